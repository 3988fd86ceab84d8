"""Accuracy of the learned operators on rows outside their training folds, and the pipeline's end."""

from pyspark.sql import functions as F

import corpus_pipeline
from proofmill.llm import queries

SF = "/root/testdata/sf0.01"


def share(df, a, b):
    return df.agg(F.avg((F.col(a) == F.col(b)).cast("int"))).first()[0]


def test_op5_held_out(spark):
    lang = queries.table(spark, SF, "documents").select("doc_id", "lang")
    rows = queries.op5_language(spark, SF).join(lang, "doc_id").where("held_out AND lang IS NOT NULL AND lang_pred <> 'und'")
    assert share(rows, "lang", "lang_pred") >= 0.95


def test_op10_held_out(spark):
    rows = queries.op10_quality(spark, SF).join(queries.table(spark, SF, "labels"), "doc_id").where("held_out AND quality IS NOT NULL")
    assert share(rows, "quality", "predicted") >= 0.95


def test_pipeline_stages_keep_the_columns(spark):
    docs = queries.table(spark, SF, "documents")
    kept = corpus_pipeline.near_dedup(spark, docs, SF)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    assert corpus_pipeline.quality(spark, docs, SF).columns == docs.columns
    assert corpus_pipeline.decontaminate(spark, docs, SF).columns == docs.columns
    assert corpus_pipeline.substring_dedup(spark, docs, SF).columns == docs.columns
