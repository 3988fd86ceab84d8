"""Benchmark decontamination: size-partitioned MinHash containment search, verified on exact shingles.

Only DataFrame functions: no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise, packed, small, unpacked

#: Everything but letters, marks and digits separates words.
SEPARATOR = r"[^\p{L}\p{M}\p{N}]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), SEPARATOR), "")


def _shingles(df: DataFrame, shingle: int, exact: bool) -> DataFrame:
    """Replace ``words`` by one row per shingle: its words joined (``exact``) or their 64-bit hash."""
    parts = lambda i: [F.get("words", i + k) for k in range(shingle)]
    last = F.size("words") - shingle
    one = (lambda i: F.concat_ws(" ", *parts(i))) if exact else (lambda i: F.xxhash64(*parts(i)))
    all_of = F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), one))
    return df.withColumn("shingle", F.explode(all_of)).drop("words")


def sketches(items: DataFrame, shingle: int, containment: float) -> DataFrame:
    """Rows ``item, n, shingle, h, in_sketch`` of the distinct shingles of ``items(item, words)``.

    Items fall into classes by size (powers of two). The bottom-k MinHash sketch of an item has the k of
    its class: a text that holds ``containment`` of the item lacks fewer than k of its shingles, so it
    holds one of any k. A document's own MinHash could not find short items, as the minima of a
    long text nearly always lie outside the item.
    """
    rows = _shingles(items, shingle, True).distinct()
    every, by_hash = W.partitionBy("item"), W.partitionBy("item").orderBy("h", "shingle")
    upper = F.pow(F.lit(2), F.ceil(F.log2("n"))).cast("long")
    k = upper - F.ceil(upper * F.lit(containment) - 1e-9) + 1
    return (
        rows.withColumn("n", F.count("*").over(every))
        .withColumn("h", F.xxhash64(*(F.get(F.split("shingle", " "), i) for i in range(shingle))))
        .withColumn("in_sketch", F.row_number().over(by_hash) <= k)
    )


def contaminated(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id",
    item_text: str = "text", shingle: int = 5, containment: float = 0.8,
) -> DataFrame:
    """Rows ``doc_id, item_id, n_shingles, n_shared, containment, text_hash, sha``: documents that hold an item.

    A document holds an item if it has at least ``containment`` of the item's distinct word shingles;
    words are lower-cased runs of letters, marks and digits. Search: each document shingle probes the
    items' sketches. Verification: for the pairs found, the item's shingles are looked up among the document's as
    text, so a shingle that many items or documents share meets only the items its document was found with.

    Items and texts of fewer than ``shingle`` words (or null) have no shingles and match nothing. Rows
    equal in id and text give one result row; several items with the same id count as one item. Null ids, of
    documents and of items, are carried like any other. Empty tables give empty results. Other columns are not read.
    """
    # In a struct a null id is equal to itself, in joins too.
    known = items.select(F.struct(F.col(item_id).alias("item_id")).alias("item"), words(F.col(item_text)).alias("words"))
    index = materialise(sketches(known, shingle, containment))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))
    sketch = index.where("in_sketch").select("h", "item")
    probe = _shingles(keyed.select("text_hash", words(F.col("text")).alias("words")), shingle, False)
    # 8 bytes for a hash; an item's id may be a text.
    size = sketch.agg(F.coalesce(F.sum(8 + F.coalesce(F.octet_length(F.col("item.item_id").cast("string")), F.lit(0))), F.lit(0))).first()[0]
    probe = probe.join(small(sketch, size), F.col("shingle") == F.col("h"))
    found = materialise(probe.select("text_hash", "item").distinct())
    held = keyed.join(found.select("text_hash").distinct(), "text_hash", "left_semi")
    held = _shingles(held.select("doc_id", "text_hash", F.sha2("text", 256).alias("sha"), words(F.col("text")).alias("words")), shingle, True)
    # Only shingles of items go on, before anything is shuffled.
    size = index.agg(F.coalesce(F.sum(F.octet_length("shingle")), F.lit(0))).first()[0]
    held = held.join(small(index.select("shingle").distinct(), size), "shingle", "left_semi").distinct()
    asked = found.join(index.select("shingle", "item", "n"), "item")
    shared = held.join(asked, ["text_hash", "shingle"])
    counts = shared.groupBy("doc_id", "text_hash", "sha", "item", F.col("n").alias("n_shingles")).agg(F.count("*").alias("n_shared"))
    share = F.col("n_shared") / F.col("n_shingles")
    return counts.where(share >= containment - 1e-9).select("doc_id", "item.item_id", "n_shingles", "n_shared", share.alias("containment"), "text_hash", "sha")


def decontaminate(docs: DataFrame, items: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text holds no item.

    Nulls, empty and very long texts, repeated rows and empty tables are handled as in :func:`contaminated`: null and short
    texts stay, repeated rows stay or go together. Columns keep their names and values, whatever they are called.
    """
    bad = materialise(contaminated(docs, items, text_col=text_col, **options).select(F.col("text_hash").alias("hash"), "sha").distinct())
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(packed(docs), F.xxhash64(text).alias("hash"), F.sha2(text, 256).alias("sha"))
    return unpacked(rows.join(bad, ["hash", "sha"], "left_anti"), docs.columns)


#: DuckDB SQL for op4: plain containment of distinct 5-word shingles.
ORACLE = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{M}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{M}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
ds AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
bs AS (SELECT DISTINCT item_id, array_to_string(w[i : i + 4], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS i FROM b)),
n AS (SELECT item_id, count(*) AS n_shingles FROM bs GROUP BY item_id)
SELECT doc_id, item_id, n_shingles, count(*) AS n_shared, count(*) / n_shingles AS containment
FROM ds JOIN bs USING (s) JOIN n USING (item_id) GROUP BY doc_id, item_id, n_shingles HAVING count(*) >= 0.8 * n_shingles - 1e-9
"""
