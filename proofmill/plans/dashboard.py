"""All that the dashboard shows from one scan of each table.

A scan sums its table into a cube: one row for each combination of what the panels group by, filter by or take percentiles of,
with a count. The cubes are written once, and every panel is a small query over one of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.quantiles import quantiles
from ..operators.tables import latest
from ..sources.scratch import materialise
from . import metrics

FIELDS = {"amount": "amount", "date": "date", "receiver": "receiver_name", "lan": "loan_account_number"}


def _since(column: str, table: str, interval: str):
    """Rows of the last ``interval``; the newest row is looked up in that column alone."""
    return F.expr(f"{column} > (SELECT max({column}) FROM {table}) - INTERVAL {interval}")


def event_cube(events: DataFrame) -> DataFrame:
    model = F.col("stage") == "stage2_ocr_classify"
    return events.select(
        "stage", F.expr("cast(floor(unix_timestamp(ts) / 60) * 60 as bigint)").alias("minute"), _since("ts", "lead_events", "2880 MINUTES").alias("recent"), "ms",
        F.when(model & (F.col("model_ms") > 0), F.col("model_ms")).alias("model_ms"), (model & (F.col("cache") == "hit")).alias("hit"), (model & (F.coalesce("model_error", F.lit("")) != "")).alias("error"),
    ).groupBy("stage", "minute", "recent", "ms", "model_ms", "hit", "error").agg(F.count("*").alias("n"))


def result_cube(results: DataFrame) -> DataFrame:
    failed = lambda path: F.from_json(F.get_json_object("outcome", path), "array<string>")
    filled = {f"has_{name}": F.coalesce(F.get_json_object("extracted", f"$.{path}"), F.lit("")) != "" for name, path in FIELDS.items()}
    return results.select(
        "lender", F.col("verification_status").alias("status"), F.col("updated_at").cast("date").alias("day"), _since("updated_at", "lead_results", "14 DAYS").alias("recent"),
        F.coalesce(failed("$.failed_fields"), failed("$.verification.failed_fields")).alias("failed"), *(v.alias(k) for k, v in filled.items()),
    ).groupBy("lender", "status", "day", "recent", "failed", *filled).agg(F.count("*").alias("n"))


def review_cube(reviews: DataFrame) -> DataFrame:
    last = latest(reviews, ["lead_id"], F.desc("id"))
    return last.select("system_status", "decision", "corrected_status", F.date_format("ts", "MM-dd").alias("t"), _since("ts", "lead_reviews", "14 DAYS").alias("recent")).groupBy(
        "system_status", "decision", "corrected_status", "t", "recent").agg(F.count("*").alias("n"))


def snapshot(spark: SparkSession, scope: str = "real") -> dict[str, DataFrame]:
    """The panels of ``metrics.SNAPSHOT`` by name, equal to the queries of that name, over the registered lead views."""
    table = lambda name: spark.sql(f"SELECT * FROM {metrics.scoped(name, scope)} x")
    ev, res, rev = materialise(event_cube(table("lead_events"))), materialise(result_cube(table("lead_results"))), materialise(review_cube(table("lead_reviews")))
    n_if = lambda when: F.coalesce(F.sum(F.when(when, F.col("n"))), F.lit(0))
    count = F.coalesce(F.sum("n"), F.lit(0))
    pct = lambda n, of, places=1: F.round(F.lit(100.0) * n / F.nullif(of, F.lit(0)), places)
    mean = lambda c: F.round(F.sum(F.col(c) * F.col("n")) / F.sum(F.when(F.col(c).isNotNull(), F.col("n"))), 6)
    clock = lambda c: F.date_format(F.timestamp_seconds(c), "HH:mm")
    shares = lambda places, kind: [pct(n_if(F.col(f"has_{f}")), count, places).cast(kind).alias(f) for f in FIELDS]
    model, one = ev.where("model_ms IS NOT NULL"), F.lit(True)
    recent_model = model.where("recent")
    read = res.where("status IN ('verified', 'unverified')")
    named = res.where("coalesce(lender, '') <> ''")
    rules, lists = (spark.createDataFrame([(x,) for x in names], "lender string").withColumn(flag, F.lit(True)) for names, flag in ((metrics.RULES, "explicit_rule"), (metrics.RECEIVERS, "receiver_list")))
    covered = named.groupBy("lender").agg(F.sum("n").alias("n")).join(F.broadcast(lists), "lender", "left").join(F.broadcast(rules), "lender", "left")
    half = {"p50": 0.5, "p95": 0.95}
    of_model = model.agg(count.alias("n"), mean("model_ms").alias("avg"), F.max("model_ms").alias("max"))
    series = recent_model.groupBy("minute").agg(F.sum("n").alias("n"))
    of_stage = ev.where("ms IS NOT NULL").groupBy(F.col("stage").alias("s")).agg(F.sum("n").alias("n"), mean("ms").alias("avg_ms"))
    stage2 = F.col("stage") == "stage2_ocr_classify"
    reviewed = rev.agg(
        count.alias("reviewed"), n_if(F.col("decision") == "confirmed").alias("confirmed"), n_if(F.col("decision") == "overturned").alias("overturned"),
        *(n_if((F.col("system_status") == s) & when).alias(f"{s}_{name}") for s in ("verified", "unverified") for name, when in (("reviewed", one), ("overturned", F.col("decision") == "overturned"))),
    ).join(F.broadcast(res.agg(count.alias("total_results"))))
    c = F.col
    return {
        "a7_model_latency": of_model.join(quantiles(model, [], "model_ms", half | {"p99": 0.99}, "n"), one, "left").select("n", "p50", "p95", "p99", "avg", "max"),
        "a8_latency_series": series.join(quantiles(recent_model, ["minute"], "model_ms", half, "n"), "minute").select("minute", clock("minute").alias("t"), "n", "p50", "p95"),
        "a9_throughput": ev.where("stage = 'lead_closed' AND recent").groupBy("minute").agg(F.sum("n").alias("n")).select("minute", clock("minute").alias("t"), "n"),
        "a10_stage_timings": of_stage.join(quantiles(ev, ["stage"], "ms", {"p95_ms": 0.95}, "n"), c("s") == c("stage")).select("stage", "n", "avg_ms", "p95_ms"),
        "a11_queue": spark.sql(metrics.analytics(metrics.SPARK, scope)["a11_queue"]),
        "a13_model_errors": ev.agg(n_if(c("error")).alias("n")),
        "a12_cache": ev.agg(n_if(c("hit")).alias("served_from_cache"), n_if(stage2).alias("stage2_total"), pct(n_if(c("hit")), n_if(stage2)).alias("hit_rate_pct")),
        "a14_unverified_reasons": res.where("status = 'unverified'").select(F.explode("failed").alias("field"), "n").groupBy("field").agg(F.sum("n").alias("n")),
        "a15_lender_funnel": named.groupBy("lender").agg(count.alias("total"), *(n_if(c("status") == s).alias(s) for s in ("verified", "unverified", "duplicate", "non_document", "unprocessed"))).orderBy(F.desc("total"), "lender").limit(40),
        "a16_fillrates": read.agg(count.alias("n"), *(n_if(c(f"has_{f}")).alias(f) for f in FIELDS)),
        "a17_fillrate_series": read.where("recent").groupBy("day").agg(count.alias("n"), *shares(0, "int")).select(c("day").cast("string").alias("day"), F.date_format("day", "MM-dd").alias("t"), "n", *FIELDS),
        "a18_config_coverage": covered.select("lender", "n", *(F.coalesce(x, F.lit(False)).alias(x) for x in ("receiver_list", "explicit_rule"))).where("NOT receiver_list OR NOT explicit_rule"),
        "a20_review_accuracy": reviewed.select(
            "reviewed", "confirmed", "overturned", "verified_reviewed", "verified_overturned", "unverified_reviewed", "unverified_overturned", "total_results",
            pct(c("reviewed"), c("total_results")).alias("coverage_pct"), pct(c("confirmed"), c("reviewed")).alias("agreement_pct"),
            pct(c("verified_reviewed") - c("verified_overturned"), c("verified_reviewed")).alias("verified_precision_pct"), pct(c("unverified_overturned"), c("unverified_reviewed")).alias("unverified_overturn_pct"),
        ),
        "a22_accuracy_series": rev.where("recent").groupBy("t").agg(count.alias("reviewed"), n_if(c("decision") == "confirmed").alias("confirmed"), pct(n_if(c("decision") == "confirmed"), count).alias("agreement_pct")),
        "a21_confusion": rev.where("decision = 'overturned' AND corrected_status IS NOT NULL").groupBy("system_status", "corrected_status").agg(F.sum("n").alias("n")),
    }
