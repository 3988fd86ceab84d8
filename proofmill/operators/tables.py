"""Keyed writes as pure transformations: upserts, insert-if-absent, the job queue, retention, scopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def scoped(df: DataFrame, scope: str = "real") -> DataFrame:
    """Rows of the real data, the test data or all."""
    return {"real": df.where("NOT is_test"), "test": df.where("is_test"), "all": df}[scope]


def latest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The last row for each key: the state that an append-only log describes."""
    first = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")


def upsert(table: DataFrame, rows: DataFrame, keys: list[str], keep: dict[str, str] | None = None) -> DataFrame:
    """``rows`` over ``table``; a column in ``keep`` has the ``min`` or ``max`` of both (as a first-seen time)."""
    both = table.withColumn("__new", F.lit(0)).unionByName(rows.withColumn("__new", F.lit(1)))
    every = W.partitionBy(*keys)
    for c, how in (keep or {}).items():
        both = both.withColumn(c, getattr(F, how)(c).over(every))
    rest = [F.col(c) for c in table.columns]
    return latest(both, keys, F.desc("__new"), *rest).drop("__new")


def insert_if_absent(table: DataFrame, rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The rows that an insert would add: keys not in ``table``, of equal keys the first."""
    return latest(rows, keys, *order).join(table.select(*keys), keys, "left_anti")


def claim(jobs: DataFrame, now: Column, n: int = 1, lease_seconds: int = 300) -> DataFrame:
    """The next ``n`` jobs: pending, or with an expired lease; with their state before and after the claim."""
    free = (F.col("status") == "pending") | ((F.col("status") == "in_progress") & (F.col("lease_until") < now))
    taken = jobs.where(free).orderBy("priority", "created_at", "job_id").limit(n)
    return taken.withColumns({
        "prev_status": F.col("status"), "prev_attempts": F.col("attempts"), "status": F.lit("in_progress"), "attempts": F.col("attempts") + 1,
        "lease_until": now + F.make_dt_interval(secs=F.lit(lease_seconds)), "reclaimed": F.col("status") == "in_progress",
    })


def complete(jobs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Jobs with a row in ``verdicts(job_id, verdict)`` become done."""
    j = jobs.join(verdicts, "job_id", "left")
    done = F.col("verdict").isNotNull()
    return j.withColumns({
        "status": F.when(done, "done").otherwise(F.col("status")), "verification_status": F.coalesce("verdict", "verification_status"),
        "last_error": F.when(~done, F.col("last_error")),
    }).drop("verdict")


def fail(jobs: DataFrame, errors: DataFrame) -> DataFrame:
    """Jobs with a row in ``errors(job_id, error)`` wait again, or fail once their attempts are used up."""
    j = jobs.join(errors, "job_id", "left")
    hit = F.col("error").isNotNull()
    again = F.when(F.col("attempts") >= F.col("max_attempts"), "failed").otherwise("pending")
    return j.withColumns({
        "status": F.when(hit, again).otherwise(F.col("status")), "last_error": F.when(hit, F.substring("error", 1, 1000)).otherwise(F.col("last_error")),
        "lease_until": F.when(~hit, F.col("lease_until")),
    }).drop("error")


def requeue(jobs: DataFrame) -> DataFrame:
    """Failed jobs wait again, with all their attempts."""
    failed = F.col("status") == "failed"
    return jobs.withColumns({
        "attempts": F.when(failed, 0).otherwise(F.col("attempts")), "last_error": F.when(~failed, F.col("last_error")), "status": F.when(failed, "pending").otherwise(F.col("status")),
    })


def backoff_seconds(over: Column, base: float = 8.0, cap: float = 60.0) -> Column:
    """Pause of the circuit breaker after ``over`` failures beyond its threshold, before jitter."""
    return F.least(F.lit(cap), F.lit(base) * F.pow(F.lit(2.0), over))


def purge(df: DataFrame, column: str, days: float, as_of: Column) -> DataFrame:
    """Rows not older than ``days``; zero or less keeps all."""
    return df if days <= 0 else df.where(F.col(column) >= as_of - F.make_dt_interval(secs=F.lit(float(days) * 86400)))


def clear_test(table: DataFrame, jobs: DataFrame, batch_id: str | None = None) -> DataFrame:
    """``table`` without test rows, of one batch or all."""
    if batch_id is None:
        return table.where("NOT is_test")
    gone = jobs.where(F.col("is_test") & (F.col("batch_id") == batch_id)).select("lead_id").distinct().withColumn("is_test", F.lit(True))
    return table.join(gone, ["lead_id", "is_test"], "left_anti")


def purge_blobs(blobs: DataFrame, jobs: DataFrame, days: float, as_of: Column) -> DataFrame:
    """Blobs that stay: used lately, or still named by an open job."""
    if days <= 0:
        return blobs
    open_jobs = jobs.where(F.col("status").isin("pending", "in_progress") & F.col("image_url").startswith("blob:"))
    named = open_jobs.select(F.substring("image_url", 6, 64).alias("sha256")).distinct()
    recent = F.col("last_used") >= as_of - F.make_dt_interval(secs=F.lit(float(days) * 86400))
    kept = blobs.join(named.withColumn("__open", F.lit(True)), "sha256", "left")
    return kept.where(recent | F.col("__open")).drop("__open")


def review_rows(requests: DataFrame, results: DataFrame, reviewer: str = "reviewer") -> DataFrame:
    """Review requests (``lead_id, decision, corrected_status, reviewer, note``) as ledger rows with an ``error`` where refused."""
    r = requests.join(results.select("lead_id", F.col("verification_status").alias("system_status"), "is_test"), "lead_id", "left")
    wants, fixed = F.col("decision") == "overturned", F.nullif(F.trim(F.coalesce("corrected_status", F.lit(""))), F.lit(""))
    valid = fixed.isin("verified", "unverified", "non_document", "unprocessed", "duplicate")
    overturned = wants & F.coalesce(fixed != F.col("system_status"), F.lit(False))
    return r.withColumns({
        "error": F.when(F.col("system_status").isNull(), "no such lead").when(wants & ~F.coalesce(valid, F.lit(False)), "corrected_status is not valid"),
        "decision": F.when(overturned, "overturned").otherwise("confirmed"),
        "corrected_status": F.when(overturned, fixed).otherwise(F.col("system_status")),
        "reviewer": F.coalesce(F.nullif(F.trim("reviewer"), F.lit("")), F.lit(reviewer)),
    })
