"""The state of incremental ingestion as tables: cursors, runs and quarantined rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import latest, upsert

#: Characters kept of a reason and of an error.
REASON, ERROR = 500, 1000


def seed(cursors: DataFrame, sources: DataFrame, at: Column) -> DataFrame:
    """``cursors(source, wm_ts, wm_id)`` with every source of ``sources``; new ones start at ``at``, so that live ingestion takes no history."""
    new = sources.select("source").distinct().join(cursors.select("source"), "source", "left_anti")
    return cursors.unionByName(new.select("source", at.cast("timestamp").alias("wm_ts"), F.lit("").alias("wm_id")))


def advance(cursors: DataFrame, reached: DataFrame, backward: bool = False) -> DataFrame:
    """``cursors`` moved to ``reached(source, wm_ts, wm_id)``; unless ``backward``, only to a later time or, at the same time, id."""
    if backward:
        return upsert(cursors, reached.select(cursors.columns), ["source"])
    both = cursors.unionByName(reached.select(cursors.columns))
    return latest(both, ["source"], F.desc("wm_ts"), F.desc("wm_id"))


def reset(cursors: DataFrame, source: str, to: Column) -> DataFrame:
    """``cursors`` with one source set back for a backfill."""
    row = cursors.sparkSession.range(1).select(F.lit(source).alias("source"), to.cast("timestamp").alias("wm_ts"), F.lit("").alias("wm_id"))
    return advance(cursors, row, backward=True)


def overlapping(rows: DataFrame, cursor_ts: Column, minutes: int = 10, created_at: str = "created_at") -> DataFrame:
    """The rows of a poll: from ``minutes`` before the cursor on, so that rows written late are read too; keys absorb what comes twice."""
    return rows.where(F.col(created_at) >= cursor_ts - F.make_dt_interval(mins=F.lit(minutes)))


def quarantine_key(lead_id: Column, row: Column) -> Column:
    """The lead's id, else one from the row's content."""
    return F.coalesce(lead_id, F.concat(F.lit("h:"), F.substring(F.sha1(row), 1, 16)))


def quarantined(table: DataFrame, rows: DataFrame) -> DataFrame:
    """``table`` after an upsert of rejected rows (``source, source_key, source_row, reason, first_seen``).

    A row that comes again has its new content and reason, is unresolved again and keeps the time it was first seen.
    """
    new = rows.withColumns({"reason": F.substring("reason", 1, REASON), "resolved": F.lit(False)})
    return upsert(table, new.select(table.columns), ["source", "source_key"], {"first_seen": "min"})


def run_row(rows: DataFrame, source: str, mode: str, started: Column, finished: Column, error: str | None = None) -> DataFrame:
    """One row of bookkeeping for an ingestion cycle over ``rows(reason, is_new)``: mapped rows and whether their lead is new."""
    bad = F.col("reason").isNotNull()
    return rows.agg(
        F.count("*").alias("rows_seen"), F.count_if(~bad & F.col("is_new")).alias("enqueued"), F.count_if(~bad & ~F.col("is_new")).alias("duplicates"), F.count_if(bad).alias("quarantined")
    ).select(F.lit(source).alias("source"), F.lit(mode).alias("mode"), started.alias("started_at"), finished.alias("finished_at"), "rows_seen", "enqueued", "duplicates", "quarantined",
             F.lit(error is None).alias("ok"), F.lit(error and error[:ERROR]).cast("string").alias("error"))
