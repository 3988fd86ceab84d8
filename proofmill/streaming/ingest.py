"""Rows of a growing source into the queue, exactly once in effect."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.cursors import REASON, quarantine_key, run_row
from ..operators.dedup import with_identity
from ..operators.keyed import KeyedTable
from ..operators.mapping import Mapping, map_rows
from ..sources.scratch import discard, materialise

#: Priorities of rows that arrive live and of those that a backfill brings.
LIVE, BACKFILL = 5, 8


def queue_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> KeyedTable:
    return KeyedTable(spark, path, ["lead_id"], schema)


def quarantine_table(spark: SparkSession, path: str) -> KeyedTable:
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("source", "source_key", "source_row", "reason")])
    return KeyedTable(spark, path, ["source", "source_key"], schema.add("first_seen", T.TimestampType()).add("resolved", T.BooleanType()), {"first_seen": "min"})


def ingest(raw: DataFrame, mapping: Mapping, queue: str, quarantine: str, priority: int = LIVE, batch: str = "batch", source: str = "primary", runs: str | None = None) -> None:
    """Valid rows into ``queue`` unless their lead is there; the others into ``quarantine`` with the reason, where a row that comes again is unresolved again.

    ``runs`` gets a row of counts for the batch. Running a batch again replaces what it wrote, so a restart after a failure
    between two writes is harmless. The mapped rows are written once, so that the source is read once.
    """
    spark, started = raw.sparkSession, datetime.now(UTC)
    rows = materialise(map_rows(raw, mapping))
    valid = rows.where("reason IS NULL").drop("reason").withColumns({"priority": F.lit(priority), "status": F.lit("pending")})
    table = queue_table(spark, queue, valid.schema)
    new = materialise(table.absent(valid, batch))
    table.write(new, batch)
    content = F.to_json(F.struct(*(F.col(f"`{c}`") for c in rows.columns if c not in ("lead_id", "reason"))))
    bad = rows.where("reason IS NOT NULL").select(
        F.lit(source).alias("source"), quarantine_key(F.col("lead_id"), content).alias("source_key"), content.alias("source_row"), F.substring("reason", 1, REASON).alias("reason"),
        F.lit(started).alias("first_seen"), F.lit(False).alias("resolved"),
    )
    quarantine_table(spark, quarantine).write(bad, batch)
    if runs:
        seen = rows.select("reason", "lead_id").join(new.select("lead_id").withColumn("is_new", F.lit(True)), "lead_id", "left")
        # Of rows with one lead in a batch one is new, the others are duplicates.
        counted = seen.withColumn("is_new", F.col("is_new") & (F.row_number().over(W.partitionBy("lead_id").orderBy(F.col("reason").isNotNull())) == 1))
        row = run_row(counted.withColumn("is_new", F.coalesce("is_new", F.lit(False))), source, "backfill" if priority == BACKFILL else "live", F.lit(started), F.current_timestamp())
        row.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{runs}/run={source}-{batch}")
    discard(rows, new)


def start_ingest(
    stream: DataFrame, mapping: Mapping, queue: str, quarantine: str, checkpoint: str, backfill: bool = False, source: str = "primary", runs: str | None = None, compact_every: int = 50
) -> StreamingQuery:
    """Ingest every micro-batch of ``stream``; late rows are accepted, as nothing here depends on time.

    The checkpoint holds the source's offsets: it is the cursor, it never goes back, and one query at a time
    may use it. A backfill reads what there is, in batches as the source limits them, and stops. Every ``compact_every``
    batches the tables' logs are folded into their bases.
    """

    def take(df: DataFrame, n: int) -> None:
        if n and n % compact_every == 0:  # before the batch, so that repeating it finds its own log
            queue_table(df.sparkSession, queue).compact()
            quarantine_table(df.sparkSession, quarantine).compact()
        ingest(df, mapping, queue, quarantine, BACKFILL if backfill else LIVE, f"{source}-{n}", source, runs)

    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(take)
    return (writer.trigger(availableNow=True) if backfill else writer.trigger(processingTime="120 seconds")).start()


def cursor(rows: DataFrame, created_at: str = "created_at", id_col: str = "id") -> DataFrame:
    """The last ``(ts, id)`` of a table as one row: null of an empty one."""
    return rows.agg(F.max(F.struct(F.col(created_at).alias("ts"), F.col(id_col).cast("string").alias("id"))).alias("cursor"))


def throughput(events: DataFrame, width: str = "1 minute", lateness: str = "10 minutes") -> DataFrame:
    """``minute, n``: leads closed in each tumbling window, for a table of events or a stream of them."""
    closed = events.where("stage = 'lead_closed'").withWatermark("ts", lateness)
    return closed.groupBy(F.window("ts", width)).agg(F.count("*").alias("n")).select(F.col("window.start").alias("minute"), "n")


def within(events: DataFrame, as_of, minutes: int) -> DataFrame:
    """Events of the last ``minutes`` before ``as_of``."""
    return events.where((F.col("ts") > F.lit(as_of) - F.make_dt_interval(mins=F.lit(minutes))) & (F.col("ts") <= F.lit(as_of)))


class Claims(StatefulProcessor):
    """The claims under one lead code, each under its own key of the state: who owns it, and which loans are known."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.owners = handle.getMapState("owners", "loan string, paid string", "lead_id string")
        self.loans = handle.getMapState("loans", "loan string", "known boolean")

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues) -> None:
        for r in initialState.itertuples():
            self.owners.updateValue((r.loan, r.paid), (r.lead_id,))
            self.loans.updateValue((r.loan,), (True,))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        out, any_known = [], next(iter(self.loans.keys()), None) is not None
        for r in pd.concat(list(rows)).sort_values(["seq", "lead_id"]).itertuples():
            claim, loan = (r.loan, r.paid), (r.loan,)
            if self.owners.containsKey(claim):
                verdict = "duplicate"
            else:
                verdict = "new" if not any_known else "emi" if self.loans.containsKey(loan) else "manual_review"
                self.owners.updateValue(claim, (r.lead_id,))
                self.loans.updateValue(loan, (True,))
                any_known = True
            out.append((r.lead_id, verdict, self.owners.getValue(claim)[0]))
        yield pd.DataFrame(out, columns=["lead_id", "dedup", "owner"])

    def close(self) -> None:
        pass


def _claims(rows: DataFrame, *more: Column | str) -> DataFrame:
    return rows.select("is_test", F.col("lead_code").alias("code"), "lead_id", F.col("loan_acct").alias("loan"), F.concat_ws("|", "amount", "pay_ym").alias("paid"), *more)


def dedup_stream(leads: DataFrame, order: str = "seq", ledger: DataFrame | None = None) -> DataFrame:
    """``lead_id, dedup, owner`` for a stream of leads: the batch verdicts, kept across micro-batches.

    State is held for each lead code (real and test rows apart), one entry for each claim, so it grows with the claims and no
    row of it does; it is kept in RocksDB, which this sets as the session's state store. Inside a micro-batch leads count in the
    order of ``order``, then ``lead_id``; the leads that a code has in one micro-batch are sorted in one task, so the
    source's limit on micro-batches bounds them. A lead that comes again meets its own claim and keeps its owner.

    ``ledger`` (rows as from :func:`dedup.ledger_rows`, one for each identity) is the state of a new query's first batch, so that
    it goes on where a batch job ended; a query that restarts from its checkpoint has it already.
    """
    leads.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    part = with_identity(leads).where("identity IS NOT NULL")
    rows = _claims(part.select("is_test", "lead_id", "identity.*", F.col(order).cast("long").alias("seq")), "seq")
    known = None if ledger is None else _claims(ledger).groupBy("is_test", "code")
    return rows.groupBy("is_test", "code").transformWithStateInPandas(Claims(), "lead_id string, dedup string, owner string", "append", "none", known)


def ledger_difference(spark: SparkSession, checkpoint: str, ledger: DataFrame) -> DataFrame:
    """Claims that only one of a stream's state and a ledger has: ``is_test, code, loan, paid, in_state, in_ledger`` (the owners).

    The state is read from the checkpoint by Spark's own reader, one state variable at a time.
    """
    state = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "owners").load()
    held = state.select("key.is_test", "key.code", "user_map_key.loan", "user_map_key.paid", F.col("user_map_value.lead_id").alias("in_state"))
    claims = _claims(ledger).withColumnRenamed("lead_id", "in_ledger")
    both = held.join(claims, ["is_test", "code", "loan", "paid"], "full_outer")
    return both.where(~F.col("in_state").eqNullSafe(F.col("in_ledger")))
