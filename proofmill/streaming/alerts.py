"""Alerts that are evaluated every minute and fire once their condition has held for a while: over a stream, and over a table.

Both count the events of each minute first. The stream keeps a rule's minutes in state and wakes by timers of event time;
the table spreads every minute over the evaluations that look back on it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


@dataclass(frozen=True)
class Rule:
    """Looks back ``minutes``; breached above ``limit`` by the count of its events, or by a ``quantile`` of their time; fires after ``hold`` minutes."""

    name: str
    minutes: int
    limit: float
    hold: int = 0
    quantile: float | None = None


#: What is watched.
RULES = (Rule("model_errors", 10, 0), Rule("latency_p95", 10, 60_000, 5, 0.95), Rule("truncation", 15, 0))
STATES = "rule string, minute timestamp, state string, value double"


def _watched(rules: tuple[Rule, ...]) -> Column:
    """The rules that an event counts for, with its time where that matters."""
    model = F.col("stage") == "stage2_ocr_classify"
    tests = {"model_errors": model & (F.coalesce("model_error", F.lit("")) != ""), "latency_p95": model & F.col("ms").isNotNull(), "truncation": model & (F.col("finish_reason") == "length")}
    hits = [F.when(tests[r.name], F.struct(F.lit(r.name).alias("rule"), (F.col("ms") if r.quantile else F.lit(0.0)).cast("double").alias("value"))) for r in rules]
    return F.array_compact(F.array(*hits))


def by_minute(events: DataFrame, rules: tuple[Rule, ...] = RULES, lateness: str | None = None) -> DataFrame:
    """``rule, at, value, n``: events of each minute; a minute has what came after its beginning, up to its end (``at``, less a microsecond)."""
    moved = events.withColumn("at", F.col("ts") - F.expr("INTERVAL '0.000001' SECOND"))
    moved = moved.withWatermark("at", lateness) if lateness else moved
    hits = moved.select("at", F.explode(_watched(rules)).alias("hit"))
    return hits.groupBy(F.window("at", "1 minute"), "hit.rule", "hit.value").agg(F.count("*").alias("n")).select("rule", F.window_time("window").alias("at"), "value", "n")


def quantile(counts: list[tuple[float, int]], q: float) -> float:
    """The interpolated quantile of values with their counts."""
    counts, seen = sorted(counts), 0
    place = q * (sum(n for _, n in counts) - 1)
    low, ends = int(place), []
    for i in (low, low + 1):
        seen = 0
        for value, n in counts:
            seen += n
            if i < seen:
                break
        ends.append(value)
    return ends[0] + (place - low) * (ends[1] - ends[0])


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["rule", "minute", "state", "value"]).astype({"rule": object, "minute": "datetime64[us]", "state": object, "value": float})


class Watch(StatefulProcessor):
    """One rule: the counts of the minutes it looks back on, its state, since when, and the last minute it was evaluated at."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = {r.name: r for r in rules}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getMapState("counts", "minute long, value double", "n long")
        self.state = handle.getValueState("state", "name string, since long, done long, timer long")

    def _now(self) -> tuple[str, int, int, int]:
        return tuple(self.state.get()) if self.state.exists() else ("normal", 0, -1, -1)

    def _wake(self, minute: int) -> int:
        self.handle.registerTimer(minute * 60_000)
        return minute

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        first = None
        for batch in rows:
            for at, value, n in zip(batch["at"], batch["value"], batch["n"]):
                minute = int(pd.Timestamp(at).timestamp() // 60) + 1
                held = self.counts.getValue((minute, value))[0] if self.counts.containsKey((minute, value)) else 0
                self.counts.updateValue((minute, value), (held + int(n),))
                first = minute if first is None else min(first, minute)
        name, since, done, timer = self._now()
        if first is not None and (timer < 0 or first < timer):
            if timer >= 0:
                self.handle.deleteTimer(timer * 60_000)
            self.state.update((name, since, done, self._wake(max(first, done + 1))))
        yield _frame([])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        rule, out = self.rules[key[0]], []
        counts = {k: v[0] for k, v in self.counts.iterator()}
        name, since, done, minute = self._now()
        last = timerValues.getCurrentWatermarkInMs() // 60_000
        while minute <= last and (counts or name != "normal"):
            for k in [k for k in counts if k[0] <= minute - rule.minutes]:
                del counts[k]
                self.counts.removeKey(k)
            seen = [(k[1], n) for k, n in counts.items() if k[0] <= minute]
            value = (quantile(seen, rule.quantile) if rule.quantile else float(sum(n for _, n in seen))) if seen else None
            before = name
            if value is not None and value > rule.limit:
                since = minute if name == "normal" else since
                name = "firing" if minute - since >= rule.hold else "pending"
            else:
                name = "normal"
            if name != before:
                out.append((rule.name, datetime.fromtimestamp(minute * 60, UTC).replace(tzinfo=None), "resolved" if before == "firing" else name, value))
            done = minute
            minute += 1
            if not counts and name == "normal":
                break
        timer = self._wake(minute) if counts or name != "normal" else -1
        self.state.update((name, since, done, timer))
        yield _frame(out)

    def close(self) -> None:
        pass


def watch(events: DataFrame, rules: tuple[Rule, ...] = RULES, lateness: str = "10 minutes") -> DataFrame:
    """``rule, minute, state, value`` of a stream of events: a row when a rule becomes pending, firing, resolved or normal again.

    Minutes are evaluated once the watermark has passed them. A rule's state holds the different values of the minutes it
    looks back on, counted by all tasks before; it lies in RocksDB, which this sets as the session's state store.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    counted = by_minute(events, rules, lateness)
    return counted.groupBy("rule").transformWithStateInPandas(Watch(rules), STATES, "append", "eventTime")


def states(events: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of :func:`watch` for a table of events, as if every minute had been evaluated; without the values of ends."""
    minute = (F.unix_timestamp("at").cast("long") / 60).cast("long") + 1
    per = by_minute(events, rules).withColumn("minute", minute)
    of = F.broadcast(events.sparkSession.createDataFrame([(r.name, r.minutes, float(r.limit), r.hold, r.quantile) for r in rules], "rule string, span int, limit double, hold int, quantile double"))
    seen = per.join(of, "rule").withColumn("minute", F.explode(F.sequence(F.col("minute"), F.col("minute") + F.col("span") - 1)))
    levels = {q: F.expr(f"percentile(value, {q}D, n)") for q in sorted({r.quantile for r in rules if r.quantile})}
    quantiled = F.coalesce(*(F.when(F.first("quantile") == q, level) for q, level in levels.items()), F.sum("n").cast("double")) if levels else F.sum("n").cast("double")
    found = seen.groupBy("rule", "minute", "limit", "hold").agg(quantiled.alias("value")).where("value > limit")
    # One row for each breached minute of a rule: consecutive ones keep the same distance from their number.
    number = F.row_number().over(W.partitionBy("rule").orderBy("minute"))
    runs = found.withColumn("run", F.col("minute") - number).groupBy("rule", "run", "hold").agg(F.min("minute").alias("a"), F.max("minute").alias("b"))
    fires = F.col("b") - F.col("a") >= F.col("hold")
    step = lambda state, minute, when=F.lit(True): F.when(when, F.struct(minute.alias("minute"), F.lit(state).alias("state")))
    steps = F.array_compact(F.array(
        step("pending", F.col("a"), F.col("hold") > 0), step("firing", F.col("a") + F.col("hold"), fires), step("resolved", F.col("b") + 1, fires), step("normal", F.col("b") + 1, ~fires),
    ))
    return runs.select("rule", F.explode(steps).alias("s")).select("rule", F.timestamp_seconds(F.col("s.minute") * 60).alias("minute"), "s.state")
