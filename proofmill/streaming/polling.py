"""A growing database table as a stream: Spark keeps the cursor, executors read the rows.

The offset is the place ``(ts, id)`` that was reached, in the order in which rows are created. A batch goes from one place to
the next, at most a page of rows further on and no faster than a rate. Where it reaches the end of the table it goes back by an
overlap first, so that rows which were committed late, behind the cursor, are read too; what comes twice meets its own key.
"""

from __future__ import annotations

import importlib
import json
import time
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..sources.readers import checked_name

#: Rows of a page, minutes of overlap, parts of a batch.
PAGE, OVERLAP, PARTS = 100_000, 10, 8


class Rows:
    """The table behind the options ``module`` (of a DB-API driver), ``connect``, ``table``, ``columns``, ``created_at``, ``id``."""

    def __init__(self, options: dict[str, str]):
        self.options = dict(options)
        self.table, self.ts, self.id = (checked_name(options.get(k, d)) for k, d in (("table", ""), ("created_at", "created_at"), ("id", "id")))
        self.columns = [checked_name(c.strip()) for c in options["columns"].split(",")]

    def select(self, what: str, where: str, values: tuple = (), order: str = "", size: int = 0) -> Iterator[tuple]:
        driver = importlib.import_module(self.options["module"])
        mark = "?" if driver.paramstyle == "qmark" else "%s"
        connection = driver.connect(self.options["connect"])
        try:
            cursor = connection.cursor()
            cursor.execute(f"SELECT {what} FROM {self.table} WHERE {where.replace('?', mark)} {order}" + (f" LIMIT {int(size)}" if size else ""), values)
            while rows := cursor.fetchmany(10_000):
                yield from rows
        finally:
            connection.close()

    def after(self, place: dict) -> tuple[str, tuple]:
        """Rows beyond a place; a place without an id lies before all rows of its time."""
        if not place["id"]:
            return f"{self.ts} >= ?", (place["ts"],)
        return f"({self.ts} > ? OR ({self.ts} = ? AND {self.id} > ?))", (place["ts"], place["ts"], place["id"])

    def upto(self, place: dict) -> tuple[str, tuple]:
        if not place["id"]:
            return f"{self.ts} < ?", (place["ts"],)
        return f"({self.ts} < ? OR ({self.ts} = ? AND {self.id} <= ?))", (place["ts"], place["ts"], place["id"])


def shifted(ts: str, minutes: float) -> str:
    """A time as text, moved; in the form in which it came."""
    return str(datetime.fromisoformat(ts) + timedelta(minutes=minutes))


class Part(InputPartition):
    """The rows that fit ``where``."""

    def __init__(self, where: str, values: tuple):
        self.where, self.values = where, values


class PollReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.rows, o = Rows(options), options
        self.page, self.overlap, self.parts = int(o.get("page", PAGE)), float(o.get("overlap", OVERLAP)), int(o.get("parts", PARTS))
        self.per_minute = float(o["rows_per_minute"]) if o.get("rows_per_minute") else None
        self.start = o.get("from") or datetime.now(UTC).replace(tzinfo=None, microsecond=0).isoformat(" ")
        self.at = json.loads(o["resume"]) if o.get("resume") else self.initialOffset()
        self.began, self.planned = time.monotonic(), 0

    def initialOffset(self) -> dict:
        return {"ts": self.start, "id": "", "tail": False, "late": 0}

    def _allowed(self) -> int:
        if self.per_minute is None:
            return self.page
        return max(0, min(self.page, int((time.monotonic() - self.began) / 60 * self.per_minute) - self.planned))

    def latestOffset(self) -> dict:
        """The place a page further on; at the end of the table also how many rows the overlap holds, so that late ones make a batch."""
        size = self._allowed()
        if not size:
            return self.at
        ts, id_ = self.rows.ts, self.rows.id
        where, values = self.rows.after(self.at)
        # The page's bound is its last row; only that one comes here.
        inner = f"(SELECT {ts}, {id_} FROM {self.rows.table} WHERE {where} ORDER BY {ts}, {id_} LIMIT {size}) page"
        driver_rows = Rows({**self.rows.options, "columns": ts})
        driver_rows.table = inner
        found = list(driver_rows.select(f"{ts}, {id_}", "1 = 1", values, f"ORDER BY {ts} DESC, {id_} DESC", 1))
        full = len(found) and next(driver_rows.select("COUNT(*)", "1 = 1", values))[0] == size
        place = {"ts": str(found[0][0]), "id": str(found[0][1])} if found else {k: self.at[k] for k in ("ts", "id")}
        if full:
            return {**place, "tail": False, "late": 0}
        bound, more = self.rows.upto(place)
        late = next(self.rows.select("COUNT(*)", f"{ts} >= ? AND {bound}", (shifted(place["ts"], -self.overlap), *more)))[0]
        return {**place, "tail": True, "late": int(late)}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        self.at = end
        if start == end:
            return []
        lower, values = self.rows.after(start)
        if end["tail"] and self.overlap and start["id"]:
            lower, values = f"{self.rows.ts} >= ?", (max(shifted(start["ts"], -self.overlap), self.start),)
        upper, more = self.rows.upto(end)
        where, values = f"{lower} AND {upper}", (*values, *more)
        if self.per_minute is not None:
            self.planned += next(self.rows.select("COUNT(*)", where, values))[0]
        low, high = next(self.rows.select(f"MIN({self.rows.ts}), MAX({self.rows.ts})", where, values))
        if low is None:
            return []
        # Equal steps of time; rows of one time stay together.
        a, b = datetime.fromisoformat(str(low)), datetime.fromisoformat(str(high))
        cuts = sorted({str(a + (b - a) * i / self.parts) for i in range(1, self.parts)} - {str(a)})
        edges = [None, *cuts, None]
        out = []
        for lo, hi in zip(edges, edges[1:]):
            tests = [where] + [f"{self.rows.ts} >= ?"] * (lo is not None) + [f"{self.rows.ts} < ?"] * (hi is not None)
            out.append(Part(" AND ".join(tests), (*values, *(x for x in (lo, hi) if x is not None))))
        return out

    def read(self, partition: Part) -> Iterator[tuple]:
        for row in self.rows.select(", ".join(self.rows.columns), partition.where, partition.values):
            yield tuple(None if v is None else str(v) for v in row)


class PollBatchReader(DataSourceReader):
    """All rows from ``from`` on, without a cursor."""

    def __init__(self, options: dict[str, str]):
        self.rows, self.start = Rows(options), options.get("from", "")

    def read(self, partition) -> Iterator[tuple]:
        where, values = self.rows.after({"ts": self.start, "id": ""}) if self.start else ("1 = 1", ())
        for row in self.rows.select(", ".join(self.rows.columns), where, values):
            yield tuple(None if v is None else str(v) for v in row)


class PollSource(DataSource):
    """Options: those of :class:`Rows`, ``from`` (else now), ``page``, ``overlap`` in minutes, ``parts``, ``rows_per_minute``, ``resume``."""

    @classmethod
    def name(cls) -> str:
        return "polled_table"

    def schema(self) -> str:
        return ", ".join(f"`{c}` string" for c in Rows(self.options).columns)

    def reader(self, schema) -> DataSourceReader:
        return PollBatchReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return PollReader(self.options)


def reached(spark: SparkSession, checkpoint: str) -> str | None:
    """The place that the last planned batch of a query goes to, from the offsets in its checkpoint folder; null for a new query.

    A source is asked how far it can go before it is told where it stands, so a restarted query brings its place along.
    """
    try:
        files = spark.read.text(f"{checkpoint}/offsets", wholetext=True).select("value", F.regexp_extract(F.col("_metadata.file_path"), r"/(\d+)$", 1).cast("long").alias("batch"))
        last = files.where("batch IS NOT NULL").agg(F.max_by("value", "batch")).first()[0]
    except AnalysisException:
        return None
    return last.strip().splitlines()[-1] if last else None


def poll(spark: SparkSession, checkpoint: str, **options) -> DataFrame:
    """The stream of a table's rows, all columns as text, for a query with this checkpoint folder."""
    spark.dataSource.register(PollSource)
    place = reached(spark, checkpoint)
    more = {"resume": place} if place else {}
    return spark.readStream.format("polled_table").options(**{k: str(v) for k, v in options.items()}, **more).load()
