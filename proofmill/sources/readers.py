"""Raw rows as all-string tables: CSV, JSON, Excel, databases and HTTP cards."""

from __future__ import annotations

import io
import json
import re
import urllib.error
import urllib.request
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader

#: Rows that one request may submit.
SUBMIT_ROWS = 2000
_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_.]*\Z")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Every column as text; empty and missing cells are empty strings."""
    return spark.read.option("header", True).option("inferSchema", False).option("multiLine", True).option("escape", '"').csv(path).na.fill("")


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines as text columns."""
    return spark.read.option("primitivesAsString", True).json(path)


def read_excel(spark: SparkSession, path: str) -> DataFrame:
    """Rows ``path, row, cells`` (a map of header to text) of the first sheet of every workbook; one task reads a workbook."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for files in batches:
            for p, content in zip(files["path"], files["content"]):
                try:
                    sheet = pd.read_excel(io.BytesIO(content), dtype=str).fillna("")
                except ImportError as e:
                    raise ImportError("reading Excel files needs the package openpyxl on the executors") from e
                yield pd.DataFrame({"path": p, "row": range(len(sheet)), "cells": sheet.to_dict("records")})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, "path string, row long, cells map<string,string>")


def submitted(spark: SparkSession, body: dict) -> DataFrame:
    """The ``rows`` (or the one ``record``) of a request; more than ``SUBMIT_ROWS`` rows are refused."""
    rows = body.get("rows") or ([body["record"]] if body.get("record") else [])
    if not rows or not all(isinstance(r, dict) for r in rows):
        raise ValueError("a request needs 'rows' or a 'record'")
    if len(rows) > SUBMIT_ROWS:
        raise ValueError(f"{len(rows)} rows; at most {SUBMIT_ROWS} in one request")
    names = list(dict.fromkeys(k for r in rows for k in r))
    return spark.createDataFrame([tuple("" if r.get(n) is None else str(r[n]) for n in names) for r in rows], ", ".join(f"`{n}` string" for n in names))


def checked_name(name: str) -> str:
    """``name`` if it is a plain, possibly dotted, identifier."""
    if not _NAME.match(name or ""):
        raise ValueError(f"unsafe identifier: {name!r}")
    return name


def jdbc_options(url: str) -> dict[str, str]:
    """Options of Spark's JDBC reader for a ``scheme://user:password@host/name`` address, or for the address of an embedded Derby."""
    if url.startswith("jdbc:derby:"):
        return {"url": url, "driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    m = re.match(r"(?:jdbc:)?(postgres(?:ql)?|mysql|mariadb)(?:\+\w+)?://(?:([^:@/]*)(?::([^@/]*))?@)?(.+)", url)
    if not m:
        raise ValueError("a database address starts with postgresql:// or mysql://")
    kind = "postgresql" if m[1].startswith("postgres") else "mysql"
    out = {"url": f"jdbc:{kind}://{m[4]}", "driver": {"postgresql": "org.postgresql.Driver", "mysql": "com.mysql.cj.jdbc.Driver"}[kind]}
    return out | {k: v for k, v in (("user", m[2]), ("password", m[3])) if v}


def read_database(spark: SparkSession, url: str, table: str, key: str | None = None, parts: int = 16) -> DataFrame:
    """A table; by ranges of ``key`` (a number, date or time), of which ``parts`` tasks read one each.

    The bounds are the database's minimum and maximum, so every range lies inside the table; rows without a key are in the
    first. Filters and columns are pushed into every range's query.
    """
    options = jdbc_options(url) | {"dbtable": checked_name(table)}
    whole = spark.read.format("jdbc").options(**options)
    if key is None:
        return whole.load()
    quoted = spark._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(options["url"]).quoteIdentifier(checked_name(key))
    bounds = options | {"dbtable": f"(SELECT MIN({quoted}) AS low, MAX({quoted}) AS high FROM {table}) bounds"}
    low, high = spark.read.format("jdbc").options(**bounds).load().first()
    if low is None or low == high:
        return whole.load()
    return whole.options(partitionColumn=key, lowerBound=str(low), upperBound=str(high), numPartitions=str(parts)).load()


def increment(rows: DataFrame, since, created_at: str = "created_at", id_col: str = "id", limit: int | None = None) -> DataFrame:
    """Rows created at ``since`` or later, in order of time and id; the filter reaches the source (a page if ``limit`` is set)."""
    at = F.col(checked_name(created_at))
    found = rows.where(at >= F.lit(since)) if since is not None else rows
    found = found.orderBy(at, F.col(checked_name(id_col)))
    return found.limit(limit) if limit else found


class CardSource(DataSource):
    """A saved query of a BI server, read as JSON over HTTP: options ``url, card, user, password, columns, limit``."""

    @classmethod
    def name(cls) -> str:
        return "bi_card"

    def schema(self) -> str:
        return ", ".join(f"`{checked_name(c.strip())}` string" for c in self.options["columns"].split(","))

    def reader(self, schema) -> DataSourceReader:
        return CardReader(dict(self.options), schema.names)


class CardReader(DataSourceReader):
    def __init__(self, options: dict[str, str], names: list[str]):
        self.options, self.names = options, names

    def _post(self, path: str, body: dict, headers: dict) -> bytes:
        request = urllib.request.Request(self.options["url"].rstrip("/") + path, json.dumps(body).encode(), {"Content-Type": "application/json", **headers})
        with urllib.request.urlopen(request, timeout=60) as answer:
            return answer.read()

    def _login(self) -> dict:
        o = self.options
        return {"X-Metabase-Session": json.loads(self._post("/api/session", {"username": o.get("user"), "password": o.get("password")}, {}))["id"]}

    def read(self, partition) -> Iterator[tuple]:
        path = f"/api/card/{int(self.options['card'])}/query/json"
        try:
            found = self._post(path, {}, self._login())
        except urllib.error.HTTPError as e:
            if e.code not in (401, 403):
                raise
            found = self._post(path, {}, self._login())  # an expired session: log in again, once
        rows = json.loads(found)
        for r in rows[: int(self.options["limit"])] if "limit" in self.options else rows:
            yield tuple(None if r.get(n) is None else str(r[n]) for n in self.names)


def open_source(spark: SparkSession, mode: str, **options) -> DataFrame:
    """Raw rows of a database table (``db``) or of a BI card (``card``)."""
    if mode == "db":
        return read_database(spark, options["url"], options["table"], options.get("key"), int(options.get("parts", 16)))
    if mode == "card":
        spark.dataSource.register(CardSource)
        return spark.read.format("bi_card").options(**options).load()
    raise ValueError(f"unknown source mode {mode!r}: use 'db' or 'card'")
