"""URL filter: a trie over reversed host labels and path segments, broadcast; the longest entry wins. Longer lists join instead."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Most entries that are shipped to every task; longer lists go through :func:`match_by_join`.
MAX_RULES = 200_000


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


def rule(verdict: str, entry: str) -> Rule:
    """Parse ``host/path``: the host is lower-cased, the path starts at the first slash."""
    host, slash, path = entry.partition("/")
    return Rule(verdict, host.lower(), slash + path)


#: The entries of op9.
RULES = (rule("block", "net/"), rule("allow", "example.net/en/"), rule("block", "example.com/de/"), rule("allow", "org/fr/"))

_PATH, _END, _MOST = "\0path", "\0end", "\0most"


def build_trie(rules: Iterable[Rule]) -> dict:
    """Nested dicts: host labels from the last to the first, then whole path segments, then a segment's beginning."""
    root: dict = {}
    for r in rules:
        node = root
        for label in reversed(r.host.split(".")):
            node = node.setdefault(label, {})
        node = node.setdefault(_PATH, {})
        *whole, rest = r.path.split("/")
        for segment in whole:
            node = node.setdefault(segment, {})
        ends = node.setdefault(_END, {})
        if ends.get(rest, ("", "allow"))[1] != "block":  # of two equal entries the blocking one counts
            ends[rest] = (r.host + r.path, r.verdict)
            node[_MOST] = max(node.get(_MOST, 0), len(rest))
    return root


def lookup(trie: dict, host: str, path: str) -> tuple[str, str] | None:
    """The longest fitting entry (host and path counted together, of equals that with the longer host) and its verdict."""
    node, found = trie, None
    segments = path.split("/")
    for label in reversed(host.split(".")):
        node = node.get(label)
        if node is None:
            break
        here = node.get(_PATH)
        for segment in segments:
            if here is None:
                break
            ends = here.get(_END)
            # The beginnings of the segment are looked up, so the number of entries that end here does not matter.
            fit = ends and next((e for i in range(min(len(segment), here[_MOST]), -1, -1) if (e := segment[:i]) in ends), None)
            if fit is not None and (found is None or len(ends[fit][0]) >= len(found[0])):
                found = ends[fit]
            here = here.get(segment)
    return found


def match_by_trie(urls: DataFrame, rules: list[Rule]) -> DataFrame:
    """``urls(host, path)`` with ``rule`` and ``verdict`` of the longest fitting entry, or nulls."""
    trie = urls.sparkSession.sparkContext.broadcast(build_trie(rules))

    @F.pandas_udf(T.StructType().add("rule", "string").add("verdict", "string"))
    def judge(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for hosts, paths in batches:
            yield pd.DataFrame([lookup(trie.value, h, p) or (None, None) for h, p in zip(hosts, paths)], columns=["rule", "verdict"])

    return urls.withColumn("found", judge("host", "path")).select(*urls.columns, "found.rule", "found.verdict")


def match_by_join(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """As :func:`match_by_trie`, for ``rules(verdict, host, path)`` of any number.

    Every different url is looked up under the ends of its host and the folders of its path, a few keys each, so
    equality joins find the entries; only what follows an entry's last slash is compared afterwards.
    """
    slash = F.length("path") - F.locate("/", F.reverse("path")) + 1
    folder = lambda path, end: F.when(F.locate("/", path) > 0, F.substring(path, F.lit(1), end)).otherwise("")
    known = rules.select("verdict", F.lower("host").alias("end"), F.col("path").alias("rule_path"), folder(F.col("path"), slash).alias("folder"))
    labels = F.split("host", r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    parts = F.split("path", "/")
    folders = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.when(i == 0, "").otherwise(F.concat(F.array_join(F.slice(parts, F.lit(1), i), "/"), F.lit("/"))))
    asked = urls.select("host", "path").distinct().withColumn("end", F.explode(ends)).withColumn("folder", F.explode(folders))
    fits = asked.join(known, ["end", "folder"]).where(F.startswith("path", "rule_path"))
    entry = F.concat("end", "rule_path")
    best = F.max(F.struct(F.length(entry).alias("n"), F.length("end").alias("m"), (F.col("verdict") == "block").alias("block"), entry.alias("rule"), "verdict")).alias("best")
    found = fits.groupBy("host", "path").agg(best).select("host", "path", "best.rule", "best.verdict")
    return urls.join(found, ["host", "path"], "left").select(*urls.columns, "rule", "verdict")


def filter_urls(
    pages: DataFrame, rules: Iterable[Rule] | DataFrame = RULES, default: str = "allow", id_col: str = "page_id", url_col: str = "url", max_rules: int = MAX_RULES
) -> DataFrame:
    """One row for each page: ``page_id, host, path, rule, verdict``.

    The host lies between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z lower-cased; the path follows up
    to ``?``, ``#`` or the end. An entry fits its host and all subdomains if the url's path begins with the
    entry's path. The longest fitting entry wins, host and path counted together; of equal entries the blocking one.
    Without one, ``verdict`` is ``default`` and ``rule`` null. ``rules`` are entries or a table ``verdict, host, path``;
    up to ``max_rules`` of them are broadcast as a trie, more are joined.

    Null urls and urls without ``://`` have an empty host and path. Repeated rows stay, null ids are kept, an empty
    table gives an empty result, other columns are not read, urls may be of any length.
    """
    parts = lambda i: F.coalesce(F.regexp_extract("url", r"(?s)^.*?://([^/?#]*)([^?#]*)", i), F.lit(""))
    low = F.translate(parts(1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    urls = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))
    split = urls.select("page_id", low.alias("host"), parts(2).alias("path"))
    if isinstance(rules, DataFrame):
        few = rules.select("verdict", "host", "path").limit(max_rules + 1).collect()
        rules = rules if len(few) > max_rules else [Rule(r["verdict"], r["host"].lower(), r["path"]) for r in few]
    else:
        rules = list(rules)
        if len(rules) > max_rules:
            rules = pages.sparkSession.createDataFrame(rules, "verdict string, host string, path string")
    matched = match_by_trie(split, rules) if isinstance(rules, list) else match_by_join(split, rules)
    return matched.withColumn("verdict", F.coalesce("verdict", F.lit(default)))


#: DuckDB SQL for op9.
ORACLE = r"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
h AS (SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
 coalesce(regexp_extract(r, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
f AS (SELECT page_id, coalesce(host, '') AS host, path, CASE
 WHEN ('.' || host) LIKE '%.example.net' AND starts_with(path, '/en/') THEN 'example.net/en/'
 WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/de/') THEN 'example.com/de/'
 WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/') THEN 'net/'
 WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/fr/') THEN 'org/fr/' END AS rule FROM h)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM f
"""
