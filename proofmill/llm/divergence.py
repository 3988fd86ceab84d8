"""Source divergence audit: how the term shares of the sources of a language differ.

1. Every task counts the terms of its rows by language and source and lays the counts out as a burst trie over UTF-8 bytes: the
   first bytes of a term lead to a container, which holds the rest of its terms in byte order, and for each the counters of the
   sources. When it has grown to a fixed number of counters, its containers become rows.
2. Containers of all tasks meet by prefix range and are merged, one prefix at a time. Prefixes below which too
   much would meet burst first, in all tasks' containers alike: their terms move to containers of longer prefixes.
3. A second walk goes through the kept terms of each range in UTF-8 order. It sums what every pair of sources differs by, and
   has each source's ten best terms of the range.

Integers only; all results are exact.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, materialise, text_slices

#: The scale of shares, the terms listed for each source.
SCALE, BEST = 1_000_000_000, 10
#: Bytes that lead to a container at first; counters that one prefix may bring together before its containers burst.
DEPTH, CONTAINER = 2, 1_000_000
#: Counters that a task holds before it hands on its trie; rows of terms and pairs of sources that one comparison holds.
COUNTERS, TERM_ROWS, PAIRS = 250_000, 20_000, 4_000_000
#: Cells of the dense blocks that are compared at once.
CELLS = 1 << 20
#: A-Z to a-z; letters and all bytes beyond ASCII stay, the rest separates.
_FOLD = bytes(b | 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


PIECE = "lang string, prefix binary, whole boolean, rest binary, docs array<long>, sizes array<long>, names array<string>, source array<long>, n array<long>"


def _lists(values: np.ndarray | pa.Array, edges: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), values if isinstance(values, pa.Array) else pa.array(values))


def containers(lang: str, terms: list[bytes], docs: np.ndarray, sizes: np.ndarray, names: list[str], source: np.ndarray, n: np.ndarray, depth: int) -> pa.RecordBatch:
    """A trie as rows: one container for each ``depth`` first bytes of its ``terms``, which are in byte order.

    Term after term, ``docs`` counts documents and ``sizes`` counters; these have an index into ``names`` and ``n`` occurrences.
    A container has what follows the prefix in its terms, joined by spaces, which no term holds, and names of its own.
    ``whole``: the prefix is the only term, so the container can't burst.
    """
    prefixes = [t[:depth] for t in terms]
    starts = [i for i, p in enumerate(prefixes) if not i or p != prefixes[i - 1]]
    spans = list(zip(starts, [*starts[1:], len(terms)]))
    edges = np.array([*starts, len(terms)])
    counters = np.append(0, np.cumsum(sizes))[edges]
    held = np.repeat(np.arange(len(starts)), np.diff(counters)) * len(names) + source
    used, at = np.unique(held, return_inverse=True)
    own = np.searchsorted(used // len(names), np.arange(len(starts) + 1))
    return pa.RecordBatch.from_pydict(
        {
            "lang": pa.array([lang] * len(starts)),
            "prefix": pa.array([prefixes[i] for i in starts], pa.binary()),
            "whole": pa.array([b == a + 1 and terms[a] == prefixes[a] for a, b in spans]),
            "rest": pa.array([b" ".join([t[depth:] for t in terms[a:b]]) for a, b in spans], pa.binary()),
            "docs": _lists(docs, edges),
            "sizes": _lists(sizes, edges),
            "names": _lists(pa.array(names).take(pa.array(used % len(names))), own),
            "source": _lists(at - np.repeat(own[:-1], np.diff(counters)), counters),
            "n": _lists(n, counters),
        }
    )


def opened(batch: pa.RecordBatch) -> Iterator[tuple[str, bytes, list[bytes], np.ndarray, np.ndarray, list[str], np.ndarray, np.ndarray]]:
    """The containers in a batch: language, prefix, and the rest as in :func:`containers`, terms without the prefix."""
    flat = {c: (batch.column(c).offsets.to_numpy(), batch.column(c).values.to_numpy()) for c in ("docs", "sizes", "source", "n")}
    for row in range(len(batch)):
        lang, prefix, rest, names = (batch.column(c)[row].as_py() for c in ("lang", "prefix", "rest", "names"))
        docs, sizes, source, n = (values[at[row] : at[row + 1]] for at, values in flat.values())
        yield lang, prefix, rest.split(b" "), docs, sizes, names, source, n


def count_terms(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """Containers of the tasks' tries over ``docs(lang, source, text)``, to be merged."""

    def trie(lang: str, sources: dict[str, Counter], having: Counter) -> pa.RecordBatch:
        terms = sorted(having)
        place = {t: i for i, t in enumerate(terms)}
        row = np.fromiter(chain.from_iterable(map(place.__getitem__, c) for c in sources.values()), np.int64)
        n = np.fromiter(chain.from_iterable(c.values() for c in sources.values()), np.int64)
        source = np.repeat(np.arange(len(sources)), [len(c) for c in sources.values()])
        order = np.argsort(row, kind="stable")
        in_docs = np.fromiter(map(having.__getitem__, terms), np.int64)
        return containers(lang, terms, in_docs, np.bincount(row, minlength=len(terms)), list(sources), source[order], n[order], DEPTH)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[dict[str, Counter], Counter]] = {}
        size = 0
        for batch in batches:
            langs, sources = (batch.column(i).to_pylist() for i in (0, 1))
            for lang, source, text in zip(langs, sources, batch.column(2)):
                by_source, having = held.setdefault(lang, ({}, Counter()))
                counts, seen = by_source.setdefault(source, Counter()), set()
                before = len(counts)
                for words in text_slices(text.as_py().translate(_FOLD)):
                    counts.update(words)
                    seen.update(words)
                having.update(seen)
                size += len(counts) - before
                if size >= counters:
                    yield from (trie(k, *v) for k, v in held.items() if v[1])
                    held, size = {}, 0
        yield from (trie(k, *v) for k, v in held.items() if v[1])

    return docs.select("lang", "source", F.col("text").cast("binary")).mapInArrow(count, PIECE)


def burst(pieces: DataFrame, most: int) -> DataFrame:
    """``pieces`` without prefixes below which more than ``most`` counters would meet, but for single terms."""
    depth = DEPTH
    while True:
        heavy = pieces.where("NOT whole").groupBy("lang", "prefix").agg(F.sum(F.size("n")).alias("met")).where(F.col("met") > most).select("lang", "prefix")
        heavy = materialise(heavy)
        if heavy.isEmpty():
            discard(heavy)
            return pieces
        depth *= 2

        def deeper(batches: Iterator[pa.RecordBatch], depth: int = depth) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lang, prefix, terms, *rest in opened(batch):
                    yield containers(lang, [prefix + t for t in terms], *rest, depth)

        again = pieces.join(heavy, ["lang", "prefix"], "left_semi").select(*pieces.columns).mapInArrow(deeper, PIECE)
        before, pieces = pieces, materialise(pieces.join(heavy, ["lang", "prefix"], "left_anti").select(*pieces.columns).unionByName(again))
        discard(before, heavy)


class Merged:
    """One prefix of one language: containers are added, then the terms in enough documents are taken out."""

    def __init__(self, lang: str, prefix: bytes):
        self.lang, self.prefix = lang, prefix
        self.terms: dict[bytes, int] = {}
        self.names: dict[str, int] = {}
        self.rows: list[tuple[np.ndarray, ...]] = []

    def add(self, terms: list[bytes], docs: np.ndarray, sizes: np.ndarray, names: list[str], source: np.ndarray, n: np.ndarray) -> None:
        at = np.array([self.terms.setdefault(t, len(self.terms)) for t in terms])
        name = np.array([self.names.setdefault(x, len(self.names)) for x in names])
        self.rows.append((at, docs, np.repeat(at, sizes), name[source], n))

    def kept(self, min_docs: int, range_: int) -> pa.RecordBatch:
        at, docs, term, source, n = (np.concatenate(x) for x in zip(*self.rows))
        having, width = np.zeros(len(self.terms), np.int64), len(self.names)
        np.add.at(having, at, docs)
        key, place = np.unique(term * width + source, return_inverse=True)
        sums = np.zeros(len(key), np.int64)
        np.add.at(sums, place, n)
        often = having[key // width] >= min_docs
        key, sums = key[often], sums[often]
        names = pa.array([self.prefix + t for t in self.terms], pa.binary())
        columns = {"lang": pa.array([self.lang] * len(key), pa.string()), "term": names.take(pa.array(key // width)), "source": pa.array(list(self.names)).take(pa.array(key % width))}
        return pa.RecordBatch.from_pydict({**columns, "n": pa.array(sums), "range": pa.array(np.full(len(key), range_, np.int32))})


def merge(pieces: DataFrame, min_docs: int) -> DataFrame:
    """``lang, term, source, n, range``: the terms in ``min_docs`` documents or more, merged prefix by prefix in each range of prefixes."""

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, range_ = None, 0
        for batch in batches:
            range_ = batch.column("range")[0].as_py()  # the same in a whole task
            for lang, prefix, *container in opened(batch):
                if here is None or (lang, prefix) != (here.lang, here.prefix):
                    if here:
                        yield here.kept(min_docs, range_)
                    here = Merged(lang, prefix)
                here.add(*container)
        if here:
            yield here.kept(min_docs, range_)

    ranged = pieces.repartitionByRange("lang", "prefix").sortWithinPartitions("lang", "prefix").withColumn("range", F.spark_partition_id())
    return ranged.mapInArrow(merged, "lang string, term binary, source string, n long, range int")


def share(count: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """``1 + floor(SCALE * (count + 2) / whole)`` by long division in three steps, so that 64 bits hold any count of a corpus."""
    rest, out = count + 2, 0
    out, rest = rest // whole, rest % whole
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + rest // whole, rest % whole
    return out + 1


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


FOUND = "lang string, source string, part string, item binary, value long"


def _compared(key: tuple, terms: pd.DataFrame, groups: pd.DataFrame) -> pd.DataFrame:
    """Of a range's terms, the sums for every pair of sources whose first is in this block, and the best terms of the block's sources."""
    groups = groups.sort_values("source", ignore_index=True)
    whole, wide = groups["whole"].to_numpy(), int(groups["lang_whole"].iloc[0])
    mine = np.flatnonzero((groups["block"] == key[3]).to_numpy())
    col = pd.Index(groups["source"]).get_indexer(terms["source"])
    row, names = pd.factorize(terms["term"], sort=True)
    n = terms["n"].to_numpy()
    in_lang = np.zeros(len(names), np.int64)
    np.add.at(in_lang, row, n)
    width = len(groups)
    sums = np.zeros((len(mine), width), np.int64)
    order = np.argsort(row, kind="stable")
    step = max(1, CELLS // width)
    for lo in range(0, len(names), step):
        here = order[slice(*np.searchsorted(row[order], (lo, lo + step)))]
        counts = np.zeros((min(step, len(names) - lo), width), np.int64)
        counts[row[here] - lo, col[here]] = n[here]
        p = share(counts, whole)
        for i, a in enumerate(mine.tolist()):
            sums[i, a + 1 :] += distance(p[:, a, None], p[:, a + 1 :]).sum(axis=0)
    first, second = np.nonzero(np.arange(width) > mine[:, None])
    source = groups["source"].to_numpy()
    coded = np.array([s.encode() for s in source], dtype=object)
    pairs = pd.DataFrame({"source": source[mine[first]], "part": "pair", "item": coded[second], "value": sums[first, second]})
    # Terms in UTF-8 order, so that of equal values the earlier ones come first.
    p, q = share(n, whole[col]), share(in_lang[row], np.int64(wide))
    own = np.flatnonzero((p > q) & np.isin(col, mine))
    value = distance(p[own], q[own])
    own = own[by := np.lexsort((row[own], -value, col[own]))]
    starts = np.flatnonzero(np.append(True, col[own][1:] != col[own][:-1])) if len(own) else own
    place = np.arange(len(own)) - np.repeat(starts, np.diff(np.append(starts, len(own))))
    top = own[place < BEST]
    best = pd.DataFrame({"source": source[col[top]], "part": "term", "item": names[row[top]], "value": value[by][place < BEST]})
    return pd.concat([pairs, best]).assign(lang=key[0])[["lang", "source", "part", "item", "value"]]


def audit_sources(
    docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", min_docs: int = 10,
    counters: int = COUNTERS, container: int = CONTAINER, term_rows: int = TERM_ROWS, pairs: int = PAIRS,
) -> DataFrame:
    """Rows ``lang, source, part, item, value, rank``: how far every source is from the others of its language, and by which terms.

    Terms are runs of letters and of characters beyond ASCII, A-Z lower-cased; a language keeps those in ``min_docs`` or more
    of its documents. A source's share of a term is ``p = 1 + floor(SCALE * (count + 2) / (N + 2 * V))``; the distance of two
    shares is ``floor((p - q)^2 / (p + q))``. Part ``pair`` has every other source of the language with the sum over all kept
    terms; part ``term`` has the ten terms that are commoner in the source than in the language with the largest
    distances. Ranks start at 1, larger values first, of equals the smaller item in UTF-8 order.

    Null texts, languages and sources are empty ones; a source without terms takes part with counts of zero, and a language
    without kept terms has distances of zero. Repeated rows count again. Texts may be of any length: long ones are
    counted in slices. An empty table gives an empty result; other columns are not read. The last four parameters
    bound what a task holds and change no result.
    """
    col = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    docs = docs.select(col(lang_col).alias("lang"), col(source_col).alias("source"), col(text_col).alias("text"))
    pieces = burst(materialise(count_terms(docs, counters)), container)
    kept = materialise(merge(pieces, min_docs))
    discard(pieces)
    groups = materialise(docs.select("lang", "source").distinct())

    in_source = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    by_term = kept.groupBy("lang", "term").agg(F.sum("n").alias("n")).groupBy("lang").agg(F.sum("n").alias("lang_n"), F.count("*").alias("v"))
    sources = groups.groupBy("lang").agg(F.ceil(F.pow(F.count("*"), F.lit(2)) / pairs).cast("long").alias("blocks"))
    whole = groups.join(in_source, ["lang", "source"], "left").join(sources, "lang").join(by_term, "lang")
    whole = whole.select(
        "lang", "source", "blocks", (F.coalesce("n", F.lit(0)) + 2 * F.col("v")).alias("whole"), (F.col("lang_n") + 2 * F.col("v")).alias("lang_whole"),
        F.pmod(F.xxhash64("source"), "blocks").alias("block"),
    )
    whole = materialise(whole)
    # A range that holds more than the others is compared in more parts.
    sizes = kept.groupBy("lang", "range").agg((1 + F.floor(F.count("*") / term_rows)).alias("parts"))
    parted = kept.join(sizes, ["lang", "range"]).withColumn("part", F.pmod(F.xxhash64("term"), "parts")).drop("parts")
    each = lambda df: df.withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).drop("blocks")
    tiles = each(parted.select("lang", "range", "part").distinct().join(sources, "lang"))
    left = each(parted.join(sources, "lang")).groupBy("lang", "range", "part", "b")
    right = tiles.join(whole.drop("blocks"), "lang").withColumnsRenamed({c: f"of_{c}" for c in tiles.columns}).groupBy(*(f"of_{c}" for c in tiles.columns))
    found = materialise(left.cogroup(right).applyInPandas(_compared, FOUND).withColumn("item", F.col("item").cast("string")))

    ordered = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    sums = found.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    sums = sums.unionByName(sums.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    others = groups.join(groups.withColumnRenamed("source", "item"), "lang").where("source <> item")
    pair = others.join(sums, ["lang", "source", "item"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0).cast("long")).alias("value"))
    term = found.where("part = 'term'").withColumn("rank", F.row_number().over(ordered)).where(F.col("rank") <= BEST)
    return pair.withColumn("rank", F.row_number().over(ordered)).unionByName(term.select(*pair.columns, "rank"))


#: DuckDB SQL for op12.
ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN k USING (lang, term) GROUP BY lang, source, term),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
gs AS (SELECT lang, source, coalesce(sum(n), 0)::HUGEINT AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY lang, source),
p AS (SELECT lang, source, term, coalesce(n, 0) AS n, (1 + (1000000000::HUGEINT * (coalesce(n, 0) + 2)) // (total + 2 * v))::BIGINT AS p
 FROM gs JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, term)),
q AS (SELECT lang, term, (1 + (1000000000::HUGEINT * (sum(n) + 2)) // (any_value(total) + 2 * any_value(v)))::BIGINT AS q
 FROM c JOIN (SELECT lang, sum(total) AS total FROM gs GROUP BY lang) USING (lang) JOIN v USING (lang) GROUP BY lang, term),
s AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
 FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
o AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
 FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
 UNION ALL SELECT lang, source, 'term', term, (((p - q) * (p - q)) // (p + q))::BIGINT FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM o)
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 10
"""
