"""Importance resampling towards a target distribution, over hashed runs of words.

Two passes over the texts: bucket counts of both corpora, then each document's mean gain from an array of 10,000 gains. The
wanted number of documents is found without sorting: radix selection counts one digit of the composite key (score, id,
features) at a time and goes on inside the digit that holds the last wanted row. Only drawn rows are sorted, by range, and ranked.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import repeat
from operator import and_, or_
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, text_map, text_slices

#: Buckets of the features, the prefix of the hashed ids.
BUCKETS, SEED = 10_000, 7
#: Bits of a digit: the driver sees at most so many counts (two to this power) in each step of the selection.
DIGIT_BITS = 16
#: A-Z to a-z; digits, letters and all bytes beyond ASCII stay, the rest separates.
_FOLD = bytes(b | 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def features(text: bytes) -> Iterator[np.ndarray]:
    """Buckets of all runs of one and of two consecutive words, in arrays of bounded size: first one-word runs, then two-word runs, again and again."""
    last: list[int] = []
    for words in text_slices(text.translate(_FOLD)):
        ones = list(map(crc32, words))
        # The checksum of "a b" goes on from that of "a ", and the first word of a slice from the last one of the slice before.
        firsts = map(crc32, repeat(b" "), last + ones)
        twos = list(map(crc32, words if last else words[1:], firsts))
        last = ones[-1:] or last
        yield np.array(ones, np.int64) % BUCKETS
        yield np.array(twos, np.int64) % BUCKETS


def bucket_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``bucket, n``: how many features of all texts fall into each bucket; empty buckets are absent."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for text in batch.column(0):
                for found in features(text.as_py()):
                    held += np.bincount(found, minlength=BUCKETS)
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_pydict({"bucket": some.astype(np.int64), "n": held[some]})

    text = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary"))
    return text.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame) -> DataFrame:
    """``bucket, gain`` of every bucket, from the counts of both corpora."""
    every = source.sparkSession.range(BUCKETS).withColumnRenamed("id", "bucket")
    count = lambda df, name: df.withColumnRenamed("n", name)
    both = every.join(count(source, "s"), "bucket", "left").join(count(target, "t"), "bucket", "left").na.fill(0)
    whole = both.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    real = lambda c, more: F.col(c).cast("double") + more
    ratio = real("t", 1) * real("all_s", BUCKETS) / (real("s", 1) * real("all_t", BUCKETS))
    return both.join(F.broadcast(whole)).select("bucket", F.floor(1000 * F.log(ratio)).alias("gain"))


def weigh(docs: DataFrame, table: list[int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_features, weight``: the floored mean of ``table`` over a document's features; none: 0."""
    gain = np.array(table, np.int64)

    def of(texts: list[bytes]) -> dict[str, list]:
        out: dict[str, list] = {"n_words": [], "n_features": [], "weight": []}
        for t in texts:
            n = total = words = 0
            for i, found in enumerate(features(t)):
                n += len(found)
                words += 0 if i % 2 else len(found)
                total += int(gain[found].sum())
            out["n_words"].append(words)
            out["n_features"].append(n)
            out["weight"].append(total // n if n else 0)
        return out

    doc_id = F.col(id_col).cast("long").alias("doc_id")
    return text_map(docs, [doc_id], text_col, of, "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """The Gumbel term of an id: ``floor(-1000 ln(-ln u))``, u from the first 8 hex digits of its SHA-256; a null id is read as empty."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))


def kth(rows: DataFrame, columns: list[str], k: int) -> tuple[tuple[int, ...], int, int]:
    """The k-th smallest key of ``rows`` over long columns without nulls, how many rows have a smaller one, and how many this one.

    Radix selection: each step counts one digit of a column among the rows that agree in all digits before, and goes on inside
    the digit in which the k-th row lies. A step is one scan with a partial count; at most two to the power ``DIGIT_BITS``
    counts reach the driver. Digits that are the same in all rows left are skipped; a single row left is the answer.
    """
    key, below = [], 0
    for c in columns:
        low, high, n = rows.agg(F.min(c), F.max(c), F.count("*")).first()
        if n == 1:
            return tuple(rows.select(*columns).first()), below, 1
        for shift in range(64 - DIGIT_BITS, -1, -DIGIT_BITS):
            if low >> shift == high >> shift:
                continue
            digit = F.shiftright(c, shift)  # with the digits before, which are the same in all rows left
            counts = sorted(map(tuple, rows.groupBy(digit.alias("digit")).count().collect()))
            for d, n in counts:
                if below + n >= k:
                    break
                below += n
            rows = rows.where(digit == d)
            low, high = max(low, d << shift), min(high, (d << shift) + (1 << shift) - 1)
        key.append(low)
    return tuple(key), below, n


def ranked(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``rows`` with ``rank`` from 1 in the order of ``columns``: sorted by ranges, numbered inside each, the ranges' sizes added up."""
    # Equal rows may fall into several ranges.
    salted = rows.withColumn("salt", F.rand(SEED))
    sorted_rows = salted.repartitionByRange(*columns, "salt").sortWithinPartitions(*columns, "salt").drop("salt").withColumn("part", F.spark_partition_id().cast("long"))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = 0
        for batch in batches:
            yield batch.append_column("place", pa.array(np.arange(done + 1, done + 1 + len(batch))))
            done += len(batch)

    numbered = materialise(sorted_rows.mapInArrow(number, T.StructType([*sorted_rows.schema, T.StructField("place", T.LongType())])))
    sizes = numbered.groupBy("part").agg(F.count("*").alias("size"))
    # One row for each range; there are no more ranges than shuffle partitions.
    before = sizes.select("part", (F.sum("size").over(W.orderBy("part")) - F.col("size")).alias("before"))
    return numbered.join(F.broadcast(before), "part").select(*rows.columns, (F.col("before") + F.col("place")).alias("rank"))


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 25, min_words: int = 20, seed: int = SEED,
    id_col: str = "doc_id", text_col: str = "text", target_text: str = "text",
) -> DataFrame:
    """One row for each document: ``doc_id, n_features, weight, score, rank``.

    Words are runs of letters, digits and characters beyond ASCII, A-Z lower-cased; features are all runs of one and two of
    them. ``weight`` is the floored mean of the features' gains, ``score`` adds Gumbel noise that depends on the id alone.
    Of the N documents with ``min_words`` words or more the ``percent * N div 100`` with the highest scores are drawn, of equals
    those with the smaller id, and ranked from 1; the others have no rank.

    Null texts have no words, no features and weight 0. Null ids come after all others of the same score. Repeated
    rows are documents of their own: equal in all results, they are drawn as often as there is room. Texts may be of
    any length: long ones are read in slices. An empty corpus gives an empty result, an empty target no features to
    aim at. Other columns are not read, whatever their names.
    """
    counted = gains(bucket_counts(docs, text_col), bucket_counts(target, target_text))
    table = [0] * BUCKETS
    for bucket, gain in counted.collect():  # one row for each bucket
        table[bucket] = gain
    scored = weigh(docs, table, id_col, text_col).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    keys = {"k0": -F.col("score"), "k1": F.isnull("doc_id").cast("long"), "k2": F.coalesce("doc_id", F.lit(0).cast("long")), "k3": F.col("n_features")}
    columns, out = list(keys), ["doc_id", "n_features", "weight", "score"]
    scored = materialise(scored.withColumns(keys))
    fit = F.col("n_words") >= min_words
    k = percent * scored.where(fit).count() // 100
    none = F.lit(None).cast("long").alias("rank")
    if not k:
        return scored.select(*out, none)
    spark = docs.sparkSession
    key, below, same = kth(scored.where(fit), columns, k)
    is_key = reduce(and_, (F.col(c) == v for c, v in zip(columns, key)))
    smaller = reduce(or_, (reduce(and_, [*(F.col(c) == v for c, v in zip(columns[:i], key)), F.col(columns[i]) < key[i]]) for i in range(len(columns))))
    drawn = scored.where(fit & smaller).select(*columns, *out)
    # Rows that share the last key are equal in all results, so any of them may be drawn: they are made anew, as many as there were.
    one = scored.where(fit & is_key).select(*columns, *out).first()
    again = lambda low, high: spark.range(low, high).select(*(F.lit(one[c]).cast("long").alias(c) for c in [*columns, *out]))
    drawn = drawn.unionByName(again(0, k - below))
    rest = scored.where(~(fit & (smaller | is_key))).select(*out).unionByName(again(k - below, same).select(*out))
    return ranked(drawn, columns).select(*out, "rank").unionByName(rest.select(*out, none))
