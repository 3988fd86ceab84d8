"""Mix sources to target weights: fixed-length blocks, multinomial shard draws, permuted slots, joins by index."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, materialise

#: numpy draws from fewer slots than this.
NUMPY_LIMIT = 1_000_000_000

#: Sources whose quotas every task holds at most; the slots of more sources are dealt out by one permutation of all slots.
MAX_SOURCES = 100_000
#: Slots of a source that are dealt out at once.
DEAL = 1_000_000

WORDS = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words between ASCII white space; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), repeat: int = 3) -> DataFrame:
    """``source, source_size, target`` from rows ``source, size``.

    Sources in code-point order, null last, take ``weights`` in turn and share the sum of all sizes.
    No target exceeds ``repeat`` times its source; the excess is shared again by weight. In closed form:
    sources with the least room for their weight stop first, the others split what is left by weight.
    The windows run over one row per source, after the rows are summed.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = (F.row_number().over(W.orderBy(F.col("source").isNull(), "source")) - 1) % len(weights)
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (turn + 1).cast("int"))
    by = by.withColumn("w", w).withColumn("room", repeat * F.col("source_size")).withColumn("ratio", F.col("room") / F.col("w"))
    order, whole = W.orderBy("ratio", "w", F.col("source").isNull(), "source"), W.partitionBy()
    before = order.rowsBetween(W.unboundedPreceding, -1)
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum("room").over(before), F.lit(0))
    open_w = F.sum("w").over(order.rowsBetween(0, W.unboundedFollowing))
    by = by.withColumn("level", left / open_w)
    by = by.withColumn("level", F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(whole))
    full = F.col("level").isNull() | (F.col("ratio") <= F.col("level"))
    return by.select("source", "source_size", F.when(full, F.col("room").cast("double")).otherwise(F.col("w") * F.col("level")).alias("target"))


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of ``n`` draws without replacement are good: numpy's draw, beyond its limit the same ratio-of-uniforms rejection (HRUA)."""
    total = good + bad
    if total < NUMPY_LIMIT:
        return int(rng.hypergeometric(good, bad, n))
    few, many, m = min(good, bad), max(good, bad), min(n, total - n)
    if not few or not m:
        z = 0
    else:
        share = few / total
        mean, width = m * share + 0.5, math.sqrt((total - m) / (total - 1) * m * share * (1 - share) + 0.5)
        logs = lambda z: math.lgamma(z + 1) + math.lgamma(few - z + 1) + math.lgamma(m - z + 1) + math.lgamma(many - m + z + 1)
        mode, end = logs((m + 1) * (few + 1) // (total + 2)), min(m, few) + 1
        while True:
            x, y = 1 - rng.random(), rng.random()
            w = mean + (1.7155277699214135 * width + 0.8989161620588988) * (y - 0.5) / x
            if 0 <= w < end:
                z = math.floor(w)
                if 2 * math.log(x) <= mode - logs(z):
                    break
    z = m - z if good > bad else z
    return good - z if m < n else z


def _draw(rng: np.random.Generator, quota: np.ndarray, n: int) -> np.ndarray:
    """How many of ``n`` slots each source gets, drawn without replacement from its quota of slots."""
    if (rest := int(quota.sum())) < NUMPY_LIMIT:
        return rng.multivariate_hypergeometric(quota, n, method="marginals")
    out = np.zeros_like(quota)
    for i, q in enumerate(quota.tolist()):
        rest -= q
        out[i] = _hypergeometric(rng, q, rest, n)
        n -= int(out[i])
    return out


def shard_counts(quota: np.ndarray, shards: int, slots: int, shard: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Source counts of one output shard and the slots each source has used before it.

    A multinomial draw conditioned on the sources' whole quotas. Halving the range of shards, with a
    generator seeded by the range, lets every task reach its own shard without any exchange.
    """
    lo, hi, used = 0, shards, np.zeros_like(quota)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        left = _draw(np.random.default_rng([seed, lo, hi]), quota, (mid - lo) * slots)
        if shard < mid:
            quota, hi = left, mid
        else:
            quota, used, lo = quota - left, used + left, mid
    return quota, used


def permuted(i: np.ndarray, n: int, key: int, back: bool = False) -> np.ndarray:
    """A pseudorandom permutation of ``range(n)`` at ``i``: four Feistel rounds, walked until inside the range. ``back`` inverts it."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    low, sh = np.uint64((1 << half) - 1), np.uint64(half)
    out, todo = i.astype(np.uint64), np.ones(len(i), bool)
    while todo.any():
        x = out[todo]
        left, right = x >> sh, x & low
        if back:
            left, right = right, left
        for r in reversed(range(4)) if back else range(4):
            f = (right + np.uint64((key * 4 + r) % (1 << 32))) * np.uint64(0x9E3779B97F4A7C15)
            f = (f ^ (f >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((f >> np.uint64(31)) & low)
        if back:
            left, right = right, left
        out[todo] = (left << sh) | right
        todo = out >= n
    return out.astype(np.int64)


def _seed(*parts) -> int:
    import zlib

    return zlib.crc32(repr(parts).encode())


def _blocks_of_slots(k: np.ndarray, blocks: int, name: str | None, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Block and pass of a source's k-th slots: every pass goes through all blocks in an order of its own."""
    turn = k // blocks
    idx = np.empty(len(k), np.int64)
    for t in np.unique(turn):
        idx[turn == t] = permuted(k[turn == t] % blocks, blocks, _seed(seed, name, int(t)))
    return idx, turn


def _quotas(plan: DataFrame, block: int) -> DataFrame:
    """``source, blocks, quota`` of the sources with words: how many blocks they have, and how many slots they fill."""
    n = F.ceil(F.col("source_size") / block)
    return plan.where("source_size > 0").select("source", n.alias("blocks"), F.round(F.col("target") * n / F.col("source_size")).cast("long").alias("quota"))


def _taken_by_slots(seed: int):
    """A column function of ``source, idx, blocks, quota``: whether any slot takes the block.

    A source with a slot for every block takes all; else its only pass takes those whose place in the order is below the quota.
    """

    @F.pandas_udf("boolean")
    def drawn(source: pd.Series, idx: pd.Series, blocks: pd.Series, quota: pd.Series) -> pd.Series:
        i, n, q = (x.to_numpy(np.int64) for x in (idx, blocks, quota))
        out = q >= n
        some = np.flatnonzero(~out)
        codes, _ = pd.factorize(source.iloc[some], use_na_sentinel=False)
        order = np.argsort(codes, kind="stable")
        for rows in np.split(some[order], np.flatnonzero(np.diff(codes[order])) + 1) if len(some) else []:
            name = source.iloc[rows[0]]
            key = _seed(seed, None if pd.isna(name) else name, 0)
            out[rows] = permuted(i[rows], int(n[rows[0]]), key, back=True) < q[rows]
        return pd.Series(out)

    return drawn


SLOT = "shard long, slot long, source string, idx long, pass long"


def sample_slots(plan: DataFrame, block: int, slots: int, seed: int, max_sources: int = MAX_SOURCES) -> DataFrame:
    """Rows ``shard, slot, source, idx, pass``: which block fills every slot of the mix.

    ``plan`` has a row per source (as from :func:`targets`). A source's k-th slot takes block ``perm(k mod n)`` of
    pass ``k div n``, so no block is taken more than its quota allows. Up to ``max_sources`` sources the plan
    reaches the driver and every task draws the counts of its shards; of more, it stays a table.
    """
    spark = plan.sparkSession
    plan = _quotas(plan, block)
    rows = plan.orderBy(F.col("source").isNull(), "source").limit(max_sources + 1).collect()
    if len(rows) > max_sources:
        return _scattered(plan, slots, seed)
    names, blocks = [r["source"] for r in rows], [r["blocks"] for r in rows]
    quota = np.array([r["quota"] for r in rows], np.int64)
    shards = max(1, -(-int(quota.sum()) // slots))

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        spare = shards * slots - int(quota.sum())  # the last shards may end with empty slots
        for batch in batches:
            for shard in batch["id"]:
                count, used = shard_counts(np.append(quota, spare), shards, slots, int(shard), seed)
                at = 0
                for s, c in enumerate(count[:-1]):
                    if c:
                        idx, turn = _blocks_of_slots(used[s] + np.arange(c), blocks[s], names[s], seed)
                        yield pd.DataFrame({"shard": shard, "slot": at + np.arange(c), "source": names[s], "idx": idx, "pass": turn})
                        at += c

    # The order inside a shard is the consumer's to shuffle; slots of one source stand together.
    return spark.range(shards).repartition(max(1, min(shards, spark.sparkContext.defaultParallelism * 4))).mapInPandas(fill, SLOT)


def _scattered(plan: DataFrame, slots: int, seed: int) -> DataFrame:
    """As :func:`sample_slots`, for any number of sources in ``plan(source, blocks, quota)``.

    All slots of all sources, laid end to end, are permuted; a slot's place divided by ``slots`` is its shard. So the
    source counts of a shard are the same multinomial draw conditioned on the quotas. The running sum
    goes over one row per source.
    """
    order = W.orderBy(F.col("source").isNull(), "source")
    plan = materialise(plan.withColumn("base", F.sum("quota").over(order.rowsBetween(W.unboundedPreceding, 0)) - F.col("quota")))
    total = plan.agg(F.sum("quota")).first()[0] or 0
    shards = max(1, -(-total // slots))
    dealt = plan.where("quota > 0").withColumn("lo", F.explode(F.sequence(F.lit(0).cast("long"), F.col("quota") - 1, F.lit(DEAL).cast("long")))).repartition(F.col("source"), F.col("lo"))

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                k = np.arange(r.lo, min(r.lo + DEAL, r.quota))
                place = permuted(r.base + k, shards * slots, _seed(seed, "slots"))
                idx, turn = _blocks_of_slots(k, r.blocks, r.source, seed)
                yield pd.DataFrame({"shard": place // slots, "slot": place % slots, "source": r.source, "idx": idx, "pass": turn})

    return dealt.mapInPandas(deal, SLOT)


def sized_documents(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """``doc_id, source, size, mark``; the mark tells apart texts of one id and size."""
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(text).alias("size"), F.xxhash64(text).alias("mark"))


def _key() -> Column:
    """The source inside a struct: there null equals null, so joins, windows and groups by it share one way of dealing rows out."""
    return F.struct("source").alias("key")


def _placed(rows: DataFrame, sized: DataFrame, quotas: DataFrame | None = None) -> DataFrame:
    """``rows`` (of ``source, doc_id, size, mark``) that have words, with their ``key`` and their ``start`` in the source; ``sized`` are all of them.

    With ``quotas`` also their source's ``blocks`` and ``quota``, which come by the join that brings the start.
    """
    bucket = F.pmod(F.xxhash64("doc_id"), F.lit(max(1, sized.count() // 2_000))).alias("bucket")
    sums = sized.where("size > 0").groupBy(_key(), bucket).agg(F.sum("size").alias("n"))
    bases = sums.select("key", "bucket", (F.sum("n").over(W.partitionBy("key").orderBy("bucket")) - F.col("n")).alias("base"))
    if quotas is not None:
        bases = bases.join(quotas.select(_key(), "blocks", "quota"), "key")
    full = rows.where("size > 0").select("*", _key(), bucket).drop("source").join(bases, ["key", "bucket"])
    order = W.partitionBy("key", "bucket").orderBy(F.xxhash64("doc_id"), "doc_id", "size", "mark").rowsBetween(W.unboundedPreceding, 0)
    return full.withColumn("start", F.col("base") + F.sum("size").over(order) - F.col("size"))


def _laid(docs: DataFrame, sized: DataFrame, quotas: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """``key, doc_id, size, start, blocks, quota, text`` of the documents with words; ``sized`` are their sizes, counted before."""
    text = F.col(text_col).cast("string")
    full = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(text).alias("size"), F.xxhash64(text).alias("mark"), text.alias("text"))
    return _placed(full, sized, quotas).select("key", "doc_id", "size", "start", "blocks", "quota", "text")


def cut(laid: DataFrame, block: int, seed: int) -> DataFrame:
    """``key, start, doc_id, idx, n, words``: what the documents give to the blocks that fill a slot. Words of other blocks go no further."""
    end = F.col("start") + F.col("size")
    ids = F.sequence(F.expr(f"start div {block}"), F.expr(f"(start + size - 1) div {block}"))

    def piece(i: Column) -> Column:
        low = F.greatest("start", i * block)
        n = F.least(end, (i + 1) * block) - low
        words = F.array_join(F.slice("all", (low - F.col("start") + 1).cast("int"), n.cast("int")), " ")
        return F.struct(i.alias("idx"), words.alias("words"), n.alias("n"))

    pieces = laid.withColumn("all", F.regexp_extract_all("text", F.lit(f"({WORDS})"))).select("key", "start", "doc_id", "blocks", "quota", F.explode(F.transform(ids, piece)).alias("p"))
    return pieces.where(_taken_by_slots(seed)("key.source", "p.idx", "blocks", "quota")).select("key", "start", "doc_id", "p.idx", "p.n", "p.words")


def pack(pieces: DataFrame) -> DataFrame:
    """``key, idx, words, parts``: blocks made of the pieces of :func:`cut` (the last one of a source may be shorter), joined by a space.

    ``parts`` has the documents that a block is made of, in order: ``start`` in the source, ``doc_id``, ``n`` words.
    """
    held = F.array_sort(F.collect_list(F.struct("start", "doc_id", "n", "words")))
    packed = pieces.groupBy("key", "idx").agg(held.alias("held"))
    parts = F.transform("held", lambda x: F.struct(x["start"].alias("start"), x["doc_id"].alias("doc_id"), x["n"].alias("n")))
    return packed.select("key", "idx", F.array_join("held.words", " ").alias("words"), parts.alias("parts"))


def _mixed(pieces: DataFrame, plan: DataFrame, block: int, slots: int, seed: int) -> DataFrame:
    # The slots grow with the corpus, though their plan's estimate rests on the few shard numbers they start from.
    filled = sample_slots(plan, block, slots, seed).select("shard", "slot", _key(), "idx", "pass").hint("merge")
    return pack(pieces).join(filled, ["key", "idx"]).select("shard", "slot", "key.source", "idx", "pass", "words", "parts")


def mixed_blocks(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[float, ...] = (5, 2, 1), repeat: int = 3, block: int = 64, slots: int = 4096, seed: int = 2,
) -> DataFrame:
    """The mixed corpus, one row for each filled slot: ``shard, slot, source, idx, pass, words, parts``.

    Blocks and slots are those of :func:`mix`; ``words`` is the block's text, ``parts`` as in :func:`pack`.
    """
    sized = materialise(sized_documents(docs, id_col, text_col, source_col))
    plan = materialise(targets(sized, weights, repeat))
    laid = _laid(docs, sized, _quotas(plan, block), id_col, text_col, source_col)
    return _mixed(cut(laid, block, seed), plan, block, slots, seed)


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[float, ...] = (5, 2, 1), repeat: int = 3, block: int = 64, slots: int = 4096, seed: int = 2,
) -> DataFrame:
    """One row for each document: ``doc_id, source, size, source_size, target, taken``.

    Each source's documents are laid end to end and cut into blocks of ``block`` words (:func:`sample_slots`
    chooses blocks) and the mixed corpus of :func:`mixed_blocks` is written; ``taken`` is how many of a
    document's words stand in it, repeats counted. A
    source's total comes within one and a half blocks of its target (half a block by rounding to whole slots, less than one by
    the short last block), and no document exceeds ``repeat`` times its size.

    Reruns agree: the order inside a source follows a hash of the id, then the id and the size; rows
    equal in these are interchangeable. Null texts have size 0, take part in no block and have taken 0;
    the null source is a source. A source of no words has target 0. Empty tables give empty results.
    Other columns are not read, whatever their names.
    """
    sized = materialise(sized_documents(docs, id_col, text_col, source_col))
    plan = materialise(targets(sized, weights, repeat))
    laid = _laid(docs, sized, _quotas(plan, block), id_col, text_col, source_col)
    # Written in between, so that the shuffle of the texts is gone from the disks before that of the blocks begins.
    pieces = materialise(cut(laid, block, seed), "zstd")
    mixed = materialise(_mixed(pieces, plan, block, slots, seed), "zstd")
    discard(pieces)
    used = mixed.select(_key(), F.explode("parts").alias("p")).groupBy("key", "p.start").agg(F.sum("p.n").alias("taken"))
    # The places follow from the sizes, so no text is read again.
    got = _placed(sized, sized).join(used, ["key", "start"], "left").select("key", "doc_id", "size", F.coalesce("taken", F.lit(0)).alias("taken"))
    every = got.unionByName(sized.where("size = 0").select(_key(), "doc_id", "size", F.lit(0).cast("long").alias("taken")))
    return every.join(plan.withColumn("key", _key()).drop("source"), "key").select("doc_id", "key.source", "size", "source_size", "target", "taken")
