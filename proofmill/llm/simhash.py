"""SimHash near-duplicates: fingerprints linked through deletion-variant signatures."""

from __future__ import annotations

import math

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import apart, discard, materialise, packed, text_map, unpacked
from .graph import components


#: Words of a shingle in a fingerprint.
FINGERPRINT_WORDS = 4


def fingerprint(words: list[bytes], shingle: int) -> int:
    """64-bit SimHash of the space-joined word shingles, as a signed integer; no words: zero."""
    n = len(words)
    if not n:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_digest
    if n <= shingle:
        hashes = digest(joined, 42)
    else:
        ends = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32).tolist() + [len(joined)]
        starts = [0] + [x + 1 for x in ends[: n - shingle]]
        hashes = b"".join([digest(joined[a:b], 42) for a, b in zip(starts, ends[shingle - 1 :])])
    return int(_majority(np.frombuffer(hashes, np.uint8).reshape(-1, 8))[0])


def _majority(rows: np.ndarray) -> np.ndarray:
    """The bits set in over half of ``rows`` (one hash per row), as one signed integer for every 64."""
    ones = np.zeros(8 * rows.shape[1], np.int64)
    for i in range(0, len(rows), 1 << 16):
        ones += np.unpackbits(rows[i : i + (1 << 16)], axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(rows)).view(">i8").astype(np.int64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """Rows ``doc_id, fp``: one for each document, A-Z lower-cased, words split at ASCII white space."""
    of = lambda words: fingerprint(words, shingle)
    columns = [F.col(id_col).cast("long").alias("doc_id")]
    return text_map(docs, columns, text_col, lambda texts: {"fp": [of(t.lower().split()) for t in texts]}, "doc_id long, fp long")


def _segments(count: int) -> list[tuple[int, int]]:
    edges = [round(64 * i / count) for i in range(count + 1)]
    return list(zip(edges, edges[1:]))


def _mask(lo: int, hi: int) -> int:
    return ((1 << hi) - 1) ^ ((1 << lo) - 1)


def _signed(m: int) -> int:
    return m - (1 << 64) if m >> 63 else m


def _variants(max_bits: int) -> Column:
    """The index's key kinds: each segment whole (``bit`` zero), and each segment with one bit taken out."""
    out = []
    for s, (lo, hi) in enumerate(_segments(max_bits // 2 + 1)):
        for bit in [0, *(1 << p for p in range(lo, hi))]:
            keep = _mask(lo, hi) & ~bit
            out.append(F.struct(*(F.lit(_signed(v)).cast("long").alias(n) for n, v in (("seg", s), ("bit", bit), ("keep", keep)))))
    return F.array(*out)


def _stars(fps: DataFrame, max_bits: int) -> DataFrame:
    """Links ``u, v`` from each fingerprint to the smallest one it shares two whole segments with, if near enough.

    Linear in the fingerprints; joins up dense groups so that :func:`_cross` has few pairs left to report.
    """
    parts = _segments(max_bits // 2 + 1)
    keys = [_signed(_mask(*a) | _mask(*b)) for i, a in enumerate(parts) for b in parts[:i]]
    k = fps.select("fp", F.explode(F.array(*(F.lit(x) for x in keys))).alias("keep")).withColumn("val", F.col("fp").bitwiseAND(F.col("keep")))
    hub = k.groupBy("keep", "val").agg(F.min("fp").alias("v"))
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("v"))) <= max_bits
    return k.join(apart(hub), ["keep", "val"]).where((F.col("fp") != F.col("v")) & near).select(F.col("fp").alias("u"), "v").distinct()


def _cross(fps: DataFrame, max_bits: int) -> DataFrame:
    """Pairs ``u, v`` of the fingerprints in ``fps(fp, root)`` at ``max_bits`` or fewer bits whose roots differ.

    With ``max_bits // 2 + 1`` segments at least one segment differs by at most one bit, so equality on
    whole segments and on one-wildcard segment variants misses no pair. The join's condition verifies
    the distance and keeps a pair only at the first segment that finds it.
    """

    # A one-bit difference joins the fingerprint that has 0 there (side 0) to the one that has 1 there.
    def side(n: int) -> DataFrame:
        k = fps.select(F.col("fp").alias(f"fp{n}"), F.col("root").alias(f"root{n}"), F.explode(_variants(max_bits)).alias("k"))
        has = F.col(f"fp{n}").bitwiseAND(F.col("k.bit")) != 0
        return k.where((F.col("k.bit") == 0) | (has if n else ~has)).select(
            f"fp{n}", f"root{n}", "k.seg", "k.bit", F.col(f"fp{n}").bitwiseAND(F.col("k.keep")).alias("val")
        )

    a, b = side(0).alias("a"), side(1).alias("b")
    x = F.col("fp0").bitwiseXOR(F.col("fp1"))
    close = (F.col("root0") != F.col("root1")) & (F.bit_count(x) <= max_bits)
    first = F.lit(True)
    for s, (lo, hi) in enumerate(_segments(max_bits // 2 + 1)):
        first = first & ((F.col("a.seg") <= s) | (F.bit_count(x.bitwiseAND(F.lit(_signed(_mask(lo, hi))))) > 1))
    on = (F.col("a.seg") == F.col("b.seg")) & (F.col("a.bit") == F.col("b.bit")) & (F.col("a.val") == F.col("b.val"))
    once = (F.col("a.bit") != 0) | (F.col("fp0") < F.col("fp1"))
    return apart(a).join(b, on & once & close & first).select(F.col("fp0").alias("u"), F.col("fp1").alias("v"))


def _linked_stars(fps: DataFrame, max_bits: int) -> tuple[DataFrame, DataFrame]:
    """The links ``u, v`` of :func:`_stars`, and every one of ``fps`` with its ``root`` over them."""
    links = materialise(_stars(fps, max_bits))
    stars = apart(components(links).withColumnRenamed("node", "fp"))
    return links, materialise(fps.join(stars, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root")))


def link_groups(fps: DataFrame, max_bits: int) -> DataFrame:
    """``fp, root`` for distinct fingerprints: root is the smallest fingerprint reachable over links of ``max_bits`` bits.

    Stars join dense groups first; then every link between two different groups is found. No link is
    lost, and a group of near copies never yields all of its pairs.
    """
    _, half = _linked_stars(fps, max_bits)
    between = _cross(half, max_bits).select(F.col("u").alias("fp"), "v")
    roots = half.withColumnRenamed("fp", "v").withColumnRenamed("root", "r")
    joined = components(between.join(apart(half), "fp").join(apart(roots), "v").select(F.col("root").alias("u"), F.col("r").alias("v")))
    return half.join(apart(joined.select(F.col("node").alias("root"), F.col("root").alias("top"))), "root", "left").select("fp", F.coalesce("top", "root").alias("root"))


def simhash_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, max_bits: int = 4
) -> DataFrame:
    """One row for each document: ``doc_id, fingerprint, component_id``.

    Documents link when their fingerprints differ in at most ``max_bits`` bits; ``component_id`` is the
    smallest doc_id reachable. Equal fingerprints collapse to one row before any pair is formed, so
    groups of copies cost nothing.

    Null and wordless texts have fingerprint zero and link like any other. Repeated rows stay repeated.
    Null ids are kept and ignored for the minimum (null only if the whole group has none). An empty
    table gives an empty result. Other columns of ``docs`` are not read, whatever their names.
    """
    fps = materialise(fingerprints(docs, id_col, text_col, shingle))
    reps = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    groups = reps.join(apart(link_groups(reps.select("fp"), max_bits)), "fp")
    label = groups.groupBy("root").agg(F.min("rep").alias("component_id"))
    of = materialise(groups.join(apart(label), "root").select("fp", "component_id"))
    return fps.join(apart(of), "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _shingle_sets(texts: DataFrame, shingle: int, similarity: float | None = None) -> DataFrame:
    """``key, n, grams``: the number of a text's distinct shingle hashes, and these in unsigned order.

    With ``similarity`` only so many of the lowest that :func:`_with_partners` needs, and ``fp``, the text's SimHash.
    """

    def sets(texts: list[bytes]) -> dict[str, list]:
        n, grams, fp = [], [], []
        for t in texts:
            words = t.lower().split()
            if similarity is not None:
                fp.append(fingerprint(words, FINGERPRINT_WORDS))
            joined = [b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
            g = np.unique(np.array([xxhash.xxh64_intdigest(x, 42) for x in joined], np.uint64))
            n.append(len(g))
            if similarity is not None:
                g = g[: len(g) - math.ceil(similarity * len(g) - 1e-9) + 1 + len(g) // 10]
            grams.append(g.view(np.int64))
        return {"n": n, "grams": grams} | ({"fp": fp} if similarity is not None else {})

    return text_map(texts, ["key"], "text", sets, "key long, n long, grams array<long>" + (", fp long" if similarity is not None else ""))


def _with_partners(low: DataFrame, similarity: float) -> DataFrame:
    """``key`` of the texts in ``low(key, n, grams)`` that may be alike to another; all others surely are not.

    Two alike texts with ``n`` and ``m`` shingles share ``l`` of their lowest ``n - ceil(similarity * n) + l`` and
    ``m - ceil(similarity * m) + l``, for any ``l``; here ``l`` is a tenth of the smaller set, which has
    ``similarity * n`` shingles at least, and one more.
    """
    each = low.select("key", "n", F.explode("grams").alias("gram"))
    shared = each.withColumn("often", F.count("*").over(W.partitionBy("gram"))).where("often > 1").groupBy("key", "n").agg(F.count("*").alias("shared"))
    return shared.where(F.col("shared") >= 1 + F.floor(similarity * F.col("n") / 10 - F.lit(1e-9))).select("key")


def _prefixes(sets: DataFrame, similarity: float) -> DataFrame:
    """``gram, key, n, pos``: of each text's shingles, ordered from the rarest on, those that must hold one of any partner's.

    Texts that are alike share ``similarity`` of the larger set at least, so the first ``n - ceil(similarity * n) + 1``
    shingles of both, in any order common to all texts, have one in common. Shingles of one text only stand
    first and join nothing; ``pos`` counts them.
    """
    each = sets.select("key", "n", F.explode("grams").alias("gram"))
    often = each.withColumn("often", F.count("*").over(W.partitionBy("gram"))).where("often > 1")
    lists = often.groupBy("key", "n").agg(F.sort_array(F.collect_list(F.struct("often", "gram"))).alias("g"))
    length = F.col("n") - F.ceil(similarity * F.col("n") - F.lit(1e-9)) + 1 - (F.col("n") - F.size("g"))
    first = lists.where(length > 0).select("key", "n", F.size("g").alias("shared"), F.posexplode(F.slice("g", 1, length.cast("int"))).alias("i", "x"))
    return first.select("x.gram", "key", "n", (F.col("n") - F.col("shared") + F.col("i")).alias("pos"), "x.often")


def _alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs ``u, v`` whose sets have at least this exact Jaccard similarity."""
    a, b = (sets.select(F.col("key").alias(k), F.col("grams").alias(f"{k}_grams")) for k in "uv")
    both = F.size(F.array_intersect("u_grams", "v_grams"))
    met = both >= similarity * (F.size("u_grams") + F.size("v_grams") - both) - F.lit(1e-9)
    return pairs.join(apart(a), "u").join(apart(b), "v").where(met).select("u", "v")


def _rest(of: DataFrame, similarity: float) -> DataFrame:
    """Candidate pairs ``u, v`` of different roots in ``of(gram, key, n, pos, root)``: all that share a prefix shingle and can still reach the similarity.

    At every shingle the texts outside its largest group meet all others, so a large group of copies never
    meets itself; frequent shingles are salted.
    """
    sizes = of.groupBy("gram", "root").agg(F.count("*").alias("m")).groupBy("gram")
    sizes = sizes.agg(F.sum("m").alias("all"), F.max("m").alias("most"), F.max_by("root", F.struct("m", "root")).alias("main")).where("all > most")
    few = F.col("all") - F.col("most")
    sizes = sizes.select("gram", "main", F.least(few, F.expr("1 + (all - most) * all div 1000000")).alias("salts"))
    of = of.join(apart(sizes), "gram")
    left = of.where("root <> main").select("gram", F.pmod(F.xxhash64("key"), "salts").alias("salt"), *(F.col(c).alias(f"u_{c}") for c in ("key", "root", "n", "pos")))
    right = of.select("gram", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), "main", *(F.col(c).alias(f"v_{c}") for c in ("key", "root", "n", "pos")))
    once = (F.col("v_root") == F.col("main")) | (F.col("u_key") < F.col("v_key"))
    # At their first common shingle no more than what follows it can be common.
    most = F.least(F.col("u_n") - F.col("u_pos"), F.col("v_n") - F.col("v_pos"))
    can = most * (1 + similarity) >= similarity * (F.col("u_n") + F.col("v_n")) - F.lit(1e-6)
    on = (left.gram == right.gram) & (left.salt == right.salt) & (F.col("u_root") != F.col("v_root")) & once & can
    return apart(left).join(right, on).select(F.col("u_key").alias("u"), F.col("v_key").alias("v")).distinct()


def _simhash_pairs(fps: DataFrame, max_bits: int) -> DataFrame:
    """Pairs ``u, v`` of the texts in ``fps(key, fp)`` that join all whose fingerprints link at ``max_bits`` bits, as in :func:`link_groups`.

    Texts with one fingerprint meet the smallest key among them; linked fingerprints meet in these keys.
    """
    least = materialise(fps.groupBy("fp").agg(F.min("key").alias("rep")))
    links, half = _linked_stars(least.select("fp"), max_bits)
    rep = lambda n: apart(least.select(F.col("fp").alias(n), F.col("rep").alias(f"{n}_rep")))
    between = links.unionByName(_cross(half, max_bits)).join(rep("u"), "u").join(rep("v"), "v").select(F.col("u_rep").alias("u"), F.col("v_rep").alias("v"))
    same = fps.join(apart(least), "fp").where("key <> rep").select(F.col("key").alias("u"), F.col("rep").alias("v"))
    return between.unionByName(same).distinct()


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, max_bits: int = 4
) -> DataFrame:
    """``text_hash, group_id`` for every different text of ``docs``: near copies share a ``group_id``.

    Groups are the components of all pairs whose ``shingle``-word sets have an exact Jaccard similarity of
    ``similarity`` or more; no pair is missed. Texts that share too few of their lowest shingle hashes with
    any other go first. The rest is linked by SimHash: fingerprints at ``max_bits`` or fewer bits meet through their
    deletion-variant signatures, and the exact similarity verifies each pair. What fingerprints miss between the groups so
    found (short texts, long additions) is joined by a prefix filter over shingles from the rarest on: first each
    text with the most central one at a shingle, which joins most of a large group in linear time, then all
    pairs between different groups. ``group_id`` is the smallest text hash of the group.

    Null texts count as empty; equal texts are one text. Null ids, repeated rows, extra columns and empty
    tables need no care, as only texts are read.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keyed = docs.select(F.xxhash64(text).alias("key"), text.alias("text"))
    low = _shingle_sets(keyed, shingle, similarity).groupBy("key").agg(F.count("*").alias("copies"), F.first("n").alias("n"), F.first("grams").alias("grams"), F.first("fp").alias("fp"))
    low = materialise(low)
    some = materialise(low.join(apart(_with_partners(low, similarity)), "key", "left_semi").select("key", "copies", "fp"))
    sets = materialise(_shingle_sets(keyed.join(apart(some), "key", "left_semi").dropDuplicates(["key"]), shingle))
    found = materialise(_alike(_simhash_pairs(some.select("key", "fp"), max_bits), sets, similarity))
    group = linked(sets, some.select("key", "copies"), similarity, found).select(F.col("node").alias("key"), F.col("root").alias("top"))
    discard(some, sets, found)
    return low.select("key").join(apart(group), "key", "left").select(F.col("key").alias("text_hash"), F.coalesce("top", "key").alias("group_id"))


def linked(sets: DataFrame, copies: DataFrame, similarity: float, found: DataFrame) -> DataFrame:
    """``node, root``: the components of all pairs of ``sets(key, n, grams)`` at this Jaccard similarity or more.

    ``copies(key, copies)`` helps to choose central texts; ``found(u, v)`` are such pairs that are known, and prefixes are joined only between the
    groups that these make.
    """
    known = components(found).withColumnRenamed("node", "key")
    prefixes = materialise(_prefixes(sets, similarity).join(apart(known), "key", "left").withColumn("root", F.coalesce("root", "key")))
    central = prefixes.groupBy("key").agg(F.sum("often").alias("s")).join(apart(copies), "key").select("key", F.struct("s", "copies", "key").alias("rank"))
    ranked = prefixes.join(apart(central), "key").select("gram", F.col("key").alias("u"), "root", "rank")
    hubs = ranked.groupBy("gram").agg(F.max(F.struct("rank.*", "root")).alias("hub"))
    stars = ranked.join(apart(hubs), "gram").where("root <> hub.root").select("u", F.col("hub.key").alias("v")).distinct()
    stars = materialise(_alike(stars, sets, similarity).unionByName(found))
    roots = components(stars).withColumnRenamed("node", "key")
    rooted = materialise(prefixes.drop("often", "root").join(apart(roots), "key", "left").withColumn("root", F.coalesce("root", "key")))
    joined = components(stars.unionByName(_alike(_rest(rooted, similarity), sets, similarity)))
    discard(prefixes, stars, rooted)
    return joined


def dedup_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of ``docs`` for each group of :func:`near_duplicates`, with all its columns: that with the smallest id.

    Ids that are null come last; of rows equal in id, the smallest text hash stays, of equal rows one. Texts that share
    their 64-bit hash but not their SHA-256 are different: none of them goes for the other's sake.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    hashed, sha = F.xxhash64(text), F.sha2(text, 256)
    groups = near_duplicates(docs, id_col, text_col, **options)
    # Copies fall together before the join, so that a text of which there are very many is one row in it.
    place = F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("sha"))).alias("first")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), hashed.alias("text_hash"), sha.alias("sha")).groupBy("text_hash", "sha").agg(place)
    texts = texts.withColumn("own", F.when(F.col("sha") != F.min("sha").over(W.partitionBy("text_hash")), F.col("sha")))
    first = F.min(F.struct("first.none", "first.id", "text_hash", "sha")).alias("first")
    keep = texts.join(apart(groups), "text_hash").groupBy("group_id", "own").agg(first)
    keep = materialise(keep.select(F.col("first.id").alias("id"), F.col("first.text_hash").alias("hash"), F.col("first.sha").alias("sha")))
    rows = docs.select(packed(docs), F.col(id_col).cast("long").alias("id"), hashed.alias("hash"), sha.alias("sha")).alias("a")
    same = F.col("a.id").eqNullSafe(F.col("b.id")) & (F.col("a.hash") == F.col("b.hash")) & (F.col("a.sha") == F.col("b.sha"))
    return unpacked(rows.join(apart(keep.alias("b")), same, "left_semi").dropDuplicates(["id", "hash", "sha"]), docs.columns)
