"""Substring dedup: paths of repeated edges in the De Bruijn graph of word windows.

Every window of ``window`` words is an edge from its first to its last ``window - 1`` words.

1. The edges of a document are cut into pieces: consecutive edges that share their minimiser, the smallest hash of a
   shorter gram inside. Equal edges share it, so only pieces whose minimiser occurs again can repeat. Pieces stay packed
   in blocks until that is known. Texts that are copies of an earlier one as a whole are set aside.
2. Equal pieces collapse onto the first of them. The firsts that may share edges with other pieces are taken apart, and
   every edge gets the coordinates where it occurs first, or where it occurred before in the same text.
3. Pieces and edges join into long paths where both their own and their first coordinates continue. On a path
   without branches each occurrence of an edge continues with the next one, so it becomes one row a document.
4. The words of every path are compared with those at its source coordinates.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator
from functools import cached_property
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import apart, chunks, discard, materialise, shuffles_freed

#: Odd multipliers of the rolling hashes, by the binary digit of the width they append.
_STEP = [np.uint64(2 * int(x) + 1) for x in np.random.default_rng(20).integers(1 << 61, 1 << 62, 12)]
#: A piece is cut at multiples of this many words, so that a text of one repeated word has many.
PIECE = 4096
#: Texts are taken apart together up to so many bytes: larger arrays leave the processor's caches, which takes twice as long.
TEXTS = 1 << 20
#: A block holds at most so many pieces, a bucket of minimisers about so many, and there are so many buckets at least.
BLOCK, BUCKET, BUCKETS = 1 << 17, 1 << 22, 256
#: Words of more bytes are hashed one by one.
LONG = 64
_SPACES = b" \t\n\v\f\r"
_INK = bytes(c not in _SPACES for c in range(256))
_BLANK = bytes.maketrans(_SPACES, b" " * len(_SPACES))
#: Masks of a little-endian 64-bit number, by the number of its bytes that count.
_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def rolling(x: np.ndarray, n: int, join) -> np.ndarray:
    """``join`` folded over every ``n`` consecutive values, by doubling."""
    out, span, width, digit = None, 0, 1, 0
    while n:
        if n & 1:
            m = len(x) - (0 if out is None else span)
            out = x if out is None else join(out[:m], x[span:], digit)
            span += width
        n >>= 1
        if n:
            x = join(x[:-width], x[width:], digit)
            width, digit = 2 * width, digit + 1
    return out


def _append(a: np.ndarray, b: np.ndarray, digit: int) -> np.ndarray:
    out = a * _STEP[digit]
    out ^= a >> np.uint64(29)
    out ^= b
    return out


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h *= _STEP[-1]
    h ^= h >> np.uint64(29)
    return h


class Words:
    """The words of some texts, laid end to end: where each begins and ends in ``data``; ``first`` is the number of each text's first word, and in the end that of all words."""

    def __init__(self, texts: list[bytes]):
        self.data = b" ".join((b"", *texts, b"        "))  # white space on both sides of every text; eight bytes can be read from every place in it
        ink = np.frombuffer(self.data.translate(_INK), bool)
        turns = np.flatnonzero(ink[1:] != ink[:-1]) + 1
        self.begin, self.end = turns[0::2].copy(), turns[1::2].copy()
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.first = np.searchsorted(self.begin, np.append(0, np.cumsum(sizes + 1)) + 1)

    def hashes(self, seed: int) -> np.ndarray:
        """A 64-bit hash of each word's bytes: eight at a time, for all words together."""
        key = np.random.default_rng([21, seed]).integers(0, 1 << 64, 3, np.uint64) | np.uint64(1)
        raw = np.frombuffer(self.data, np.uint8)
        eight = np.ndarray((len(raw) - 7,), "<u8", raw, 0, (1,))
        size = self.end - self.begin

        def scrambled(h: np.ndarray) -> np.ndarray:
            h ^= h >> np.uint64(31)
            h *= key[1]
            h ^= h >> np.uint64(29)
            h *= key[2]
            h ^= h >> np.uint64(32)
            return h

        out = eight[self.begin] & _BYTES[np.minimum(size, 8)]
        out ^= size.view(np.uint64) * key[0]
        out = scrambled(out)
        at, done = np.flatnonzero(size > 8), 8
        while len(at) and done < LONG:
            more = eight[self.begin[at] + done] & _BYTES[np.minimum(size[at] - done, 8)]
            out[at] = scrambled(out[at] * key[0] ^ more)
            done += 8
            at = at[size[at] > done]
        for i in at.tolist():
            word = self.data[self.begin[i] : self.end[i]]
            out[i] = int.from_bytes(hashlib.blake2b(word, digest_size=8, key=b"%d" % seed).digest(), "little")
        return out

    def without(self, gone: np.ndarray) -> pa.Array:
        """The texts of the other words, joined by one space."""
        stay = np.flatnonzero(~gone)
        bound = np.searchsorted(stay, self.first)
        begin, end = self.begin[stay], self.end[stay] + 1  # with the blank behind it,
        end[bound[1:][np.diff(bound) > 0] - 1] -= 1  # but for a text's last
        turns = np.zeros(len(self.data) + 1, np.int8)
        turns[begin] += 1
        turns[end] -= 1
        data = np.frombuffer(self.data.translate(_BLANK), np.uint8)[np.cumsum(turns[:-1], dtype=np.int8).view(bool)]
        offsets = np.append(0, np.cumsum(end - begin))[bound].astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(bound) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)])


class Edges:
    """The edges of some texts, laid end to end: for each its text's row, its position there and its hash."""

    def __init__(self, texts: list[bytes], window: int, seed: int, bits: int = 64):
        words = Words(texts)
        self.starts, sizes = words.first[:-1], np.diff(words.first)
        self.some, self.window, self.bits = len(words.begin) >= window, window, bits
        if self.some:
            self.words = words.hashes(seed)
            self.row = np.repeat(np.arange(len(sizes)), sizes)
            self.pos = np.arange(len(self.row)) - np.repeat(self.starts, sizes)
            self.valid = self.row[: 1 - window] == self.row[window - 1 :]

    @cached_property
    def hash(self) -> np.ndarray:
        return _mixed(rolling(self.words, self.window, _append)) & np.uint64((1 << self.bits) - 1)

    def pieces(self, gram: int) -> dict[str, np.ndarray]:
        """Per piece where it ``begin``s, the ``n``umber of its edges, its minimiser ``m`` and whether an edge may occur twice in it."""
        grams = _mixed(rolling(self.words, gram, _append))
        span, n, valid = self.window - gram + 1, len(self.valid), self.valid
        m = rolling(grams, span, lambda a, b, _: np.minimum(a, b))
        start = valid.copy()
        start[1:] &= ~valid[:-1] | (m[1:] != m[:-1]) | (self.pos[1:n] % PIECE == 0)
        near, low = np.zeros(len(grams), bool), grams.astype(np.uint32)
        for s in range(1, span + 1):
            near[:-s] |= low[s:] == low[:-s]
        begin = np.flatnonzero(start)
        size = np.diff(np.append(np.cumsum(valid)[begin] - 1, valid.sum()))
        seen = np.append(0, np.cumsum(near))
        return {"begin": begin, "n": size, "m": m[begin].view(np.int64), "rep": seen[np.minimum(begin + size - 1 + span, len(near))] > seen[begin]}

    def digests(self, begin: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Of ``n`` edges each from ``begin`` on."""
        sums = np.append(np.uint64(0), np.cumsum(_mixed(self.hash)))
        return (sums[begin + n] - sums[begin]).view(np.int64)


def _each_text(docs: DataFrame, fn: Callable[[list[bytes], pa.RecordBatch], dict], schema: str) -> DataFrame:
    """Rows that ``fn`` makes of the texts and of the rows they stand in; ``text`` is the last column of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            for a, b in chunks(texts, TEXTS):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_pydict(fn([t or b"" for t in part.column(part.num_columns - 1).to_pylist()], part))

    return docs.mapInArrow(run, schema)


class Places:
    """Coordinates ``own`` of a document and a word position as one value, in their order. With one mark and ids that lie close together
    documents are numbers of 32 bits and coordinates of 63, which Spark groups and joins fastest; else both are structs."""

    def __init__(self, docs: DataFrame):
        ends = docs.agg(F.min("doc"), F.max("doc"), F.count_if(F.col("doc").isNull()), F.min("mark"), F.max("mark"))
        with shuffles_freed(docs.sparkSession):
            self.least, most, nulls, self.mark, last = ends.first()
        self.short = self.least is not None and not nulls and most - self.least < 1 << 32 and self.mark == last
        doc = F.col("doc") - F.lit(self.least).cast("long") if self.short else F.struct("doc", "mark")
        self.docs = docs.select(doc.alias("doc"), "text")
        self.doc_type = self.docs.schema["doc"].dataType.simpleString()

    def own(self, doc: str = "doc", pos: str = "pos") -> Column:
        at = F.expr(pos).alias("pos")
        return F.shiftleft(doc, 31) + at if self.short else F.struct(F.col(doc).alias("doc"), at)

    def doc(self, own: str) -> Column:
        return F.shiftright(own, 31) if self.short else F.col(f"{own}.doc")

    def pos(self, own: str) -> Column:
        return F.col(own).bitwiseAND(F.lit((1 << 31) - 1)).cast("int") if self.short else F.col(f"{own}.pos")

    def parts(self, own: str) -> list[Column]:
        """Id, mark and position."""
        if self.short:
            ids = self.doc(own) + F.lit(self.least).cast("long"), F.lit(self.mark).cast("long")
        else:
            ids = F.col(f"{own}.doc.doc"), F.col(f"{own}.doc.mark")
        return [c.alias(n) for c, n in zip((*ids, self.pos(own)), ("doc", "mark", "pos"))]


def _blocks(docs: DataFrame, doc_type: str, window: int, gram: int, seed: int, bits: int) -> DataFrame:
    """All pieces of the texts, a row for some thousands: the ``docs`` they are from with the texts' ``hashes``, how ``many`` pieces of each with how many ``edges``,
    where the first begins (``pos``); minimiser, number of edges, digest and ``rep`` of all pieces in one value each. A row for each piece takes Spark several times as long."""

    def made(texts: list[bytes], part: pa.RecordBatch) -> dict:
        edges = Edges(texts, window, seed, bits)
        p = edges.pieces(gram) if edges.some else {"begin": ()}
        cuts = [slice(a, a + BLOCK) for a in range(0, len(p["begin"]), BLOCK)]
        if not cuts:
            return {f.name: pa.array([], f.type) for f in pa.schema([("block", pa.int64()), ("size", pa.int32()), ("docs", pa.list_(part.schema.field("doc").type)), ("hashes", pa.list_(pa.binary())), ("edges", pa.list_(pa.int32())), *((c, pa.binary()) for c in ("many", "m", "n", "digest", "rep")), ("pos", pa.int32())])}
        row, digest = edges.row[p["begin"]], edges.digests(p["begin"], p["n"])
        rows = [np.arange(r[0], r[-1] + 1) for r in map(row.__getitem__, cuts)]
        ends, flat = pa.array(np.append(0, np.cumsum([len(r) for r in rows])).astype(np.int32)), np.concatenate(rows)
        hashes = pa.array([hashlib.sha256(texts[r]).digest()[:16] for r in flat.tolist()], pa.binary())
        sizes = np.concatenate([np.bincount(row[c] - row[c][0], weights=p["n"][c]) for c in cuts]).astype(np.int32)
        packed = {"m": p["m"], "n": p["n"].astype(np.int16), "digest": digest}
        return {
            "block": [uuid.uuid4().int >> 65 for _ in cuts], "size": pa.array([len(row[c]) for c in cuts], pa.int32()), "docs": pa.ListArray.from_arrays(ends, part.column("doc").take(pa.array(flat))),
            "hashes": pa.ListArray.from_arrays(ends, hashes), "edges": pa.ListArray.from_arrays(ends, pa.array(sizes)),
            "many": [np.bincount(row[c] - row[c][0]).astype(np.int32).tobytes() for c in cuts], **{k: [x[c].tobytes() for c in cuts] for k, x in packed.items()},
            "rep": [np.packbits(p["rep"][c]).tobytes() for c in cuts], "pos": pa.array([edges.pos[p["begin"][c][0]] for c in cuts], pa.int32()),
        }

    return _each_text(docs, made, f"block long, size int, docs array<{doc_type}>, hashes array<binary>, edges array<int>, many binary, m binary, n binary, digest binary, rep binary, pos int")


def _copies(places: Places, blocks: DataFrame) -> DataFrame:
    """``block, at, own, n, first``: the texts that stand in an earlier document as a whole, by SHA-256; ``at`` is their number in the block."""
    texts = blocks.select("block", "pos", F.posexplode(F.arrays_zip("docs", "hashes", "edges")).alias("at", "text"))
    texts = texts.select("block", "at", F.when(F.col("at") == 0, F.col("pos")).otherwise(0).alias("pos"), F.col("text.docs").alias("doc"), F.col("text.hashes").alias("hash"), F.col("text.edges").alias("n")).where("n > 0")
    firsts = materialise(texts.groupBy("hash").agg(F.min("doc").alias("from"), F.count("*").alias("often")).where("often > 1").drop("often"))
    copies = texts.join(firsts, "hash").where("doc <> from").select("block", "at", places.own().alias("own"), "n", places.own("from").alias("first"))
    copies = materialise(copies)
    discard(firsts)
    return copies


def _without(blocks: DataFrame, copies: DataFrame) -> DataFrame:
    """``blocks`` with the numbers of their ``copies``, which need not be looked at."""
    return apart(blocks).join(apart(copies.groupBy("block").agg(F.collect_list("at").alias("copies"))), "block", "left")


def _looked_at(many: bytes, copies: list[int] | None) -> np.ndarray:
    """For each piece of a block, whether its text is no copy."""
    many = np.frombuffer(many, np.int32)
    new = np.ones(len(many), bool)
    new[copies or []] = False
    return np.repeat(new, many)


def _often(blocks: DataFrame, pieces: int) -> DataFrame:
    """``block, often``: the minimisers in a block that several pieces of all blocks share, or one that may repeat an edge inside."""
    buckets = max(BUCKETS, pieces // BUCKET)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, m, rep, many, copies in zip(*(c.to_pylist() for c in batch.columns)):
                new = _looked_at(many, copies)
                each = np.frombuffer(m, np.uint64)[new]
                if not len(each):
                    continue
                rep = np.unpackbits(np.frombuffer(rep, np.uint8), count=len(new))[new]
                each, at, n = np.unique(each, return_inverse=True, return_counts=True)
                sure = n + np.bincount(at, weights=rep) > 1
                bucket = (each % np.uint64(buckets)).astype(np.int32)
                order = np.argsort(bucket, kind="stable")
                ends = np.flatnonzero(np.append(np.diff(bucket[order]), 1)) + 1
                spans = [slice(a, b) for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]
                each, sure = each[order], sure[order]
                yield pa.RecordBatch.from_pydict({"bucket": bucket[order][ends - 1], "block": pa.array([block] * len(spans), pa.int64()), "m": [each[x].tobytes() for x in spans], "sure": [sure[x].tobytes() for x in spans]})

    def shared(bucket: pa.Table) -> pa.Table:
        lists = bucket.column("m").to_pylist()
        m, often = np.frombuffer(b"".join(lists), np.uint64), np.frombuffer(b"".join(bucket.column("sure").to_pylist()), bool).copy()
        order = np.argsort(m)
        same = m[order[1:]] == m[order[:-1]]
        often[order[1:][same]] = often[order[:-1][same]] = True
        ends = np.cumsum([len(x) // 8 for x in lists])
        found = [m[a:b][often[a:b]].tobytes() for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]
        out = pa.table({"block": bucket.column("block"), "often": pa.array(found, pa.binary())})
        return out.filter(pa.compute.greater(pa.compute.binary_length(out.column("often")), 0))

    rows = blocks.select("block", "m", "rep", "many", "copies").mapInArrow(dealt, "bucket int, block long, m binary, sure binary")
    return rows.groupBy("bucket").applyInArrow(shared, "block long, often binary")


def _pieces(blocks: DataFrame, often: DataFrame, doc_type: str) -> DataFrame:
    """``m, doc, pos, n, digest, rep``: the pieces whose minimiser is ``often`` in their block."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                row = batch.slice(i, 1)
                get = lambda c, t: np.frombuffer(row.column(c)[0].as_buffer(), t)  # noqa: B023, E731
                m, n, many = get("m", np.int64), get("n", np.int16).astype(np.int32), get("many", np.int32)
                often = np.frombuffer(b"".join(row.column("often")[0].as_py()), np.int64)
                kept = np.flatnonzero(np.isin(m, often) & _looked_at(many, row.column("copies")[0].as_py()))
                before, first = np.cumsum(n) - n, np.cumsum(many) - many
                lead = before[first]  # the pieces of a text follow each other without gaps
                lead[0] -= row.column("pos")[0].as_py()
                text = np.repeat(np.arange(len(many)), many)[kept]
                rep = np.unpackbits(get("rep", np.uint8), count=len(m))[kept].astype(bool)
                yield pa.RecordBatch.from_pydict({"m": m[kept], "doc": row.column("docs").flatten().take(pa.array(text)), "pos": (before[kept] - lead[text]).astype(np.int32), "n": n[kept], "digest": get("digest", np.int64)[kept], "rep": pa.array(rep)})

    lists = often.groupBy("block").agg(F.collect_list("often").alias("often"))
    return blocks.drop("hashes", "edges", "size").join(apart(lists), "block").mapInArrow(made, f"m long, doc {doc_type}, pos int, n int, digest long, rep boolean")


def _with(docs: DataFrame, rows: DataFrame, how: str = "inner") -> DataFrame:
    """``docs`` with the columns that ``rows`` has for their ``doc`` and ``mark``."""
    more = [c for c in rows.columns if c not in ("doc", "mark")]
    same = F.col("a.doc").eqNullSafe(F.col("b.doc")) & (F.col("a.mark") == F.col("b.mark"))
    return docs.alias("a").join(rows.alias("b"), same, how).select("a.*", *(f"b.{c}" for c in more))


def _listed(lists: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The elements of all lists, and for each the row of its list."""
    sizes = pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(lists)), sizes), lists.flatten()


def _taken_apart(places: Places, pieces: DataFrame, window: int, seed: int, bits: int) -> DataFrame:
    """The edges of ``pieces(own, n)``: ``h, own`` of those not yet seen in their text; of the others ``own, n, first``: ``n`` edges from ``own`` on that
    stand in the same text from ``first`` on. So a text that goes round in circles takes a row or two, not one for each word."""

    def made(texts: list[bytes], part: pa.RecordBatch) -> dict:
        edges = Edges(texts, window, seed, bits)
        rows, parts = _listed(part.column("parts"))
        pos, n = (parts.field(c).to_numpy().astype(np.int64) for c in ("pos", "n"))
        order = np.lexsort((pos, rows))
        rows, pos, n = rows[order], pos[order], n[order]
        inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        at, row = np.repeat(pos, n) + inside, np.repeat(rows, n)
        h = edges.hash[edges.starts[row] + at] if len(at) else np.zeros(0, np.uint64)
        key = h ^ row.astype(np.uint64) * _STEP[0]
        order = np.argsort(key, kind="stable")
        here, there = order[1:], order[:-1]
        same = (h[here] == h[there]) & (row[here] == row[there])
        back = np.zeros(len(h), np.int64)
        back[here[same]] = at[here[same]] - at[there[same]]
        starts = np.flatnonzero(np.append(True, (back[1:] == 0) | (back[1:] != back[:-1]) | (row[1:] != row[:-1]) | (at[1:] != at[:-1] + 1))[: len(h)])
        size = np.diff(np.append(starts, len(h)))
        ints = {"pos": at[starts], "n": size, "back": back[starts]}
        return {"h": h[starts].view(np.int64), "doc": part.column("doc").take(pa.array(row[starts])), **{k: x.astype(np.int32) for k, x in ints.items()}}

    parts = pieces.groupBy(places.doc("own").alias("doc")).agg(F.collect_list(F.struct(places.pos("own").alias("pos"), "n")).alias("parts"))
    texts = apart(places.docs).join(apart(parts), "doc").select("doc", "parts", "text")
    first = F.when(F.col("back") > 0, places.own(pos="pos - back"))
    return _each_text(texts, made, f"h long, doc {places.doc_type}, pos int, n int, back int").select("h", places.own().alias("own"), "n", first.alias("first"))


def _firsts(rows: DataFrame, keys: list[str], *more: Column) -> DataFrame:
    """``first``: the coordinates of the first of all rows that agree in ``keys``; how ``often`` they occur. Written, so that Spark can split the joins with it where a key is hot."""
    return materialise(rows.groupBy(*keys).agg(F.min("own").alias("first"), F.count("*").alias("often"), *more))


def _sorted_out(shared: DataFrame) -> DataFrame:
    """``own, n, first, apart``: the pieces without those that hold first edges only.

    ``first`` is where the first of several equal pieces stands; ``apart``: the edges of that one may stand in other pieces, too.
    Where all pieces of a minimiser are equal and repeat no edge inside, there are no others.
    """
    key = ["m", "n", "digest"]
    kinds = _firsts(shared, key, F.max("rep").alias("rep"))
    many = materialise(kinds.groupBy("m").agg(F.count("*").alias("kinds"), F.max("rep").alias("rep")).where("kinds > 1 OR rep").select("m", F.lit(True).alias("apart")))
    told = materialise(kinds.join(many, "m", "left").where("apart OR often > 1").select(*key, "first", F.coalesce("apart", F.lit(False)).alias("apart")))
    pieces = shared.join(told, key).where("first <> own OR apart").select("own", "n", "first", "apart")
    pieces = materialise(pieces)
    discard(kinds, many, told)
    return pieces


def _joined_up(places: Places, steps: DataFrame) -> DataFrame:
    """``doc, mark, pos, n, src``: repeated pieces and edges whose own and first coordinates continue as one path."""
    pos = places.pos("own")
    line = {"doc": places.doc("own"), "from": places.doc("first"), "shift": pos - places.pos("first")}
    if places.short:
        line = {"doc": places.doc("own"), "shift": F.col("own") - F.col("first")}  # positions stay below 2 ** 30, so no other document and position have the same
    order = W.partitionBy(*line).orderBy("pos")
    steps = steps.select("own", "first", "n", pos.alias("pos"), *(c.alias(k) for k, c in line.items()))
    breaks = F.when(F.lag(F.col("pos") + F.col("n")).over(order) == F.col("pos"), 0).otherwise(1)
    runs = steps.withColumn("new", breaks).withColumn("run", F.sum("new").over(order))
    paths = runs.groupBy(*line, "run").agg(F.min("own").alias("own"), F.min("first").alias("first"), F.sum("n").cast("int").alias("n"))
    return paths.select(*places.parts("own"), "n", F.struct(*places.parts("first")).alias("src"))


def _unlike(docs: DataFrame, paths: DataFrame, window: int) -> DataFrame:
    """The source ranges ``src, n`` whose words are not those of every path that names them."""

    def made(texts: list[bytes], part: pa.RecordBatch) -> dict:
        words, row, asked = Words(texts), *_listed(part.column("asked"))
        at, n = words.first[row] + asked.field("pos").to_numpy(), asked.field("n").to_numpy()
        spans = zip(words.begin[at].tolist(), words.end[at + n + window - 2].tolist())
        sha = b"".join(hashlib.sha256(b" ".join(words.data[a:b].split())).digest()[:16] for a, b in spans)
        high, low = np.frombuffer(sha, np.int64).reshape(-1, 2).T
        return {"src": asked.field("src"), "n": n, "high": high, "low": low}

    source = paths.select("src.doc", "src.mark", "src.pos", "n", "src").distinct()
    asked = paths.select("doc", "mark", "pos", "n", "src").unionByName(source)
    asked = asked.groupBy("doc", "mark").agg(F.collect_list(F.struct("pos", "n", "src")).alias("asked"))
    said = _each_text(_with(docs, asked).select("asked", "text"), made, "src struct<doc:long,mark:long,pos:int>, n int, high long, low long")
    return said.groupBy("src", "n").agg(*(f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in ("high", "low"))).where("min_high <> max_high OR min_low <> max_low")


def repeated_paths(docs: DataFrame, window: int, gram: int, bits: int = 64) -> DataFrame:
    """Rows ``doc, mark, pos, n, src``: ``n`` consecutive windows from word ``pos`` on, all of which also stand from ``src`` on.

    ``docs`` has ``doc, mark, text``; coordinates are ordered by ``doc`` (null first), ``mark`` and position, and
    ``src`` is where the windows occur first, or an earlier place in the same text. Windows are found by hashes of
    ``bits`` bits. If the comparison of words shows that two different windows shared a hash, all is done again with
    other hashes of 64 bits, so what is returned holds word for word. Copies of whole texts are told by SHA-256.
    """
    places = Places(docs)
    for seed in count():
        blocks = materialise(_blocks(places.docs, places.doc_type, window, gram, seed, bits))
        copies = _copies(places, blocks)
        with shuffles_freed(docs.sparkSession):
            size = blocks.agg(F.sum("size")).first()[0] or 0
        often = materialise(_often(_without(blocks.select("block", "m", "rep", "many"), copies), size))
        shared = materialise(_pieces(_without(blocks, copies), often, places.doc_type).select("m", "n", "digest", "rep", places.own().alias("own")))
        discard(blocks, often)
        pieces = _sorted_out(shared)
        discard(shared)
        edges = materialise(_taken_apart(places, pieces.where("first = own"), window, seed, bits))
        new, line = edges.where("first IS NULL").select("h", "own", "n"), ["own", "n", "first"]
        firsts = _firsts(new, ["h"])
        steps = pieces.select(line).unionByName(new.join(firsts.where("often > 1"), "h").select(line)).where("first <> own").unionByName(edges.where("first IS NOT NULL").select(line))
        paths = materialise(_joined_up(places, steps))
        discard(pieces, edges, firsts)
        with shuffles_freed(docs.sparkSession):
            if not _unlike(docs, paths, window).limit(1).count():
                return paths.unionByName(copies.select(*places.parts("own"), "n", F.struct(*places.parts("first")).alias("src")))
        discard(paths, copies)
        bits = 64


def dedup_substrings(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20, gram: int = 8, bits: int = 64
) -> DataFrame:
    """All columns of ``docs`` plus ``kept, n_words, n_removed``: texts without words that repeat an earlier passage.

    Words are split at ASCII white space, unchanged. A word goes if a window of ``window`` words covers it
    whose words also start a window earlier, in a smaller id or earlier in the same document; windows
    are judged on the input. ``kept`` joins the other words by one space. ``docs`` is read several times.

    Null and wordless texts have no words and an empty ``kept``. A null id comes before all others.
    Rows with one id but different texts are different documents, ordered by a 64-bit hash of the text; rows
    equal in id and text are one document, so neither repeats the other. Texts may be of any length. Empty
    tables give empty results. Columns of ``docs`` keep their values whatever their names; only the three new names are replaced.
    """
    text, doc = F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.col(id_col).cast("long")
    by_id = docs.groupBy(doc.alias("doc"))
    same = (by_id.count().where("count > 1"), by_id.agg(F.min(F.xxhash64(text)).alias("least"), F.max(F.xxhash64(text)).alias("most")).where("least <> most"))
    with shuffles_freed(docs.sparkSession):
        unique = not all(x.limit(1).count() for x in same)  # the texts are read only if an id occurs twice
    mark = F.lit(0).cast("long") if unique else F.xxhash64(text)
    keyed = docs.select(doc.alias("doc"), mark.alias("mark"), text.cast("binary").alias("text"))
    paths = repeated_paths(keyed, window, gram, bits)
    cuts = paths.groupBy("doc", "mark").agg(F.collect_list(F.struct("pos", "n")).alias("cuts"))
    names = [c for c in docs.columns if c not in ("kept", "n_words", "n_removed")]
    others = [c for c in names if c != text_col]
    rest = F.struct(F.lit(0).alias("c"), *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)))
    rows = docs.select(doc.alias("doc"), mark.alias("mark"), rest.alias("row"), F.col(text_col).cast("string").cast("binary").alias("text"))
    joined = _with(rows, cuts, "left").select("row", "cuts", "text")

    def cut(texts: list[bytes], part: pa.RecordBatch) -> dict:
        words, row, cuts = Words(texts), *_listed(part.column("cuts"))
        at, n = words.first[row] + cuts.field("pos").to_numpy(), cuts.field("n").to_numpy()
        total = len(words.begin) + 1
        gone = np.cumsum(np.bincount(at, minlength=total) - np.bincount(at + n + window - 1, minlength=total))[:-1] > 0
        n_words, n_removed = np.diff(words.first), np.diff(np.append(0, np.cumsum(gone))[words.first])
        return {"row": part.column("row"), "text": part.column("text"), "kept": words.without(gone), "n_words": n_words, "n_removed": n_removed}

    schema = T.StructType([joined.schema["row"], T.StructField("text", T.BinaryType()), T.StructField("kept", T.BinaryType())])
    out = _each_text(joined, cut, schema.add("n_words", T.LongType()).add("n_removed", T.LongType()))
    own = F.col("text").cast("string").cast(docs.schema[text_col].dataType)
    back = {text_col: own, **{c: F.col(f"row.c{i}") for i, c in enumerate(others)}}
    return out.select(*(back[c].alias(c) for c in names), F.col("kept").cast("string").alias("kept"), "n_words", "n_removed")
