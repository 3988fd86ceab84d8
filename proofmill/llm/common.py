"""What the operators share: tables in the shared folder, safe broadcasts, batches of texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import discard, materialise, shuffles_freed

__all__ = ["apart", "chunks", "discard", "materialise", "packed", "shuffles_freed", "small", "text_map", "text_slices", "unpacked"]

#: Rows of texts handled at once inside a task hold at most about so many bytes.
CHUNK_BYTES = 4 << 20

#: A table is hinted as broadcast only below so many bytes.
BROADCAST_BYTES = 32 << 20


def small(df: DataFrame, size: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast only when the counted bytes are under ``limit``; else Spark plans a shuffle join."""
    return F.broadcast(df) if size <= limit else df


def apart(df: DataFrame) -> DataFrame:
    """Join ``df`` by shuffle. For tables that grow with the corpus: Spark judges them by their compressed files and would
    broadcast many that come to several times as much in the driver."""
    return df.hint("merge")


def packed(df: DataFrame) -> Column:
    """The whole row in one column, whatever its columns are called."""
    return F.struct(F.lit(0).alias("c"), *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(df.columns))).alias("row")


def unpacked(df: DataFrame, columns: list[str], **changed: Column) -> DataFrame:
    """The columns that :func:`packed` put into ``row``, under their names; those ``changed`` with new values."""
    return df.select(*(changed.get(c, F.col(f"row.c{i}")).alias(c) for i, c in enumerate(columns)))


def text_map(
    docs: DataFrame, columns: list[str], text: str, fn: Callable[[list[bytes]], dict[str, list]], schema: str | T.StructType
) -> DataFrame:
    """Add what ``fn`` derives from the UTF-8 bytes of each text to ``columns``, in chunks of bounded size.

    ``fn`` takes a list of byte strings (null texts as ``b""``) and returns new columns by name.
    ``schema`` lists the kept columns and then the new ones.
    """
    names = [x.split()[0] for x in schema.split(", ")] if isinstance(schema, str) else schema.names
    kept = docs.select(*columns, F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            for lo, hi in chunks(texts):
                new = fn(texts.slice(lo, hi - lo).to_pylist())
                old = {n: batch.column(i).slice(lo, hi - lo) for i, n in enumerate(names[: batch.num_columns - 1])}
                cols = {**old, **{k: v if isinstance(v, pa.Array) else pa.array(v) for k, v in new.items()}}
                yield pa.RecordBatch.from_pydict({n: cols[n] for n in names})

    return kept.mapInArrow(run, schema)


def chunks(texts: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of a binary column that hold about ``size`` bytes each (a longer text stands alone)."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_pylist()
    lo = held = 0
    for i, n in enumerate(sizes):
        if held and held + n > size:
            yield lo, i
            lo, held = i, 0
        held += n + 64
    if lo < len(sizes):
        yield lo, len(sizes)


def text_slices(text: bytes, size: int = CHUNK_BYTES) -> Iterator[list[bytes]]:
    """The words of ``text``, in lists made of about ``size`` bytes each, so that a very long text is never a list of all its words."""
    lo = 0
    while lo < len(text):
        hi = text.find(b" ", lo + size) if len(text) - lo > size else -1
        hi = len(text) if hi < 0 else hi
        yield text[lo:hi].split()
        lo = hi
