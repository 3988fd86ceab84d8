"""Classification by compressed size: zstandard raw-content dictionaries, one per class."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_map

#: Bounds of the samples that the classifiers learn from: rows per class, characters per row, bytes per dictionary.
SAMPLE_ROWS, SAMPLE_CHARS, DICT_BYTES = 300, 20_000, 65_536
#: Labels that are learned: those with the most rows, of equals the first in code-point order.
LABELS = 256
#: Rows that the quality score is calibrated on, at most.
CALIBRATION_ROWS = 8_000
_BITS = 30
_SPACES = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id's text modulo ``n``; a null id has remainder 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % n, F.lit(0))


def spread(labelled: DataFrame, label: str, rows: int) -> DataFrame:
    """At most ``rows`` rows of each label, chosen by a hash of ``doc_id`` over the whole table, with their ``rank``.

    Counts per label set a hash threshold first, so only about twice the wanted rows are ever ranked.
    """
    most = labelled.groupBy(label).count().orderBy(F.desc("count"), label).limit(LABELS)
    counts = {r[label]: r["count"] for r in most.collect()}
    hashed = F.pmod(F.xxhash64("doc_id"), F.lit(1 << _BITS))
    below = [(F.col(label) == k) & (hashed < int((1 << _BITS) * min(1, (2 * rows + 100) / n))) for k, n in counts.items() if k is not None]
    near = one_each(labelled.where(reduce(lambda a, b: a | b, below, F.lit(False))), label)
    return near.withColumn("rank", F.row_number().over(W.partitionBy(label).orderBy(hashed, "doc_id"))).where(F.col("rank") <= rows)


def one_each(rows: DataFrame, *by: str) -> DataFrame:
    """One row for each ``doc_id`` (and ``by``): of repeated ids the smallest row, so that a bound on ids is one on rows."""
    rest = [c for c in rows.columns if c != "doc_id" and c not in by]
    if not rest:
        return rows.distinct()
    return rows.groupBy("doc_id", *by).agg(F.min(F.struct(*rest)).alias("row")).select("doc_id", *by, "row.*")


class Sizer:
    """Compressed sizes of texts under each class's dictionary. Pickles as dictionaries; compressors are built per task."""

    def __init__(self, contents: list[bytes], level: int):
        self.contents, self.level, self.made = contents, level, None

    def __getstate__(self) -> dict:
        return {**self.__dict__, "made": None}

    def __call__(self, texts: list[bytes]) -> np.ndarray:
        if self.made is None:
            raw = [zstandard.ZstdCompressionDict(c, dict_type=zstandard.DICT_TYPE_RAWCONTENT) for c in self.contents]
            for d in raw:
                d.precompute_compress(level=self.level)
            self.made = [zstandard.ZstdCompressor(level=self.level, dict_data=d, write_content_size=False) for d in raw]
        return np.array([[len(z.compress(t)) for z in self.made] for t in texts], float).reshape(len(texts), len(self.made))


def _joined(texts: list[bytes], size: int) -> bytes:
    return (b"\n".join(texts) or b" ")[:size].ljust(8)


def letters(text: str) -> bytes:
    """Lower-cased text with every ASCII character but letters as a single space."""
    return b" ".join(text.lower().encode("utf-8", "replace").translate(_SPACES).split())


def learn_languages(docs: DataFrame, fold_of: int = 4, held_out: int = 2, level: int = -3, dict_bytes: int = DICT_BYTES) -> tuple[list[str], Sizer]:
    """Dictionaries for the languages of ``docs(doc_id, text, lang)`` outside the held-out fold."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold(F.col("doc_id"), fold_of) != held_out))
    known = known.where(F.length("text") <= SAMPLE_CHARS)
    texts: dict[str, list[bytes]] = {}
    for r in spread(known.select("doc_id", "text", "lang"), "lang", SAMPLE_ROWS).orderBy("lang", "rank").collect():
        texts.setdefault(r["lang"], []).append(letters(r["text"]))
    names = sorted(texts)
    return names, Sizer([_joined(texts[n], dict_bytes) for n in names], level)


def identify_languages(
    docs: DataFrame, fold_of: int = 4, held_out: int = 2, min_margin: float = 0.02, level: int = -3, dict_bytes: int = DICT_BYTES
) -> DataFrame:
    """One row for each row of ``docs(doc_id, text, lang)``: ``doc_id, held_out, lang_pred, score, confident``.

    The predicted language is the one whose dictionary compresses the whole text best, of equals the
    first in code-point order. ``score`` falls from 1 to 1/languages as the other sizes come near;
    ``confident`` is false where the best size beats the second by less than ``min_margin``: narrow
    margins are rejected there, while ``lang_pred`` still names the best. Learned from a bounded sample
    (the module's constants) of rows outside the held-out fold; a prediction reads the text only.

    Null texts and texts without a letter (a character of a Unicode letter category: ``½`` and ``²`` are none) give
    ``und`` with score 0. Without any labelled row all give ``und``. Repeated rows stay, null ids are kept (fold 0),
    other columns are not read, texts of any length are compressed whole, equal sizes go to the first language.
    """
    names, sizes = learn_languages(docs, fold_of, held_out, level, dict_bytes)

    def predict(texts: list[bytes]) -> dict[str, pa.Array]:
        full = [t.decode("utf-8", "replace") for t in texts]
        ok = np.array([bool(names) and any(map(str.isalpha, t)) for t in full], bool)
        c = sizes([letters(t) if k else b"" for t, k in zip(full, ok)]) if names else np.ones((len(full), 1))
        best = c.argmin(axis=1)
        low = c.min(axis=1)
        score = 1 / np.exp(-(c - low[:, None]) / (2 + 0.01 * low[:, None])).sum(axis=1)
        second = np.sort(c, axis=1)[:, min(1, c.shape[1] - 1)]
        return {
            "lang_pred": pa.array([names[b] if k else "und" for b, k in zip(best, ok)], pa.string()),
            "score": np.where(ok, score, 0.0),
            "confident": ok & (second - low >= min_margin * low),
        }

    columns = [F.col("doc_id").cast("long").alias("doc_id"), (fold(F.col("doc_id"), fold_of) == held_out).alias("held_out")]
    return text_map(docs, columns, "text", predict, "doc_id long, held_out boolean, lang_pred string, score double, confident boolean")


def quality_features(sizes: np.ndarray, texts: list[bytes]) -> np.ndarray:
    """Per text: a one, the normalised size difference (bad less good), the share left under the better dictionary, log length."""
    bad, good = sizes[:, 0], sizes[:, 1]
    n = np.array([len(t) for t in texts], float)
    left = np.minimum(np.minimum(bad, good) / (n + 20), 1.0)
    return np.stack([np.ones(len(texts)), (bad - good) / (bad + good + 20), left, left**2, np.log1p(n) / 10], axis=1)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 50) -> np.ndarray:
    """Weights of a logistic regression by Newton's method with a small ridge."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + ridge * np.eye(len(w)) * max(1, len(y)) / 100, x.T @ (y - p) - ridge * w * max(1, len(y)) / 100)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return w


def learn_quality(docs: DataFrame, labels: DataFrame, fold_of: int, held_out: int, level: int, dict_bytes: int) -> tuple[Sizer, np.ndarray]:
    """Dictionaries of bad and good texts, then weights of the calibrated score on further labelled rows."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality").where("doc_id IS NOT NULL AND quality IN (0, 1)")
    known = known.where(fold(F.col("doc_id"), fold_of) != held_out).groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    texts = docs.where(F.col("text").isNotNull() & (F.length("text") <= SAMPLE_CHARS)).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # Both samples have the bounds above, so these joins broadcast a few thousand ids at most, and one text an id is collected.
    # Each uses its own half of the labelled rows, so that a small table leaves rows to calibrate on.
    half = F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(2))
    chosen = spread(known.where(half == 0), "quality", SAMPLE_ROWS)
    rows = one_each(texts.join(F.broadcast(chosen), "doc_id"), "quality", "rank").orderBy("quality", "rank").collect()
    lines = [{x for r in rows if r["quality"] == q for x in r["text"].encode().split(b"\n")} for q in (0, 1)]
    common = lines[0] & lines[1]
    own = [[b"\n".join(x for x in r["text"].encode().split(b"\n") if x not in common) for r in rows if r["quality"] == q] for q in (0, 1)]
    sizes = Sizer([_joined(t, dict_bytes) for t in own], level)
    rest = known.where(half == 1)
    hashed = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1 << _BITS))
    some = rest.where(hashed < int((1 << _BITS) * min(1, CALIBRATION_ROWS / max(1, rest.count())))).orderBy(hashed, "doc_id").limit(2 * CALIBRATION_ROWS)
    measured = text_map(
        one_each(texts.join(F.broadcast(some), "doc_id"), "quality"), ["quality"], "text",
        lambda t: {"f": pa.array(list(quality_features(sizes(t), t)), pa.list_(pa.float64()))}, "quality int, f array<double>",
    ).collect()
    if not measured:
        return sizes, np.array([0.0, 20.0, 0.0, 0.0, 0.0])
    return sizes, fit_logistic(np.array([r["f"] for r in measured]), np.array([r["quality"] for r in measured], float))


def score_quality(
    docs: DataFrame, labels: DataFrame, fold_of: int = 3, held_out: int = 1, level: int = -1, dict_bytes: int = DICT_BYTES
) -> DataFrame:
    """All columns of ``docs`` plus ``held_out, score, predicted``: how likely a text has ``quality`` 1.

    Texts are compressed whole under a dictionary of bad and one of good texts; the normalised difference
    of the sizes, with the share left and the length, becomes a score through a logistic calibration.
    Learned from bounded samples (the module's constants) of ``labels(doc_id, quality)`` outside the
    held-out fold. A score reads the text only.

    Null and empty texts are scored as empty, very long ones whole. Without labelled rows the score rests on the plain size
    difference. Labels that are null do not count, those that repeat an id once (the smallest), and of the texts that
    share a labelled id the smallest is learned from. Repeated rows stay, null ids are kept (fold 0), and columns of
    ``docs`` named like the new ones are replaced.
    """
    sizes, w = learn_quality(docs, labels, fold_of, held_out, level, dict_bytes)
    names = [c for c in docs.columns if c not in ("held_out", "score", "predicted")]

    def predict(texts: list[bytes]) -> dict[str, np.ndarray]:
        return {"score": 1 / (1 + np.exp(-np.clip(quality_features(sizes(texts), texts) @ w, -30, 30)))}

    held = (fold(F.col("doc_id"), fold_of) == held_out).alias("held_out")
    scored = with_text_columns(docs, names, held, predict)
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def with_text_columns(docs: DataFrame, names: list[str], held: Column, predict: Callable[[list[bytes]], dict[str, np.ndarray]]) -> DataFrame:
    row = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), held, F.col("text").alias("text"))
    kept = row.schema["row"]
    schema = T.StructType([kept]).add("held_out", T.BooleanType()).add("score", T.DoubleType())
    out = text_map(row, ["row", "held_out"], "text", predict, schema)
    return out.select(*(F.col("row").getField(c).alias(c) for c in names), "held_out", "score")
