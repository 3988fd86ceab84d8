"""Quality rules: base counts of a text, and how far its histograms are from those of the languages.

References are learned from all documents that pass the base rules and have few symbols and no repeated lines: for each language
how often every class of characters and every one of its commonest words occurs. A document is as far from a language as the larger of its two Jensen-Shannon
distances, each less what chance alone explains in a text of that length; it is judged by the nearest language.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, materialise, text_map

#: What counts as a symbol.
SYMBOLS = b"#*$%&|<>"
#: Classes of characters: marks that sentences use, symbols as above, and by Unicode category.
SENTENCE = ".,;:!?'\"()-"
CLASSES = ("small letter", "capital letter", "other letter", "number", "sentence mark", "symbol", "other mark", "rest")
#: Languages that documents are compared with: those with the most documents to learn from, and ``LANGUAGE_DOCS`` at least.
LANGUAGES, LANGUAGE_DOCS = 256, 20
#: Common words of a language, and counters of words that a task holds before it hands them on.
COMMON, COUNTERS = 20, 400_000
#: Below so many words a document is not judged by its histograms.
LEAST_WORDS = 50
#: Largest distances that pass, and how many times what chance explains on the average is allowed for.
MAX_CLASSES, MAX_WORDS, CHANCE = 0.25, 0.25, 1.5
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_FOLD = bytes(b | 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


@cache
def _classes() -> np.ndarray:
    """The class of every code point; ASCII white space has none (-1)."""
    of = {"Ll": 0, "Lu": 1, "Lt": 1, "Lo": 2, "Lm": 2, "Mn": 2, "Mc": 2, "Nd": 3, "Nl": 3, "No": 3}
    out = np.array([of.get(c := unicodedata.category(chr(i)), 6 if c[0] in "PS" else 7) for i in range(0x110000)], np.int8)
    out[[ord(c) for c in SENTENCE]] = 4
    out[list(SYMBOLS)] = 5
    out[np.flatnonzero(_SPACE)] = -1
    return out


def class_counts(text: bytes) -> np.ndarray:
    """How many characters of each class a text has."""
    points = np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)
    kinds = _classes()[points]
    return np.bincount(kinds[kinds >= 0], minlength=len(CLASSES))


def repeated_words(words: list[bytes], window: int = 8) -> int:
    """How many words stand in windows of ``window`` words that occur twice or more; exact, as windows are numbered by doubling."""
    if len(words) <= window:
        return 0
    ids = pd.factorize(np.array(words, dtype=object))[0].astype(np.int64)
    if ids.max() + 1 == len(ids):
        return 0
    width = 1
    while width < window:
        ids = np.unique(ids[:-width] * (int(ids.max()) + 1) + ids[width:], return_inverse=True)[1]
        width *= 2
    often = np.bincount(ids)[ids] > 1
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(often)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def base_counts(text: bytes) -> tuple[int, int, int, int, int]:
    """``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` of a text."""
    words = text.split()
    raw = np.frombuffer(text, np.uint8)
    chars = int(((raw & 0xC0 != 0x80) & ~_SPACE[raw]).sum())
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated_words(words)


def fails(n_words: int, n_repeat_words: int) -> bool:
    return n_words < 20 or 100 * n_repeat_words > 30 * n_words


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distances (base 2, 0 to 1) of histograms, row by row."""
    p, q = (x / np.maximum(x.sum(axis=-1, keepdims=True), 1) for x in (p, q))
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(p / m), 0).sum(axis=-1)
        right = np.where(q > 0, q * np.log2(q / m), 0).sum(axis=-1)
    return np.sqrt(np.clip((left + right) / 2, 0, 1))


def beyond_chance(distance: np.ndarray, bins: int, n: int) -> np.ndarray:
    """The distance without what ``n`` draws from the reference itself show on the average, times ``CHANCE``."""
    return np.sqrt(np.maximum(0, distance**2 - CHANCE * bins / (8 * max(n, 1) * np.log(2))))


SEEN = "lang string, kind string, word binary, n long"


def histograms(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """``lang, kind, word, n``: partial counts over ``docs(lang, text)``, to be summed.

    Kind ``docs`` counts documents, ``words`` all their words, ``class 0`` and so on characters, ``word`` single words.
    """

    def rows(held: dict[str, Counter], totals: Counter) -> Iterator[pa.RecordBatch]:
        flat = [(lang, kind, b"", n) for (lang, kind), n in totals.items()]
        flat += [(lang, "word", w, n) for lang, words in held.items() for w, n in words.items()]
        for i in range(0, len(flat), 50_000):
            lang, kind, word, n = zip(*flat[i : i + 50_000])
            yield pa.RecordBatch.from_pydict({"lang": pa.array(lang), "kind": pa.array(kind), "word": pa.array(word, pa.binary()), "n": pa.array(n, pa.int64())})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}
        totals: Counter = Counter()
        size = 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words = base_counts(text)
                if fails(n_words, n_repeat_words) or 100 * n_symbols > word_chars or n_dup_lines:
                    continue
                words, own = text.translate(_FOLD).split(), held.setdefault(lang, Counter())
                before = len(own)
                own.update(words)
                totals.update({(lang, "docs"): 1, (lang, "words"): len(words)} | {(lang, f"class {i}"): int(n) for i, n in enumerate(class_counts(text))})
                size += len(own) - before
                if size >= counters:
                    yield from rows(held, totals)
                    held, totals, size = {}, Counter(), 0
        yield from rows(held, totals)

    return docs.mapInArrow(count, SEEN)


class References:
    """Histograms of the languages: ``classes`` has a row for each, ``words`` too, with all other words in the last column."""

    def __init__(self, totals: dict[str, dict[str, int]], common: dict[str, dict[bytes, int]], width: int):
        self.names = sorted(totals)
        self.classes = np.array([[totals[k].get(f"class {i}", 0) for i in range(len(CLASSES))] for k in self.names], float).reshape(-1, len(CLASSES))
        self.vocabulary = sorted({w for k in self.names for w in common.get(k, {})})
        place = {w: i for i, w in enumerate(self.vocabulary)}
        self.at = np.full((len(self.names), width), len(place), np.int64)  # the last place is empty
        self.words = np.zeros((len(self.names), width + 1))
        for row, k in enumerate(self.names):
            for col, (w, n) in enumerate(common.get(k, {}).items()):
                self.at[row, col], self.words[row, col] = place[w], n
            self.words[row, -1] = totals[k].get("words", 0) - self.words[row].sum()

    def distances(self, text: bytes) -> tuple[str, float, float]:
        """The nearest language, and the distances of classes and of words from it."""
        kinds, counts = class_counts(text), Counter(words := text.translate(_FOLD).split())
        seen = np.array([counts[w] for w in self.vocabulary] + [0])[self.at]
        own = np.column_stack([seen, len(words) - seen.sum(axis=1)])
        by_class = beyond_chance(js_distance(kinds, self.classes), self.classes.shape[1], int(kinds.sum()))
        by_word = beyond_chance(js_distance(own, self.words), self.words.shape[1], len(words))
        k = int(np.argmin(np.maximum(by_class / MAX_CLASSES, by_word / MAX_WORDS)))
        return self.names[k], float(by_class[k]), float(by_word[k])


def learn_references(docs: DataFrame, common: int = COMMON, languages: int = LANGUAGES, language_docs: int = LANGUAGE_DOCS, counters: int = COUNTERS) -> References:
    """References of ``docs(lang, text)``; at most ``languages`` rows of counts and ``common`` words of each reach the driver."""
    seen = materialise(histograms(docs.where("lang IS NOT NULL").select("lang", F.coalesce("text", F.lit("")).cast("binary").alias("text")), counters))
    by_kind = seen.where("kind <> 'word'").groupBy("lang", "kind").agg(F.sum("n").alias("n"))
    totals = by_kind.groupBy("lang").agg(F.map_from_entries(F.collect_list(F.struct("kind", "n"))).alias("of"))
    most = totals.where(F.col("of.docs") >= language_docs).orderBy(F.desc("of.docs"), "lang").limit(languages)
    of = {r["lang"]: r["of"] for r in most.collect()}
    # The limit on the rank holds before the exchange too, so no language's vocabulary meets in one task.
    place = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "word"))
    words = seen.where((F.col("kind") == "word") & F.col("lang").isin(list(of))).groupBy("lang", "word").agg(F.sum("n").alias("n"))
    top: dict[str, dict[bytes, int]] = {}
    for r in words.withColumn("place", place).where(F.col("place") <= common).orderBy("lang", "place").collect():
        top.setdefault(r["lang"], {})[bytes(r["word"])] = r["n"]
    discard(seen)
    return References(of, top, common)


def check_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least_words: int = LEAST_WORDS, **learning) -> DataFrame:
    """One row for each document: ``doc_id``, five counts, ``base_failed, kept, nearest, class_distance, word_distance``.

    ``n_words`` words between ASCII white space have ``word_chars`` code points; ``n_symbols`` counts ``#*$%&|<>``,
    ``n_dup_lines`` lines with a word that are equal to an earlier line, ``n_repeat_words`` the words in windows of eight words
    that stand twice or more in the text. A document fails the base rules with fewer than 20 words or more than 30 %
    repeated words. Of the others those are kept that are near enough to some language (its ``nearest``) in both
    histograms; the language column is only learned from, never compared. Guards: documents of fewer than ``least_words`` words
    are not compared and stay, and distances are reduced by what chance explains in a text of that length.

    Null and empty texts have no words and fail. Rows without a language teach nothing; without a language of enough
    documents nothing is compared. Repeated rows stay and count as often as they stand; null ids are kept; empty tables give
    empty results; other columns are not read. A task holds one text's words at a time, whatever its length.
    """
    column = lambda c: F.col(f"`{c}`").cast("string")
    known = learn_references(docs.select(column(lang_col).alias("lang"), column(text_col).alias("text")), **learning)

    def judge(texts: list[bytes]) -> dict[str, list]:
        out: dict[str, list] = {k: [] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "nearest", "class_distance", "word_distance")}
        for t in texts:
            counts = base_counts(t)
            failed = fails(counts[0], counts[4])
            near, by_class, by_word = (None, None, None) if failed or counts[0] < least_words or not known.names else known.distances(t)
            kept = not failed and (near is None or (by_class <= MAX_CLASSES and by_word <= MAX_WORDS))
            for k, v in zip(out, (*counts, failed, kept, near, by_class, by_word)):
                out[k].append(v)
        return {**out, "nearest": pa.array(out["nearest"], pa.string()), **{k: pa.array(out[k], pa.float64()) for k in ("class_distance", "word_distance")}}

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, nearest string, class_distance double, word_distance double"
    return text_map(docs, [F.col(f"`{id_col}`").cast("long").alias("doc_id")], f"`{text_col}`", judge, schema)
