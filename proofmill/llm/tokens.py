"""Token counts by a linear longest-match automaton over a piece vocabulary."""

from __future__ import annotations

import base64
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_map

#: Where the public byte-level vocabulary lies, as ``base64(piece) rank`` lines.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Distinct words whose counts a task remembers.
MEMO = 200_000


class LongestMatch:
    """Counts the pieces of greedy longest-match-first splitting in one pass over a word.

    Trie nodes have a failure link, to where matching goes on once the longest piece on the path has
    been popped, and the number of pieces popped on the way; pieces themselves are never built. A word
    starts at ``start``; after a popped piece it goes on at the ``prefix`` node (the root if there is no prefix).
    """

    def __init__(self, pieces: Iterable[bytes], prefix: bytes = b""):
        self.next: list[dict[int, int]] = [{}]
        whole = set()
        for piece in [*pieces, prefix]:
            node = 0
            for c in piece:
                follow = self.next[node].get(c)
                if follow is None:
                    follow = self.next[node][c] = len(self.next)
                    self.next.append({})
                node = follow
            if piece and piece != prefix:
                whole.add(node)
            if piece == prefix:
                self.more = node
        self.link, self.pops = [-1] * len(self.next), [0] * len(self.next)
        queue = [0, self.more] if self.more else [0]
        seen = {0, self.more}
        while queue:
            later = []
            for node in queue:
                for c, child in self.next[node].items():
                    if child in seen:
                        continue
                    seen.add(child)
                    later.append(child)
                    if child in whole:
                        self.link[child], self.pops[child] = self.more, 1
                        continue
                    at, popped = self.link[node], self.pops[node]
                    while at >= 0 and c not in self.next[at]:
                        popped += self.pops[at]
                        at = self.link[at]
                    if at >= 0:
                        self.link[child], self.pops[child] = self.next[at][c], popped
            queue = later

    def count(self, word: bytes) -> int:
        """Pieces of ``word``; 1 (the unknown piece) where it cannot be split; 0 for an empty word."""
        node, n = 0, 0
        step, link, pops = self.next, self.link, self.pops
        for c in word:
            while c not in step[node]:
                if link[node] < 0:
                    return 1
                n += pops[node]
                node = link[node]
            node = step[node][c]
        while node not in (0, self.more):
            if link[node] < 0:
                return 1
            n += pops[node]
            node = link[node]
        return n


def read_pieces(path: str = VOCABULARY) -> list[bytes]:
    with open(path, "rb") as f:
        return [base64.b64decode(line.split()[0]) for line in f if line.strip()]


@lru_cache(maxsize=4)
def _automaton(pieces: tuple[bytes, ...], prefix: bytes) -> LongestMatch:
    return LongestMatch(pieces, prefix)


def count_tokens(
    docs: DataFrame, pieces: Iterable[bytes], prefix: bytes = b"", lead: bytes = b" ", id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row for each document: ``doc_id, n_words, n_tokens, max_word_tokens``.

    Words stand between ASCII white space and are split as ``lead + word`` by greedy longest match; the
    default suits byte-level vocabularies, whose word-initial pieces start with a space. The pieces are
    read on the driver (a vocabulary is bounded) and the automaton is built once per worker. Null
    and wordless texts have 0 tokens. A word that the vocabulary cannot cover counts as 1. Repeated
    rows stay, null ids are kept, empty tables give empty results, other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast((tuple(pieces), prefix))

    def count(texts: list[bytes]) -> dict[str, np.ndarray]:
        one, memo, rows = _automaton(*shared.value).count, {}, []
        for t in texts:
            words = t.split()
            for w in set(words):
                if w not in memo:
                    if len(memo) >= MEMO:
                        memo.clear()
                    memo[w] = one(lead + w)
            found = [memo[w] if w in memo else one(lead + w) for w in words]
            rows.append((len(words), sum(found), max(found, default=0)))
        return dict(zip(["n_words", "n_tokens", "max_word_tokens"], np.array(rows, np.int64).reshape(-1, 3).T))

    return text_map(docs, [F.col(id_col).cast("long").alias("doc_id")], text_col, count, "doc_id long, n_words long, n_tokens long, max_word_tokens long")
