"""Token counts by a linear longest-match automaton.

Greedy longest-match word pieces are counted without being built: a trie of the vocabulary has
failure links, and each node knows how many pieces are complete when its link is followed
(popped tokens). A word is read once; failures add those numbers. Every byte is a piece of the
vocabulary, so each word can be cut.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import NO_ID, shown_id


def byte_vocabulary(path: str) -> list[bytes]:
    """The pieces of a byte-level tokenizer file as bytes, and each single byte."""
    spec = json.loads(Path(path).read_text())
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
    special = {t["content"] for t in spec.get("added_tokens", [])}
    pieces = {bytes(byte[c] for c in t) for t in spec["model"]["vocab"] if t not in special and all(c in byte for c in t)}
    return sorted(pieces | {bytes([b]) for b in range(256)})


class LongestMatch:
    """Number of greedy longest-match pieces of a byte string, in time linear in its length."""

    def __init__(self, pieces: list[bytes]):
        self.kids: list[dict[int, int]] = [{}]
        ends = [False]
        for piece in pieces:
            node = 0
            for c in piece:
                nxt = self.kids[node].get(c)
                if nxt is None:
                    nxt = self.kids[node][c] = len(self.kids)
                    self.kids.append({})
                    ends.append(False)
                node = nxt
            ends[node] = node != 0
        self.fail = [0] * len(self.kids)
        self.popped = [0] * len(self.kids)
        level = [(0, c, k) for c, k in self.kids[0].items()]
        while level:  # by depth, so links of shorter prefixes are known
            for parent, c, node in level:
                if ends[node]:
                    self.fail[node], self.popped[node] = 0, 1
                    continue
                to, n = self.fail[parent], self.popped[parent]
                while c not in self.kids[to]:
                    n += self.popped[to]
                    to = self.fail[to]
                self.fail[node], self.popped[node] = self.kids[to][c], n
            level = [(node, c, k) for _, _, node in level for c, k in self.kids[node].items()]

    def count(self, word: bytes) -> int:
        kids, fail, popped = self.kids, self.fail, self.popped
        node = n = 0
        for c in word:
            while (nxt := kids[node].get(c)) is None:
                n += popped[node]
                node = fail[node]
            node = nxt
        while node:
            n += popped[node]
            node = fail[node]
        return n


class _Counts(dict):
    """Pieces of each word after a space; emptied when it has grown large."""

    def __init__(self, automaton: LongestMatch):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        n = self[word] = self.automaton.count(b" " + word)
        return n


_known: dict[str, _Counts] = {}


def token_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_words, n_tokens) for each document.

    A word, with a space before it, is cut from the left into the longest pieces of the
    vocabulary (a byte-level tokenizer file). A null text counts as empty and has none; a null
    id stays null; repeated rows each give a row. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if vocabulary not in _known:
            _known[vocabulary] = _Counts(LongestMatch(byte_vocabulary(vocabulary)))
        counts = _known[vocabulary].__getitem__
        for b in batches:
            n_bytes, n_words, n_tokens = [], [], []
            for body in b.column(1):
                raw = body.as_py()
                words = raw.split()
                n_bytes.append(len(raw))
                n_words.append(len(words))
                n_tokens.append(sum(map(counts, words)))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.int64()) for x in (n_bytes, n_words, n_tokens))], names=["id", "n_bytes", "n_words", "n_tokens"])

    source = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)), F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    done = source.mapInArrow(run, "id long, n_bytes long, n_words long, n_tokens long")
    return done.select(shown_id().alias("doc_id"), "n_bytes", "n_words", "n_tokens")
