"""Substring dedup of 13-word windows by super-k-mer partitioning.

Window = k-mer of words; minimiser = least hash of the 3-word grams in it. Consecutive windows
that share a minimiser travel as one packed string to its bucket (quarry.llm.windows); there
windows are sorted by a hash of their words and neighbours with one hash compared in full.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import windows as W
from quarry.llm.common import free_shuffles, keyed, shown_id, tidy

GRAM = 3


def _words(line: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, end and hash of each word of a text whose words are parted by single spaces."""
    gaps = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    begin, end = np.append(0, gaps + 1), np.append(gaps, len(line))
    return begin, end, W.Fingerprints(line).of(begin, end)


def _batch(ids: list[int], ths: list[int], texts: list[bytes]) -> W.Batch:
    lines = [b" ".join(t.split()) for t in texts]  # bytes.split() parts at [\x20\x09-\x0D]+
    bounds = np.append(0, np.cumsum([x.count(b" ") + 1 if x else 0 for x in lines], dtype=np.int64))
    line = b" ".join(filter(None, lines))
    begin, end, h = _words(line)
    n = max(0, int(bounds[-1]) - GRAM + 1)
    gram = h[:n] * W.K1 + h[1 : n + 1] * W.K2 + h[2 : n + 2] * W.K3 if n else h[:0]
    return W.Batch(np.array(ids, np.int64), np.array(ths, np.int64), bounds, (line, begin.tolist(), end.tolist()), W.mixed(gram))


def _piece(units: tuple[bytes, list[int], list[int]], lo: int, hi: int) -> bytes:
    line, begin, end = units
    return line[begin[lo] : end[hi - 1]]


def _decide(length: int):
    factors = np.random.default_rng(7).integers(1, 1 << 63, length, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def decide(block: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        text, _, _, ids, _, _, n_windows, _ = block
        begin, end, code = _words(text)
        n_words = n_windows.astype(np.int64) + length - 1
        piece, number, at = W.window_starts(np.cumsum(n_words) - n_words, n_windows)
        n = len(code) - length + 1
        h = np.zeros(n, np.uint64)
        for j in range(length):
            h += code[j : n + j] * factors[j]
        h = h[at]
        order = np.argsort(h)
        same = h[order][1:] == h[order][:-1]
        own = ids[piece]
        bad = np.zeros(len(at), bool)
        if same.any():
            some = order[np.append(same, False) | np.append(False, same)]  # only windows whose hash another has
            lo, hi = begin[at[some]].tolist(), end[at[some] + length - 1].tolist()
            fresh = np.append(True, h[some][1:] != h[some][:-1])
            exact = np.fromiter((text[a:b] == text[c:d] for a, b, c, d in zip(lo[1:], hi[1:], lo, hi)), bool, len(some) - 1)
            if (~fresh[1:] & ~exact).any():  # different windows with one hash: told apart by their text
                numbers: dict[bytes, int] = {}
                group = np.fromiter((numbers.setdefault(text[a:b], len(numbers)) for a, b in zip(lo, hi)), np.int64, len(some))
                by = np.argsort(group, kind="stable")
                some, group = some[by], group[by]
            else:
                group = np.cumsum(fresh)
            start = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
            least = np.minimum.reduceat(own[some], start)
            bad[some] = own[some] > np.repeat(least, np.diff(np.append(start, len(some))))
        return W.as_runs(piece, number, bad)

    return decide


def remove_repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 13) -> DataFrame:
    """Remove every word in a window of `length` words that also starts in a document of smaller id.

    Returns (doc_id, n_words, n_removed, kept): kept is the words left, joined by single spaces.
    Windows are judged on the input. A null or empty text, or one of fewer words, loses nothing.
    A null id counts as larger than any other and as equal to another null. Rows with equal ids
    don't remove each other's windows; repeated rows each give a row. Other columns are ignored.
    """
    rows = keyed(docs, id_col, text_col)
    found = W.removals(rows, length, GRAM, _batch, _piece, _decide(length), least_id=True, between=b" ")
    free_shuffles(docs.sparkSession)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, body, lows, highs in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), b.column(3).to_pylist()):
                words = body.as_py().split()
                gone = W.covered(len(words), lows, highs)
                kept = words if gone is None else [w for w, g in zip(words, gone.tolist()) if not g]
                out.append((i, len(words), len(words) - len(kept), b" ".join(kept)))
            columns = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["id", "n_words", "n_removed", "kept"])

    both = rows.join(W.spans_of(found), ["id", "th"], "left").select("id", "body", "lows", "highs")
    done = both.mapInArrow(tidy(keep), "id long, n_words long, n_removed long, kept binary")
    return done.select(shown_id().alias("doc_id"), "n_words", "n_removed", F.col("kept").cast("string").alias("kept"))
