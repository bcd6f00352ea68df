"""Suffix-array dedup of 200-byte strings, one suffix bucket at a time.

Suffixes (byte positions with 200 bytes left in their document) are dealt to buckets by the
minimiser of those bytes, so suffixes that agree that far meet (quarry.llm.windows). Buckets are
sorted in blocks of bounded size. The suffixes in every difference-cover residue are ranked
beforehand, by doubling the bytes that count until these are 200 or more. Then all suffixes are
sorted by their first bytes, and long ties by the ranks: for any two suffixes there is an offset
under 13 at which both are in the cover. Equal strings are neighbours in that order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import windows as W
from quarry.llm.common import column, free_shuffles, keyed, shown_id, tidy

GRAM = 16
#: Each difference modulo 13 occurs between two residues of the cover.
MODULUS, COVER = 13, (0, 1, 3, 9)
#: Bytes that suffixes are sorted by before ranks are: 8, then 5 at a time.
HEAD = 33

_member = np.zeros(MODULUS, bool)
_member[list(COVER)] = True
#: Offset from residues (a, b) at which both are in the cover.
OFFSET = np.array([[next(k for k in range(MODULUS) if _member[(a + k) % MODULUS] and _member[(b + k) % MODULUS]) for b in range(MODULUS)] for a in range(MODULUS)])


def _words(buf: bytes) -> np.ndarray:
    """The 8 bytes from each position on as one number; zeros follow the end, and HEAD more positions do."""
    padded = np.frombuffer(buf + bytes(HEAD + 16), np.uint8)
    return np.ndarray((len(buf) + HEAD,), "<u8", padded, strides=(1,))


def _batch(ids: list[int], ths: list[int], texts: list[bytes]) -> W.Batch:
    buf = b"".join(texts)
    bounds = np.append(0, np.cumsum([len(t) for t in texts], dtype=np.int64))
    w = _words(buf)
    n = max(0, len(buf) - GRAM + 1)
    h = W.mixed(w[:n] * W.K1 + w[8 : n + 8] * W.K2) if n else np.empty(0, np.uint64)
    return W.Batch(np.array(ids, np.int64), np.array(ths, np.int64), bounds, buf, h)


def _piece(buf: bytes, lo: int, hi: int) -> bytes:
    return buf[lo:hi]


def _equal(words: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Whether the `length` bytes from a and from b on are equal."""
    same = np.ones(len(a), bool)
    left = np.arange(len(a))
    for k in range(0, length, 8):
        rest = np.uint64(max(0, 64 - 8 * (length - k)))  # bits beyond the length
        left = left[((words[a[left] + k] ^ words[b[left] + k]) << rest) == 0]
        if not len(left):
            break
    same[:] = False
    same[left] = True
    return same


def _numbers(keys: np.ndarray) -> np.ndarray:
    """Numbers from 1 on of sorted keys, the same for equal ones."""
    return np.cumsum(np.append(True, keys[1:] != keys[:-1])[: len(keys)])


def by_head(words: np.ndarray, at: np.ndarray, head: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, number): the positions sorted by their first `head` bytes, with numbers of equal ones."""
    key = words[at].byteswap()  # the first byte is the highest
    order = np.argsort(key)
    number = _numbers(key[order])
    for k in range(8, head, 5):
        size = np.bincount(number, minlength=2)
        tied = np.flatnonzero(size[number] > 1)
        if not len(tied):
            break
        own = order[tied]
        more = words[at[own] + k].byteswap() >> np.uint64(24)
        if len(at) < 1 << 24:
            key = number[tied].astype(np.uint64) << np.uint64(40) | more
            by = np.argsort(key)
        else:
            by = np.lexsort([more, number[tied]])
        order[tied] = own[by]
        fresh = np.append(True, number[1:] != number[:-1])
        fresh[tied] |= np.append(True, more[by][1:] != more[by][:-1])
        number = np.cumsum(fresh)
    return order, number


class CoverRanks:
    """Ranks of all positions in cover residues by their first `length` bytes or more."""

    def __init__(self, words: np.ndarray, size: int, length: int):
        sample = np.flatnonzero(np.resize(_member, size))
        order, number = by_head(words, sample, MODULUS)
        span = MODULUS
        self.rank = np.zeros(size + 2 * length + 2 * MODULUS, np.int64)  # the end of the text is least
        self.rank[sample[order]] = number
        while span < length:
            key = self.rank[sample] << 32 | self.rank[sample + span]
            order = np.argsort(key)
            self.rank[sample[order]] = _numbers(key[order])
            span *= 2


def suffix_order(buf: bytes, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, same): the positions sorted by their first `length` bytes, and which of them share these with the next."""
    words = _words(buf)
    order, number = by_head(words, at, HEAD)
    same = number[1:] == number[:-1]
    if length > HEAD and same.any():
        rank = CoverRanks(words, len(buf), length).rank
        known = np.zeros(len(same), bool)
        size = np.bincount(number)
        slots = np.flatnonzero(size[number] > 1)  # places in the order that ties hold
        group = _numbers(number[slots]) - 1
        while len(slots):
            first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
            size = np.diff(np.append(first, len(group)))
            here = at[order[slots]]
            pivot = here[first + size // 2][group]
            k = OFFSET[here % MODULUS, pivot % MODULUS]
            side = np.sign(rank[here + k] - rank[pivot + k]) + 1
            key = group * 3 + side
            by = np.argsort(key, kind="stable")
            order[slots], key = order[slots][by], key[by]
            tie = np.flatnonzero((key[1:] == key[:-1]) & (key[1:] % 3 == 1))
            known[slots[tie]] = True  # both equal the pivot
            number = _numbers(key)
            size = np.bincount(number)
            open_ = (key % 3 != 1) & (size[number] > 1)
            slots, group = slots[open_], _numbers(number[open_]) - 1
        ask = np.flatnonzero(same & ~known)
        same = known
    else:
        ask = np.flatnonzero(same) if length > HEAD else np.arange(len(same))
        same = np.zeros(len(same), bool)
    same[ask] = _equal(words, at[order[ask]], at[order[ask + 1]], length)
    return order, same


def repeated(buf: bytes, at: np.ndarray, length: int) -> np.ndarray:
    """Which of the suffixes at these positions share their first `length` bytes with another."""
    order, same = suffix_order(buf, at, length)
    out = np.zeros(len(at), bool)
    out[order[:-1][same]] = out[order[1:][same]] = True
    return out


def _decide(length: int):
    def decide(block: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        text, offsets, _, _, _, _, n_windows, twice = block
        piece, number, at = W.window_starts(offsets[:-1], n_windows)
        return W.as_runs(piece, number, repeated(text, at, length) | twice[piece])

    return decide


def _alone(length: int, gram: int):
    def alone(text: bytes, windows: int) -> bool:
        """Whether no two windows of the piece can be equal.

        All windows cover the bytes from the last one's start to the first one's end. Of two
        equal windows the later one has them again as much earlier as it is later.
        """
        return windows <= length - gram + 1 and text.find(text[windows - 1 : length]) == windows - 1

    return alone


def remove_repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, carry: tuple[str, ...] = (), whole_letters: bool = False) -> DataFrame:
    """Remove every byte in a string of `length` bytes that also starts anywhere else.

    Returns (doc_id, n_bytes, n_removed, n_spans, kept binary) and the columns named in carry as
    carried_0, carried_1 and so on.
    Overlapping occurrences count, in one document too; strings never cross documents and are
    judged on the input. A null text counts as empty; it and texts under `length` bytes lose
    nothing. Repeated rows are different documents, so both lose such strings; a null id stays
    null. whole_letters: kept also loses what is left of a letter whose other bytes were removed,
    so that it is valid UTF-8. Other columns are ignored.
    """
    rows = keyed(docs, id_col, text_col)
    gram = min(GRAM, length)
    found = W.removals(rows, length, gram, _batch, _piece, _decide(length), least_id=False, alone=_alone(length, gram))
    free_shuffles(docs.sparkSession)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            removed, spans, kept = [], [], []
            for body, lows, highs in zip(b.column("body"), b.column("lows").to_pylist(), b.column("highs").to_pylist()):
                raw = body.as_py()
                gone = W.covered(len(raw), lows, highs)
                if gone is None:
                    removed.append(0)
                    spans.append(0)
                    kept.append(raw)
                else:
                    removed.append(int(gone.sum()))
                    spans.append(int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()))
                    kept.append(np.frombuffer(raw, np.uint8)[~gone].tobytes())
            n = [len(k) + r for k, r in zip(kept, removed)]
            if whole_letters:
                kept = [k.decode("utf-8", "ignore").encode() if r else k for k, r in zip(kept, removed)]
            own = [b.column(c) for c in ("id", *carried)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())], names=["id", *carried, "n_bytes", "n_removed", "n_spans", "kept"])

    carried = [f"carried_{k}" for k in range(len(carry))]
    full = docs.select(*[F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1)).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("body")], *[column(c).alias(k) for c, k in zip(carry, carried)])
    full = full.withColumn("th", F.xxhash64("body")).withColumn("body", F.col("body").cast("binary"))
    both = full.join(W.spans_of(found), ["id", "th"], "left").select("id", "body", "lows", "highs", *carried)
    kinds = {f.name: f.dataType.simpleString() for f in full.schema}
    schema = ", ".join(["id long", *[f"{c} {kinds[c]}" for c in carried], "n_bytes long, n_removed long, n_spans long, kept binary"])
    done = both.mapInArrow(tidy(keep), schema)
    return done.select(shown_id().alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept", *carried)
