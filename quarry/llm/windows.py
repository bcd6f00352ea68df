"""Super-windows: equal windows of documents meet without shipping each window.

A window's minimiser is the least hash of the grams in it, so equal windows have equal
minimisers. Consecutive windows of a document that share one travel as one packed piece of text
to the minimiser's bucket. Pieces with equal content in a task are sent once. A minimiser that
holds a large part of all pieces would overload its bucket; its windows are sent singly, each
to a bucket by its own content.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import HEAVY_SCHEMA, Frequent, cut, heavy_keys, partitions, tidy

#: Text that is worked on at once in a task, and packed text held before it is sent on, in bytes.
STEP, HELD = 3 << 19, 28 << 20
#: Bytes that a held span and a held piece take besides its text, about.
SPAN, PIECE = 200, 400

K1, K2, K3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(29))
    h = h * K3
    return h ^ (h >> np.uint64(32))


def sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    """Least of h[i : i + width] for each i, by doubling."""
    span = 1
    while span * 2 <= width:
        h = np.minimum(h[:-span], h[span:])
        span *= 2
    if span < width:
        h = np.minimum(h[: len(h) - (width - span)], h[width - span :])
    return h


class Fingerprints:
    """Polynomial fingerprints modulo 2^64 of any substrings of a buffer."""

    BASE = 0x9E3779B97F4A7C15 | 1
    TABLE = np.random.default_rng(3).integers(1, 1 << 63, 256, dtype=np.uint64)
    _powers: dict[int, np.ndarray] = {}

    def __init__(self, buf: bytes):
        self.sums = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(self.TABLE[np.frombuffer(buf, np.uint8)] * self.powers(self.BASE, len(buf)), out=self.sums[1:])
        self.back = self.powers(pow(self.BASE, -1, 1 << 64), len(buf) + 1)

    @classmethod
    def powers(cls, base: int, n: int) -> np.ndarray:
        """The first n powers; those of usual blocks are kept."""
        known = cls._powers.get(base)
        if known is None or len(known) < n:
            known = np.full(max(n, 2 * STEP), base, np.uint64)
            known[0] = 1
            known = np.cumprod(known)
            if len(known) <= 4 * STEP:
                cls._powers[base] = known
        return known[:n]

    @classmethod
    def forget(cls) -> None:
        cls._powers.clear()

    def of(self, at: np.ndarray, to: np.ndarray) -> np.ndarray:
        return mixed((self.sums[to] - self.sums[at]) * self.back[at])


@dataclass
class Batch:
    """Some documents as one array of units (bytes or words), end to end."""

    ids: np.ndarray
    ths: np.ndarray
    bounds: np.ndarray  # of the documents, in units; one more than there are documents
    units: object  # what piece() cuts from
    hashes: np.ndarray  # of the gram that starts at each unit, shorter at the end


@dataclass
class Pieces:
    """What a bucket gets: pieces of text with the windows in each and where they come from."""

    texts: list[bytes] = field(default_factory=list)
    keys: list[int] = field(default_factory=list)
    ids: list[int] = field(default_factory=list)
    ths: list[int] = field(default_factory=list)
    starts: list[int] = field(default_factory=list)
    windows: list[int] = field(default_factory=list)
    twice: list[bool] = field(default_factory=list)

    def packed(self) -> bytes:
        arrays = (self.keys, self.ids, self.ths, self.starts, self.windows, self.twice)
        kinds = (np.int64, np.int64, np.int64, np.int32, np.int32, bool)
        lengths = np.fromiter(map(len, self.texts), np.int32, len(self.texts))
        return zstandard.ZstdCompressor(level=1).compress(pickle.dumps((b"".join(self.texts), lengths, *(np.array(a, k) for a, k in zip(arrays, kinds))), 5))


def unpacked(blob: bytes) -> tuple:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(blob))


def documents(batches: Iterator[pa.RecordBatch], step: int) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """Lists of ids, text hashes and texts, of about `step` bytes each; one document is never cut."""
    ids, ths, texts, size = [], [], [], 0
    for b in batches:
        for i, th, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
            ids.append(i)
            ths.append(th)
            texts.append(body.as_py())
            size += len(texts[-1])
            if size >= step:
                yield ids, ths, texts
                ids, ths, texts, size = [], [], [], 0
    if ids:
        yield ids, ths, texts


def runs(batch: Batch, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of consecutive windows with one minimiser: document index, first unit, windows, minimiser."""
    sizes = np.diff(batch.bounds)
    n = len(batch.hashes) - (length - gram)
    if n <= 0:
        return (np.empty(0, np.int64),) * 4
    key = sliding_min(batch.hashes, length - gram + 1)
    # windows of a document start in [bounds[d], bounds[d + 1] - length]
    have = np.flatnonzero(sizes >= length)
    ok = np.zeros(n + 1, np.int32)
    np.add.at(ok, batch.bounds[have], 1)
    np.add.at(ok, batch.bounds[have + 1] - length + 1, -1)
    ok = np.cumsum(ok[:-1]) > 0
    new = np.empty(n, bool)
    new[0] = True
    new[1:] = (key[1:] != key[:-1]) | ~ok[:-1]
    new[batch.bounds[have]] = True
    at = np.flatnonzero(new & ok)
    stop = np.flatnonzero(new | ~ok)  # a run ends where another starts or no window is
    after = np.append(stop, n)[np.searchsorted(stop, at, "right")]
    doc = np.searchsorted(batch.bounds, at, "right") - 1
    return doc, at, after - at, key[at].view(np.int64)


def removals(
    docs: DataFrame,
    length: int,
    gram: int,
    batch: Callable[[list[int], list[int], list[bytes]], Batch],
    piece: Callable[[object, int, int], bytes],
    decide: Callable[[tuple], tuple[np.ndarray, np.ndarray, np.ndarray]],
    least_id: bool,
    between: bytes = b"",
    alone: Callable[[bytes, int], bool] = lambda text, windows: True,
) -> DataFrame:
    """Spans to remove from docs, as (id, th, lo, hi), in units; they may overlap.

    docs: from keyed(). batch() makes units and gram hashes of some documents, piece() cuts the
    text of units [lo, hi), decide() finds in a block of pieces (every window of a minimiser
    together) the windows to remove and returns piece index, first window and windows of runs.
    between stands between the pieces of a block. A bucket that holds a single piece needs no
    sorting if alone(text, windows) says that no two of its own windows can be equal.
    least_id: a window is removed only if a smaller id has it; else if it is anywhere else.
    Of copies of a piece in a task only one (least_id: one of the least id) is sent, marked.
    """
    spark = docs.sparkSession
    buckets = 4 * partitions(spark)
    share = 1 / (2 * buckets)

    def minimisers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Frequent(share)
        for some in documents(batches, STEP):
            seen.add(runs(batch(*some), length, gram)[3])
        yield seen.batch()
        Fingerprints.forget()

    hot = heavy_keys(cut(docs.mapInArrow(tidy(minimisers), HEAVY_SCHEMA)), share)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Pieces] = {}
        seen: dict[bytes, tuple[Pieces, int]] = {}
        size, spans = 0, []

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal size
            keys, blobs = list(held), [p.packed() for p in held.values()]
            if spans:  # decided here; they only pass through the shuffle, by their documents
                found = merged(np.array(spans, np.int64))
                to = found[:, 1] % buckets
                for k in np.unique(to):
                    keys.append(int(k))
                    blobs.append(zstandard.ZstdCompressor(level=1).compress(pickle.dumps((None, found[to == k]), 5)))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "blob"])
            held.clear()
            seen.clear()
            spans.clear()
            size = 0

        def send(text: bytes, key: int, bucket: int, i: int, th: int, start: int, n: int) -> None:
            nonlocal size
            if old := seen.get(text):
                p, k = old
                if not least_id:
                    p.twice[k] = True
                    spans.append((i, th, start, start + n - 1 + length))
                    size += SPAN
                    return
                if i != p.ids[k]:
                    if i < p.ids[k]:
                        p.ids[k], i, p.ths[k], th, p.starts[k], start = i, p.ids[k], th, p.ths[k], start, p.starts[k]
                    spans.append((i, th, start, start + n - 1 + length))
                    size += SPAN
                    return
            p = held.setdefault(bucket, Pieces())
            seen[text] = p, len(p.texts)
            for values, value in zip((p.texts, p.keys, p.ids, p.ths, p.starts, p.windows, p.twice), (text, key, i, th, start, n, False)):
                values.append(value)
            size += len(text) + PIECE

        for some in documents(batches, STEP):
            b = batch(*some)
            doc, at, n, key = runs(b, length, gram)
            single = np.isin(key, hot)
            offset = b.bounds[doc]
            ids, ths = b.ids[doc].tolist(), b.ths[doc].tolist()
            bucket = (key.view(np.uint64) % np.uint64(1_000_003) % np.uint64(buckets)).tolist()
            for i, th, a, m, k, to, start, alone in zip(ids, ths, at.tolist(), n.tolist(), key.tolist(), bucket, (at - offset).tolist(), single.tolist()):
                if not alone:
                    send(piece(b.units, a, a + m - 1 + length), k, to, i, th, start, m)
                    continue
                for j in range(m):
                    text = piece(b.units, a + j, a + j + length)
                    k = xxhash.xxh3_64_intdigest(text)
                    send(text, k - (1 << 63), k % buckets, i, th, start + j, 1)
            if size >= HELD:
                yield from flush()
        yield from flush()
        Fingerprints.forget()

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for blobs in by_bucket(batches):
            parts, done = [], []
            for blob in blobs:
                x = unpacked(blob)
                (done if x[0] is None else parts).append(x)
            out = [x[1] for x in done]
            for block in blocks(parts, between, alone):
                p, first, n = decide(block)
                start = block[5][p] + first
                out.append(np.column_stack([block[3][p], block[4][p], start, start + n - 1 + length]))
            if sum(map(len, out)):
                rows = merged(np.concatenate(out))
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in rows.T], names=["id", "th", "lo", "hi"])
        Fingerprints.forget()

    dealt = docs.mapInArrow(tidy(deal), "bucket int, blob binary").repartition(partitions(spark), "bucket").sortWithinPartitions("bucket")
    found = cut(dealt.mapInArrow(tidy(settle), "id long, th long, lo long, hi long"))
    return found


def merged(spans: np.ndarray) -> np.ndarray:
    """Rows (id, th, lo, hi) with the spans of a document that overlap or touch made one.

    Ordered by document and first unit, and the ends by document and end: a span starts anew
    where as many spans of its document have ended before it as have started.
    """
    by_start = spans[np.lexsort([spans[:, 2], spans[:, 1], spans[:, 0]])]
    ends = spans[np.lexsort([spans[:, 3], spans[:, 1], spans[:, 0]]), 3]
    fresh = np.append(True, (by_start[1:, :2] != by_start[:-1, :2]).any(1) | (by_start[1:, 2] > ends[:-1]))
    first = np.flatnonzero(fresh[: len(spans)])
    out = by_start[first]
    out[:, 3] = ends[np.append(first[1:], len(spans)) - 1] if len(first) else out[:, 3]
    return out


def by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[list[bytes]]:
    now, blobs = None, []
    for b in batches:
        for bucket, blob in zip(b.column(0).to_pylist(), b.column(1)):
            if bucket != now and blobs:
                yield blobs
                blobs = []
            now = bucket
            blobs.append(blob.as_py())
    if blobs:
        yield blobs


def blocks(parts: list[tuple], between: bytes, alone: Callable[[bytes, int], bool]) -> Iterator[tuple]:
    """(bytes, piece offsets, keys, ids, ths, starts, windows, twice) of about STEP bytes, all pieces of a key together.

    Without the pieces that have a key for themselves and, alone() says, no equal windows.
    """
    if not parts:
        return
    keys = np.concatenate([x[2] for x in parts])
    order = np.argsort(keys, kind="stable")
    which = np.repeat(np.arange(len(parts)), [len(x[1]) for x in parts])
    offsets = [np.append(0, np.cumsum(x[1], dtype=np.int64)) for x in parts]
    where = np.concatenate([np.arange(len(x[1])) for x in parts])
    columns = [np.concatenate([x[k] for x in parts]) for k in range(1, 8)]
    fresh = np.append(True, keys[order][1:] != keys[order][:-1])
    single = order[(fresh & np.append(fresh[1:], True)) & ~columns[6][order]]
    idle = np.zeros(len(order), bool)
    idle[single] = [alone(parts[w][0][offsets[w][i] : offsets[w][i + 1]], n) for w, i, n in zip(which[single].tolist(), where[single].tolist(), columns[5][single].tolist())]
    order = order[~idle[order]]
    if not len(order):
        return
    fresh = np.append(True, keys[order][1:] != keys[order][:-1])
    size = np.cumsum(columns[0][order], dtype=np.int64)
    a = 0
    while a < len(order):
        b = int(np.searchsorted(size, (size[a - 1] if a else 0) + STEP, "right"))
        b = max(b, a + 1)
        while b < len(order) and not fresh[b]:
            b += 1
        own = order[a:b]
        text = between.join([parts[w][0][offsets[w][i] : offsets[w][i + 1]] for w, i in zip(which[own].tolist(), where[own].tolist())])
        lengths, *rest = (c[own] for c in columns)
        yield text, np.append(0, np.cumsum(lengths + len(between), dtype=np.int64)), *rest
        a = b


def window_starts(offsets: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every window of every piece: its piece, its number there, and offset of the piece plus that."""
    piece = np.repeat(np.arange(len(windows)), windows)
    number = np.arange(len(piece)) - np.repeat(np.cumsum(windows, dtype=np.int64) - windows, windows)
    return piece, number, offsets[piece] + number


def as_runs(piece: np.ndarray, number: np.ndarray, bad: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of consecutive marked windows in a piece: piece, first, how many."""
    if not len(piece):
        return piece, number, number
    start = np.append(True, (piece[1:] != piece[:-1]) | ~bad[:-1]) | ~bad
    at = np.flatnonzero(start)
    n = np.add.reduceat(bad.astype(np.int64), at)
    marked = bad[at]
    return piece[at[marked]], number[at[marked]], n[marked]


def spans_of(found: DataFrame) -> DataFrame:
    """One row per document with spans: (id, th, lows, highs)."""
    return found.groupBy("id", "th").agg(F.collect_list(F.struct("lo", "hi")).alias("spans")).select("id", "th", F.col("spans.lo").alias("lows"), F.col("spans.hi").alias("highs"))


def covered(n: int, lows: list[int] | None, highs: list[int] | None) -> np.ndarray | None:
    """Which of n units the spans cover; None if there are no spans."""
    if not lows:
        return None
    change = np.zeros(n + 1, np.int32)
    np.add.at(change, np.asarray(lows), 1)
    np.add.at(change, np.asarray(highs), -1)
    return np.cumsum(change[:-1]) > 0
