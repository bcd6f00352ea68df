"""SimHash near-dedup with deletion-variant signatures.

64-bit fingerprints that differ at no more than three bits are cut into two segments of 32; one
of the segments then differs at no more than one bit. Each segment is indexed 32 times, with
each of its bits made a wildcard in turn, so such fingerprints share an index key. An equality
join on the key finds candidates, which are verified.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import HEAVY_SCHEMA, NO_ID, Frequent, column, components, cut, follow, forest, heavy_keys, keyed, own_names, partitions, shown_id, tidy
from quarry.llm.windows import K2, mixed

SEED = 42


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """SimHash over the word shingles of a text, A-Z lower-cased; a bit is set by over half of them."""
    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle:
        h = np.array([xxhash.xxh64_intdigest(line, SEED)], np.uint64)
    else:
        begin = [0, *accumulate(len(w) + 1 for w in words)]
        digest = xxhash.xxh64_intdigest
        h = np.fromiter((digest(line[a : b - 1], SEED) for a, b in zip(begin, begin[shingle:])), np.uint64, len(words) - shingle + 1)
    ones = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, th, fp) for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(x.as_py()) for x in b.column(2)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp.view(np.int64))], names=["id", "th", "fp"])

    return keyed(docs, id_col, text_col).mapInArrow(tidy(run), "id long, th long, fp long")


def variants(fp: np.ndarray) -> np.ndarray:
    """(n, 64) keys: segment and wildcard in the upper half, the segment without that bit below."""
    segments = np.stack([fp & np.uint64(0xFFFFFFFF), fp >> np.uint64(32)], 1)[:, :, None]
    bits = np.arange(32, dtype=np.uint64)
    number = np.arange(2, dtype=np.uint64)[None, :, None] * np.uint64(32) + bits
    return ((number << np.uint64(32)) | (segments & ~(np.uint64(1) << bits))).reshape(-1, 64)


def second_variants(key: np.ndarray, fp: np.ndarray) -> np.ndarray:
    """(n, 32) keys within a key that too many share.

    Its fingerprints agree on 31 bits of one segment; the other segment is cut in two again, so
    a half of it differs at no more than one bit. At most 2^18 fingerprints share such a key.
    """
    upper = (key >> np.uint64(37)) & np.uint64(1)
    other = np.where(upper == 1, fp & np.uint64(0xFFFFFFFF), fp >> np.uint64(32))
    halves = np.stack([other & np.uint64(0xFFFF), other >> np.uint64(16)], 1)[:, :, None]
    bits = np.arange(16, dtype=np.uint64)
    number = np.arange(2, dtype=np.uint64)[None, :, None] * np.uint64(16) + bits
    fine = ((number << np.uint64(16)) | (halves & ~(np.uint64(1) << bits))).reshape(-1, 32)
    return mixed(mixed(key)[:, None] + (fine + np.uint64(1)) * K2)


def _masks(varying: int, most: int) -> list[int]:
    bits = [1 << k for k in range(64) if varying >> k & 1]
    return [sum(c) for n in range(1, most + 1) for c in combinations(bits, n)]


def linked(keys: np.ndarray, fp: np.ndarray, most: int) -> np.ndarray:
    """Rows (a, b) of fingerprints of equal key that differ at `most` bits or fewer. keys is sorted.

    Small groups compare members pairwise. A group larger than the number of ways to flip
    `most` of the bits in which it varies looks up each member's flips instead.
    """
    start = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
    n = np.diff(np.append(start, len(keys)))
    found = _Links()
    for s, c in zip(start[n > 600].tolist(), n[n > 600].tolist()):
        own = np.unique(fp[s : s + c])
        varying = int(np.bitwise_or.reduce(own ^ own[0]))
        m = varying.bit_count()
        if sum(comb(m, k) for k in range(1, most + 1)) * 8 < len(own):
            for mask in _masks(varying, most):
                to = own ^ np.uint64(mask)
                at = np.minimum(np.searchsorted(own, to), len(own) - 1)
                hit = (own[at] == to) & (own < to)
                found.add(own[hit], to[hit])
        else:
            for k in range(1, len(own)):
                hit = np.bitwise_count(own[k:] ^ own[:-k]) <= most
                found.add(own[k:][hit], own[:-k][hit])
    start, n = start[n <= 600], n[n <= 600]
    step = 1
    while len(start := start[n > step]):
        n = n[n > step]
        reach = n - step
        a = np.repeat(start, reach) + np.arange(reach.sum()) - np.repeat(np.cumsum(reach) - reach, reach)
        hit = np.bitwise_count(fp[a] ^ fp[a + step]) <= most
        found.add(fp[a[hit]], fp[a[hit] + step])
        step += 1
    return found.pairs().view(np.uint64)


class _Links:
    """Pairs of linked fingerprints; once there are many, a forest that connects the same ones."""

    MOST = 1_000_000

    def __init__(self) -> None:
        self.held: list[np.ndarray] = []
        self.size = self.after = 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        if not len(a):
            return
        self.held.append(np.column_stack([a, b]).view(np.int64))
        self.size += len(a)
        if self.size > self.after + self.MOST:
            self.held = [forest(self.pairs())]
            self.size = self.after = len(self.held[0])

    def pairs(self) -> np.ndarray:
        return np.concatenate(self.held) if self.held else np.empty((0, 2), np.int64)


def parts(batch: pa.RecordBatch) -> list[np.ndarray]:
    """The fingerprints in the first column, some thousands at a time."""
    return np.array_split(batch.column(0).to_numpy().view(np.uint64), max(1, batch.num_rows // 2000))


def rooted(fps: DataFrame, bits: int = 3) -> DataFrame:
    """(fp, low, root): the least id with each fingerprint, and the fingerprint naming its group. fps: (id, fp), cut."""
    if not 0 <= bits <= 3:
        raise ValueError("two segments with one wildcard find differences of up to three bits")
    reps = cut(fps.groupBy("fp").agg(F.min("id").alias("low")))
    share = 1 / (4 * partitions(fps.sparkSession))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Frequent(share)
        for b in batches:
            for part in parts(b):
                seen.add(variants(part).ravel().view(np.int64))
        yield seen.batch()

    hot = heavy_keys(cut(reps.select("fp").mapInArrow(tidy(counted), HEAVY_SCHEMA)), share).view(np.uint64)

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in parts(b):
                key, fp = variants(part).ravel(), np.repeat(part, 64)
                if len(hot) and (often := np.isin(key, hot)).any():
                    again = second_variants(key[often], fp[often]).ravel()
                    key, fp = np.append(key[~often], again), np.append(fp[~often], np.repeat(fp[often], 32))
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(fp.view(np.int64))], names=["key", "fp"])

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = _Links()
        for keys, fp in whole_keys(batches):
            kept.add(*linked(keys, fp, bits).T)
        tree = forest(kept.pairs())
        yield pa.RecordBatch.from_arrays([pa.array(tree[:, 0]), pa.array(tree[:, 1])], names=["a", "b"])

    keys = reps.select("fp").mapInArrow(tidy(indexed), "key long, fp long").repartition(partitions(fps.sparkSession), "key").sortWithinPartitions("key")
    roots = components(keys.mapInArrow(tidy(verified), "a long, b long"))
    return reps.join(roots, reps.fp == roots.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))


def components_of(fps: DataFrame, bits: int = 3) -> DataFrame:
    """(fp, component): the least id in the group of each fingerprint. fps: (id, fp), cut."""
    own = rooted(fps, bits)
    least = own.groupBy("root").agg(F.min("low").alias("up")).select(F.col("root").alias("node"), "up")
    return follow(cut(own.select("root", "fp")), "root", cut(least)).select("fp", F.col("root").alias("component"))


def whole_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(keys, fps) from batches sorted by key; a key's rows come together."""
    keys, fps = [], []
    for b in batches:
        k, f = b.column(0).to_numpy(), b.column(1).to_numpy()
        keys.append(k)
        fps.append(f)
        if sum(map(len, keys)) < 200_000 or k[0] == k[-1]:
            continue
        last = int(np.searchsorted(k, k[-1], "left"))
        yield np.concatenate([*keys[:-1], k[:last]]).view(np.uint64), np.concatenate([*fps[:-1], f[:last]]).view(np.uint64)
        keys, fps = [k[last:]], [f[last:]]
    if keys:
        yield np.concatenate(keys).view(np.uint64), np.concatenate(fps).view(np.uint64)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id, th): each document's group of near copies.

    Fingerprints link at `bits` or fewer differing bits; component_id is the least doc_id
    reachable by links. Null and empty texts have fingerprint zero and link like any other. A
    null id counts as the largest; a group of null ids only has a null component_id. Repeated
    rows each give a row. th is a hash of the text. Other columns are ignored.
    """
    fps = cut(fingerprints(docs, id_col, text_col))
    groups = components_of(fps.select("id", "fp"), bits)
    rows = follow(fps.select("fp", "id", "th", F.col("fp").alias("own")), "fp", cut(groups.select(F.col("fp").alias("node"), F.col("component").alias("up"))))
    return rows.select(shown_id().alias("doc_id"), F.lower(F.lpad(F.hex("own"), 16, "0")).alias("fingerprint"), shown_id("fp").alias("component_id"), "th")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 3) -> DataFrame:
    """The documents with one of each group of near copies: the first by id and text hash.

    Groups are told apart by their fingerprints, so ids may be null (they sort last) or repeat.
    Of equal rows any one stays. All columns of docs are kept.
    """
    fps = cut(fingerprints(docs, id_col, text_col))
    groups = cut(rooted(fps.select("id", "fp"), bits).select(F.col("fp").alias("node"), F.col("root").alias("up")))
    first = follow(fps, "fp", groups).groupBy("fp").agg(F.min(F.struct("id", "th")).alias("first"))
    a, b, c, d = own_names(docs, "own_id", "own_th", "kept_id", "kept_th")
    kept = first.select(F.col("first.id").alias(c), F.col("first.th").alias(d))
    rows = docs.withColumns({a: F.coalesce(column(id_col).cast("long"), F.lit(NO_ID)), b: F.xxhash64(F.coalesce(column(text_col), F.lit("")))})
    both = rows.join(kept, (F.col(a) == F.col(c)) & (F.col(b) == F.col(d)), "left_semi")
    return both.dropDuplicates([a, b]).select(*map(column, docs.columns))
