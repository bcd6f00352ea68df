"""Best-fit packing of token pieces into sequences, bulk-synchronously.

Lengths and gaps are whole numbers up to the capacity, so documents are range-sorted into runs of
one length, gaps into runs of one size, each a few thousand rows at most however many documents
there are. In a round the tasks sweep ranges of sizes: a run of documents takes the least gaps
that it fits, its successors. Runs that want the same gaps are served by rank, longest documents
first; those that get none go up to the gaps that higher ranges have left. Then gaps shrink, new
sequences are opened for the longest documents if nothing fits these, and the round repeats.
The driver holds the runs between rounds.
Placing the documents by their ranks is distributed too: its tasks get runs, not documents.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import NO_ID, cut, shown_id, tidy

#: Kinds of runs: gaps, documents still open, and documents placed.
GAP, OPEN, PLACED = 0, 1, 2
#: Ranges of sizes that are swept side by side, and documents in a sequence up to which only
#: the longest ones open new sequences.
RANGES, FEW = 8, 8
SCHEMA = pa.schema([("kind", pa.int32()), ("size", pa.int32()), ("first", pa.int64()), ("n", pa.int64()), ("rank", pa.int64()), ("offset", pa.int32())])
RUN = "kind int, size int, first long, n long, rank long, offset int"


def sweep(runs: Iterable[tuple[int, int, int, int, int, int]], capacity: int) -> tuple[list, list, list]:
    """Documents with their places, documents left and gaps left, all of them runs.

    A run is (kind, size, first, n, rank, offset): of gaps, those of the sequences first to
    first + n - 1; of open documents, n from `rank` on; of placed ones, document rank + k is in
    sequence first + k at the offset. From large to small, documents take the gaps that were met last.
    """
    stack, placed, left, gaps = [], [], [], []
    for kind, size, first, n, rank, _ in sorted(runs, key=lambda r: (-r[1], r[0], r[2], r[4])):
        if kind == GAP:
            stack.append((size, first, n))
            continue
        while n and stack:
            gap, at, m = stack.pop()
            fits = gap // size  # what is left of a gap is the least successor again
            full = min(m, n // fits)
            for many, times in ((full, fits), (min(m - full, 1), min(n - full * fits, fits - 1))):
                if not many or not times:
                    continue
                for k in range(times):
                    placed.append((PLACED, size, at, many, rank, capacity - gap + k * size))
                    rank += many
                n -= many * times
                if gap > times * size:
                    gaps.append((GAP, gap - times * size, at, many, 0, 0))
                at, m = at + many, m - many
            if m:
                stack.append((gap, at, m))
        if n:
            left.append((OPEN, size, 0, n, rank, 0))
    return placed, left, gaps + [(GAP, size, at, m, 0, 0) for size, at, m in stack]


def opened(left: list, gaps: list, capacity: int, number: int) -> tuple[list, list, list, int]:
    """New sequences, from `number` on, for the longest documents left if no gap fits any of these.

    Returns placed runs, documents left, new gaps and how many sequences were opened. The longest
    are those of which as few fit a sequence as of the very longest. By rank, so few at a time
    share one: best fit would do the same, as what is left of it fits none of them.
    """
    few = capacity // max(r[1] for r in left)
    longest = [r for r in left if few > FEW or r[1] > capacity // (few + 1)]
    if any(g[1] >= min(r[1] for r in longest) for g in gaps):
        return [], left, [], 0
    if few > FEW:
        n = max(1, sum(r[1] * r[3] for r in longest) // capacity)
        return [], left, [(GAP, capacity, number, n, 0, 0)], n
    placed, fresh = [], []
    at, held, fill = number, 0, 0  # the sequence that isn't full yet, its documents and tokens
    for _, length, _, n, rank, _ in sorted(longest, key=lambda r: -r[1]):
        while n:
            many, times = (1, 1) if held or n < few else (n // few, few)
            for k in range(times):
                placed.append((PLACED, length, at, many, rank, fill + k * length))
                rank += many
            n -= many * times
            held, fill = held + times, fill + times * length
            if held == few:
                if fill < capacity:
                    fresh.append((GAP, capacity - fill, at, many, 0, 0))
                at, held, fill = at + many, 0, 0
    if held:
        fresh.append((GAP, capacity - fill, at, 1, 0, 0))
        at += 1
    return placed, [r for r in left if few <= FEW and r[1] <= capacity // (few + 1)], fresh, at - number


def placed_runs(spark: SparkSession, counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """The PLACED runs of counts[length] documents of each length, by rounds of sweeps in tasks."""

    def table(rows: list) -> pa.Table:
        columns = list(zip(*rows)) or [()] * len(SCHEMA)
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, SCHEMA)], SCHEMA)

    def matched(rows: pa.Table) -> pa.Table:
        """The documents of a range take its gaps."""
        runs = list(zip(*(c.to_pylist() for c in rows.select(SCHEMA.names).columns)))
        found = sweep((r for r in runs if r[0] != PLACED), capacity)
        return table([r for r in runs if r[0] == PLACED] + [r for part in found for r in part])

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What the ranges left meets: documents take gaps of higher ranges."""
        yield from matched(pa.Table.from_batches(batches, SCHEMA)).to_batches()

    def ranged(runs: list) -> pa.Table:
        """The runs with the number of their range: as many sizes are in each."""
        sizes = sorted({r[1] for r in runs})
        part = {size: k * RANGES // len(sizes) for k, size in enumerate(sizes)}
        return table(runs).append_column("part", pa.array([part[r[1]] for r in runs], pa.int32()))

    done, number, gaps = [], 0, []
    left = [(OPEN, length, 0, n, 0, 0) for length, n in sorted(counts.items())]
    while left:
        placed, left, fresh, n = opened(left, gaps, capacity, number)
        done, number = done + placed, number + n
        rows = []
        if left:
            swept = spark.createDataFrame(ranged(left + gaps + fresh)).groupBy("part").applyInArrow(matched, RUN)
            rows = [tuple(r) for r in swept.repartition(1).mapInArrow(across, RUN).collect()]
        left, gaps, placed = ([r for r in rows if r[0] == kind] for kind in (OPEN, GAP, PLACED))
        done += placed
    return done


class _Encoder:
    """ids of whole texts by the byte-level BPE of a tokenizer file.

    A faster reader of the same vocabulary does texts without special tokens and without very
    long runs (its pattern can't take a million blanks), if ids are in the order of merges and
    the file splits texts by the usual pattern. All others go through the tokenizer itself.
    """

    RUNS = re.compile(r"\s{256}|\S{4096}")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(Path(path).read_text())
        pre, model = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
        added = [t["content"] for t in spec.get("added_tokens", [])]
        self.special = re.compile("|".join(map(re.escape, added))) if added else None
        usual = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec.get("normalizer") and model.get("type") == "BPE"
        self.fast = self._by_ranks(model, added) if usual else self._plain

    def _plain(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _by_ranks(self, model: dict, added: list[str]):
        import tiktoken

        whole = [m if isinstance(m, str) else " ".join(m) for m in model["merges"]]
        made = [model["vocab"][m.replace(" ", "")] for m in whole]
        if made != sorted(made) or model.get("ignore_merges") or model.get("dropout"):
            return self._plain
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
        ranks = {bytes(byte[c] for c in t): i for t, i in model["vocab"].items() if t not in added}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def __call__(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        odd = self.RUNS.search(text) or (self.special and self.special.search(text))
        return np.array((self._plain if odd else self.fast)(text), "<u4").tobytes()


_encoders: dict[str, _Encoder] = {}


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """(id, piece, start, length, ids_crc32): documents over the capacity are cut, the first piece is the short one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _encoders:
            _encoders[tokenizer] = _Encoder(tokenizer)
        encode, end = _encoders[tokenizer], np.array([end_id], "<u4").tobytes()
        for b in batches:
            rows = []
            for i, text in zip(b.column(0).to_pylist(), b.column(1)):
                raw = encode(text.as_py()) + end
                n = len(raw) // 4
                begin = [0, *range((n - 1) % capacity + 1, n, capacity)]
                for k, (lo, hi) in enumerate(zip(begin, [*begin[1:], n])):
                    rows.append((i, k, lo, hi - lo, zlib.crc32(raw[4 * lo : 4 * hi])))
            columns = list(zip(*rows)) or [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["id", "piece", "start", "length", "ids_crc32"])

    source = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)), F.coalesce(F.col(text_col), F.lit("")))
    return source.mapInArrow(tidy(run), "id long, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack documents' tokens into as few sequences of at most `capacity` tokens as best-fit finds.

    Returns per piece (doc_id, piece, start, length, ids_crc32, sequence_id, offset). A document
    is its ids and end_id; a null text counts as empty, so it is the end id alone. A null id
    stays null; repeated rows are different documents. Other columns are ignored.
    """
    # ranks: a piece's number among its length's in its task, after those of earlier tasks
    cutting = cut(pieces(docs, tokenizer, capacity, end_id, id_col, text_col).withColumn("task", F.spark_partition_id()))
    sizes = cutting.groupBy("task", "length").count()
    table = cut(sizes)
    whole = {r["length"]: r["n"] for r in table.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    runs = placed_runs(docs.sparkSession, whole, capacity)
    lengths, first, ranks, offset = (np.array([r[k] for r in runs], np.int64) for k in (1, 2, 4, 5))
    order = np.lexsort([ranks, lengths])
    lengths, first, ranks, offset = lengths[order], first[order], ranks[order], offset[order]
    begins = np.searchsorted(lengths, np.arange(capacity + 2))
    before = F.sum("count").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    base = table.select("task", F.col("length").alias("size"), F.coalesce(before, F.lit(0)).alias("base"))

    def place(rows: pa.Table, bases: pa.Table) -> pa.Table:
        """The pieces that one task cut, with their places."""
        length = rows.column("length").to_numpy()
        upto = np.zeros(capacity + 1, np.int64)
        upto[bases.column("size").to_numpy()] = bases.column("base").to_numpy()
        by = np.argsort(length, kind="stable")
        s = length[by]
        start = np.flatnonzero(np.append(True, s[1:] != s[:-1])) if len(s) else np.empty(0, np.int64)
        n = np.diff(np.append(start, len(s)))
        rank = upto[s] + np.arange(len(s)) - np.repeat(start, n)
        at = np.empty(len(s), np.int64)
        for a, m in zip(start.tolist(), n.tolist()):  # the run that holds each rank
            x = s[a]
            at[a : a + m] = begins[x] + np.searchsorted(ranks[begins[x] : begins[x + 1]], rank[a : a + m], "right") - 1
        kept = rows.select(["id", "piece", "start", "length", "ids_crc32"]).take(pa.array(by))
        return kept.append_column("sequence_id", pa.array(first[at] + rank - ranks[at], pa.int64())).append_column("offset", pa.array(offset[at], pa.int64()))

    schema = "id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    placed = cutting.groupBy("task").cogroup(base.groupBy("task")).applyInArrow(place, schema)
    return placed.select(shown_id().alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
