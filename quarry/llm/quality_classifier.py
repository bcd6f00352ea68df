"""Quality classifier by co-training of a text view and a page-metadata view.

Each view has its own naive Bayes model, whose counts add up over tasks: hashed words and shares of
odd characters, lines and repeats for the text; source, language and length for the metadata. In
each round both models, calibrated on labelled documents that neither is fitted on, score all
unlabelled documents; those that one is sure of count, with its labels, for the other. How sure it
must be is set on the calibrating documents too: a view that is not right often gives nothing. In the end a
logistic combination of the calibrated views scores every document.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import column, cut, tidy
from quarry.llm.toxicity import SAMPLE, held_out, logistic

#: Rounds of exchange, and the share of right labels from which on a view gives them.
ROUNDS, SURE = 3, 0.95
#: Bits for hashed words, and cells for hashed sources and languages (and one more for null).
BITS, SOURCES, LANGS = 2048, 64, 16
#: Shares of all documents between which a number is cut into cells.
CUTS = (0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.98, 0.99, 0.995)
#: Numbers of the text view; one more, the length, is of the other view.
N_SURFACE = 11
#: Documents' worth of the pooled distribution that is added to each class.
PRIOR = 4.0
#: Ridge of the calibrations, which weigh a view's features; few rows leave the weights near those of naive Bayes.
RIDGE = 0.005


def surface(text: str, words: list[str]) -> list[float]:
    """What a text looks like, in numbers that don't grow with its length."""
    n, size = max(1, len(words)), max(1, len(text))
    lines = [x for x in text.split("\n") if x.strip()]
    m = max(1, len(lines))
    often = Counter(words).most_common(1)[0][1] if words else 0
    grams = len(set(zip(words, words[1:], words[2:])))
    return [
        sum(map(len, words)) / n, sum(text.count(c) for c in "#*$%&|<>") / size, 1 - grams / max(1, n - 2), 1 - len(set(lines)) / m, often / n,
        sum(map(text.count, "ABCDEFGHIJKLMNOPQRSTUVWXYZ")) / size, sum(map(text.count, "0123456789")) / size, text.count("!") / size,
        (text.count(".") + text.count(",")) / size, size / m, text.count("://") / n,
    ]


class View:
    """Naive Bayes over features with cells (one per row and feature) and over bits."""

    def __init__(self, cells: list[int], bits: int):
        self.start = np.append(0, np.cumsum(cells))
        self.cells, self.bits = int(self.start[-1]), bits
        self.size = 2 * (1 + self.cells + bits)

    def counts(self, cells: np.ndarray, bits: np.ndarray | None, label: np.ndarray) -> np.ndarray:
        """Numbers of rows with label 0 and 1, for each cell and bit; other labels don't count."""
        out = np.zeros((2, self.size // 2))
        for y in (0, 1):
            own = label == y
            out[y, 0] = own.sum()
            out[y, 1 : 1 + self.cells] = np.bincount((cells[own] + self.start[:-1]).ravel(), minlength=self.cells)
            if self.bits:
                out[y, 1 + self.cells :] = bits[own].sum(0, dtype=np.int64)
        return out.ravel()

    def model(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log odds of each cell, and of each bit among all bits that are set.

        Each class is drawn towards both together. Bits count whose shares in the classes differ
        by three standard errors.
        """
        counts = counts.reshape(2, -1)
        n, cells, bits = counts[:, 0], counts[:, 1 : 1 + self.cells], counts[:, 1 + self.cells :]
        both = (cells.sum(0) + 0.1) / (n.sum() + 1)
        p = (cells + PRIOR * both) / (n[:, None] + PRIOR)
        every = bits.sum(1)
        both = (bits.sum(0) + 0.1) / (every.sum() + 1)
        q = (bits + PRIOR * self.bits * both) / (every[:, None] + PRIOR * self.bits)
        error = np.sqrt(both / np.maximum(1.0, every)[:, None]).sum(0)
        word = np.where(np.abs(q[1] - q[0]) > 3 * error, np.log(q[1] / q[0]), 0.0)
        return np.log(p[1] / p[0]), word

    def odds(self, model: tuple[np.ndarray, np.ndarray], cells: np.ndarray, bits: np.ndarray | None) -> np.ndarray:
        """A column of log odds for each feature and, if there are bits, one for the mean of theirs."""
        cell, word = model
        out = cell[cells + self.start[:-1]]
        if self.bits:
            out = np.column_stack([out, 30 * (bits @ word) / np.maximum(1, bits.sum(1, dtype=np.int64))])
        return out / 3


TEXT = View([len(CUTS) + 1] * N_SURFACE, BITS)
META = View([SOURCES + 1, LANGS + 1, len(CUTS) + 2], 0)


def proba(model: np.ndarray, x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ model[:-1] + model[-1], -30, 30)))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-9, 1 - 1e-9)
    return np.log(p / (1 - p))


def sure(p: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Probabilities from which on and up to which a view gives label 1 and label 0; 2 and -1 for never.

    Of the calibrating rows beyond them the share with that label is SURE or more, by the lower
    end of a 95 % interval (Wilson's).
    """
    out = []
    for label, sign in ((1, -1), (0, 1)):
        order = np.argsort(sign * p, kind="stable")
        w = weight[order]
        n, right = np.cumsum(w) * len(w) / w.sum(), np.cumsum(w * (y[order] == label)) / np.cumsum(w)
        z = 1.96
        low = (right + z * z / (2 * n) - z * np.sqrt(right * (1 - right) / n + z * z / (4 * n * n))) / (1 + z * z / n)
        good = np.flatnonzero((low >= SURE) & np.append(np.diff(p[order]) != 0, True))  # equal ones go together
        out.append(float(p[order][good[-1]]) if len(good) else (2.0 if label else -1.0))
    return out[0], out[1]


def exchanged(text: np.ndarray, meta: np.ndarray, free: np.ndarray, limits: list[tuple[float, float]]) -> tuple[np.ndarray, np.ndarray]:
    """Labels for the text and for the metadata model, each from the other's probabilities; -1 for none."""
    give = lambda p, up, down: np.where(free & (p >= up), 1, np.where(free & (p <= down), 0, -1))
    return give(meta, *limits[1]), give(text, *limits[0])


def features(docs: DataFrame, id_col: str, text_col: str, source_col: str, lang_col: str, chars_col: str) -> DataFrame:
    """(doc_id, held_out, key, s, bits, cells): what the views see of each document, some 300 bytes."""

    def cell(value: str | None, n: int) -> int:
        return n if value is None else zlib.crc32(value.encode()) % n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for b in batches:
            s, rows, at, cells = [], [], [], []
            for k, (text, source, lang, chars) in enumerate(zip(b.column("text"), *(b.column(c).to_pylist() for c in ("source", "lang", "n_chars")))):
                text = text.as_py()
                words = text.split()
                if len(known) > 200_000:
                    known.clear()
                for w in set(words):
                    code = known.get(w)
                    if code is None:
                        code = known[w] = zlib.crc32(w.lower().encode()) % BITS
                    at.append(code)
                rows.append(len(at))
                s.append([*surface(text, words), np.nan if chars is None else float(chars)])
                cells.append([cell(source, SOURCES), cell(lang, LANGS)])
            bits = np.zeros((b.num_rows, BITS), bool)
            bits[np.repeat(np.arange(b.num_rows), np.diff([0, *rows])), at] = True
            packed = [row.tobytes() for row in np.packbits(bits, axis=1)]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in ("doc_id", "held_out", "key")), pa.array(s, pa.list_(pa.float64())), pa.array(packed, pa.binary()), pa.array(cells, pa.list_(pa.int32()))],
                names=["doc_id", "held_out", "key", "s", "bits", "cells"],
            )

    text = F.coalesce(column(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        column(id_col).cast("long").alias("doc_id"), text.alias("text"), column(source_col).cast("string").alias("source"),
        column(lang_col).cast("string").alias("lang"), column(chars_col).cast("long").alias("n_chars"),
    )
    # rows without an id meet no label: their hash deals them out
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("no id "), F.xxhash64("text").cast("string")))
    rows = rows.withColumns({"held_out": F.coalesce(held_out(), F.lit(False)), "key": key})
    return rows.mapInArrow(tidy(run), "doc_id long, held_out boolean, key string, s array<double>, bits binary, cells array<int>")


def _cells(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    return np.where(np.isnan(values), len(edges) + 1, np.searchsorted(edges, np.nan_to_num(values), "right"))


def views(s: list, bits: list[bytes], cells: list, edges: list[np.ndarray]) -> tuple[tuple, tuple]:
    """Cells and bits of some documents for the text view and for the metadata view."""
    x = np.array(s, np.float64).reshape(-1, N_SURFACE + 1)
    binned = np.column_stack([_cells(x[:, k], edges[k]) for k in range(N_SURFACE + 1)]).astype(np.int64)
    unpacked = np.unpackbits(np.frombuffer(b"".join(bits), np.uint8).reshape(-1, BITS // 8), axis=1)
    return (binned[:, :-1], unpacked), (np.column_stack([np.array(cells, np.int64).reshape(-1, 2), binned[:, -1]]), None)


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", chars_col: str = "n_chars", threshold: float = 0.5, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, held_out, text_score, meta_score, score, kept) for each document.

    labels (doc_id, quality 0 or 1) outside the fold crc32(doc_id) mod 4 = 2 are learnt from;
    a third of them calibrates, at most toxicity.SAMPLE of each class. Labels are exchanged over
    all unlabelled documents outside the fold. kept: score at least `threshold`. A null text
    counts as empty; null metadata are values of their own; a null id is never learnt from.
    Where either third or the rest lacks a class, all labelled documents fit and calibrate. With
    one class of labels every score is that class's, without labels it is 1. Repeated rows each
    give a row; of repeated labels the greatest counts. Other columns are ignored.
    """
    good = labels.where("doc_id is not null and quality in (0, 1)").where(~held_out()).groupBy("doc_id").agg(F.max("quality").cast("int").alias("y"))
    marks = good.select(F.col("doc_id").cast("long").cast("string").alias("key"), "y", (F.crc32(F.concat(F.lit("calibrate"), F.col("doc_id").cast("string")).cast("binary")) % 3 == 0).alias("calibrates"))
    rows = cut(features(docs, id_col, text_col, source_col, lang_col, chars_col).join(marks, "key", "left").drop("key"))
    shares = rows.agg(*[F.percentile_approx(F.when(~F.isnan(F.col("s")[k]), F.col("s")[k]), list(CUTS), 2000).alias(f"e{k}") for k in range(N_SURFACE + 1)]).first()
    edges = [np.unique(e) if e else np.empty(0) for e in shares]
    number = {(r.y, r.calibrates): r.n for r in rows.where("y is not null").groupBy("y", "calibrates").agg(F.count("*").alias("n")).collect()}
    classes = {y for y, _ in number}
    split = all((y, c) in number for y in (0, 1) for c in (True, False))

    if len(classes) == 2:
        calibrating = rows.where("y is not null" + (" and calibrates" if split else "")).select("doc_id", "y", "s", "bits", "cells")
        some = [calibrating.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id", "bits").limit(SAMPLE) for y in (0, 1)]
        held = some[0].unionByName(some[1]).collect()  # at most SAMPLE of each class
        y = np.array([r.y for r in held])
        text, meta = views([r.s for r in held], [r.bits for r in held], [r.cells for r in held], edges)
        # the classes are sampled to equal bounds; weights restore their shares of the labels
        total = [sum(n for (c, _), n in number.items() if c == k) for k in (0, 1)]
        weight = np.where(y == 1, total[1] / (y == 1).sum(), total[0] / (y == 0).sum())
        weight = weight / weight.mean()

        def fitted(counts: np.ndarray) -> tuple:
            """Models of both views, their calibrations, and where they are sure."""
            models = TEXT.model(counts[: TEXT.size]), META.model(counts[TEXT.size :])
            raw = TEXT.odds(models[0], *text), META.odds(models[1], *meta)
            scale = [logistic(r, y, weight, RIDGE, least=2.0, prior=1.0) for r in raw]
            return models, scale, [sure(proba(s, r), y, weight) for s, r in zip(scale, raw)]

        state = fitted(_tally(rows, edges, None, split))
        for _ in range(rounds):
            state = fitted(_tally(rows, edges, state, split))
        final = logistic(np.column_stack([_logit(p) for p in _probabilities(state, text, meta)]), y, weight, least=2.0, prior=0.5)
    else:
        state, final = None, np.array([0.0, 0.0, -30.0 if classes == {0} else 30.0])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t, m = views(*(b.column(c).to_pylist() for c in ("s", "bits", "cells")), edges)
            each = _probabilities(state, t, m) if state else [np.full(b.num_rows, 0.5)] * 2
            score = proba(final, np.column_stack([_logit(p) for p in each]))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), *map(pa.array, (*each, score, score >= threshold))], names=["doc_id", "held_out", "text_score", "meta_score", "score", "kept"])

    source = rows.select("doc_id", "held_out", "s", "bits", "cells")
    return source.mapInArrow(tidy(scored), "doc_id long, held_out boolean, text_score double, meta_score double, score double, kept boolean")


def _probabilities(state: tuple, text: tuple, meta: tuple) -> list[np.ndarray]:
    """Calibrated probabilities of the text view and of the metadata view."""
    models, scale, _ = state
    raw = TEXT.odds(models[0], *text), META.odds(models[1], *meta)
    return [proba(s, r) for s, r in zip(scale, raw)]


def _tally(rows: DataFrame, edges: list[np.ndarray], state: tuple | None, split: bool) -> np.ndarray:
    """Counts of both views, end to end: labelled documents, and with a state those that it labels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(TEXT.size + META.size)
        for b in batches:
            text, meta = views(*(b.column(c).to_pylist() for c in ("s", "bits", "cells")), edges)
            y = np.array([-1 if x is None else x for x in b.column("y").to_pylist()])
            free = (y < 0) & ~np.array(b.column("held_out").to_pylist(), bool)
            fit = np.where(np.array([bool(c) and split for c in b.column("calibrates").to_pylist()], bool), -1, y)
            given = exchanged(*_probabilities(state, text, meta), free, state[2]) if state else (fit, fit)
            for view, at, own, label in ((TEXT, 0, text, given[0]), (META, TEXT.size, meta, given[1])):
                out[at : at + view.size] += view.counts(*own, np.where(fit >= 0, fit, label))
        some = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(out[some])], names=["place", "n"])

    source = rows.select("held_out", "s", "bits", "cells", "y", "calibrates")
    if state is None:
        source = source.where("y is not null")
    sums = source.mapInArrow(tidy(run), "place int, n double").groupBy("place").agg(F.sum("n").alias("n"))
    out = np.zeros(TEXT.size + META.size)
    for r in sums.collect():  # one row for each feature and class at most
        out[r.place] = r.n
    return out
