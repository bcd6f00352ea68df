"""Toxicity scores: misspelled lexicon terms found by an automaton, weighed by their context.

The lexicon is learnt: words that are far more frequent in labelled toxic documents. A
Levenshtein automaton is intersected with the lexicon's trie and made deterministic as words
are read, so a word costs one table look-up a letter and most leave after two. What stands in a
window around a match tells abuse (address in the second person) from quotation (quotation
marks, words of speech). A logistic model of these counts gives the score.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed words of speech and of address, and quotation marks.
SPEECH = frozenset("said says say saying called calls call word words term quote quoted quotes wrote writes insult insults slur claimed claims".split())
ADDRESS = frozenset("you your you're youre u ur yourself du dich dir ihr tu te toi vous usted ustedes".split())
MARKS = "\"'“”‘’«»„"
LOOK_ALIKE = str.maketrans("013457@$", "oieastas")
EDGE = string.punctuation + MARKS
#: Terms are learnt from runs of letters and apostrophes, and looked up in those of a word too.
LETTERS = re.compile(r"(?:[^\W\d_]|')+")
WINDOW = 6
#: Most labelled rows of each class that the model is fitted on.
SAMPLE = 6000


class LexiconAutomaton:
    """Deterministic automaton of all words within the allowed edits of a term, built as needed.

    A state is a set of (trie node, edits left). Terms under five letters must match exactly,
    others may differ by one insertion, deletion or substitution.
    """

    def __init__(self, terms: list[str], edits: int = 1):
        self.edits = edits
        self.kids: list[dict[str, int]] = [{}]
        self.term: list[int] = [-1]
        self.terms = terms
        for t, term in enumerate(terms):
            node = 0
            for c in term:
                if c not in self.kids[node]:
                    self.kids[node][c] = len(self.kids)
                    self.kids.append({})
                    self.term.append(-1)
                node = self.kids[node][c]
            self.term[node] = t
        self.letters = {c for k in self.kids for c in k}
        self.numbers: dict[frozenset, int] = {}
        self.states: list[frozenset] = []
        self.accepts: list[tuple[int, int] | None] = []
        self.moves: list[dict[str, int]] = []
        self.start = self._number(self._closed({0: edits}))

    def _closed(self, best: dict[int, int]) -> frozenset:
        """With the nodes that letters left out lead to; of a node only the most edits left count."""
        todo = list(best)
        while todo:
            node = todo.pop()
            left = best[node]
            for kid in self.kids[node].values() if left else ():
                if best.get(kid, -1) < left - 1:
                    best[kid] = left - 1
                    todo.append(kid)
        return frozenset(best.items())

    def _number(self, state: frozenset) -> int:
        if not state:
            return -1
        if state not in self.numbers:
            self.numbers[state] = len(self.states)
            self.states.append(state)
            self.moves.append({})
            ends = [(self.edits - left, self.term[n]) for n, left in state if self.term[n] >= 0 and (left == self.edits or len(self.terms[self.term[n]]) >= 5)]
            self.accepts.append(min(ends)[::-1] if ends else None)
        return self.numbers[state]

    def _move(self, state: int, c: str) -> int:
        best: dict[int, int] = {}
        for node, left in self.states[state]:
            kid = self.kids[node].get(c)
            options = [(kid, left)] if kid is not None else []
            if left:
                options += [(k, left - 1) for k in self.kids[node].values()] + [(node, left - 1)]
            for n, e in options:
                if best.get(n, -1) < e:
                    best[n] = e
        return self._number(self._closed(best))

    def match(self, word: str) -> tuple[int, int] | None:
        """(term, edits) of the nearest term, or None."""
        state, moves, letters = self.start, self.moves, self.letters
        for c in word:
            if c not in letters:
                c = ""
            nxt = moves[state].get(c)
            if nxt is None:
                nxt = moves[state][c] = self._move(state, c)
            if nxt < 0:
                return None
            state = nxt
        return self.accepts[state]


class _Matches(dict):
    """The match of each word as it stands in a text; emptied when it has grown large."""

    def __init__(self, automaton: LexiconAutomaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: str):
        if len(self) > 400_000:
            self.clear()
        bare = word.strip(EDGE).lower()
        m = self.automaton.match(bare)
        if m is None and not bare.isalpha():
            m = self.automaton.match(bare.translate(LOOK_ALIKE))
            if m is None:  # terms joined to other words or to markup
                near = [x for run in LETTERS.findall(bare) if len(run) >= 3 and (x := self.automaton.match(run))]
                m = min(near, key=lambda x: x[1]) if near else None
        if len(word) <= 256:
            self[word] = m
        return m


N_FEATURES = 12


def features(text: str, matches: _Matches, weights: list[float]) -> np.ndarray:
    words = text.split()
    hits = [(i, m) for i, w in enumerate(words) if (m := matches[w])]
    out = np.zeros(N_FEATURES)
    out[0] = np.log1p(len(words))
    if not hits:
        return out
    exact = [(i, t) for i, (t, e) in hits if e == 0]
    strong = total = quoted = spoken = addressed = 0.0
    for i, (t, e) in hits:
        near = words[max(0, i - WINDOW) : i + WINDOW + 1]
        w = weights[t] * (1 if e == 0 else 0.5)
        total += w
        strong = max(strong, w)
        quoted += words[i][0] in MARKS or words[i][-1] in MARKS or sum(x[0] in MARKS for x in words[max(0, i - WINDOW) : i]) > sum(x[-1] in MARKS for x in words[max(0, i - WINDOW) : i])
        bare = {x.strip(EDGE).lower() for x in near}
        spoken += not bare.isdisjoint(SPEECH)
        addressed += not bare.isdisjoint(ADDRESS)
    n = len(hits)
    out[1:] = (bool(exact), np.log1p(len(exact)), n > len(exact), np.log1p(n - len(exact)), strong, np.log1p(total), 30 * len(exact) / (len(words) + 30), len({t for _, t in exact}), quoted / n, spoken / n, addressed / n)
    return out


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1e-3, rounds: int = 60, least: float = 0.0, prior: float = 0.0) -> np.ndarray:
    """Ridge logistic regression by Newton steps, shortened until the loss falls; the last coefficient is the intercept.

    The ridge, of at least `least`, draws the other coefficients to `prior`.
    """
    x = np.column_stack([x, np.ones(len(x))])
    weight = np.ones(len(x)) if weight is None else weight
    b = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], max(least, ridge * max(1.0, weight.sum())))
    penalty[-1] = 1e-6
    middle = np.append(np.full(x.shape[1] - 1, prior), 0.0)

    def loss(b: np.ndarray) -> float:
        z = x @ b
        return float((weight * (np.logaddexp(0, z) - y * z)).sum() + (penalty * (b - middle) ** 2).sum() / 2)

    now = loss(b)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        grad = x.T @ (weight * (p - y)) + penalty * (b - middle)
        step = np.linalg.solve((x.T * (weight * p * (1 - p) + 1e-9)) @ x + np.diag(penalty), grad)
        while (new := loss(b - step)) > now and np.abs(step).max() > 1e-8:
            step /= 2
        b, now = b - step, min(new, now)
        if np.abs(step).max() < 1e-8:
            break
    return b


def held_out(name: str = "doc_id"):
    return F.crc32(F.col(name).cast("string").cast("binary")) % 4 == 2


def training_sample(labels: DataFrame, column: str) -> DataFrame:
    """(doc_id, y): at most SAMPLE rows of each class outside the held-out fold, by a hash of the id."""
    own = labels.where(f"doc_id is not null and {column} in (0, 1)").where(~held_out()).groupBy("doc_id").agg(F.max(column).alias("y"))
    pick = [own.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE) for y in (1, 0)]
    return pick[0].unionByName(pick[1])


def learn_lexicon(sample: DataFrame) -> list[tuple[str, float]]:
    """Terms and weights from (text, y): words with far more toxic documents than chance gives.

    A term is in five rows of the sample or more, so its bound bounds their number.
    """
    words = F.array_distinct(F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}']+"), lambda w: F.length(w) >= 3))
    n, base = sample.agg(F.count("*"), F.avg("y")).first()
    if not n or not base or base == 1:
        return []
    table = sample.select("y", F.explode(words).alias("w")).groupBy("w").agg(F.sum("y").alias("a"), F.count("*").alias("n")).where("n >= 5")
    rate = F.col("a") / F.col("n")
    z = (rate - base) / F.sqrt(F.lit(base * (1 - base)) / F.col("n"))
    got = table.select("w", "a", "n", z.alias("z")).where((F.col("z") > 5) & (rate > base + 0.5 * (1 - base))).orderBy(F.desc("z"), "w").collect()
    odds = base / (1 - base)
    return [(r.w, float(np.log((r.a + 0.5) / (r.n - r.a + 0.5) / odds))) for r in got]


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each document.

    The lexicon and the model are learnt from at most SAMPLE labelled rows of each class whose
    crc32(doc_id) mod 4 is not 2; the texts alone are scored. A null text counts as empty, which
    has the score of a text without matches; with no labels of one class every score is that
    class's rate, or 0. A null id is not held out and is never learnt from. Repeated rows each
    give a row. Other columns are ignored.
    """
    marks = training_sample(labels, "toxic")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sample = rows.join(F.broadcast(marks), "doc_id").select("text", "y")  # at most 2 SAMPLE rows
    lexicon = learn_lexicon(sample)
    terms, weights = [t for t, _ in lexicon], [w for _, w in lexicon]

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matches = _Matches(LexiconAutomaton(terms))
        for b in batches:
            x = [features(t or "", matches, weights).tolist() for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), b.column(1)], names=["x", "y"])

    got = sample.withColumn("y", F.col("y").cast("int")).mapInArrow(measured, "x array<double>, y int").collect()
    x = np.array([r.x for r in got]).reshape(-1, N_FEATURES)
    y = np.array([r.y for r in got], float)
    if len(set(y.tolist())) == 2:
        # classes are sampled to equal bounds: weights give each its share of the labels again
        share = {r.toxic: r.n for r in labels.where("doc_id is not null and toxic in (0, 1)").where(~held_out()).groupBy("toxic").agg(F.count("*").alias("n")).collect()}
        weight = np.where(y == 1, share.get(1, 1) / max(1, (y == 1).sum()), share.get(0, 1) / max(1, (y == 0).sum()))
        model = logistic(x, y, weight / weight.mean(), 1e-4)
    else:
        model = np.append(np.zeros(N_FEATURES), 30.0 if len(y) and y[0] else -30.0)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matches = _Matches(LexiconAutomaton(terms))
        for b in batches:
            x = np.array([features(t or "", matches, weights) for t in b.column(1).to_pylist()]).reshape(-1, N_FEATURES)
            score = 1 / (1 + np.exp(-np.clip(x @ model[:-1] + model[-1], -30, 30)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    source = rows.select("doc_id", "text", F.coalesce(held_out(), F.lit(False)).alias("held_out"))
    return source.mapInArrow(scored, "doc_id long, held_out boolean, score double, predicted int")
