"""The other operators and the pipeline against brute force."""

import collections
import heapq
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import mixing, packing, quality_classifier, quality_rules, queries, token_counts, toxicity
from quarry.llm.quality_classifier import quality_scores

VOCABULARY = queries.BYTE_BPE
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_longest_match():
    rng = random.Random(3)
    pieces = {bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 6))) for _ in range(40)} | {b"a", b"b", b"c", b" "}
    automaton = token_counts.LongestMatch(sorted(pieces))
    for _ in range(500):
        word = rest = bytes(rng.choice(b" abc") for _ in range(rng.randrange(0, 30)))
        n = 0
        while rest:
            rest = rest[max(k for k in range(1, 7) if rest[:k] in pieces) :]
            n += 1
        assert automaton.count(word) == n


def test_token_counts_by_brute_force(spark):
    """The registered query against greedy cutting, word by word."""
    pieces = set(token_counts.byte_vocabulary(VOCABULARY))
    longest, known = max(map(len, pieces)), {}

    def cut(word):
        n, at = 0, 0
        while at < len(word):
            at += next(k for k in range(min(longest, len(word) - at), 0, -1) if word[at : at + k] in pieces)
            n += 1
        return n

    d = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    for r in queries.queries()["op5_token_counts"](spark, d).collect():
        words = texts[r.doc_id].encode().split()
        for w in set(words) - known.keys():
            known[w] = cut(b" " + w)
        assert (r.n_bytes, r.n_words, r.n_tokens) == (len(texts[r.doc_id].encode()), len(words), sum(known[w] for w in words))


def test_token_counts(odd_docs, no_docs):
    got = token_counts.token_counts(odd_docs, VOCABULARY)
    rows = [(r.doc_id, r.n_words, r.n_tokens) for r in got.collect()]
    assert (3, 0, 0) in rows and (4, 0, 0) in rows and len(rows) == odd_docs.count()
    assert token_counts.token_counts(no_docs, VOCABULARY).collect() == []


def best_fit_decreasing(sizes, capacity):
    gaps = []
    for s in sorted(sizes, reverse=True):
        fits = [k for k, g in enumerate(gaps) if g >= s]
        if fits:
            gaps[min(fits, key=lambda k: gaps[k])] -= s
        else:
            gaps.append(capacity - s)
    return len(gaps)


def test_rounds_pack_about_as_best_fit_decreasing(spark):
    rng = random.Random(1)
    for capacity, low, high, n in ((10, 1, 10, 200), (64, 1, 64, 300), (1024, 1, 1024, 400), (1024, 200, 400, 300), (1024, 1, 60, 300), (1024, 600, 1024, 50)):
        sizes = [rng.randint(low, high) for _ in range(n)]
        fill, ranks = collections.defaultdict(list), collections.defaultdict(list)
        for kind, length, first, many, rank, offset in packing.placed_runs(spark, dict(collections.Counter(sizes)), capacity):
            assert kind == packing.PLACED
            ranks[length] += range(rank, rank + many)
            for k in range(many):
                fill[first + k].append((offset, length))
        assert len(fill) == best_fit_decreasing(sizes, capacity)
        for own in fill.values():
            end = 0
            for offset, length in sorted(own):
                assert offset == end
                end += length
            assert end <= capacity
        assert {x: sorted(r) for x, r in ranks.items()} == {x: list(range(m)) for x, m in collections.Counter(sizes).items()}
    assert packing.placed_runs(spark, {}, 1024) == []


LONG_RUNS = [f"a{c * n}b" for c, n in ((" ", 1_200_000), ("\n", 1_100_000), ("x", 300_000), ("x", 4000), ("ab ", 100_000), (" \t", 300), (" ", 255), ("é", 257), ("!", 5000))]
TRICKY = ["a  b\n\nc   d \n e", "  lead", "tail  ", "don't we'll\t\tx \x1c y", "é ñ  ß 12 3.4!! ##", "<|endoftext|> x", "a  b  c ​ d", "", " ", "\n"]


def test_encoder_gives_the_tokenizers_ids():
    from tokenizers import Tokenizer

    encode, want = packing._Encoder(VOCABULARY), Tokenizer.from_file(VOCABULARY)
    rng = random.Random(9)
    for text in TRICKY + ["".join(rng.choice("ab c\n\t é'1! \x1f") for _ in range(rng.randrange(80))) for _ in range(2000)] + LONG_RUNS:
        assert np.frombuffer(encode(text), "<u4").tolist() == want.encode(text, add_special_tokens=False).ids, repr(text)


def test_packing_round_trip(odd_docs, no_docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(VOCABULARY)
    rows = packing.pack(odd_docs, VOCABULARY).collect()
    want = collections.Counter()
    for r in odd_docs.collect():
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2]
        cuts = [0, *range((len(ids) - 1) % 1024 + 1, len(ids), 1024)]
        for k, (a, b) in enumerate(zip(cuts, [*cuts[1:], len(ids)])):
            want[(r.doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    by = collections.defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for own in by.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= 1024
    assert packing.pack(no_docs, VOCABULARY).collect() == []


def measures(text):
    w = WORD.findall(text or "")
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n, repeats = collections.Counter(grams), set()
    for i, g in enumerate(grams):
        if n[g] > 1:
            repeats |= {i, i + 1, i + 2}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    base = len(w) < 50 or 100 * len(repeats) > 50 * len(w)
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(repeats), base


def test_quality_measures(odd_docs, no_docs, spark):
    labels = spark.createDataFrame([(1, 1), (None, 1), (2, None)], "doc_id long, quality int")
    got = quality_rules.quality_rules(odd_docs, labels).collect()
    rows = sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got)
    assert rows == sorted((str(r.doc_id), *measures(r.text)) for r in odd_docs.collect())
    assert all(r.kept != r.base_failed for r in got)  # three labels certify nothing
    assert quality_rules.quality_rules(no_docs, labels.limit(0)).collect() == []


def test_binomial_tail(spark):
    cases = [(n, k, p) for n in (10, 500, 3000) for k in (0, 1, 5, 12) for p in (0.004, 0.02)]
    for p in (0.004, 0.02):
        df = spark.createDataFrame([c for c in cases if c[2] == p], "n long, k long, p double")
        for r in df.withColumn("t", quality_rules.binomial_tail(F.col("n"), F.col("k"), p)).collect():
            exact = sum(math.comb(r.n, j) * p**j * (1 - p) ** (r.n - j) for j in range(r.k + 1))
            assert r.t == pytest.approx(1.0 if r.k >= r.n * p else exact, rel=1e-8)


def test_certified_cutoffs_keep_the_good(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows, labels = [], []
    for k in range(2200):
        bad = k % 10 == 0
        rows.append((k, " ".join(word() + ("###" if bad else "") for _ in range(60)), "en"))
        labels.append((k, 0 if bad else 1))
    got = quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    assert all(r.kept == (r.doc_id % 10 != 0) for r in got)


def test_small_strata_use_the_pool(spark):
    # stratum, documents, of which with many symbols, good
    parts = [("en", 1900, 0, True), ("en", 100, 100, False), ("de", 300, 0, True), ("de", 30, 30, False), ("fr", 60, 2, True), ("fr", 30, 30, False), ("other", 20, 20, False)]
    rows = [(s, good, 30 if k < many else 0) for s, n, many, good in parts for k in range(n)]
    df = spark.createDataFrame(rows, "stratum string, good boolean, n_symbols long").selectExpr("*", *[f"{v}L AS {c}" for c, v in {"n_words": 60, "word_chars": 300, "n_dup_lines": 0, "n_repeat_words": 0, "n_lines": 1, "n_capitals": 0}.items()])
    # 2 of the pool's 2,260 good ones are over every cutoff: too many
    assert set(quality_rules.certified(df, 0.004, 0.05)) == {("en", "symbols")}
    got = quality_rules.certified(df.where("stratum <> 'fr' or not good or n_symbols = 0"), 0.004, 0.05)
    assert set(got) == {(s, "symbols") for s in ("de", "en", "fr")}  # 'other' has no good documents
    more = spark.range(3000).selectExpr("'en' AS stratum", "true AS good", "0L AS n_symbols", *[f"{v}L AS {c}" for c, v in {"n_words": 60, "word_chars": 300, "n_dup_lines": 0, "n_repeat_words": 0, "n_lines": 1, "n_capitals": 0}.items()])
    got = quality_rules.certified(df.unionByName(more), 0.004, 0.05)
    assert set(got) == {("de", "symbols"), ("en", "symbols")}  # the pool's cutoffs reject 2 of 60 good ones in 'fr'


def test_mixing_meets_targets(odd_docs, no_docs, spark):
    rng = random.Random(11)
    rows = [(k, " ".join("w" for _ in range(rng.randrange(0, 300))), rng.choice(["a", "a", "a", "b", "c", "d", None])) for k in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df).collect()
    assert got and sorted(got) == sorted(mixing.mix(df.repartition(7)).collect())
    source = {k: s for k, _, s in rows}
    size = collections.Counter()
    for k, t, s in rows:
        size[s] += len(t.split())
    total, weights = sum(size.values()), dict(zip(["a", "b", "c", "d", None], [5, 2, 1, 5, 2]))
    capped = set()
    while True:
        level = (total - sum(3 * size[s] for s in capped)) / sum(w for s, w in weights.items() if s not in capped)
        more = {s for s in weights if s not in capped and level * weights[s] > 3 * size[s]}
        if not more:
            break
        capped |= more
    taken = collections.Counter()
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == size[s] and r.target == pytest.approx(3 * size[s] if s in capped else level * weights[s])
        assert 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
    assert all(abs(taken[s] - (3 * size[s] if s in capped else level * weights[s])) <= 40 for s in size)
    out = mixing.mixed_documents(df)
    assert sum(len(r.text.split()) for r in out.collect()) == sum(taken.values())
    assert mixing.mix(odd_docs).count() == odd_docs.count() and mixing.mixed_documents(odd_docs).columns == odd_docs.columns
    assert mixing.mix(no_docs).collect() == [] and mixing.mixed_documents(no_docs).collect() == []


def highest_quotients(units, house):
    """Seats of (unit, votes, most) by a heap of quotients."""
    seats, most, votes = {u: 0 for u, *_ in units}, {u: m for u, _, m in units}, {u: v for u, v, _ in units}
    heap = [(-v, u) for u, v, m in units if m]
    heapq.heapify(heap)
    for _ in range(house):
        if not heap:
            break
        _, u = heapq.heappop(heap)
        seats[u] += 1
        if seats[u] < most[u]:
            heapq.heappush(heap, (-votes[u] / (2 * seats[u] + 1), u))
    return seats


def test_seats_go_to_the_highest_quotients(spark):
    rng = random.Random(3)
    cases = {
        "skewed": ([(0, 16000.0, 3000)] + [(k, 6.0, 2) for k in range(1, 401)], 1150),
        "mixed": ([(k, float(rng.randint(0, 3000)), 563) for k in range(300)], 9000),
        "equal": ([(k, 100.0, 19) for k in range(300)], 1111),
        "stopped": ([(0, 1000.0, 3), (1, 10.0, 50), (2, 10.0, 50)], 40),
        "full": ([(0, 8.0, 2), (1, 5.0, 1)], 9),
        "none": ([(0, 5.0, 1)], 0),
    }
    units = spark.createDataFrame([(c, u, v, m) for c, (own, _) in cases.items() for u, v, m in own], "key string, unit long, votes double, most long").repartition(8)
    houses = spark.createDataFrame([(c, h) for c, (_, h) in cases.items()], "key string, house long")
    got = collections.defaultdict(dict)
    for r in mixing.apportioned(units, houses).collect():
        got[r.key][r.unit] = r.quota
    assert got == {c: highest_quotients(own, house) for c, (own, house) in cases.items()}


def test_mixed_texts_are_the_words_drawn(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD", 4000)
    rows = [(k, " \n" * (k % 3) + "".join(f"d{k}w{j}{' ' if j % 5 else chr(10)}" for j in range(k * 37 % 900)), "abcde"[k * k % 5], k) for k in range(120)]
    rows += [(7, "same text here", "a", 1)] * 300 + [(None, "one two three", None, 2)] * 5
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, own_id int").repartition(6)
    plan, out = mixing.mix(df).collect(), mixing.mixed_documents(df).collect()
    want, got = collections.Counter(), collections.Counter()
    for r in plan:
        want[r.doc_id] += r.taken
        assert r.taken == r.passes * r.size + sum(p.hi - p.lo for p in r.parts)
    texts = {i: t for i, t, *_ in rows}
    for r in out:
        got[r.doc_id] += len(r.text.split())
        if r.doc_id != 7 and r.text != texts[r.doc_id]:  # a part: runs of its words, with the blanks between them
            words = r.text.split()
            assert "d" in words[0] or r.doc_id is None
            assert all(piece in texts[r.doc_id] for piece in re.split(r" (?=d\d+w0\b)", r.text)) or len(words) < len(texts[r.doc_id].split())
    assert got == +want
    assert any("\n" in r.text and r.text != texts[r.doc_id] for r in out)
    assert len({r.nth for r in plan if r.size == 3 and r.doc_id == 7}) == 300


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_lexicon_automaton():
    rng = random.Random(12)
    terms = sorted({"".join(rng.choice("abcd") for _ in range(rng.randrange(3, 8))) for _ in range(30)})
    automaton = toxicity.LexiconAutomaton(terms)
    for _ in range(3000):
        word = "".join(rng.choice("abcde") for _ in range(rng.randrange(1, 9)))
        near = [distance(word, t) for t in terms if distance(word, t) <= (1 if len(t) >= 5 else 0)]
        got = automaton.match(word)
        assert (got is not None) == bool(near)
        if got:
            assert got[1] == min(near) == distance(word, terms[got[0]])


def test_toxicity_features_by_brute_force():
    rng = random.Random(14)
    terms, weights = ["idiot", "scum", "moron", "trash"], [3.0, 2.0, 2.5, 1.0]
    matches = toxicity._Matches(toxicity.LexiconAutomaton(terms))
    edge = toxicity.EDGE

    def nearest(token):
        """(edits, term) of a whole token, its look-alike or one of its runs of letters, in this order."""
        bare = token.strip(edge).lower()
        best = lambda w: min(((distance(w, t), k) for k, t in enumerate(terms) if distance(w, t) <= (1 if len(t) >= 5 else 0)), default=None)
        got = best(bare)
        if got is None and not bare.isalpha():
            got = best(bare.translate(toxicity.LOOK_ALIKE))
            if got is None:
                got = min((x for run in re.findall(r"[a-z']+", bare) if len(run) >= 3 and (x := best(run))), key=lambda x: x[0], default=None)
        return got

    pool = ["idiot", "idot", "IDIOT!", "1diot", "you/idiot", "idiot...loser", "scum", "scam", "morons", "trash-face", "\"moron\"", "you", "said", "he", "«idiot»", "the", "wrote", "x", "...", "i", "ab/cd"]
    for _ in range(300):
        words = [rng.choice(pool) for _ in range(rng.randrange(0, 25))]
        hits = [(i, *nearest(w)) for i, w in enumerate(words) if nearest(w)]
        got = toxicity.features(" ".join(words), matches, weights)
        assert got[0] == pytest.approx(math.log1p(len(words)))
        exact = [t for _, e, t in hits if e == 0]
        w = [weights[t] * (1 if e == 0 else 0.5) for _, e, t in hits]
        assert got[1:9] == pytest.approx([float(bool(exact)), math.log1p(len(exact)), float(len(hits) > len(exact)), math.log1p(len(hits) - len(exact)), max(w, default=0), math.log1p(sum(w)), 30 * len(exact) / (len(words) + 30) if hits else 0, len(set(exact))])
        spoken = sum(any(x.strip(edge).lower() in toxicity.SPEECH for x in words[max(0, i - 6) : i + 7]) for i, *_ in hits)
        assert got[10] == pytest.approx(spoken / len(hits) if hits else 0)


def labelled(spark, n=1500):
    rng = random.Random(13)
    word = lambda: "".join(rng.choice("aeioulnrst") for _ in range(rng.randrange(2, 9)))
    rows, toxic = [], []
    for k in range(n):
        words = [word() for _ in range(rng.randrange(20, 90))]
        bad = k % 6 == 0
        for _ in range(3 if bad else 0):
            words[rng.randrange(len(words))] = rng.choice(["vilexx", "scorned", "wretchy", "vilexz"])
        rows.append((k, " ".join(words), "en", "s", 10))
        toxic.append((k, int(bad), int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame(toxic, "doc_id long, quality int, toxic int")


def test_toxicity(spark, odd_docs, no_docs):
    docs, labels = labelled(spark)
    got = toxicity.toxicity(docs, labels).collect()
    held = [r for r in got if r.held_out]
    assert held and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert sum(r.predicted == (r.doc_id % 6 == 0) for r in held) > 0.97 * len(held)
    assert toxicity.toxicity(odd_docs, labels).count() == odd_docs.count()
    rows = toxicity.toxicity(odd_docs, labels.limit(0)).collect()
    assert len(rows) == odd_docs.count() and all(r.score < 0.3 for r in rows)
    assert toxicity.toxicity(no_docs, labels).collect() == []


def test_quality_classifier(spark, odd_docs, no_docs):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    truth = {r.doc_id: r.quality for r in labels.collect()}
    held = [r for r in quality_scores(docs, labels).collect() if r.held_out and r.doc_id in truth]
    assert sum(r.kept == truth[r.doc_id] for r in held) > 0.9 * len(held)
    assert quality_scores(odd_docs, labels).count() == odd_docs.count()
    assert all(r.kept for r in quality_scores(odd_docs, labels.limit(0)).collect())
    assert not any(r.kept for r in quality_scores(odd_docs, labels.withColumn("quality", F.lit(0))).collect())
    assert quality_scores(no_docs, labels).collect() == []


def two_views(spark, n, labelled, seed):
    """Documents whose words and whose source each tell good from bad, most of the time; labels for few."""
    rng = random.Random(seed)
    rows, labels = [], []
    for k in range(n):
        good = rng.random() < 0.6
        lean = 0.62 if good else 0.38
        words = [rng.choice(("ga", "gb", "gc", "gd")) + str(rng.randrange(12)) if rng.random() < lean else rng.choice(("ba", "bb", "bc", "bd")) + str(rng.randrange(12)) for _ in range(40)]
        source = rng.randrange(0, 20) if (rng.random() < 0.995) == good else rng.randrange(20, 40)
        rows.append((k, " ".join(words), "en", f"s{source}", 200))
        if k < labelled:
            labels.append((k, int(good)))
        else:
            labels.append((k, None))
        rows[-1] += (int(good),)
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, truth int"), spark.createDataFrame(labels, "doc_id long, quality int")


def area(pairs):
    """Share of (good, bad) pairs that the score puts in order."""
    good, bad = [p for p, y in pairs if y], [p for p, y in pairs if not y]
    return sum((g > b) + (g == b) / 2 for g in good for b in bad) / len(good) / len(bad)


def test_co_training_adds_to_the_labels(spark):
    docs, labels = two_views(spark, 4000, 800, 5)
    truth = {r.doc_id: r.truth for r in docs.select("doc_id", "truth").collect()}
    alone, both = ({r.doc_id: r.text_score for r in quality_scores(docs, labels, rounds=n).collect()} for n in (0, 3))
    test = [k for k in truth if k >= 800 and zlib.crc32(str(k).encode()) % 4 == 2]
    before, after = (area([(got[k], truth[k]) for k in test]) for got in (alone, both))
    assert after > before + 0.01 and after > 0.9


def test_few_labels_are_not_a_constant(spark):
    docs, _ = two_views(spark, 400, 0, 6)
    truth = {r.doc_id: r.truth for r in docs.select("doc_id", "truth").collect()}
    for n, least in ((16, 0.5), (100, 0.75)):
        labels = docs.where(F.col("doc_id") < n).select("doc_id", F.col("truth").alias("quality"))
        got = quality_scores(docs, labels).collect()
        assert len({round(r.score, 6) for r in got}) > 20
        assert area([(r.score, truth[r.doc_id]) for r in got if r.doc_id >= 100]) > least


def test_counts_of_the_views_by_brute_force(spark):
    docs, _ = two_views(spark, 60, 0, 7)
    rows = quality_classifier.features(docs, "doc_id", "text", "source", "lang", "n_chars").withColumns({"y": F.when(F.col("doc_id") < 30, (F.col("doc_id") % 2).cast("int")), "calibrates": F.col("doc_id") % 3 == 0})
    edges = [np.array([0.01, 0.5, 3.0])] * (quality_classifier.N_SURFACE + 1)
    got = quality_classifier._tally(rows, edges, None, True)
    want, n_cells = collections.Counter(), len(quality_classifier.CUTS) + 1
    for r in docs.collect():
        if r.doc_id >= 30 or r.doc_id % 3 == 0:
            continue
        at = r.doc_id % 2 * (quality_classifier.TEXT.size // 2)
        want[at] += 1
        for k, x in enumerate(quality_classifier.surface(r.text, r.text.split())):
            want[at + 1 + k * n_cells + sum(x >= e for e in edges[0])] += 1
        for bit in {zlib.crc32(w.encode()) % quality_classifier.BITS for w in r.text.split()}:
            want[at + 1 + quality_classifier.TEXT.cells + bit] += 1
    assert {k: v for k, v in enumerate(got[: quality_classifier.TEXT.size]) if v} == want
    assert got[quality_classifier.TEXT.size] == want[0]


def test_labels_are_given_where_they_are_mostly_right():
    rng = np.random.default_rng(2)
    y = rng.integers(0, 2, 3000)
    p = np.clip(y * 0.5 + rng.normal(0.25, 0.15, 3000), 0, 1)
    up, down = quality_classifier.sure(p, y, np.ones(3000))
    assert (y[p >= up] == 1).mean() >= 0.95 and (y[p <= down] == 0).mean() >= 0.95 and (p >= up).sum() > 500 < (p <= down).sum()
    assert quality_classifier.sure(rng.random(3000), y, np.ones(3000)) == (2.0, -1.0)
    text, meta = quality_classifier.exchanged(np.array([0.1, 0.5, 0.9]), np.array([0.9, 0.5, 0.9]), np.array([True, True, False]), [(0.8, 0.2), (0.8, 0.2)])
    assert text.tolist() == [1, -1, -1] and meta.tolist() == [0, -1, -1]


def test_pipeline_stages_on_odd_rows(spark, odd_docs, no_docs, tmp_path):
    """Every stage by itself on nulls, repeats, copies and columns with names that operators use."""
    import corpus_pipeline

    labels = spark.createDataFrame([(1, 1), (None, 1), (2, None), (3, 0)], "doc_id long, quality int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    rows = odd_docs.collect()
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd_docs, str(tmp_path))
        got = out.collect()
        assert stage(spark, no_docs, str(tmp_path)).collect() == []
        if name == "best-fit packing":
            assert {r.doc_id for r in got} == {r.doc_id for r in rows}
            continue
        assert out.columns == odd_docs.columns
        assert all(r["__id"] == r["a.b"] == r.own_id == 7 and r.kept == ["y"] and r.key == "x" for r in got)
        if name == "quality rules":
            assert sorted(str(r) for r in got) == sorted(str(r) for r in rows if not measures(r.text)[-1])
        elif name == "suffix-array dedup":
            assert sorted(str(r.doc_id) for r in got) == sorted(str(r.doc_id) for r in rows)
            assert all(r.n_chars == len(r.text) for r in got) and next(r for r in got if r.doc_id == 10).text == "one two"
        elif name == "source mixing":
            size = collections.Counter(str(r.doc_id) for r in rows for _ in (r.text or "").split())
            taken = collections.Counter(str(r.doc_id) for r in got for _ in r.text.split())
            assert all(0 < taken[k] <= 3 * size[k] for k in taken)


def test_pipeline(spark, tmp_path):
    """Each stage's rows by brute force over what the stage before kept."""
    import corpus_pipeline
    from test_dedup import byte_oracle, fp_groups

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "simhash near-dedup", "suffix-array dedup", "source mixing", "best-fit packing"]
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns, kept = docs.columns, [docs.collect()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, d)
        docs.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept.append(docs.collect())
        assert k == 4 or docs.columns == columns
    source, good, single, cleaned, mixed, packed = kept
    # 1: sf0.001 has too few labels to certify a cutoff, so the base rule decides
    assert sorted(good) == sorted(r for r in source if not measures(r.text)[-1])
    # 2: of each group of fingerprints the least id
    assert len(good) > len(single) and {r.doc_id for r in single} == {int(c) for *_, c in fp_groups([(r.doc_id, r.text) for r in good])}
    assert all(r in good for r in single)
    # 3: bytes that repeat go, and what is left of letters that they cut
    want = {int(i): raw.decode("utf-8", "ignore") for i, *_, raw in byte_oracle([(r.doc_id, r.text) for r in single])}
    assert {r.doc_id: r.text for r in cleaned} == want and all(r.n_chars == len(r.text) for r in cleaned)
    assert sorted((r.doc_id, r.lang, r.source) for r in cleaned) == sorted((r.doc_id, r.lang, r.source) for r in single)
    # 4: each source comes near its target, no document over three times its words
    size, taken, of = collections.Counter(), collections.Counter(), {r.doc_id: r.source for r in cleaned}
    words, drawn = {r.doc_id: len(r.text.split()) for r in cleaned}, collections.Counter()
    for i, n in words.items():
        size[of[i]] += n
    for r in mixed:
        taken[r.source] += len(r.text.split())
        drawn[r.doc_id] += len(r.text.split())
        assert r.source == of[r.doc_id] and r.text and (r.text == want[r.doc_id] or set(r.text.split()) <= set(want[r.doc_id].split()))
    assert all(n <= 3 * words[i] for i, n in drawn.items())
    order = sorted(size)
    weights, capped = {x: (5, 2, 1)[k % 3] for k, x in enumerate(order)}, set()
    while True:
        level = (sum(size.values()) - sum(3 * size[x] for x in capped)) / sum(weights[x] for x in order if x not in capped)
        more = {x for x in order if x not in capped and level * weights[x] > 3 * size[x]}
        if not more:
            break
        capped |= more
    assert all(abs(taken[x] - (3 * size[x] if x in capped else level * weights[x])) <= 3 * mixing.BLOCK for x in order)
    # 5: the pieces of every document, each once
    from tokenizers import Tokenizer

    tokenizer, pieces = Tokenizer.from_file(VOCABULARY), collections.Counter()
    for r in mixed:
        ids = [*tokenizer.encode(r.text, add_special_tokens=False).ids, 2]
        cuts = [0, *range((len(ids) - 1) % 1024 + 1, len(ids), 1024)]
        for k, (a, b) in enumerate(zip(cuts, [*cuts[1:], len(ids)])):
            pieces[(r.doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed) == pieces
    assert len({r.sequence_id for r in packed}) == best_fit_decreasing([r.length for r in packed], 1024)
    assert corpus_pipeline.run(spark, d).count() == len(packed)
