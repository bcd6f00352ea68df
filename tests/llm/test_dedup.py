"""Dedup operators against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import common, simhash, windows
from quarry.llm.embedding_dedup import near_vectors
from quarry.llm.simhash import fingerprint, near_duplicates, one_of_each
from quarry.llm.substring_dedup import remove_repeated_windows
from quarry.llm.suffix_dedup import CoverRanks, _words, remove_repeated_bytes, repeated, suffix_order

NO = (1 << 63) - 1


def groups(n, pairs, ids):
    up = list(range(n))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    least = {}
    for k in range(n):
        least[top(k)] = min(least.get(top(k), NO), ids[k])
    return [least[top(k)] for k in range(n)]


def window_oracle(rows, length=13):
    first = {}
    for d, text in rows:
        w = (text or "").encode().split()
        for i in range(len(w) - length + 1):
            k = tuple(w[i : i + length])
            first[k] = min(first.get(k, NO), NO if d is None else d)
    out = []
    for d, text in rows:
        w = (text or "").encode().split()
        gone = [False] * len(w)
        for i in range(len(w) - length + 1):
            if first[tuple(w[i : i + length])] < (NO if d is None else d):
                gone[i : i + length] = [True] * length
        out.append((str(d), len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    return sorted(out)


def byte_oracle(rows, length=200):
    seen = {}
    for _, text in rows:
        raw = (text or "").encode()
        for i in range(len(raw) - length + 1):
            seen[raw[i : i + length]] = seen.get(raw[i : i + length], 0) + 1
    out = []
    for d, text in rows:
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - length + 1):
            if seen[raw[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int((np.diff(np.append(0, gone.astype(int))) == 1).sum())
        out.append((str(d), len(raw), int(gone.sum()), spans, np.frombuffer(raw, np.uint8)[~gone].tobytes()))
    return sorted(out)


def told(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_windows_on_odd_rows(odd_docs):
    got = [(str(r.doc_id), r.n_words, r.n_removed, r.kept) for r in remove_repeated_windows(odd_docs).collect()]
    assert sorted(got) == window_oracle(told(odd_docs))


def test_bytes_on_odd_rows(odd_docs):
    got = [(str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in remove_repeated_bytes(odd_docs).collect()]
    assert sorted(got) == byte_oracle(told(odd_docs))


def test_no_rows(no_docs, spark):
    for op in (remove_repeated_windows, remove_repeated_bytes, near_duplicates, one_of_each):
        assert op(no_docs).collect() == []
    assert near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).collect() == []


@pytest.fixture()
def hot(monkeypatch):
    """Every minimiser that occurs twice counts as one that too many pieces share."""
    monkeypatch.setattr(windows, "heavy_keys", lambda counts, share: np.array(sorted(r[0] for r in counts.where("key is not null").select("key").distinct().collect()), np.int64))


def test_hot_minimisers_give_the_same(spark, hot):
    rng = random.Random(5)
    common_part = " ".join(rng.choice("lorem ipsum dolor sit amet magna aliqua".split()) + str(rng.randrange(9)) for _ in range(80))
    rows = [(k, f"{rng.random()} start{k} {common_part[: rng.randrange(200, 500)]} end {rng.random()}") for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = [(str(r.doc_id), r.n_words, r.n_removed, r.kept) for r in remove_repeated_windows(df).collect()]
    assert sorted(got) == window_oracle(rows)
    got = [(str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in remove_repeated_bytes(df).collect()]
    assert sorted(got) == byte_oracle(rows)


def test_repeated_suffixes_by_brute_force():
    rng = random.Random(1)
    for length in (5, 40, 200, 230):
        base = bytes(rng.choice(b"ab") for _ in range(700))
        buf = base + bytes(rng.choice(b"abc") for _ in range(300)) + base[37:500]
        at = np.arange(len(buf) - length + 1)
        seen = {}
        for i in at.tolist():
            seen[buf[i : i + length]] = seen.get(buf[i : i + length], 0) + 1
        assert repeated(buf, at, length).tolist() == [seen[buf[i : i + length]] > 1 for i in at.tolist()]


def test_suffixes_are_in_byte_order():
    rng = random.Random(4)
    letters = "the of and to in is that for it was".split()
    for n in range(12):
        passage = bytes(rng.randrange(256) for _ in range(500)) if n % 3 else " ".join(rng.choice(letters) for _ in range(120)).encode()
        buf = b"".join(passage[rng.randrange(200) : rng.randrange(250, 500)] + bytes(rng.choice(b"ab\x00\xff") for _ in range(rng.randrange(40))) for _ in range(60)) + b"a" * 400
        for length in (7, 33, 34, 200, 301):
            at = np.array(rng.sample(range(len(buf) - length + 1), 3000))
            order, same = suffix_order(buf, at, length)
            strings = [buf[i : i + length] for i in at[order].tolist()]
            assert sorted(order.tolist()) == list(range(len(at))) and strings == sorted(strings)
            assert same.tolist() == [x == y for x, y in zip(strings, strings[1:])]
        rank = CoverRanks(_words(buf), len(buf), 200).rank
        some = [i for i in range(len(buf)) if i % 13 in (0, 1, 3, 9)]
        by = sorted(some, key=lambda i: buf[i : i + 208])
        assert all((rank[i] < rank[j]) == (buf[i : i + 208] < buf[j : j + 208]) for i, j in zip(by, by[1:]))


def test_pieces_alone_with_equal_windows(spark):
    """Periodic texts repeat strings within one piece."""
    rows = [(k, ("abcdefghijklmnopqrstuvwxyz0123456789" * 20)[:k] * n) for k, n in ((1, 205), (1, 199), (3, 80), (37, 6), (150, 3), (184, 3), (185, 3), (230, 2))]
    rows += [(300, "".join(chr(97 + (i * i) % 23) for i in range(184)) * 2 + "zq"), (301, bytes(33 + (i * 7919) % 90 for i in range(190)).decode() * 3)]
    got = [(str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in remove_repeated_bytes(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got) == byte_oracle(rows)


def test_spans_are_merged():
    rng = random.Random(8)
    spans = np.array([(rng.randrange(5), rng.randrange(2), lo := rng.randrange(1 << 30), lo + rng.randrange(1, 1 << 27)) for _ in range(300)])
    want = []
    for i, th, lo, hi in sorted(map(tuple, spans.tolist())):
        if want and want[-1][:2] == [i, th] and lo <= want[-1][3]:
            want[-1][3] = max(want[-1][3], hi)
        else:
            want.append([i, th, lo, hi])
    assert windows.merged(spans).tolist() == want
    assert len(windows.merged(np.empty((0, 4), np.int64))) == 0
    many = np.column_stack([np.repeat(np.arange(1 << 16), 2), np.zeros(1 << 17, int), np.tile([0, 5], 1 << 16), np.tile([9, 20], 1 << 16)])
    assert len(windows.merged(many)) == 1 << 16 and (windows.merged(many)[:, 2:] == [0, 20]).all()


def test_forest_and_components(spark):
    rng = random.Random(2)
    for n, m in ((50, 30), (400, 380), (300, 2000)):
        pairs = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(0, k) for k in range(0, n, 7)]
        got = {r.node: r.root for r in common.components(spark.createDataFrame(pairs, "a long, b long").repartition(4)).collect()}
        want = groups(n, pairs, list(range(n)))
        assert all(got.get(k, k) == want[k] for k in range(n))
        tree = dict(map(tuple, common.forest(np.array(pairs)).tolist()))
        assert all(tree.get(k, k) == want[k] for k in range(n))


def test_estimates_stay_small_over_rounds(spark):
    """Each round joins what the last one left; the estimate's digits used to double each time."""
    now = spark.range(100).selectExpr("id", "id % 7 as k")
    for _ in range(5):
        one = common.cut(now.groupBy("k").count().drop("count"))
        now = common.cut(now.join(F.broadcast(one), "k").select("id", "k"))
        assert now._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length() <= 64
    assert sorted(map(tuple, now.select("id", "k").collect())) == [(i, i % 7) for i in range(100)]


def fp_groups(rows, bits=3):
    fp = [fingerprint((t or "").encode()) for _, t in rows]
    pairs = [(i, j) for i in range(len(fp)) for j in range(i) if bin(fp[i] ^ fp[j]).count("1") <= bits]
    return sorted((str(d), f"{f:016x}", str(c if c != NO else None)) for (d, _), f, c in zip(rows, fp, groups(len(fp), pairs, [NO if d is None else d for d, _ in rows])))


def test_simhash_on_odd_rows(odd_docs):
    got = [(str(r.doc_id), r.fingerprint, str(r.component_id)) for r in near_duplicates(odd_docs).collect()]
    assert sorted(got) == fp_groups(told(odd_docs))
    kept = one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns and kept.count() == len({c for *_, c in fp_groups(told(odd_docs))})


def test_one_of_each_group_whatever_its_ids(spark):
    rng = random.Random(9)
    prose = [" ".join(f"t{n}w{rng.randrange(10**6)}" for _ in range(80)) for n in range(7)]
    # three groups of null ids only, one with an id too, two groups that share id 1, one that has id 1 and 0
    rows = [(None, prose[0]), (None, prose[0]), (None, prose[1]), (None, prose[2]), (None, prose[3]), (5, prose[3]), (1, prose[4]), (1, prose[5]), (2, prose[5]), (1, prose[6]), (0, prose[6])]
    got = one_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert sorted((str(r.doc_id), prose.index(r.text)) for r in got) == [("0", 6), ("1", 4), ("1", 5), ("5", 3), ("None", 0), ("None", 1), ("None", 2)]


def test_links_of_crowded_keys():
    rng = np.random.default_rng(4)
    base = int(rng.integers(0, 1 << 62))
    near = np.unique(np.array([base ^ sum(1 << int(b) for b in rng.choice(20, rng.integers(0, 9), replace=False)) for _ in range(3000)], np.uint64))
    for most in (1, 3):
        got = simhash.linked(np.zeros(len(near), np.uint64), near, most)
        assert (np.bitwise_count(got[:, 0] ^ got[:, 1]) <= 20).all()
        number = {int(x): k for k, x in enumerate(near)}
        pairs = [(i, i + s) for s in range(1, len(near)) for i in np.flatnonzero(np.bitwise_count(near[s:] ^ near[:-s]) <= most).tolist()]
        ids = list(range(len(near)))
        assert groups(len(near), [(number[int(a)], number[int(b)]) for a, b in got], ids) == groups(len(near), pairs, ids)


def test_variants_meet():
    rng = np.random.default_rng(6)
    a = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
    for n in range(4):
        b = a.copy()
        for k in range(len(b)):
            for bit in rng.choice(64, n, replace=False):
                b[k] ^= np.uint64(1) << np.uint64(bit)
        x, y = simhash.variants(a), simhash.variants(b)
        for k in range(len(a)):
            shared = np.intersect1d(x[k], y[k])
            assert len(shared)
            key = np.full(1, shared[0])
            again = np.intersect1d(simhash.second_variants(key, a[k : k + 1]), simhash.second_variants(key, b[k : k + 1]))
            assert len(again)


def vector_oracle(rows, cosine=0.98):
    good = []
    for k, (i, v, label) in enumerate(rows):
        x = np.array([np.nan if c is None else c for c in v], float) if v else np.zeros(1)
        if label is not None and np.isfinite(x).all() and x.any():
            good.append((k, x / np.linalg.norm(x), label))
    pairs = [(a[0], b[0]) for n, a in enumerate(good) for b in good[:n] if a[2] == b[2] and len(a[1]) == len(b[1]) and a[1] @ b[1] >= cosine]
    links = [0] * len(rows)
    for a, b in pairs:
        links[a] += 1
        links[b] += 1
    ids = [NO if r[0] is None else r[0] for r in rows]
    return sorted((str(r[0]), n, str(None if c == NO else c), i == c) for r, n, c, i in zip(rows, links, groups(len(rows), pairs, ids), ids))


@pytest.mark.parametrize("block", [24, 64])  # several levels of cells, and one
def test_vectors(spark, monkeypatch, block):
    from quarry.llm import embedding_dedup

    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    monkeypatch.setattr(embedding_dedup, "FAN", 3)
    monkeypatch.setattr(embedding_dedup, "DEALT", 40)
    monkeypatch.setattr(embedding_dedup, "GROUP", 2)
    rng = np.random.default_rng(8)
    rows = []
    for label in range(3):
        for c in rng.normal(size=(12, 16)):
            for _ in range(rng.integers(1, 25)):
                rows.append((len(rows), (c + rng.normal(size=16) * rng.choice([0, 0.05, 0.12, 0.2])).astype(np.float32).tolist(), label))
    tight = rng.normal(size=16)  # more vectors closer than any net parts than a block holds
    rows += [(1000 + k, (tight + 1e-4 * rng.normal(size=16)).tolist(), 2) for k in range(30)]
    rows += [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, [None] + [1.0] * 15, 1), (904, rows[0][1], None), (None, rows[0][1], 0), (905, [2 * x for x in rows[0][1]], 0), (0, rows[0][1], 0), (906, [1.0, 2.0], 0)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, label int, node int, cell int")
    got = [(str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in near_vectors(df).collect()]
    want = vector_oracle([(i, None if v is None else [None if c is None else float(np.float32(c)) for c in v], y) for i, v, y in rows])
    assert sorted(got) == want
