"""Embedding near-dedup by dual traversal of cover trees.

Vectors of one label are put on the unit sphere, where cosine >= t means distance <= tau =
sqrt(2 - 2 t). A label's cell is cut into cells around the points of a net, these again with half
the radius or less, until a cell is a block of bounded size. Pairs of cells are walked down from
the labels, level by level, as tables: a pair whose centres are further apart than tau plus both
covering radii is dropped. Each block has a cover tree with nested levels of halving radii, and
for a pair of blocks the two trees are walked together by the same bounds; nodes that are
certainly closer are linked as a whole, and the rest is opened down to the vectors, which are
compared exactly.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import NO_ID, beside, column, components, cut, follow, forest, partitions, shown_id, tidy

SLACK = 1e-6
#: Vectors in a block, vectors that a cell's net is chosen from, points of a net, and vectors that a task deals to them.
BLOCK, SAMPLE, FAN, DEALT = 2048, 256, 48, 20_000
#: Partners that a block's tree meets in one go, about.
GROUP = 32


class CoverTree:
    """Nodes in arrays: centre (row), covering radius, range in perm, children."""

    def __init__(self, unit: np.ndarray, finest: float):
        self.unit = unit
        self.perm: list[int] = []
        self.centre, self.radius, self.lo, self.hi, self.kids = [], [], [], [], []
        self._node(0, np.arange(len(unit)), 1.0, finest)
        self.perm = np.array(self.perm)
        self.centre, self.radius, self.lo, self.hi = (np.array(x) for x in (self.centre, self.radius, self.lo, self.hi))

    def _away(self, c: int, rows: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0, 2 - 2 * (self.unit[rows] @ self.unit[c])))

    def _node(self, c: int, rows: np.ndarray, reach: float, finest: float) -> int:
        """A node over rows around c, whose children cover within `reach`, theirs within half of it."""
        me = len(self.centre)
        away = self._away(c, rows)
        self.centre.append(c)
        self.radius.append(float(away.max()))
        self.lo.append(len(self.perm))
        self.hi.append(len(self.perm) + len(rows))
        self.kids.append([])
        if len(rows) == 1 or reach < finest:
            self.perm.extend(rows.tolist())
            return me
        while self.radius[me] <= reach / 2 and reach >= finest:  # levels that would hold one child
            reach /= 2
        left, p, d = rows, c, away
        while True:
            near = d <= reach
            self.kids[me].append(self._node(p, left[near], reach / 2, finest))
            left = left[~near]
            if not len(left):
                return me
            p = int(left[0])
            d = self._away(p, left)


class _Found:
    """Links of the vectors in two blocks, as counts in the trees' order and as edges."""

    def __init__(self, a: CoverTree, b: CoverTree, wa: np.ndarray, wb: np.ndarray):
        self.a, self.b = a, b
        self.wa, self.wb = (np.append(0, np.cumsum(w[t.perm])) for w, t in ((wa, a), (wb, b)))
        self.na, self.nb = np.zeros(len(a.perm) + 1, np.int64), np.zeros(len(b.perm) + 1, np.int64)
        self.edges: list[np.ndarray] = []

    def whole(self, x: int, y: int) -> None:
        """All vectors of node x link with all of node y."""
        a, b = self.a, self.b
        self.na[a.lo[x]] += (w := self.wb[b.hi[y]] - self.wb[b.lo[y]])
        self.na[a.hi[x]] -= w
        self.nb[b.lo[y]] += (w := self.wa[a.hi[x]] - self.wa[a.lo[x]])
        self.nb[b.hi[y]] -= w
        left, right = a.perm[a.lo[x] : a.hi[x]], b.perm[b.lo[y] : b.hi[y]]
        self.edges.append(np.column_stack([left, np.full(len(left), right[0])]))
        self.edges.append(np.column_stack([np.full(len(right), left[0]), right]))


def dual(a: CoverTree, b: CoverTree, wa: np.ndarray, wb: np.ndarray, cosine: float, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weighted numbers of links of the rows of a and of b, and edges (row of a, row of b) that connect all linked.

    same: a is b; then links with oneself don't count and each pair counts once.
    """
    tau = np.sqrt(2 - 2 * cosine)
    found = _Found(a, b, wa, wb)
    stack = [(0, 0)]
    while stack:
        x, y = stack.pop()
        self_pair = same and x == y
        kx, ky = a.kids[x], b.kids[y]
        if not kx and not ky:
            _leaves(found, x, y, cosine, self_pair)
            continue
        kx, ky = np.array(kx or [x]), np.array(ky or [y])
        d = np.sqrt(np.maximum(0, 2 - 2 * (a.unit[a.centre[kx]] @ b.unit[b.centre[ky]].T)))
        reach = a.radius[kx][:, None] + b.radius[ky][None, :]
        open_ = d <= reach + tau + SLACK
        if self_pair:
            open_ &= np.arange(len(kx))[:, None] <= np.arange(len(ky))[None, :]
        sure = open_ & (d + reach <= tau - SLACK)
        for i, j in zip(*(k.tolist() for k in np.nonzero(open_))):
            p, q = int(kx[i]), int(ky[j])
            if sure[i, j] and not (same and p == q):
                found.whole(p, q)
            elif p == x and q == y:
                _leaves(found, p, q, cosine, same and p == q)
            else:
                stack.append((p, q))
    na, nb = np.empty(len(a.perm), np.int64), np.empty(len(b.perm), np.int64)
    na[a.perm], nb[b.perm] = np.cumsum(found.na[:-1]), np.cumsum(found.nb[:-1])
    edges = np.concatenate(found.edges) if found.edges else np.empty((0, 2), np.int64)
    return na, nb, edges


def _leaves(found: _Found, x: int, y: int, cosine: float, self_pair: bool) -> None:
    a, b = found.a, found.b
    left, right = a.perm[a.lo[x] : a.hi[x]], b.perm[b.lo[y] : b.hi[y]]
    hit = a.unit[left] @ b.unit[right].T >= cosine
    if self_pair:
        hit &= np.arange(len(left))[:, None] < np.arange(len(right))[None, :]
    i, j = np.nonzero(hit)
    if not len(i):
        return
    wl, wr = np.diff(found.wa)[a.lo[x] : a.hi[x]], np.diff(found.wb)[b.lo[y] : b.hi[y]]
    for base, lo, at, w in ((found.na, a.lo[x], i, wr[j]), (found.nb, b.lo[y], j, wl[i])):
        plus = np.bincount(at, w, minlength=at.max() + 1).astype(np.int64)
        base[lo : lo + len(plus)] += plus  # a difference array: add here, take away one further on
        base[lo + 1 : lo + 1 + len(plus)] -= plus
    found.edges.append(np.column_stack([left[i], right[j]]))


def _units(raw: list[bytes], dim: int) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), "<f8").reshape(-1, dim)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def net(unit: np.ndarray, reach: float, finest: float, most: int) -> tuple[list[int], float]:
    """Rows further apart than the returned reach, which is halved until there are two; one row if they are all closer than finest."""
    while reach >= finest:
        chosen, away = [0], np.sqrt(np.maximum(0, 2 - 2 * (unit @ unit[0])))
        while len(chosen) < most and away.max() > reach:
            chosen.append(int(away.argmax()))
            away = np.minimum(away, np.sqrt(np.maximum(0, 2 - 2 * (unit @ unit[chosen[-1]]))))
        if len(chosen) > 1:
            return chosen, reach
        reach /= 2
    return [0], reach


def cut_cells(vectors: DataFrame, finest: float) -> tuple[DataFrame, list[DataFrame]]:
    """vectors (node, w, v, cell) with the cells that they end in, and the levels of cells below the labels.

    A level has (cell, parent, centre, radius): radius is that of the vectors in the cell. A cell
    of more than BLOCK vectors is cut by a net of its own sample; one whose vectors are closer
    than `finest` stays whole, its parts are dealt by hash.
    """

    def chosen(rows: pa.Table) -> pa.Table:
        order = np.argsort(rows.column("nth").to_numpy())
        raw = rows.column("v").take(pa.array(order)).to_pylist()
        n = rows.column("n")[0].as_py()
        at, reach = net(_units(raw, len(raw[0]) // 8), rows.column("reach")[0].as_py(), finest, max(2, min(FAN, -(-2 * n // BLOCK))))
        at = at if len(at) > 1 else []
        m = len(at)
        return pa.table([pa.array([rows.column("cell")[0].as_py()] * m, pa.string()), pa.array(range(m), pa.int32()), pa.array([raw[k] for k in at], pa.binary()), pa.array([reach / 2] * m, pa.float64())], names=["cell", "kid", "centre", "reach"])

    def dealt(rows: pa.Table, kids: pa.Table) -> pa.Table:
        if not rows.num_rows or not kids.num_rows:
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.float64())], names=["node", "w", "v", "cell", "away"])
        kids = kids.sort_by("kid")
        centres = kids.column("centre").to_pylist()
        dots = _units(rows.column("v").to_pylist(), len(centres[0]) // 8) @ _units(centres, len(centres[0]) // 8).T
        to = [f"{c}/{k}" for c, k in zip(rows.column("cell").to_pylist(), dots.argmax(1).tolist())]
        return pa.table([*(rows.column(c) for c in ("node", "w", "v")), pa.array(to), pa.array(np.sqrt(np.maximum(0, 2 - 2 * dots.max(1))))], names=["node", "w", "v", "cell", "away"])

    done, levels = [], []
    # a label's points are at most 2 apart
    now = vectors.withColumn("reach", F.lit(1.0))
    while True:
        sizes = cut(now.groupBy("cell").agg(F.count("*").alias("n"), F.first("reach").alias("reach")))
        big = sizes.where(F.col("n") > BLOCK)
        if big.isEmpty():
            done.append(now.select("node", "w", "v", "cell"))
            break
        wide = cut(beside(now.drop("reach"), sizes, "cell", F.xxhash64("node")))
        done.append(wide.where(F.col("n") <= BLOCK).select("node", "w", "v", "cell"))
        wide = wide.where(F.col("n") > BLOCK)
        nth = F.row_number().over(Window.partitionBy("cell").orderBy(F.xxhash64("node", F.lit(1)), "node"))
        some = wide.select("cell", "v", "n", "reach", nth.alias("nth")).where(F.col("nth") <= SAMPLE)
        kids = cut(some.groupBy("cell").applyInArrow(chosen, "cell string, kid int, centre binary, reach double"))
        tight = big.join(kids, "cell", "left_anti").select("cell").withColumn("tight", F.lit(True))
        wide = cut(beside(wide, sizes.select("cell").join(tight, "cell", "left"), "cell", F.xxhash64("node")))
        done.append(wide.where("tight").select("node", "w", "v", "cell"))
        chunks = F.ceil(F.col("n") / DEALT)
        left = wide.where("tight is null").select("node", "w", "v", "cell", F.pmod(F.col("node"), chunks).alias("chunk"))
        right = kids.join(big.select("cell", "n"), "cell").select("cell", "kid", "centre", F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1)).alias("chunk"))
        placed = cut(left.groupBy("cell", "chunk").cogroup(right.groupBy("cell", "chunk")).applyInArrow(dealt, "node long, w long, v binary, cell string, away double"))
        named = kids.select(F.concat_ws("/", "cell", F.col("kid").cast("string")).alias("cell"), F.col("cell").alias("parent"), "centre", "reach")
        radius = placed.groupBy("cell").agg(F.max("away").alias("radius"))
        levels.append(cut(radius.join(named, "cell")))
        now = beside(placed.drop("away"), levels[-1].select("cell", "reach"), "cell", F.xxhash64("node"))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return cut(out), [x.select("cell", "parent", "centre", "radius") for x in levels]


def near_cells(roots: DataFrame, levels: list[DataFrame], tau: float) -> DataFrame:
    """(a, b), a <= b: the pairs of cells, none cut further, that may hold vectors at most tau apart. roots: (cell)."""

    def apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            left, right = b.column("ca").to_pylist(), b.column("cb").to_pylist()
            keep = np.ones(b.num_rows, bool)
            by_dim: dict[int, list[int]] = {}
            for k, (x, y) in enumerate(zip(left, right)):
                if x is not None and y is not None:
                    by_dim.setdefault(len(x) // 8, []).append(k)
            reach = b.column("ra").to_numpy(zero_copy_only=False) + b.column("rb").to_numpy(zero_copy_only=False)
            for dim, at in by_dim.items():
                dots = (_units([left[k] for k in at], dim) * _units([right[k] for k in at], dim)).sum(1)
                keep[at] = np.sqrt(np.maximum(0, 2 - 2 * dots)) <= reach[at] + tau + SLACK
            yield b.filter(pa.array(keep))

    shape = "a string, b string, ca binary, cb binary, ra double, rb double"
    none = F.lit(None)
    pairs = roots.select(F.col("cell").alias("a"), F.col("cell").alias("b"), none.cast("binary").alias("ca"), none.cast("binary").alias("cb"), none.cast("double").alias("ra"), none.cast("double").alias("rb"))
    for level in levels:
        for side in "ab":
            kids = level.select(F.col("parent").alias("up"), F.col("cell").alias("kid"), F.col("centre").alias("kc"), F.col("radius").alias("kr"))
            both = pairs.withColumn("same", F.col("a") == F.col("b")) if side == "a" else pairs
            both = both.join(kids, F.col(side) == F.col("up"), "left")
            own = {side: F.coalesce("kid", side), f"c{side}": F.coalesce("kc", f"c{side}"), f"r{side}": F.coalesce("kr", f"r{side}")}
            pairs = both.select(*[own.get(c, F.col(c)).alias(c) for c in ("a", "b", "ca", "cb", "ra", "rb", "same")])
        pairs = cut(pairs.where("not same or a <= b").drop("same").mapInArrow(apart, shape))
    return pairs.select("a", "b")


def _pack(tree: tuple) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(tree, 5))


def _unpack(blob: bytes) -> tuple:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(blob))


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = 0.98) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each vector.

    Vectors are compared if their labels are equal and not null and they have equally many
    components. One that is null, empty, zero or holds null or non-finite components links with
    nothing, as does one with a null label: no links, its own id, kept. A null id counts as the
    largest. Repeated rows are different vectors and link. Other columns are ignored.
    Equal vectors are counted first and walk the trees as one weighted vector.
    """
    spark = vectors.sparkSession
    tau = float(np.sqrt(2 - 2 * cosine))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = []
            for v, label in zip(b.column(2).to_pylist(), b.column(1).to_pylist()):
                x = np.array(v, np.float64) if v and label is not None and None not in v else np.zeros(1)
                raw.append((x + 0.0).tobytes() if np.isfinite(x).all() and x.any() else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(raw, pa.binary())], names=["id", "label", "v"])

    source = vectors.select(F.coalesce(column(id_col).cast("long"), F.lit(NO_ID)).alias("id"), column(label_col).cast("string").alias("label"), column(vector_col).cast("array<double>").alias("v"))
    read_rows = cut(source.mapInArrow(read, "id long, label string, v binary"))
    equal = cut(read_rows.where("v is not null").groupBy("label", "v").agg(F.min("id").alias("low"), F.count("*").alias("w")))
    seed, nodes = 0, None
    while nodes is None or not nodes.groupBy("node").count().where("count > 1").isEmpty():  # vectors are named by a hash that no two share
        nodes = equal.withColumn("node", F.xxhash64(F.lit(seed), "label", "v"))
        seed += 1
    nodes = cut(nodes)
    rows = read_rows.withColumn("node", F.xxhash64(F.lit(seed - 1), "label", "v"))
    good = rows.where("v is not null")

    start = nodes.select("node", "w", "v", F.concat_ws(":", F.length("v").cast("string"), "label").alias("cell"))
    cells, levels = cut_cells(start, tau / 8)
    near = near_cells(start.select("cell").distinct(), levels, tau)
    parts = cells.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))  # over one where all are very close
    named = lambda cell, part: F.concat_ws("#", cell, F.col(part).cast("string"))
    for side in "ab":
        near = near.join(parts.select(F.col("cell").alias(side), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias(f"p{side}")), side)
    pairs = near.where("a < b or pa <= pb").select(named("a", "pa").alias("a"), named("b", "pb").alias("b"))

    def planted(rows: pa.Table) -> pa.Table:
        """A block's tree, made once."""
        raw = rows.column("v").to_pylist()
        tree = CoverTree(_units(raw, len(raw[0]) // 8), tau / 8)
        blob = _pack((tree, rows.column("node").to_numpy(), rows.column("w").to_numpy()))
        return pa.table([pa.array([rows.column("block")[0].as_py()]), pa.array([blob], pa.binary())], names=["block", "blob"])

    dealt = beside(cells, cut(parts), "cell", F.xxhash64("node")).withColumn("part", F.pmod(F.col("node"), F.col("parts")))
    blocks = cut(dealt.select("node", "w", "v", named("cell", "part").alias("block")).groupBy("block").applyInArrow(planted, "block string, blob binary"))
    # a block's tree goes once to each group of at most about GROUP of its partners, these follow it
    partners = cut(pairs.where("a < b"))
    groups = partners.groupBy("a").agg(F.ceil(F.count("*") / GROUP).alias("groups"))
    grouped = partners.join(groups, "a").withColumn("g", F.pmod(F.xxhash64("b"), F.col("groups")))
    first = blocks.join(groups, blocks.block == groups.a, "left").select("block", "blob", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("groups", F.lit(1)) - 1)).alias("g"))
    later = grouped.join(blocks, grouped.b == blocks.block).select("a", "g", F.lit(1).alias("nth"), "blob")
    meet = first.select(F.col("block").alias("a"), "g", F.lit(0).alias("nth"), "blob").unionByName(later)
    meet = meet.repartition(partitions(spark), "a", "g").sortWithinPartitions("a", "g", "nth")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = node = w = None
        for b in batches:
            for g, nth, blob in zip(b.column("g").to_pylist(), b.column("nth").to_pylist(), b.column("blob")):
                if nth == 0:
                    tree, node, w = _unpack(blob.as_py())
                    if g:  # the block's own pairs belong to its first group
                        continue
                    na, nb, edges = dual(tree, tree, w, w, cosine, True)
                    names, links = node, na + nb
                    edges = node[edges]
                else:
                    other, you, v = _unpack(blob.as_py())
                    na, nb, edges = dual(tree, other, w, v, cosine, False)
                    names, links = np.append(node, you), np.append(na, nb)
                    edges = np.column_stack([node[edges[:, 0]], you[edges[:, 1]]])
                found = forest(edges)
                some = links > 0
                left = np.append(names[some], found[:, 0])
                right = pa.array([None] * int(some.sum()) + found[:, 1].tolist(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(left), right, pa.array(np.append(links[some], np.zeros(len(found), np.int64)))], names=["a", "b", "n"])

    found = cut(meet.mapInArrow(tidy(walk), "a long, b long, n long"))
    roots = components(found.where("b is not null").select("a", "b"))
    links = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    own = cut(nodes.select("node", "low", "w").join(links, "node", "left").join(roots, "node", "left").select("node", "low", (F.col("w") - 1 + F.coalesce("n", F.lit(0))).alias("n"), F.coalesce("root", "node").alias("root")))
    least = cut(own.groupBy("root").agg(F.min("low").alias("up")).select(F.col("root").alias("node"), "up"))
    placed = cut(follow(own.select("root", "node", "n"), "root", least))  # root is now the least id
    packed = placed.select("node", F.struct("root", "n").alias("up"))
    valid = _attach(cut(good.select("node", "id")), packed)
    rest = rows.where("v is null").select("id", F.col("id").alias("root"), F.lit(0).cast("long").alias("n"))
    return valid.unionByName(rest).select(shown_id().alias("vec_id"), F.col("n").alias("n_links"), shown_id("root").alias("component_id"), (F.col("id") == F.col("root")).alias("kept"))


def _attach(rows: DataFrame, table: DataFrame) -> DataFrame:
    roots = table.select("node", F.col("up.root").alias("up"))
    counts = table.select("node", F.col("up.n").alias("up"))
    first = cut(follow(rows.select("node", "id", F.col("node").alias("key")), "node", roots).select("key", "id", F.col("node").alias("root")))
    return follow(first, "key", counts).select("id", "root", F.col("key").alias("n"))
