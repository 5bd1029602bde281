"""Embedding near-dedup: a random-projection tree forest with spill, exact comparison within leaves, and union.

The forest is fitted level by level on all vectors: a pass sums, for each node, how many vectors it has and their projections' mean and variance, and nodes
of more than LEAF vectors are split near the mean. A model is a few numbers for each node, so about as many rows as there are leaves
reach the driver; vectors move only to be compared.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaestor.llm.components import components
from quaestor.llm.packs import batch, mixed
from quaestor.llm.spread import spread_join
from quaestor.llm.storage import discard, written

COSINE = 0.9
TREES = 4
LEAF = 2048
SPILL = 0.2  # of a node's spread to each side of its cut: vectors there go to both children
WANDER = 0.4  # of a node's spread by which a cut is at most off the mean
LEVELS = 48
#: Nodes of a tree; a larger model isn't sent to tasks, leaves stay larger instead and are compared in blocks.
NODES = 1 << 18
#: A node of less variance than this is nearly one bundle of close vectors (all spread out: 1).
TIGHT = 0.1
MERGE = math.radians(5)  # centres of tight nodes nearer than this are one
STATS_SCHEMA = "tree int, node long, n long, total double, squares double"
CENTRE_SCHEMA = "node long, size int, n long, total array<double>"
MEMBER_SCHEMA = "node long, ball long, w long"
FOUND_SCHEMA = "sid long, node long, links long, root long"


@dataclass
class Tree:
    """Nodes as arrays; left is the first of two children, or -1. Node 0 is the root."""

    left: list[int] = field(default_factory=lambda: [-1])
    cut: list[float] = field(default_factory=lambda: [0.0])
    margin: list[float] = field(default_factory=lambda: [0.0])
    level: list[int] = field(default_factory=lambda: [0])
    count: list[int] = field(default_factory=lambda: [0])
    variances: list[list[float]] = field(default_factory=lambda: [[]])
    open: set[int] = field(default_factory=lambda: {0})

    def split(self, node: int, cut: float, margin: float) -> None:
        self.left[node], self.cut[node], self.margin[node] = len(self.left), cut, margin
        for _ in range(2):
            self.open.add(len(self.left))
            for values, value in ((self.left, -1), (self.cut, 0.0), (self.margin, 0.0), (self.level, self.level[node] + 1), (self.count, 0), (self.variances, self.variances[node][-2:])):
                values.append(list(value) if isinstance(value, list) else value)

    def arrays(self) -> tuple[np.ndarray, ...]:
        return np.array(self.left), np.array(self.cut), np.array(self.margin), np.array(self.level)


@dataclass
class Forest:
    seed: int
    leaf: int
    bound: float  # of the cosine of linked vectors
    trees: list[Tree]
    balls: dict[int, int] = field(default_factory=dict)  # of tight nodes of the first tree
    centres: list[np.ndarray] = field(default_factory=list)  # of balls
    main: list[dict[int, int]] = field(default_factory=list)  # of each tree: the ball that most of a tight node is in

    def __post_init__(self):
        self._directions: dict[tuple[int, int, int], np.ndarray] = {}
        self._arrays = None

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("_directions", "_arrays")} | {"_directions": {}, "_arrays": None}

    def direction(self, tree: int, level: int, size: int) -> np.ndarray:
        key = (tree, level, size)
        if key not in self._directions:
            self._directions[key] = np.random.default_rng([self.seed, tree, level, size]).standard_normal(size)
        return self._directions[key]

    def route(self, x: np.ndarray, tree: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, node): the nodes without children that each unit vector reaches, by row and node."""
        if self._arrays is None:
            self._arrays = [t.arrays() for t in self.trees]
        left, cut, margin, level = self._arrays[tree]
        rows, nodes, done = np.arange(len(x)), np.zeros(len(x), np.int64), []
        while len(rows):
            ends = left[nodes] < 0
            done.append((rows[ends], nodes[ends]))
            rows, nodes = rows[~ends], nodes[~ends]
            if not len(rows):
                break
            p = x[rows] @ self.direction(tree, int(level[nodes[0]]), x.shape[1])
            to_left, to_right = p < cut[nodes] + margin[nodes], p >= cut[nodes] - margin[nodes]
            rows = np.concatenate([rows[to_left], rows[to_right]])
            nodes = np.concatenate([left[nodes[to_left]], left[nodes[to_right]] + 1])
        rows, nodes = (np.concatenate(part) for part in zip(*done)) if done else (np.empty(0, np.int64),) * 2
        order = np.lexsort((nodes, rows))
        return rows[order], nodes[order]

    def ball(self, x: np.ndarray) -> np.ndarray:
        """The ball of each unit vector, -1 for none. Two vectors within half the angle of a link of one centre are linked: nothing needs to be compared."""
        out = np.full(len(x), -1, np.int64)
        if not self.balls:
            return out
        half = math.cos(math.acos(self.bound) / 2 - 1e-9)
        rows, nodes = self.route(x, 0)
        for node in np.unique(nodes):
            b = self.balls.get(int(node))
            if b is not None and len(self.centres[b]) == x.shape[1]:
                at = rows[nodes == node]
                near = at[x[at] @ self.centres[b] >= half]
                out[near] = np.where(out[near] < 0, b, np.minimum(out[near], b))
        return out


def unit(values: np.ndarray) -> np.ndarray:
    """Rows of length 1; very large or small ones are scaled before they are squared."""
    top = np.abs(values).max(1, initial=0)[:, None]
    values = np.where((top > 1e100) | (top < 1e-100), values / np.where(top == 0, 1, top), values)
    return values / np.linalg.norm(values, axis=1)[:, None]


def _by_size(column: pa.Array):
    """(rows, unit vectors) for each length among a column of lists."""
    sizes = column.value_lengths().to_numpy()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    begin = np.cumsum(sizes) - sizes
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        yield rows, unit(flat[begin[rows][:, None] + np.arange(size)[None]])


# --- fitting ----------------------------------------------------------------------------------------------------------


def _level_stats(vectors: DataFrame, forest: Forest) -> list:
    """tree, node, n, total, squares of the projections of each open node's vectors."""

    def run(batches):
        sums: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            for _, x in _by_size(b.column(0)):
                for t, tree in enumerate(forest.trees):
                    rows, nodes = forest.route(x, t)
                    open_ = np.isin(nodes, list(tree.open))
                    rows, nodes = rows[open_], nodes[open_]
                    if not len(rows):
                        continue
                    p = x[rows] @ forest.direction(t, tree.level[nodes[0]], x.shape[1])
                    found, place = np.unique(nodes, return_inverse=True)
                    parts = [np.bincount(place, minlength=len(found)), np.bincount(place, p, len(found)), np.bincount(place, p * p, len(found))]
                    for node, part in zip(found.tolist(), np.array(parts).T):
                        sums[t, node] = sums.get((t, node), 0) + part
        yield batch(STATS_SCHEMA, [(t, node, int(v[0]), float(v[1]), float(v[2])) for (t, node), v in sums.items()])

    parts = vectors.select("vec").mapInArrow(run, STATS_SCHEMA)
    return parts.groupBy("tree", "node").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum("squares").alias("squares")).collect()


def _centre_sums(vectors: DataFrame, forest: Forest, tree: int, nodes: set[int], near: dict[int, np.ndarray] | None = None) -> dict[int, np.ndarray]:
    """The mean direction of the vectors at each of the nodes (of the most frequent length), of those not far from ``near`` if given."""
    half = math.cos(0.6 * math.acos(forest.bound))

    def run(batches):
        sums: dict[tuple[int, int], list] = {}
        for b in batches:
            for _, x in _by_size(b.column(0)):
                rows, at = forest.route(x, tree)
                for node in np.unique(at):
                    if int(node) in nodes:
                        chosen = x[rows[at == node]]
                        centre = None if near is None else near.get(int(node))
                        if centre is not None and len(centre) == x.shape[1]:
                            chosen = chosen[chosen @ centre >= half]
                        held = sums.setdefault((int(node), x.shape[1]), [0, 0.0])
                        held[0] += len(chosen)
                        held[1] = held[1] + chosen.sum(0)
        yield batch(CENTRE_SCHEMA, [(node, size, n, total.tolist()) for (node, size), (n, total) in sums.items() if n])

    parts = vectors.select("vec").mapInArrow(run, CENTRE_SCHEMA).select("node", "size", "n", F.posexplode("total").alias("i", "x"))
    sums = parts.groupBy("node", "size", "i").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    out: dict[int, tuple[int, np.ndarray]] = {}
    for r in sums.groupBy("node", "size").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v")).collect():
        v = np.array([x.x for x in r.v])
        if r.n > out.get(r.node, (0, None))[0] and np.linalg.norm(v) > 0:
            out[r.node] = (r.n, v / np.linalg.norm(v))
    return {node: v for node, (_, v) in out.items()}


def fitted(vectors: DataFrame, bound: float = COSINE, trees: int = TREES, leaf: int = LEAF, spill: float = SPILL, seed: int = 11) -> Forest:
    """A forest over all rows of vectors (vec: arrays of finite numbers, not all 0)."""
    forest = Forest(seed, leaf, bound, [Tree() for _ in range(trees)])
    tight: list[set[int]] = [set() for _ in range(trees)]
    while any(t.open for t in forest.trees):
        stats = _level_stats(vectors, forest)
        found = {(r.tree, r.node): r for r in stats}
        forest._arrays = None
        for t, tree in enumerate(forest.trees):
            for node in sorted(tree.open):
                tree.open.discard(node)
                r = found.get((t, node))
                if r is None:
                    continue
                mean = r.total / r.n
                variance = max(0.0, r.squares / r.n - mean * mean)
                before = tree.variances[node]
                tree.count[node], tree.variances[node] = r.n, [*before, variance][-3:]
                spread = sum(tree.variances[node]) / len(tree.variances[node])
                if r.n <= leaf:
                    continue
                thinned = before and variance < 0.8 * before[-1]
                if spread < TIGHT and (r.n * spread <= leaf or not thinned):
                    tight[t].add(node)
                elif tree.level[node] < LEVELS and len(tree.left) < NODES and variance > 0:
                    u = np.random.default_rng([seed, t, node]).uniform(-WANDER, WANDER)
                    tree.split(node, mean + u * math.sqrt(variance), spill * math.sqrt(variance))
    forest._arrays = None
    forest.main = [{} for _ in forest.trees]
    if tight[0]:
        rough = _centre_sums(vectors, forest, 0, tight[0])
        exact = rough | _centre_sums(vectors, forest, 0, tight[0], rough)
        for node in sorted(exact, key=lambda n: (-forest.trees[0].count[n], n)):
            of = next((i for i, c in enumerate(forest.centres) if len(c) == len(exact[node]) and c @ exact[node] >= math.cos(MERGE)), None)
            if of is None:
                of = len(forest.centres)
                forest.centres.append(exact[node])
            forest.balls[node] = of
        forest.main[0] = dict(forest.balls)
        for t in range(1, trees):
            for node, centre in (_centre_sums(vectors, forest, t, tight[t]) if tight[t] else {}).items():
                same = [i for i, c in enumerate(forest.centres) if len(c) == len(centre)]
                if same:
                    forest.main[t][node] = max(same, key=lambda i: forest.centres[i] @ centre)
    return forest


# --- comparing --------------------------------------------------------------------------------------------------------


def _placed(rows: np.ndarray, nodes: np.ndarray, ids: np.ndarray, balls: np.ndarray, tree: Tree, main: dict[int, int], leaf: int):
    """(row, node, part, side, inner): where each vector is compared.

    A leaf is one part. A tight node's main ball is cut into parts, which all others of the node come to. Another node of too many
    vectors is compared block by block. Vectors of different sides meet, those of one side if they are inner.
    """
    parts = np.maximum(1, -(-np.array(tree.count)[nodes] // leaf))
    block = (mixed(ids[rows].astype(np.uint64)) % parts.astype(np.uint64)).astype(np.int64)
    of_main = np.array([main.get(n, -2) for n in nodes.tolist()], np.int64)
    bundle, in_main = of_main >= 0, (of_main >= 0) & (balls[rows] == of_main)
    copies = np.where(in_main, 1, parts)
    at = np.repeat(np.arange(len(rows)), copies)
    j = np.arange(len(at)) - np.repeat(np.cumsum(copies) - copies, copies)
    b, n = block[at], parts[at]
    part = np.where(bundle[at], np.where(in_main[at], b, j), np.minimum(b, j) * n + np.maximum(b, j))
    side = np.where(bundle[at], in_main[at], b > j).astype(np.int32)
    inner = np.where(bundle[at], ~in_main[at] & (j == 0), b == j)
    return rows[at], nodes[at], part, side, inner


def _padded(rows: np.ndarray, nodes: np.ndarray, n: int) -> np.ndarray:
    """Nodes of each row, in a table filled up with -1."""
    counts = np.bincount(rows, minlength=n)
    out = np.full((n, max(1, counts.max(initial=0))), -1, np.int64)
    out[rows, np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)] = nodes
    return out


def _labels(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least index of each vertex's component."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _compared(table: pa.Table, forest: Forest, tree: int, rows_at_once: int = 512) -> pa.Table:
    leaf = table.column("leaf")[0].as_py()
    ids, weight, balls, side = (table.column(c).to_numpy() for c in ("node", "w", "ball", "side"))
    inner = table.column("inner").to_numpy()
    out = []
    for at, x in _by_size(table.column("vec").combine_chunks()):
        order = np.argsort(ids[at])
        at, x = at[order], x[order]
        reached = [_padded(*forest.route(x, t), len(x)) for t in range(tree + 1)]
        links, first, second = np.zeros(len(x), np.int64), [], []
        ball, s, own = balls[at], side[at], inner[at]
        for lo in range(0, len(x), rows_at_once):
            near = x[lo : lo + rows_at_once] @ x[lo:].T >= forest.bound
            i, j = np.nonzero(near)
            i, j = i[j > i] + lo, j[j > i] + lo
            fit = ((s[i] != s[j]) | own[i]) & ((ball[i] < 0) | (ball[i] != ball[j]))
            i, j = i[fit], j[fit]
            for t, nodes in enumerate(reached):  # a pair counts in the first leaf that it shares
                a, b = nodes[i], nodes[j]
                same = (a[:, :, None] == b[:, None, :]) & (a >= 0)[:, :, None]
                shared = np.where(same.any(2), a, np.iinfo(np.int64).max).min(1, initial=np.iinfo(np.int64).max)
                fit = shared == (leaf if t == tree else np.iinfo(np.int64).max)
                i, j = i[fit], j[fit]
            np.add.at(links, i, weight[at[j]])
            np.add.at(links, j, weight[at[i]])
            first.append(i)
            second.append(j)
        label = _labels(np.concatenate(first), np.concatenate(second), len(x))
        sid = np.where(ball < 0, ids[at], -2 - ball)
        for k in np.flatnonzero(links).tolist():
            out.append((int(sid[k]), int(ids[at[k]]), int(links[k]), int(sid[label[k]])))
    return pa.Table.from_batches([batch(FOUND_SCHEMA, out)])


def _found(vectors: DataFrame, forest: Forest, tree: int) -> DataFrame:
    """sid, node, links, root: what the leaves of one tree add."""
    kind = dict(vectors.dtypes)["vec"]
    schema = f"leaf long, part long, node long, w long, ball long, side int, inner boolean, vec {kind}"

    def deal(batches):
        for b in batches:
            ids, weight = b.column(0).to_numpy(), b.column(1).to_numpy()
            for at, x in _by_size(b.column(2)):
                balls = forest.ball(x)
                rows, nodes = forest.route(x, tree)
                rows, nodes, part, side, inner = _placed(rows, nodes, ids[at], balls, forest.trees[tree], forest.main[tree], forest.leaf)
                where = at[rows]
                columns = [nodes, part, ids[where], weight[where], balls[rows], side, inner]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), b.column(2).take(pa.array(where))], names=["leaf", "part", "node", "w", "ball", "side", "inner", "vec"])

    dealt = vectors.select("node", "w", "vec").mapInArrow(deal, schema)
    return dealt.groupBy("leaf", "part").applyInArrow(lambda t: _compared(t, forest, tree), FOUND_SCHEMA)


def _members(vectors: DataFrame, forest: Forest) -> DataFrame:
    """node, ball, w of the vectors in balls."""

    def run(batches):
        for b in batches:
            ids, weight = b.column(0).to_numpy(), b.column(1).to_numpy()
            for at, x in _by_size(b.column(2)):
                balls = forest.ball(x)
                yield batch(MEMBER_SCHEMA, [(int(ids[at[k]]), int(balls[k]), int(weight[at[k]])) for k in np.flatnonzero(balls >= 0)])

    return vectors.select("node", "w", "vec").mapInArrow(run, MEMBER_SCHEMA)


def near_duplicates(vectors: DataFrame, bound: float = COSINE, trees: int = TREES, leaf: int = LEAF, spill: float = SPILL, seed: int = 11) -> DataFrame:
    """vec_id, n_links, component_id, kept of each row of vectors (vec_id, embedding).

    Rows link if the cosine of their vectors, in doubles, is at least ``bound``; only pairs that were found are compared, and only linked ones count. n_links:
    other rows linked directly. component_id: the least vec_id reachable by links. kept: vec_id is that one.

    1. Equal vectors (by 128 bits of hash) are one vertex with a weight, before anything is compared.
    2. The forest: each of ``trees`` trees cuts nodes of more than ``leaf`` vectors by random directions; vectors near a cut go to both sides.
       A pair is found if it shares a leaf of any tree; it counts in the first leaf that it shares, which both vectors' paths tell.
    3. Bundles of close vectors, which no cut thins out, are balls around a centre. Members within half the angle of a link of the centre
       are all linked with each other, whatever their number: they are counted, not compared.
       All others of such a node are compared with each member. No list of pairs is made anywhere: a leaf gives sums and a spanning tree.
    4. Balls and vectors are joined to components.

    Null vectors, those with a null or non-finite component, empty or zero ones: no links, own component. Vectors of different lengths don't
    link. Null vec_id: such a row links like others, but its id is no component's name unless there is no other (kept is true then).
    Repeated rows link with each other. An empty table gives an empty result. Other columns aren't read.
    """
    kind = dict(vectors.dtypes)["embedding"]
    vec = F.col("embedding") if kind == "array<float>" else F.col("embedding").cast("array<double>")
    fine = F.forall(vec, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))) & F.exists(vec, lambda v: v != 0)
    rows = vectors.select(F.col("vec_id").cast("long"), vec.alias("vec"), F.coalesce(fine, F.lit(False)).alias("fine"))
    keys = [F.xxhash64("vec").alias("k1"), F.xxhash64(F.lit(1), "vec").alias("k2")]
    vertices = rows.filter("fine").select("vec_id", "vec", *keys).groupBy("k1", "k2")
    vertices = written(vertices.agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("w"), F.first("vec").alias("vec")).withColumn("node", F.monotonically_increasing_id()))
    forest = fitted(vertices, bound, trees, leaf, spill, seed)
    found = [written(_found(vertices, forest, t), release=True) for t in range(trees)]
    members = written(_members(vertices, forest))
    balls = written(members.groupBy("ball").agg(F.sum("w").alias("ball_w")))

    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    links = every.groupBy("node").agg(F.sum("links").alias("links"))
    edges = written(every.select(F.col("sid").alias("a"), F.col("root").alias("b")).filter("a != b").distinct())
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).union(balls.select(-2 - F.col("ball"))).distinct()
    label = components(nodes, edges)

    # Balls are fewer than the forest's nodes, which the driver holds; so they may be broadcast.
    of_ball = F.broadcast(balls.join(label.withColumnRenamed("node", "sid"), F.col("sid") == -2 - F.col("ball")).select("ball", "ball_w", F.col("label").alias("ball_label")))
    known = vertices.select("node", "k1", "k2", "w", "least").join(members.select("node", "ball"), "node", "left").join(of_ball, "ball", "left")
    known = known.join(links, "node", "left").join(label, "node", "left")
    known = written(known.select(
        "node", "k1", "k2", "least", F.coalesce("ball_label", "label").alias("label"),
        (F.col("w") - 1 + F.coalesce(F.col("ball_w") - F.col("w"), F.lit(0)) + F.coalesce("links", F.lit(0))).alias("n_links"),
    ))
    named = written(known.filter("label is not null").groupBy("label").agg(F.min("least").alias("component_id")))
    together = spread_join(known.filter("label is not null"), named, ["label"], "node").select("k1", "k2", "n_links", "component_id")
    alone = known.filter("label is null").select("k1", "k2", "n_links", F.col("least").alias("component_id"))
    result = written(together.unionByName(alone))
    linked = spread_join(rows.filter("fine").select("vec_id", *keys).withColumn("row", F.monotonically_increasing_id()), result, ["k1", "k2"], "row")
    rest = rows.filter("not fine").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = linked.select("vec_id", "n_links", "component_id").unionByName(rest)
    out = written(out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))))
    discard(vertices, *found, members, balls, edges, label, known, named, result)
    return out


def op11_embedding_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


SQL = """
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS r, vec_id, embedding::DOUBLE[] AS x FROM embeddings
  WHERE len(list_filter(embedding, lambda y: y IS NOT NULL AND isfinite(y))) = len(embedding) AND len(list_filter(embedding, lambda y: y != 0)) > 0),
e AS (SELECT a.r AS a, b.r AS b FROM v a JOIN v b ON a.r != b.r AND len(a.x) = len(b.x) AND
      list_inner_product(a.x, b.x) / sqrt(list_inner_product(a.x, a.x) * list_inner_product(b.x, b.x)) >= 0.9),
n AS (SELECT a AS r, count(*) AS n FROM e GROUP BY a),
t AS (SELECT r, r AS c FROM v UNION SELECT e.b, t.c FROM t JOIN e ON e.a = t.r),
c AS (SELECT t.r, min(v.vec_id) AS component_id FROM t JOIN v ON v.r = t.c GROUP BY t.r)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept FROM v JOIN c USING (r) LEFT JOIN n USING (r)
UNION ALL
SELECT vec_id, 0, vec_id, true FROM embeddings
WHERE embedding IS NULL OR NOT (len(list_filter(embedding, lambda y: y IS NOT NULL AND isfinite(y))) = len(embedding) AND len(list_filter(embedding, lambda y: y != 0)) > 0)
"""
