"""Centroid clustering of whole-number vectors: Lloyd's rounds, exact, with Yinyang bounds."""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaestor.llm.packs import batch
from quaestor.llm.storage import discard, written

SCALE = 64
#: Components beyond this could have distances that no long holds.
LARGEST = 1 << 27
_PLAIN = 1 << 20  # components up to this have exact products in doubles
_FAR = np.iinfo(np.int64).max
SLACK = 1e-9  # of a bound, relative: bounds are doubles, so a centroid as near as another is looked at
STATE_SCHEMA = "vec_id long, components binary, cluster int, upper double, lower binary"
SUMS_SCHEMA = "cluster int, n long, sums array<long>"
OUT_SCHEMA = "vec_id long, cluster int, distance long"


def whole_vectors(vectors: DataFrame, size: int, scale: int = SCALE) -> DataFrame:
    """vec_id, components (a list of longs): floor(scale * x) of each component of the vectors with exactly ``size`` components.

    Left out: null vectors, those of another length, with a null or non-finite component, or with one beyond LARGEST
    (its distances would fit no long).
    """
    x = F.transform("embedding", lambda v: F.floor(F.lit(scale) * v.cast("double")))
    fine = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) <= LARGEST / scale))
    return vectors.filter((F.size("embedding") == size) & fine).select(F.col("vec_id").cast("long"), x.alias("components"))


def _narrow(x: np.ndarray) -> bytes:
    """Components in as few bytes as they need; the length tells how many."""
    most = int(np.abs(x).max(initial=0))
    return x.astype(np.int8 if most < 128 else np.int16 if most < 1 << 15 else np.int32).tobytes()


def _wide(data: bytes, size: int) -> np.ndarray:
    return np.frombuffer(data, {1: np.int8, 2: np.int16, 4: np.int32}[len(data) // size] if size else np.int8).astype(np.int64)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of each row of x to each row of c (both int64)."""
    most = max(np.abs(x).max(initial=0), np.abs(c).max(initial=0))
    if most <= _PLAIN and x.shape[1] * most * most < 1 << 50:
        dot = (x.astype(float) @ c.astype(float).T).astype(np.int64)
        return (x * x).sum(1)[:, None] - 2 * dot + (c * c).sum(1)[None, :]
    return np.stack([((x - y) ** 2).sum(1) for y in c], 1) if len(c) else np.empty((len(x), 0), np.int64)


def grouped_centroids(centroids: np.ndarray, groups: int, rounds: int = 5) -> np.ndarray:
    """A group for each centroid, by a few rounds of clustering them; done once. It bears on speed only."""
    centres = centroids[np.linspace(0, len(centroids) - 1, groups).astype(int)].astype(float)
    for _ in range(rounds):
        of = ((centroids[:, None, :] - centres[None]) ** 2).sum(2).argmin(1)
        for g in range(groups):
            if (of == g).any():
                centres[g] = centroids[of == g].mean(0)
    return of


def _first(x: np.ndarray, c: np.ndarray, of: np.ndarray, groups: int):
    """cluster, upper, lower: by comparing all. lower[g]: the distance to the nearest centroid of group g, the own one left out."""
    d = squared(x, c)
    own = d.argmin(1)  # the first of equally near ones
    upper = np.sqrt(d[np.arange(len(x)), own].astype(float))
    rest = np.sqrt(d.astype(float))
    rest[np.arange(len(x)), own] = np.inf
    lower = np.stack([rest[:, of == g].min(1, initial=np.inf) for g in range(groups)], 1) if len(x) else np.empty((0, groups))
    return own, upper, lower


def _next(x, own, upper, lower, c, before, of, groups):
    """The same after centroids moved from ``before`` to c: filtered for the whole row, then by group, then compared."""
    drift = np.sqrt(((c - before).astype(float) ** 2).sum(1))
    fall = np.array([drift[of == g].max(initial=0.0) for g in range(groups)])
    own, upper, lower = own.copy(), upper + drift[own], lower - fall
    sure = lower.min(1) > upper * (1 + SLACK) + SLACK
    left = np.flatnonzero(~sure)
    exact = ((x[left] - c[own[left]]) ** 2).sum(1)
    upper[left] = np.sqrt(exact.astype(float))
    near = lower[left] <= (upper[left] * (1 + SLACK) + SLACK)[:, None]
    open_ = near.any(1)
    left, exact, near, old = left[open_], exact[open_], near[open_], own[left[open_]]
    d = np.full((len(left), len(c)), _FAR)
    for g in range(groups):
        rows, which = np.flatnonzero(near[:, g]), np.flatnonzero(of == g)
        d[np.ix_(rows, which)] = squared(x[left[rows]], c[which])
    all_left = np.arange(len(left))
    d[all_left, old] = exact
    new = d.argmin(1)  # the first of equally near ones
    upper[left] = np.sqrt(d[all_left, new].astype(float))
    d[all_left, new] = _FAR
    for g in range(groups):  # a group that was looked at has new bounds; in another one only the former own centroid can be nearer than its bound
        near_most = d[:, of == g].min(1, initial=_FAR)
        found = np.where(near_most == _FAR, np.inf, np.sqrt(near_most.astype(float)))
        lower[left, g] = np.where(near[:, g], found, np.minimum(lower[left, g], found))
    own[left] = new
    return own, upper, lower


def assigned(state: DataFrame, centroids: np.ndarray, before: np.ndarray | None, of: np.ndarray) -> DataFrame:
    """Rows of STATE_SCHEMA after an assignment to the centroids, from vectors (before: None) or from the state of the last assignment, to ``before``."""
    groups, size = int(of.max()) + 1, centroids.shape[1]

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            ids = b.column(0).to_pylist()
            if before is None:
                x = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, size)
                own, upper, lower = _first(x, centroids, of, groups)
                packed = [_narrow(v) for v in x]
            else:
                packed = b.column(1).to_pylist()
                x = np.stack([_wide(v, size) for v in packed])
                lower = np.frombuffer(b"".join(b.column(4).to_pylist()), np.float64).reshape(-1, groups)
                own, upper, lower = _next(x, b.column(2).to_numpy().astype(np.int64), b.column(3).to_numpy(), lower, centroids, before, of, groups)
            yield batch(STATE_SCHEMA, list(zip(ids, packed, own.tolist(), upper.tolist(), [v.tobytes() for v in lower])))

    return state.mapInArrow(run, STATE_SCHEMA)


def moved(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Centroids at the floor of their vectors' mean; one without vectors stays. Only sums by task and cluster are shuffled; one row a cluster reaches the driver."""
    size = centroids.shape[1]

    def run(batches):
        n, total = np.zeros(len(centroids), np.int64), [0] * len(centroids)
        for b in batches:
            own = b.column(1).to_numpy()
            x = np.array([_wide(v, size) for v in b.column(0).to_pylist()]).reshape(-1, size)
            for c in np.unique(own):
                n[c] += (own == c).sum()
                total[c] = total[c] + x[own == c].sum(0)
        yield batch(SUMS_SCHEMA, [(c, int(n[c]), total[c].tolist()) for c in range(len(centroids)) if n[c]])

    parts = state.select("components", "cluster").mapInArrow(run, SUMS_SCHEMA)
    sums = [F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(size)]
    after = centroids.copy()
    for row in parts.groupBy("cluster").agg(F.sum("n").alias("n"), *sums).collect():
        after[row.cluster] = [int(row[f"s{i}"]) // row.n for i in range(size)]
    return after


def distances(state: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster, distance: exact, to the own centroid."""
    size = centroids.shape[1]

    def run(batches):
        for b in batches:
            own = b.column(2).to_numpy()
            x = np.array([_wide(v, size) for v in b.column(1).to_pylist()]).reshape(-1, size)
            far = ((x - centroids[own]) ** 2).sum(1)
            yield batch(OUT_SCHEMA, list(zip(b.column(0).to_pylist(), own.tolist(), far.tolist())))

    return state.select("vec_id", "components", "cluster").mapInArrow(run, OUT_SCHEMA)


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, size: int = 64, scale: int = SCALE, seed: int = 1, groups: int | None = None) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, centroid of each vector kept of vectors (vec_id, embedding).

    Lloyd's rounds over whole_vectors: ``rounds`` times each vector goes to its nearest centroid (squared Euclidean distance, ties to the smaller
    number) and centroids to the floor of their vectors' mean; then vectors are assigned once more. Centroids start as the k vectors with the smallest sha256 of
    ``seed:vec_id``; fewer, if there are fewer vectors. Results are exact and the same for any partitioning.

    Yinyang: centroids are put into ``groups`` (a fourth of them unless given) once. Each vector keeps an upper bound of the distance to its own
    centroid and, for each group, a lower bound of the distance to all others of it. Centroids' moves loosen the bounds; a vector whose
    least lower bound is above its upper bound is done without a look at any centroid, else groups are left out in the same way, and the
    centroids of the remaining ones are compared. State is a table written each round, partitioned as the vectors are read:
    no vector is shuffled, whatever the size of a cluster. On the driver and in each task are k centroids, a parameter.

    Null vec_id: sorts last among the starts. Rows with equal vec_id are vectors of their own (as starts, in the order of their components). Repeated rows
    count as often as they occur; centroids may be equal then, and all but the first of them stay empty. An empty table gives an empty result; inertias that no long holds are null. Other columns aren't read.
    """
    rows = whole_vectors(vectors, size, scale)
    order = [F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256).asc_nulls_last(), F.col("components")]
    starts = rows.orderBy(*order).limit(k).select("components").collect()
    if not starts:
        return rows.selectExpr("vec_id", "0 AS cluster", "vec_id AS distance", "vec_id AS cluster_inertia", "vec_id AS inertia", "'' AS centroid_sha256", "components AS centroid").filter("false")
    centroids = np.array([r.components for r in starts], np.int64).reshape(len(starts), size)
    of = grouped_centroids(centroids, groups or max(1, math.ceil(len(starts) / 4)))
    state = written(assigned(rows, centroids, None, of))
    for _ in range(rounds):
        after = moved(state, centroids)
        last, state = state, written(assigned(state, after, centroids, of))
        discard(last)
        centroids = after
    out = written(distances(state, centroids))
    discard(state)
    exact = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    inertia = out.groupBy("cluster").agg(exact("distance").alias("i"))
    total = inertia.agg(F.sum("i").try_cast("long").alias("inertia"))
    named = [(c, hashlib.sha256(",".join(map(str, v)).encode()).hexdigest(), v) for c, v in enumerate(centroids.tolist())]
    known = vectors.sparkSession.createDataFrame(named, "cluster int, centroid_sha256 string, centroid array<long>").join(inertia, "cluster", "left").crossJoin(total)
    known = known.select("cluster", F.col("i").try_cast("long").alias("cluster_inertia"), "inertia", "centroid_sha256", "centroid")
    return out.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "centroid")


def op12_centroid_clustering(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return cluster(rows).drop("centroid")


def _sql(rounds: int = 3) -> str:
    near = """a{r} AS (SELECT id, vec_id, x, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS d FROM (
    SELECT v.id, v.vec_id, v.x, c.cluster, list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM v CROSS JOIN c{r} c) GROUP BY id, vec_id, x)"""
    mean = """c{n} AS (SELECT c.cluster, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN (
    SELECT cluster, list(s ORDER BY i) AS x FROM (SELECT cluster, i, floor(sum(x[i])::DOUBLE / count(*))::BIGINT AS s FROM a{r}, range(1, 65) t(i) GROUP BY cluster, i) GROUP BY cluster) m USING (cluster))"""
    steps = [f"{near.format(r=r)},\n{mean.format(r=r, n=r + 1)}" for r in range(rounds)]
    return f"""
WITH e AS (SELECT row_number() OVER () AS id, vec_id, embedding FROM embeddings WHERE len(embedding) = 64),
v AS (SELECT id, vec_id, list_transform(embedding, lambda y: floor(64 * y::DOUBLE)::BIGINT) AS x FROM e
      WHERE len(list_filter(embedding, lambda y: y IS NOT NULL AND isfinite(y))) = 64),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id::VARCHAR) NULLS LAST, x) - 1 AS cluster, x FROM v QUALIFY cluster < 16),
{",\n".join(steps)},
{near.format(r=rounds)}
SELECT vec_id, cluster::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} c USING (cluster)
"""


SQL = _sql()
