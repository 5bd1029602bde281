"""An approximate vector index: inverted lists by centroids, kept as a table, searched by the lists nearest to each query.

The centroids are fitted on a bounded sample; every vector is in the index. How many lists a search looks at is set by measurement: a sample of the
rows is searched exactly and by the index, and the fewest lists with the wanted recall are taken. ``nearest_each`` remains the exact way.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaestor.functions.columns import col
from quaestor.operators.retrieval import BEST_SCHEMA, _blocks, best, matrix, nearest_each, placed
from quaestor.sources.shared import shared_dir

#: Rows that centroids are fitted on, at most; and rows whose searches are measured.
SAMPLE, MEASURED = 20_000, 200
LISTS = (1, 4096)  # at least and at most; in between, the root of the number of rows
BLOCK = 1024
#: Rows of queries (one for each list that it looks at) that are sent to each task, at most; more meet the lists by shuffle. SALTS: parts that a list is written in.
BROADCAST_QUERIES, SALTS = 20_000, 16


def _unit(v: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(v, axis=1, keepdims=True)
    return v / np.where(size == 0, 1, size)


def _fit(x: np.ndarray, k: int, seed: int, rounds: int = 8) -> np.ndarray:
    """k directions, by a few rounds of clustering unit vectors."""
    centres = x[np.random.default_rng(seed).choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = (x @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres = np.where(np.linalg.norm(sums, axis=1, keepdims=True) > 0, _unit(sums), centres)
    return centres


@dataclass
class VectorIndex:
    spark: SparkSession
    path: str
    fingerprint: str
    centres: np.ndarray
    probes: int
    recall: float

    # --- making

    @classmethod
    def build(
        cls, vectors: DataFrame, ids: str = "vec_id", vector: str = "embedding", path: str | None = None, fingerprint: str = "", lists: int | None = None, recall: float = 0.95, k: int = 5, seed: int = 5,
    ) -> VectorIndex:
        """Indexes every row that has an id and a vector. Vectors must be equally long, without nulls. A table of none gives an index that finds nothing.

        path: where the index is kept; a folder of its own in the shared one unless given. recall: the share of the exact k nearest that searches of sampled rows must find.
        """
        spark = vectors.sparkSession
        rows = vectors.select(col(ids).cast("long").alias("id"), col(vector).cast("array<double>").alias("v")).filter("id is not null and v is not null")
        n = rows.count()
        part = rows.select("v").sample(min(1.0, 1.2 * SAMPLE / max(n, 1)), seed).limit(SAMPLE) if n > SAMPLE else rows.select("v")
        sample = _unit(np.array([r.v for r in part.collect()], float).reshape(-1, len((rows.head() or {"v": [0.0]})["v"])))
        count = min(max(LISTS[0], lists or round(n**0.5)), LISTS[1], max(1, len(sample)))
        centres = _fit(sample, count, seed) if len(sample) else np.zeros((1, sample.shape[1]))
        path = path or f"{shared_dir(spark)}/vectors/{uuid.uuid4().hex}"
        out = cls(spark, path, fingerprint, centres, count, 1.0)
        listed = rows.mapInArrow(out._assigned(), "list int, id long, v array<double>")
        # Lists of any size are cut into blocks where they are found; a block is a row.
        listed.repartition("list", F.pmod("id", F.lit(SALTS))).sortWithinPartitions("list").mapInArrow(_blocked, _BLOCKS).write.partitionBy("list").mode("overwrite").parquet(path + "/lists")
        if n:
            out._tune(rows, n, recall, k)
        spark.createDataFrame([(out.fingerprint, json.dumps(centres.tolist()), out.probes, out.recall)], _META).coalesce(1).write.mode("overwrite").parquet(path + "/about")
        return out

    @classmethod
    def open(cls, spark: SparkSession, path: str, fingerprint: str | None = None) -> VectorIndex | None:
        """The index at a path; None if it is of another state of the table."""
        about = spark.read.parquet(path + "/about").head()
        if fingerprint is not None and about.fingerprint != fingerprint:
            return None
        return cls(spark, path, about.fingerprint, np.array(json.loads(about.centres)), about.probes, about.recall)

    def _assigned(self):
        centres = self.centres

        def run(batches):
            for b in batches:
                x = _unit(b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)) if b.num_rows else np.zeros((0, centres.shape[1]))
                lists = (x @ centres.T).argmax(1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(lists), b.column(0), b.column(1)], names=["list", "id", "v"])

        return run

    def _tune(self, rows: DataFrame, n: int, recall: float, k: int) -> None:
        """Looks for the fewest lists that give the recall, among powers of two, on rows chosen by a hash."""
        queries = rows.orderBy(F.xxhash64("id"), "id").limit(MEASURED)
        queries = self.spark.createDataFrame(queries.collect(), queries.schema)
        wanted = {(r.query, r.id) for r in nearest_each(rows, queries, k, ids="id", vector="v").collect()}
        tried = 1
        while True:
            found = {(r.query, r.id) for r in self.search(queries, k, "id", "v", tried).select("query", "id").collect()}
            self.probes, self.recall = tried, len(wanted & found) / max(1, len(wanted))
            if self.recall >= recall or tried >= len(self.centres):
                return
            tried = min(2 * tried, len(self.centres))

    # --- searching

    def _probed(self, probes: int):
        centres = self.centres

        def run(batches):
            for b in batches:
                x = np.array(b.column(1).to_pylist(), float).reshape(b.num_rows, -1)
                near = np.argsort(-(_unit(x) @ centres.T), axis=1, kind="stable")[:, :probes] if b.num_rows else np.zeros((0, 1), int)
                at = np.repeat(np.arange(b.num_rows), near.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(near.ravel().astype(np.int32)), b.column(0).take(pa.array(at)), b.column(1).take(pa.array(at))], names=["list", "query", "q"])

        return run

    def search(self, queries: DataFrame, k: int = 5, ids: str = "vec_id", vector: str = "embedding", probes: int | None = None, least: float | None = None) -> DataFrame:
        """query, id, score, place: as nearest_each gives, among the vectors of the lists that are nearest to each query. As many lists as there are give the exact result."""
        asked = queries.select(col(ids).cast("long").alias("query"), col(vector).cast("array<double>").alias("q")).filter("query is not null and q is not null")
        probes = min(probes or self.probes, len(self.centres))
        lists = self.spark.read.schema("ids array<long>, data binary, list int").parquet(self.path + "/lists")
        if probes == len(self.centres):  # every query meets every list
            pairs = lists.select(F.col("ids").alias("v_ids"), F.col("data").alias("v_data")).crossJoin(_blocks(asked, "query", "q", "q"))
            return placed(pairs.select("q_ids", "q_data", "v_ids", "v_data").mapInArrow(best(k, least), BEST_SCHEMA), k)
        probed = asked.mapInArrow(self._probed(probes), "list int, query long, q array<double>")
        n = asked.count()
        # Queries of a list come together by a cut of at most about BLOCK of them.
        cut = F.pmod(F.xxhash64("query"), F.lit(max(1, n // BLOCK)))
        by_list = probed.withColumn("cut", cut).groupBy("list", "cut").agg(F.collect_list(F.struct("query", "q")).alias("asked"))
        pairs = lists.join(F.broadcast(by_list) if n * probes <= BROADCAST_QUERIES else by_list, "list")
        return placed(pairs.select("asked", "ids", "data").mapInArrow(best(k, least, _asked), BEST_SCHEMA), k)


def _asked(row: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    queries = row.column(0).flatten()
    return queries.field("query").to_numpy(zero_copy_only=False), matrix(queries.field("q"))


_META = "fingerprint string, centres string, probes int, recall double"
_BLOCKS = "list int, ids array<long>, data binary"


def _blocked(batches):
    """Rows sorted by list as blocks of up to BLOCK vectors of one list."""
    now, ids, held = None, [], []

    def block():
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([ids], pa.list_(pa.int64())), pa.array([np.concatenate(held).tobytes()], pa.binary())], names=["list", "ids", "data"])

    for b in batches:
        if not b.num_rows:
            continue
        lists, names = b.column(0).to_numpy(), b.column(1).to_numpy()
        x = b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
        edges = np.flatnonzero(np.diff(lists)) + 1
        for lo, hi in zip([0, *edges], [*edges, len(lists)]):
            while lo < hi:
                if now != lists[lo] or len(ids) == BLOCK:
                    if ids:
                        yield block()
                    now, ids, held = int(lists[lo]), [], []
                upto = min(hi, lo + BLOCK - len(ids))
                ids += names[lo:upto].tolist()
                held.append(x[lo:upto])
                lo = upto
    if ids:
        yield block()
