"""Chunks of a table, their embeddings, and search by cosine similarity."""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaestor.functions.columns import col, cosine, labelled_row
from quaestor.models import Embedder
from quaestor.operators.profile import profile, top_values_of
from quaestor.sources.readers import RID, Dataset, numbered
from quaestor.sources.shared import listed, shared_dir

CHUNK_COLUMNS = ("chunk_id", "text", "chunk_type", "metadata")


def window_size(n_columns: int) -> int:
    """Rows of a chunk: about 60 cells, from 3 to 15 rows."""
    return max(3, min(15, 60 // max(n_columns, 1)))


def row_groups(table: DataFrame, columns: list[str], size: int | None = None) -> DataFrame:
    """Neighbouring rows together, without overlap; every row is in one chunk. table has contiguous row ids."""
    size = size or window_size(len(columns))
    line = F.concat(F.lit("Row "), (F.col(RID) + 1).cast("string"), F.lit(": "), labelled_row(columns))
    lines = table.select((F.col(RID) / size).cast("long").alias("g"), RID, line.alias("line"))
    chunks = lines.groupBy("g").agg(F.array_sort(F.collect_list(F.struct(RID, "line"))).alias("rows"), F.min(RID).alias("a"), F.max(RID).alias("b"))
    meta = F.create_map(F.lit("start_row"), F.col("a").cast("string"), F.lit("end_row"), F.col("b").cast("string"), F.lit("columns"), F.lit(", ".join(columns)))
    return chunks.select(
        F.concat(F.lit("rows-"), F.col("g").cast("string")).alias("chunk_id"),
        F.array_join(F.transform("rows", lambda r: r["line"]), "\n").alias("text"),
        F.lit("rows").alias("chunk_type"), meta.alias("metadata"),
    )


def _about(kind: str, text: Column) -> list[Column]:
    return [
        F.concat(F.lit(f"{kind}-"), F.col("column")).alias("chunk_id"), text.alias("text"),
        F.lit(kind).alias("chunk_type"), F.create_map(F.lit("column"), F.col("column")).alias("metadata"),
    ]


def column_descriptions(ds: Dataset, known: DataFrame | None = None) -> DataFrame:
    """Of numbers: range, mean, missing; of others: distinct values, the five most frequent, missing. known: the profile, if there is one."""
    top = top_values_of(ds.rows, ds.textual, 5) if ds.textual else None
    prof = profile(ds, median=False) if known is None else known
    if top is not None:
        named = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "value"))), lambda x: x["value"]), ", ")
        prof = prof.join(top.groupBy("column").agg(named.alias("top")), "column", "left")
    else:
        prof = prof.withColumn("top", F.lit(None).cast("string"))
    numeric = F.format_string("Column '%s' (numeric): from %s to %s, mean %.2f, missing %d", "column", F.col("low").cast("string"), F.col("high").cast("string"), "mean", "n_missing")
    other = F.format_string("Column '%s' (%s): %d distinct values, most frequent: %s, missing %d", "column", "kind", "n_distinct", F.coalesce("top", F.lit("none")), "n_missing")
    return prof.select(*_about("column", F.when((F.col("kind") == "numeric") & F.col("mean").isNotNull(), numeric).otherwise(other)))


def statistics_chunks(ds: Dataset, known: DataFrame | None = None) -> DataFrame:
    text = F.format_string(
        "Statistics of '%s': minimum %s, maximum %s, mean %.2f, standard deviation %s, median %s", "column",
        F.col("low").cast("string"), F.col("high").cast("string"), "mean", F.coalesce(F.format_string("%.2f", "std"), F.lit("none")), F.col("median").cast("string"),
    )
    prof = profile(ds, distinct=False) if known is None else known
    return prof.filter("kind = 'numeric' and mean is not null").select(*_about("statistics", text))


def distribution_chunks(ds: Dataset, most: int = 50, k: int = 10, known: DataFrame | None = None) -> DataFrame:
    """Of columns that aren't numbers and have at most ``most`` distinct values."""
    prof = profile(Dataset(ds.rows.select(RID, *[col(c) for c in ds.textual])), median=False) if known is None else known
    few = prof.filter((F.col("kind") == "text") & (F.col("n_distinct") <= most) & (F.col("n_distinct") > 0)).select("column")
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "value", "n"))), lambda x: F.concat(x["value"], F.lit(": "), x["n"].cast("string"))), "\n")
    tops = top_values_of(ds.rows, ds.textual, k).join(few, "column").groupBy("column").agg(lines.alias("lines"))
    return tops.select(*_about("distribution", F.concat(F.lit("Distribution of '"), F.col("column"), F.lit("':\n"), F.col("lines"))))


def build_chunks(ds: Dataset) -> DataFrame:
    """chunk_id, text, chunk_type, metadata: rows, columns, statistics, distributions. The last three read one profile, whose exchanges Spark runs once."""
    plain = [c for c in ds.columns if ds.kinds[c] != "nested"]
    known = profile(ds)
    parts = [row_groups(numbered(ds.table), plain), column_descriptions(ds, known)]
    parts += [statistics_chunks(ds, known)] if ds.numeric else []
    parts += [distribution_chunks(ds, known=known)] if ds.textual else []
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def row_lines(ds: Dataset) -> DataFrame:
    """One line for each row."""
    return numbered(ds.table).select(RID, F.concat(F.lit("Row "), (F.col(RID) + 1).cast("string"), F.lit(": "), labelled_row(ds.columns, " | ")).alias("text"))


def embedded(chunks: DataFrame, embedder: Embedder) -> DataFrame:
    """chunks with ``embedding``; each distinct text is embedded once, in Arrow batches."""

    def run(frames):
        for f in frames:
            yield pd.DataFrame({"text_md5": f["text_md5"], "embedding": embedder.embed(f["text"].tolist())})

    keyed = chunks.withColumn("text_md5", F.md5("text"))
    vectors = keyed.select("text_md5", "text").dropDuplicates(["text_md5"]).mapInPandas(run, "text_md5 string, embedding array<double>")
    return keyed.join(vectors, "text_md5")


def nearest(vectors: DataFrame, query: list[float], k: int | None = 5, least: float | None = None, vector: str = "embedding", tie: str = "chunk_id") -> DataFrame:
    """vectors with ``score``, the k highest (None: all, in no order) of at least ``least``; ties by ``tie``. The query is a literal, so rows don't move but for the top k."""
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = vectors.withColumn("score", cosine(col(vector), q))
    scored = scored.filter(F.col("score") >= least) if least is not None else scored
    return scored if k is None else scored.orderBy(F.desc("score"), tie).limit(k)


#: Vectors of a block: with 1,000 numbers each, 8 MB.
BLOCK = 1024


#: Best rows that a task keeps for its queries before it sends them on.
KEPT_BEST = 2_000_000


def matrix(vectors: pa.Array) -> np.ndarray:
    """Equally long vectors as a matrix of their own."""
    size = len(vectors[0]) if len(vectors) else 0
    if len(vectors) and not (vectors.value_lengths().to_numpy(zero_copy_only=False) == size).all():
        raise ValueError("vectors must be equally long")
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(vectors), size)


def _blocks(vectors: DataFrame, ids: str, vector: str, name: str) -> DataFrame:
    """Vectors by BLOCK to a row, within the tasks that hold them: nothing is shuffled."""

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, BLOCK):
                part = b.slice(lo, BLOCK)
                yield pa.RecordBatch.from_pydict({f"{name}_ids": [part.column(0).to_pylist()], f"{name}_data": [matrix(part.column(1)).tobytes()]}, schema)

    schema = pa.schema([(f"{name}_ids", pa.list_(pa.int64())), (f"{name}_data", pa.binary())])
    chosen = vectors.select(col(ids).cast("long").alias("i"), col(vector).cast("array<double>").alias("v")).filter("i is not null and v is not null")
    return chosen.mapInArrow(run, f"{name}_ids array<long>, {name}_data binary")


BEST_SCHEMA = "query long, id long, score double"


def best(k: int, least: float | None, asked=None):
    """A mapInArrow function over pairs of blocks (q_ids, q_data, v_ids, v_data): a task keeps the k best rows of each of its queries, so it sends k rows a query, not k for each
    pair, and looks at one pair at a time. asked: gives (ids, matrix) of the queries from the first of three columns instead."""

    def queries(row):
        qi = row.column(0).flatten().to_numpy(zero_copy_only=False)
        return qi, np.frombuffer(row.column(1)[0].as_py(), np.float64).reshape(len(qi), -1)

    def run(batches):
        kept: dict[bytes, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

        def rows():
            for qi, scores, ids in kept.values():
                at = np.nonzero(scores >= (-np.inf if least is None else least))
                yield pa.RecordBatch.from_pydict({"query": qi[at[0]], "id": ids[at], "score": scores[at]})
            kept.clear()

        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1)
                qi, q = (asked or queries)(row)
                vi = row.column(row.num_columns - 2).flatten().to_numpy(zero_copy_only=False)
                v = np.frombuffer(row.column(row.num_columns - 1)[0].as_py(), np.float64).reshape(len(vi), -1)
                for lo in range(0, len(qi), BLOCK):
                    names, part = qi[lo : lo + BLOCK], q[lo : lo + BLOCK]
                    size = np.outer(np.linalg.norm(part, axis=1), np.linalg.norm(v, axis=1))
                    scores, ids = (part @ v.T) / np.where(size == 0, 1e-10, size), np.broadcast_to(vi, (len(names), len(vi)))
                    key = names.tobytes()
                    if key in kept:
                        scores, ids = np.concatenate([scores, kept[key][1]], axis=1), np.concatenate([ids, kept[key][2]], axis=1)
                    order = np.lexsort((ids, -np.round(scores, 12)), axis=1)[:, :k]
                    kept[key] = names, np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)
                if sum(x[2].size for x in kept.values()) > KEPT_BEST:
                    yield from rows()
        yield from rows()

    return run


def placed(scored: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc(F.round("score", 12)), "id"))
    return scored.withColumn("place", place).filter(F.col("place") <= k)


def nearest_each(vectors: DataFrame, queries: DataFrame, k: int = 5, least: float | None = None, ids: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query, id, score, place: for each row of ``queries`` the k rows of ``vectors`` with the highest cosine, of at least ``least``; ties by id.

    Exact. Blocks of queries meet blocks of vectors as matrices, one pair at a time; what is shuffled is k rows for
    each query and task. Rows without id or vector take no part; vectors must be equally long.
    """
    left, right = _blocks(vectors, ids, vector, "v"), _blocks(queries, ids, vector, "q")
    return placed(left.crossJoin(right).select("q_ids", "q_data", "v_ids", "v_data").mapInArrow(best(k, least), BEST_SCHEMA), k)


#: Distinct chunks from which searches go by inverted lists instead of comparing with all.
APPROXIMATE_FROM = 200_000


class Index:
    """Embedded chunks of one dataset, cached by its fingerprint; vectors of single questions are kept too.

    Chunks of a large table (of at least approximate_from distinct texts) are written with a vector index to a folder named by the
    fingerprint, where another session finds them; the k nearest are then those of the lists that the index looks at.
    """

    def __init__(self, embedder: Embedder, approximate_from: int = APPROXIMATE_FROM):
        self.embedder, self.approximate_from, self._of, self._vectors, self._lists = embedder, approximate_from, None, None, None
        self._single = lru_cache(1000)(lambda text: embedder.embed([text])[0])

    def build(self, ds: Dataset) -> DataFrame:
        if self._vectors is None or self._of != ds.fingerprint or not ds.fingerprint:
            self.clear()
            self._vectors, self._of = self._kept(ds) or embedded(build_chunks(ds), self.embedder).persist(), ds.fingerprint
            if self._lists is None and ds.fingerprint and self._vectors.select("text_md5").distinct().count() >= self.approximate_from:
                self._keep(ds)
        return self._vectors

    def _place(self, ds: Dataset) -> str:
        """Of a table's state and the embedder that its chunks are known by."""
        kind = getattr(self.embedder, "model", "") or type(self.embedder).__name__
        return f"{shared_dir(ds.rows.sparkSession)}/chunks/{hashlib.md5(f'{ds.fingerprint}:{kind}'.encode()).hexdigest()}"

    def _kept(self, ds: Dataset) -> DataFrame | None:
        from quaestor.operators.vector_index import VectorIndex

        spark, place = ds.rows.sparkSession, self._place(ds)
        if not ds.fingerprint or not listed(spark, place + "/lists/about"):  # written last
            return None
        self._lists = VectorIndex.open(spark, place + "/lists", ds.fingerprint)
        return spark.read.parquet(place + "/chunks") if self._lists else None

    def _keep(self, ds: Dataset) -> None:
        from quaestor.operators.vector_index import VectorIndex

        place, held = self._place(ds), self._vectors
        held.withColumn("number", F.xxhash64("text_md5")).write.mode("overwrite").parquet(place + "/chunks")
        self._vectors = ds.rows.sparkSession.read.parquet(place + "/chunks")
        held.unpersist()
        self._lists = VectorIndex.build(self._vectors.dropDuplicates(["number"]), "number", "embedding", place + "/lists", ds.fingerprint)

    def search(self, question: str, k: int = 5, least: float = 0.3) -> DataFrame | None:
        if self._vectors is None:
            return None
        single = self._vectors.dropDuplicates(["text_md5"])
        if self._lists is None:
            return nearest(single, self._single(question), k, least).select(*CHUNK_COLUMNS, "score")
        asked = single.sparkSession.createDataFrame([(0, [float(x) for x in self._single(question)])], "query long, embedding array<double>")
        found = self._lists.search(asked, k, "query", "embedding", least=least)
        near = single.join(F.broadcast(found.select(F.col("id").alias("number"), "score")), "number")  # k rows
        return near.orderBy(F.desc("score"), "chunk_id").select(*CHUNK_COLUMNS, "score")

    def clear(self) -> None:
        if self._vectors is not None:
            self._vectors.unpersist()
        self._vectors = self._of = self._lists = None
