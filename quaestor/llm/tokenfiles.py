"""Token-ID output: documents as token ids in shards, each a compressed wavelet matrix."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import zip_longest

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quaestor.llm.encoder import default_path, encoder
from quaestor.llm.packs import NULL_ID, arrow_limits, batch, doc_batches, squeeze, unsqueeze
from quaestor.llm.storage import shared_dir, written
from quaestor.llm.wavelet import WaveletMatrix

END_ID = 0
BLOCK_BYTES = 2 << 20  # of text encoded at once
#: Tokens after which a shard ends; a longer document is a shard of its own.
SHARD_TOKENS = 1_000_000
ENCODED_SCHEMA = "doc_id long, part int, ids binary"
#: Text bytes for each part of the order; there are at least as many parts as shuffle partitions.
PART_BYTES = 256 << 20
SHARD_SCHEMA = "part int, shard int, n_tokens long, first_doc long, last_doc long, ids binary, offsets binary, ranks binary, planes array<binary>"
READ_SCHEMA = "doc_id long, part int, shard int, at long, n_tokens long, ids_crc32 long"


def _encode(path: str, edges: list[int]):
    bounds = np.array(edges, np.int64)

    def run(batches):
        own = encoder(path, added=True)
        for ids, texts in doc_batches(batches, BLOCK_BYTES):
            tokens, at = own.encode(texts)
            part = np.searchsorted(bounds, [NULL_ID if i is None else i for i in ids], side="right")
            yield batch(ENCODED_SCHEMA, [(i, int(p), tokens[lo:hi].tobytes()) for i, p, lo, hi in zip(ids, part, at[:-1], at[1:])])

    return run


def _shards(path: str, end_id: int):
    """Documents in order of (part, doc_id) to shards; a task holds one shard at a time."""

    def close(part, shard, ids, tokens):
        lengths = np.array([len(t) + 1 for t in tokens], np.int64)
        flat = np.full(int(lengths.sum()), end_id, np.uint32)
        last = np.cumsum(lengths) - 1
        keep = np.ones(len(flat), bool)
        keep[last] = False
        flat[keep] = np.concatenate(tokens) if tokens else []
        matrix = WaveletMatrix.build(flat.astype(np.uint16) if flat.max(initial=0) < 1 << 16 else flat)
        offsets = np.concatenate([[0], last + 1])
        known = [i for i in ids if i is not None]
        ends = (known[0], known[-1]) if known else (None, None)
        return batch(SHARD_SCHEMA, [(part, shard, len(flat), *ends, squeeze(np.array(known, np.int64)), squeeze(offsets), *matrix.to_parts())])

    def run(batches) -> Iterator[pa.RecordBatch]:
        kind = encoder(path, added=True).kind
        part, shard, ids, tokens, size = None, 0, [], [], 0
        for b in batches:
            for i, p, data in zip(*(b.column(k).to_pylist() for k in range(3))):
                t = np.frombuffer(data, kind)
                if ids and (p != part or size + len(t) > SHARD_TOKENS):
                    yield close(part, shard, ids, tokens)
                    shard, ids, tokens, size = shard + 1 if p == part else 0, [], [], 0
                part = p
                ids.append(i)
                tokens.append(t)
                size += len(t) + 1
        if ids:
            yield close(part, shard, ids, tokens)

    return run


def write_token_files(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID) -> str:
    """Writes docs (doc_id, text) to ``path``, a Parquet container with one row for each shard, and returns the path.

    A row: part and shard (their order is that of doc_id), n_tokens, the first and last doc_id, all doc_ids (documents without one are the last and have none here), where each document begins
    within the shard, and the wavelet matrix of all its ids, each document followed by end_id: its rank directory as it is, and its planes in blocks that are
    compressed with zstd apart, so that a lookup opens only those that it passes. Bounds between parts are quantiles of doc_id, so the order needs no global sort; documents of a part
    are sorted and cut to shards as they stream through a task.

    Null or empty text: end_id only. Null doc_id: after all others. Rows with equal doc_id follow each other,
    in the order of their ids' bytes. An empty table writes no shard. Other columns aren't read.
    """
    spark = docs.sparkSession
    tokenizer = tokenizer or default_path()
    arrow_limits(spark)
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    size = docs.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))
    cuts = docs.agg(F.percentile_approx("doc_id", [k / parts for k in range(1, parts)], max(10_000, 10 * parts))).head()[0] if parts > 1 else []
    encoded = docs.mapInArrow(_encode(tokenizer, sorted(set(cuts or []))), ENCODED_SCHEMA)
    ordered = encoded.repartitionById(parts, F.col("part")).sortWithinPartitions("part", F.col("doc_id").asc_nulls_last(), "ids")
    ordered.mapInArrow(_shards(tokenizer, end_id), SHARD_SCHEMA).write.option("compression", "none").parquet(path)
    return path


def open_shard(row) -> tuple[np.ndarray, np.ndarray, WaveletMatrix]:
    """(doc_ids, offsets, matrix) of a row of the container. Documents from len(doc_ids) on have no doc_id."""
    return unsqueeze(row["ids"], np.int64), unsqueeze(row["offsets"], np.int64), WaveletMatrix.from_parts(row["ranks"], row["planes"])


def read_token_files(spark, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document in a container, from its shards alone.

    start: the ids of all documents before. Shards are decoded in the tasks; their totals are summed within each part, and over parts.
    """

    def documents(row, ids, offsets, matrix):
        flat = matrix.to_array().astype("<u4").tobytes()
        return [
            (i, row["part"], row["shard"], lo, hi - lo, zlib.crc32(flat[4 * lo : 4 * hi]))
            for i, lo, hi in zip_longest(ids.tolist(), offsets[:-1].tolist(), offsets[1:].tolist())
        ]

    shards = spark.read.schema(SHARD_SCHEMA).parquet(path)
    totals = shards.select("part", "shard", "n_tokens")
    upto = lambda w: F.sum("n_tokens").over(w) - F.col("n_tokens")
    of_part = totals.groupBy("part").agg(F.sum("n_tokens").alias("n_tokens")).select("part", upto(Window.orderBy("part")).alias("before_part"))
    within = totals.select("part", "shard", upto(Window.partitionBy("part").orderBy("shard")).alias("before"))
    before = written(within.join(of_part, "part").select("part", "shard", (F.col("before") + F.col("before_part")).alias("before")))
    docs = shards.select("part", "shard", "ids", "offsets", "ranks", "planes").mapInArrow(_each_shard(documents, READ_SCHEMA), READ_SCHEMA)
    out = docs.join(before, ["part", "shard"])
    return out.select("doc_id", (F.col("at") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def _each_shard(apply, schema: str):
    """A mapInArrow function: apply(row, doc_ids, offsets, matrix) -> rows of schema, a shard at a time."""

    def run(batches):
        for b in batches:
            for k in range(b.num_rows):
                row = {c: v[k].values if c == "planes" else v[k].as_py() for c, v in zip(b.schema.names, b.columns)}
                yield batch(schema, apply(row, *open_shard(row)))

    return run


def count_token(spark, path: str, token: int) -> DataFrame:
    """part, shard, n: occurrences of a token id in each shard, by rank alone."""
    schema = "part int, shard int, n long"
    count = lambda row, ids, offsets, matrix: [(row["part"], row["shard"], matrix.rank(token))]
    return spark.read.schema(SHARD_SCHEMA).parquet(path).mapInArrow(_each_shard(count, schema), schema)


def find_token(spark, path: str, token: int) -> DataFrame:
    """doc_id, at: each occurrence of a token id, as its place in its document, by rank and select; a document's end counts as its last place."""
    schema = "doc_id long, at long"

    def find(row, ids, offsets, matrix):
        at = matrix.occurrences(token)
        doc = np.searchsorted(offsets, at, side="right") - 1
        return [(int(ids[d]) if d < len(ids) else None, p) for d, p in zip(doc.tolist(), (at - offsets[doc]).tolist())]

    return spark.read.schema(SHARD_SCHEMA).parquet(path).mapInArrow(_each_shard(find, schema), schema)


def read_tokens(spark, path: str, doc_id: int, begin: int = 0, end: int | None = None) -> DataFrame:
    """doc_id, tokens: the ids at places begin to end (of all, with the document's end, by default) of each row of a document, by access.

    Only shards whose range of doc_ids holds it are read.
    """
    schema = "doc_id long, tokens array<long>"

    def cut(row, ids, offsets, matrix):
        out = []
        for d in np.flatnonzero(ids == doc_id):
            lo, hi = int(offsets[d]), int(offsets[d + 1])
            out.append((doc_id, matrix.access(np.arange(lo + begin, hi if end is None else min(hi, lo + end))).tolist()))
        return out

    shards = spark.read.schema(SHARD_SCHEMA).parquet(path).filter((F.col("first_doc") <= doc_id) & (F.col("last_doc") >= doc_id))
    return shards.mapInArrow(_each_shard(cut, schema), schema)


def token_files(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Writes docs to a new container in the shared folder and reads it back."""
    import uuid

    spark = docs.sparkSession
    return read_token_files(spark, write_token_files(docs, f"{shared_dir(spark)}/tokens/{uuid.uuid4().hex}", tokenizer))


def op3_token_files(spark, sf_dir: str) -> DataFrame:
    return token_files(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
