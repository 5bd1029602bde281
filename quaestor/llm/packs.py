"""Documents packed for numpy, and an exchange of keys between packs.

A pack is one row that holds a few MB of texts. Operators that compare words between
documents work on whole packs with array operations, and meet over an exchange:
each pack sends its distinct keys, sorted and cut into ranges, as compressed arrays. Beyond FAN buckets
the way there has levels, each with about the same number of ranges: a node merges what as many packs sent for one range, and sends its distinct keys on, cut into as many smaller ranges;
a bucket, the last one, merges what all its senders sent and replies to each, and replies go back the same way. So a pack or node sends at most
FAN messages, a node holds about the keys of one pack whatever the input's size (with fewer ranges than senders it would hold those of many), and a key that every
document has comes to its bucket once from each node, whose number a level divides.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaestor.llm.storage import discard, written

#: Text bytes of a pack. A longer document is a pack of its own.
PACK_BYTES = 4 << 20
#: Keys that a bucket holds on average, and with it the memory of its task.
BUCKET_KEYS = 1_500_000
#: Ranges that a pack or node sends to, at most; of more buckets the root is taken, of as many levels as that needs.
FAN = 2048
NULL_ID = np.iinfo(np.int64).max

PACK_SCHEMA = "pack long, n int, ids binary, ends binary, data binary"
SENT_SCHEMA = "bucket int, pack long, n int, data binary"
REPLY_SCHEMA = "pack long, bucket int, data binary"


def squeeze(data: bytes | np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data if isinstance(data, bytes) else np.ascontiguousarray(data).tobytes())


def unsqueeze(data: bytes, kind=None):
    raw = zstandard.ZstdDecompressor().decompress(data)
    return raw if kind is None else np.frombuffer(raw, kind)


def squeeze_sorted(keys: np.ndarray) -> bytes:
    """Sorted uint64 keys: differences, byte plane by byte plane."""
    steps = np.diff(keys, prepend=np.uint64(0))
    return squeeze(steps.view(np.uint8).reshape(-1, 8).T)


def unsqueeze_sorted(data: bytes) -> np.ndarray:
    planes = unsqueeze(data, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def squeeze_counts(counts: np.ndarray) -> bytes:
    """Whole numbers from 0 that are mostly small, as uint64: byte plane by byte plane, of which the upper ones take no room."""
    return squeeze(np.ascontiguousarray(counts, np.uint64).view(np.uint8).reshape(-1, 8).T)


def unsqueeze_counts(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(unsqueeze(data, np.uint8).reshape(8, -1).T).view(np.uint64).ravel()


def arrow_limits(spark) -> None:
    """Arrow batches of few rows: rows here are texts or packs."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")


def batch(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<double>": pa.list_(pa.float64()), "array<binary>": pa.list_(pa.binary())}
    fields = [f.rsplit(" ", 1) for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[k]) for i, (_, k) in enumerate(fields)], names=[f for f, _ in fields])


def doc_batches(batches: Iterable[pa.RecordBatch], limit: int = PACK_BYTES) -> Iterator[tuple[list, list]]:
    """(ids, texts as bytes) of about ``limit`` bytes each, from batches of (doc_id, text)."""
    ids, texts, size = [], [], 0
    for b in batches:
        for i, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.large_binary()).to_pylist()):
            t = t or b""
            if ids and size + len(t) > limit:
                yield ids, texts
                ids, texts, size = [], [], 0
            ids.append(i)
            texts.append(t)
            size += len(t) + 1
    if ids:
        yield ids, texts


def packed(docs: DataFrame, limit: int = PACK_BYTES) -> DataFrame:
    """docs (doc_id, text) as packs. Null text is packed as an empty one, null doc_id as NULL_ID.

    The pack number is (partition, count); write the table before using it twice.
    """
    from pyspark import TaskContext

    def run(batches):
        part = TaskContext.get().partitionId()
        for seq, (ids, texts) in enumerate(doc_batches(batches, limit)):
            data = b"\n".join(texts) + b"\n"
            ends = np.cumsum([len(t) + 1 for t in texts]).astype(np.int64)
            ids = np.array([NULL_ID if i is None else i for i in ids], np.int64)
            yield batch(PACK_SCHEMA, [((part << 16) + seq, len(ids), squeeze(ids), squeeze(ends), squeeze(data))])

    arrow_limits(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PACK_SCHEMA)


def n_buckets(n: int, partitions: int) -> int:
    """For so many packs; at least one bucket for each shuffle partition up to one for each pack."""
    return max(1, math.ceil(n * (PACK_BYTES / 6) / BUCKET_KEYS), min(n, partitions))


@dataclass(frozen=True)
class Layout:
    """How a channel's keys are dealt: to ``first`` ranges, each of them cut into ``fan`` at each further level; those of the last level are the buckets."""

    packs: int
    first: int
    levels: int
    fan: int

    @classmethod
    def of(cls, packs: DataFrame) -> Layout:
        n = packs.count()
        buckets, levels = n_buckets(n, int(packs.sparkSession.conf.get("spark.sql.shuffle.partitions"))), 1
        while FAN**levels < buckets:
            levels += 1
        fan = math.ceil(round(buckets ** (1 / levels), 6))
        return cls(n, math.ceil(buckets / fan ** (levels - 1)), levels, fan)

    def ranges(self, level: int) -> int:
        """Of one channel."""
        return self.first * self.fan**level

    def nodes(self, level: int) -> int:
        """That the senders of a level come together in, for each range."""
        return max(1, math.ceil(self.packs / self.fan ** (level + 1)))


# --- texts as arrays -------------------------------------------------------------------------------------------------

_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _constants(n: int, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mixed((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 32)) * _GOLD) | np.uint64(1)


@dataclass
class Words:
    """Words of a pack: byte spans, hashes, and each document's range of words."""

    data: np.ndarray
    ids: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray  # of each document, and the number of words at last
    hash: np.ndarray

    def text(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


_CHUNK = np.array([(1 << 8 * n) - 1 for n in range(8)] + [2**64 - 1], np.uint64)  # mask of the first n bytes of eight
LONG = 512  # bytes of a span from which on its own chunks are hashed in one go


def _hash_long(data: np.ndarray) -> np.uint64:
    chunks = np.concatenate([data, np.zeros(-len(data) % 8, np.uint8)]).view(np.uint64)
    place = np.arange(1, len(chunks) + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        return np.uint64(len(data)) * _GOLD + mixed(chunks ^ mixed(place * _GOLD)).sum(dtype=np.uint64)


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray, block: int = 1 << 16) -> np.ndarray:
    """64-bit hash of data[start:end] for each span (none empty): eight bytes at a time are mixed in, after the length."""
    out = np.empty(len(start), np.uint64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, np.uint64, padded, 0, (1,))  # the eight bytes from each place on
    for lo in range(0, len(start), block):
        at, left = start[lo : lo + block], end[lo : lo + block] - start[lo : lo + block]
        h = mixed(left.astype(np.uint64) * _GOLD + (eight[at] & _CHUNK[np.minimum(left, 8)]))
        which = np.flatnonzero((left > 8) & (left <= LONG))
        at, left = at[which] + 8, left[which] - 8
        while len(which):
            chunk = eight[at] & _CHUNK[np.minimum(left, 8)]
            h[which] = mixed((h[which] ^ chunk) * _GOLD + chunk)
            more = left > 8
            which, at, left = which[more], at[more] + 8, left[more] - 8
        out[lo : lo + block] = h
    for i in np.flatnonzero(end - start > LONG):
        out[i] = mixed(np.array([_hash_long(data[start[i] : end[i]])]))[0]
    return out


def words_of(row: dict, lower: bool = False) -> Words:
    """Words of a row of PACK_SCHEMA: runs of bytes that are not ASCII blanks."""
    data = np.frombuffer(unsqueeze(row["data"]), np.uint8)
    if lower:
        data = data + (((data - np.uint8(65)) < 26).view(np.uint8) << np.uint8(5))
    ids, ends = unsqueeze(row["ids"], np.int64), unsqueeze(row["ends"], np.int64)
    blank = (data == 0x20) | ((data - np.uint8(9)) < 5)  # each text ends with a line feed, so words don't run over
    edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    if len(blank) and not blank[0]:
        edge = np.concatenate([[0], edge])
    start, end = edge[0::2], edge[1::2]
    first = np.concatenate([[0], np.searchsorted(start, ends)])
    doc = np.repeat(np.arange(len(ids), dtype=np.int32), np.diff(first))
    return Words(data, ids, start, end, doc, first, hash_spans(data, start, end) if len(start) else np.empty(0, np.uint64))


def joined(w: Words, which: np.ndarray, block: int = 1 << 16) -> tuple[bytes, np.ndarray]:
    """Words ``which`` each followed by a space, and where each begins (and the length at last)."""
    length = w.end[which] - w.start[which] + 1
    at = np.concatenate([[0], np.cumsum(length)])
    out = np.full(at[-1], 0x20, np.uint8)
    for lo in range(0, len(which), block):
        n = length[lo : lo + block] - 1
        begin = np.cumsum(n) - n
        within = np.arange(begin[-1] + n[-1], dtype=np.int64) - np.repeat(begin, n)
        out[np.repeat(at[lo : lo + len(n)], n) + within] = w.data[np.repeat(w.start[which[lo : lo + len(n)]], n) + within]
    return out.tobytes(), at


def window_hashes(w: Words, k: int, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of each window of k words in one document."""
    n = len(w.hash) - k + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    start = np.flatnonzero(w.doc[:n] == w.doc[k - 1 :])
    factor = _constants(k, seed)
    total = np.zeros(n, np.uint64)
    for j in range(k):
        total += w.hash[j : j + n] * factor[j]
    return start, mixed(total[start])


# --- the exchange ----------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Channel:
    """Keys of one meaning. combine(keys, attributes) -> distinct keys in order, an attribute for each, and the place of each key's among them; it is
    applied again to what it gave, in any order. answer(keys, attributes) -> a reply for each distinct key, and a summary for pack -1 or None."""

    bits: int
    combine: Callable
    answer: Callable
    shrink: Callable
    grow: Callable
    shrink_reply: Callable
    grow_reply: Callable


def cuts(keys: np.ndarray, low: int, high: int, ranges: int, bits: int) -> np.ndarray:
    """Where each of the ranges from low to below high (of so many) begins in sorted keys of so many bits, and the number of keys at last."""
    edges = np.array([(b << bits) // ranges for b in range(low + 1, high)], np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]]).astype(np.int64)


def _messages(sender: int, keys: np.ndarray, attributes: np.ndarray, at: np.ndarray, first: int, channel: Channel) -> pa.RecordBatch:
    rows = []
    for b, (lo, hi) in enumerate(zip(at[:-1], at[1:])):
        if hi > lo:
            body = squeeze_sorted(keys[lo:hi])
            rows.append((first + b, sender, int(hi - lo), len(body).to_bytes(4, "little") + body + channel.shrink(attributes[lo:hi])))
    return batch(SENT_SCHEMA, rows)


def send(pack: int, keys: np.ndarray, attributes: np.ndarray, layout: Layout, channel: Channel, index: int = 0) -> Iterator[pa.RecordBatch]:
    """Rows of SENT_SCHEMA: a pack's sorted distinct keys with one attribute each, by range; index is the channel's place among those that share the exchange."""
    ranges = layout.ranges(0)
    if len(keys):
        yield _messages(pack, keys, attributes, cuts(keys, 0, ranges, ranges, channel.bits), index * ranges, channel)


def _opened(table: pa.Table, channel: Channel) -> tuple[np.ndarray, np.ndarray]:
    keys, attributes = [], []
    for d in table.column("data").to_pylist():
        size = int.from_bytes(d[:4], "little")
        keys.append(unsqueeze_sorted(d[4 : 4 + size]))
        attributes.append(channel.grow(d[4 + size :]))
    return np.concatenate(keys), np.concatenate(attributes)


def _replies(table: pa.Table, replies: np.ndarray, channel: Channel, more: list[tuple] = []) -> pa.Table:  # noqa: B006
    bucket = table.column("bucket")[0].as_py()
    parts = np.split(replies, np.cumsum(table.column("n").to_numpy())[:-1])
    rows = [(p, bucket, channel.shrink_reply(x)) for p, x in zip(table.column("pack").to_pylist(), parts)]
    return pa.Table.from_batches([batch(REPLY_SCHEMA, rows + more)])


def exchange(sent: DataFrame, layout: Layout, channels: list[Channel], level: int = 0) -> DataFrame:
    """Rows of REPLY_SCHEMA, written: to each pack, by range, the answers for its keys in their order; and summaries to pack -1."""
    ranges, fan = layout.ranges(level), layout.fan

    def meet(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        channel = channels[bucket // ranges]
        keys, attributes, group = channel.combine(*_opened(table, channel))
        replies, summary = channel.answer(keys, attributes)
        return _replies(table, replies[group], channel, [] if summary is None else [(-1, bucket, squeeze(summary))])

    if level == layout.levels - 1:
        return written(sent.groupBy("bucket").applyInArrow(meet, REPLY_SCHEMA), release=True)

    def pass_on(table: pa.Table) -> pa.Table:
        at = table.column("bucket")[0].as_py()
        index, place = divmod(at, ranges)
        channel = channels[index]
        keys, attributes, _ = channel.combine(*_opened(table, channel))
        edges = cuts(keys, place * fan, (place + 1) * fan, ranges * fan, channel.bits)
        return pa.Table.from_batches([_messages(table.column("node")[0].as_py(), keys, attributes, edges, at * fan, channel)])

    def pass_back(table: pa.Table, found: pa.Table) -> pa.Table:
        channel = channels[table.column("bucket")[0].as_py() // ranges]
        _, _, group = channel.combine(*_opened(table, channel))
        return _replies(table, replied(found, channel)[group], channel)

    node = F.pmod(F.xxhash64("pack"), F.lit(layout.nodes(0))) if level == 0 else F.floor(F.col("pack") / fan)
    sent = written(sent.withColumn("node", node.cast("long")), release=True)
    of_nodes = sent.groupBy("bucket", "node").applyInArrow(pass_on, SENT_SCHEMA)
    found = exchange(of_nodes, layout, channels, level + 1)
    to_nodes = found.filter("pack >= 0").select("bucket", F.floor(F.col("bucket") / fan).cast("int").alias("at"), F.col("pack").alias("node"), "data")
    back = sent.groupBy("bucket", "node").cogroup(to_nodes.groupBy("at", "node")).applyInArrow(pass_back, REPLY_SCHEMA)
    out = written(back.union(found.filter("pack = -1")), release=True)
    discard(sent, found)
    return out


def combine_counts(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For a channel whose attributes are counts: uint64 ones are exact, uint32 ones stop at the greatest one and tell an order only."""
    order, begins, group = grouped(keys)
    total = np.add.reduceat(counts[order].astype(np.uint64), begins)
    return keys[order][begins], np.minimum(total, np.uint64(np.iinfo(counts.dtype).max)).astype(counts.dtype), group


def grouped(keys: np.ndarray, more: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, begins, group): keys[order] is sorted, group i starts at begins[i], and group[j] is the group of keys[j]. more: a second part of the keys."""
    if not len(keys):
        return (np.empty(0, np.int64),) * 3
    order = np.argsort(keys, kind="stable") if more is None else np.lexsort((more, keys))
    s = keys[order]
    fresh = s[1:] != s[:-1]
    if more is not None:
        fresh |= more[order][1:] != more[order][:-1]
    begins = np.flatnonzero(np.concatenate([[True], fresh]))
    group = np.empty(len(keys), np.int64)
    group[order] = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(s))))
    return order, begins, group


def replied(table: pa.Table, channel: Channel, low: int = 0, high: float = math.inf, **where) -> np.ndarray:
    """A sender's replies from the ranges from low to below high, in the order of its keys."""
    rows = [r for r in table.to_pylist() if low <= r["bucket"] < high and all(r[k] == v for k, v in where.items())]
    parts = [channel.grow_reply(r["data"]) for r in sorted(rows, key=lambda r: r["bucket"])]
    return np.concatenate(parts) if parts else np.empty(0, np.int64)


def with_replies(packs: DataFrame, replies: DataFrame, apply: Callable[[dict, pa.Table], list[pa.RecordBatch]], schema: str) -> DataFrame:
    """apply(pack row, its replies) -> batches of schema."""

    empty = batch(schema, [])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [b for row in left.to_pylist() for b in apply(row, right)]
        return pa.Table.from_batches(out, empty.schema)

    return packs.groupBy("pack").cogroup(replies.groupBy("pack")).applyInArrow(run, schema)


def each_pack(packs: DataFrame, apply: Callable[[dict], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                yield from apply({k: v[0].as_py() for k, v in zip(b.schema.names, b.slice(i, 1).columns)})

    return packs.mapInArrow(run, schema)
