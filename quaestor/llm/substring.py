"""Substring dedup: fixed-block anchors, probed by rolling windows, extended to exact repeats."""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaestor.llm.packs import (
    NULL_ID, SENT_SCHEMA, Channel, Layout, Words, batch, each_pack, exchange, grouped, joined, packed, replied, send, squeeze, unsqueeze, window_hashes, with_replies, words_of,
)
from quaestor.llm.storage import discard, written

WINDOW = 13
ANCHOR_BITS = 48  # an anchor is a hint; a false one costs a look at a window
WINDOW_KIND = np.dtype([("least", "<i8"), ("check", "<u4")])
OUT_SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"


def _anchors(w: Words, window: int, block: int):
    """(keys, flags, place): distinct hashes of rolling block-word windows, and for each rolling window its key's place.

    Flag 1: it is one of the non-overlapping blocks of a document here. Flag 2: two documents here have it.
    """
    start, full = window_hashes(w, block)
    long_enough = np.diff(w.first)[w.doc[start]] >= window
    start, full = start[long_enough], full[long_enough]
    keys, place = np.unique(full >> np.uint64(64 - ANCHOR_BITS), return_inverse=True)
    doc = w.doc[start]
    is_block = (start - w.first[doc]) % block == 0
    flags = np.zeros(len(keys), np.uint8)
    flags[place[is_block]] = 1
    low, high = np.full(len(keys), len(w.ids), np.int32), np.full(len(keys), -1, np.int32)
    np.minimum.at(low, place, doc)
    np.maximum.at(high, place, doc)
    flags[low < high] |= 2
    return keys, flags, start, place


def _combine_anchors(keys, flags):
    """Flag 1: a block of some document. Flag 2: in two documents."""
    order, begins, group = grouped(keys)
    many = np.diff(np.append(begins, len(keys))) > 1
    return keys[order][begins], np.bitwise_or.reduceat(flags[order], begins) | (many.astype(np.uint8) << 1), group


def _hits(keys, flags):
    return (flags == 3).astype(np.uint8), None


def _candidates(w: Words, window: int, block: int, hits: np.ndarray):
    """(start, keys, checks, place): windows that hold a hit anchor, extended to all starts around it. A window is known by 96 bits, its key and its check."""
    _, _, start, place = _anchors(w, window, block)
    near = np.zeros(len(w.hash) + 1, np.int64)
    at = start[hits[place] > 0] if len(place) else start
    np.add.at(near, np.maximum(at - (window - block), 0), 1)  # a hit at p is in windows from p - (window - block) to p
    np.add.at(near, at + 1, -1)
    covered = np.cumsum(near)[:-1] > 0
    starts, full = window_hashes(w, window, seed=4)
    keep = covered[starts]
    starts, full = starts[keep], full[keep]
    check = (window_hashes(w, window, seed=5)[1][keep] >> np.uint64(32)).astype(np.uint32)
    order, begins, place = grouped(full, check)
    first = order[begins] if len(order) else order
    return starts, full[first], check[first], place


def _least_ids(w: Words, starts, keys, check, place):
    least = np.full(len(keys), NULL_ID, np.int64)
    np.minimum.at(least, place, w.ids[w.doc[starts]])
    out = np.empty(len(keys), WINDOW_KIND)
    out["least"], out["check"] = least, check
    return out


def _combine_least(keys, sent):
    order, begins, group = grouped(keys, sent["check"])
    out = sent[order][begins]
    out["least"] = np.minimum.reduceat(sent["least"][order], begins)
    return keys[order][begins], out, group


def _least(keys, sent):
    return sent["least"], None


def _shrink(sent: np.ndarray) -> bytes:
    return squeeze(sent["least"].tobytes() + sent["check"].tobytes())


def _grow(data: bytes) -> np.ndarray:
    raw = unsqueeze(data)
    n = len(raw) // WINDOW_KIND.itemsize
    out = np.empty(n, WINDOW_KIND)
    out["least"], out["check"] = np.frombuffer(raw, np.int64, n), np.frombuffer(raw, np.uint32, n, 8 * n)
    return out


ANCHORS = Channel(ANCHOR_BITS, _combine_anchors, _hits, squeeze, partial(unsqueeze, kind=np.uint8), squeeze, partial(unsqueeze, kind=np.uint8))
WINDOWS = Channel(64, _combine_least, _least, _shrink, _grow, squeeze, partial(unsqueeze, kind=np.int64))


def substring_dedup(docs: DataFrame, window: int = WINDOW, with_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept_text of each row of docs (doc_id, text).

    A word goes if a window of ``window`` words over it also starts in a document with a smaller doc_id.
    Blocks are half a window long, so every window of the reference holds a whole one: the exchange of anchors
    marks rolling windows that are a block of another document, and only around those are whole windows
    hashed (96 bits) and their least doc_id looked up. Neighbouring removed windows make up the maximal repeats.

    Null text: no words. Null doc_id: counts as greater than any other, so its repeats of others go. Rows
    with equal doc_id don't remove from each other. Other columns of docs aren't read.
    """
    block = (window + 1) // 2
    packs = written(packed(docs), release=True)
    layout = Layout.of(packs)

    def send_anchors(row):
        keys, flags, _, _ = _anchors(words_of(row), window, block)
        yield from send(row["pack"], keys, flags, layout, ANCHORS)

    hits = exchange(each_pack(packs, send_anchors, SENT_SCHEMA), layout, [ANCHORS])

    def send_windows(row, replies):
        w = words_of(row)
        starts, keys, check, place = _candidates(w, window, block, replied(replies, ANCHORS))
        return send(row["pack"], keys, _least_ids(w, starts, keys, check, place), layout, WINDOWS)

    least = exchange(with_replies(packs, hits, send_windows, SENT_SCHEMA), layout, [WINDOWS])

    def finish(row, replies):
        w = words_of(row)
        starts, _, _, place = _candidates(w, window, block, replied(replies, ANCHORS, round=1))
        found = replied(replies, WINDOWS, round=2)
        gone = starts[found[place] < w.ids[w.doc[starts]]] if len(starts) else starts
        marks = np.zeros(len(w.hash) + 1, np.int64)
        np.add.at(marks, gone, 1)
        np.add.at(marks, gone + window, -1)
        kept = np.cumsum(marks)[:-1] == 0
        which = np.flatnonzero(kept)
        spaced, at = joined(w, which)
        edge = np.searchsorted(which, w.first)
        rows = []
        for d, (lo, hi) in enumerate(zip(edge[:-1], edge[1:])):
            text = spaced[at[lo] : max(at[lo], at[hi] - 1)]
            n = int(w.first[d + 1] - w.first[d])
            rows.append((None if w.ids[d] == NULL_ID else int(w.ids[d]), n, n - int(hi - lo), hashlib.sha256(text).hexdigest(), text.decode("utf-8", "replace") if with_text else None))
        return [batch(OUT_SCHEMA, rows)]

    both = hits.withColumn("round", F.lit(1)).unionByName(least.withColumn("round", F.lit(2)))
    out = written(with_replies(packs, both, finish, OUT_SCHEMA))
    discard(packs, hits, least)
    return out


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return substring_dedup(docs, with_text=False).drop("kept_text")


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT rid, doc_id, s, array_to_string(w[s:s + 12], ' ') AS g FROM (SELECT rid, doc_id, w, unnest(range(1, len(w) - 11)) AS s FROM d)),
gone AS (SELECT rid, s FROM (SELECT rid, s, doc_id, min(doc_id) OVER (PARTITION BY g) AS m FROM g) WHERE m < doc_id),
p AS (SELECT DISTINCT rid, unnest(range(s, s + 13)) AS p FROM gone),
k AS (SELECT rid, doc_id, len(w) AS n, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT k.rid, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS c FROM k ANTI JOIN p ON k.rid = p.rid AND k.p = p.p GROUP BY k.rid)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(c, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (rid)
"""
