"""N-gram Jaccard join: a grouped prefix join over word shingles."""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaestor.llm.components import components
from quaestor.llm.packs import (
    NULL_ID, SENT_SCHEMA, Channel, Layout, Words, batch, combine_counts, each_pack, exchange, mixed, packed, replied, send, squeeze, unsqueeze, window_hashes, with_replies, words_of,
)
from quaestor.llm.spread import spread_join
from quaestor.llm.storage import discard, written

SHINGLE, PERCENT = 5, 80
KEY_BITS = 48  # of the keys whose document counts are exchanged; a clash only changes the order of shingles
DOC_SCHEMA = "uid long, doc_id long, n int, sig1 long, sig2 long, prefix long, tokens array<long>, places array<int>"
SET_SCHEMA = "uid long, members binary"


def _sets(w: Words, size: int):
    """(doc, shingle) of the distinct shingles of each document, by document. A shorter text is one shingle."""
    start, full = window_hashes(w, size)
    doc = w.doc[start]
    counts = np.diff(w.first)
    small = np.flatnonzero((counts > 0) & (counts < size))
    if len(small):
        one = np.array([_sequence(w.hash[w.first[d] : w.first[d + 1]]) for d in small], np.uint64)
        doc, full = np.concatenate([doc, small.astype(doc.dtype)]), np.concatenate([full, one])
    order = np.lexsort((full, doc))
    doc, full = doc[order], full[order]
    fresh = np.concatenate([[True], (full[1:] != full[:-1]) | (doc[1:] != doc[:-1])]) if len(full) else np.empty(0, bool)
    return doc[fresh], full[fresh]


def _sequence(hashes: np.ndarray) -> np.uint64:
    out = np.uint64(len(hashes))
    with np.errstate(over="ignore"):
        for h in hashes:
            out = mixed(np.array([out * np.uint64(0x9E3779B97F4A7C15) + h]))[0]
    return out


def _prefix_lengths(n: np.ndarray, percent: int) -> np.ndarray:
    """Two sets of n and more members that are alike enough share one of the first so many of any common order."""
    return n - (percent * n + 99) // 100 + 1


def _of_several(keys, counts):
    """Documents that have the key; 0 for one."""
    return np.where(counts > 1, counts, np.uint32(0)), None


COUNTS = Channel(KEY_BITS, combine_counts, _of_several, squeeze, partial(unsqueeze, kind=np.uint32), squeeze, partial(unsqueeze, kind=np.uint32))


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def _documents(row: dict, counts: np.ndarray, size: int, percent: int) -> list[pa.RecordBatch]:
    w = words_of(row, lower=True)
    doc, full = _sets(w, size)
    keys, place = np.unique(full >> np.uint64(64 - KEY_BITS), return_inverse=True)
    often = counts[place] if len(keys) else np.empty(0, np.uint32)
    order = np.lexsort((full, often, doc))  # rare ones first
    often, full = often[order], full[order]
    at = np.searchsorted(doc, np.arange(len(w.ids) + 1))
    n = np.diff(at)
    first = _prefix_lengths(n, percent)
    salted = mixed(full ^ np.uint64(0x5851F42D4C957F2D))
    rows = []
    for d in range(len(w.ids)):
        lo, k = at[d], int(n[d])
        head = slice(lo, lo + (first[d] if k else 0))
        whole = slice(lo, lo + k)
        shared = np.flatnonzero(often[head])
        sums = np.array([full[whole].sum(dtype=np.uint64), salted[whole].sum(dtype=np.uint64), mixed(full[head]).sum(dtype=np.uint64)], np.uint64)
        rows.append(
            (
                (row["pack"] << 22) + d, None if w.ids[d] == NULL_ID else int(w.ids[d]), k, *_signed(sums).tolist(),
                _signed(full[head][shared]).tolist(), shared.tolist(),
            )
        )
    return [batch(DOC_SCHEMA, rows)]


def _members(row: dict, wanted: pa.Table, size: int) -> list[pa.RecordBatch]:
    if not wanted.num_rows:
        return []
    w = words_of(row, lower=True)
    doc, full = _sets(w, size)
    at = np.searchsorted(doc, np.arange(len(w.ids) + 1))
    uids = wanted.column("uid").to_pylist()
    return [batch(SET_SCHEMA, [(u, full[at[d := u & ((1 << 22) - 1)] : at[d + 1]].tobytes()) for u in uids])]


def _alike(percent: int):
    """Filters pairs (a, b, x, y) of sorted sets x and y."""

    def run(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def verified(pairs: DataFrame, packs: DataFrame, size: int, percent: int) -> DataFrame:
    """Of the pairs (a, b) of uids those whose sets are alike enough, by comparing the whole sets."""
    uids = pairs.select(F.col("a").alias("uid")).union(pairs.select("b")).distinct()
    wanted = uids.withColumn("pack", F.shiftright("uid", 22))
    sets = written(with_replies(packs, wanted, lambda row, t: _members(row, t, size), SET_SCHEMA), release=True)
    x, y = (sets.select(F.col("uid").alias(k), F.col("members").alias(v)) for k, v in (("a", "x"), ("b", "y")))
    # A text with very many pairs would else bring all their sets into one task.
    both = spread_join(spread_join(pairs, x, ["a"], "b"), y, ["b"], "a").select("a", "b", "x", "y")
    out = written(both.mapInArrow(_alike(percent), "a long, b long"), release=True)
    discard(sets)
    return out


def _fits(a: str, b: str, percent: int):
    """Of a shared token at place p of n: sizes are near enough, and enough members are left from it on.

    Alike sets pass this at the first token that they share, so it is enough to look at tokens that do."""
    na, nb, pa_, pb = (F.col(f"{t}.{c}") for c in ("n", "p") for t in (a, b))
    need = F.ceil(percent * (na + nb) / F.lit(100 + percent) - F.lit(1e-9))
    return (100 * F.least(na, nb) >= percent * F.greatest(na, nb)) & (F.least(na - pa_, nb - pb) >= need)


def link(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of each row of docs (doc_id, text).

    A document's set is its distinct shingles of ``size`` words in ASCII lower case (all words, if fewer); sets link
    if 100 * intersection >= percent * union; component_id is the least doc_id reachable by links.

    1. Packs exchange how many documents have each shingle. In the order of that count, alike sets share a shingle
       of their first ones; shingles of one document can't be it and are left out, so a text that is like no
       other has no row in any join.
    2. Rows with equal sets are one text; texts of equal prefix and size are one group. Groups that share a
       prefix token are paired: first with the token's most central group (it has it at the earliest place), which
       is as many pairs as rows; members are expanded and verified on whole sets, and linked texts become components.
    3. Then all other pairs that share a token, pass the size and place filters and aren't in one component yet
       are expanded and verified. Nothing is left out, but a large group of near copies isn't compared all with all.

    Null or blank text: no shingles, linked with nothing, its own component. Null doc_id: its row's component is the
    least id reachable, null if there is none. Repeated rows are one text. Other columns aren't read.
    """
    packs = written(packed(docs), release=True)
    layout = Layout.of(packs)

    def send_counts(row):
        _, full = _sets(words_of(row, lower=True), size)
        keys, counts = np.unique(full >> np.uint64(64 - KEY_BITS), return_counts=True)
        yield from send(row["pack"], keys, counts.astype(np.uint32), layout, COUNTS)

    counts = exchange(each_pack(packs, send_counts, SENT_SCHEMA), layout, [COUNTS])
    rows = with_replies(packs, counts, lambda row, t: _documents(row, replied(t, COUNTS), size, percent), DOC_SCHEMA)
    rows = written(rows, release=True)
    discard(counts)

    shared = rows.filter(F.size("tokens") > 0)
    sig = ["sig1", "sig2", "n"]
    reps = shared.groupBy(*sig).agg(F.min("uid").alias("uid"), F.count(F.lit(1)).alias("weight"))
    texts = reps.select("uid", "weight").join(shared.select("uid", "n", "prefix", "tokens", "places"), "uid")
    gids = texts.groupBy("prefix", "n").agg(F.min("uid").alias("gid"), F.sum("weight").alias("gweight"))
    texts = written(texts.join(gids, ["prefix", "n"]))
    tokens = texts.filter("uid = gid").select("gid", "n", "gweight", F.explode(F.arrays_zip("tokens", "places")).alias("t"))
    tokens = written(tokens.select("gid", "n", "gweight", F.col("t.tokens").alias("token"), F.col("t.places").alias("p")))
    members = texts.select("gid", "uid")

    hubs = tokens.groupBy("token").agg(F.min(F.struct("p", -F.col("gweight"), "gid", "n")).alias("h"), F.count(F.lit(1)).alias("c"))
    hubs = hubs.filter("c > 1").select("token", F.col("h.gid").alias("gid"), F.col("h.n").alias("n"), F.col("h.p").alias("p"))
    hubs = hubs.select("token", F.struct("gid", "n", "p").alias("x"))
    fit = (F.col("x.gid") != F.col("y.gid")) & _fits("x", "y", percent)
    near = spread_join(tokens.select("token", "gid", F.struct("gid", "n", "p").alias("y")), hubs, ["token"], "gid", fit)
    stars = near.select(F.col("x.gid").alias("ga"), F.col("y.gid").alias("gb")).distinct()
    pairs = stars.join(members.withColumnRenamed("gid", "gb"), "gb").select(F.col("ga").alias("a"), F.col("uid").alias("b"))
    inside = members.filter("gid != uid").select(F.col("gid").alias("a"), F.col("uid").alias("b"))
    pairs = pairs.union(inside).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = written(pairs)
    edges = verified(pairs, packs, size, percent)
    nodes = texts.select(F.col("uid").alias("node"))
    label = components(nodes, edges)

    # Each text now has its component; a group counts as settled in one if all its members are.
    member = texts.select("gid", "uid").join(label.withColumnRenamed("node", "uid"), "uid")
    group = written(member.groupBy("gid").agg(F.min("label").alias("lo"), F.max("label").alias("hi")))
    known = tokens.join(group, "gid")
    mixed_tokens = known.groupBy("token").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).filter("lo != hi").select("token")
    known = written(spread_join(known, mixed_tokens, ["token"], "gid").select("token", "gid", "n", "p", "lo", "hi"))
    apart = (F.col("x.lo") != F.col("x.hi")) | (F.col("y.lo") != F.col("y.hi")) | (F.col("x.lo") != F.col("y.lo"))
    # Which sizes and places of a token fit is found among those that occur, so that a token's groups meet only where they can be alike.
    kinds = known.select("token", "n", "p").distinct()
    fitting = kinds.alias("x").join(kinds.alias("y"), (F.col("x.token") == F.col("y.token")) & _fits("x", "y", percent))
    fitting = fitting.select(F.col("x.token").alias("token"), *[F.col(f"{t}.{c}").alias(f"{t}{c}") for t in "xy" for c in "np"])
    at = lambda t: (F.col(f"{t}.token") == F.col("f.token")) & (F.col(f"{t}.n") == F.col(f"f.{t}n")) & (F.col(f"{t}.p") == F.col(f"f.{t}p"))
    more = known.alias("x").join(fitting.alias("f"), at("x")).join(known.alias("y"), at("y") & (F.col("x.gid") < F.col("y.gid")) & apart)
    more = more.select(F.col("x.gid").alias("ga"), F.col("y.gid").alias("gb"))
    within = group.filter("lo != hi").select(F.col("gid").alias("ga"), F.col("gid").alias("gb"))
    more = more.union(within).distinct()
    of = lambda g, u, c: member.select(F.col("gid").alias(g), F.col("uid").alias(u), F.col("label").alias(c))
    wide = more.join(of("ga", "a", "la"), "ga").join(of("gb", "b", "lb"), "gb").filter("la != lb and a != b")
    wide = wide.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(pairs, ["a", "b"], "left_anti")
    wide = written(wide)
    rest = verified(wide, packs, size, percent)
    discard(packs)
    discard(label)
    label = components(nodes, edges.union(rest))

    of_text = reps.select(*sig, F.col("uid").alias("rep")).join(label, F.col("rep") == F.col("node")).select(*sig, "label")
    least = shared.groupBy(*sig).agg(F.min("doc_id").alias("least")).join(of_text, sig)
    of_label = least.groupBy("label").agg(F.min("least").alias("component_id"))
    of_sig = written(least.join(of_label, "label").select(*sig, "component_id"))
    linked = spread_join(shared.select("uid", "doc_id", *sig), of_sig, sig, "uid")
    linked = linked.select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")
    alone = rows.filter(F.size("tokens") == 0).select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    out = written(linked.union(alone))
    discard(rows, texts, tokens, pairs, group, known, wide, of_sig, edges, rest, label)
    return out


def op9_jaccard_join(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return link(docs, size=4, percent=85)


_WORDS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS_SQL} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e2 AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT doc_id AS v, doc_id AS c FROM d UNION SELECT e2.b, r.c FROM r JOIN e2 ON e2.a = r.v)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(r.c) AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN r ON r.v = d.doc_id GROUP BY ALL
"""
