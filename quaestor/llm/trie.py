"""Conversation prefix trie: chained digests of every prefix, nodes by (depth, digest), subtree sums by ancestors.

A conversation owns the nodes of which it is the smallest member. As members only get fewer with depth, it owns the last
part of its path or nothing, and a node is known by its owner and depth from the moment that owners are known: two whole numbers.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quaestor.llm.packs import batch
from quaestor.llm.storage import discard, written

ROOT = bytes(32)
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()
#: Nodes that more than this part of all prefixes reach are fewer than its inverse; they are broadcast, the others joined by shuffle.
HOT_PART = 10_000
CHUNK_BYTES = 1 << 20  # of a node's list of members, from which its digest is taken
PREFIX_SCHEMA = "conv_id long, depth long, digest binary, chars long, ends boolean"
CHUNK_SCHEMA = "owner long, depth long, first long, ids binary"
ENDS_SCHEMA = "owner long, depth long, ends_sha256 string"


def turn_digests(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text_sha, chars of each row of conversations (conv_id, turn, role, text): texts themselves are never shuffled.

    Null role or text: empty. Rows without conv_id belong to no conversation and are left out.
    """
    text = F.coalesce("text", F.lit(""))
    return conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit("")).alias("role"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("text_sha"), F.char_length(text).cast("long").alias("chars"),
    )


def rebuilt(turns: DataFrame, every: int = 100, heads: int = 6) -> DataFrame:
    """conv_id, part, place, role, text_sha, chars: each conversation c begins with the first h turns of conversation c - c % every (all if fewer,
    none if absent) and goes on with its own after its first h; h = crc32(c) % heads.

    Part 0 are the former, part 1 the latter, part -1 is a row without text_sha that says that the conversation is there.
    Turns are in the order of turn (null first), role and text_sha. At most ``every`` conversations share a beginning of fewer than ``heads`` turns.
    """
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text_sha"))
    placed = written(turns.withColumn("place", place.cast("long")).drop("turn"))
    borrowed = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    there = placed.filter("place = 1").select("conv_id", (F.col("conv_id") - F.col("conv_id") % every).alias("of"), borrowed.alias("h"))
    firsts = placed.filter((F.col("conv_id") % every == 0) & (F.col("place") < heads)).withColumnRenamed("conv_id", "of")
    begun = there.join(firsts, "of").filter("place <= h").select("conv_id", F.lit(0).alias("part"), "place", "role", "text_sha", "chars")
    own = placed.filter(F.col("place") > borrowed).select("conv_id", F.lit(1).alias("part"), "place", "role", "text_sha", "chars")
    marks = there.select("conv_id", F.lit(-1).alias("part"), F.lit(0).cast("long").alias("place"), F.lit("").alias("role"), F.lit(None).cast("binary").alias("text_sha"), F.lit(0).cast("long").alias("chars"))
    out = marks.unionByName(begun).unionByName(own)
    out._reads = placed
    return out


def _chained(batches):
    """Rows of PREFIX_SCHEMA from rows (conv_id, role, text_sha, chars) in order: the root, then a row for each turn; the last of each conversation ends it."""
    now, digest, depth = None, ROOT, 0
    rows: list[list] = []
    for b in batches:
        for conv, role, text_sha, chars in zip(*(b.column(k).to_pylist() for k in range(4))):
            if conv != now:
                if rows:
                    rows[-1][4] = True
                now, digest, depth = conv, ROOT, 0
                rows.append([conv, 0, ROOT, 0, False])
            if text_sha is not None:
                named = role.encode()
                digest = hashlib.sha256(digest + len(named).to_bytes(8, "big") + named + text_sha).digest()
                depth += 1
                rows.append([conv, depth, digest, chars, False])
        if len(rows) > 1:
            yield batch(PREFIX_SCHEMA, rows[:-1])
            del rows[:-1]
    if rows:
        rows[-1][4] = True
        yield batch(PREFIX_SCHEMA, rows)


def prefixes(turns: DataFrame, order: list[str]) -> DataFrame:
    """Every prefix of every conversation, by its chained digest. Rows stream in order: a task holds a batch, however long the conversation."""
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = turns.repartition(n, "conv_id").sortWithinPartitions("conv_id", *order, "role", "text_sha")
    return ordered.select("conv_id", "role", "text_sha", "chars").mapInArrow(_chained, PREFIX_SCHEMA)


def _owned(paths: DataFrame) -> DataFrame:
    """paths with each prefix's owner (its smallest member) and n_convs, its members."""
    nodes = written(paths.groupBy("depth", "digest").agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("owner")))
    often = F.col("n_convs") > max(64, paths.count() // HOT_PART)
    with_hot = paths.join(F.broadcast(nodes.filter(often)), ["depth", "digest"], "left")
    cold = with_hot.filter("owner is null").drop("owner", "n_convs").join(nodes.filter(~often), ["depth", "digest"])
    out = written(with_hot.filter("owner is not null").unionByName(cold).drop("digest"))
    discard(nodes)
    return out


def _chunks(batches):
    """Sorted rows (owner, depth, conv_id) as comma-joined lists, cut where they get long or a task ends."""
    now, ids, size = None, [], 0

    def chunk():
        return (now[0], now[1], ids[0], ",".join(map(str, ids)).encode())

    for b in batches:
        done = []
        for *node, conv in zip(*(b.column(k).to_pylist() for k in range(3))):
            if node != now or size > CHUNK_BYTES:
                if now is not None:
                    done.append(chunk())
                now, ids, size = node, [], 0
            ids.append(conv)
            size += len(str(conv)) + 1
        if done:
            yield batch(CHUNK_SCHEMA, done)
    if now is not None:
        yield batch(CHUNK_SCHEMA, [chunk()])


def _digests(batches):
    """A digest for each node from its chunks in order."""
    now, state = None, None
    for b in batches:
        done = []
        for owner, depth, data in zip(*(b.column(k).cast(pa.large_binary()).to_pylist() if k == 2 else b.column(k).to_pylist() for k in range(3))):
            if now != (owner, depth):
                if now is not None:
                    done.append((*now, state.hexdigest()))
                now, state = (owner, depth), hashlib.sha256(data)
            else:
                state.update(b"," + data)
        if done:
            yield batch(ENDS_SCHEMA, done)
    if now is not None:
        yield batch(ENDS_SCHEMA, [(*now, state.hexdigest())])


def _ends(paths: DataFrame) -> DataFrame:
    """owner, depth, ends_sha256 of nodes at which conversations end. The members of one node are cut over tasks; only their chunks meet, one after the other."""
    n = int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = ["owner", "depth", "conv_id"]
    chunks = paths.filter("ends").select(*key).repartitionByRange(n, *key).sortWithinPartitions(*key).mapInArrow(_chunks, CHUNK_SCHEMA)
    ordered = chunks.repartition(n, "owner", "depth").sortWithinPartitions("owner", "depth", "first")
    return ordered.select("owner", "depth", "ids").mapInArrow(_digests, ENDS_SCHEMA)


def prefix_trie(turns: DataFrame, order: list[str] | None = None) -> DataFrame:
    """One row for each distinct prefix: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    turns: conv_id, role, text_sha, chars and the columns of ``order`` (turn, if not given), as turn_digests gives them; ties by role and text_sha, so that
    repeated rows are turns of their own. A row without text_sha says that a conversation is there and adds no turn.

    1. Each conversation's prefixes get chained digests. Nodes are prefixes grouped by depth and digest, summed before the shuffle, so a first turn
       that a third of all conversations share is one row from each task; its many prefixes meet it by broadcast.
    2. A conversation's own nodes are a run at the end of its path; above it are the runs of others. For subtree sums each run is
       exploded to all runs above it, with the depth at which it hangs (not to all nodes above: a long conversation would make the square of
       its length), summed by (run, depth), and a running sum goes up each run.
    3. Members that end at a node are listed in chunks over many tasks; only one digest per node runs over the chunks.

    An empty table has no conversation, hence no node. One conversation is chained by one task, which streams.
    """
    paths = written(prefixes(turns, order or ["turn"]))
    owned = _owned(paths)
    discard(paths)
    along = Window.partitionBy("conv_id").orderBy("depth")
    mine = owned.withColumn("parent", F.lag("owner").over(along)).filter("conv_id = owner")
    none = F.lit(None).cast("long")
    zero = F.lit(0).cast("long")
    nodes = mine.select("owner", "depth", "n_convs", "parent", ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"), zero.alias("child"))
    children = mine.filter("parent is not null").select(F.col("parent").alias("owner"), (F.col("depth") - 1).alias("depth"), none.alias("n_convs"), none.alias("parent"), zero.alias("saved"), F.lit(1).cast("long").alias("child"))
    nodes = nodes.unionByName(children).groupBy("owner", "depth").agg(F.max("n_convs").alias("n_convs"), F.max("parent").alias("parent"), F.sum("saved").alias("saved"), F.sum("child").alias("n_children"))
    nodes = written(nodes.withColumn("leaf", (F.col("n_children") == 0).cast("long")))

    runs = nodes.groupBy(F.col("owner").alias("run")).agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved"))
    above = owned.filter("conv_id != owner").groupBy(F.col("conv_id").alias("run"), "owner").agg(F.max("depth").alias("depth"))
    hung = above.join(runs, "run").groupBy("owner", "depth").agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved"))
    hung = hung.select("owner", "depth", none.alias("n_convs"), none.alias("parent"), "saved", none.alias("n_children"), "leaf")
    both = nodes.unionByName(hung).groupBy("owner", "depth").agg(*[f(c).alias(c) for f, c in ((F.max, "n_convs"), (F.max, "parent"), (F.max, "n_children"), (F.sum, "leaf"), (F.sum, "saved"))])
    upward = Window.partitionBy("owner").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = both.withColumn("n_leaves", F.sum("leaf").over(upward)).withColumn("saved_tokens", F.sum("saved").over(upward))
    out = sums.join(_ends(owned), ["owner", "depth"], "left")
    out = written(out.select(
        F.col("owner").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(EMPTY_SHA256)).alias("ends_sha256"),
    ))
    discard(owned, nodes)
    return out


def op13_prefix_trie(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    turns = rebuilt(turn_digests(rows))
    out = prefix_trie(turns, ["part", "place"])
    discard(turns._reads)
    return out


_CRC32 = """list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length({0}::VARCHAR) + 1), lambda i: ascii(substr({0}::VARCHAR, i::INT, 1))::BIGINT)),
  lambda crc, b: list_reduce(list_prepend(xor(crc, b), range(8)), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END))"""
SQL = f"""
WITH RECURSIVE t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(coalesce(text, ''))) AS place
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT DISTINCT conv_id, conv_id - conv_id % 100 AS head, xor({_CRC32.format("conv_id")}, 4294967295::BIGINT) % 6 AS h FROM t),
b AS (SELECT c.conv_id, 0 AS part, place, role, text FROM c JOIN t ON t.conv_id = c.head AND place <= h
      UNION ALL SELECT c.conv_id, 1, place, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND place > h),
p AS (SELECT c.conv_id, coalesce(list({{'role': role, 'text': text}} ORDER BY part, place) FILTER (WHERE role IS NOT NULL), []) AS path
      FROM c LEFT JOIN b USING (conv_id) GROUP BY c.conv_id),
x AS (SELECT conv_id, len(path) AS n, path[1:d] AS prefix, d AS depth FROM (SELECT conv_id, path, unnest(range(0, len(path) + 1)) AS d FROM p)),
n AS (SELECT depth, prefix, min(conv_id) AS conv_id, count(*) AS n_convs, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE n = depth) AS ends FROM x GROUP BY depth, prefix),
k AS (SELECT n.*, m.conv_id AS parent_conv_id, (n.n_convs - 1) * coalesce(length(n.prefix[n.depth].text), 0) AS saved
      FROM n LEFT JOIN n m ON m.depth = n.depth - 1 AND m.prefix = n.prefix[1:n.depth - 1]),
f AS (SELECT k.*, (SELECT count(*) FROM k q WHERE q.depth = k.depth + 1 AND q.parent_conv_id = k.conv_id) AS n_children FROM k),
s AS (SELECT a.depth, a.conv_id, sum((d.n_children = 0)::INT) AS n_leaves, sum(d.saved) AS saved_tokens
      FROM f a JOIN f d ON d.depth >= a.depth AND d.prefix[1:a.depth] = a.prefix GROUP BY a.depth, a.conv_id)
SELECT f.conv_id, f.depth::BIGINT AS depth, f.parent_conv_id, f.n_convs::BIGINT AS n_convs, f.n_children::BIGINT AS n_children, s.n_leaves::BIGINT AS n_leaves,
       s.saved_tokens::BIGINT AS saved_tokens, sha256(coalesce(f.ends, '')) AS ends_sha256
FROM f JOIN s USING (depth, conv_id)
"""
