"""Mixing sources to target weights: capped water-filling, then seeded repetitions."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quaestor.llm.native import apart, n_words, together
from quaestor.llm.storage import written
from quaestor.sources.readers import estimated_bytes

WEIGHTS = (5, 2, 1)
ADDED = ("size", "source_size", "target", "taken", "copies")
BIN_CHARS = 3  # at least: 4,096 bins of the draw for each source
BIN_BYTES = 256 << 20  # of documents in a bin, about, by the optimizer's estimate; larger tables have 16 times more bins, and again


def _draw(seed: int):
    """A draw for each document: documents of a source are taken in the order of this text."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))


def targets(sizes: DataFrame, share: float, max_epochs: int, weights: tuple[int, ...]) -> DataFrame:
    """source, source_size, target by water-filling.

    sizes: one row per source. A source is clamped at max_epochs times its size
    (a handful of rows: sources are the parts of a mix, not a key of the data)
    as soon as the level, which is what is left to share out per weight, would pass that.
    In the order of clamp per weight the clamped ones come first, so that two running
    sums give the level for each source; it is one pass whatever the number of sources. The level of the first
    free source holds for all free ones; it is the greatest of theirs, as later ones count free sources as clamped.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    filling = Window.orderBy(F.col("clamp") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    out = (
        sizes.withColumn("weight", weight.cast("long"))
        .withColumn("clamp", F.lit(max_epochs).cast("long") * F.col("source_size"))
        .withColumn("total", F.lit(float(share)) * F.sum("source_size").over(everything))
        .withColumn("clamped_before", F.sum("clamp").over(filling.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("clamp"))
        .withColumn("weight_left", F.sum("weight").over(filling.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("level", (F.col("total") - F.col("clamped_before")) / F.col("weight_left"))
        .withColumn("free", F.col("clamp") / F.col("weight") > F.col("level"))
        .withColumn("at", F.max(F.when(F.col("free"), F.col("level"))).over(everything))
    )
    filled = F.when(F.col("free"), F.col("weight") * F.col("at")).otherwise(F.col("clamp").cast("double"))
    return out.select("source", "source_size", filled.alias("target"))


def mix(docs: DataFrame, share: float = 1.5, max_epochs: int = 2, weights: tuple[int, ...] = WEIGHTS, seed: int = 7, source: str = "source") -> DataFrame:
    """docs with size, source_size, target, taken and copies (how often the mix holds the row).

    Each source's documents are all taken ``whole`` times, and once more in the order of a
    seeded draw until the rest of the target is filled; a document goes in if its
    middle word is within the rest. The draw's first digits are bins, summed by (source, bin)
    before any shuffle; only the one bin in which the rest runs out (a 4,096th of a source, less of a large table)
    is ranked document by document, by draws and sizes alone, so a source with a third of all rows stays in many tasks.

    Null text: size 0, copies as drawn, taken 0. Null source: a source of its own, the last.
    Rows with equal doc_id have equal draws and go in or stay out together. An
    empty table gives an empty result. Added columns replace columns of docs of those names.
    """
    rows, names = apart(docs, doc_id="doc_id", text="text", _src=source)
    sized = rows.withColumns({"size": n_words(F.col("text")), "_draw": _draw(seed)})
    chars = max(BIN_CHARS, math.ceil(math.log(max(1, estimated_bytes(docs)) / BIN_BYTES, 16)))
    sized = sized.withColumn("_bin", F.substring("_draw", 1, min(chars, 16)))
    bins = written(sized.groupBy("_src", "_bin").agg(F.sum("size").alias("n")))
    plan = targets(bins.groupBy(F.col("_src").alias("source")).agg(F.sum("n").alias("source_size")), share, max_epochs, weights)
    plan = plan.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    plan = plan.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    by_bin = Window.partitionBy("_src").orderBy("_bin")
    running = bins.withColumn("before", F.sum("n").over(by_bin) - F.col("n")).join(plan, F.col("_src").eqNullSafe(F.col("source")))
    last = running.filter(F.col("before") < F.col("rest")).groupBy("_src").agg(F.max(F.struct("_bin", "before")).alias("m"))
    plan = plan.join(last, F.col("source").eqNullSafe(F.col("_src")), "left")
    # A written table has a known size; Spark broadcasts it by that, or joins by shuffle.
    plan = written(plan.select(F.col("source").alias("_s"), "source_size", "target", "whole", "rest", F.col("m._bin").alias("_last"), F.col("m.before").alias("_before")))
    rows = sized.join(plan, F.col("_src").eqNullSafe(F.col("_s")), "left")
    inside = F.coalesce(F.col("_bin") == F.col("_last"), F.lit(False))
    more = F.coalesce((F.col("_bin") < F.col("_last")).cast("long"), F.lit(0))
    outer = rows.filter(~inside).withColumn("copies", F.col("whole") + more)
    # Rows of one draw are those of one doc_id. Few fields of one bin are ranked, and the rows meet their rank again by draw.
    drawn = rows.filter(inside).groupBy("_src", "_draw", "_before").agg(F.sum("size").alias("_n"))
    ranked = drawn.select(F.col("_src").alias("_of"), F.col("_draw").alias("_at"), (F.col("_before") + F.sum("_n").over(Window.partitionBy("_src").orderBy("_draw"))).alias("_upto"))
    inner = rows.filter(inside).join(written(ranked), F.col("_src").eqNullSafe(F.col("_of")) & (F.col("_draw") == F.col("_at"))).drop("_of", "_at")
    inner = inner.withColumn("copies", F.col("whole") + (F.col("_upto") - F.col("size") / 2 <= F.col("rest")).cast("long")).drop("_upto")
    both = outer.unionByName(inner).withColumn("taken", F.col("size") * F.col("copies"))
    return together(both, names, ADDED)


def op10_source_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('7:' || coalesce(doc_id::VARCHAR, 'null')) AS draw FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight, 2 * source_size AS clamp,
        1.5::DOUBLE * (sum(source_size) OVER ())::BIGINT AS total FROM s),
f AS (SELECT *, (total - coalesce((sum(clamp) OVER (ORDER BY clamp / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))::BIGINT, 0))
        / (sum(weight) OVER (ORDER BY clamp / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS level FROM w),
t AS (SELECT source, source_size,
        CASE WHEN clamp / weight > level THEN weight * (max(level) FILTER (WHERE clamp / weight > level) OVER ()) ELSE clamp::DOUBLE END AS target FROM f),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t),
r AS (SELECT doc_id, size, source_size, target, whole, target - whole * source_size AS rest,
        (sum(size) OVER (PARTITION BY d.source ORDER BY draw, doc_id))::BIGINT AS upto
      FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
  (size * (whole + CASE WHEN rest > 0 AND upto - size / 2 <= rest THEN 1 ELSE 0 END))::BIGINT AS taken FROM r
"""
