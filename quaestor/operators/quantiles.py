"""Exact quantiles without a task that holds all values.

A sketch of fixed size brackets each quantile. Only values within a bracket (about a thousandth of the rows, or
all of up to 10,000 rows) are then counted one by one; all others are counted in lumps between brackets, so that ranks stay exact. A table that is small by
the optimizer's estimate needs no brackets: its values are counted at once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaestor.functions.columns import col
from quaestor.sources.readers import estimated_bytes

#: Of the sketch; its ranks are off by no more than the inverse, and a bracket reaches five times as far to each side.
ACCURACY = 10_000
MARGIN = 5 / ACCURACY
#: A table of at most so many bytes is counted value by value in one pass: a task then holds no more than these.
SMALL_BYTES = 16 << 20
#: Brackets of so many groups and columns are sent to each task (about 100 bytes each); of more, rows meet them by a shuffle that spreads each group.
BROADCAST_CUTS = 200_000
SALTS = 64  # tasks that a group's rows are then spread over


def quantiles(df: DataFrame, keys: list[str], columns: list[str], fractions: list[float], names: list[str], small_bytes: int | None = None, broadcast_cuts: int = BROADCAST_CUTS) -> DataFrame:
    """``k0``, ``k1``... for the keys, then one of ``names`` for each column: its quantiles at ``fractions``, as an array.

    Linear between neighbours. Nulls don't count; a group has null arrays where a column has no value. Keys mustn't be null.
    Without keys there is one row, of an empty table too. With keys, a group that holds most rows is spread over tasks like any other: rows are only summed by
    (group, value) with partial sums, and of those sums one task ranks what is in a group's brackets, with spill.
    """
    ks = [f"k{i}" for i in range(len(keys))]
    if estimated_bytes(df.select(*[col(c) for c in dict.fromkeys([*keys, *columns])])) <= (SMALL_BYTES if small_bytes is None else small_bytes):
        measures = [F.percentile(col(c).cast("double"), F.array(*map(F.lit, fractions))).alias(n) for c, n in zip(columns, names)]
        return df.groupBy(*[col(k).alias(a) for k, a in zip(keys, ks)]).agg(*measures)
    pairs = F.array(*[F.struct(F.lit(i).alias("c"), col(c).cast("double").alias("v")) for i, c in enumerate(columns)])
    tall = df.select(*[col(k).alias(a) for k, a in zip(keys, ks)], F.inline(pairs)).filter("v is not null")
    edges = [min(1.0, max(0.0, q + side)) for q in fractions for side in (-MARGIN, MARGIN)]
    cuts = tall.groupBy(*ks, "c").agg(F.count(F.lit(1)).alias("total"), F.percentile_approx("v", edges, ACCURACY).alias("cut"))
    both = tall.join(F.broadcast(cuts), [*ks, "c"]) if not keys else _met(tall, cuts, [*ks, "c"], broadcast_cuts)
    v, cut = F.col("v"), F.col("cut")
    inside = reduce(lambda a, b: a | b, [(cut[2 * i] <= v) & (v <= cut[2 * i + 1]) for i in range(len(fractions))], F.col("total") <= ACCURACY)
    lump = F.array_min(F.filter(cut, lambda x: x >= v))  # values between brackets count at the bracket above, before it
    placed = both.select(*ks, "c", "total", inside.alias("inside"), F.when(inside, v).otherwise(lump).alias("at"))
    counts = placed.groupBy(*ks, "c", "total", "inside", "at").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy(*ks, "c").orderBy(F.asc_nulls_last("at"), "inside").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = counts.withColumn("upto", F.sum("n").over(order))
    measures = []
    for i, name in enumerate(names):
        for j, q in enumerate(fractions):
            place = (F.col("total") - 1) * F.lit(q)
            for edge, which in (("low", F.floor(place)), ("high", F.ceil(place))):
                held = (F.col("c") == i) & (F.col("upto") > which)
                measures.append(F.min(F.when(held, F.struct("upto", "at", "inside", (place - F.floor(place)).alias("part")))).alias(f"{edge}_{i}_{j}"))
    found = ranked.groupBy(*ks).agg(*measures)
    return found.select(*ks, *[F.array(*[_between(i, j) for j in range(len(fractions))]).alias(n) for i, n in enumerate(names)])


def _met(tall: DataFrame, cuts: DataFrame, on: list[str], broadcast_cuts: int) -> DataFrame:
    """tall with its group's cuts: no row moves if these are few, else a group's rows go to SALTS tasks."""
    cuts = cuts.persist()  # counted and then sent; it is small, and made again if an executor with it is lost
    if cuts.count() <= broadcast_cuts:
        return tall.join(F.broadcast(cuts), on)
    salt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    return tall.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")).join(cuts.withColumn("salt", salt), [*on, "salt"]).drop("salt")


def _between(i: int, j: int) -> Column:
    low, high = F.col(f"low_{i}_{j}"), F.col(f"high_{i}_{j}")
    value = F.when(low["at"] == high["at"], low["at"]).otherwise(low["at"] * (1 - low["part"]) + high["at"] * low["part"])
    missed = low["inside"].isNotNull() & ~(low["inside"] & high["inside"])
    return F.when(missed, F.raise_error(F.lit("a quantile lies outside its bracket"))).otherwise(value)


def medians(df: DataFrame, keys: list[str], columns: list[str], names: list[str], small_bytes: int | None = None) -> DataFrame:
    """As quantiles, with a number for each column."""
    found = quantiles(df, keys, columns, [0.5], names, small_bytes)
    return found.select(*[f"k{i}" for i in range(len(keys))], *[F.col(n)[0].alias(n) for n in names])
