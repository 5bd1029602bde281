"""Joins by time: the last row as of a time, and intervals that hold a point.

Both cut time into buckets, so that a key with very many rows is many small groups: nothing but one row for each key and bucket is ever brought together by key alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaestor.functions.columns import col


def _seconds(time: Column) -> Column:
    """Whole seconds since 1970 of a timestamp with or without zone, or a date."""
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), time.cast("timestamp_ntz"))


def _bucket(time: Column, width: int) -> Column:
    return F.floor(_seconds(time) / F.lit(width)).cast("long")


def asof_join(left: DataFrame, right: DataFrame, on: dict[str, str], time: tuple[str, str], order: list[str] | None = None, width: int = 30 * 86_400, prefix: str = "") -> DataFrame:
    """left with the columns of right's last row of its key that isn't later; nulls where there is none.

    on: left's key columns and right's; time: both time columns; order: right's columns that choose among rows of one time (the greatest; all its columns, if not given).
    Right's columns get ``prefix``. Rows of left with a null key or time meet none.

    Rows meet within a bucket of ``width`` seconds; what a bucket doesn't have comes from the last one before it that has a row, which is found among one row for each key and bucket.
    """
    keys = list(on)
    ks = [f"_k{i}" for i in range(len(keys))]
    names = {c: f"{prefix}{c}" for c in right.columns}
    chosen = F.struct(col(time[1]).cast("timestamp_ntz").alias("_t"), *[col(c).alias(f"_o{i}") for i, c in enumerate(order or right.columns)], F.struct(*[col(c).alias(n) for c, n in names.items()]).alias("_row"))
    there = right.select(*[col(on[k]).alias(a) for k, a in zip(keys, ks)], chosen.alias("_r")).filter(F.col("_r._t").isNotNull())
    there = there.withColumn("_b", _bucket(F.col("_r._t"), width))
    asked = left.select(*[col(k).alias(a) for k, a in zip(keys, ks)], col(time[0]).cast("timestamp_ntz").alias("_t"), F.struct(*[col(c) for c in left.columns]).alias("_left"))
    asked = asked.withColumn("_b", F.coalesce(_bucket(F.col("_t"), width), F.lit(-(1 << 40))))
    kind = there.schema["_r"].dataType
    # One row for each key and bucket: the last of the bucket; and with it what the buckets before it leave.
    last = there.groupBy(*ks, "_b").agg(F.max("_r").alias("_m")).unionByName(asked.select(*ks, "_b").distinct().withColumn("_m", F.lit(None).cast(kind)))
    before = Window.partitionBy(*ks).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.groupBy(*ks, "_b").agg(F.max("_m").alias("_m")).withColumn("_carried", F.last("_m", ignorenulls=True).over(before)).select(*ks, "_b", "_carried")
    empty = asked.schema["_left"].dataType
    both = asked.select(*ks, "_b", "_t", F.lit(1).alias("_side"), "_left", F.lit(None).cast(kind).alias("_r"))
    both = both.unionByName(there.select(*ks, "_b", F.col("_r._t").alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(empty).alias("_left"), "_r"))
    upto = Window.partitionBy(*ks, "_b").orderBy("_t", "_side", "_r").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = both.withColumn("_found", F.last("_r", ignorenulls=True).over(upto)).filter("_side = 1")
    same = [F.col(f"x.{a}").eqNullSafe(F.col(f"y.{a}")) for a in [*ks, "_b"]]
    joined = met.alias("x").join(carried.alias("y"), same, "left").select("x.*", "y._carried")
    usable = F.col("_t").isNotNull()
    for a in ks:
        usable = usable & F.col(a).isNotNull()
    row = F.when(usable, F.coalesce("_found", "_carried")["_row"])
    return joined.select("_left", row.alias("_row")).select("_left.*", *[F.col("_row")[n].alias(n) for n in names.values()])


def _by_place(df: DataFrame, mark: str, keys: list[str], times: list[str]) -> tuple[DataFrame, list[str], list[Column], list[Column]]:
    """df with its columns named by their places, these names, and its keys and times among them; names are found in any case, as Spark finds them.

    A time of another type is cast into a column of its own; all else is held once, so that a shuffle doesn't carry a key or time as a value and again for the join.
    """
    names = [f"{mark}{i}" for i in range(len(df.columns))]
    place = {c.lower(): n for c, n in zip(df.columns, names)} | dict(zip(df.columns, names))
    find = lambda c: place.get(c, place.get(c.lower(), c))
    placed = df.select(*[col(c).alias(n) for c, n in zip(df.columns, names)])
    kinds = dict(placed.dtypes)
    cast = {c: f"{mark}t{i}" for i, c in enumerate(times) if kinds.get(find(c)) != "timestamp_ntz"}
    placed = placed.withColumns({n: F.col(find(c)).cast("timestamp_ntz") for c, n in cast.items()}) if cast else placed
    return placed, names, [F.col(find(c)) for c in keys], [F.col(cast.get(c, find(c))) for c in times]


def range_join(points: DataFrame, intervals: DataFrame, on: dict[str, str], time: str, bounds: tuple[str, str], width: int = 86_400, prefix: str = "") -> DataFrame:
    """Each row of points with each interval of its key that holds its time: start <= time < end. Nulls meet nothing.

    An interval is repeated for each bucket of ``width`` seconds that it touches, so the width should be near the usual length: a wider one lets more rows meet that then don't
    fit, a narrower one repeats intervals more often. A key and bucket meet as an equality, which Spark shuffles and, where one is hot, splits. The keys come first in it, since Spark
    sorts by the first column's prefix before it compares rows.
    """
    held, held_names, held_keys, (start, end) = _by_place(intervals, "_i", [*on.values()], [*bounds])
    held = held.filter(start.isNotNull() & (start < end)).withColumn("_b", F.explode(F.sequence(_bucket(start, width), _bucket(end, width))))
    at, names, keys, (when,) = _by_place(points, "_p", [*on], [time])
    at = at.withColumn("_pb", _bucket(when, width))
    met = (F.col("_pb") == F.col("_b")) & (start <= when) & (when < end)
    for k, h in reversed([*zip(keys, held_keys)]):
        met = (k == h) & met
    return at.join(held, met).select(*[F.col(n).alias(c) for n, c in zip(names, points.columns)], *[F.col(n).alias(f"{prefix}{c}") for n, c in zip(held_names, intervals.columns)])
