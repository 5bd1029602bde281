"""Joins whose hot keys are dealt over many tasks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaestor.llm.storage import discard, written

VALUES = 1 << 12  # hash values of keys by which rows are counted


def salted(many: DataFrame, on: list[str], row: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """many with ``_salt``, and a function that gives a table with each key once the rows to meet it, joined by ``on`` and ``_salt``.

    Rows of many are counted by VALUES hash values of their keys. A value with more than half of a task's mean share gets salts: many adds one by its column
    ``row``, the other side repeats its rows. Salts are a constant of VALUES numbers, so that they are added without a join.
    """
    value = F.pmod(F.xxhash64(*on), F.lit(VALUES))
    counts = written(many.groupBy(value.alias("_value")).agg(F.count(F.lit(1)).alias("_n")))
    tasks = int(many.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = max(64, (counts.agg(F.sum("_n")).head()[0] or 0) // (2 * tasks))
    found = {r._value: -(-r._n // share) for r in counts.filter(F.col("_n") > share).collect()}
    discard(counts)
    if not found:
        return many.withColumn("_salt", F.lit(0)), lambda one: one.withColumn("_salt", F.lit(0))
    table = F.split(F.lit(",".join(str(found.get(v, 1)) for v in range(VALUES))), ",").cast("array<int>")
    salts = F.get(table, value.cast("int"))
    left = many.withColumn("_salt", F.pmod(F.xxhash64(row), salts).cast("int"))
    return left, lambda one: one.withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1)))


def spread_join(many: DataFrame, one: DataFrame, on: list[str], row: str, where: Column | None = None) -> DataFrame:
    """many joined with one, which has each key once; a hot key of many is dealt over tasks by its column ``row``. where: a condition on columns of both."""
    left, repeated = salted(many, on, row)
    keys = [*on, "_salt"]
    right = repeated(one).withColumnsRenamed({k: f"_of_{k}" for k in keys})
    met = F.lit(True) if where is None else where
    for k in keys:
        met = met & (F.col(k) == F.col(f"_of_{k}"))
    return left.join(right, met).drop("_salt", *[f"_of_{k}" for k in keys])
