"""Aggregations: scalar, grouped, described."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaestor.functions.columns import col, number, text
from quaestor.operators.quantiles import medians, quantiles
from quaestor.sources.readers import RID


def _skew(c: Column) -> Column:
    """Bias-corrected, as data frames in memory have it; Spark's own is that of the population."""
    n = F.count(c)
    return F.when(n > 2, F.skewness(c) * F.sqrt(n * (n - 1)) / (n - 2))


def _at_edge(c: Column, last: bool) -> Column:
    """First or last value that is there, by row id."""
    at = F.when(c.isNotNull(), F.col(RID))
    return F.max_by(c, at) if last else F.min_by(c, at)


FUNCTIONS = {
    "sum": lambda c: F.coalesce(F.sum(c), F.lit(0)),
    "mean": F.avg,
    "median": F.median,
    "min": F.min,
    "max": F.max,
    "count": F.count,
    "std": F.stddev_samp,
    "var": F.var_samp,
    "sem": lambda c: F.stddev_samp(c) / F.sqrt(F.count(c)),
    "first": lambda c: _at_edge(c, False),
    "last": lambda c: _at_edge(c, True),
    "nunique": F.count_distinct,
    "size": lambda c: F.count(F.lit(1)),
    "prod": F.product,
    "any": lambda c: F.bool_or(c.cast("boolean")),
    "all": lambda c: F.bool_and(c.cast("boolean")),
    "skew": _skew,
}
#: Other names that plans use.
FUNCTIONS |= {"avg": FUNCTIONS["mean"], "average": FUNCTIONS["mean"], "stddev": FUNCTIONS["std"], "variance": FUNCTIONS["var"], "count_distinct": FUNCTIONS["nunique"]}


def measured(df: DataFrame, keys: list[str], measures: dict[str, tuple[str, str]]) -> DataFrame:
    """Keys, then measures (alias -> (function, column)). Keys mustn't be null. Medians are ranked apart: their values meet in no single task."""
    ranked = [a for a, (f, _) in measures.items() if f == "median"]
    plain = {a: m for a, m in measures.items() if a not in ranked}
    aliases = {a: f"m{i}" for i, a in enumerate(measures)}  # names of columns and measures may be anything
    ks = [f"k{i}" for i in range(len(keys))]
    base = df.groupBy(*[col(k).alias(a) for k, a in zip(keys, ks)])
    out = base.agg(*[FUNCTIONS[f](col(c)).alias(aliases[a]) for a, (f, c) in plain.items()] or [F.lit(0).alias("none")])
    if ranked:
        middle = medians(df, keys, [measures[a][1] for a in ranked], [aliases[a] for a in ranked])
        out = out.join(middle, ks, "left") if keys else out.crossJoin(F.broadcast(middle))  # one row each
    return out.select(*[F.col(a).alias(k) for k, a in zip(keys, ks)], *[F.col(aliases[a]).alias(a) for a in measures])


def scalar(df: DataFrame, function: str, name: str, alias: str = "value") -> DataFrame:
    return measured(df, [], {alias: (function, name)})


def coerced(df: DataFrame, function: str, name: str, alias: str = "value") -> DataFrame:
    """On values as numbers, whatever is none left out; texts without any number have a max and min as texts."""
    of_numbers = FUNCTIONS[function](number(name)).cast("string")
    of_texts = FUNCTIONS[function](text(name)) if function in ("max", "min") else F.lit(None).cast("string")
    return df.agg(F.when(F.count(number(name)) > 0, of_numbers).otherwise(of_texts).alias(alias))


def _present(keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [col(k).isNotNull() for k in keys])


def grouped(df: DataFrame, keys: list[str], measures: dict[str, tuple[str, str]]) -> DataFrame:
    """measures: alias -> (function, column). Rows with a null key go; keys ascend."""
    return measured(df.filter(_present(keys)), keys, measures).orderBy(*[col(k) for k in keys])


def register(name: str, make: Callable[[Column], Column]) -> None:
    """An aggregate of one's own, by name, for plans and measures: from a column to an expression of Spark's aggregates, which are merged from partial ones.

    ``register("geometric_mean", lambda c: F.exp(F.avg(F.log(c))))``. A name that is taken is refused.
    """
    key = name.strip().lower()
    if not key or key in FUNCTIONS:
        raise ValueError(f"{name!r} is no free name for an aggregate")
    FUNCTIONS[key] = make


def group_sets(kind: str, keys: list[str]) -> list[list[str]]:
    """rollup: all keys, all but the last, and so on to none; cube: every part of the keys."""
    if kind == "rollup":
        return [keys[:n] for n in range(len(keys), -1, -1)]
    if kind == "cube":
        return [[k for i, k in enumerate(keys) if not bits >> i & 1] for bits in range(1 << len(keys))]
    raise ValueError(f"no grouping {kind!r}")


def grouped_sets(df: DataFrame, keys: list[str], sets: list[list[str]], measures: dict[str, tuple[str, str]]) -> DataFrame:
    """Keys, then measures (alias -> (function, column)), for each of the sets of keys; a key that a set leaves out is null. Rows with a null key go, so a null means all.

    One pass over the rows, but for medians, which are ranked set by set. Keys ascend, totals last.
    """
    rows = df.filter(_present(keys))
    if any(f == "median" for f, _ in measures.values()):
        kinds = {f.name: f.dataType for f in df.schema}
        parts = []
        for chosen in sets:
            part = measured(rows, chosen, measures)
            parts.append(part.select(*[col(k) if k in chosen else F.lit(None).cast(kinds[k]).alias(k) for k in keys], *[col(a) for a in measures]))
        out = reduce(lambda a, b: a.unionByName(b), parts)
    else:
        aliases = {a: f"m{i}" for i, a in enumerate(measures)}
        named = rows.select("*", *[col(k).alias(f"_k{i}") for i, k in enumerate(keys)])
        at = {k: F.col(f"_k{i}") for i, k in enumerate(keys)}
        base = named.groupingSets([[at[k] for k in chosen] for chosen in sets], *at.values()).agg(*[FUNCTIONS[f](col(c)).alias(aliases[a]) for a, (f, c) in measures.items()])
        out = base.select(*[F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)], *[F.col(aliases[a]).alias(a) for a in measures])
    return out.orderBy(*[col(k).asc_nulls_last() for k in keys])


def group_sizes(df: DataFrame, keys: list[str], alias: str = "Count") -> DataFrame:
    return df.filter(_present(keys)).groupBy(*[col(k) for k in keys]).agg(F.count(F.lit(1)).alias(alias)).orderBy(*[col(k) for k in keys])


def counted(df: DataFrame, alias: str = "Count") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias(alias))


STATISTICS = ("count", "mean", "std", "min", "25%", "50%", "75%", "max")


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """index, then a column for each of ``columns``: count, mean, std, min, quartiles, max; quartiles are ranked apart."""
    stats = []
    for i, c in enumerate(columns):
        v = col(c).cast("double")
        stats.append(F.struct(F.count(v).cast("double").alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("low"), F.max(v).alias("high")).alias(f"s{i}"))
    both = df.agg(*stats).crossJoin(F.broadcast(quantiles(df, [], columns, [0.25, 0.5, 0.75], [f"q{i}" for i in range(len(columns))])))  # one row each
    lines = [F.array(F.col(f"s{i}.n"), F.col(f"s{i}.mean"), F.col(f"s{i}.std"), F.col(f"s{i}.low"), *[F.col(f"q{i}")[j] for j in range(3)], F.col(f"s{i}.high")).alias(c) for i, c in enumerate(columns)]
    one = both.select(*lines)
    named = F.explode(F.arrays_zip(F.array(*map(F.lit, STATISTICS)).alias("index"), *[col(c) for c in columns])).alias("s")
    return one.select(named).select(F.col("s.index").alias("index"), *[F.col(f"s.`{c}`").alias(c) for c in columns])


def describe_text(df: DataFrame, columns: list[str]) -> DataFrame:
    """index (count, unique, top, freq), then a column for each of ``columns``."""
    from quaestor.operators.profile import top_values_of

    top = top_values_of(df, columns, 1).select("column", "value", "n")
    tall = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), text(c).alias("value")) for c in columns])).alias("x"))
    counts = tall.groupBy("x.column").agg(F.count("x.value").alias("count"), F.count_distinct("x.value").alias("unique"))
    both = counts.join(top, "column", "left").select("column", F.array(F.col("count").cast("string"), F.col("unique").cast("string"), "value", F.col("n").cast("string")).alias("v"))
    rows = both.select("column", F.posexplode("v").alias("i", "value")).groupBy("i").pivot("column", columns).agg(F.first("value"))
    names = F.array(*map(F.lit, ("count", "unique", "top", "freq")))
    return rows.orderBy("i").select(F.get(names, F.col("i")).alias("index"), *[col(c) for c in columns])
