"""Column profiles, frequent values, outliers and analyses; each in as few passes as there are shapes of result."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quaestor.functions.columns import col, date_like, text
from quaestor.operators.quantiles import medians
from quaestor.sources.readers import RID, Dataset, spread


def profile(ds: Dataset, exact: bool = True, distinct: bool = True, median: bool = True) -> DataFrame:
    """One row for each column: position, column, kind, n_rows, n_present, n_missing, n_distinct, low, high, mean, std, median.

    distinct, median: whether these two are computed (else null); each costs passes and shuffles of its own. exact=False takes
    sketches of fixed size for both (2 % and 0.01 % off), merged from partial ones in the same pass as the rest.
    """
    out = []
    for i, (c, kind) in enumerate(ds.kinds.items()):
        v = text(c) if kind != "nested" else F.to_json(F.struct(col(c)))
        x = col(c).cast("double") if kind == "numeric" else F.lit(None).cast("double")
        many = F.lit(None).cast("long") if not distinct else F.count_distinct(v) if exact else F.approx_count_distinct(v, 0.02)
        middle = F.percentile_approx(x, 0.5, 10_000) if median and not exact else F.lit(None).cast("double")
        out.append(
            F.struct(
                F.lit(i).alias("position"), F.lit(c).alias("column"), F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("n_rows"),
                F.count(col(c)).alias("n_present"), F.count_if(col(c).isNull()).alias("n_missing"), many.alias("n_distinct"),
                F.min(x).alias("low"), F.max(x).alias("high"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), middle.alias("median"),
            )
        )
    rows = (spread(ds.rows) if distinct and exact else ds.rows).agg(F.array(*out).alias("p")).select(F.inline("p"))
    if not (median and exact and ds.numeric):
        return rows
    middles = medians(ds.rows, [], ds.numeric, [f"m{i}" for i in range(len(ds.numeric))])
    tall = middles.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"m{i}").alias("middle")) for i, c in enumerate(ds.numeric)])))
    return rows.join(F.broadcast(tall), "column", "left").withColumn("median", F.col("middle")).select(*rows.columns)  # a row a column


def column_info(ds: Dataset, k: int = 3) -> DataFrame:
    """One row for each column: position, column, type, n_present, and samples, its first k distinct values that are there, as texts in order of first sight."""
    kinds = {f.name: f.dataType.simpleString() for f in ds.rows.schema if f.name != RID}
    views = [text(c) if ds.kinds[c] != "nested" else F.to_json(col(c)) if kinds[c].startswith(("array", "map", "struct")) else F.hex(col(c)) for c in ds.columns]
    counts = ds.rows.agg(F.array(*[F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"), F.lit(kinds[c]).alias("type"), F.count(col(c)).alias("n_present")) for i, c in enumerate(ds.columns)]).alias("x")).select(F.inline("x"))
    tall = ds.rows.select(F.col(RID), F.inline(F.array(*[F.struct(F.lit(i).alias("position"), v.alias("value")) for i, v in enumerate(views)]))).filter("value is not null")
    seen = tall.groupBy("position", "value").agg(F.min(RID).alias("at"))
    place = F.row_number().over(Window.partitionBy("position").orderBy("at", "value"))  # Spark keeps k rows of each task before the shuffle
    first = seen.withColumn("place", place).filter(F.col("place") <= k)
    samples = first.groupBy("position").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "value"))), lambda x: x["value"]).alias("samples"))
    return counts.join(samples, "position", "left").withColumn("samples", F.coalesce("samples", F.array().cast("array<string>")))


def top_values(df: DataFrame, name: str, k: int = 10) -> DataFrame:
    """value, n of the k most frequent values that are there; ties in order of first sight where rows have an id, else by value."""
    first = F.min(RID) if RID in df.columns else F.min(col(name))
    counts = df.filter(col(name).isNotNull()).groupBy(col(name).alias("value")).agg(F.count(F.lit(1)).alias("n"), first.alias("_first"))
    return counts.orderBy(F.desc("n"), "_first", "value").limit(k).drop("_first")


def top_values_of(df: DataFrame, columns: list[str], k: int = 10) -> DataFrame:
    """column, value, n, place for many columns in one grouping; k rows a column, ranked per column."""
    first = F.col(RID) if RID in df.columns else F.lit(0).cast("long")
    df = spread(df.select(RID, *[col(c) for c in dict.fromkeys(columns)])) if RID in df.columns else df
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), text(c).alias("value")) for c in columns])
    tall = df.select(first.alias("_first"), F.explode(pairs).alias("x")).select("_first", "x.column", "x.value").filter("value is not null")
    counts = tall.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"), F.min("_first").alias("_first"))
    place = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("n"), "_first", "value"))
    return counts.withColumn("place", place).filter(F.col("place") <= k).drop("_first")


def shares(df: DataFrame, name: str, k: int = 10) -> DataFrame:
    """value, n, percent of all rows with one decimal, halves to even."""
    total = df.agg(F.count(F.lit(1)).alias("total"))
    return top_values(df, name, k).crossJoin(F.broadcast(total)).select("value", "n", F.bround(100 * F.col("n") / F.col("total"), 1).alias("percent"))


def duplicates(df: DataFrame, name: str) -> DataFrame:
    """<name>_md5, n of each text that stands more than once; digests are shuffled, not texts."""
    key = f"{name}_md5"
    return df.groupBy(F.md5(text(name)).alias(key)).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def distinct_in_order(df: DataFrame, name: str) -> DataFrame:
    """Each value once, null too, in order of first sight."""
    return df.groupBy(col(name).alias("value")).agg(F.min(RID).alias("_first")).orderBy("_first").select("value")


def outliers(df: DataFrame, name: str, width: float = 2.0) -> DataFrame:
    """Rows strictly beyond mean +- width * sample standard deviation. The two numbers are one row, which is broadcast."""
    v = col(name).cast("double")
    bounds = df.agg((F.avg(v) - width * F.stddev_samp(v)).alias("_low"), (F.avg(v) + width * F.stddev_samp(v)).alias("_high"))
    return df.crossJoin(F.broadcast(bounds)).filter((v < F.col("_low")) | (v > F.col("_high"))).drop("_low", "_high")


def analyze(ds: Dataset, filter_column: str | None = None, filter_value: object = None, targets: list[str] | None = None) -> dict[str, DataFrame | list[str]]:
    """Lazy parts of an analysis: rows, count, statistics (one row a numeric target), outliers of each target, distributions of up to five others."""
    from quaestor.functions.columns import equals_ci

    rows = ds.rows
    found = ds.find(filter_column) if filter_column else None
    if found and filter_value is not None:
        rows = rows.filter(col(found) == filter_value) if ds.kinds[found] == "numeric" and not isinstance(filter_value, str) else rows.filter(equals_ci(found, filter_value))
    targets = [c for c in (ds.find(t) for t in targets or ds.numeric) if c and ds.kinds[c] == "numeric"]
    others = [c for c in ds.columns if c not in targets and ds.kinds[c] != "nested"][:5]
    measured = Dataset(rows.select(RID, *[col(c) for c in targets]))
    stats = profile(measured, distinct=False).select("column", "low", "high", "mean", "median", "std")
    return {
        "rows": rows,
        "count": rows.agg(F.count(F.lit(1)).alias("n")),
        "statistics": stats,
        "outliers": {c: outliers(rows, c) for c in targets},
        "distributions": top_values_of(rows, others, 10) if others else None,
        "targets": targets,
    }


def date_columns(ds: Dataset) -> list[str]:
    """Columns of a date type, and text columns whose values that are there all look like dates. One pass, one row."""
    typed = [f.name for f in ds.rows.schema if f.dataType.typeName() in ("date", "timestamp", "timestamp_ntz")]
    texts = [c for c in ds.textual if c not in typed]
    if not texts:
        return typed
    row = ds.rows.agg(*[F.coalesce(F.bool_and(date_like(text(c))), F.lit(False)).alias(c) for c in texts]).head()
    return typed + [c for c, yes in zip(texts, row) if yes]
