"""A profile that is kept: one row of mergeable sketches for each file and column, so that a table that has grown is profiled by reading its new files only."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaestor.functions.columns import col, text
from quaestor.sources.readers import Dataset
from quaestor.sources.shared import listed

#: Of the distinct counts' sketch: 2 ** 14 registers, a standard error of 0.8 %.
REGISTERS = 14
#: Of the quantiles' sketch: a rank is off by no more than about 0.8 % (with 99 % confidence).
QUANTILE_SIZE = 400
_STATE = "file string, column string, position int, kind string, n_rows long, n_present long, low double, high double, first string, last string, total double, squares double, distinct binary, ranks binary"


@dataclass
class KeptProfile:
    """The profile of the files at ``source``, kept at ``path``."""

    spark: SparkSession
    source: str
    path: str
    kind: str = "parquet"
    scanned: list[str] = field(default_factory=list)  # files that the last update read

    def _state(self) -> DataFrame:
        if _there(self.spark, self.path):
            return self.spark.read.schema(_STATE).parquet(self.path)
        return self.spark.createDataFrame([], _STATE)

    def update(self) -> DataFrame:
        """The profile of the table as it is: position, column, kind, n_rows, n_present, n_missing, n_distinct, low, high, mean, std, median, first, last.

        low to median are of numbers; first and last of texts. n_distinct and median have the errors stated above, all else is exact (sums but for rounding).
        Files are known by name, size and time: a changed file is a new one, and what is kept of files that are gone is left out.
        """
        now = {f"{name.rsplit('/', 1)[-1]}:{size}:{time}": name for name, size, time in listed(self.spark, self.source)}
        kept = {r.file for r in self._state().select("file").distinct().collect()}  # names of files, which the driver lists anyway
        self.scanned = [name for key, name in now.items() if key not in kept]
        if self.scanned:
            self._sketched(self.spark.read.format(self.kind).option("basePath", self.source).load(self.scanned)).write.mode("append").parquet(self.path)
        current = self.spark.createDataFrame([(k,) for k in now], "file string")
        return _merged(self._state().join(F.broadcast(current), "file", "left_semi"))

    def _sketched(self, table: DataFrame) -> DataFrame:
        ds = Dataset(table)
        names = [c for c in ds.columns if ds.kinds[c] != "nested"]
        meta = [F.col(f"_metadata.file_{k}") for k in ("name", "size")] + [F.unix_millis("_metadata.file_modification_time")]
        rows = table.select(F.concat_ws(":", *[m.cast("string") for m in meta]).alias("_file"), *[col(c) for c in names])
        each = []
        for i, c in enumerate(names):
            number = ds.kinds[c] == "numeric"
            v = col(c).cast("double") if number else F.lit(None).cast("double")
            t = F.lit(None).cast("string") if number else text(c)
            values = [
                F.lit(c).alias("column"), F.lit(i).alias("position"), F.lit(ds.kinds[c]).alias("kind"), F.count(F.lit(1)).alias("n_rows"), F.count(col(c)).alias("n_present"),
                F.min(v).alias("low"), F.max(v).alias("high"), F.min(t).alias("first"), F.max(t).alias("last"), F.sum(v).alias("total"), F.sum(v * v).alias("squares"),
                F.hll_sketch_agg(text(c), REGISTERS).alias("distinct"), (F.kll_sketch_agg_double(v, QUANTILE_SIZE) if number else F.lit(None).cast("binary")).alias("ranks"),
            ]
            each.append(F.struct(*values))
        return rows.groupBy(F.col("_file").alias("file")).agg(F.array(*each).alias("x")).select("file", F.inline("x"))


def _there(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def _merged(state: DataFrame) -> DataFrame:
    sums = state.groupBy("position", "column").agg(
        F.first("kind").alias("kind"), *[F.sum(c).alias(c) for c in ("n_rows", "n_present", "total", "squares")], F.min("low").alias("low"), F.max("high").alias("high"),
        F.min("first").alias("first"), F.max("last").alias("last"), F.hll_sketch_estimate(F.hll_union_agg("distinct")).alias("n_distinct"), F.kll_merge_agg_double("ranks").alias("ranks"),
    )
    n, mean = F.col("n_present"), F.col("total") / F.col("n_present")
    counted = (F.col("kind") == "numeric") & (n > 0)
    spread = F.when(counted & (n > 1), F.sqrt(F.greatest(F.lit(0.0), F.col("squares") - n * mean * mean) / (n - 1)))
    return sums.select(
        "position", "column", "kind", "n_rows", "n_present", (F.col("n_rows") - n).alias("n_missing"), "n_distinct", "low", "high", F.when(counted, mean).alias("mean"), spread.alias("std"),
        F.when(counted, F.kll_sketch_get_quantile_double("ranks", F.lit(0.5))).alias("median"), "first", "last",
    ).orderBy("position")
