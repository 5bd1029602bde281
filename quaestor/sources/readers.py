"""Tables from CSV, Parquet, JSON and ORC, with column kinds and a fingerprint."""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quaestor.errors import DataLoadError
from quaestor.functions.columns import is_numeric, is_text_like
from quaestor.sources.shared import listed, shared_dir
from quaestor.sources.split_csv import read_csv, splits

RID = "_rid"


@dataclass
class Dataset:
    """One table and what is known of it. ``rows`` also has the row id."""

    rows: DataFrame
    source: str = ""
    fingerprint: str = ""
    kinds: dict[str, str] = field(default_factory=dict)

    def __post_init__(self):
        if RID not in self.rows.columns:
            self.rows = self.rows.withColumn(RID, F.monotonically_increasing_id())
        fields = [f for f in self.rows.schema if f.name != RID]
        self.kinds = {f.name: "numeric" if is_numeric(f.dataType) else "text" if is_text_like(f.dataType) else "nested" for f in fields}

    @property
    def columns(self) -> list[str]:
        return list(self.kinds)

    @property
    def numeric(self) -> list[str]:
        return [c for c, k in self.kinds.items() if k == "numeric"]

    @property
    def textual(self) -> list[str]:
        return [c for c, k in self.kinds.items() if k == "text"]

    @property
    def table(self) -> DataFrame:
        return self.rows.select(*[F.col(f"`{c}`") for c in self.columns])

    def find(self, name: str) -> str | None:
        """A column by its name in any case."""
        return next((c for c in self.columns if c.lower() == name.strip().lower()), None)


def load(spark: SparkSession, path: str, kind: str | None = None) -> Dataset:
    """Reads a table; its kind is that of the file's name unless given. CSV takes a header and infers types; its large files are read by many tasks, also where fields hold line feeds."""
    kind = kind or ("csv" if path.rstrip("/").lower().endswith((".csv", ".csv.gz", ".txt")) else "json" if ".json" in path.lower() else "orc" if path.lower().endswith(".orc") else "parquet")
    try:
        if kind == "csv":
            # A file of one block is one task in any case.
            df = read_csv(spark, path, RID) if splits(spark, path) else spark.read.csv(path, header=True, inferSchema=True, multiLine=True, escape='"')
        else:
            df = spark.read.format(kind).load(path)
    except Exception as error:
        raise DataLoadError(f"{path} can't be read: {str(error).splitlines()[0]}", path=path) from error
    return Dataset(df, path, fingerprint(spark, path, df))


def fingerprint(spark: SparkSession, path: str, df: DataFrame) -> str:
    """Of the path, its files' sizes and times, and the schema; works for any store Spark reads."""
    parts = [path, df.schema.simpleString()]
    try:
        parts += [":".join(map(str, f)) for f in listed(spark, path)]
    except Exception as error:  # a store without listings
        parts.append(type(error).__name__)
    return hashlib.md5("|".join(parts).encode()).hexdigest()


def numbered(df: DataFrame, name: str = RID) -> DataFrame:
    """df with contiguous row numbers from 0 in row order.

    Row ids hold (partition, place); adding up the partitions' counts makes them contiguous, so
    no row moves. The counts are one row for each partition, two numbers each, and are broadcast: Spark, which takes them to be as many as the rows, would else shuffle all rows by partition. Rows that come out of a shuffle may come in another order when they are read again, so
    they are written with their ids first, to the folder that the cluster shares.
    """
    placed = df.withColumn("_mid", F.monotonically_increasing_id())
    if "Exchange" in placed._jdf.queryExecution().executedPlan().toString():
        path = f"{shared_dir(df.sparkSession)}/numbered/{uuid.uuid4().hex}"
        placed.write.parquet(path)
        placed = df.sparkSession.read.parquet(path)
    part, place = F.shiftright("_mid", 33), F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))
    counts = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return placed.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + place).drop("_mid", "_part", "_before")


def save(df: DataFrame, path: str, kind: str = "parquet", mode: str = "errorifexists") -> None:
    """Writes a result as parquet, csv (with header), json or orc."""
    writer = df.write.mode(mode)
    writer.csv(path, header=True) if kind == "csv" else writer.format(kind).save(path)


def sample(ds: Dataset, n: int = 5) -> DataFrame:
    return ds.table.limit(n)


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of a table's size; nothing is read."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


#: Of a file, by the optimizer's estimate, that one task aggregates: well compressed rows are many, and each distinct value is held once.
SPREAD_BYTES, SPREAD_PARTS = 4 << 20, 20_000


def spread(df: DataFrame) -> DataFrame:
    """df (with row ids) dealt to tasks by the rows' ids, so that what a task holds of distinct values before they are shuffled doesn't grow with its file."""
    parts = min(SPREAD_PARTS, -(-estimated_bytes(df) // SPREAD_BYTES))
    return df.repartition(parts, F.xxhash64(RID)) if parts > 1 else df
