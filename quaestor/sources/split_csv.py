"""CSV files whose quoted fields may hold line feeds, read by many tasks.

A reader that takes such files as a whole reads each in one task. Here Spark cuts them into blocks of lines. A line ends its record if the number of quotes
before its end is even: each block counts its quotes, the counts of the blocks before it tell whether it begins within quotes, and
so each block finds its own records. Only records that cross a block's edge are put together, from a piece of each block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quaestor.sources.shared import listed

OPTIONS = {"sep": ",", "quote": '"', "escape": '"'}
#: Blocks of more than this many would make a table too large to send to each task.
BROADCAST_BLOCKS = 1_000_000
PLACE_BITS = 33  # of a row id: the place in its block; above it is the block's number
#: Spark cuts files anew for each job, by settings and cores as they then are.
CHANGED = "CSV files were cut into other blocks than those that were counted: settings, cores or files changed in between; read them again"
#: kind 0: a whole record. 1: the end of one from earlier blocks. 2: a block within one. 3: the beginning of one.
PIECES = "number long, kind int, place long, first boolean, value string"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """file, block, value: the lines of each block in their order; a carriage return at the end of a line stays."""
    lines = spark.read.text(path, lineSep="\n")
    return lines.select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_path").alias("name"), "value")


def _blocks(lines: DataFrame) -> DataFrame:
    """file, block, number, lines, odd: blocks numbered in the order of files and places, how many lines each has, and whether it begins within quotes."""
    quotes = F.char_length("value") - F.char_length(F.replace("value", F.lit('"'), F.lit("")))
    sums = lines.groupBy("file", "block", "name").agg(F.sum(quotes).alias("n"), F.count(F.lit(1)).alias("lines"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("block")) - F.col("n")
    number = F.row_number().over(Window.orderBy("name", "block")) - 1  # one row for each block of the input
    return sums.select("file", "block", number.cast("long").alias("number"), "lines", (before % 2 == 1).alias("odd"), (F.col("n") % 2 == 1).alias("flips"))


def _cut(lines: list[str], ends: np.ndarray) -> tuple[list[str], list[str]]:
    """Records that end among the lines, and the lines after the last of them."""
    at = np.flatnonzero(ends) + 1
    return ["\n".join(lines[a:b]) for a, b in zip([0, *at[:-1]], at)], lines[at[-1] if len(at) else 0 :]


def _pieces(whole: bool):
    """From lines of blocks in order: whole records only, or only the pieces of those that cross an edge."""

    def run(batches):
        state: dict = {"number": None}
        out: list[tuple] = []

        def add(kind: int, place: int, value: str) -> None:
            if whole == (kind == 0) and (kind or value.strip()):
                out.append((state["number"], kind, place, state["block"] == 0 and place == 0, value))

        def close() -> None:
            if state["number"] is None:
                return
            if state["seen"] != state["lines"]:
                raise ValueError(CHANGED)
            if not state["open"]:
                return
            value = "\n".join(state["open"])
            if state["odd"]:  # quotes are open
                add(2 if state["head"] else 3, state["place"], value)
            else:
                add(0, state["place"], value)

        def flush():
            rows, out[:] = list(out), []
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["number", "kind", "place", "first", "value"])

        for b in batches:
            numbers = b.column("number").to_numpy()
            values = b.column("value")
            odd = (pc.count_substring(values, '"').to_numpy(zero_copy_only=False) & 1).astype(bool)
            edges = np.flatnonzero(np.diff(numbers)) + 1
            for lo, hi in zip([0, *edges], [*edges, len(numbers)]):
                if lo == hi:
                    continue
                if state["number"] != numbers[lo]:
                    close()
                    block, number, begins_odd, n = (b.column(c)[int(lo)].as_py() for c in ("block", "number", "odd", "lines"))
                    if number < 0:
                        raise ValueError(CHANGED)
                    state = {"number": number, "block": block, "odd": begins_odd, "head": begins_odd, "open": [], "place": 0, "lines": n, "seen": 0}
                state["seen"] += hi - lo
                inside = np.logical_xor.accumulate(np.concatenate([[state["odd"]], odd[lo:hi]]))[1:]
                records, rest = _cut([*state["open"], *values.slice(lo, hi - lo).to_pylist()], np.concatenate([np.zeros(len(state["open"]), bool), ~inside]))
                if records and state["head"]:
                    add(1, 0, records.pop(0))
                    state["head"] = False
                for r in records:
                    add(0, state["place"], r)
                    state["place"] += bool(r.strip())
                state["open"], state["odd"] = rest, bool(inside[-1])
            if out:
                yield flush()
        close()
        if out:
            yield flush()

    return run


def records(spark: SparkSession, path: str) -> DataFrame:
    """_rid, first, value: the records of CSV files as texts; ids are in the order of files and places. first: a file's first record. Blank lines are no records."""
    lines = _lines(spark, path)
    # Read twice below, and small: one row for each block. If an executor that holds it is lost, it is counted again.
    blocks = _blocks(lines).persist()
    n, crossing = blocks.agg(F.count(F.lit(1)), F.coalesce(F.bool_or(F.col("flips") | F.col("odd")), F.lit(False))).head()
    if n > BROADCAST_BLOCKS:  # a shuffle join would lose the order of lines
        raise ValueError(f"{n} blocks in one table: raise spark.sql.files.maxPartitionBytes")
    # A left join: a line whose block wasn't counted must fail, not be left out.
    placed = lines.join(F.broadcast(blocks.select("file", "block", "number", "odd", "lines")), ["file", "block"], "left").select("block", F.coalesce("number", F.lit(-1)).alias("number"), "odd", "lines", "value")
    rid = F.shiftleft("number", PLACE_BITS).bitwiseOR(F.col("place"))
    own = placed.mapInArrow(_pieces(True), PIECES).select(rid.alias("_rid"), "first", "value")
    if not crossing:
        return own
    pieces = placed.mapInArrow(_pieces(False), PIECES)
    record = F.sum((F.col("kind") == 3).cast("long")).over(Window.orderBy("number", "kind"))  # at most two pieces of each block
    joined = pieces.withColumn("record", record).groupBy("record").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number", "kind", "value"))), lambda p: p["value"]), "\n").alias("value"),
        F.min(F.struct("number", "kind", rid.alias("_rid"), "first")).alias("at"),
    )
    return own.unionByName(joined.select(F.col("at._rid").alias("_rid"), F.col("at.first").alias("first"), "value"))


def splits(spark: SparkSession, path: str) -> bool:
    """Whether some file at the path has more than one block, and can be cut."""
    size = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    return any(n > size and not name.lower().endswith((".gz", ".bz2", ".zst", ".xz", ".snappy", ".lz4")) for name, n, _ in listed(spark, path))


def _balanced(spark: SparkSession, path: str) -> bool:
    """Whether each file has an even number of quotes, as it must if quotes only stand around fields and doubled in them."""
    odd = _blocks(_lines(spark, path)).groupBy("file").agg((F.sum(F.col("flips").cast("int")) % 2 == 1).alias("odd"))
    return odd.filter("odd").isEmpty()


def read_csv(spark: SparkSession, path: str, rid: str = "_rid", schema: StructType | None = None, **options: str) -> DataFrame:
    """CSV files with a header as a table with typed columns, and ``rid``, a row's number in the order of files and places.

    The same rows and types as Spark's own reader gives with multiLine, header and inferSchema, but each file is read by as many tasks as it has blocks. Quotes
    stand around fields and are doubled in them; a table with a file in which their number is odd is left to Spark's reader. Lines end with a line feed, or a
    carriage return and a line feed. Nothing is inferred if the schema is given. options are further ones of Spark's reader: it takes an empty field in quotes for null unless nullValue is another text.
    """
    options = OPTIONS | options
    if not _balanced(spark, path):
        return spark.read.options(**options).csv(path, schema=schema, header=True, inferSchema=schema is None, multiLine=True).withColumn(rid, F.monotonically_increasing_id())
    rows = records(spark, path).filter("not first")
    if schema is not None:
        kinds, names = [f.dataType.simpleString() for f in schema], schema.names
    else:
        names = spark.read.options(**options).csv(path, header=True, multiLine=True).columns
        found = _inferred(spark, rows, options)
        kinds = [found[i].dataType.simpleString() if i < len(found) else "string" for i in range(len(names))]
    typed = ", ".join(f"`c{i}` {k}" for i, k in enumerate(kinds))
    parsed = rows.select(F.col("_rid").alias(rid), F.from_csv(F.regexp_replace("value", "\r$", ""), typed, options).alias("r"))
    return parsed.select(*[F.col(f"r.c{i}").alias(n) for i, n in enumerate(names)], rid)


def _inferred(spark: SparkSession, rows: DataFrame, options: dict[str, str]) -> StructType:
    """Spark's inference, over texts."""
    texts = rows.select(F.regexp_replace("value", "\r$", "").alias("value"))
    encoder = spark._jvm.org.apache.spark.sql.Encoders.STRING()
    reader = spark.read.options(**options, inferSchema="true")
    return reader._df(reader._jreader.csv(getattr(texts._jdf, "as")(encoder))).schema
