"""What a table's files hold, kept beside them: ranges of numbers, hashed values and hashed trigrams, so that a search reads only files that can have a match.

File formats keep ranges of values as they are written; questions compare lowered texts, parts of texts, and texts that are numbers. Each file and
column has bitmaps of a fixed number of bits, one for lowered values and one for the trigrams in them, set in the tasks that read the rows and merged by Spark's bitmap aggregates. They may say yes where
there is nothing, never no where there is something; the rows of the files they leave are filtered by the same predicates as ever.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quaestor.functions.columns import col, number, text
from quaestor.sources.readers import Dataset, fingerprint
from quaestor.sources.shared import shared_dir

#: Bits for a file's values and for its trigrams, in each column: 128 kB and 32 kB at most.
BITS = {"value": 1 << 20, "gram": 1 << 18}
_BUCKET_BITS = 1 << 15  # of one bitmap of Spark's
#: Of bits, a byte each, that a task holds before it sends them on; the maps of a file are merged by their bits.
HELD_BYTES = 64 << 20
_MAPS = "file string, column string, kind string, bucket long, bits binary"
_PATTERN = re.compile(r"[\\^$.|?*+()\[\]{}]")


def _grams(value: Column) -> Column:
    """The trigrams of a text: three rows of neighbours, each begun one character later."""
    return F.array_distinct(F.concat(*[F.regexp_extract_all(F.substr(value, F.lit(i)), F.lit("(?s)(.{3})"), F.lit(1)) for i in (1, 2, 3)]))


def _bit(kind: str, value: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(kind), value), F.lit(BITS[kind])) + 1


def _bitmaps(names: list[str]):
    """Rows of _MAPS from (file, and for each name a value's bit and its trigrams' bits): a task sets bits in arrays of fixed size, so it holds and sends no more for many rows than for few."""

    def run(batches):
        held: dict[tuple[str, str, str], np.ndarray] = {}

        def maps():
            for (file, column, kind), on in held.items():
                buckets = [(k + 1, np.packbits(x, bitorder="little").tobytes()) for k, x in enumerate(on.reshape(-1, _BUCKET_BITS)) if x.any()]
                n = len(buckets)
                fields = [[file] * n, [column] * n, [kind] * n, [k for k, _ in buckets], [x for _, x in buckets]]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(fields, (pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary()))], names=["file", "column", "kind", "bucket", "bits"])
            held.clear()

        for b in batches:
            files = b.column(0).dictionary_encode()
            for f, file in enumerate(files.dictionary.to_pylist()):
                rows = b if len(files.dictionary) == 1 else b.filter(pa.array(files.indices.to_numpy() == f))
                for i, column in enumerate(names):
                    for kind, bits in (("value", rows.column(2 * i + 1).drop_null()), ("gram", rows.column(2 * i + 2).flatten())):
                        if len(bits):
                            on = held.setdefault((file, column, kind), np.zeros(BITS[kind], bool))
                            on[bits.to_numpy(zero_copy_only=False) - 1] = True
                if sum(x.nbytes for x in held.values()) > HELD_BYTES:
                    yield from maps()
        yield from maps()

    return run


def _number(value: object) -> float | None:
    try:
        return None if isinstance(value, bool) else float(str(value))
    except ValueError:
        return None


@dataclass
class FileIndex:
    spark: SparkSession
    source: str
    kind: str
    path: str
    fingerprint: str

    @classmethod
    def build(cls, spark: SparkSession, source: str, columns: list[str] | None = None, kind: str = "parquet", path: str | None = None) -> FileIndex:
        """Indexes the named columns (all that aren't nested, unless given) of a table's files, in one pass for ranges and one for bitmaps.

        path: where the index is kept; a folder of its own in the shared one unless given. Columns that aren't indexed, and files that came later, are always read: ``open`` refuses
        an index of another state of the table.
        """
        table = spark.read.format(kind).load(source)
        kinds = Dataset(table).kinds
        names = [c for c in kinds if kinds[c] != "nested" and (columns is None or c in columns)]
        rows = table.select(F.col("_metadata.file_path").alias("_file"), *[col(c) for c in names])
        ranges = [F.struct(F.lit(c).alias("column"), F.min(number(c, kinds[c] == "numeric")).alias("low"), F.max(number(c, kinds[c] == "numeric")).alias("high")) for c in names]
        path = path or f"{shared_dir(spark)}/files/{uuid.uuid4().hex}"
        rows.groupBy(F.col("_file").alias("file")).agg(F.array(*ranges).alias("r")).select("file", F.inline("r")).write.mode("overwrite").parquet(path + "/ranges")
        lowered = {c: F.lower(text(c)) for c in names}
        bits = {c: (_bit("value", v).cast("int"), F.transform(_grams(v), lambda g: _bit("gram", g).cast("int"))) for c, v in lowered.items()}
        bits = [F.when(lowered[c].isNotNull(), x).alias(f"{kind}{i}") for i, c in enumerate(names) for kind, x in zip(BITS, bits[c])]
        held = rows.select(F.col("_file").alias("file"), *bits).mapInArrow(_bitmaps(names), _MAPS)
        maps = held.groupBy("file", "column", "kind", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
        maps.write.mode("overwrite").parquet(path + "/bits")
        state = fingerprint(spark, source, table)
        spark.createDataFrame([(source, kind, state)], "source string, kind string, fingerprint string").coalesce(1).write.mode("overwrite").parquet(path + "/about")
        return cls(spark, source, kind, path, state)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> FileIndex | None:
        """The index at a path; None if its table has changed since."""
        about = spark.read.parquet(path + "/about").head()
        if fingerprint(spark, about.source, spark.read.format(about.kind).load(about.source)) != about.fingerprint:
            return None
        return cls(spark, about.source, about.kind, path, about.fingerprint)

    def _with_bits(self, kind: str, column: str | None, values: Column) -> DataFrame:
        """file: those that have the bits of all values (an array) in the column, or all in one column of any."""
        wanted = self.spark.range(1).select(F.explode(F.array_distinct(values)).alias("v")).select(_bit(kind, F.col("v")).alias("bit")).distinct()
        wanted = [r.bit for r in wanted.collect()]  # of one search term
        maps = self.spark.read.parquet(self.path + "/bits").filter(F.col("kind") == kind)
        maps = maps.filter(F.col("column") == column) if column is not None else maps
        of = F.explode(F.array(*[F.struct(F.lit((b - 1) // _BUCKET_BITS + 1).alias("b"), F.lit((b - 1) % _BUCKET_BITS).alias("p")) for b in wanted]))
        place = maps.filter(F.col("bucket").isin(*{(b - 1) // _BUCKET_BITS + 1 for b in wanted})).select("file", "column", "bucket", "bits", of.alias("w")).filter("bucket = w.b")
        octet = F.conv(F.hex(F.expr("substring(bits, cast(w.p div 8 as int) + 1, 1)")), 16, 10).cast("int")
        on = place.filter(F.floor(octet / F.pow(F.lit(2), F.col("w.p") % 8)) % 2 == 1)
        return on.groupBy("file", "column").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == len(wanted)).select("file").distinct()

    def _of_filter(self, ds: Dataset, name: str, op: str, value: object) -> DataFrame | None:
        """Files that can have rows for one of a plan's filters; None for all."""
        from quaestor.operators.filters import COMPARE, all_numbers

        found, op, v = ds.find(str(name)), str(op).strip().lower(), _number(value)
        indexed = found is not None and not self.spark.read.parquet(self.path + "/ranges").filter(F.col("column") == found).isEmpty()
        if not indexed or value is None:
            return None
        low = str(value).lower()
        if op in ("contains", "like"):
            return self._with_bits("gram", found, _grams(F.lit(low))) if self.literal(low) else None
        if op not in COMPARE or op == "!=":
            return None
        if v is not None and all_numbers(ds, found):
            ranges = self.spark.read.parquet(self.path + "/ranges").filter((F.col("column") == found) & F.col("low").isNotNull())
            fits = {">": F.col("high") > v, ">=": F.col("high") >= v, "<": F.col("low") < v, "<=": F.col("low") <= v}.get(op, (F.col("low") <= v) & (F.col("high") >= v))
            return ranges.filter(fits).select("file")
        return self._with_bits("value", found, F.array(F.lit(low))) if op in ("=", "==") else None

    @staticmethod
    def literal(term: str) -> bool:
        """A term whose trigrams tell: no pattern, and long enough."""
        return len(term) >= 3 and not _PATTERN.search(term)

    def _read(self, ds: Dataset, files: list[DataFrame]) -> DataFrame:
        if not files:
            return ds.rows
        chosen = sorted(r.file for r in reduce(lambda a, b: a.join(b, "file", "left_semi"), files).collect())  # names of files, which the driver lists to read them anyway
        if not chosen:
            return ds.rows.filter("false")
        return Dataset(self.spark.read.format(self.kind).option("basePath", self.source).load(chosen), ds.source).rows

    def filtered(self, ds: Dataset, filters: list[tuple[str, str, object]]) -> DataFrame:
        """The rows that operators.filters.apply_filters gives for the whole table, from the files that can have any."""
        from quaestor.operators.filters import predicate

        conditions = [p for p in (predicate(ds, *f) for f in filters) if p is not None]
        rows = self._read(ds, [f for f in (self._of_filter(ds, *f) for f in filters) if f is not None])
        return rows.filter(reduce(lambda a, b: a & b, conditions)) if conditions else rows

    def searched(self, ds: Dataset, term: str) -> DataFrame:
        """The rows that operators.search.search gives for the whole table and all its columns, from the files that can have any."""
        from quaestor.operators.search import keyword_rank

        plain = [c for c, k in ds.kinds.items() if k != "nested"]
        indexed = {r.column for r in self.spark.read.parquet(self.path + "/ranges").select("column").distinct().collect()}
        usable = self.literal(term.lower()) and set(plain) <= indexed
        rows = self._read(ds, [self._with_bits("gram", None, _grams(F.lit(term.lower())))] if usable else [])
        return rows.withColumn("_rank", keyword_rank(plain, term)).filter("_rank is not null")
