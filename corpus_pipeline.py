"""The corpus pipeline: documents through five stages of quaestor.llm.

Rows that a stage keeps keep all their columns, also those whose names an operator gives to its own. Stages take any table with the
columns of documents, also an empty one; names are found as Spark finds them (in any case, by default), and a missing one is an error.
"""

from pyspark.sql import functions as F

from quaestor.llm.decontaminate import contamination
from quaestor.llm.jaccard import link
from quaestor.llm.mixing import mix
from quaestor.llm.native import apart, find_column, together
from quaestor.llm.quality import quality
from quaestor.llm.storage import discard, written
from quaestor.llm.tokenfiles import token_files


def _rows(docs):
    return apart(docs, doc_id="doc_id", text="text", source="source")


def quality_rules(spark, docs, sf_dir):
    """Keeps what passes the quality rules."""
    rows, names = _rows(docs)
    return together(quality(rows).filter("kept"), names)


def near_duplicates(spark, docs, sf_dir):
    """Keeps one row of each group of near copies: that with the least doc_id, any one of several; a row without a doc_id only if no other has one.

    Rows are told apart by a number of their own, so that rows of one doc_id with unlike texts all stay.
    """
    rows, names = _rows(docs)
    numbered = written(rows.select(*names.values(), F.monotonically_increasing_id().alias("row_id")))
    doc_id, text = (F.col(names[find_column(docs, c)]) for c in ("doc_id", "text"))
    linked = link(numbered.select(F.col("row_id").alias("doc_id"), text.alias("text")))
    named = numbered.select("row_id", doc_id.alias("doc_id")).join(linked.select(F.col("doc_id").alias("row_id"), "component_id"), "row_id")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row_id")
    kept = named.groupBy("component_id").agg(F.min(order).alias("first")).select(F.col("first.row_id").alias("row_id"))
    return together(numbered.join(written(kept, release=True), "row_id"), names)


def decontamination(spark, docs, sf_dir):
    """Keeps what shares no window with a benchmark item."""
    rows, names = _rows(docs)
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return together(contamination(rows, benchmark).filter(~F.col("contaminated")), names)


def source_mixing(spark, docs, sf_dir):
    """Repeats each document as often as the mix holds it; none of those that it doesn't."""
    rows, names = _rows(docs)
    mixed = mix(rows).filter("copies > 0")
    return together(mixed.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))), names)


def token_output(spark, docs, sf_dir):
    """Writes token files; returns doc_id, start, n_tokens and ids_crc32 of each document as read back from them."""
    return token_files(docs.select("doc_id", "text"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("source_mixing", source_mixing),
    ("token_output", token_output),
]

#: The last stage encodes by a tokenizer, which SQL can't; tests hold all stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir: str):
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs)
            if before is not None:
                discard(before)
            before = docs
    return docs
