"""Each stage of the pipeline against a plain version, on its own input."""

import zlib

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from quaestor.llm import quality
from quaestor.llm.encoder import default_path
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumns({"kept": F.lit("extra"), "size": F.col("doc_id") * 2, "_k": F.lit("mine")})
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    names = docs.columns
    by_name = dict(corpus_pipeline.STAGES)
    assert list(by_name) == ["quality_rules", "near_duplicates", "decontamination", "source_mixing", "token_output"]

    good = by_name["quality_rules"](spark, docs, SF)
    assert good.columns == names
    passed = {r.doc_id for r in quality.quality(docs).filter("kept").collect()}
    rows = [(r.doc_id, r.text) for r in good.collect()]
    assert {i for i, _ in rows} == passed and all(not brute.quality_counts(t)[-1] for _, t in rows)

    single = by_name["near_duplicates"](spark, good.union(good.limit(3)), SF)
    kept = [(r.doc_id, r.text) for r in single.collect()]
    assert sorted(i for i, _ in kept) == sorted({c for _, _, c in brute.components(rows)})

    clean = by_name["decontamination"](spark, single, SF)
    left = [(r.doc_id, r.source, r.text) for r in clean.collect()]
    assert sorted(i for i, _, _ in left) == sorted(r[0] for r in brute.contamination(kept, items) if not r[-1])

    mixed = by_name["source_mixing"](spark, clean, SF)
    assert mixed.columns == names
    assert mixed.filter("kept != 'extra' or size != doc_id * 2 or _k != 'mine'").count() == 0
    wanted = sorted(r[0] for r in brute.mixing(left) for _ in range(r[4] // max(1, r[1])))
    assert sorted(r.doc_id for r in mixed.select("doc_id").collect()) == wanted

    out = by_name["token_output"](spark, mixed, SF).orderBy("start").collect()
    assert [r.doc_id for r in out] == wanted
    from tokenizers import Tokenizer

    plain, text, start = Tokenizer.from_file(default_path()), {r.doc_id: r.text for r in mixed.collect()}, 0
    for r in out:
        ids = [*plain.encode(text[r.doc_id] or "", add_special_tokens=False).ids, 0]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += r.n_tokens


def test_near_duplicates_by_row(spark):
    a, b = (" ".join(f"{x}{k}" for k in range(60)) for x in "ab")
    rows = [(5, a), (5, b), (3, a + " more"), (5, b), (7, None), (7, None), (8, ""), (None, b), (None, "alone of all words"), (9, "alone of all words here and there")]
    docs = spark.createDataFrame([(i, t, None, None, None, f"{i}{t}") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, row_id string")
    out = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs.repartition(3), SF)
    assert out.columns == docs.columns
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    wanted = [(3, a + " more"), (5, b), (7, None), (7, None), (8, ""), (None, "alone of all words"), (9, "alone of all words here and there")]
    found = [tuple(r) for r in out.select("doc_id", "text", "row_id").collect()]
    assert sorted([r[:2] for r in found], key=key) == sorted(wanted, key=key)
    assert all(r[2] == f"{r[0]}{r[1]}" for r in found)


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
