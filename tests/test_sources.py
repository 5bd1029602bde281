"""CSV by blocks, indexes beside a table's files."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quaestor.sources import split_csv
from quaestor.sources.readers import RID, load


def _field(rng):
    return rng.choice(["plain", "with, comma", 'say ""hi""', "two\nlines", "three\n\nlines", "", "é中", '""', "x" * 300, "\n", " padded ", "cr\r\nlf"])


@pytest.fixture()
def small_blocks(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def _written(path, rng, rows, end="\n"):
    with open(path, "w", newline="", encoding="utf-8") as h:
        h.write(f'id,"the name",price,day,when,note{end}')
        for i in range(rows):
            h.write(f'{i},"{_field(rng)}",{rng.random() * 100:.2f},2024-01-{i % 28 + 1:02d},2024-01-01 10:00:{i % 60:02d},"{_field(rng)}"{end}')
            if i % 100 == 0:
                h.write(end)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_csv_by_blocks_is_what_sparks_reader_gives(spark, small_blocks, tmp_path, end):
    rng = random.Random(1)
    for k in range(2):
        _written(tmp_path / f"f{k}.csv", rng, 400, end)
    found = split_csv.read_csv(spark, str(tmp_path))
    whole = spark.read.csv(str(tmp_path), header=True, inferSchema=True, multiLine=True, escape='"')
    assert found.drop(RID).schema == whole.schema
    assert found.rdd.getNumPartitions() > 4 >= whole.rdd.getNumPartitions()
    if end == "\n":
        assert sorted(map(str, found.drop(RID).collect())) == sorted(map(str, whole.collect()))
    assert [r.id for r in found.orderBy(RID).select("id").collect()] == [*range(400), *range(400)]


def test_a_record_over_many_blocks(spark, small_blocks, tmp_path):
    long = "\n".join(f"line {i}" for i in range(5000))
    with open(tmp_path / "a.csv", "w") as h:
        h.write(f'a,b\n1,"{long}"\n2,x\n3,"{long}"\n')
    found = split_csv.read_csv(spark, str(tmp_path / "a.csv")).orderBy(RID).collect()
    assert [(r.a, r.b) for r in found] == [(1, long), (2, "x"), (3, long)]


def test_unbalanced_quotes_are_left_to_sparks_reader(spark, small_blocks, tmp_path):
    with open(tmp_path / "a.csv", "w") as h:
        h.write("a,b\n" + "".join(f'{i},5" pipe\n' for i in range(1001)))
    whole = spark.read.csv(str(tmp_path), header=True, inferSchema=True, multiLine=True, escape='"')
    assert split_csv.read_csv(spark, str(tmp_path)).drop(RID).collect() == whole.collect()


def test_load_splits_large_files_only(spark, small_blocks, tmp_path):
    _written(tmp_path / "large.csv", random.Random(2), 300)
    _written(tmp_path / "small.csv", random.Random(3), 3)
    large, small = load(spark, str(tmp_path / "large.csv")), load(spark, str(tmp_path / "small.csv"))
    assert large.rows.rdd.getNumPartitions() > 1 and large.columns == small.columns == ["id", "the name", "price", "day", "when", "note"]
    assert large.table.count() == 300 and small.table.count() == 3


def test_empty_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b\n")
    assert split_csv.read_csv(spark, str(tmp_path / "a.csv")).drop(RID).schema.names == ["a", "b"]
    assert split_csv.read_csv(spark, str(tmp_path / "a.csv")).count() == 0


def test_csv_scan_keeps_what_texts_hold(spark, small_blocks, tmp_path):
    """Empty texts aren't nulls, NULs before quotes stay, and columns keep their types whatever their texts look like."""
    from quaestor import catalogue

    rng = random.Random(7)
    rows = [(1, "", "en", "7", 0), (2, "a", "", None, None), (3, "b", None, "", 1), (None, "c", "en", "7", 1), (4, '\0"', '"\0"x', "8", 2), (5, "\0", '"', "9", 1), (6, '\\"', "a\rb", "1", 2)]
    rows += [(i, "".join(rng.choice(["a", " ", '"', '""', "\n", ",", "\\", "\0", "é", '","']) for _ in range(rng.choice([0, 1, 2, 9, 40]))), rng.choice(["1", "", None]), "2", i) for i in range(10, 2000)]
    docs = spark.createDataFrame(rows + [(7, None, "en", "7", None), (8, "x\r", "en", "7", 2)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.withColumn("more", F.lit(1)).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    found = catalogue.QUERIES["csv_scan"](spark, str(tmp_path))
    assert found.schema == docs.schema and found.rdd.getNumPartitions() > 1
    assert sorted(map(repr, found.collect())) == sorted(map(repr, docs.filter("text is not null and doc_id is distinct from 8").collect()))


@pytest.mark.parametrize("size", ["900", "2500", "20000"])
def test_lines_of_other_blocks_than_were_counted_are_refused(spark, small_blocks, tmp_path, size):
    """Spark cuts files by the settings and cores at the time of each job; lines of blocks that nothing is known of were left out before."""
    _written(tmp_path / "a.csv", random.Random(3), 300)
    found = split_csv.read_csv(spark, str(tmp_path))
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", size)
    try:
        with pytest.raises(Exception, match="cut into other blocks"):
            found.select("id").collect()
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")


def _vectors(spark, n=3000, size=16):
    import numpy as np

    rng = np.random.default_rng(4)
    centres = rng.standard_normal((30, size))
    pick = np.where(rng.random(n) < 0.4, 0, rng.integers(0, 30, n))  # one list holds more than a third
    x = centres[pick] + rng.standard_normal((n, size)) * 0.6
    rows = [(i * 2, v.tolist(), "x") for i, v in enumerate(x)] + [(None, [1.0] * size, "x"), (9_999_999, None, "x")]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, list string").repartition(5)


def test_vector_index_finds_the_nearest(spark, tmp_path):
    from quaestor.operators.retrieval import nearest_each
    from quaestor.operators.vector_index import VectorIndex

    vectors = _vectors(spark)
    path = f"file://{tmp_path}/index"
    index = VectorIndex.build(vectors, path=path, fingerprint="one", recall=0.95)
    asked = vectors.filter("vec_id % 50 = 0")
    key = lambda df: sorted((r["query"], r["id"], round(r["score"], 9), r["place"]) for r in df.collect())
    exact = key(nearest_each(vectors, asked))
    assert key(index.search(asked, probes=len(index.centres))) == exact  # every row is in it
    found = {x[:2] for x in key(index.search(asked))}
    assert len(found & {x[:2] for x in exact}) >= 0.9 * len(exact) and index.recall >= 0.95
    assert index.probes < len(index.centres) / 2
    again = VectorIndex.open(spark, path, "one")
    assert key(again.search(asked)) == key(index.search(asked)) and again.probes == index.probes
    assert VectorIndex.open(spark, path, "another") is None


def test_vector_index_of_more_queries_than_are_broadcast(spark, monkeypatch):
    from quaestor.operators import vector_index
    from quaestor.operators.retrieval import nearest_each

    vectors = _vectors(spark, 600)
    index = vector_index.VectorIndex.build(vectors, lists=8)
    monkeypatch.setattr(vector_index, "BROADCAST_QUERIES", 0)
    monkeypatch.setattr(vector_index, "BLOCK", 50)
    key = lambda df: sorted((r["query"], r["id"], round(r["score"], 9)) for r in df.collect())
    assert key(index.search(vectors, probes=8)) == key(nearest_each(vectors, vectors))


def test_vector_index_of_nothing(spark):
    from quaestor.operators.vector_index import VectorIndex

    empty = spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")
    assert VectorIndex.build(empty).search(empty).count() == 0


def test_a_task_sends_k_rows_a_query(spark, monkeypatch):
    """Whatever the number of blocks that a query meets in a task; lists that are joined by shuffle give what broadcast ones give."""
    import numpy as np

    from quaestor.operators import retrieval, vector_index

    x = np.random.default_rng(4).normal(size=(60, 4))
    q = (pa.array([[7, 8]] * 6, pa.list_(pa.int64())), pa.array([x[:2].tobytes()] * 6, pa.binary()))
    v = (pa.array([list(range(10 * i, 10 * i + 10)) for i in range(6)], pa.list_(pa.int64())), pa.array([x[10 * i : 10 * i + 10].tobytes() for i in range(6)], pa.binary()))
    pairs = pa.RecordBatch.from_arrays([*q, *v], names=["q_ids", "q_data", "v_ids", "v_data"])
    (sent,) = retrieval.best(3, None)([pairs, pairs.slice(0, 0)])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert [(r["query"], r["id"]) for r in sent.to_pylist()] == [(7 + i, int(j)) for i in range(2) for j in np.argsort(-(unit[i] @ unit.T))[:3]]
    vectors = spark.createDataFrame([(i, [float(a) for a in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    index = vector_index.VectorIndex.build(vectors, lists=6)
    found = [sorted(map(tuple, index.search(vectors, 3, probes=2).collect()))]
    monkeypatch.setattr(vector_index, "BROADCAST_QUERIES", 0)
    found.append(sorted(map(tuple, index.search(vectors, 3, probes=2).collect())))
    assert found[0] == found[1] and len(found[0]) == 180


@pytest.fixture()
def indexed(spark, tmp_path):
    from quaestor.sources.file_index import FileIndex
    from quaestor.sources.readers import Dataset

    words = ["Größe", "red apple", "GREEN pear", "blue", "x", None, "", "a+b", "naïve 🙂 end"]
    rows = [(i, f"{words[i % 9]} {i // 40}" if words[i % 9] is not None else None, f"code{i // 40}", str(i // 40) if i % 2 else None, [i]) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, text string, code string, digits string, nested array<long>")
    df.repartitionByRange(10, "id").write.parquet(str(tmp_path / "t"))
    index = FileIndex.build(spark, str(tmp_path / "t"), path=str(tmp_path / "i"))
    return index, Dataset(spark.read.parquet(str(tmp_path / "t")))


@pytest.mark.parametrize(
    ("filters", "most"),
    [
        ([("code", "=", "CODE3")], 1), ([("code", "=", "code77")], 0), ([("id", ">", 380)], 1), ([("id", "<=", 39), ("code", "=", "code0")], 1), ([("id", "=", 100)], 1),
        ([("digits", "=", 4)], 1), ([("digits", ">=", 8)], 2), ([("text", "contains", "größe 5")], 1), ([("text", "contains", "🙂 END 7")], 1), ([("text", "contains", "a+b")], 10),
        ([("text", "contains", "x")], 10), ([("text", "contains", "gr.+ 5")], 10), ([("code", "!=", "code3")], 10), ([("none", "=", 1)], 10), ([("id", ">", "text")], 10),
    ],
)
def test_files_are_skipped_and_no_row_is_lost(indexed, filters, most):
    from quaestor.operators.filters import apply_filters

    index, ds = indexed
    found, wanted = index.filtered(ds, filters), apply_filters(ds, filters)
    assert sorted(r.id for r in found.collect()) == sorted(r.id for r in wanted.collect())
    assert len(found.inputFiles()) <= most or (most == 0 and found.count() == 0)


@pytest.mark.parametrize(("term", "most"), [("code7", 1), ("größe 3", 1), ("Pear 9", 1), ("399", 1), ("zzz", 0), ("x", 10), ("red|blue", 10)])
def test_searches_skip_files(indexed, term, most):
    from quaestor.operators.search import search

    index, ds = indexed
    found = index.searched(ds, term)
    assert sorted((r.id, r._rank) for r in found.collect()) == sorted((r.id, r._rank) for r in search(ds, term).collect())
    assert len(found.inputFiles()) <= most or (most == 0 and found.count() == 0)


def test_a_task_that_indexes_holds_bits_not_rows(spark, tmp_path, monkeypatch):
    """No row for each trigram is sorted or hashed before the bits are set; maps that a task sends in several parts, and of a file read by several tasks, are merged."""
    from quaestor.sources import file_index

    rows = spark.range(4000).selectExpr("id", "concat('name ', id % 37) AS name", "if(id % 3 = 0, null, 'x y') AS other")
    rows.repartitionByRange(3, "id").write.parquet(str(tmp_path / "t"))
    sent = file_index._bitmaps(["id"])
    batch = pa.RecordBatch.from_arrays([pa.array(["f"] * 3), pa.array([1, 40_000, None], pa.int32()), pa.array([[1, 2], None, []], pa.list_(pa.int32()))], names=["file", "value0", "gram0"])
    assert [(b.column("kind").to_pylist(), b.column("bucket").to_pylist()) for b in sent([batch] * 50)] == [(["value"] * 2, [1, 2]), (["gram"], [1])]
    one = file_index.FileIndex.build(spark, str(tmp_path / "t"), path=str(tmp_path / "i"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        two = file_index.FileIndex.build(spark, str(tmp_path / "t"), path=str(tmp_path / "j"))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    a, b = ({(r.file, r.column, r.kind, r.bucket): bytes(r.bits) for r in spark.read.parquet(f"{x.path}/bits").collect()} for x in (one, two))
    assert a == b and len(a) > 9


def test_distinct_values_are_counted_in_many_tasks(spark, tmp_path, monkeypatch):
    """A file of one block holds many rows; their distinct values aren't all held by the task that reads it."""
    from quaestor.operators import profile
    from quaestor.sources import readers

    spark.range(5000).selectExpr("id", "concat('n', id % 1700) AS name").coalesce(1).write.parquet(str(tmp_path / "t"))
    ds = readers.Dataset(spark.read.parquet(str(tmp_path / "t")))
    monkeypatch.setattr(readers, "SPREAD_BYTES", 4096)
    found = profile.profile(ds)
    assert [(r.n_rows, r.n_distinct) for r in found.orderBy("position").collect()] == [(5000, 5000), (5000, 1700)]
    assert "REPARTITION" in found._jdf.queryExecution().executedPlan().toString()
    tops = profile.top_values_of(ds.rows, ["name"], 2)
    assert [(r.value, r.n) for r in tops.orderBy("place").collect()] == [("n0", 3), ("n1", 3)]
    assert "REPARTITION" in tops._jdf.queryExecution().executedPlan().toString()


def test_an_index_of_another_state_is_refused(spark, indexed):
    from quaestor.sources.file_index import FileIndex

    index, ds = indexed
    assert FileIndex.open(spark, index.path).fingerprint == index.fingerprint
    ds.table.limit(3).write.mode("append").parquet(index.source)
    assert FileIndex.open(spark, index.path) is None


def test_a_grown_table_is_profiled_by_its_new_files(spark, tmp_path):
    import statistics

    from quaestor.operators.kept_profile import KeptProfile

    rng = random.Random(8)
    rows = [(i, rng.gauss(50, 20) if i % 10 else None, f"name{rng.randint(0, 3000)}", [1]) for i in range(12_000)]
    schema = "id long, v double, name string, nested array<int>"
    source, kept = str(tmp_path / "t"), str(tmp_path / "kept")
    spark.createDataFrame(rows[:8000], schema).repartition(4).write.parquet(source)

    def check(held):
        found = {r.column: r for r in KeptProfile(spark, source, kept).update().collect()}
        values = [r[1] for r in held if r[1] is not None]
        assert list(found) == ["id", "v", "name"] and {r.n_rows for r in found.values()} == {len(held)}
        v, ranked = found["v"], sorted(values)
        assert (v.n_present, v.n_missing, v.low, v.high) == (len(values), len(held) - len(values), ranked[0], ranked[-1])
        assert v.mean == pytest.approx(statistics.fmean(values)) and v.std == pytest.approx(statistics.stdev(values))
        assert abs(sum(x < v.median for x in values) / len(values) - 0.5) < 0.01 + 1 / len(values)
        assert found["name"].n_distinct == pytest.approx(len({r[2] for r in held}), rel=0.03)
        assert (found["name"].first, found["name"].last) == (min(r[2] for r in held), max(r[2] for r in held))

    check(rows[:8000])
    spark.createDataFrame(rows[8000:], schema).repartition(2).write.mode("append").parquet(source)
    check(rows)
    profile = KeptProfile(spark, source, kept)
    profile.update()
    assert profile.scanned == []
    spark.createDataFrame(rows[:100], schema).coalesce(1).write.mode("append").parquet(source)
    profile.update()
    assert len(profile.scanned) == 1
    spark.createDataFrame(rows[:50], schema).coalesce(1).write.mode("overwrite").parquet(source)  # all former files are gone
    check(rows[:50])


def test_kept_profile_of_empty_and_null_columns(spark, tmp_path):
    from quaestor.operators.kept_profile import KeptProfile

    spark.createDataFrame([(None, None)], "a double, b string").coalesce(1).write.parquet(str(tmp_path / "t"))
    found = KeptProfile(spark, str(tmp_path / "t"), str(tmp_path / "k")).update().collect()
    assert [(r.column, r.n_rows, r.n_present, r.n_distinct, r["median"], r["mean"], r.first) for r in found] == [("a", 1, 0, 0, None, None, None), ("b", 1, 0, 0, None, None, None)]


def test_chunks_of_a_large_table_are_kept_with_their_lists(spark, tmp_path, monkeypatch):
    from quaestor.models import HashingEmbedder
    from quaestor.operators import retrieval
    from quaestor.sources.readers import load

    monkeypatch.setattr(retrieval, "shared_dir", lambda _: f"file://{tmp_path}/shared")
    rng = random.Random(6)
    words = ["festival", "traffic", "river", "bird", "market", "night", "rain", "stone"]
    spark.createDataFrame([(i, " ".join(rng.choices(words, k=4))) for i in range(900)], "id long, note string").coalesce(1).write.parquet(str(tmp_path / "t"))
    ds = load(spark, str(tmp_path / "t"))
    exact, kept = retrieval.Index(HashingEmbedder()), retrieval.Index(HashingEmbedder(), approximate_from=10)
    exact.build(ds)
    kept.build(ds)
    assert exact._lists is None and kept._lists.recall >= 0.95
    questions = ["distribution of note", "column id numeric range mean", "Row 7 festival river", "rain and stone"]
    best = lambda index, q: {(r.chunk_id, round(r.score, 9)) for r in index.search(q, 5, 0.0).collect()}
    shared = sum(len(best(exact, q) & best(kept, q)) for q in questions)
    assert shared >= 0.8 * sum(len(best(exact, q)) for q in questions)
    built = []
    monkeypatch.setattr(retrieval, "build_chunks", lambda _: built.append(1))
    again = retrieval.Index(HashingEmbedder(), approximate_from=10)  # another session finds what is kept
    again.build(ds)
    assert not built and best(again, questions[0]) == best(kept, questions[0])


def test_numbers_of_rows_behind_a_shuffle_stay(spark):
    from pyspark.sql import functions as F

    from quaestor.sources.readers import numbered

    df = spark.range(500).select("id", F.rand().alias("x")).repartition(5, "x").sortWithinPartitions("x")
    rows = numbered(df, "n")
    first, again = (sorted((r.n, r.id, r.x) for r in rows.collect()) for _ in range(2))
    assert first == again and [r[0] for r in first] == list(range(500))
    plain = numbered(spark.range(0, 100, 1, 4), "n")
    assert [(r.n, r.id) for r in plain.orderBy("n").collect()] == [(i, i) for i in range(100)]


def test_row_numbers_are_counted_without_shuffling_them(spark, tmp_path, monkeypatch):
    from pyspark.sql import functions as F

    from quaestor import catalogue

    def found(rows, parts):
        d = str(tmp_path / f"{len(rows)}_{parts}")
        spark.createDataFrame(rows, "l_orderkey long, l_linenumber int").repartition(parts).write.parquet(f"{d}/lineitem.parquet")
        return catalogue.QUERIES["row_numbers"](spark, d)

    rows = [(None if i % 3 else i % 7, i % 2) for i in range(70_000)]  # nulls, and rows that come many times
    for some, parts in ((rows, 5), (rows[:1], 1), (rows[:40], 9)):
        assert [tuple(r) for r in found(some, parts).collect()] == [(len(some), 0, len(some) - 1)]
    none = found([], 1)
    assert [tuple(r) for r in none.collect()] == [(0, None, None)] and [tuple(x) for x in none.dtypes] == [("n", "bigint"), ("low", "bigint"), ("high", "bigint")]
    assert "hashpartitioning(_rid" not in found(rows[:50], 3)._jdf.queryExecution().executedPlan().toString()
    # Numbers that come twice, gaps and nulls still count as distinct values do.
    odd = spark.createDataFrame([(x,) for x in (0, 0, 1, 5, 32_768, 32_769, 65_536, 65_536, 1 << 40, None)], "_rid long").repartition(4)
    monkeypatch.setattr(catalogue, "numbered", lambda df: odd)
    assert [tuple(r) for r in found(rows[:3], 1).collect()] == [tuple(r) for r in odd.agg(F.count_distinct("_rid"), F.min("_rid"), F.max("_rid")).collect()] == [(7, 0, 1 << 40)]


def test_numbering_moves_no_row(spark, tmp_path):
    """However large Spark takes the counts to be; rows are numbered in their order, with nulls, rows that come twice, empty partitions and empty tables."""
    from quaestor.sources.readers import numbered

    path = str(tmp_path / "rows")
    rows = [(None if i % 5 == 0 else i // 2, None if i % 7 == 0 else f"t{i // 2}") for i in range(600)]
    spark.createDataFrame(rows, "a long, t string").coalesce(1).write.parquet(path)
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for df in (spark.read.parquet(path), spark.createDataFrame(rows, "a long, t string"), spark.createDataFrame([rows[0]] * 2, "a long, t string")):
            found = numbered(df, "n")
            plan = found._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" not in plan and "hashpartitioning(_part" not in plan, plan
            assert [(r.a, r.t, r.n) for r in found.collect()] == [(r.a, r.t, i) for i, r in enumerate(df.collect())]
        assert numbered(spark.read.parquet(path).limit(0), "n").collect() == []
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
