"""Quantiles, column information, nearest vectors, and the forms of answers, against plain versions."""

import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from quaestor import render
from quaestor.models import HashingEmbedder, semantic_confidence, structured_confidence
from quaestor.nl.grammar import question_info
from quaestor.operators import aggregates, conversations, profile, retrieval, search
from quaestor.operators import quantiles as quantile_module
from quaestor.operators.quantiles import quantiles
from quaestor.sources.readers import Dataset


@pytest.mark.parametrize("kind", ["spread", "ties", "tails"])
def test_quantiles_beyond_the_sketch(spark, kind):
    rng = random.Random(kind)
    draw = {"spread": rng.random, "ties": lambda: float(rng.randint(0, 4)), "tails": lambda: rng.paretovariate(0.4)}[kind]
    values = [draw() for _ in range(60_000)]
    df = spark.createDataFrame([(v,) for v in values + [None] * 50], "v double").repartition(4)
    found = quantiles(df, [], ["v"], [0.0, 0.25, 0.5, 0.9, 1.0], ["q"]).head().q
    assert found == pytest.approx(list(np.quantile(values, [0.0, 0.25, 0.5, 0.9, 1.0])), rel=1e-12)


def test_quantiles_of_groups(spark):
    rng = random.Random(5)
    sizes = {"a": 30_000, "b": 1, "c": 2, "d": 700, "none": 0}
    groups = {g: [round(rng.gauss(0, 9), 2) for _ in range(n)] for g, n in sizes.items()}
    rows = [(g, v, 1) for g, vs in groups.items() for v in vs] + [("none", None, 1), (None, 1.0, 1)]
    df = spark.createDataFrame(rows, "k0 string, total double, at int")  # names that are used inside too
    out = aggregates.grouped(df, ["k0"], {"m": ("median", "total"), "n": ("count", "at"), "k0 ": ("median", "at")}).collect()
    assert [r.k0 for r in out] == sorted(groups)
    for r in out:
        assert r.m == (pytest.approx(statistics.median(groups[r.k0])) if groups[r.k0] else None)
        assert r.n == max(1, len(groups[r.k0])) and r["k0 "] == 1
    assert aggregates.grouped(df.limit(0), ["k0"], {"m": ("median", "total")}).count() == 0
    assert aggregates.scalar(df.limit(0), "median", "total").head().value is None


def test_no_task_holds_all_values_for_a_median(spark, monkeypatch):
    """Of a table that isn't small only brackets are counted value by value."""
    df = spark.range(100_000).select(F.rand(1).alias("v"))
    at_once = aggregates.scalar(df, "median", "v")._jdf.queryExecution().executedPlan().toString()
    assert "percentile(" in at_once
    monkeypatch.setattr(quantile_module, "SMALL_BYTES", 0)
    plan = aggregates.scalar(df, "median", "v")._jdf.queryExecution().executedPlan().toString()
    assert "percentile_approx" in plan and "percentile(" not in plan and "median(" not in plan


@pytest.mark.parametrize("broadcast_cuts", [1000, 0])
def test_a_group_with_half_of_all_rows(spark, broadcast_cuts):
    """Its rows aren't brought together by group: they meet their brackets where they are, or by a salt."""
    rng = np.random.default_rng(2)
    group, value = np.where(rng.random(60_000) < 0.5, 0, rng.integers(1, 50, 60_000)), np.round(rng.standard_normal(60_000) * 50, 1)
    df = spark.createDataFrame([(int(g), float(v)) for g, v in zip(group, value)], "g int, v double").repartition(6)
    found = quantiles(df, ["g"], ["v"], [0.25, 0.5, 0.99], ["q"], small_bytes=0, broadcast_cuts=broadcast_cuts)
    plan = found._jdf.queryExecution().executedPlan().toString()
    for r in found.collect():
        assert r.q == pytest.approx(list(np.quantile(value[group == r.k0], [0.25, 0.5, 0.99])))
    assert ("salt" in plan) is (broadcast_cuts == 0)
    small = {r.k0: r.q for r in quantiles(df, ["g"], ["v"], [0.25, 0.5, 0.99], ["q"], small_bytes=1 << 62).collect()}
    assert all(small[r.k0] == pytest.approx(r.q) for r in found.collect())


def test_profile_of_what_is_asked(spark):
    ds = Dataset(spark.createDataFrame([(1.0, "x"), (2.0, "y"), (9.0, None)], "a double, median string"))
    full = {r.column: r for r in profile.profile(ds).collect()}
    assert full["a"]["median"] == 2.0 and full["median"]["median"] is None and full["median"].n_distinct == 2
    part = profile.profile(ds, distinct=False, median=False)
    assert [(r.n_distinct, r["median"]) for r in part.collect()] == [(None, None)] * 2
    assert "Expand" not in part._jdf.queryExecution().executedPlan().toString()


def test_column_info(spark):
    rows = [(1, "b", [1]), (1, "a", None), (2, None, [2]), (3, "b", [2]), (4, "c", [1]), (5, "d", None)]
    found = {r.column: r for r in profile.column_info(Dataset(spark.createDataFrame(rows, "n int, position string, value array<int>").coalesce(1))).collect()}
    assert (found["n"].type, found["n"].n_present, found["n"].samples) == ("int", 6, ["1", "2", "3"])
    assert (found["position"].n_present, found["position"].samples) == (5, ["b", "a", "c"])
    assert found["value"].samples == ["[1]", "[2]"]
    empty = profile.column_info(Dataset(spark.createDataFrame([], "n int"))).collect()
    assert [(r.n_present, r.samples) for r in empty] == [(0, [])]


def test_nearest_each(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "BLOCK", 7)
    rng = np.random.default_rng(2)
    vectors = rng.integers(-2, 3, (60, 4)).astype(float)  # with ties and zero vectors
    vectors[5] = 0
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)] + [(None, [1.0] * 4), (99, None)], "vec_id long, embedding array<double>").repartition(3)
    found = {}
    for r in retrieval.nearest_each(df, df.filter("vec_id % 10 = 0"), 4).collect():
        found.setdefault(r["query"], []).append((r.place, r.id))
    for q in range(0, 60, 10):
        size = np.linalg.norm(vectors, axis=1) * np.linalg.norm(vectors[q])
        score = np.round(vectors @ vectors[q] / np.where(size == 0, 1e-10, size), 12)
        wanted = sorted(range(60), key=lambda i: (-score[i], i))[:4]
        assert [i for _, i in sorted(found[q])] == wanted
    assert retrieval.nearest_each(df, df.limit(0)).count() == 0
    assert all(r.score >= 0.9 for r in retrieval.nearest_each(df, df.filter("vec_id % 10 = 0"), 4, 0.9).collect())


def test_single_questions_are_embedded_once(spark):
    class Counting(HashingEmbedder):
        calls = 0

        def embed(self, texts):
            Counting.calls += 1
            return super().embed(texts)

    index = retrieval.Index(Counting())
    assert index._single("a question") == index._single("a question") and Counting.calls == 1


def test_fuzzy_over_fractions(spark):
    ds = Dataset(spark.createDataFrame([(12345.5, 12345, "river"), (7.25, 7, "road")], "x double, n int, s string"))
    assert {r.value for r in search.distinct_values(ds).collect()} == {"12345.5", "7.25", "river", "road"}
    assert search.fuzzy(ds, "12345.6").collect()[0].value == "12345.5"
    assert search.fuzzy(Dataset(spark.createDataFrame([(1,)], "n int")), "abc").count() == 0


def test_forms(spark):
    few = spark.createDataFrame([(1, "a|b"), (22, None)], "n int, s string")
    assert render.table(few) == ("n   s\n-------\n1   a|b\n22", 2)
    text, n = render.table(spark.range(30).coalesce(1))
    assert n == 30 and text.startswith("| id |") and text.endswith("... and 10 more rows")
    assert render.matches(few.limit(0), None, "n", "7") == ("Nothing is known of n 7.", 0)
    assert render.matches(few.filter("n = 1"), "s", "n", "1") == ("s for n 1: a|b", 1)
    assert render.matches(few.filter("n = 1")) == ("- n: 1\n- s: a|b", 1)
    assert render.matches(few, None, "n", "2")[0] == "Found 2 matches for n 2:\n\nMatch 1:\n- n: 1\n- s: a|b\n\nMatch 2:\n- n: 22\n- s: "


def test_question_info():
    columns = ["Item", "Price", "In Stock"]
    found = question_info("What is the price of item Lamp?", columns)
    assert (found.target_column, found.id_column, found.id_value) == ("Price", "Item", "Lamp")
    found = question_info("list items where price is above 10", columns)
    assert (found.command, found.comparison.column, found.comparison.operator, found.id_column) == ("list", "Price", ">", None)
    found = question_info("lamp", columns)
    assert (found.target_column, found.id_column, found.id_value) == (None, "Item", "lamp")
    assert question_info("help", columns).help and question_info("sumarize price", columns).correction == "summarize"


def test_confidence():
    assert structured_confidence("average price", "x" * 30, 3) == 0.9
    assert structured_confidence("average price", "x" * 30, 0) == pytest.approx(0.63)
    assert structured_confidence("max price", "x", 1) == pytest.approx(0.792)
    assert structured_confidence("show price", "x" * 30, 3) == pytest.approx(0.99)
    assert semantic_confidence("The price is 3", ["Price", "Item"]) == pytest.approx(0.85)
    assert semantic_confidence("I don't have that", []) == pytest.approx(0.35)
    assert semantic_confidence("The average of price and item is 3", ["Price", "Item"]) == pytest.approx(1.0)


def test_conversations(spark):
    rows = [(1, 1, "user", "red apples and red pears"), (1, 2, "bot", 'the "big one" of unit_price'), (2, 1, "user", "red plums"), (2, 2, "user", None), (3, 1, "user", "blue sky"), (3, 2, "user", 'unit_price "big one" unit_price')]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert {tuple(r) for r in conversations.counters(turns, "role").collect()} == {("user", 5), ("bot", 1)}
    assert [tuple(r) for r in conversations.mentioned(turns, "text").collect()] == [("unit_price", 3), ("big one", 2)]
    assert {(r.conv_id, r.turn) for r in conversations.latest(turns, 1).collect()} == {(1, 2), (2, 2), (3, 2)}
    scores = {(r.conv_id, r.turn): r.score for r in conversations.similar(turns, (F.col("conv_id") == 1) & (F.col("turn") == 1)).collect()}
    assert set(scores) == {(1, 1), (2, 1)} and scores[1, 1] == pytest.approx(1) and 0 < scores[2, 1] < 1
    assert conversations.similar(turns.limit(0), F.lit(True)).count() == 0 and conversations.similar(turns, F.col("conv_id") == 9).count() == 0


def test_rows_within_a_search(spark):
    ds = Dataset(spark.createDataFrame([(1, "red"), (2, "blue"), (3, None), (4, "dark red")], "n int, s string"))
    assert [r.n for r in search.within(ds, F.col("n") > 1, "red").collect()] == [4]
    assert sorted(r.n for r in search.within(ds, None, "red", keep=False).collect()) == [2, 3]


def test_duplicates(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "s string")
    assert [r.n for r in profile.duplicates(df, "s").collect()] == [2]


def test_a_number_asked_of_a_date(spark):
    from quaestor.operators.filters import apply_filters, by_comparison

    ds = Dataset(spark.sql("SELECT timestamp_ntz'2024-01-01 00:00:00' AS t, date'2024-01-01' AS d, 1 AS n UNION ALL SELECT null, null, 2"))
    assert by_comparison(ds, "t", ">", 5).count() == 0 and apply_filters(ds, [("d", ">", 5)]).count() == 2
    assert apply_filters(ds, [("d", "=", "2024-01-01")]).count() == 1


def _plain_fuzzy(values, term, k):
    """As fuzzy, by comparing all."""
    from difflib import SequenceMatcher

    low, out = term.lower(), []
    ratio = lambda x: SequenceMatcher(None, low, x).ratio()
    for value in {v for v in values if v is not None}:
        v = value.lower()
        scores = [ratio(v)] if ratio(v) >= 0.4 else []
        scores += [0.9] if (len(low) >= 3 and low in v) or (len(low) > 5 and v in low) else []
        a, b = set(low.split()), set(v.split())
        scores += [len(a & b) / len(a | b)] if a | b and len(a & b) / len(a | b) > 0.5 else []
        near = [(len(set(low) & set(w)) / len(set(low) | set(w)) + ratio(w)) / 2 for w in v.split() if len(w) >= 3]
        scores += [max(near)] if near and max(near) > 0.6 else []
        if scores:
            out.append((value, max(scores)))
    return sorted(out, key=lambda r: (-r[1], r[0]))[:k]


@pytest.mark.parametrize("term", ["festivel", "Rush houre", "ab", "night market concert", "zzzzq", "é中", "aaaaaaaaab"])
def test_fuzzy_is_what_comparing_all_gives(spark, monkeypatch, term):
    rng = random.Random(11)
    parts = ["festival", "rush", "hour", "night", "market", "concert", "Birds", "é中文", "aaaa", "morning", "x"]
    values = [" ".join("".join(c for c in rng.choice(parts) if rng.random() > 0.1) for _ in range(rng.randint(1, 3))).strip() or "y" for _ in range(600)] + [None, "festival"]
    ds = Dataset(spark.createDataFrame([(v,) for v in values], "v string"))
    monkeypatch.setattr(search, "FIRST", 8)
    for k in (1, 3):
        found = [(r.value, r.score) for r in search.fuzzy(ds, term, k).collect()]
        wanted = _plain_fuzzy(values, term, k)
        assert [v for v, _ in found] == [v for v, _ in wanted] and [s for _, s in found] == pytest.approx([s for _, s in wanted])


def test_few_values_are_compared(spark):
    values = [f"{w} {i:04d}" for i in range(500) for w in ("quartz", "lumber", "pigment")] + ["festival ground"]
    ds = Dataset(spark.createDataFrame([(v,) for v in values], "v string"))
    bounds = {r.value: r.bound for r in search.fuzzy_candidates(ds, "festivals").collect()}
    best = search.fuzzy(ds, "festivals", 1).head()
    assert best.value == "festival ground" and sum(b >= best.score for b in bounds.values()) < 5


@pytest.mark.parametrize("width", [7, 1000, 10**7])
def test_joins_by_time_against_comparing_all(spark, width):
    """A key that holds most rows, ties, nulls, times before 1970, and rows without a match."""
    from datetime import datetime, timedelta

    from quaestor.operators.temporal import asof_join, range_join

    rng = random.Random(width)
    at = lambda: None if rng.random() < 0.05 else datetime(1970, 1, 1) + timedelta(seconds=rng.randint(-300, 900) / 2)
    key = lambda: rng.choice([1, 1, 1, 1, 2, 3, None])
    left, right = [(i, key(), at()) for i in range(150)], [(key(), at(), i) for i in range(120)]
    right += [(1, datetime(1970, 1, 1, 0, 0, 30), 900 + i) for i in range(3)]
    a = spark.createDataFrame(left, "id long, k int, t timestamp_ntz")
    b = spark.createDataFrame(right, "k int, t timestamp_ntz, v int")
    found = {r.id: r.r_v for r in asof_join(a, b, {"k": "k"}, ("t", "t"), ["v"], width, "r_").collect()}
    for i, k, t in left:
        fit = [(u, v) for j, u, v in right if k is not None and j == k and t is not None and u is not None and u <= t]
        assert found[i] == (max(fit)[1] if fit else None)
    spans = [(k, t, t and t + timedelta(seconds=rng.choice([0, 1, 5, 40])), v) for k, t, v in right]
    c = spark.createDataFrame(spans, "k int, s timestamp_ntz, e timestamp_ntz, v int")
    met = sorted((r.id, r.v) for r in range_join(a, c, {"k": "k"}, "t", ("s", "e"), width, "").select("id", "v").collect())
    assert met == sorted((i, v) for i, k, t in left for j, u, e, v in spans if k is not None and j == k and t is not None and u is not None and u <= t < e)


def test_range_join_shuffles_each_value_once(spark):
    """Neither side of the exchange holds its key or its times a second time; what is shuffled are the columns that are asked for, the key, the times and the bucket."""
    import re

    from quaestor.operators.temporal import range_join

    points = spark.range(0, 4000, 1, 4).selectExpr("id % 50 AS k", "id", "timestamp_ntz'2020-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, id) AS t", "id AS unused")
    spans = points.selectExpr("k", "id AS v", "t AS s", "t + INTERVAL 90 SECOND AS e", "unused")
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = range_join(points, spans, {"k": "k"}, "t", ("s", "e"), 60, "r_").select("k", "id", "t", "r_v")
        plan = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
        assert sorted(map(int, re.findall(r"\) Exchange\nInput \[(\d+)\]", plan))) == [4, 5], plan  # k, id, t, bucket; k, v, s, e, bucket
        assert df.count() == sum(1 for i in range(4000) for j in range(max(0, i - 89), i + 1) if i % 50 == j % 50)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)


def test_range_join_of_odd_rows_and_names(spark):
    """Names of the join's own columns, other cases, both sides alike, times of other types, rows that come twice, nulls and empty tables."""
    from datetime import date, datetime, timedelta

    from quaestor.operators.temporal import range_join

    day, none = datetime(2020, 3, 1), None
    rows = [("a", date(2020, 3, 1), 1, 7), ("a", date(2020, 3, 1), 1, 7), ("a", none, 2, 8), (none, date(2020, 3, 1), 3, none), ("b", date(2020, 3, 2), none, 9), ("", date(2020, 3, 2), 5, 9), ("zz", date(2020, 3, 2), 6, 9)]
    points = spark.createDataFrame(rows, "`_b` string, `_pb` date, `_p0` int, `_i.0` int")
    spans = [("a", day, day + timedelta(days=1), none), ("a", day, day + timedelta(days=1), none), ("a", day, day, 1), ("a", day + timedelta(days=1), day, 2), ("a", none, day, 3), ("a", day, none, 4)]
    spans += [("b", day, day + timedelta(days=2), 5), ("", day - timedelta(days=400), day + timedelta(days=1, seconds=1), 6), (none, day, day + timedelta(days=9), 7)]
    held = spark.createDataFrame(spans, "`_B` string, `_i1` timestamp_ntz, e timestamp_ntz, `_p0` int")
    found = range_join(points, held.withColumn("_i1", held["_i1"].cast("timestamp")), {"_B": "_b"}, "_PB", ("_I1", "E"), 86_400, "r_")
    assert found.columns == ["_b", "_pb", "_p0", "_i.0", "r__B", "r__i1", "r_e", "r__p0"]
    assert [t for _, t in found.dtypes] == ["string", "date", "int", "int", "string", "timestamp", "timestamp_ntz", "int"]
    at = lambda d: d and datetime(d.year, d.month, d.day)
    fit = [(*p, *s) for p in rows for s in spans if None not in (p[0], p[1], s[0], s[1], s[2]) and p[0] == s[0] and s[1] <= at(p[1]) < s[2]]
    key = lambda r: str(tuple(r))
    assert sorted(map(key, found.collect())) == sorted(map(key, fit)) and len(fit) == 6
    assert range_join(points.limit(0), held, {"_b": "_B"}, "_pb", ("_i1", "e")).count() == range_join(points, held.limit(0), {"_b": "_B"}, "_pb", ("_i1", "e")).count() == 0
    same = spark.createDataFrame([(1, day, day + timedelta(days=1)), (1, day + timedelta(hours=5), day + timedelta(hours=6)), (none, day, day + timedelta(days=1))], "k int, s timestamp_ntz, e timestamp_ntz")
    assert range_join(same, same, {"k": "k"}, "s", ("s", "e"), 3600, "r_").count() == 3  # a table with itself


def test_grouping_sets_with_nulls_and_odd_names(spark):
    rows = [("x", "a", 1.0), ("x", "b", 2.0), ("y", "a", None), (None, "a", 9.0), ("y", None, 9.0)]
    df = spark.createDataFrame(rows, "`k.1` string, m0 string, v double")
    key = lambda df: sorted(map(str, df.collect()))
    sets = aggregates.group_sets("rollup", ["k.1", "m0"])
    plain = aggregates.grouped_sets(df, ["k.1", "m0"], sets, {"k": ("sum", "v"), "n": ("count", "v"), "q": ("max", "v")})
    assert [tuple(r) for r in plain.collect()] == [("x", "a", 1.0, 1, 1.0), ("x", "b", 2.0, 1, 2.0), ("x", None, 3.0, 2, 2.0), ("y", "a", 0.0, 0, None), ("y", None, 0.0, 0, None), (None, None, 3.0, 2, 2.0)]
    ranked = aggregates.grouped_sets(df, ["k.1", "m0"], sets, {"k": ("sum", "v"), "n": ("count", "v"), "q": ("median", "v")}).drop("q")
    assert key(ranked) == key(plain.drop("q"))
    assert aggregates.group_sets("cube", ["a", "b"]) == [["a", "b"], ["b"], ["a"], []]
    assert aggregates.grouped_sets(df.limit(0), ["m0"], [["m0"]], {"v": ("sum", "v")}).count() == 0


def test_registered_aggregates(spark):
    from quaestor.plans.plan import compile_plan, from_dict

    aggregates.register("Width", lambda c: F.max(c) - F.min(c))
    with pytest.raises(ValueError, match="no free name"):
        aggregates.register("width", F.max)
    with pytest.raises(ValueError, match="no free name"):
        aggregates.register("sum", F.max)
    ds = Dataset(spark.createDataFrame([("a", 1), ("a", 5), ("b", 2)], "k string, v int"))
    plan = from_dict({"operation": "aggregate", "columns": [{"column": "v", "operation": "WIDTH"}], "groupby": ["k"]})
    assert [tuple(r) for r in compile_plan(plan, ds).collect()] == [("a", 4), ("b", 0)]
    del aggregates.FUNCTIONS["width"]


def test_similar_turns_against_brute_force(spark, monkeypatch):
    """Several blocks and parts, equal turns, ties and turns without words; what tasks send doesn't grow with the pairs that are alike."""
    import math
    import random
    from collections import Counter

    rng = random.Random(4)
    texts = [" ".join(rng.choice(["red", "green", "blue", "plum", "pear", "fig", "kiwi", "date"]) for _ in range(rng.randint(1, 4))) + f" n{'abcdefghij'[i % 10]}x" for i in range(120)]
    texts += ["", None, "1 2", "plum"] + texts[:30] + [f"shared words {'abcdefghijklmnopqrst'[i]}q" for i in range(20)]
    rows = [(i // 4, i % 4, x) for i, x in enumerate(texts)]
    monkeypatch.setattr(conversations, "BLOCK", 16)
    sent, of = [], conversations.written
    monkeypatch.setattr(conversations, "written", lambda *given: sent.append(of(*given)) or sent[-1])
    turns = spark.createDataFrame(rows, "conv_id long, turn long, text string").repartition(5)
    found = {(r.conv_id, r.turn, r.place): (tuple(r.other), r.score) for r in conversations.similar_each(turns).collect()}
    bags = {(c, t): [w for w in (x or "").split() if w.isalpha() and len(w) > 1] for c, t, x in rows}
    df = Counter(w for b in bags.values() for w in set(b))
    weights = {}
    for key, b in bags.items():
        w = {t: n / len(b) * (math.log((1 + len(rows)) / (1 + df[t])) + 1) for t, n in Counter(b).items()}
        size = math.sqrt(sum(x * x for x in w.values()))
        weights[key] = {t: x / size for t, x in w.items()}
    wanted = {}
    for a, x in weights.items():
        scores = [(-round(s, 12), b, s) for b, y in weights.items() if a != b and 0.3 < (s := sum(v * y.get(t, 0.0) for t, v in x.items())) < 0.95]
        wanted |= {(*a, k + 1): (b, s) for k, (_, b, s) in enumerate(sorted(scores)[:3])}
    assert found.keys() == wanted.keys() and len(found) > 300
    assert all(found[k][0] == b and found[k][1] == pytest.approx(s) for k, (b, s) in wanted.items())
    met = next(t for t in sent if t.columns == ["bag", "of", "score"])
    distinct = len({tuple(sorted(b)) for b in bags.values() if b})
    assert met.groupBy("bag").count().agg({"count": "max"}).head()[0] <= 3 * 2 * conversations.PARTS and met.count() < distinct * distinct / 2


@pytest.mark.parametrize("few", [0, 1, 10**9])
def test_heavy_words_are_looked_at_for_few_pairs(monkeypatch, few):
    """Blocks against brute force, by lists and by matrices; pairs that can't reach a bar cost no look at the words that many turns hold."""
    import numpy as np

    from quaestor.operators import turn_blocks as T

    rng = np.random.default_rng(few % 7)
    for name, x in (("PAIRS", 1000), ("LISTED", 50), ("DENSE", 7), ("FEW", few), ("HELD", 40)):
        monkeypatch.setattr(T, name, x)
    listed, spans = [0], T.spans
    monkeypatch.setattr(T, "spans", lambda begin, n: listed.__setitem__(0, listed[0] + int(n.sum())) or spans(begin, n))
    words, bags = 1200, 400  # the first 30 words are common
    times = [dict(zip(rng.choice(30, 5, False), rng.integers(1, 3, 5))) | dict(zip(rng.integers(30, words, 8), rng.integers(1, 3, 8))) for _ in range(bags)]
    times[50:90] = [dict(list(t.items())[:10]) | {40 + 7 * i: 2} for i, t in enumerate(times[:10] * 4)]
    df = np.bincount([w for t in times for w in t], minlength=words)
    idf = np.log((1 + bags) / (1 + df)) + 1
    full = np.array([[t.get(w, 0) for w in range(words)] for t in times]) * idf
    full /= np.linalg.norm(full, axis=1)[:, None]

    def block(lo, hi):
        has = np.unique([w for t in times[lo:hi] for w in t])
        flat = [(np.searchsorted(has, w), n) for t in times[lo:hi] for w, n in t.items()]
        place, n = np.array(flat).T
        return T.Block(T.squeezed(ids=np.arange(lo, hi), words=has, idf=idf[has], distinct=np.array([len(t) for t in times[lo:hi]], np.int32), place=place.astype(np.int32), times=n.astype(np.int32)))

    scores = full @ full.T
    blocks = [block(0, 190), block(190, 400)]
    best = [T.Best(b.ids, 3, 0.3) for b in blocks]
    for x, y in ((0, 0), (0, 1), (1, 1)):
        a, b = blocks[x], blocks[y]
        for i, j, s in T.met(a, b, 3, 0.3, 0.95, best[x].bar, best[y].bar):
            best[x].meet(i, b.ids[j], s)
            best[y].meet(j, a.ids[i], s)
    found = {tuple(r[:2]): r[2] for x in best for r in zip(*x.rows().to_pydict().values())}
    wanted = {}
    for i, row in enumerate(scores):
        fit = sorted((-round(s, 12), j) for j, s in enumerate(row) if j != i and 0.3 < s < 0.95)[:3]
        wanted |= {(i, j): row[j] for _, j in fit}
    assert len(found) > 150
    assert found.keys() == wanted.keys() and all(found[k] == pytest.approx(v, abs=1e-12) for k, v in wanted.items())
    shared = sum(len(a.keys() & b.keys()) for i, a in enumerate(times) for b in times[:i])
    assert listed[0] < shared


def test_similar_turns_of_none(spark):
    none = spark.createDataFrame([(1, 1, None), (1, 2, "7")], "conv_id long, turn long, text string")
    assert conversations.similar_each(none).count() == 0 and conversations.similar_each(none.limit(0)).count() == 0
