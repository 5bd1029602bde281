"""Operators and the engine on small tables."""

import csv
import random

import pytest
from pyspark.sql import functions as F

from quaestor import cli
from quaestor.engine import Engine
from quaestor.errors import DataLoadError
from quaestor.models import HashingEmbedder
from quaestor.operators import aggregates, filters, profile, retrieval, search
from quaestor.plans.plan import Filter, QueryPlan, Sort, compile_plan
from quaestor.sources.readers import RID, Dataset, estimated_bytes, load, numbered, save
from quaestor.streaming.windows import sessions, tumbling

ROWS = [
    ("Late festival", "River Meadow", "Event", 79.5, 60),
    ("Busy hour", "Main Street", "Traffic", 88.0, 30),
    ("festival", "Main Street", "Event", 65.0, 120),
    ("Birds", "River Meadow", "Ambient", 42.0, None),
    (None, "Harbour (north)", "Traffic", 70.5, 45),
    ("Drill", "Harbour (north)", None, 95.0, 10),
]
NAMES = ["Notes", "Location", "EventType", "DecibelsA", "Duration"]


@pytest.fixture(scope="module")
def path(tmp_path_factory):
    p = tmp_path_factory.mktemp("data") / "sound.csv"
    with open(p, "w", newline="") as f:
        csv.writer(f).writerows([NAMES, *[["" if v is None else v for v in r] for r in ROWS]])
    return str(p)


@pytest.fixture(scope="module")
def ds(spark, path):
    return load(spark, path)


@pytest.fixture
def engine(spark, path):
    e = Engine(spark)
    e.load(path)
    return e


def notes(df):
    return [r.Notes for r in df.collect()]


def test_load(spark, ds, path, tmp_path):
    assert ds.columns == NAMES and ds.numeric == ["DecibelsA", "Duration"]
    assert ds.fingerprint == load(spark, path).fingerprint
    with pytest.raises(DataLoadError):
        load(spark, str(tmp_path / "none.csv"))
    save(ds.table, str(tmp_path / "out"), "parquet")
    assert load(spark, str(tmp_path / "out")).table.count() == len(ROWS)


def test_filters(ds):
    assert notes(filters.lookup(ds, "notes", "FESTIVAL")) == ["festival"]
    assert notes(filters.lookup(ds, "location", "meadow")) == ["Late festival", "Birds"]
    assert notes(filters.lookup(ds, "location", "harbour (")) == [None, "Drill"]  # no pattern, so as it stands
    assert filters.by_comparison(ds, "Location", ">", 3).count() == 0
    assert filters.by_comparison(ds, "decibelsa", ">=", 79.5).count() == 3
    assert filters.apply_filters(ds, [("EventType", "!=", "event")]).count() == 4
    assert filters.apply_filters(ds, [("x", "=", 1), ("EventType", "?", 1)]).count() == 6


def test_search(ds):
    assert notes(search.ordered(search.search(ds, "festival"))) == ["festival", "Late festival"]
    assert search.search(ds, "nan").count() == 0
    assert search.exclude(ds, "festival").count() == 4
    assert notes(search.ordered(search.search_terms(ds, ["busy", "festival"]))) == ["Busy hour", "festival", "Late festival"]
    assert notes(search.search_terms(ds, ["festival", "meadow"], "and")) == ["Late festival"]
    assert search.any_row_contains(ds, "drill") and not search.any_row_contains(ds, "decibelsa")
    assert [r.value for r in search.fuzzy(ds, "festivl").collect()][0] == "festival"
    assert "Main Street" in [r.value for r in search.fuzzy(ds, "mian stret").collect()]
    assert search.fuzzy(ds, "zzzzzz").count() == 0


def test_aggregates(ds):
    assert aggregates.scalar(ds.rows.limit(0), "sum", "DecibelsA").head()[0] == 0
    assert aggregates.scalar(ds.rows.limit(1), "std", "DecibelsA").head()[0] is None
    assert [tuple(r) for r in aggregates.group_sizes(ds.rows, ["EventType"]).collect()] == [("Ambient", 1), ("Event", 2), ("Traffic", 2)]
    first = aggregates.grouped(ds.rows, ["Location"], {"a": ("first", "Notes"), "z": ("last", "Notes")})
    assert {r.Location: (r.a, r.z) for r in first.collect()}["Harbour (north)"] == ("Drill", "Drill")
    described = {r["index"]: r.DecibelsA for r in aggregates.describe(ds.rows, ["DecibelsA"]).collect()}
    assert described["count"] == 6 and described["50%"] == 75.0
    assert {r["index"]: r.EventType for r in aggregates.describe_text(ds.rows, ["EventType"]).collect()} == {"count": "5", "unique": "3", "top": "Event", "freq": "2"}
    assert aggregates.coerced(ds.rows, "max", "Notes").head()[0] == "festival"


def test_profile(ds, spark):
    by = {r.column: r for r in profile.profile(ds).collect()}
    assert by["Notes"].n_missing == 1 and by["Location"].n_distinct == 3 and by["DecibelsA"].high == 95.0
    assert [tuple(r) for r in profile.top_values(ds.rows, "EventType", 2).collect()] == [("Event", 2), ("Traffic", 2)]
    assert [r.value for r in profile.distinct_in_order(ds.rows, "EventType").collect()] == ["Event", "Traffic", "Ambient", None]
    values = spark.createDataFrame([(float(x),) for x in [1] * 20 + [100]], "v double")
    assert [r.v for r in profile.outliers(values, "v").collect()] == [100.0]


def test_plan_order(ds):
    plan = QueryPlan("list", ("notes", "DecibelsA"), filters=(Filter("DecibelsA", ">", 50),), sort=(Sort("Notes"),), limit=2)
    assert [tuple(r) for r in compile_plan(plan, ds).collect()] == [("Busy hour", 88.0), ("Drill", 95.0)]


def test_plans_push_down(spark):
    data = Dataset(spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet"))
    df = compile_plan(QueryPlan("list", ("l_orderkey",), filters=(Filter("l_quantity", ">", 25),)), data)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,25.0)]" in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan and "Exchange" not in plan


def test_chunks(spark):
    rng = random.Random(1)
    table = spark.createDataFrame([(i, rng.random()) for i in range(200)], "a int, b double").repartition(5)
    assert (retrieval.window_size(2), retrieval.window_size(20)) == (15, 3)
    rows = numbered(table)
    assert sorted(r[RID] for r in rows.collect()) == list(range(200))
    chunks = retrieval.row_groups(rows, ["a", "b"]).collect()
    assert len(chunks) == 14 and sum(len(c.text.split("\n")) for c in chunks) == 200
    assert {r.chunk_type for r in retrieval.build_chunks(Dataset(table)).collect()} == {"rows", "column", "statistics"}


def test_index(ds):
    index = retrieval.Index(HashingEmbedder())
    assert index.search("x") is None
    index.build(ds)
    found = index.search("distinct values of Location", 3, 0.0).collect()
    assert len(found) == 3 and found[0].score >= found[1].score
    index.clear()
    assert index.search("x") is None


def test_engine_answers(engine):
    assert engine.ask("what is the average DecibelsA?").text == "The mean of DecibelsA is 73.33."
    assert engine.ask("how many records").count == 6
    found = engine.ask("all records with festival")
    assert "Late festival" in found.text and "Birds" not in found.text
    assert engine.ask("DecibelsA above 200").text == "No rows match."
    assert "Event" in engine.ask("count by EventType").text
    assert engine.ask("records not containing festival").count == 4
    assert engine.ask("analyze DecibelsA where EventType is Event").text.startswith("Analysis of 2 rows")
    assert engine.ask("What can I ask?").suggestions
    assert engine.ask("festivl").suggestions
    assert engine.ask("tell me about the birds please").text
    assert engine.ask("").text and engine.ask("??!! ;;").text


def test_follow_ups(engine):
    engine.ask("show records where EventType is Traffic")
    assert engine.ask("what is the max DecibelsA in these records?").text == "The max of DecibelsA is 88.00."
    assert engine.ask("and the min DecibelsA of them?").text == "The min of DecibelsA is 70.50."
    assert engine.ask("how many in those?").count == 2
    assert engine.ask("what is the max Location in these?").text == "The max of Location is Main Street."
    assert len(engine.memory.turns) == 5


def test_cache_without_memory(spark, path):
    e = Engine(spark, memory=False)
    assert e.ask("x").text == "No table is loaded."
    e.load(path)
    assert e.ask("how many records") is e.ask("How many records")
    assert "".join(e.stream("how many records")) == "There are 6 records."
    assert e.status()["memory"] is False


def test_a_model_can_plan(spark, path):
    class Planner:
        def ask(self, q, c):
            return "answer"

        def ask_stream(self, q, c):
            yield "answer"

        def plan(self, q, card):
            assert "DecibelsA" in card
            return {"operation": "aggregate", "columns": [{"column": "Duration", "operation": "sum"}], "groupby": ["Location"]}

        def steps(self, q, card):
            return {"steps": [{"operation": "filter", "type": "keyword_search", "keyword": "busy"}, {"operation": "list"}]}

    e = Engine(spark, Planner())
    e.load(path)
    answer = e.ask("please tell me where the longest noise came from")
    assert answer.engine == "plan" and answer.count == 3
    assert e.ask("records with something odd").count == 1


def test_a_model_answers_in_pieces(spark, path):
    class Slow:
        told = 0

        def ask(self, q, c):
            return "".join(self.ask_stream(q, c))

        def ask_stream(self, q, c):
            for piece in ("It ", "was ", "loud."):
                self.told += 1
                yield piece

        def plan(self, q, card):
            return None

        def steps(self, q, card):
            return None

    model = Slow()
    e = Engine(spark, model)
    e.load(path)
    pieces = list(e.stream("why is it so, and what does it tell about the birds"))
    assert pieces[:3] == ["It ", "was ", "loud."] and model.told == 3 and e.model is model
    assert pieces.count("It ") == 1


class Listening:
    """Answers with one sentence and keeps what it was told."""

    def __init__(self):
        self.told = []

    def ask(self, q, c):
        self.told.append(c)
        return "It was loud there."

    def ask_stream(self, q, c):
        self.told.append(c)
        yield from ("It ", "was ", "loud ", "there.")

    def plan(self, q, card):
        return None

    def steps(self, q, card):
        return None


def test_open_questions_go_to_the_model_with_the_turns_that_bear_on_them(spark, path):
    model = Listening()
    e = Engine(spark, model)
    e.load(path)
    assert e.ask("show records where EventType is Traffic").intent.kind == "structured"
    first = e.ask("why is the Traffic so remarkable")
    assert first.engine in ("semantic", "model") and first.intent.kind == "semantic"
    assert "Earlier in this conversation" in model.told[-1] and "Q: show records where EventType is Traffic" in model.told[-1]
    bare = Engine(spark, Listening(), memory=False)
    bare.load(path)
    bare.ask("why is the Traffic so remarkable")
    assert "Earlier" not in bare.model.told[-1]


def test_a_question_while_another_streams(spark, path):
    e = Engine(spark, Listening(), memory=False)
    e.load(path)
    stream = e.stream("why is it so remarkable")
    assert next(stream) == "It "
    assert e.ask("what does it reveal about birds").text == "It was loud there."  # told to this caller only
    assert "".join(stream) == "was loud there."
    again = e.stream("why is that so remarkable")
    next(again)
    again.close()
    assert e.ask("how many records").count == 6


def test_cli(path, capsys, spark, tmp_path, monkeypatch):
    history = str(tmp_path / "h.json")
    monkeypatch.setattr(spark.__class__, "stop", lambda self: None)
    assert cli.main(["-f", path, "--save-history", history, "how", "many", "records"]) == 0
    assert "There are 6 records." in capsys.readouterr().out
    assert cli.main(["-f", path + "x", "y"]) == 1


def test_streams(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = tumbling(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {tuple(r)[:3] for r in spark.table("w").collect()} == {tuple(r)[:3] for r in tumbling(events).collect()}
    assert sessions(events).agg(F.sum("n")).head()[0] == events.count()


def test_profile_by_sketches(ds):
    key = lambda df: [(r.column, r.n_present, r.n_distinct, r.high) for r in df.orderBy("position").collect()]
    assert key(profile.profile(ds, exact=False)) == key(profile.profile(ds))


def test_dates_and_size(spark):
    data = Dataset(spark.createDataFrame([("2024-01-02", "x", 1), (None, "2024/1/3", 2)], "day string, other string, n int"))
    assert profile.date_columns(data) == ["day"]
    assert profile.date_columns(Dataset(spark.read.parquet("/root/testdata/sf0.001/events.parquet"))) == ["ts"]
    assert estimated_bytes(data.table) > 0
