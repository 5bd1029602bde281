"""Conversation memory; no Spark."""

from datetime import datetime, timedelta, timezone

import pytest

from quaestor.errors import ModelConnectionError, ModelResponseError, QueryResult, StructuredQueryError
from quaestor.memory import Memory, confidence_of, entities, question_type
from quaestor.models import HashingEmbedder, OfflineModel, grounding, retried
from quaestor.plans.plan import Filter


class Clock:
    def __init__(self):
        self.at = datetime(2030, 1, 1, tzinfo=timezone.utc)

    def __call__(self):
        return self.at


@pytest.fixture
def memory():
    return Memory(clock=Clock())


def test_limits(memory):
    for i in range(15):
        memory.add(f"question {i}", "answer")
    assert [t.question for t in memory.turns] == [f"question {i}" for i in range(5, 15)]
    memory.clock.at += timedelta(days=1, minutes=1)
    assert memory.follow_up("in these records?") is None and memory.turns == []


def test_follow_ups(memory):
    assert memory.follow_up("how many in them?") is None
    memory.add("show records where EventType is Traffic", "Found 6 rows", (Filter("EventType", "=", "Traffic"),), 6)
    assert memory.follow_up("how many in them?") == "pronoun"
    assert memory.follow_up("what about Price?") == "continuation"
    assert memory.follow_up("but only large") == "refinement"
    assert memory.follow_up("unrelated words") is None
    assert memory.carried("max Price in these records") == (Filter("EventType", "=", "Traffic"),)
    assert memory.carried("max Price") == ()
    assert memory.resolved("what is the max Price in these records?") == "what is the max Price ?"


def test_similar_and_relevant(memory):
    memory.add("average price by country", "1")
    assert memory.similar("average price") == []
    memory.add("largest festival noise", "2")
    (score, turn), *_ = memory.similar("average price in town")
    assert turn.question == "average price by country" and 0.3 < score < 0.95
    assert memory.relevant("average price country")


def test_files_keep_filters(memory, tmp_path):
    memory.add('where "River Meadow" is', "Found 2 rows", (Filter("a", "=", 1),), 2)
    memory.save(str(tmp_path / "h.json"))
    other = Memory(clock=memory.clock)
    other.load(str(tmp_path / "h.json"))
    assert other.turns == memory.turns and other.mentioned == memory.mentioned
    assert other.summary()["turns"] == 1 and "River Meadow" in other.text()
    other.export(str(tmp_path / "h.txt"))
    assert (tmp_path / "h.txt").read_text().startswith("Q: where")
    other.clear()
    assert other.turns == []


def test_classifiers():
    assert question_type("summarize all") == "summary" and question_type("how many") == "count" and question_type("hm") == "unknown"
    assert entities("show 'River Meadow' for Traffic and l_tax") == ["River Meadow", "Traffic", "l_tax"]
    assert (confidence_of("No rows match."), confidence_of("Found 3 rows"), confidence_of("x")) == (0.3, 0.9, 0.6)


def test_embedder_and_offline_model():
    e = HashingEmbedder()
    a, b, c, empty = e.embed(["night festival noise", "noise of the festival", "zzz", ""])
    dot = lambda x, y: sum(p * q for p, q in zip(x, y))
    assert dot(a, a) == pytest.approx(1) and dot(a, b) > dot(a, c) and not any(empty)
    assert "festival" in OfflineModel().ask("where is the festival", "Late festival in June\nother line")
    assert "".join(OfflineModel().ask_stream("festival?", "a festival")) == OfflineModel().ask("festival?", "a festival")
    assert grounding("", "x") == 0 and grounding("short", "x") == 0.2 and grounding("festival lasted 12 days", "festival lasted 12 days") == 1.0


def test_retries():
    calls, waits = [], []

    def fails():
        calls.append(1)
        raise ModelConnectionError("down", again=True)

    with pytest.raises(ModelConnectionError):
        retried(fails, sleep=waits.append)
    assert len(calls) == 3 and 0.5 <= waits[0] <= 1.0 <= waits[1] <= 1.5
    with pytest.raises(ModelResponseError):
        retried(lambda: (_ for _ in ()).throw(ModelResponseError("bad")), sleep=waits.append)
    assert len(waits) == 2


def test_results():
    assert QueryResult.ok(1, "structured").success
    assert QueryResult.fail("NO_MATCH").error_message
    assert str(StructuredQueryError("x")) == "[STRUCT_QUERY_ERR] x"


def test_answers_that_break_off(monkeypatch):
    from quaestor import models

    context = "The festival was loud. Birds sang."
    for text, whole in (("Yes.", False), ("It was a loud night at the", False), ("It was a loud night.", True), ("", False)):
        model = models.HttpModel("m")
        monkeypatch.setattr(model, "_generate", lambda *_, text=text: text)
        monkeypatch.setattr(model, "_streamed", lambda *_, text=text: iter(text.split(" ")))
        fallback = models.OfflineModel().ask("festival?", context)
        assert model.ask("festival?", context) == (text if whole else fallback)
        assert ("".join(model.ask_stream("festival?", context)).endswith(fallback)) is not whole


def test_replies_of_several_lines():
    from quaestor.errors import ModelResponseError
    from quaestor.models import joined_reply

    assert joined_reply('{"response": "a"}') == {"response": "a"}
    assert joined_reply('{"response": "It "}\nnoise\n{"response": "rains.", "done": true}') == {"response": "It rains.", "done": True}
    with pytest.raises(ModelResponseError):
        joined_reply("no json")


def _turns(seed, conversations=6, n=160):
    import random
    from datetime import datetime, timedelta, timezone

    rng, at, rows = random.Random(seed), datetime(2024, 1, 1, tzinfo=timezone.utc), []
    for k in range(n):
        at += timedelta(seconds=rng.choice([0, 5, 60, 400, 900]))
        rows.append((rng.choice([0, 0, 0, *range(conversations)]), k, at))
    return rows


def _replayed(rows, max_turns, max_minutes):
    """What Memory holds after each turn."""
    out, memories, now = [], {}, {}
    for c, k, at in rows:
        now["at"] = at
        memory = memories.setdefault(c, Memory(max_turns, max_minutes, lambda: now["at"]))
        memory.add(str(k), "answer")
        out.append((c, k, tuple(int(t.question) for t in memory.turns)))
    return sorted(out)


def test_remembered_turns_of_tables_and_streams(spark, tmp_path):
    from quaestor.streaming.turns import append_history, remembered, remembered_stream

    rows = _turns(3)
    wanted = _replayed(rows, 4, 20)
    key = lambda df: sorted((r.conv_id, r.turn, tuple(r.remembered)) for r in df.collect())
    df = spark.createDataFrame([(c, k, at.replace(tzinfo=None)) for c, k, at in rows] + [(None, 1, None)], "conv_id long, turn long, ts timestamp_ntz")
    assert key(remembered(df, 4, 20)) == wanted
    place, out, checkpoint = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "checkpoint")
    for lo in (0, 40, 80, 120):  # stopped and started again between batches
        df.filter(f"turn >= {lo} and turn < {lo + 40} and conv_id is not null").coalesce(1).write.mode("append").parquet(place)
        stream = spark.readStream.schema(df.schema).parquet(place)
        query = append_history(remembered_stream(stream, 4, 20, "1 day"), out, checkpoint, available_now=True)
        query.awaitTermination(120)
    assert key(spark.read.parquet(out)) == wanted


def test_state_of_quiet_conversations_goes(spark, tmp_path):
    from datetime import datetime

    from quaestor.streaming.turns import remembered_stream

    place = str(tmp_path / "in")
    for k, (c, hour) in enumerate([(1, 0), (2, 10), (2, 20), (2, 21)]):
        spark.createDataFrame([(c, k, datetime(2024, 1, 1, hour))], "conv_id long, turn long, ts timestamp_ntz").coalesce(1).write.mode("append").parquet(place)
    stream = spark.readStream.schema("conv_id long, turn long, ts timestamp_ntz").option("maxFilesPerTrigger", 1).parquet(place)
    query = remembered_stream(stream, 4, 20, "1 minute").writeStream.format("memory").queryName("quiet").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == 1
