"""Questions to plans; no Spark."""

from types import SimpleNamespace

import pytest

from quaestor.nl import grammar as g
from quaestor.plans.plan import Filter, Measure, QueryPlan, Sort, from_dict, parse_json
from quaestor.plans.steps import Step, default_steps

KINDS = {"Location": "text", "DecibelsA": "numeric", "FrequencyPeak": "numeric", "EventType": "text", "PublishYear": "numeric", "unit_price": "numeric", "Country": "text"}
DS = SimpleNamespace(columns=list(KINDS), kinds=KINDS)


def f(column, op, value):
    return Filter(column, op, value)


@pytest.mark.parametrize(
    ("question", "plan"),
    [
        ("What is the average DecibelsA?", QueryPlan("aggregate", ("DecibelsA",), (Measure("DecibelsA", "mean"),))),
        ("average decibels a by location", QueryPlan("aggregate", ("DecibelsA",), (Measure("DecibelsA", "mean"),), groupby=("Location",))),
        ("highest unit price per country and location", QueryPlan("aggregate", ("unit_price",), (Measure("unit_price", "max"),), groupby=("Country", "Location"))),
        ("max EventType", QueryPlan("aggregate", ("EventType",), (Measure("EventType", "max"),))),
        ("show records where Location is River Meadow", QueryPlan("list", filters=(f("Location", "=", "River Meadow"),))),
        ("show records where DecibelsA is 45.2", QueryPlan("list", filters=(f("DecibelsA", "=", 45.2),))),
        ("DecibelsA above 65", QueryPlan("list", filters=(f("DecibelsA", ">", 65),))),
        ("unit price is at most 10", QueryPlan("list", filters=(f("unit_price", "<=", 10),))),
        ("unit_price >= 10 and Country is not France", QueryPlan("list", filters=(f("unit_price", ">=", 10), f("Country", "!=", "France")))),
        ("count records where EventType is Traffic", QueryPlan("count", filters=(f("EventType", "=", "Traffic"),))),
        ("how many records are there?", QueryPlan("count")),
        ("count by country", QueryPlan("count", groupby=("Country",))),
        ("count Country", QueryPlan("aggregate", ("Country",), (Measure("Country", "count"),))),
        ("show FrequencyPeak", QueryPlan("list", ("FrequencyPeak",))),  # peak is part of a name here
        ("distinct Country", QueryPlan("distinct", ("Country",))),
        ("describe", QueryPlan("summarize")),
        ("list the first 3 sorted by unit_price descending", QueryPlan("list", sort=(Sort("unit_price", True),), limit=3)),
        ("Location contains 'meadow'", QueryPlan("list", filters=(f("Location", "contains", "meadow"),))),
    ],
)
def test_plans(question, plan):
    found = g.structured_plan(question, DS)
    assert found is not None and found.__class__(**{**found.__dict__, "source": ""}) == plan


@pytest.mark.parametrize("question", ["tell me something", "is it fine", "what happened here"])
def test_no_plan(question):
    assert g.structured_plan(question, DS) is None


@pytest.mark.parametrize(
    ("question", "way"),
    [("show Location", "structured"), ("average DecibelsA", "structured"), ("what patterns do you see", "semantic"), ("show interesting Location patterns", "hybrid"), ("hello there", "hybrid"), ("how many records", "structured")],
)
def test_route(question, way):
    assert g.route(question, DS.columns) == way


def test_resolve_prefers_exact_names():
    assert g.resolve("country", DS.columns) == "Country"
    assert g.resolve("peak", DS.columns) == "FrequencyPeak"
    assert g.resolve("xx", DS.columns) is None


def test_small_parsers():
    assert g.complexity("show it") == "simple" and g.complexity("compare all") == "complex" and g.complexity("hm") == "medium"
    assert g.corrected_command("sumarize it") == "summarize" and g.corrected_command("summarize it") is None
    assert g.is_help("What can I ask?") and not g.is_help("what can be")
    assert g.keyword_of("all records with festival") == "festival"
    assert g.is_complex("analysis for records with festival", DS.columns) and not g.is_complex("show Location", DS.columns)
    assert g.intent("average DecibelsA where Location is X", DS.columns).aggregations == ("mean",)


def test_steps():
    assert default_steps("show records containing festival", DS.columns) == [Step("filter", "keyword_search", ("festival",)), Step("list")]
    assert default_steps("records not containing festival", DS.columns)[0].type == "keyword_search_exclude"
    assert default_steps("records with concert or traffic", DS.columns)[0] == Step("filter", "compound_search", ("concert", "traffic"), "or")
    assert default_steps("analyze DecibelsA where EventType is Traffic", DS.columns)[-1] == Step("analyze", target="DecibelsA")


def test_plans_from_loose_json():
    assert from_dict(parse_json('Sure: {"operation": "list", "limit": 3, "sort": [{"column": "a", "order": "DESC"}, 5]} done')) == QueryPlan("list", sort=(Sort("a", True),), limit=3)
    assert from_dict({"operation": "explode", "limit": -1, "filters": [{"column": "a"}, None]}) == QueryPlan()
    assert parse_json("no json {here") is None


@pytest.mark.parametrize(
    ("question", "plan"),
    [
        ("average DecibelsA by Location having DecibelsA above 60", QueryPlan("aggregate", ("DecibelsA",), (Measure("DecibelsA", "mean"),), groupby=("Location",), having=(f("DecibelsA", ">", 60),))),
        ("how many records by Location having count at least 3", QueryPlan("count", groupby=("Location",), having=(f("Count", ">=", 3),))),
        ("total unit price by Country and Location with subtotals", QueryPlan("aggregate", ("unit_price",), (Measure("unit_price", "sum"),), groupby=("Country", "Location"), grouping="rollup")),
        ("total unit price by Country and Location in all combinations", QueryPlan("aggregate", ("unit_price",), (Measure("unit_price", "sum"),), groupby=("Country", "Location"), grouping="cube")),
        ("average DecibelsA with subtotals", QueryPlan("aggregate", ("DecibelsA",), (Measure("DecibelsA", "mean"),))),
    ],
)
def test_groups_of_groups(question, plan):
    assert g.structured_plan(question, DS) == plan


def test_groups_of_groups_from_json():
    plan = from_dict({"operation": "aggregate", "columns": [{"column": "a", "operation": "sum"}], "groupby": ["b", "c"], "grouping": "CUBE", "having": [{"column": "a", "operator": ">", "value": 1}, {"column": "b"}, "x"]})
    assert plan.grouping == "cube" and plan.having == (f("a", ">", 1),)
    assert from_dict({"operation": "aggregate", "grouping": "none"}).grouping == ""
