"""The query plan: what a question, a command or a model's JSON comes down to, and its DataFrame."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from quaestor.functions.columns import col
from quaestor.operators import aggregates, filters
from quaestor.sources.readers import RID, Dataset


@dataclass(frozen=True)
class Filter:
    column: str
    operator: str
    value: object


@dataclass(frozen=True)
class Measure:
    column: str
    function: str = "mean"


@dataclass(frozen=True)
class Sort:
    column: str
    descending: bool = False


OPERATIONS = ("list", "filter", "count", "aggregate", "summarize", "distinct")


@dataclass(frozen=True)
class QueryPlan:
    """filters -> operation -> having -> sort -> limit, always in this order.

    grouping: rollup or cube gives subtotals too; having: filters of the groups, on their keys, measures and counts."""

    operation: str = "list"
    columns: tuple[str, ...] = ()
    measures: tuple[Measure, ...] = ()
    filters: tuple[Filter, ...] = ()
    groupby: tuple[str, ...] = ()
    grouping: str = ""
    having: tuple[Filter, ...] = ()
    sort: tuple[Sort, ...] = ()
    limit: int | None = None
    description: str = ""
    source: str = field(default="", compare=False)


def parse_json(text: str) -> dict | None:
    """The first JSON object in a text."""
    decoder = json.JSONDecoder()
    at = text.find("{")
    while at >= 0:
        try:
            found, _ = decoder.raw_decode(text, at)
        except ValueError:
            at = text.find("{", at + 1)
            continue
        return found
    return None


def _many(value: object) -> list:
    return [] if value is None else list(value) if isinstance(value, (list, tuple)) else [value]


def from_dict(d: dict) -> QueryPlan:
    """A plan from loose JSON; parts that make no sense are left out."""
    filters_, having = ([Filter(str(f["column"]), str(f.get("operator", "=")), f["value"]) for f in _many(d.get(k)) if isinstance(f, dict) and "column" in f and "value" in f] for k in ("filters", "having"))
    grouping = str(d.get("grouping") or "").lower()
    columns, measures = [], []
    for c in _many(d.get("columns")):
        if isinstance(c, dict) and "column" in c:
            measures.append(Measure(str(c["column"]), str(c.get("operation", "mean")).lower()))
        elif isinstance(c, str):
            columns.append(c)
            measures.append(Measure(c))
    sorts = []
    for s in _many(d.get("sort")):
        if isinstance(s, dict) and "column" in s:
            sorts.append(Sort(str(s["column"]), str(s.get("order", "asc")).lower().startswith("desc")))
        elif isinstance(s, str):
            sorts.append(Sort(s))
    limit = d.get("limit")
    operation = str(d.get("operation") or "list").lower()
    return QueryPlan(
        operation if operation in OPERATIONS else "list", tuple(columns), tuple(measures), tuple(filters_), tuple(map(str, _many(d.get("groupby")))),
        grouping if grouping in ("rollup", "cube") else "", tuple(having), tuple(sorts), limit if isinstance(limit, int) and not isinstance(limit, bool) and limit > 0 else None, str(d.get("description") or ""),
    )


def compile_plan(plan: QueryPlan, ds: Dataset) -> DataFrame:
    """The plan as a lazy DataFrame; the optimizer does the rest."""
    rows = filters.apply_filters(ds, [(f.column, f.operator, f.value) for f in plan.filters])
    keys = [c for c in map(ds.find, plan.groupby) if c]
    sets = aggregates.group_sets(plan.grouping, keys) if plan.grouping and keys else None
    if plan.operation == "count":
        sized = lambda: aggregates.grouped_sets(rows, keys, sets, {"Count": ("size", keys[0])}) if sets else aggregates.group_sizes(rows, keys)
        out = sized() if keys else aggregates.counted(rows)
    elif plan.operation == "aggregate" and plan.measures:
        chosen = {}
        for m in plan.measures:  # a later one for the same column wins
            found = ds.find(m.column)
            if found and m.function in aggregates.FUNCTIONS and found not in keys:
                chosen[found] = (m.function, found)
        if not chosen:
            out = rows.drop(RID)
        elif keys:
            out = aggregates.grouped_sets(rows, keys, sets, chosen) if sets else aggregates.grouped(rows, keys, chosen)
        else:
            out = aggregates.measured(rows, [], chosen)
    elif plan.operation == "summarize":
        names = [c for c in map(ds.find, plan.columns) if c] or ds.columns
        numbers = [c for c in names if ds.kinds[c] == "numeric"]
        out = aggregates.describe(rows, numbers) if numbers else aggregates.describe_text(rows, [c for c in names if ds.kinds[c] == "text"])
    elif plan.operation == "distinct":
        from quaestor.operators.profile import distinct_in_order

        found = next((c for c in map(ds.find, plan.columns) if c), None)
        out = distinct_in_order(rows, found) if found else rows.drop(RID).distinct()
    else:
        names = [c for c in map(ds.find, plan.columns) if c]
        out = rows.select(*[col(c) for c in names]) if names else rows.drop(RID)
    for f in plan.having:
        found = next((c for c in out.columns if c.lower() == f.column.lower()), None)
        condition = filters.predicate(Dataset(out), found, f.operator, f.value) if found else None
        out = out.filter(condition) if condition is not None else out
    orders = []
    for s in plan.sort:
        found = next((c for c in out.columns if c.lower() == s.column.lower()), None)
        if found:
            orders.append(col(found).desc_nulls_last() if s.descending else col(found).asc_nulls_last())
    out = out.orderBy(*orders) if orders else out
    return out.limit(plan.limit) if plan.limit else out
