"""Questions of several steps: filters that narrow each other, then a listing or an analysis."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame

from quaestor.nl import vocabulary as V
from quaestor.nl.grammar import conditions, has, mentions, without_columns
from quaestor.operators import filters, profile, search
from quaestor.sources.readers import Dataset


@dataclass(frozen=True)
class Step:
    operation: str  # filter, analyze, list
    type: str = ""  # keyword_search, compound_search, keyword_search_exclude, column_filter
    keywords: tuple[str, ...] = ()
    how: str = "or"
    column: str | None = None
    operator: str = "="
    value: object = None
    target: str | None = None


def from_dict(d: dict | None) -> list[Step]:
    """Steps from a model's JSON."""
    out = []
    for s in (d or {}).get("steps") or []:
        if isinstance(s, dict) and s.get("operation") in ("filter", "analyze", "list"):
            words = s.get("keywords") or ([s["keyword"]] if s.get("keyword") else [])
            out.append(Step(s["operation"], s.get("type") or "", tuple(map(str, words)), str(s.get("logical_operator") or "or").lower(), s.get("column"), "=", s.get("value"), s.get("target")))
    return out


def default_steps(question: str, columns: list[str]) -> list[Step]:
    """Conditions on columns, else the remaining words as keywords (any of them after "or", none of them after a negation); then analysis or listing."""
    stated = conditions(question, columns)
    steps = [Step("filter", "column_filter", column=f.column, operator=f.operator, value=f.value) for f in stated]
    bare = without_columns(question, columns)
    if not stated:
        words = [w for w in re.findall(r"[\w'-]+", bare.lower()) if w not in V.STEP_SKIP and len(w) > 3]
        if words and has(bare, V.NEGATION):
            steps += [Step("filter", "keyword_search_exclude", (w,)) for w in words]
        elif len(words) > 1 and (has(bare, ("or",)) or has(bare, ("and",))):
            steps.append(Step("filter", "compound_search", tuple(words), "or" if has(bare, ("or",)) else "and"))
        elif words:
            steps.append(Step("filter", "keyword_search", (words[-1],)))
    target = next((c for _, _, c in mentions(question, columns) if c not in {f.column for f in stated}), None)
    return [*steps, Step("analyze", target=target) if has(bare, V.ANALYSIS) else Step("list")]


def narrowed(ds: Dataset, steps: list[Step]) -> Dataset:
    """The rows that all filter steps leave."""
    now = ds
    for s in steps:
        if s.operation != "filter":
            continue
        if s.type == "keyword_search_exclude":
            rows = search.exclude(now, s.keywords[0]) if s.keywords else now.rows
        elif s.type == "column_filter":
            p = filters.predicate(now, s.column or "", s.operator, s.value)
            rows = now.rows if p is None else now.rows.filter(p)
        elif s.keywords:
            rows = search.search_terms(now, list(s.keywords), s.how).drop("_rank")
        else:
            rows = now.rows
        now = Dataset(rows, ds.source, "")
    return now


def execute(ds: Dataset, steps: list[Step]) -> DataFrame | dict:
    """The rows, or an analysis of them."""
    now = narrowed(ds, steps)
    last = next((s for s in steps if s.operation != "filter"), None)
    if last and last.operation == "analyze":
        return profile.analyze(now, targets=[last.target] if last.target else None)
    return now.table
