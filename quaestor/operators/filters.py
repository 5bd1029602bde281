"""Row predicates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaestor.functions.columns import col, contains_ci, equals_ci, number, text
from quaestor.sources.readers import Dataset

COMPARE = {
    ">": lambda c, v: c > v,
    "<": lambda c, v: c < v,
    ">=": lambda c, v: c >= v,
    "<=": lambda c, v: c <= v,
    "=": lambda c, v: c == v,
    "==": lambda c, v: c == v,
    "!=": lambda c, v: c != v,
}


def as_number(value: object) -> float | None:
    if isinstance(value, bool) or value is None:
        return None
    try:
        return float(str(value))
    except ValueError:
        return None


def all_numbers(ds: Dataset, name: str) -> bool:
    """Every value that is there is a number: by type, or by looking at the column."""
    if ds.kinds[name] == "numeric":
        return True
    if ds.kinds[name] != "text":
        return False
    return ds.rows.filter(text(name).isNotNull() & number(name, False).isNull()).isEmpty()


def lookup(ds: Dataset, name: str, value: object, exact: bool = False) -> DataFrame:
    """Rows whose value equals in any case; if there are none and not ``exact``, those that contain it."""
    found = ds.find(name)
    if found is None:
        return ds.rows.limit(0)
    if ds.kinds[found] == "numeric":
        v = as_number(value)
        return ds.rows.filter(col(found) == v) if v is not None else ds.rows.limit(0)
    same = ds.rows.filter(equals_ci(found, value))
    return same if exact or not same.isEmpty() else ds.rows.filter(contains_ci(found, value))


def by_comparison(ds: Dataset, name: str, op: str, value: float) -> DataFrame:
    """Rows that compare so; no row if the column isn't all numbers."""
    found = ds.find(name)
    if found is None or op not in COMPARE or not all_numbers(ds, found):
        return ds.rows.limit(0)
    return ds.rows.filter(COMPARE[op](number(found, ds.kinds[found] == "numeric"), float(value)))


def predicate(ds: Dataset, name: str, op: str, value: object) -> Column | None:
    """A plan's filter as a condition; None if it says nothing (unknown column or operator, no number to compare with).

    Numbers compare as numbers where the column is all numbers; else equality is that of texts in any case.
    """
    found, op = ds.find(str(name)), str(op).strip().lower()
    if found is None or value is None:
        return None
    if op in ("contains", "like"):
        return contains_ci(found, value)
    if op not in COMPARE:
        return None
    v = as_number(value)
    if v is not None and all_numbers(ds, found):
        return COMPARE[op](number(found, ds.kinds[found] == "numeric"), v)
    if op in ("=", "=="):
        return equals_ci(found, value)
    if op == "!=":
        return ~F.coalesce(equals_ci(found, value), F.lit(False))
    return None


def apply_filters(ds: Dataset, filters: list[tuple[str, str, object]]) -> DataFrame:
    """All of the filters hold."""
    conditions = [p for p in (predicate(ds, *f) for f in filters) if p is not None]
    return ds.rows.filter(reduce(lambda a, b: a & b, conditions)) if conditions else ds.rows
