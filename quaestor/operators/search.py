"""Keyword search over all columns, with rank, and its set operations."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from quaestor.functions.columns import char_jaccard, contains_ci, equals_ci, text
from quaestor.sources.readers import RID, Dataset


def keyword_rank(columns: list[str], term: str) -> Column:
    """2 i if column i equals the term, 2 i + 1 if it contains it; the least over columns, null if none."""
    ranks = [F.when(equals_ci(c, term), 2 * i).when(contains_ci(c, term), 2 * i + 1) for i, c in enumerate(columns)]
    return F.least(*ranks) if len(ranks) > 1 else ranks[0]


def _searched(ds: Dataset) -> list[str]:
    return [c for c, k in ds.kinds.items() if k != "nested"]


def search(ds: Dataset, term: str, columns: list[str] | None = None) -> DataFrame:
    """Rows with the term, with their ``_rank``; order by (_rank, row id) for the order of a search."""
    return ds.rows.withColumn("_rank", keyword_rank(columns or _searched(ds), term)).filter("_rank is not null")


def exclude(ds: Dataset, term: str, columns: list[str] | None = None) -> DataFrame:
    return ds.rows.filter(keyword_rank(columns or _searched(ds), term).isNull())


def within(ds: Dataset, condition: Column | None, term: str, keep: bool = True, columns: list[str] | None = None) -> DataFrame:
    """Rows for which the condition holds and that are (``keep``) or aren't among those of a search. Both sides are of the same rows, so no join is needed."""
    part = ds if condition is None else Dataset(ds.rows.filter(condition), ds.source)
    return search(part, term, columns).drop("_rank") if keep else exclude(part, term, columns)


def search_terms(ds: Dataset, terms: list[str], how: str = "or", columns: list[str] | None = None) -> DataFrame:
    """Union ("or") or intersection ("and") of searches, each row once; _rank puts earlier terms first."""
    columns = columns or _searched(ds)
    ranks = [keyword_rank(columns, t) for t in terms]
    width = 2 * len(columns)
    if how == "and":
        return ds.rows.withColumn("_rank", ranks[0]).filter(reduce(lambda a, b: a & b, [r.isNotNull() for r in ranks]))
    first = [r + width * i for i, r in enumerate(ranks)]
    return ds.rows.withColumn("_rank", F.least(*first) if len(first) > 1 else first[0]).filter("_rank is not null")


def ordered(found: DataFrame) -> DataFrame:
    return found.orderBy("_rank", RID)


def any_row_contains(ds: Dataset, term: str) -> bool:
    """Some value, not a column's name, contains the term."""
    held = F.lower(F.concat_ws(" ", *[text(c) for c in _searched(ds)])).contains(term.lower())
    return not ds.rows.filter(held).isEmpty()


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity, which no built-in function gives."""
    from difflib import SequenceMatcher

    return pd.Series([SequenceMatcher(None, x, y).ratio() if x is not None and y is not None else 0.0 for x, y in zip(a, b)])


def distinct_values(ds: Dataset, columns: list[str] | None = None) -> DataFrame:
    """value: each distinct value of the columns as text; of texts and fractional numbers unless columns are given."""
    fractional = {f.name for f in ds.rows.schema if f.dataType.typeName() in ("float", "double", "decimal")}
    columns = columns or [c for c in ds.columns if ds.kinds[c] == "text" or c in fractional]
    if not columns:
        return ds.rows.sparkSession.createDataFrame([], "value string")
    return ds.rows.select(F.explode(F.array(*[text(c) for c in columns])).alias("value")).filter("value is not null").distinct()


#: Values of the highest bounds whose exact scores set the bar for all others.
FIRST = 64
WHOLE, OVERLAP, NEAR, INSIDE = 0.4, 0.5, 0.6, 0.9  # the least score as a whole, by shared words, by a close word; the score of one within the other


def ratio_bound(term: str, value: Column) -> Column:
    """At least sequence_ratio(term, value): twice the characters that both have, as often as both have them, over all characters."""
    shared = [F.least(F.lit(term.count(c)), F.char_length(value) - F.char_length(F.replace(value, F.lit(c), F.lit("")))) for c in dict.fromkeys(term)]
    total = F.char_length(value) + len(term)
    return F.when(total > 0, 2.0 * reduce(lambda a, b: a + b, shared, F.lit(0)) / total).otherwise(F.lit(1.0))


def fuzzy_candidates(ds: Dataset, term: str, columns: list[str] | None = None) -> DataFrame:
    """value, low, sure, bound: distinct values that can be like the term. sure: the score that needs no comparison, if any; bound: what the score is at most.

    No Python: one value within the other, shared words, and for the rest bounds of the ratios by characters."""
    low = term.lower()
    values = distinct_values(ds, columns).withColumn("low", F.lower("value"))
    inside = F.col("low").contains(low) if len(low) >= 3 else F.lit(False)
    if len(low) > 5:
        inside = inside | F.lit(low).contains(F.col("low"))
    terms, words = F.split(F.lit(low), r"\s+"), F.split("low", r"\s+")
    overlap = F.size(F.array_intersect(terms, words)) / F.greatest(F.size(F.array_union(terms, words)), F.lit(1))
    sure = F.greatest(F.when(inside, F.lit(INSIDE)), F.when(overlap > OVERLAP, overlap))
    near = F.array_max(F.transform(F.filter(words, lambda w: F.length(w) >= 3), lambda w: (char_jaccard(F.lit(low), w) + ratio_bound(low, w)) / 2))
    whole = ratio_bound(low, F.col("low"))
    bound = F.greatest(sure, F.when(whole >= WHOLE, whole), F.when(near > NEAR, near))
    return values.withColumns({"sure": sure, "bound": bound}).filter("bound is not null")


def _scored(candidates: DataFrame, low: str) -> DataFrame:
    """value, score: candidates compared in full. Only ratios are computed in Python."""
    words = F.filter(F.split("low", r"\s+"), lambda w: F.length(w) >= 3)
    each = candidates.withColumn("whole", sequence_ratio(F.lit(low), F.col("low"))).withColumn("word", F.explode_outer(words))
    near = (char_jaccard(F.lit(low), F.col("word")) + sequence_ratio(F.lit(low), F.coalesce("word", F.lit("")))) / 2
    scored = each.withColumn("near", near).groupBy("value", "sure", "whole").agg(F.max("near").alias("near"))
    best = F.greatest("sure", F.when(F.col("whole") >= WHOLE, F.col("whole")), F.when(F.col("near") > NEAR, F.col("near")))
    return scored.select("value", best.alias("score")).filter("score is not null")


def fuzzy(ds: Dataset, term: str, k: int = 3, columns: list[str] | None = None) -> DataFrame:
    """(value, score) of the k values most like the term: close as a whole, one within the other, or with a close word.

    Distinct values are compared once; ties by value. The values of the highest bounds are compared first; then only those whose bound reaches the k-th best score of these, so
    that few values reach Python, and the result is that of comparing all.
    """
    low = term.lower()
    candidates = fuzzy_candidates(ds, term, columns)
    order = [F.desc("score"), F.asc("value")]
    first = _scored(candidates.orderBy(F.desc("bound"), "value").limit(max(k, FIRST)), low).orderBy(*order).limit(k).collect()
    bar = first[-1].score if len(first) == k else 0.0
    return _scored(candidates.filter(F.col("bound") >= bar - 1e-9), low).orderBy(*order).limit(k)
