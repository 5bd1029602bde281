"""Column helpers for operators that stay inside DataFrame functions."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = " \t\n\x0b\f\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, however often (or inside whichever lambda) body uses it.

    The optimizer may inline a projected expression into a lambda, where it would
    run for each element; a lambda's own variable can't be inlined.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """Blank-separated words of a text; none for null."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, BLANK_RUN))


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def positions(first: Column | int, last: Column) -> Column:
    """first..last, empty if last < first."""
    first = F.lit(first) if isinstance(first, int) else first
    return F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))


def row_key(*columns: str) -> Column:
    """A key of a row's values; equal rows share it."""
    return F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\x00null")) for c in columns])


def exact(name: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def find_column(df: DataFrame, name: str) -> str:
    """The column that Spark would take for this name, as df spells it. An error if there is none, or none alone."""
    sensitive = df.sparkSession.conf.get("spark.sql.caseSensitive") == "true"
    found = [c for c in df.columns if c == name] or ([] if sensitive else [c for c in df.columns if c.lower() == name.lower()])
    if len(found) != 1:
        raise ValueError(f"{'no column' if not found else 'more than one column'} {name!r} among {df.columns}")
    return found[0]


def apart(docs: DataFrame, **needed: str) -> tuple[DataFrame, dict[str, str]]:
    """The needed columns of docs by the given names, and all columns of docs by names that
    nothing else has, so that no name of theirs meets one of an operator; with those names by column. Columns are found as Spark finds them; one that isn't there is an error."""
    mark = f"c{uuid.uuid4().hex}"
    names = {c: f"{mark}_{i}" for i, c in enumerate(docs.columns)}
    own = [exact(find_column(docs, c)).alias(n) for n, c in needed.items()]
    return docs.select(*own, *[exact(c).alias(n) for c, n in names.items()]), names


def together(rows: DataFrame, names: dict[str, str], added: Iterable[str] = ()) -> DataFrame:
    """The columns that apart put aside, by their own names, and the added ones, which replace columns of the same name."""
    lowered = {a.lower() for a in added}
    return rows.select(*[F.col(n).alias(c) for c, n in names.items() if c.lower() not in lowered], *added)
