"""Column expressions that all operators share."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def col(name: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def text(name: str) -> Column:
    return col(name).cast("string")


def number(name: str, numeric: bool = True) -> Column:
    """Lenient: null where the text is no number. numeric: whether the column's type is that of a number or a text; other types are read as texts."""
    return (col(name) if numeric else text(name)).try_cast("double")


def is_numeric(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def is_text_like(kind: T.DataType) -> bool:
    return not isinstance(kind, (T.ArrayType, T.MapType, T.StructType, T.BinaryType))


def date_like(value: Column) -> Column:
    """A text that begins with year, month and day, between dashes or slashes."""
    return value.rlike(r"^\d{4}[-/]\d{1,2}[-/]\d{1,2}")


def equals_ci(name: str, value: object) -> Column:
    return F.lower(text(name)) == str(value).lower()


def safe_pattern(pattern: str) -> str | None:
    """The pattern if it is a regular expression that Java takes too, else None."""
    try:
        re.compile(pattern)
    except re.error:
        return None
    # Python reads these otherwise than Java: named groups, conditions, the end, and a brace that bounds no repetition.
    return None if re.search(r"\(\?P|\(\?\(|\\Z|(?<!\\)\{(?!\d+(?:,\d*)?\})", pattern) else pattern


def contains_ci(name: str, value: object) -> Column:
    """Lowered text matches the pattern; a value that is no pattern is looked for as it stands."""
    pattern = safe_pattern(str(value).lower())
    lowered = F.lower(text(name))
    return lowered.rlike(pattern) if pattern is not None else lowered.contains(str(value).lower())


def cosine(a: Column, b: Column) -> Column:
    """Of two arrays; a zero norm counts as 1e-10."""
    add = lambda acc, x: acc + x
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), add)
    norm = lambda v: F.sqrt(F.aggregate(F.transform(v, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), add))
    size = norm(a) * norm(b)
    return dot / F.when(size == 0, F.lit(1e-10)).otherwise(size)


# Words that carry no topic. Similarities of questions depend on exactly these.
STOP_WORDS = (
    "a an the and or but is are was were in on at to for of with by from as i me my we our you your it its be been being have has had do does did "
    "will would shall should may might can could not no nor so yet both either neither what which who whom this that these those"
).split()


def tokens(value: Column) -> Column:
    """Words of two or more ASCII letters in a text, lowered, without stop words; letters beyond ASCII end no word but bar it."""
    parts = F.split(F.lower(F.coalesce(value, F.lit(""))), r"[^\p{L}\p{N}_]+")
    return F.filter(parts, lambda t: t.rlike(r"^[a-z]{2,}$") & ~t.isin(*STOP_WORDS))


def names_in(value: Column) -> Column:
    """Names in a text: quoted texts, capitalised words after the first word, and names with underscores; in that order, repeats stay."""
    value = F.coalesce(value, F.lit(""))
    quotes = r"\"([^\"]+)\"|'([^']+)'"
    quoted = F.filter(F.concat(*[F.regexp_extract_all(value, F.lit(quotes), F.lit(i)) for i in (1, 2)]), lambda x: x != "")
    bare = F.regexp_replace(value, quotes, " ")
    later = F.regexp_replace(bare, r"^\s*\S+", "")
    words = lambda v: F.split(v, r"[^\p{L}\p{N}_]+")
    named = F.filter(words(later), lambda w: w.rlike(r"^[A-Z][A-Za-z0-9]+$"))
    joined = F.filter(words(bare), lambda w: w.rlike(r"^[a-z0-9]+(_[a-z0-9]+)+$"))
    return F.concat(quoted, named, joined)


def char_jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two texts' sets of characters, lowered; 0 for two empty ones."""
    chars = lambda c: F.array_remove(F.array_distinct(F.split(F.lower(c), "")), "")
    union = F.size(F.array_union(chars(a), chars(b)))
    return F.when(union > 0, F.size(F.array_intersect(chars(a), chars(b))) / union).otherwise(F.lit(0.0))


def labelled_row(columns: list[str], separator: str = ", ") -> Column:
    """``name: value`` of each column, nulls as ``null``."""
    return F.concat_ws(separator, *[F.concat(F.lit(f"{c}: "), F.coalesce(text(c), F.lit("null"))) for c in columns])
