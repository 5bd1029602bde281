"""Quality rules: a threshold table compiled into one projection."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaestor.llm.native import BLANKS, apart, ascii_lower, let, positions, together, words

SYMBOLS = "#*$%&|<>"
#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the be to of and that have with is in it for on as this by an or are was "
    "de la le les et des un une du en que qui dans pour par sur est au ou ne "
    "der die das und den von zu mit sich auf ist im ein eine nicht dem als "
    "el los las y por con para su del se al lo no es una"
).split()


@dataclass(frozen=True)
class Rule:
    """A measure must lie in [low, high]; None leaves a side open."""

    measure: str
    low: float | None = None
    high: float | None = None


#: Shares are per word, but for line shares, which are per line with a word.
RULES = (
    Rule("mean_word_chars", 3.0, 12.0),
    Rule("symbol_share", None, 0.1),
    Rule("letter_word_share", 0.7, None),
    Rule("stop_word_share", 0.01, None),
    Rule("dup_line_share", None, 0.4),
    Rule("ellipsis_line_share", None, 0.3),
)


def _repeat_words(tokens: Column) -> Column:
    """Words in 3-word windows that stand twice or more in the text.

    Windows are compared by 64-bit hash: sorted with their positions, equal ones are neighbours.
    """

    def covered(at: Column) -> Column:
        return F.size(F.array_distinct(F.concat(at, F.transform(at, lambda p: p + 1), F.transform(at, lambda p: p + 2))))

    def sorted_pairs(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return let(pairs, lambda s: let(_doubled(s), covered))

    def _doubled(s: Column) -> Column:
        same = lambda i, j: F.get(s, i)["h"] == F.get(s, j)["h"]
        hit = F.filter(s, lambda x, i: F.coalesce(same(i, i - 1), F.lit(False)) | F.coalesce(same(i, i + 1), F.lit(False)))
        return F.transform(hit, lambda x: x["i"])

    def from_hashes(hashes: Column) -> Column:
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(sorted_pairs(hashes))

    def from_words(w: Column) -> Column:
        windows = F.transform(positions(1, F.size(w) - 2), lambda i: F.xxhash64(F.get(w, i - 1), F.get(w, i), F.get(w, i + 1)))
        return let(windows, from_hashes)

    return let(tokens, from_words)


def measures(text: Column) -> dict[str, Column]:
    """Counts of one text by name, and the shares that rules refer to."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    counts = let(
        words(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            _repeat_words(w).cast("long").alias("n_repeat_words"),
            F.size(F.filter(w, lambda x: F.btrim(ascii_lower(x), F.lit(".,;:!?\"'()")).isin(*STOP_WORDS))).alias("n_stop"),
            F.size(F.filter(w, lambda x: x.rlike(r"\p{L}"))).alias("n_letter"),
        ),
    )
    by_line = let(
        lines,
        lambda x: F.struct(
            F.size(x).alias("n_lines"),
            (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            F.size(F.filter(x, lambda y: F.rtrim(y).endswith("...") | F.rtrim(y).endswith("…"))).alias("n_ellipsis"),
        ),
    )
    return {
        "_w": counts,
        "_l": by_line,
        "word_chars": F.length(F.translate(text, BLANKS, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
    }


def _shares() -> dict[str, Column]:
    per_word = lambda c: F.when(F.col("n_words") > 0, F.col(c) / F.col("n_words")).otherwise(F.lit(0.0))
    per_line = lambda c: F.when(F.col("_l.n_lines") > 0, F.col(c) / F.col("_l.n_lines")).otherwise(F.lit(0.0))
    return {
        "mean_word_chars": per_word("word_chars"),
        "symbol_share": per_word("n_symbols"),
        "letter_word_share": per_word("_w.n_letter"),
        "stop_word_share": per_word("_w.n_stop"),
        "dup_line_share": per_line("n_dup_lines"),
        "ellipsis_line_share": per_line("_l.n_ellipsis"),
    }


def compile_rules(rules: tuple[Rule, ...], shares: dict[str, Column]) -> Column:
    """One boolean: every rule holds."""
    passed = F.lit(True)
    for rule in rules:
        value = shares[rule.measure]
        if rule.low is not None:
            passed = passed & (value >= rule.low)
        if rule.high is not None:
            passed = passed & (value <= rule.high)
    return passed


def quality(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, min_words: int = 50) -> DataFrame:
    """docs with their measures and ``kept``; one projection, no shuffle.

    A null or blank text has zero counts and fails the base rule. Any number of
    rows, repeated rows and nulls in other columns pass through row by row. Columns
    of docs that have the name of an added column are replaced by it.
    """
    rows, names = apart(docs, text=text)
    out = rows.withColumns(measures(F.col("text")))
    out = out.withColumns({c: F.col(f"_w.{c}") for c in ("n_words", "n_repeat_words")} | {"n_dup_lines": F.col("_l.n_dup_lines")})
    out = out.withColumns(
        {
            "base_failed": (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
            "_rules": compile_rules(rules, _shares()),
        }
    )
    return together(out.withColumn("kept", ~F.col("base_failed") & F.col("_rules")), names, COLUMNS)


COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return quality(docs).select("doc_id", *COLUMNS)


_STOP_SQL = ", ".join(f"'{w}'" for w in STOP_WORDS)
_LOWER_SQL = "translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL = rf"""
WITH base AS (
  SELECT *, row_number() OVER () AS rid, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
wins AS (
  SELECT rid, i, w[i] || ' ' || w[i+1] || ' ' || w[i+2] AS g
  FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM base)),
doubled AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM wins) WHERE c > 1),
repeats AS (SELECT rid, count(DISTINCT i + d) AS n FROM doubled, (VALUES (0), (1), (2)) AS o(d) GROUP BY rid),
counted AS (
  SELECT doc_id, len(w) AS n_words,
    length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    len(l) - len(list_distinct(l)) AS n_dup_lines,
    coalesce(n, 0) AS n_repeat_words, len(l) AS n_lines,
    len(list_filter(w, lambda x: trim({_LOWER_SQL.format(x='x')}, '.,;:!?"''()') IN ({_STOP_SQL}))) AS n_stop,
    len(list_filter(w, lambda x: regexp_matches(x, '\p{{L}}'))) AS n_letter,
    len(list_filter(l, lambda x: rtrim(x) LIKE '%...' OR rtrim(x) LIKE '%…')) AS n_ellipsis
  FROM base LEFT JOIN repeats USING (rid)),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT base_failed AND word_chars / n_words BETWEEN 3.0 AND 12.0 AND n_symbols / n_words <= 0.1
    AND n_letter / n_words >= 0.7 AND n_stop / n_words >= 0.01
    AND n_dup_lines / n_lines <= 0.4 AND n_ellipsis / n_lines <= 0.3 AS kept
FROM judged
"""
