"""Registered queries of the question engine and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaestor.functions.columns import STOP_WORDS, tokens
from quaestor.models import HashingEmbedder
from quaestor.nl.grammar import structured_plan
from quaestor.operators import aggregates as A
from quaestor.operators import conversations, filters, profile, retrieval, search, temporal
from quaestor.plans import steps as step_plans
from quaestor.plans.plan import Filter, Measure, QueryPlan, Sort, compile_plan, from_dict
from quaestor.sources.file_index import FileIndex
from quaestor.sources.readers import RID, Dataset, numbered, sample
from quaestor.sources.shared import shared_dir
from quaestor.sources.split_csv import read_csv
from quaestor.operators.kept_profile import KeptProfile
from quaestor.operators.vector_index import VectorIndex
from quaestor.streaming.turns import remembered
from quaestor.streaming.windows import tumbling

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def ds(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> Dataset:
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return Dataset(df.select(*columns) if columns else df, f"{sf_dir}/{table}.parquet")


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def planned(name: str, table: str, plan: QueryPlan, sql: str):
    query(name, sql)(lambda s, d: compile_plan(plan, ds(s, d, table)))


def asked(name: str, table: str, question: str, sql: str):
    """A question; the columns of its result are those of the SQL."""

    def run(s, d):
        data = ds(s, d, table)
        plan = structured_plan(question, data)
        if plan is None:
            raise ValueError(f"not understood: {question}")
        return compile_plan(plan, data)

    query(name, sql)(run)


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    return df.select(*[F.round(f"`{f.name}`", digits).alias(f.name) if f.dataType.simpleString() == "double" else F.col(f"`{f.name}`") for f in df.schema])


# --- scans and projections

query("scan_preview", "SELECT * FROM nation ORDER BY n_nationkey LIMIT 10")(lambda s, d: sample(Dataset(s.read.parquet(f"{d}/nation.parquet").orderBy("n_nationkey")), 10))
planned("project_columns", "orders", QueryPlan("list", ("o_orderkey", "o_orderstatus", "O_TOTALPRICE", "nothing")), "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
planned("show_column_values", "part", QueryPlan("list", ("p_brand",)), "SELECT p_brand FROM part")


@query("csv_scan", "SELECT doc_id, text, lang, source, n_chars FROM documents WHERE text IS NOT NULL AND NOT contains(text, chr(13))")
def _csv(s, d):
    """All documents as CSV, with their quotes and line feeds, read back by blocks."""
    path = f"{shared_dir(s)}/csv/{uuid.uuid4().hex}"
    docs = s.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").filter(F.col("text").isNotNull() & ~F.col("text").contains("\r"))
    # Nulls are written as a text that no row has by chance, for an empty one is a value; escapes aren't escaped by NUL, which is Spark's default where quotes are doubled.
    spelled = {"nullValue": uuid.uuid4().hex, "charToEscapeQuoteEscaping": '"'}
    docs.write.csv(path, header=True, quoteAll=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, **spelled)
    return read_csv(s, path, schema=docs.schema, **spelled).drop(RID).withColumns({c: F.col(c).cast("long") for c in ("doc_id", "n_chars")})


@query(
    "column_profile",
    " UNION ALL ".join(
        f"SELECT {i} AS position, '{c}' AS \"column\", count(*) AS n_rows, count({c}) AS n_present, count(*) - count({c}) AS n_missing, count(DISTINCT {c}) AS n_distinct FROM customer"
        for i, c in enumerate(("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"))
    ),
)
def _profile(s, d):
    return profile.profile(ds(s, d, "customer"), median=False).select("position", "column", "n_rows", "n_present", "n_missing", "n_distinct")


@query(
    "kept_profile",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) AS n_rows, count({c}) AS n_present, min({c})::DOUBLE AS low, max({c})::DOUBLE AS high, round(avg({c}), 5) AS mean, round(stddev_samp({c}), 5) AS std FROM lineitem"
        for c in ("l_quantity", "l_extendedprice", "l_discount")
    ),
)
def _kept(s, d):
    """A table that grew: its first half is profiled and kept, then the whole is, by reading the rest."""
    place = f"{shared_dir(s)}/kept/{uuid.uuid4().hex}"
    lines = s.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_quantity", "l_extendedprice", "l_discount")
    half = F.col("l_orderkey") % 2 == 0
    lines.filter(half).write.parquet(place + "/table")
    profile = KeptProfile(s, place + "/table", place + "/profile")
    profile.update()
    lines.filter(~half).write.mode("append").parquet(place + "/table")
    return profile.update().filter("column != 'l_orderkey'").select("column", "n_rows", "n_present", "low", "high", F.round("mean", 5).alias("mean"), F.round("std", 5).alias("std"))


# --- filters

planned("filter_ci_equality", "customer", QueryPlan(filters=(Filter("C_MktSegment", "=", "building"),)), "SELECT * FROM customer WHERE lower(c_mktsegment) = 'building'")
query("lookup_exact_then_contains", "SELECT * FROM supplier WHERE regexp_matches(lower(s_name), '00001')")(lambda s, d: filters.lookup(ds(s, d, "supplier"), "s_name", "00001").drop(RID))
query("lookup_exact_hit", "SELECT * FROM region WHERE lower(r_name) = 'asia'")(lambda s, d: filters.lookup(ds(s, d, "region"), "r_name", "ASIA").drop(RID))
for _name, _op in (("gt", ">"), ("lt", "<"), ("eq", "="), ("ge", ">="), ("le", "<="), ("ne", "!=")):
    query(f"compare_{_name}", f"SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity {_op} 25")(
        lambda s, d, op=_op: filters.by_comparison(ds(s, d, "lineitem", "l_orderkey", "l_linenumber", "l_quantity"), "L_Quantity", op, 25).drop(RID)
    )
planned(
    "plan_filter_conjunction", "orders", QueryPlan(filters=(Filter("o_totalprice", ">=", 200000), Filter("o_orderstatus", "=", "o"), Filter("none", "=", 1), Filter("o_orderkey", "~", 1))),
    "SELECT * FROM orders WHERE o_totalprice >= 200000 AND lower(o_orderstatus) = 'o'",
)
planned("filter_contains_regex", "orders", QueryPlan("list", ("o_orderkey",), filters=(Filter("o_orderdate", "contains", "1995-0[12]"),)), "SELECT o_orderkey FROM orders WHERE regexp_matches(o_orderdate::VARCHAR, '1995-0[12]')")
planned("filter_contains_literal", "events", QueryPlan("list", ("event_id",), filters=(Filter("props", "contains", '{"k": 6'),)), "SELECT event_id FROM events WHERE contains(lower(props), '{\"k\": 6')")
planned("filter_numeric_as_text", "customer", QueryPlan("list", ("c_custkey",), filters=(Filter("c_acctbal", "contains", "99\\."),)), "SELECT c_custkey FROM customer WHERE regexp_matches(c_acctbal::VARCHAR, '99\\.')")
query("numeric_coercion", "SELECT p_partkey, try_cast(replace(p_brand, 'Brand#', '') AS DOUBLE) AS v FROM part WHERE try_cast(replace(p_brand, 'Brand#', '') AS DOUBLE) > 20")(
    lambda s, d: filters.by_comparison(Dataset(s.read.parquet(f"{d}/part.parquet").select("p_partkey", F.replace("p_brand", F.lit("Brand#"), F.lit("")).alias("v"))), "v", ">", 20).select("p_partkey", F.col("v").cast("double").alias("v"))
)
planned("filter_not_equal_text", "orders", QueryPlan("list", ("o_orderkey",), filters=(Filter("o_orderstatus", "!=", "O"),)), "SELECT o_orderkey FROM orders WHERE lower(o_orderstatus) <> 'o' OR o_orderstatus IS NULL")

# --- keyword search and set operations

_TEXTS = ("p_name", "p_brand", "p_type")
_PART = ("p_partkey", *_TEXTS)


def _hit(term: str) -> str:
    return "(" + " OR ".join(f"regexp_matches(lower({c}), '{term}')" for c in _TEXTS) + ")"


_RANK = "least(" + ", ".join(f"CASE WHEN lower({c}) = 'red' THEN {2 * i} WHEN regexp_matches(lower({c}), 'red') THEN {2 * i + 1} END" for i, c in enumerate(_TEXTS)) + ")"
_parts = lambda s, d: ds(s, d, "part", *_PART)
query("keyword_search_all_columns", f"SELECT {', '.join(_PART)} FROM part WHERE {_hit('red')}")(lambda s, d: search.search(_parts(s, d), "red", list(_TEXTS)).select(*_PART))
query("keyword_search_ranked", f"SELECT p_partkey, {_RANK} AS rank FROM part WHERE {_RANK} IS NOT NULL")(lambda s, d: search.search(_parts(s, d), "Red", list(_TEXTS)).select("p_partkey", F.col("_rank").alias("rank")))


def _parted(s, d, table: str, by: str):
    """A table in 16 files by ranges of a column, and its index."""
    path = f"{shared_dir(s)}/parted/{uuid.uuid4().hex}"
    s.read.parquet(f"{d}/{table}.parquet").repartitionByRange(16, by).write.parquet(path)
    return FileIndex.build(s, path), Dataset(s.read.parquet(path), path)


@query("indexed_search", "SELECT p_partkey, p_name FROM part WHERE " + " OR ".join(f"contains(lower({c}::VARCHAR), 'brand#12')" for c in ("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")))
def _indexed_search(s, d):
    index, parts = _parted(s, d, "part", "p_brand")
    return index.searched(parts, "Brand#12").select("p_partkey", "p_name")


@query("indexed_filters", "SELECT o_orderkey, o_totalprice FROM orders WHERE lower(o_orderpriority) = '1-urgent' AND o_totalprice > 300000 AND o_orderkey <= 4000")
def _indexed_filters(s, d):
    index, orders = _parted(s, d, "orders", "o_orderkey")
    return index.filtered(orders, [("o_orderpriority", "=", "1-URGENT"), ("o_totalprice", ">", 300000), ("o_orderkey", "<=", 4000)]).select("o_orderkey", "o_totalprice")


query("keyword_exclude", f"SELECT p_partkey FROM part WHERE NOT coalesce({_hit('red')}, false)")(lambda s, d: search.exclude(_parts(s, d), "red", list(_TEXTS)).select("p_partkey"))
query("search_or", f"SELECT p_partkey FROM part WHERE {_hit('red')} OR {_hit('small')}")(lambda s, d: search.search_terms(_parts(s, d), ["red", "small"], "or", list(_TEXTS)).select("p_partkey"))
query("search_and", f"SELECT p_partkey FROM part WHERE {_hit('red')} AND {_hit('small')}")(lambda s, d: search.search_terms(_parts(s, d), ["red", "small"], "and", list(_TEXTS)).select("p_partkey"))
query("row_semi_join", f"SELECT p_partkey FROM part WHERE {_hit('red')} AND p_size > 25")(
    lambda s, d: search.within(ds(s, d, "part"), F.col("p_size") > 25, "red", columns=list(_TEXTS)).select("p_partkey")
)
query("row_anti_join", f"SELECT p_partkey FROM part WHERE NOT {_hit('red')}")(
    lambda s, d: search.within(ds(s, d, "part"), None, "red", keep=False, columns=list(_TEXTS)).select("p_partkey")
)
def _bound(term: str, value: str) -> str:
    shared = " + ".join(f"least({term.count(c)}, length({value}) - length(replace({value}, '{c}', '')))" for c in dict.fromkeys(term))
    return f"2.0::DOUBLE * ({shared}) / (length({value}) + {len(term)})"


def _jaccard(term: str, value: str) -> str:
    mine = ", ".join(f"'{c}'" for c in dict.fromkeys(term))
    return f"len(list_intersect([{mine}], string_split({value}, '')))::DOUBLE / len(list_distinct(list_concat([{mine}], string_split({value}, ''))))"


query(
    "fuzzy_candidates",
    f"""SELECT value, round(greatest(inside, words, CASE WHEN whole >= 0.4 THEN whole END, CASE WHEN near > 0.6 THEN near END), 9) AS bound FROM (
    SELECT value, CASE WHEN contains(value, 'burnishd') OR contains('burnishd', value) THEN 0.9 END AS inside,
      CASE WHEN list_contains(w, 'burnishd') AND 1.0 / len(list_distinct(w)) > 0.5 THEN 1.0 / len(list_distinct(w)) END AS words, {_bound("burnishd", "value")} AS whole,
      list_max(list_transform(list_filter(w, lambda x: length(x) >= 3), lambda x: ({_jaccard("burnishd", "x")} + {_bound("burnishd", "x")}) / 2)) AS near
    FROM (SELECT DISTINCT lower(p_type) AS value, regexp_split_to_array(lower(p_type), '\\s+') AS w FROM part WHERE p_type IS NOT NULL)) WHERE bound IS NOT NULL""",
)(lambda s, d: search.fuzzy_candidates(ds(s, d, "part", "p_type"), "Burnishd").select(F.col("low").alias("value"), F.round("bound", 9).alias("bound")).distinct())
query("fuzzy_suggestions")(lambda s, d: search.fuzzy(ds(s, d, "customer", "c_mktsegment"), "bulding"))

# --- aggregations

_SQL_OF = {"sum": "sum({0})", "mean": "avg({0})", "median": "median({0})", "max": "max({0})", "min": "min({0})", "std": "stddev_samp({0})", "count": "count({0})"}
for _name, _sql in _SQL_OF.items():
    query(f"agg_{_name}", f"SELECT round({_sql.format('l_extendedprice')}, 2)::DOUBLE AS value FROM lineitem")(
        lambda s, d, f=_name: A.scalar(ds(s, d, "lineitem").rows, f, "l_extendedprice").select(F.round(F.col("value").cast("double"), 2).alias("value"))
    )
query("agg_text_extremes", "SELECT max(p_name) AS high, min(p_name) AS low FROM part")(lambda s, d: ds(s, d, "part").rows.agg(A.FUNCTIONS["max"](F.col("p_name")).alias("high"), A.FUNCTIONS["min"](F.col("p_name")).alias("low")))
query("agg_empty_sum_zero", "SELECT 0::DOUBLE AS value, NULL::DOUBLE AS mean")(
    lambda s, d: ds(s, d, "lineitem").rows.filter("l_quantity < 0").agg(A.FUNCTIONS["sum"](F.col("l_quantity")).cast("double").alias("value"), A.FUNCTIONS["mean"](F.col("l_quantity")).alias("mean"))
)
planned("count_records", "lineitem", QueryPlan("count"), 'SELECT count(*) AS "Count" FROM lineitem')
planned("count_filtered", "lineitem", QueryPlan("count", filters=(Filter("l_returnflag", "=", "r"),)), "SELECT count(*) AS \"Count\" FROM lineitem WHERE lower(l_returnflag) = 'r'")
planned("group_count", "orders", QueryPlan("count", groupby=("o_orderstatus",)), 'SELECT o_orderstatus, count(*) AS "Count" FROM orders WHERE o_orderstatus IS NOT NULL GROUP BY o_orderstatus')
query(
    "group_aggregate",
    "SELECT l_returnflag, round(avg(l_quantity), 6) AS l_quantity, round(median(l_extendedprice), 6) AS l_extendedprice, round(stddev_samp(l_discount), 6) AS l_discount FROM lineitem GROUP BY l_returnflag",
)(lambda s, d: rounded(compile_plan(QueryPlan("aggregate", measures=(Measure("l_quantity"), Measure("l_extendedprice", "median"), Measure("l_discount", "std")), groupby=("l_returnflag",)), ds(s, d, "lineitem")), 6))
query("group_multi_key", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS l_quantity, max(l_shipdate) AS l_shipdate FROM lineitem GROUP BY ALL")(
    lambda s, d: rounded(compile_plan(QueryPlan("aggregate", measures=(Measure("l_quantity", "sum"), Measure("l_shipdate", "max")), groupby=("l_returnflag", "l_linestatus")), ds(s, d, "lineitem")), 2)
)
query(
    "group_aggregate_ops",
    """SELECT l_linestatus, round(var_samp(l_quantity), 4) AS v, count(DISTINCT l_suppkey) AS n, count(*) AS size, round(stddev_samp(l_tax) / sqrt(count(l_tax)), 6) AS sem,
       round(skewness(l_extendedprice), 4) AS skew, bool_or(l_discount <> 0) AS some, bool_and(l_discount <> 0) AS every, round(product(1 + l_tax / 1e6), 6) AS product
       FROM lineitem GROUP BY l_linestatus""",
)(
    lambda s, d: rounded(
        A.grouped(
            ds(s, d, "lineitem").rows.withColumns({"nonzero": F.col("l_discount") != 0, "growth": 1 + F.col("l_tax") / 1e6}), ["l_linestatus"],
            {"v": ("var", "l_quantity"), "n": ("nunique", "l_suppkey"), "size": ("size", "l_suppkey"), "sem": ("sem", "l_tax"), "skew": ("skew", "l_extendedprice"), "some": ("any", "nonzero"), "every": ("all", "nonzero"), "product": ("prod", "growth")},
        ).select("l_linestatus", F.round("v", 4).alias("v"), "n", "size", F.round("sem", 6).alias("sem"), F.round("skew", 4).alias("skew"), "some", "every", F.round("product", 6).alias("product")), 6,
    )
)
query("group_first_last", "SELECT n_regionkey, arg_min(n_name, n_nationkey) AS a, arg_max(n_name, n_nationkey) AS z FROM nation GROUP BY n_regionkey")(
    lambda s, d: A.grouped(Dataset(s.read.parquet(f"{d}/nation.parquet").withColumn(RID, F.col("n_nationkey").cast("long"))).rows, ["n_regionkey"], {"a": ("first", "n_name"), "z": ("last", "n_name")})
)


def _describe_sql(table: str, column: str) -> str:
    parts = (("count", "count({0})"), ("mean", "avg({0})"), ("std", "stddev_samp({0})"), ("min", "min({0})"), ("25%", "quantile_cont({0}, 0.25)"), ("50%", "quantile_cont({0}, 0.5)"), ("75%", "quantile_cont({0}, 0.75)"), ("max", "max({0})"))
    return " UNION ALL ".join(f"SELECT '{n}' AS \"index\", round({x.format(column)}, 4)::DOUBLE AS {column} FROM {table}" for n, x in parts)


query("describe_numeric", _describe_sql("events", "value"))(lambda s, d: rounded(compile_plan(QueryPlan("summarize", ("value",)), ds(s, d, "events"))))
query(
    "describe_text",
    """SELECT 'count' AS "index", count(r_name)::VARCHAR AS r_name FROM region UNION ALL SELECT 'unique', count(DISTINCT r_name)::VARCHAR FROM region
       UNION ALL SELECT 'top', min(r_name) FROM region UNION ALL SELECT 'freq', '1'""",
)(lambda s, d: A.describe_text(Dataset(s.read.parquet(f"{d}/region.parquet").withColumn(RID, F.lit(0).cast("long"))).rows, ["r_name"]))
query("statistics_first5", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", min({c})::DOUBLE AS low, max({c})::DOUBLE AS high, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std FROM lineitem" for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")))(
    lambda s, d: rounded(profile.profile(ds(s, d, "lineitem"), distinct=False, median=False).filter("kind = 'numeric'").orderBy("position").limit(5).select("column", "low", "high", "mean", "std"))
)
query("analyze_columns", "SELECT c AS \"column\", round(lo, 4) AS low, round(hi, 4) AS high, round(m, 4) AS mean, round(md, 4) AS median, round(sd, 4) AS std FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS c, min({c})::DOUBLE AS lo, max({c})::DOUBLE AS hi, avg({c}) AS m, median({c})::DOUBLE AS md, stddev_samp({c}) AS sd FROM part WHERE lower(p_brand) = 'brand#23'" for c in ("p_size", "p_retailprice")) + ")")(
    lambda s, d: rounded(profile.analyze(ds(s, d, "part"), "p_brand", "Brand#23", ["p_size", "p_retailprice"])["statistics"])
)
query("outliers_2sigma", "SELECT event_id, value FROM events, (SELECT avg(value) AS m, stddev_samp(value) AS sd FROM events) WHERE value < m - 2 * sd OR value > m + 2 * sd")(lambda s, d: profile.outliers(ds(s, d, "events").rows, "value").select("event_id", "value"))
query("top_values", "SELECT o_orderpriority AS value, count(*) AS n FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY 1 ORDER BY n DESC, value LIMIT 3")(lambda s, d: profile.top_values(s.read.parquet(f"{d}/orders.parquet"), "o_orderpriority", 3))
query(
    "top_values_all_columns",
    " UNION ALL ".join(f"SELECT * FROM (SELECT '{c}' AS \"column\", {c} AS value, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, {c})::INT AS place FROM orders GROUP BY 2) WHERE place <= 3" for c in ("o_orderstatus", "o_orderpriority")),
)(lambda s, d: profile.top_values_of(s.read.parquet(f"{d}/orders.parquet"), ["o_orderstatus", "o_orderpriority"], 3))
query("distribution_percent", "SELECT event_type AS value, count(*) AS n, round_even(100 * count(*) / (SELECT count(*) FROM events), 1) AS percent FROM events GROUP BY 1")(lambda s, d: profile.shares(s.read.parquet(f"{d}/events.parquet"), "event_type"))
planned("distinct_values", "events", QueryPlan("distinct", ("event_type",)), "SELECT DISTINCT event_type AS value FROM events")
query("count_distinct", "SELECT count(DISTINCT user_id) AS value FROM events")(lambda s, d: A.scalar(ds(s, d, "events").rows, "nunique", "user_id"))
query("context_filtered_agg", "SELECT max(l_extendedprice)::VARCHAR AS value FROM lineitem WHERE lower(l_returnflag) = 'r'")(lambda s, d: A.coerced(filters.apply_filters(ds(s, d, "lineitem"), [("l_returnflag", "=", "R")]), "max", "l_extendedprice"))
query("context_text_agg", "SELECT max(c_mktsegment) AS value FROM customer WHERE c_nationkey = 3")(lambda s, d: A.coerced(filters.apply_filters(ds(s, d, "customer"), [("c_nationkey", "=", 3)]), "max", "c_mktsegment"))

# --- order and limits

planned("sort_limit", "orders", QueryPlan("list", ("o_orderkey", "o_totalprice"), sort=(Sort("o_totalprice", True), Sort("o_orderkey")), limit=10), "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
query("plan_from_json", "SELECT l_returnflag, round(max(l_quantity), 4) AS l_quantity FROM lineitem WHERE l_discount <> 0.05 GROUP BY 1 ORDER BY 1 DESC LIMIT 2")(
    lambda s, d: rounded(compile_plan(from_dict({"operation": "aggregate", "columns": [{"column": "L_QUANTITY", "operation": "max"}], "filters": [{"column": "l_discount", "operator": "!=", "value": 0.05}, "junk"], "groupby": ["l_returnflag"], "sort": [{"column": "l_returnflag", "order": "desc"}], "limit": 2}), ds(s, d, "lineitem")))
)
query("exact_duplicates", "SELECT md5(text) AS text_md5, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")(lambda s, d: profile.duplicates(s.read.parquet(f"{d}/documents.parquet"), "text"))

# --- steps

_STEPS = [step_plans.Step("filter", "keyword_search", ("promo",)), step_plans.Step("filter", "keyword_search_exclude", ("small",)), step_plans.Step("filter", "column_filter", column="p_size", operator=">", value=10), step_plans.Step("list")]
query("steps_narrowing", "SELECT * FROM part WHERE (contains(lower(p_name), 'promo') OR contains(lower(p_type), 'promo') OR contains(lower(p_brand), 'promo')) AND NOT (contains(lower(p_name), 'small') OR contains(lower(p_type), 'small')) AND p_size > 10")(
    lambda s, d: step_plans.execute(ds(s, d, "part"), _STEPS)
)

# --- retrieval

_COS = "list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"


def _nearest(s, d, k: int | None, least: float | None) -> DataFrame:
    vectors = s.read.parquet(f"{d}/embeddings.parquet")
    one = vectors.filter("vec_id = 0").select("embedding").head()[0]
    return retrieval.nearest(vectors, one, k, least, tie="vec_id").select("vec_id", F.round("score", 6).alias("score"))


query("vector_topk_cosine", f"SELECT e.vec_id, round({_COS}, 6) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY {_COS} DESC, e.vec_id LIMIT 5")(lambda s, d: _nearest(s, d, 5, None))
query("vector_topk_threshold", f"SELECT e.vec_id, round({_COS}, 6) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE {_COS} >= 0.3")(lambda s, d: _nearest(s, d, None, 0.3))


_EACH = (
    f"""SELECT query, vec_id, round(score, 6) AS score, place FROM (SELECT q.vec_id AS query, e.vec_id, {_COS} AS score,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY round({_COS}, 12) DESC, e.vec_id)::INT AS place FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0) WHERE place <= 5"""
)


@query("vector_topk_each", _EACH)
def _nearest_each(s, d):
    vectors = s.read.parquet(f"{d}/embeddings.parquet")
    return retrieval.nearest_each(vectors, vectors.filter("vec_id % 50 = 0"), 5).select("query", F.col("id").alias("vec_id"), F.round("score", 6).alias("score"), "place")


def _indexed(s, d, every: bool):
    vectors = s.read.parquet(f"{d}/embeddings.parquet")
    index = VectorIndex.build(vectors)
    found = index.search(vectors.filter("vec_id % 50 = 0"), 5, probes=len(index.centres) if every else None)
    return found.select("query", F.col("id").alias("vec_id"), F.round("score", 6).alias("score"), "place")


# All lists of the index hold all vectors, so looking at all gives the exact result; the lists that the index chooses give most of it (measured in tests).
query("vector_index_all_lists", _EACH)(lambda s, d: _indexed(s, d, True))
query("vector_index_each")(lambda s, d: _indexed(s, d, False))


query("row_group_chunks", "SELECT (n_nationkey // 15)::BIGINT AS g, min(n_nationkey)::VARCHAR AS start_row, max(n_nationkey)::VARCHAR AS end_row FROM nation GROUP BY 1")(
    lambda s, d: retrieval.row_groups(s.read.parquet(f"{d}/nation.parquet").withColumn(RID, F.col("n_nationkey").cast("long")), ["n_nationkey", "n_name", "n_regionkey"]).select(
        F.substring("chunk_id", 6, 20).cast("long").alias("g"), F.col("metadata")["start_row"].alias("start_row"), F.col("metadata")["end_row"].alias("end_row")
    )
)


def _counted(rows: DataFrame) -> DataFrame:
    """How many distinct row numbers there are, the least and the greatest. Numbers without gaps fill Spark's bitmaps of 32,768, so that these are shuffled and not each number."""
    blocks = rows.groupBy(F.bitmap_bucket_number(RID)).agg(F.bitmap_construct_agg(F.bitmap_bit_position(RID)).alias("met"), F.min(RID).alias("low"), F.max(RID).alias("high"))
    return blocks.agg(F.coalesce(F.sum(F.bitmap_count("met")), F.lit(0)).alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))


query("row_numbers", "SELECT count(*) AS n, min(i) AS low, max(i) AS high FROM (SELECT row_number() OVER () - 1 AS i FROM lineitem)")(
    lambda s, d: _counted(numbered(s.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey")))
)


def _about(s, d, table: str, chunks, *columns: str) -> DataFrame:
    return chunks(ds(s, d, table, *columns)).select("chunk_id", "text", "chunk_type")


def _tops_sql(table: str, column: str, key: str, k: int, entry: str, separator: str) -> str:
    """The k most frequent values of a column as one text; ties by the table's order."""
    return (
        f"(SELECT string_agg({entry}, {separator} ORDER BY n DESC, seen) FROM "
        f"(SELECT {column}::VARCHAR AS v, count(*) AS n, min({key}) AS seen FROM {table} WHERE {column} IS NOT NULL GROUP BY 1 ORDER BY n DESC, seen LIMIT {k}))"
    )


_ENTRY, _LINE = "v || ': ' || n", "E'\\n'"
query(
    "column_descriptions",
    " UNION ALL ".join(
        [
            f"SELECT 'column-{c}' AS chunk_id, printf('Column ''{c}'' (numeric): from %s to %s, mean %.2f, missing %d', min({c})::DOUBLE::VARCHAR, max({c})::DOUBLE::VARCHAR, avg({c}), count(*) - count({c})) AS text, 'column' AS chunk_type FROM customer"
            for c in ("c_custkey", "c_nationkey", "c_acctbal")
        ]
        + [
            f"SELECT 'column-{c}', printf('Column ''{c}'' (text): %d distinct values, most frequent: %s, missing %d', count(DISTINCT {c}), {_tops_sql('customer', c, 'c_custkey', 5, 'v', chr(39) + ', ' + chr(39))}, count(*) - count({c})), 'column' FROM customer"
            for c in ("c_name", "c_mktsegment")
        ]
    ),
)(lambda s, d: _about(s, d, "customer", retrieval.column_descriptions))
query(
    "stat_summary",
    " UNION ALL ".join(
        f"SELECT 'statistics-{c}' AS chunk_id, printf('Statistics of ''{c}'': minimum %s, maximum %s, mean %.2f, standard deviation %.2f, median %s', min({c})::DOUBLE::VARCHAR, max({c})::DOUBLE::VARCHAR, avg({c}), stddev_samp({c}), median({c})::DOUBLE::VARCHAR) AS text, 'statistics' AS chunk_type FROM part"
        for c in ("p_size", "p_retailprice")
    ),
)(lambda s, d: _about(s, d, "part", retrieval.statistics_chunks, "p_size", "p_retailprice", "p_brand"))
query(
    "categorical_distribution",
    f"SELECT 'distribution-event_type' AS chunk_id, 'Distribution of ''event_type'':' || chr(10) || {_tops_sql('events', 'event_type', 'event_id', 10, _ENTRY, _LINE)} AS text, 'distribution' AS chunk_type",
)(lambda s, d: _about(s, d, "events", retrieval.distribution_chunks, "event_id", "event_type", "value"))
query(
    "column_info",
    " UNION ALL ".join(
        f"SELECT {i}::INT AS position, '{c}' AS \"column\", '{t}' AS type, count({c}) AS n_present, (SELECT string_agg(v, ' / ' ORDER BY seen) FROM (SELECT {c}::VARCHAR AS v, min(c_custkey) AS seen FROM customer WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY seen LIMIT 3)) AS samples FROM customer"
        for i, (c, t) in enumerate((("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"), ("c_acctbal", "double"), ("c_mktsegment", "string")))
    ),
)(lambda s, d: profile.column_info(ds(s, d, "customer")).withColumn("samples", F.array_join("samples", " / ")))
_CHUNKED = ("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
query(
    "row_chunk_texts",
    "SELECT 'rows-' || (rn // 15) AS chunk_id, min(rn)::VARCHAR AS start_row, string_agg('Row ' || (rn + 1) || ': ' || "
    + " || ', ' || ".join(f"'{c}: ' || coalesce({c}::VARCHAR, 'null')" for c in _CHUNKED)
    + ", chr(10) ORDER BY rn) AS text FROM (SELECT *, row_number() OVER () - 1 AS rn FROM customer) GROUP BY rn // 15",
)(lambda s, d: retrieval.row_groups(numbered(s.read.parquet(f"{d}/customer.parquet").select(*_CHUNKED)), list(_CHUNKED)).select("chunk_id", F.col("metadata")["start_row"].alias("start_row"), "text"))
query(
    "chunk_kinds",
    """SELECT 'rows' AS chunk_type, ceil(count(*) / 15.0)::INT AS n FROM customer UNION ALL SELECT 'column', ((count(*) > 0)::INT * 4) FROM customer
    UNION ALL SELECT 'statistics', (count(c_custkey) > 0)::INT + (count(c_nationkey) > 0)::INT FROM customer
    UNION ALL SELECT 'distribution', (count(DISTINCT c_name) BETWEEN 1 AND 50)::INT + (count(DISTINCT c_mktsegment) BETWEEN 1 AND 50)::INT FROM customer""",
)(lambda s, d: retrieval.build_chunks(ds(s, d, "customer", *_CHUNKED)).groupBy("chunk_type").agg(F.count(F.lit(1)).cast("int").alias("n")))
query("semantic_search")(lambda s, d: retrieval.nearest(retrieval.embedded(retrieval.build_chunks(ds(s, d, "customer", *_CHUNKED)), HashingEmbedder()), HashingEmbedder().embed(["column c_name distinct values"])[0]).select("chunk_id", "score"))

# --- conversations

_TOKENS = "list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_]+'), lambda t: regexp_full_match(t, '[a-z]{2,}') AND t NOT IN (%s))"


def _tokens_sql() -> str:
    from quaestor.functions.columns import STOP_WORDS

    return _TOKENS % ", ".join(f"'{w}'" for w in STOP_WORDS)


query("tokenize_counts", f"SELECT t, count(*) AS n FROM (SELECT unnest({_tokens_sql()}) AS t FROM benchmark) GROUP BY t")(
    lambda s, d: s.read.parquet(f"{d}/benchmark.parquet").select(F.explode(tokens(F.col("text"))).alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n"))
)


@query(
    "tfidf_similarity",
    f"""WITH u AS (SELECT conv_id, turn, {_tokens_sql()} AS ts FROM conversations WHERE role = 'user'),
    n AS (SELECT count(*) AS n FROM u), t AS (SELECT conv_id, turn, len(ts) AS l, unnest(ts) AS t FROM u),
    f AS (SELECT conv_id, turn, t, count(*) / any_value(l) AS tf FROM t GROUP BY ALL), df AS (SELECT t, count(*) AS df FROM f GROUP BY t),
    w AS (SELECT conv_id, turn, t, tf * (ln((1 + n.n) / (1 + df)) + 1) AS w FROM f JOIN df USING (t), n),
    s AS (SELECT conv_id, turn, sqrt(sum(w * w)) AS s FROM w GROUP BY ALL),
    q AS (SELECT t, w FROM w WHERE conv_id = 0 AND turn = (SELECT min(turn) FROM u WHERE conv_id = 0))
    SELECT w.conv_id, w.turn, round(sum(w.w * q.w) / any_value(s.s) / (SELECT sqrt(sum(w * w)) FROM q), 6) AS score
    FROM w JOIN q USING (t) JOIN s ON s.conv_id = w.conv_id AND s.turn = w.turn GROUP BY ALL""",
)
def _tfidf(s, d):
    """Turns like the first that a user wrote in conversation 0."""
    users = s.read.parquet(f"{d}/conversations.parquet").filter("role = 'user'")
    first = users.filter("conv_id = 0").agg(F.min("turn")).head()[0]
    return conversations.similar(users, (F.col("conv_id") == 0) & (F.col("turn") == F.lit(first))).withColumn("score", F.round("score", 6))


@query("last_n_turns", "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations) WHERE k <= 2")
def _last(s, d):
    return conversations.latest(s.read.parquet(f"{d}/conversations.parquet"), 2).select("conv_id", "turn", "role")


query("turn_role_counts", "SELECT role, count(*) AS n FROM conversations GROUP BY role")(lambda s, d: conversations.counters(s.read.parquet(f"{d}/conversations.parquet"), "role"))
query(
    "mentioned_names",
    r"""SELECT entity, count(*) AS n FROM (SELECT unnest(list_concat(
      list_filter(list_concat(regexp_extract_all(t, '"([^"]+)"|''([^'']+)''', 1), regexp_extract_all(t, '"([^"]+)"|''([^'']+)''', 2)), lambda x: x != ''),
      list_filter(regexp_split_to_array(regexp_replace(b, '^\s*\S+', ''), '[^\p{L}\p{N}_]+'), lambda w: regexp_full_match(w, '[A-Z][A-Za-z0-9]+')),
      list_filter(regexp_split_to_array(b, '[^\p{L}\p{N}_]+'), lambda w: regexp_full_match(w, '[a-z0-9]+(_[a-z0-9]+)+')))) AS entity
      FROM (SELECT text AS t, regexp_replace(text, '"([^"]+)"|''([^'']+)''', ' ', 'g') AS b FROM documents)) GROUP BY 1 ORDER BY n DESC, entity LIMIT 5""",
)(lambda s, d: conversations.mentioned(s.read.parquet(f"{d}/documents.parquet"), "text"))

# --- groups of groups, filters of groups, aggregates of one's own

planned(
    "group_rollup", "lineitem", QueryPlan("aggregate", (), (Measure("l_quantity", "sum"), Measure("l_discount", "count")), groupby=("l_returnflag", "l_linestatus"), grouping="rollup"),
    "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS l_quantity, count(l_discount) AS l_discount FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
)
planned(
    "group_cube_median", "lineitem", QueryPlan("aggregate", (), (Measure("l_quantity", "median"), Measure("l_tax", "max")), groupby=("l_returnflag", "l_linestatus"), grouping="cube"),
    "SELECT l_returnflag, l_linestatus, median(l_quantity) AS l_quantity, max(l_tax) AS l_tax FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
)
planned(
    "group_having", "orders", QueryPlan("aggregate", (), (Measure("o_totalprice", "mean"),), groupby=("o_custkey",), having=(Filter("o_totalprice", ">", 300000), Filter("o_custkey", "<=", 1000))),
    "SELECT o_custkey, avg(o_totalprice) AS o_totalprice FROM orders GROUP BY o_custkey HAVING avg(o_totalprice) > 300000 AND o_custkey <= 1000",
)


@query("agg_registered", "SELECT l_returnflag, round(exp(avg(ln(l_quantity))), 6) AS l_quantity FROM lineitem GROUP BY l_returnflag")
def _registered(s, d):
    if "geometric_mean" not in A.FUNCTIONS:
        A.register("geometric_mean", lambda c: F.round(F.exp(F.avg(F.log(c))), 6))
    return compile_plan(QueryPlan("aggregate", (), (Measure("l_quantity", "geometric_mean"),), groupby=("l_returnflag",)), ds(s, d, "lineitem"))


# --- joins by time


@query(
    "asof_join",
    """SELECT e.event_id, user_id, coalesce(p.o.id, -1) AS last_id, p.o.v AS last_value FROM events e LEFT JOIN (
      SELECT a.event_id, max({'t': b.ts, 'id': b.event_id, 'v': b.value}) AS o
      FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts <= a.ts AND b.event_type = 'purchase' GROUP BY a.event_id) p USING (event_id)""",
)
def _asof(s, d):
    """Each event with its user's last purchase as of its time."""
    events = s.read.parquet(f"{d}/events.parquet")
    bought = events.filter("event_type = 'purchase'").selectExpr("user_id AS buyer", "ts AS at", "event_id AS last_id", "value AS last_value")
    return temporal.asof_join(events.select("event_id", "user_id", "ts"), bought, {"user_id": "buyer"}, ("ts", "at"), ["last_id"], 2 * 86_400).select("event_id", "user_id", F.coalesce("last_id", F.lit(-1)).cast("long").alias("last_id"), "last_value")


@query("range_join", "SELECT l_orderkey, l_linenumber, o_custkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey AND o_orderdate + INTERVAL 30 DAY <= l_shipdate AND l_shipdate < o_orderdate + INTERVAL 400 DAY")
def _ranged(s, d):
    """Lines shipped from 30 to 400 days after their order."""
    due = s.read.parquet(f"{d}/orders.parquet").selectExpr("o_orderkey", "o_custkey", "o_orderdate + INTERVAL 30 DAY AS begins", "o_orderdate + INTERVAL 400 DAY AS ends")
    return temporal.range_join(s.read.parquet(f"{d}/lineitem.parquet"), due, {"l_orderkey": "o_orderkey"}, "l_shipdate", ("begins", "ends"), 370 * 86_400).select("l_orderkey", "l_linenumber", "o_custkey")


@query(
    "similar_turns_each",
    f"""WITH d AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}_]+'), lambda x: regexp_full_match(x, '[a-z]{{2,}}') AND x NOT IN ({", ".join(f"'{w}'" for w in STOP_WORDS)})) AS ts FROM conversations),
    tf AS (SELECT conv_id, turn, t, count(*)::DOUBLE / any_value(len(ts)) AS tf FROM (SELECT conv_id, turn, ts, unnest(ts) AS t FROM d) GROUP BY ALL),
    f AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
    w AS (SELECT conv_id, turn, t, tf * (ln((1 + (SELECT count(*) FROM d)) / (1 + df)::DOUBLE) + 1) AS w FROM tf JOIN f USING (t)),
    n AS (SELECT conv_id, turn, sqrt(sum(w * w)) AS s FROM w GROUP BY ALL),
    p AS (SELECT a.conv_id, a.turn, b.conv_id AS c, b.turn AS u, sum(a.w * b.w) AS dot FROM w a JOIN w b ON a.t = b.t AND (a.conv_id, a.turn) != (b.conv_id, b.turn) GROUP BY ALL),
    r AS (SELECT p.*, dot / x.s / y.s AS score FROM p JOIN n x ON x.conv_id = p.conv_id AND x.turn = p.turn JOIN n y ON y.conv_id = c AND y.turn = u)
    SELECT conv_id, turn, place, c AS other_conv, u AS other_turn, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY round(score, 12) DESC, c, u)::INT AS place
    FROM r WHERE score > 0.3 AND score < 0.95) WHERE place <= 3""",
)
def _similar_each(s, d):
    found = conversations.similar_each(s.read.parquet(f"{d}/conversations.parquet"))
    return found.select("conv_id", "turn", "place", F.col("other.conv_id").alias("other_conv"), F.col("other.turn").alias("other_turn"), F.round("score", 6).alias("score"))


@query(
    "remembered_turns",
    """SELECT user_id AS conv_id, event_id AS turn, array_to_string(list_transform(list_filter(h, lambda x: x.ts >= ts - INTERVAL 600 MINUTE), lambda x: x.id), ',') AS remembered FROM (
    SELECT user_id, event_id, ts, list({'id': event_id, 'ts': ts}) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS h FROM events)""",
)
def _remembered(s, d):
    """Events as turns of their users: what a memory of ten turns and ten hours holds after each."""
    held = remembered(s.read.parquet(f"{d}/events.parquet"), 10, 600, "user_id", "event_id", "ts")
    return held.select("conv_id", "turn", F.array_join(F.col("remembered").cast("array<string>"), ",").alias("remembered"))


# --- questions

asked("nl_average_by", "lineitem", "What is the average l_quantity by l_returnflag?", "SELECT l_returnflag, avg(l_quantity) AS l_quantity FROM lineitem GROUP BY l_returnflag")
asked("nl_average", "lineitem", "what is the average l_quantity", "SELECT avg(l_quantity) AS l_quantity FROM lineitem")
asked("nl_where", "lineitem", "show records where l_returnflag is R", "SELECT * FROM lineitem WHERE lower(l_returnflag) = 'r'")
asked("nl_above", "customer", "customers with c_acctbal above 9000 and c_mktsegment is building", "SELECT * FROM customer WHERE c_acctbal > 9000 AND lower(c_mktsegment) = 'building'")
asked("nl_at_least", "part", "list parts where p_size is at least 49", "SELECT * FROM part WHERE p_size >= 49")
asked("nl_how_many", "orders", "how many records are there?", 'SELECT count(*) AS "Count" FROM orders')
asked("nl_count_where", "orders", "count records where o_orderstatus is O", "SELECT count(*) AS \"Count\" FROM orders WHERE lower(o_orderstatus) = 'o'")
asked("nl_count_by", "orders", "count by o_orderpriority", 'SELECT o_orderpriority, count(*) AS "Count" FROM orders GROUP BY 1')
asked("nl_unique", "events", "unique event_type", "SELECT DISTINCT event_type AS value FROM events")
asked("nl_max_where", "part", "what is the maximum p_retailprice where p_brand is Brand#23", "SELECT max(p_retailprice) AS p_retailprice FROM part WHERE lower(p_brand) = 'brand#23'")
asked("nl_top", "orders", "list the top 5 sorted by o_orderkey descending", "SELECT * FROM orders ORDER BY o_orderkey DESC LIMIT 5")
asked("nl_column", "nation", "show n_name", "SELECT n_name FROM nation")
query("nl_statistics", _describe_sql("customer", "c_acctbal"))(lambda s, d: rounded(compile_plan(structured_plan("statistics of c_acctbal", ds(s, d, "customer")), ds(s, d, "customer"))))
query("nl_steps", "SELECT * FROM part WHERE contains(lower(p_name), 'economy') OR contains(lower(p_type), 'economy') OR contains(lower(p_brand), 'economy')")(
    lambda s, d: (lambda data: step_plans.execute(data, step_plans.default_steps("show records containing economy", data.columns)))(ds(s, d, "part"))
)

# --- extension: event time

query("ext_tumbling_daily", "SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")(
    lambda s, d: tumbling(s.read.parquet(f"{d}/events.parquet")).select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))
)
asked(
    "nl_having", "orders", "average o_totalprice by o_custkey having o_totalprice above 300000",
    "SELECT o_custkey, avg(o_totalprice) AS o_totalprice FROM orders GROUP BY o_custkey HAVING avg(o_totalprice) > 300000",
)
asked("nl_having_count", "orders", "how many records by o_custkey having count at least 20", 'SELECT o_custkey, count(*) AS "Count" FROM orders GROUP BY o_custkey HAVING count(*) >= 20')
asked(
    "nl_subtotals", "lineitem", "total l_quantity by l_returnflag and l_linestatus with subtotals",
    "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS l_quantity FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
)
