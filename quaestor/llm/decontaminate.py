"""Benchmark decontamination by winnowing, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaestor.llm.native import apart, ascii_lower, let, positions, row_key, together
from quaestor.llm.storage import written

#: All but ASCII letters, ASCII digits and non-ASCII characters separates words.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW, GRAM = 10, 5
ADDED = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
#: A benchmark of more fingerprints or windows than this is joined by shuffle instead of broadcast.
BROADCAST_ROWS = 500_000


def _words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SEPARATORS), lambda w: w != "")


def _hashes(w: Column) -> Column:
    """Of each word in lower case. Words that agree but for ASCII case agree here, so that nothing is missed; windows are compared exactly later."""
    return F.transform(w, lambda x: F.xxhash64(F.lower(x)))


def _grams(h: Column, n: int) -> Column:
    return F.transform(positions(0, F.size(h) - n), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(n)]))


def _fingerprints(w: Column, window: int, gram: int, short: list[int]) -> Column:
    """Structs (start, run, m, h): the windows of m words from start to start + run - 1 have h as their least gram hash.

    Winnowing: each window of ``window`` words keeps the least hash of its grams;
    neighbouring windows that keep the same one make one entry. Lengths in
    ``short`` (of items shorter than a window) keep the hash of all their words.
    """

    def runs(low: Column) -> Column:
        begins = F.filter(positions(0, F.size(low) - 1), lambda s: (s == 0) | (F.get(low, s) != F.get(low, s - 1)))

        def entries(at: Column) -> Column:
            return F.transform(
                at,
                lambda s, i: F.struct(
                    s.alias("start"),
                    (F.coalesce(F.get(at, i + 1), F.size(low)) - s).alias("run"),
                    F.lit(window).alias("m"),
                    F.get(low, s).alias("h"),
                ),
            )

        return let(begins, entries)

    def least(g: Column) -> Column:
        span = window - gram + 1
        return F.transform(positions(0, F.size(g) - span), lambda s: F.least(*[F.get(g, s + j) for j in range(span)]))

    def whole(h: Column, n: int) -> Column:
        return F.transform(
            _grams(h, n), lambda x, i: F.struct(i.alias("start"), F.lit(1).alias("run"), F.lit(n).alias("m"), x.alias("h"))
        )

    return let(_hashes(w), lambda h: F.concat(let(let(_grams(h, gram), least), runs), *[whole(h, n) for n in short]))


def _window_text(w: Column, start: Column, m: Column) -> Column:
    return ascii_lower(F.concat_ws(" ", F.slice(w, start + 1, m)))


def _small(table: DataFrame) -> bool:
    """Whether a written table may be broadcast."""
    return table.count() <= BROADCAST_ROWS


def find_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """(hits, items): hits has _k, doc_id, start, m, content for each window of an item in a document (doc_id, text, _k); items has content, item_id.

    Fingerprints of a benchmark of bounded size are broadcast, and a place that meets one takes its words along. Those of a larger one are
    joined by shuffle, with keys and places only; words are fetched for the places that met.
    """
    items = benchmark.select("item_id", _words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    items = items.withColumn("m", F.least(F.size("w"), F.lit(window)))
    short = sorted(r.m for r in items.filter(F.col("m") < window).select("m").distinct().collect())  # fewer than window values
    cut = items.withColumn("start", F.explode(positions(0, F.size("w") - F.col("m"))))
    of_item = written(cut.select("item_id", _window_text(F.col("w"), F.col("start"), F.col("m")).alias("content")).distinct())
    contents = written(of_item.select("content").distinct())
    keys = items.select("w", "m", F.explode(_fingerprints(F.col("w"), window, gram, short)).alias("f"))
    keys = written(keys.filter(F.col("f.m") == F.col("m")).select(F.col("m").alias("_m"), F.col("f.h").alias("_h")).distinct())

    words = docs.select("doc_id", "_k", _words(F.col("text")).alias("w"))
    prints = words.select("*", F.explode(_fingerprints(F.col("w"), window, gram, short)).alias("f"))
    place = ["_k", "doc_id", F.col("f.start").alias("s"), F.col("f.run").alias("run"), F.col("f.m").alias("m")]
    near = F.slice("w", F.col("s") + 1, F.col("run") + F.col("m") - 1).alias("near")
    if _small(keys):
        met = (F.col("f.m") == F.col("_m")) & (F.col("f.h") == F.col("_h"))
        anchors = prints.join(F.broadcast(keys), met).select(*place, "w").select("_k", "doc_id", "s", "run", "m", near)
    else:
        spots = prints.select(*place, F.col("f.h").alias("h"))
        spots = written(spots.join(keys, (F.col("m") == F.col("_m")) & (F.col("h") == F.col("_h"))).select("_k", "doc_id", "s", "run", "m").distinct())
        own = words.select("w", F.col("_k").alias("_of"), F.col("doc_id").alias("_id"))
        anchors = spots.join(own, (F.col("_k") == F.col("_of")) & F.col("doc_id").eqNullSafe(F.col("_id"))).select("_k", "doc_id", "s", "run", "m", near).distinct()
    wide = anchors.withColumn("j", F.explode(positions(0, F.col("run") - 1)))
    wide = wide.select("_k", "doc_id", (F.col("s") + F.col("j")).alias("start"), "m", _window_text(F.col("near"), F.col("j"), F.col("m")).alias("content"))
    return written(wide.join(F.broadcast(contents) if _small(contents) else contents, "content").distinct()), of_item


def _covered(spans: Column) -> Column:
    """Words in the union of sorted (start, end) spans."""
    first = F.struct(F.lit(0).alias("last"), F.lit(0).cast("long").alias("n"))

    def step(acc: Column, x: Column) -> Column:
        fresh = F.greatest(F.lit(0), x["end"] - F.greatest(acc["last"], x["start"]))
        return F.struct(F.greatest(acc["last"], x["end"]).alias("last"), (acc["n"] + fresh).alias("n"))

    return F.aggregate(spans, first, step, lambda acc: acc["n"])


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """docs with n_words, n_hit, n_items, items_sha256 and contaminated.

    A window of ``window`` item words (an item of fewer is one window) makes every word of any of its
    occurrences in a document hit. Every shared span of window words is found: both sides keep
    the same least gram of it, the join on those leaves a few places, and the windows there are compared word by word.

    Null or wordless text: no words, nothing hit; null or wordless item: no window. Items without an id make words hit but
    aren't listed. Rows with equal doc_id and text get equal results. Columns of docs with names of added ones are replaced.
    """
    rows, names = apart(docs, doc_id="doc_id", text="text")
    rows = rows.withColumn("_k", row_key("doc_id", "text"))
    hits, of_item = find_hits(rows, benchmark, window, gram)
    spans = hits.groupBy("_k", "doc_id").agg(_covered(F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("m")).alias("end"))))).alias("_hit"))
    found = hits.select("_k", "doc_id", "content").distinct().join(of_item, "content").filter(F.col("item_id").isNotNull())
    listed = found.groupBy("_k", "doc_id").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("_items"))
    same = lambda a, b: (a["_k"] == b["_k"]) & a["doc_id"].eqNullSafe(b["doc_id"])
    marked = spans.join(listed, same(spans, listed), "left").select(spans["_k"].alias("_of"), spans["doc_id"].alias("_id"), "_hit", "_items")
    keyed = rows.withColumn("n_words", F.size(_words(F.col("text"))).cast("long")).drop("text")
    out = keyed.join(marked, (F.col("_k") == F.col("_of")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    ids = F.coalesce(F.col("_items"), F.array().cast("array<string>"))
    out = out.withColumns(
        {
            "n_hit": F.coalesce(F.col("_hit"), F.lit(0)).cast("long"),
            "n_items": F.size(ids).cast("long"),
            "items_sha256": F.sha2(F.concat_ws(",", ids), 256),
        }
    )
    return together(out.withColumn("contaminated", F.col("n_hit") > 0), names, ADDED)


def op5_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return contamination(docs, benchmark).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


_WORDS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS_SQL} AS w FROM documents),
b AS (SELECT item_id, {_WORDS_SQL} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, m, array_to_string(w[s:s + m - 1], ' ') AS g
       FROM (SELECT item_id, w, least(len(w), 10) AS m, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS s FROM b WHERE len(w) > 0)),
dw AS (SELECT rid, m, s, array_to_string(w[s:s + m - 1], ' ') AS g
       FROM (SELECT rid, w, m, unnest(range(1, len(w) - m + 2)) AS s FROM d, (SELECT DISTINCT m FROM bw) WHERE len(w) >= m)),
hit AS (SELECT DISTINCT rid, s, dw.m AS m, item_id FROM dw JOIN bw USING (g)),
nh AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT DISTINCT rid, unnest(range(s, s + m)) AS p FROM hit) GROUP BY rid),
it AS (SELECT rid, count(*) AS n, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT rid, item_id::VARCHAR AS i FROM hit WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(nh.n, 0)::BIGINT AS n_hit, coalesce(it.n, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(nh.n, 0) > 0 AS contaminated
FROM d LEFT JOIN nh USING (rid) LEFT JOIN it USING (rid)
"""
