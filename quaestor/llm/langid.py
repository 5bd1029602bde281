"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaestor.llm.packs import arrow_limits, batch, mixed
from quaestor.llm.storage import discard, written

ORDERS = (1, 2, 3)
BITS = 15  # hash slots: 2 ** BITS
SMOOTHING = 0.5
BLOCK = 1 << 20  # characters handled at once
#: The log-probability matrix goes to the tasks in blocks of languages of at most so many bytes, one after another.
MATRIX_BYTES = 64 << 20
COUNT_SCHEMA = "lang string, slot int, n long"
OUT_SCHEMA = "doc_id long, lang_pred string, score double"
BEST_SCHEMA = "row_id long, doc_id long, n long, lang string, best double, part double"


def held_out(doc_id):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)


_IS_LETTER: list[np.ndarray] = []


def is_letter(points: np.ndarray) -> np.ndarray:
    """Of each code point."""
    if not _IS_LETTER:
        _IS_LETTER.append(np.array([unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)]))
    return _IS_LETTER[0][points]


class Slots:
    """Hash slots of all n-grams of texts given block by block: lower case, a run of anything but letters is one break, and breaks stand around.

    The last characters of a block are carried over, so that cuts lose no n-gram and make none.
    """

    def __init__(self, bits: int = BITS):
        self.bits, self.carry, self.letters = bits, np.array([0x20], np.uint64), 0

    def add(self, text: str, last: bool) -> np.ndarray:
        points = _points(text.lower())
        letter = is_letter(points)
        self.letters += int(letter.sum())
        points = np.where(letter, points, np.uint32(0x20)).astype(np.uint64)
        if last:
            points = np.append(points, np.uint64(0x20))
        both = np.concatenate([self.carry, points])
        keep = np.concatenate([[True] * len(self.carry), (points != 0x20) | (both[len(self.carry) - 1 : -1] != 0x20)])
        both, old = both[keep], len(self.carry)
        parts, key = [], np.zeros(len(both), np.uint64)
        for n in ORDERS:
            if len(both) < n:
                break
            key = key[: len(both) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + both[n - 1 :] + np.uint64(n)
            fresh = key[max(0, old - n + 1) :]  # n-grams that end in this block
            parts.append((mixed(fresh) >> np.uint64(64 - self.bits)).astype(np.int64))
        self.carry = both[-(max(ORDERS) - 1) :]
        return np.concatenate(parts)


def slots(text: str, bits: int = BITS):
    """Arrays of hash slots of a text, block by block; none without a letter."""
    blocks = range(0, len(text), BLOCK)
    if any(is_letter(_points(text[lo : lo + BLOCK])).any() for lo in blocks):
        state = Slots(bits)
        for lo in blocks:
            yield state.add(text[lo : lo + BLOCK], lo + BLOCK >= len(text))


def train(docs: DataFrame, bits: int = BITS, smoothing: float = SMOOTHING) -> DataFrame:
    """The counts (lang, slot, n) of docs (text, lang), with slot -1 for a language's number of texts.

    Counts of all rows are summed by (lang, slot) inside each task, then by Spark with partial sums; a language has a fixed number
    of slots. Rows with null text or lang teach nothing.
    """

    def run(batches):
        for b in batches:
            sums: dict[str, np.ndarray] = {}
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                total = sums.setdefault(lang, np.zeros((1 << bits) + 1, np.int64))
                total[0] += 1
                for at in slots(text, bits):
                    if len(at) > 4096:
                        total[1:] += np.bincount(at, minlength=1 << bits)
                    else:
                        np.add.at(total, at + 1, 1)
            for lang, total in sums.items():
                at = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at - 1, pa.int32()), pa.array(total[at], pa.int64())], names=["lang", "slot", "n"])

    arrow_limits(docs.sparkSession)
    usable = docs.filter("text is not null and lang is not null").select("text", "lang")
    return written(usable.mapInArrow(run, COUNT_SCHEMA).groupBy("lang", "slot").agg(F.sum("n").alias("n")))


def matrix(counts: DataFrame, langs: list[str], bits: int = BITS, smoothing: float = SMOOTHING) -> np.ndarray:
    """Log-probabilities by (slot, language); a last row holds the log-priors, the shares of texts."""
    texts = counts.filter("slot = -1").agg(F.sum("n")).head()[0] or 1
    total, prior = np.full((1 << bits, len(langs)), smoothing), np.ones(len(langs))
    table = counts.filter(F.col("lang").isin(langs)).toArrow()
    column = {lang: i for i, lang in enumerate(langs)}
    for lang, slot, n in zip(*(table.column(c).to_pylist() for c in ("lang", "slot", "n"))):
        if slot < 0:
            prior[column[lang]] = n
        else:
            total[slot, column[lang]] += n
    return np.concatenate([np.log(total / total.sum(axis=0)), np.log(prior / texts)[None]]).astype(np.float32)


def scores(texts: list[str], logp: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(log-probability of each text and language, n-grams of each text): all texts of a batch are one sparse matrix of
    (text, slot, count), multiplied with the log-probabilities block by block."""
    out, n = np.zeros((len(texts), logp.shape[1])), np.zeros(len(texts), np.int64)
    waiting, owners, size = [], [], 0

    def flush():
        nonlocal waiting, owners, size
        if not waiting:
            return
        at, owner = np.concatenate(waiting), np.repeat(owners, [len(x) for x in waiting])
        begins = np.flatnonzero(np.diff(owner, prepend=-1))
        out[owner[begins]] += np.add.reduceat(logp[at], begins, axis=0, dtype=np.float64)
        waiting, owners, size = [], [], 0

    for k, text in enumerate(texts):
        for at in slots(text, bits):
            n[k] += len(at)
            if owners and owners[-1] == k:
                flush()  # a text of several blocks: each is added on its own
            waiting.append(at)
            owners.append(k)
            size += len(at) * logp.shape[1]
            if size > 1 << 22:
                flush()
    flush()
    return out + logp[-1], n


def predict(docs: DataFrame, counts: DataFrame, bits: int = BITS, smoothing: float = SMOOTHING) -> DataFrame:
    """doc_id, lang_pred, score of each row of docs (doc_id, text), from what train counted.

    lang_pred: the language most probable given the text, by its share of training texts and its n-grams, the first by name on ties;
    ``und`` with score 0 for null texts, texts without a letter, and if nothing was learned. score: its share of probability at the mean
    log-probability of a tenth of the n-grams, which keeps short and long texts comparable. Each block of languages gives every
    text its best and the sum of the others, and those are merged, so that any number of languages is told apart.

    Null doc_id and repeated rows pass row by row. Other columns aren't read.
    """
    langs = sorted(r.lang for r in counts.select("lang").distinct().collect())
    per_block = max(1, MATRIX_BYTES // (4 << bits))
    blocks = [langs[lo : lo + per_block] for lo in range(0, len(langs), per_block)] or [[]]

    def of_block(rows: DataFrame, names: list[str]) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast(matrix(counts, names, bits, smoothing))

        def run(batches):
            for b in batches:
                texts = [t or "" for t in b.column(2).to_pylist()]
                total, n = scores(texts, shared.value, bits) if names else (np.zeros((len(texts), 1)), np.zeros(len(texts), int))
                best = total.argmax(axis=1)
                top = total[np.arange(len(texts)), best]
                part = np.exp((total - top[:, None]) / np.maximum(1.0, n / 10)[:, None]).sum(axis=1)
                rows = zip(b.column(0).to_pylist(), b.column(1).to_pylist(), n.tolist(), best, top.tolist(), part.tolist())
                yield batch(BEST_SCHEMA, [(r, i, k, names[j] if k and names else None, t, p) for r, i, k, j, t, p in rows])

        return rows.mapInArrow(run, BEST_SCHEMA)

    arrow_limits(docs.sparkSession)
    rows = docs.select(F.lit(None).cast("long").alias("row_id"), F.col("doc_id").cast("long"), "text")
    if len(blocks) > 1:
        rows = written(rows.withColumn("row_id", F.monotonically_increasing_id()))
    found = of_block(rows, blocks[0])
    for names in blocks[1:]:
        found = found.union(of_block(rows, names))
    if len(blocks) > 1:
        # The best of all blocks, and each block's part brought to it.
        found = found.groupBy("row_id").agg(
            F.first("doc_id").alias("doc_id"), F.first("n").alias("n"), F.max("best").alias("top"),
            F.min(F.struct(-F.col("best"), "lang"))["lang"].alias("lang"), F.collect_list(F.struct("best", "part")).alias("parts"),
        )
        scaled = F.aggregate("parts", F.lit(0.0), lambda acc, x: acc + x["part"] * F.exp((x["best"] - F.col("top")) / F.greatest(F.lit(1.0), F.col("n") / 10)))
        found = found.withColumn("part", scaled)
    score = F.when(F.col("lang").isNull(), F.lit(0.0)).otherwise(1 / F.col("part"))
    return found.select("doc_id", F.coalesce("lang", F.lit("und")).alias("lang_pred"), score.alias("score"))


def op4_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    counts = train(docs.filter(~held_out(F.col("doc_id"))))
    out = predict(docs, counts)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
