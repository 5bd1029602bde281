"""LM scoring: a hashed maximum-entropy model with a class-factored softmax, under exact counts of n-grams.

log P(text) = sum over tokens of log P(token | context). The maximum-entropy model gives
P(class | context) * P(slot | class, context) * P(token | class, slot). Frequent words have classes by their training frequency, and slots
by their rank in the class; rarer ones have classes by their shape and slots by their hash. Class and slot are softmaxes over weights
of hashed features of the context: the last word, the last two words, and the second last alone (a skip). A token's share of its slot
is its smoothed share of the slot's training tokens.

Weights are learnt in rounds over all training rows. A round's gradient is what the rows hold of each (feature, class)
less what the model expects of it; both are whole numbers (expectations in units of 2 ** -16), summed by Spark in a tree, so the result
doesn't depend on how rows are dealt, but for the last digits of single-precision sums. The step is log(observed / expected) over the number of features that are on at once.

On that prior stand the counts of each word after the last one and after the last two, of the whole corpus (``given``); they grow with
the input and lie in partitioned tables.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaestor.llm.packs import (
    NULL_ID, SENT_SCHEMA, Channel, Layout, Words, batch, combine_counts, each_pack, exchange, grouped, mixed, packed, replied, send, squeeze, squeeze_counts, unsqueeze, unsqueeze_counts,
    with_replies, words_of,
)
from quaestor.llm.storage import discard, release, written

FREQUENT_CLASSES, SHAPES = 16, 15
CLASSES = FREQUENT_CLASSES + SHAPES + 1
END_CLASS = CLASSES - 1
SLOTS = 16
FEATURES = 3
FEATURE_BITS = 14
#: A word is frequent if it is at least this share of all training tokens (so there are at most 65,536), and occurs so often.
FREQUENT_SHARE, FREQUENT_COUNT = 1 / 65_536, 16
SMOOTHING = 0.1
ROUNDS = 2
BLOCK, GROUP = 1 << 10, 1 << 16  # tokens whose softmax is taken at once, and whose expectations are summed at once
UNIT = 1 << 16  # of expectations
DAMPING = 2.0  # tokens of the smaller model that each observed and expected number is smoothed by
PARTS = 16  # of the sums that are merged apart
FAN_IN = 6  # log2 of the tasks whose sums are merged at once
SUM_SCHEMA = "part int, task int, data binary"
SLOT_SUM_SCHEMA = "shape int, slot int, n long, v long"
FREQUENT_SCHEMA = "key long, n long, shape int"
OUT_SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
END_HASH, START = np.uint64(0xE2D), np.uint64(0x57A)
PAIR_BITS = 56  # of the keys of two and of three words: of 10**12 distinct ones, one in 70,000 shares its key with another
#: What the prior may count for beside the counts after the last word, and after the last two; which of them, all training rows tell.
STRENGTHS = ((32.0, 128.0, 512.0, 2048.0, 8192.0), (0.5, 2.0, 8.0, 32.0))
#: What a pack's documents amount to under each pair of strengths (scores), and in a row of its own what its training tokens do (bits, n_trained).
SCORED_SCHEMA = OUT_SCHEMA.replace("score double", "scores array<double>").replace("base_scores array<double>", "base_score double") + ", bits array<long>, n_trained long"
RUN, RUNS = 8, 1 << 12  # tokens of a text whose P are multiplied before a logarithm is taken, and such runs that are looked at at once
LEAST = 1e-37  # that RUN probabilities may be multiplied from
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def _held_out(ids: np.ndarray) -> np.ndarray:
    import zlib

    return np.array([zlib.crc32(b"" if i == NULL_ID else str(i).encode()) % 10 == 0 for i in ids.tolist()], bool)


def _shapes(w: Words) -> np.ndarray:
    """Shape of each word: 5 endings x (short, long, with characters beyond ASCII)."""
    last, length = w.data[w.end - 1], w.end - w.start
    ending = np.select([last == 46, last == 44, length == 1, (last < 48) | (last > 57) & (last < 97) | (last > 122) & (last < 128)], [1, 2, 3, 4], 0)
    high = np.concatenate([[0], np.cumsum(w.data > 127)])
    return (ending * 3 + np.where(high[w.end] > high[w.start], 2, length >= 8)).astype(np.int32)


@dataclass
class Tokens:
    """All tokens of a pack, each document's words and then its end: hash, shape (SHAPES for the end), document, training or not."""

    hash: np.ndarray
    shape: np.ndarray
    doc: np.ndarray
    trains: np.ndarray
    first: np.ndarray  # each document's first token
    words: Words

    def before(self, k: int) -> np.ndarray:
        """Hash of the k-th token before each one; START before the document's first."""
        out = np.full(len(self.hash), START)
        if len(self.hash) > k:
            out[k:] = np.where(self.doc[k:] == self.doc[:-k], self.hash[:-k], START)
        return out


def tokens_of(row: dict) -> Tokens:
    w = words_of(row, lower=True)
    n, docs = len(w.hash), len(w.ids)
    at = np.arange(n) + w.doc
    hashes, shape, doc = np.full(n + docs, END_HASH), np.full(n + docs, SHAPES, np.int32), np.empty(n + docs, np.int32)
    hashes[at], shape[at], doc[at] = w.hash, _shapes(w), w.doc
    doc[w.first[1:] + np.arange(docs)] = np.arange(docs)
    return Tokens(hashes, shape, doc, ~_held_out(w.ids)[doc], w.first[:-1] + np.arange(docs), w)


# --- counts ----------------------------------------------------------------------------------------------------------


def _pair_keys(t: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """Keys of each token with the one before, and with the two before."""
    one, two = t.before(1), t.before(2)
    with np.errstate(over="ignore"):
        pair = mixed(mixed(one * _GOLD + np.uint64(21)) + t.hash)
        triple = mixed(mixed(two * _GOLD + np.uint64(22)) + pair)
    shift = np.uint64(64 - PAIR_BITS)
    return pair >> shift, triple >> shift


def _distinct(t: Tokens):
    """(keys, place, training count, shape) of the distinct tokens of a pack."""
    keys, first, place = np.unique(t.hash, return_index=True, return_inverse=True)
    counts = np.bincount(place, weights=t.trains, minlength=len(keys)).astype(np.int64)
    return keys, place, counts, t.shape[first]


def _slot_of(keys: np.ndarray) -> np.ndarray:
    """Slot of a word that isn't frequent."""
    return (keys % np.uint64(SLOTS)).astype(np.int64)


def send_counts(row: dict, layout: Layout):
    """Distinct words, pairs and triples with their training counts."""
    t = tokens_of(row)
    keys, _, counts, shape = _distinct(t)
    coded = counts.astype(np.uint64) << np.uint64(4) | shape.astype(np.uint64)
    yield from send(row["pack"], keys, coded, layout, WORDS)
    for k, found in enumerate(_pair_keys(t)):
        # The lowest bit says whether the token counts; equal keys are neighbours in any case.
        both = np.sort(found << np.uint64(1) | t.trains.astype(np.uint64))
        begins = np.flatnonzero(np.concatenate([[True], both[1:] >> np.uint64(1) != both[:-1] >> np.uint64(1)])) if len(both) else np.empty(0, np.int64)
        n = np.add.reduceat(both & np.uint64(1), begins) if len(both) else np.empty(0, np.uint64)
        yield from send(row["pack"], both[begins] >> np.uint64(1), n, layout, PAIRS, k + 1)


def _combine_words(keys, coded):
    order, begins, group = grouped(keys)
    total = np.add.reduceat((coded >> np.uint64(4))[order], begins)
    return keys[order][begins], total << np.uint64(4) | coded[order][begins] & np.uint64(15), group


def _counts_of_words(keys, coded):
    """The counts, and a summary: tokens and distinct words of each shape and slot, and the words that may be frequent."""
    total, shape = (coded >> np.uint64(4)).astype(np.int64), (coded & np.uint64(15)).astype(np.int64)
    cell = shape * SLOTS + _slot_of(keys)
    n = np.bincount(cell, weights=total, minlength=16 * SLOTS).astype(np.int64)
    v = np.bincount(cell, weights=total > 0, minlength=16 * SLOTS).astype(np.int64)
    often = (total >= FREQUENT_COUNT) & (shape < SHAPES)
    return total.astype(np.uint64), np.concatenate([n, v, keys[often].view(np.int64), total[often], shape[often]])


def _counts_of_pairs(keys, counts):
    return counts, None


WORDS = Channel(64, _combine_words, _counts_of_words, squeeze, partial(unsqueeze, kind=np.uint64), squeeze_counts, unsqueeze_counts)
PAIRS = Channel(PAIR_BITS, combine_counts, _counts_of_pairs, squeeze_counts, unsqueeze_counts, squeeze_counts, unsqueeze_counts)


def _summary(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens and distinct words by shape and slot, and (key, count, shape) of words that may be frequent)."""
    values = unsqueeze(data, np.int64)
    cells = 16 * SLOTS
    return values[:cells], values[cells : 2 * cells], values[2 * cells :].reshape(3, -1)


def _slot_sums(batches):
    for b in batches:
        for data in b.column(0).to_pylist():
            n, v, _ = _summary(data)
            yield batch(SLOT_SUM_SCHEMA, [(i // SLOTS, i % SLOTS, int(n[i]), int(v[i])) for i in np.flatnonzero(n + v)])


def _frequent_rows(batches):
    for b in batches:
        for data in b.column(0).to_pylist():
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(_summary(data)[2], (pa.int64(), pa.int64(), pa.int32()))], names=["key", "n", "shape"])


# --- classes ---------------------------------------------------------------------------------------------------------


@dataclass
class Vocabulary:
    """Classes and slots. n and v: training tokens and distinct words by class and slot; total: all training tokens."""

    keys: np.ndarray  # an open-addressing table of the frequent words; 0 is free
    codes: np.ndarray  # class * SLOTS + slot of each
    n: np.ndarray
    v: np.ndarray
    total: int

    @classmethod
    def build(cls, slot_sums, frequent) -> Vocabulary:
        """slot_sums: (shape, slot, n, v) of all words. frequent: (key, n, shape), at most 1 / FREQUENT_SHARE of them."""
        n, v = np.zeros((CLASSES, SLOTS), np.int64), np.zeros((CLASSES, SLOTS), np.int64)
        for shape, slot, a, b in slot_sums:
            n[FREQUENT_CLASSES + shape, slot] += a
            v[FREQUENT_CLASSES + shape, slot] += b
        n[END_CLASS, 0], v[END_CLASS, 0] = n[END_CLASS].sum(), min(1, v[END_CLASS].sum())
        n[END_CLASS, 1:] = v[END_CLASS, 1:] = 0
        key, count, shape = (np.array([r[i] for r in frequent], np.int64) for i in range(3))
        order = np.lexsort((key, -count))
        key, count, shape = key[order].view(np.uint64), count[order], shape[order]
        below = np.cumsum(count) - count
        kind = np.minimum(below * FREQUENT_CLASSES // max(1, int(count.sum())), FREQUENT_CLASSES - 1)
        slot = (np.arange(len(key)) - np.searchsorted(kind, kind)) % SLOTS
        np.subtract.at(n, (FREQUENT_CLASSES + shape, _slot_of(key)), count)
        np.subtract.at(v, (FREQUENT_CLASSES + shape, _slot_of(key)), 1)
        np.add.at(n, (kind, slot), count)
        np.add.at(v, (kind, slot), 1)
        size = 1 << max(4, (4 * len(key)).bit_length())
        keys, codes = np.zeros(size, np.uint64), np.zeros(size, np.int32)
        for k, code in zip(key.tolist(), (kind * SLOTS + slot).tolist()):
            at = k % size
            while keys[at]:
                at = (at + 1) % size
            keys[at], codes[at] = k, code
        return cls(keys, codes, n, v, int(n.sum()))

    def code(self, t: Tokens) -> np.ndarray:
        """class * SLOTS + slot of each token."""
        out = (FREQUENT_CLASSES + t.shape.astype(np.int64)) * SLOTS + np.where(t.shape < SHAPES, _slot_of(t.hash), 0)
        mask = np.uint64(len(self.keys) - 1)
        at, left = (t.hash & mask).astype(np.int64), np.arange(len(t.hash))
        while len(left):
            found = self.keys[at]
            hit = found == t.hash[left]
            out[left[hit]] = self.codes[at[hit]]
            go = ~hit & (found != 0)
            left, at = left[go], (at[go] + 1) & int(mask)
        return out

    def log_prior(self) -> tuple[np.ndarray, np.ndarray]:
        """Of classes, and of slots by class."""
        n = self.n + SMOOTHING * (self.v + 1)
        n[END_CLASS, 1:] = 1e-9
        return np.log(n.sum(axis=1) / n.sum()).astype(np.float32), np.log(n / n.sum(axis=1, keepdims=True)).astype(np.float32)


# --- the model -------------------------------------------------------------------------------------------------------


@dataclass
class Model:
    """Weights by feature slot: of classes, and of slots given a class."""

    vocabulary: Vocabulary
    of_class: np.ndarray
    of_slot: np.ndarray

    @classmethod
    def empty(cls, vocabulary: Vocabulary) -> Model:
        return cls(vocabulary, np.zeros((1 << FEATURE_BITS, CLASSES), np.float32), np.zeros((1 << FEATURE_BITS, SLOTS), np.float32))


def contexts(t: Tokens) -> list[np.ndarray]:
    """Hashes of the last word, the last two and the second last."""
    one, two = t.before(1), t.before(2)
    with np.errstate(over="ignore"):
        return [mixed(k) for k in (one + np.uint64(11), one * np.uint64(31) + two + np.uint64(12), two + np.uint64(13))]


def _features(context: list[np.ndarray], kind: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Rows of the two weight tables that are on for each token."""
    mask = np.uint64((1 << FEATURE_BITS) - 1)
    with np.errstate(over="ignore"):
        salted = [mixed(c + (kind.astype(np.uint64) + np.uint64(1)) * _GOLD) for c in context]
    return [(c & mask).astype(np.intp) for c in context], [(c & mask).astype(np.intp) for c in salted]


def _softmax(prior: np.ndarray, weights: np.ndarray, on: list[np.ndarray]) -> np.ndarray:
    out, more = np.empty((2, len(on[0]), weights.shape[1]), np.float32)
    weights.take(on[0], axis=0, out=out, mode="clip")
    for rows in on[1:]:
        weights.take(rows, axis=0, out=more, mode="clip")
        out += more
    out += prior
    np.exp(out, out=out)  # steps are bounded, so that this can't overflow
    out /= (out @ np.ones(out.shape[1], np.float32))[:, None]
    return out


def probabilities(model: Model, on_class: list[np.ndarray], on_slot: list[np.ndarray], kind: np.ndarray):
    """(place, P of every class, P of every slot of the token's class) of tokens, block by block."""
    classes, slots = model.vocabulary.log_prior()
    for lo in range(0, len(kind), BLOCK):
        block = slice(lo, lo + BLOCK)
        yield block, _softmax(classes, model.of_class, [on[block] for on in on_class]), _softmax(slots[kind[block]], model.of_slot, [on[block] for on in on_slot])


def observe(model: Model, row: dict, total: np.ndarray) -> None:
    """Adds what a pack's training rows hold of each feature (second axis) with each class, with each slot, and of the slots' features with each class."""
    t = tokens_of(row)
    code = model.vocabulary.code(t)
    kind, slot = code // SLOTS, code % SLOTS
    on_class, on_slot = _features(contexts(t), kind)
    inner = t.trains & (kind != END_CLASS)
    for part, value, on, which in zip(_cut(total), (kind, slot, kind), (on_class, on_slot, on_slot), (t.trains, inner, inner)):
        for rows in on:
            part += np.bincount(value[which] * part.shape[1] + rows[which], minlength=part.size).reshape(part.shape)


def _cut(total: np.ndarray) -> list[np.ndarray]:
    return np.split(total, [CLASSES, CLASSES + SLOTS])


def expect(model: Model, row: dict, total: np.ndarray) -> None:
    """Adds what the model expects of the features with each class and with each slot, in units."""
    of_class, of_slot, _ = _cut(total)
    t = tokens_of(row)
    kind = model.vocabulary.code(t)[t.trains] // SLOTS
    context = [c[t.trains] for c in contexts(t)]
    for lo in range(0, len(kind), GROUP):
        group = kind[lo : lo + GROUP]
        on_class, on_slot = _features([c[lo : lo + GROUP] for c in context], group)
        classes, slots = np.empty((CLASSES, len(group))), np.empty((SLOTS, len(group)))
        for block, p, q in probabilities(model, on_class, on_slot, group):
            for units, found in ((classes, p), (slots, q)):
                found *= np.float32(UNIT)
                np.copyto(units[:, block], np.rint(found, out=found).T)
        slots[:, group == END_CLASS] = 0
        for part, units, on in ((of_class, classes, on_class), (of_slot, slots, on_slot)):
            rows = np.concatenate(on)
            for k, column in enumerate(units):
                part[k] += np.bincount(rows, np.tile(column, len(on)), part.shape[1]).astype(np.int64)


def _sums(packs: DataFrame, model, add, height: int) -> np.ndarray:
    """add(model, pack, total) over all packs, summed; total has so many numbers for each feature slot. Tasks' sums meet in a tree, 64 at once up to 262,144 tasks;
    to the driver comes one table of the weights' size."""
    from pyspark import TaskContext

    shape = (height, 1 << FEATURE_BITS)
    per_part = shape[0] * shape[1] // PARTS

    def run(batches):
        total = np.zeros(shape, np.int64)
        for b in batches:
            for i in range(b.num_rows):
                add(model.value, {k: v[0].as_py() for k, v in zip(b.schema.names, b.slice(i, 1).columns)}, total)
        flat = total.ravel()
        task = TaskContext.get().partitionId()
        if flat.any():
            yield batch(SUM_SCHEMA, [(k, task, squeeze(x.view(np.uint8).reshape(-1, 8).T)) for k, x in enumerate(np.split(flat, PARTS))])

    def whole(data: bytes) -> np.ndarray:
        return np.ascontiguousarray(unsqueeze(data, np.uint8).reshape(8, -1).T).view(np.int64).ravel()

    def merge(table: pa.Table) -> pa.Table:
        total = np.zeros(per_part, np.int64)
        for d in table.column("data"):
            total += whole(d.as_py())
        rows = [(table.column("part")[0].as_py(), table.column("task")[0].as_py(), squeeze(total.view(np.uint8).reshape(-1, 8).T))]
        return pa.Table.from_batches([batch(SUM_SCHEMA, rows)])

    sums = packs.mapInArrow(run, SUM_SCHEMA)
    for shift in (FAN_IN, FAN_IN, 31):
        sums = sums.withColumn("task", F.shiftright("task", shift)).groupBy("part", "task").applyInArrow(merge, SUM_SCHEMA)
    flat = np.zeros((PARTS, per_part), np.int64)
    for r in sums.collect():
        flat[r.part] = whole(bytes(r.data))
    return flat.reshape(shape)


def train(packs: DataFrame, vocabulary: Vocabulary, rounds: int = ROUNDS) -> Model:
    """The model after so many rounds over all training rows of packs. The first starts from the priors of classes and slots alone, so that
    what it expects follows from counts."""
    spark, model = packs.sparkSession, Model.empty(vocabulary)
    observed, expected = [], []
    for turn in range(rounds):
        shared = spark.sparkContext.broadcast(model)
        if turn == 0:
            *observed, kinds = _cut(_sums(packs, shared, observe, 2 * CLASSES + SLOTS))
            of_class, of_slot = (np.exp(x.astype(np.float64)) for x in vocabulary.log_prior())
            expected = [observed[0].sum(axis=0) * of_class[:, None], of_slot.T @ kinds]
        else:
            expected = [units / UNIT for units in _cut(_sums(packs, shared, expect, CLASSES + SLOTS))[:2]]
        shared.unpersist()
        steps = []
        for seen, of in zip(observed, expected):
            base = DAMPING * (of + 1e-3) / (of + 1e-3).sum(axis=0)
            steps.append(np.clip(np.log((seen + base) / (of + base)) / FEATURES, -4, 4).astype(np.float32).T)
        model = Model(vocabulary, np.ascontiguousarray(model.of_class + steps[0]), np.ascontiguousarray(model.of_slot + steps[1]))
    return model


def given(prior: np.ndarray, counts: list[tuple[np.ndarray, np.ndarray]], strengths: tuple[float, float]) -> np.ndarray:
    """P(token | context) from the prior and, for the last word and the last two, (count of the context, count of the token after it).

    A distribution over words if the prior is: the first counts take it as their prior, and the second take that.
    """
    for (n, c), k in zip(counts, strengths):
        prior = (c + k * prior) / (n + k)
    return prior


@dataclass
class Scorer:
    """What all tasks share; a pack's tokens with what the model says of each."""

    model: object  # a broadcast one
    ranges: int
    smoothing: float
    distinct_words: int

    def of(self, row: dict, replies: pa.Table) -> tuple[Tokens, np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """(tokens, count of each, P of each by the maximum-entropy model, counts for ``given``)."""
        model, t = self.model.value, tokens_of(row)
        code = model.vocabulary.code(t)
        kind, slot = code // SLOTS, code % SLOTS
        c = replied(replies, WORDS, 0, self.ranges).astype(np.float64)[_distinct(t)[1]]
        prior = (c + self.smoothing) / (model.vocabulary.n[kind, slot] + self.smoothing * (model.vocabulary.v[kind, slot] + 1))
        prior[kind == END_CLASS] = 1.0
        for block, classes, slots in probabilities(model, *_features(contexts(t), kind), kind):
            at = np.arange(len(classes))
            prior[block] *= classes[at, kind[block]] * np.where(kind[block] == END_CLASS, 1.0, slots[at, slot[block]])
        pair, triple = (
            replied(replies, PAIRS, (k + 1) * self.ranges, (k + 2) * self.ranges).astype(np.float64)[np.unique(keys, return_inverse=True)[1]]
            for k, keys in enumerate(_pair_keys(t))
        )
        # The last word's own count; before the first token stands the start, which there is once in each training text, as the end.
        starts = np.zeros(len(c), bool)
        starts[t.first] = True
        ends = float(model.vocabulary.n[END_CLASS, 0])
        one = np.where(starts, ends, np.concatenate([[0.0], c[:-1]])) if len(c) else c
        two = np.where(starts, ends, np.concatenate([[0.0], pair[:-1]])) if len(c) else c
        return t, c, prior, [(one, pair), (two, triple)]


def runs_of(t: Tokens) -> np.ndarray:
    """Where runs of up to RUN tokens of one document begin."""
    at = np.arange(len(t.hash))
    return np.flatnonzero((at - t.first[t.doc]) % RUN == 0)


def log_sums(prior: np.ndarray, counts: list[tuple[np.ndarray, np.ndarray]], grid: tuple, runs: np.ndarray) -> np.ndarray:
    """log2 of ``given`` over each run of tokens, under each of grid[0] (first axis) with each of grid[1]."""
    out, edges = np.empty((len(grid[0]), len(grid[1]), len(runs))), np.append(runs, len(prior))
    for lo in range(0, len(runs), RUNS):
        hi = min(lo + RUNS, len(runs))
        at, begins = slice(edges[lo], edges[hi]), runs[lo:hi] - edges[lo]
        first, second = ([x[at] for x in pair] for pair in counts)
        for i, a in enumerate(grid[0]):
            one = given(prior[at], [first], (a,))
            for j, b in enumerate(grid[1]):
                p = given(one, [second], (b,))
                whole = p.min() >= LEAST
                out[i, j, lo:hi] = np.log2(np.multiply.reduceat(p, begins)) if whole else np.add.reduceat(np.log2(np.maximum(p, 1e-300)), begins)
    return out


def score_packs(packs: DataFrame, replies: DataFrame, scorer: Scorer, grid: tuple) -> DataFrame:
    """Rows of SCORED_SCHEMA, written. What the model says of a token doesn't depend on the strengths, so each pack is looked at once for all of them."""
    total = scorer.model.value.vocabulary.total

    def run(row, table):
        t, c, prior, counts = scorer.of(row, table)
        runs = runs_of(t)
        base = np.log10((c + scorer.smoothing) / (total + scorer.smoothing * (scorer.distinct_words + 1)))
        scores = np.add.reduceat(log_sums(prior, counts, grid, runs), np.searchsorted(runs, t.first), axis=2) * np.log10(2)
        sums = [np.add.reduceat(x, t.first) for x in (c > 0, base)]
        n, out = np.diff(np.append(t.first, len(c))), ~t.trains[t.first]
        scores = scores.reshape(-1, len(n)).T.tolist()
        rows = [(None if i == NULL_ID else i, bool(o), int(k), int(a), float(b), s, None, None) for i, o, k, a, b, s in zip(t.words.ids.tolist(), out, n, *sums, scores)]
        yield batch(SCORED_SCHEMA, rows)
        if len(grid[0]) * len(grid[1]) > 1:
            # Each training token is taken out of the counts itself; in 1/1024 of a bit.
            apart = [(np.maximum(n - 1, 0), np.maximum(c - 1, 0)) for n, c in counts]
            bits = np.rint(log_sums(prior, apart, grid, runs)[:, :, t.trains[runs]] * 1024).sum(axis=2).astype(np.int64)
            yield batch(SCORED_SCHEMA, [(None, None, None, None, None, None, bits.ravel().tolist(), int(t.trains.sum()))])

    return written(with_replies(packs, replies, run, SCORED_SCHEMA))


def fit_sums(scored: DataFrame, grid: tuple) -> DataFrame:
    """i, j, total, n: what the n training tokens of all packs, each taken out of the counts itself, amount to under grid[0][i] and grid[1][j]; in 1/1024 of a bit."""
    each = scored.filter("bits IS NOT NULL").select("n_trained", F.posexplode("bits").alias("at", "total"))
    place = F.floor(F.col("at") / len(grid[1])).cast("int").alias("i"), (F.col("at") % len(grid[1])).alias("j")
    return each.groupBy(*place).agg(F.sum("total").alias("total"), F.sum("n_trained").alias("n"))


def fitted_strengths(scored: DataFrame, grid: tuple) -> tuple[int, int]:
    """Places of those of the grid under which all training tokens are likeliest. Held-out rows have no part in it."""
    best = max(fit_sums(scored, grid).collect(), key=lambda r: (r.total, -r.i, -r.j), default=None)
    return (best.i, best.j) if best else (0, 0)


def lm_scores(docs: DataFrame, rounds: int = ROUNDS, smoothing: float = SMOOTHING, strengths: tuple[float, float] | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row of docs (doc_id, text).

    Trains on rows whose crc32(doc_id as text) mod 10 is not 0. Words are in ASCII lower case; a text's tokens are its words and one end.
    base_score is the unigram model of the counts of all training tokens; score is the model's (both log10), one model for all rows.
    Counts come from all packs by one exchange of distinct words, pairs and triples; a context's own count is that of the word or
    pair that it is. To the driver come sums for each class and slot, and the frequent words, which their share bounds. strengths: those of ``given``; fitted if not given.

    Null or blank text: the end only. Null doc_id is held out (the checksum of nothing is 0) and is returned as null.
    Repeated rows count as often as they stand. An empty table gives an empty result. Other columns aren't read.
    """
    spark = docs.sparkSession
    packs = written(packed(docs), release=True)
    layout = Layout.of(packs)
    found = exchange(each_pack(packs, lambda row: send_counts(row, layout), SENT_SCHEMA), layout, [WORDS, PAIRS, PAIRS])
    summaries, replies = found.filter("pack = -1").select("data"), found.filter("pack >= 0")
    slot_sums = summaries.mapInArrow(_slot_sums, SLOT_SUM_SCHEMA).groupBy("shape", "slot").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect()
    total, distinct_words = sum(r.n for r in slot_sums), sum(r.v for r in slot_sums)
    frequent = summaries.mapInArrow(_frequent_rows, FREQUENT_SCHEMA).filter(F.col("n") >= total * FREQUENT_SHARE).collect()
    vocabulary = Vocabulary.build([tuple(r) for r in slot_sums], [tuple(r) for r in frequent])
    release(spark)
    scorer = Scorer(spark.sparkContext.broadcast(train(packs, vocabulary, rounds)), layout.ranges(0), smoothing, distinct_words)
    grid = STRENGTHS if strengths is None else tuple((x,) for x in strengths)
    scored = score_packs(packs, replies, scorer, grid)
    i, j = fitted_strengths(scored, grid)
    discard(packs, found)
    out = scored.filter("bits IS NULL").withColumn("train_tokens", F.lit(total).cast("long")).withColumn("score", F.col("scores")[i * len(grid[1]) + j])
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_lm_scoring(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return lm_scores(docs)
