"""Operators on small tables with nulls, ties, repeats, long and empty texts, against plain versions."""

import hashlib
import random
import zlib
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from quaestor.llm import chat, decontaminate, jaccard, langid, lm, mixing, packs, quality, substring, tokencounts, tokenfiles
from quaestor.llm.components import components
from quaestor.llm.encoder import Encoder, default_path
from quaestor.llm.wavelet import WaveletMatrix
from tests.llm import brute

DOCS = "doc_id long, text string, source string, lang string, n_words long, kept boolean, copies string"


def corpus(seed=5, n=60):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "And", "Été", "x|y", "a.", "b,", "naïve", "中文", "w1", "w2", "w3", "###", "don't", "\\n"]
    long_words = [f"k{i}" for i in range(400)]
    make = lambda k, v: [rng.choice(v) for _ in range(k)]
    base = make(160, long_words)
    texts = [None, "", "   \n\t ", "one", "one two three", " ".join(make(13, vocabulary)), "a a a a a a a a a a a a a a a a a a a a", " ".join(base)]
    texts += [" ".join(base)] * 6
    for _ in range(12):
        near = list(base)
        for _ in range(rng.randint(1, 8)):
            near[rng.randrange(len(near))] = rng.choice(long_words)
        texts.append(" ".join(near))
    passage = make(30, vocabulary + long_words)
    for _ in range(10):
        texts.append("\n".join([" ".join(make(rng.randint(0, 40), long_words)), " ".join(passage), " ".join(make(5, vocabulary))]))
    texts.append(" ".join(make(30_000, long_words + vocabulary)))
    while len(texts) < n:
        texts.append(rng.choice([" ", "\n", "\r\n"]).join(make(rng.randint(1, 120), vocabulary + long_words[:30])))
    rng.shuffle(texts)
    ids = [3 * i - 7 for i in range(len(texts))]
    rows = [(i, t, rng.choice(["b", "a", None, "é"]), rng.choice(["en", "fr", None]), 1, None, "x") for i, t in zip(ids, texts)]
    rows += [rows[4], rows[4], (None, texts[9], None, None, None, None, None), (None, " ".join(base), "a", "en", None, None, None)]
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


def pairs(rows):
    return [(r[0], r[1]) for r in rows]


def same(found, wanted):
    key = lambda r: tuple((x is None, str(type(x)), x) if x is not None else (True, "", 0) for x in r)
    assert sorted(map(tuple, found), key=key) == sorted(map(tuple, wanted), key=key)


def test_substring(docs, rows):
    found = substring.substring_dedup(docs).collect()
    same([r[:4] for r in found], brute.substring(pairs(rows)))
    assert all(hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 for r in found)


@pytest.mark.parametrize(("size", "percent"), [(5, 80), (4, 85)])
def test_jaccard(docs, rows, size, percent):
    same(jaccard.link(docs, size, percent).collect(), brute.components(pairs(rows), percent, size))


def test_jaccard_of_a_chain(spark):
    base = [f"v{i}" for i in range(60)]
    texts = []
    for k in range(20):  # each links to its neighbours only
        base = base[2:] + [f"n{k}", f"m{k}"]
        texts.append((100 - k, " ".join(base)))
    same(jaccard.link(spark.createDataFrame(texts, "doc_id long, text string")).collect(), brute.components(texts))


def test_jaccard_of_a_common_header(spark):
    rng = random.Random(9)
    header = [f"h{i}" for i in range(30)]
    rows = [(i, " ".join(header + [f"x{i}_{k}" for k in range(rng.randint(3, 30))])) for i in range(80)]
    rows += [(100 + i, rows[i][1] + " one more") for i in range(20)] + [(200 + i, rows[3][1]) for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    same(jaccard.link(docs, 4, 85).collect(), brute.components(rows, 85, 4))


@pytest.mark.parametrize("fan", [2, 3])
def test_exchange_over_levels(docs, rows, monkeypatch, fan):
    """Many more buckets than a pack sends to: nodes merge and pass on, and the results are those of one level."""
    many = docs.repartition(23)
    flat = {r.doc_id: (r.n_known, r.base_score, r.score) for r in lm.lm_scores(many).filter("doc_id IS NOT NULL").collect()}
    monkeypatch.setattr(packs, "FAN", fan)
    monkeypatch.setattr(packs, "BUCKET_KEYS", packs.PACK_BYTES)
    layout = packs.Layout.of(packs.packed(many))
    assert layout.levels > 1 and layout.ranges(layout.levels - 1) >= packs.n_buckets(layout.packs, 4) and layout.first <= fan
    same([r[:4] for r in substring.substring_dedup(many, with_text=False).collect()], brute.substring(pairs(rows)))
    same(jaccard.link(many, 4, 85).collect(), brute.components(pairs(rows), 85, 4))
    for r in lm.lm_scores(many).filter("doc_id IS NOT NULL").collect():
        assert (r.n_known, r.base_score, r.score) == pytest.approx(flat[r.doc_id], rel=1e-6)


def test_messages_of_a_level():
    """A pack and a node send no more than ``fan`` messages for a channel, whatever the number of buckets; keys reach the bucket of their range."""
    layout, channel = packs.Layout(1000, 3, 3, 4), jaccard.COUNTS
    keys = np.unique(np.random.default_rng(3).integers(0, 1 << 48, 5000, dtype=np.uint64))
    (sent,) = packs.send(7, keys, np.ones(len(keys), np.uint32), layout, channel, 1)
    assert set(sent.column("bucket").to_pylist()) == {3, 4, 5} and sum(sent.column("n").to_pylist()) == len(keys)
    assert [layout.ranges(k) for k in range(3)] == [3, 12, 48] and [layout.nodes(k) for k in range(3)] == [250, 63, 16]


@pytest.mark.parametrize("n", [300, 560, 2568, 6000, 30_000, 3_000_000])
def test_keys_of_a_node(n):
    """However many packs there are, no task of any level merges more keys than a bucket is meant to hold."""
    table = SimpleNamespace(count=lambda: n, sparkSession=SimpleNamespace(conf={"spark.sql.shuffle.partitions": "200"}))
    layout, of_pack = packs.Layout.of(table), packs.PACK_BYTES // 6
    assert layout.first <= packs.FAN and layout.fan <= packs.FAN
    senders = n
    for level in range(layout.levels):
        last = level == layout.levels - 1
        merged = senders if last else -(-senders // layout.nodes(level))
        share = of_pack * (n / senders) / layout.ranges(level)  # keys that a sender sends to one range, if no two packs have any in common
        assert merged * share <= 1.1 * packs.BUCKET_KEYS
        senders = layout.nodes(level)


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(40)] + [(rng.randrange(50, 90), rng.randrange(50, 90)) for _ in range(25)]
    found = dict(components(spark.range(100).toDF("node"), spark.createDataFrame(edges, "a long, b long")).collect())
    label = list(range(100))
    for _ in range(100):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    assert found == dict(enumerate(label))


def test_decontamination(spark, docs, rows, monkeypatch):
    texts = [t for _, t in pairs(rows) if t and len(t.split()) > 30]
    items = [(1, " ".join(texts[0].split()[3:20])), (12, texts[1].upper()), (2, "one"), (3, "ONE two"), (4, None), (5, "###"), (None, "one two three"), (7, "a a a"), (7, "a a a"), (8, "été 中文")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    columns = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    same(decontaminate.contamination(docs, benchmark).select(*columns).collect(), brute.contamination(pairs(rows), items))
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", -1)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plans = []
        real = decontaminate.written
        monkeypatch.setattr(decontaminate, "written", lambda df, **k: plans.append(df._jdf.queryExecution().executedPlan().toString()) or real(df, **k))
        same(decontaminate.contamination(docs, benchmark).select(*columns).collect(), brute.contamination(pairs(rows), items))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert not any("BroadcastHashJoin" in p for p in plans)
    joins = [p for p in plans if "run#" in p and "h#" in p]
    assert joins and all("Generate" in p for p in joins[:1])
    assert decontaminate.contamination(docs, benchmark.limit(0)).filter("contaminated").count() == 0


def test_quality(docs, rows):
    found = quality.quality(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()
    same(found, [(i, *brute.quality_counts(t)) for i, t in pairs(rows)])
    assert quality.quality(docs).filter("kept is null or (kept and base_failed)").count() == 0


def test_quality_has_no_shuffle(spark):
    plan = quality.op6_quality_rules(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_mixing(docs, rows):
    found = mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken").collect()
    assert len(found) == len(rows)
    same([(r.doc_id, r.size) for r in found], [(r[0], len(brute.words(r[1]))) for r in rows])
    assert all(r.taken <= 2 * r.size for r in found)
    taken, target, largest = {}, {}, max(r.size for r in found)
    for r in found:
        key = r.source_size
        taken[key], target[key] = taken.get(key, 0) + r.taken, r.target
    assert all(abs(taken[k] - target[k]) <= largest for k in taken)


def test_names_of_other_columns_are_safe(spark):
    text = " ".join(f"word{i} of the text" for i in range(40))
    kept = ["rest", "whole", "_s", "_src", "_draw", "_w", "_l", "_rules", "_k", "_id", "_hit", "_items", "_of", "w", "f", "n", "a.b", "row_id", "_rows", "Source2"]
    docs = spark.createDataFrame([(i, f"{text} {i}", "a", *[f"{c}{i}" for c in kept]) for i in range(3)], ["doc_id", "text", "source", *kept])
    items = spark.createDataFrame([(1, "word1 of the text word2 of the text word3 of the text word4")], "item_id long, text string")
    for out in (quality.quality(docs), mixing.mix(docs), decontaminate.contamination(docs, items)):
        assert set(docs.columns) <= set(out.columns)
        assert {tuple(r) for r in out.select("doc_id", *[f"`{c}`" for c in kept]).collect()} == {(i, *[f"{c}{i}" for c in kept]) for i in range(3)}


def test_mixing_against_brute_force(spark, rows):
    named = [(r[0], r[2], r[1]) for r in rows if r[0] is not None]
    docs = spark.createDataFrame(named, "doc_id long, source string, text string")
    found = {tuple(r) for r in mixing.mix(docs).select("doc_id", "size", "source_size", "taken").collect()}
    assert found == {(a, b, c, e) for a, b, c, _, e in brute.mixing(named)}
    target = {r.source: (r.target, r.taken) for r in mixing.mix(docs).groupBy("source").agg(F.first("target").alias("target"), F.sum("taken").alias("taken")).collect()}
    assert sum(t for t, _ in target.values()) == pytest.approx(1.5 * sum(len(brute.words(t)) for _, _, t in named))


def language_brute(rows, learnt, bits):
    """(doc_id, lang_pred) by naive Bayes over the n-grams of whole texts, in plain Python; slots are the operator's own hashes of them."""
    import math
    import unicodedata
    from collections import Counter

    def grams(text):
        shown = "".join(c if unicodedata.category(c)[0] == "L" else " " for c in f" {(text or '').lower()} ")
        while "  " in shown:
            shown = shown.replace("  ", " ")
        return Counter(shown[i : i + n] for n in langid.ORDERS for i in range(len(shown) - n + 1)) if shown.strip() else Counter()

    def slot(gram):
        key = 0
        for n, c in enumerate(gram, 1):
            key = (key * 0x9E3779B97F4A7C15 + ord(c) + n) % 2**64
        return int(packs.mixed(np.array([key], np.uint64))[0]) >> (64 - bits)

    counts, texts = {}, Counter()
    for text, lang in learnt:
        if text is not None and lang is not None:
            texts[lang] += 1
            at = counts.setdefault(lang, Counter())
            for g, n in grams(text).items():
                at[slot(g)] += n
    out = []
    for i, text in rows:
        found, best = grams(text), ("und", None)
        for lang in sorted(counts) if found else ():
            whole = sum(counts[lang].values()) + langid.SMOOTHING * 2**bits
            p = math.log(texts[lang] / sum(texts.values())) + sum(n * math.log((counts[lang][slot(g)] + langid.SMOOTHING) / whole) for g, n in found.items())
            if best[1] is None or p > best[1]:
                best = (lang, p)
        out.append((i, best[0]))
    return out


def test_language(docs, rows, monkeypatch):
    wanted = language_brute(pairs(rows), [(r[1], r[3]) for r in rows], 10)
    counts = langid.train(docs, bits=10)
    found = langid.predict(docs, counts, bits=10).collect()
    same([(r.doc_id, r.lang_pred) for r in found], wanted)
    assert all(0 <= r.score <= 1 and (r.score == 0) == (r.lang_pred == "und") for r in found)
    monkeypatch.setattr(langid, "MATRIX_BYTES", 4 << 10)  # one language a block
    apart = langid.predict(docs, counts, bits=10).collect()
    same([(r.doc_id, r.lang_pred) for r in apart], wanted)
    assert sorted(r.score for r in apart) == pytest.approx(sorted(r.score for r in found), abs=1e-6)


def test_language_slots_of_blocks(monkeypatch):
    text = "Ünïcode 中文 words, don't  split\u3000here 123 a b  ~~ \U00030000 end"
    whole = sorted(np.concatenate(list(langid.slots(text))))
    for block in (1, 2, 3, 7):
        monkeypatch.setattr(langid, "BLOCK", block)
        assert sorted(np.concatenate(list(langid.slots(text)))) == whole
    assert not list(langid.slots("1234 ... \u3000")) and list(langid.slots("\U00030000"))


def test_language_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = langid.op4_language_id(spark, "/root/testdata/sf0.01")
    held = out.filter("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    right = held.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).head()[0]
    assert right > 0.97
    crc = {r.doc_id: r.held_out for r in out.collect()}
    assert all(h == (zlib.crc32(str(i).encode()) % 3 == 1) for i, h in crc.items())


def test_lm(docs, rows):
    import math
    from collections import Counter

    tokens = [(i, [*brute.words(t, lower=True), "</end>"]) for i, t in pairs(rows)]
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0
    count = Counter(x for i, w in tokens if not held(i) for x in w)
    total, v = sum(count.values()), len(count)
    wanted = [(i, held(i), len(w), sum(count[x] > 0 for x in w), total) for i, w in tokens]
    found = lm.lm_scores(docs).collect()
    same([r[:5] for r in found], wanted)
    base = {i: sum(math.log10((count[x] + 0.1) / (total + 0.1 * (v + 1))) for x in w) for i, w in tokens}
    assert all(r.base_score == pytest.approx(base[r.doc_id]) for r in found if r.doc_id is not None)
    assert all(r.score <= 0 for r in found)


def test_lm_words_follow_their_contexts(spark):
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    out, train = [i for i in range(1000) if held(i)], [i for i in range(1000) if not held(i)]
    # All words of a place have one class and one frequency, so that only the words before tell them apart.
    n = 40
    rows = [(i, f"red{k % n:02d}q plum{k % n:02d}q") for k, i in enumerate(train[: 10 * n])]
    rows += [(out[k], f"red{k:02d}q plum{k:02d}q") for k in range(n)] + [(out[n + k], f"red{k:02d}q plum{(k + 7) % n:02d}q") for k in range(n)]
    score = {r.doc_id: r.score for r in lm.lm_scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(score[out[k]] > score[out[n + j]] + 0.2 for k in range(n) for j in range(n))


def test_lm_given_is_a_distribution():
    rng = np.random.default_rng(3)
    prior = rng.random(50)
    prior /= prior.sum()
    counts = [rng.integers(0, 3, 50) * (rng.random(50) < 0.3) for _ in lm.STRENGTHS]
    for strengths in ((32.0, 0.5), (8192.0, 32.0)):
        assert lm.given(prior, [(c.sum(), c) for c in counts], strengths).sum() == pytest.approx(1)
        assert lm.given(prior, [(0, np.zeros(50))] * 2, strengths) == pytest.approx(prior)


def test_counts_beyond_32_bits():
    for pack in (lm.WORDS, lm.PAIRS):
        keys = np.array([5, 5, 9], np.uint64)
        counts = np.array([4 << 32, 4 << 32, 1], np.uint64)
        sent = counts << np.uint64(4) if pack is lm.WORDS else counts
        sent = pack.grow(pack.shrink(sent))
        distinct, total, group = pack.combine(keys, sent)
        reply = pack.grow_reply(pack.shrink_reply(pack.answer(distinct, total)[0]))
        assert reply.tolist() == [8 << 32, 1] and group.tolist() == [0, 0, 1]


def lm_brute(rows, rounds, strengths):
    """log10 P of rows by the same model in plain Python: dicts of weights, token by token."""
    import math
    from collections import Counter

    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0
    texts = [[*brute.words(t, lower=True), None] for _, t in rows]
    table = spark_vocabulary(rows)
    packs_row = pack_row([(None, " ".join(w[:-1])) for w in texts])
    t = lm.tokens_of(packs_row)
    codes = table.code(t).tolist()
    rows_of = [lm._features(lm.contexts(t), table.code(t) // lm.SLOTS)[k] for k in (0, 1)]
    at = 0
    tokens = []  # (row, class, slot, class features, slot features)
    for k, w in enumerate(texts):
        for _ in w:
            c = codes[at]
            tokens.append((k, c // lm.SLOTS, c % lm.SLOTS, [int(x[at]) for x in rows_of[0]], [int(x[at]) for x in rows_of[1]]))
            at += 1
    trains = [not held(i) for i, _ in rows]
    class_prior, slot_prior = table.log_prior()
    weights = ({}, {})

    def softmax(which, on, prior):
        logits = [float(p) + sum(weights[which].get((f, j), 0.0) for f in on) for j, p in enumerate(prior)]
        z = sum(map(math.exp, logits))
        return [math.exp(x) / z for x in logits]

    seen = (Counter(), Counter())
    for k, c, s, on_c, on_s in tokens:
        if trains[k]:
            for f in on_c:
                seen[0][f, c] += 1
            for f in on_s if c != lm.END_CLASS else ():
                seen[1][f, s] += 1
    for _ in range(rounds):
        expected = (Counter(), Counter())
        for k, c, s, on_c, on_s in tokens:
            if trains[k]:
                for f in on_c:
                    for j, p in enumerate(softmax(0, on_c, class_prior)):
                        expected[0][f, j] += p
                for f in on_s if c != lm.END_CLASS else ():
                    for j, p in enumerate(softmax(1, on_s, slot_prior[c])):
                        expected[1][f, j] += p
        for which, size in ((0, lm.CLASSES), (1, lm.SLOTS)):
            for f in {f for f, _ in expected[which]}:
                whole = sum(expected[which][f, j] + 1e-3 for j in range(size))
                for j in range(size):
                    base = lm.DAMPING * (expected[which][f, j] + 1e-3) / whole
                    step = math.log((seen[which][f, j] + base) / (expected[which][f, j] + base)) / lm.FEATURES
                    weights[which][f, j] = weights[which].get((f, j), 0.0) + max(-4, min(4, step))
    one, two, three = Counter(), Counter(), Counter()
    for w, trained in zip(texts, trains):
        for n, x in enumerate(w):
            if trained:
                a, b = w[n - 1] if n else "<", w[n - 2] if n > 1 else "<"
                one[x] += 1
                two[a, x] += 1
                three[b, a, x] += 1
    out, at = [0.0] * len(rows), 0
    for k, w in enumerate(texts):
        for n, x in enumerate(w):
            _, c, s, on_c, on_s = tokens[at]
            at += 1
            p = (one[x] + 0.1) / (table.n[c, s] + 0.1 * (table.v[c, s] + 1)) if x is not None else 1.0
            p *= softmax(0, on_c, class_prior)[c] * (softmax(1, on_s, slot_prior[c])[s] if x is not None else 1.0)
            a, b = w[n - 1] if n else "<", w[n - 2] if n > 1 else "<"
            p = (two[a, x] + strengths[0] * p) / ((one[a] if n else one[None]) + strengths[0])
            p = (three[b, a, x] + strengths[1] * p) / ((two[b, a] if n else one[None]) + strengths[1])
            out[k] += math.log10(p)
    return out


def pack_row(rows):
    texts = [(t or "").encode() for _, t in rows]
    ids = np.array([packs.NULL_ID if i is None else i for i, _ in rows], np.int64)
    ends = np.cumsum([len(t) + 1 for t in texts]).astype(np.int64)
    return {"pack": 0, "n": len(rows), "ids": packs.squeeze(ids), "ends": packs.squeeze(ends), "data": packs.squeeze(b"".join(t + b"\n" for t in texts))}


def spark_vocabulary(rows):
    """Classes and slots from plain counts; words are known by their hashes."""
    t = lm.tokens_of(pack_row(rows))
    keys, _, counts, shape = lm._distinct(t)
    sums, frequent = {}, []
    for k, n, kind in zip(keys, counts.tolist(), shape.tolist()):
        cell = (kind, int(k % np.uint64(lm.SLOTS)))
        a, b = sums.get(cell, (0, 0))
        sums[cell] = (a + n, b + (n > 0))
        if n >= lm.FREQUENT_COUNT and kind < lm.SHAPES:
            frequent.append((int(k.view(np.int64)), n, kind))
    return lm.Vocabulary.build([(*c, *x) for c, x in sums.items()], frequent)


def test_lm_against_brute_force(spark):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(12)] + ["Été", "long-winded-word", ",", "x.", "W1"]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 25)))) for i in range(60)] + [(None, "w1 w2"), (3, None), (7, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    strengths = (512.0, 8.0)
    one, many = (lm.lm_scores(d, rounds=2, strengths=strengths).collect() for d in (docs.coalesce(1), docs.repartition(8)))
    wanted = sorted(lm_brute(rows, 2, strengths))
    assert sorted(r.score for r in one) == pytest.approx(wanted, rel=1e-4)
    assert sorted(r.score for r in one) == pytest.approx(sorted(r.score for r in many), rel=1e-6)


def test_lm_gains_on_held_out_rows(spark):
    out = lm.op7_lm_scoring(spark, "/root/testdata/sf0.01").filter("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).head()
    assert (out[0] - out[1]) / out[2] > 0.2


def test_encoder_agrees_with_whole_texts():
    from tokenizers import Tokenizer

    own, plain = Encoder(default_path()), Tokenizer.from_file(default_path())
    plain.encode_special_tokens = True
    rng = random.Random(2)
    parts = ["a", "B", " ", "  ", "\n", "\t", ".", "'", "'s", "don't", "é", "1", "12", "###", "　", "中", "<|endoftext|>", "\x00", "\r", "!", " '", "​", "ü."]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    ids, at = own.encode([t.encode() for t in texts])
    wanted = [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == wanted


def test_encoder_keeps_added_tokens():
    from tokenizers import Tokenizer

    own, plain = Encoder(default_path(), added=True), Tokenizer.from_file(default_path())
    rng = random.Random(4)
    parts = ["a", "B", " ", "\n", ".", "don't", "12", "中", "<|endoftext|>", "<|endoftext", "|>", "x y. z", "", " word", "É", "×", "÷'s", "\n\n", "\t", "\u00a0", "\u3000", "\x85", "\x1c", "ñ", "-", "'ll", "  "]
    texts = ["a<|endoftext|>b", "<|endoftext|>", "<|endoftext|><|endoftext|>", "<|endo", "ftext|>"]
    texts += ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(4000)] + ["word" * 3000 + " a" + "é" * 2000]
    ids, at = own.encode([t.encode() for t in texts])
    wanted = [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == wanted


def test_encoder_forgets(monkeypatch):
    from quaestor.llm import encoder

    monkeypatch.setattr(encoder, "PLACES", 8)
    monkeypatch.setattr(encoder, "POOL", 50)
    own, plain, rng = Encoder(default_path()), Encoder(default_path()).tokenizer, random.Random(6)
    for _ in range(30):
        texts = [" ".join(rng.choice(["abc", "zebra", "naïve", "x,y", "qqq", "Wort"]) + str(rng.randint(0, 9)) for _ in range(rng.randint(0, 30))) for _ in range(5)]
        ids, at = own.encode([t.encode() for t in texts])
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]


def test_hashes_tell_spans_apart():
    rng = np.random.default_rng(1)
    width = np.concatenate([rng.integers(1, 40, 20_000), [600, 601, 5000]])
    end = np.cumsum(width)
    data = rng.integers(0, 3, end[-1]).astype(np.uint8)
    found = packs.hash_spans(data, end - width, end)
    by_span = {}
    for a, b, h in zip(end - width, end, found.tolist()):
        by_span.setdefault(data[a:b].tobytes(), set()).add(h)
    assert all(len(h) == 1 for h in by_span.values()) and len(set(found.tolist())) == len(by_span)


def test_a_lookup_opens_few_blocks():
    """Access to one token decompresses one block of each plane; counting opens at most two of each."""
    values = np.random.default_rng(2).integers(0, 50_000, 1_000_000).astype(np.uint16)
    parts = WaveletMatrix.build(values).to_parts()
    for look, most in ((lambda m: m.access([777_777])[0] == values[777_777], 1), (lambda m: m.rank(int(values[5])) == (values == values[5]).sum(), 2)):
        m = WaveletMatrix.from_parts(*parts)
        assert look(m)
        assert all(len(p.opened) <= most for p in m.planes) and len(parts[1]) == 16 * m.bits


def test_wavelet():
    rng = np.random.default_rng(4)
    for n, top in ((0, 5), (1, 1), (64, 2), (512, 3), (1000, 7), (1024, 9), (5000, 60_000)):
        values = rng.integers(0, top, n).astype(np.uint16)
        m = WaveletMatrix.from_parts(*WaveletMatrix.build(values).to_parts())
        assert (m.to_array() == values).all()
        assert (m.access(np.arange(n)) == values).all()
        for v in [*set(values[:20].tolist()), top + 1]:
            at = np.flatnonzero(values == v)
            assert m.rank(v) == len(at) and (m.occurrences(v) == at).all() and m.rank(v, n // 2) == (values[: n // 2] == v).sum()
            assert m.rank(v, n) == len(at)


def test_token_files(spark, docs, rows, tmp_path):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(default_path())
    rows = [*rows, (90_001, "a<|endoftext|> b <|endoftext|>", None, None, None, None, None)]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    small, tokenfiles.SHARD_TOKENS = tokenfiles.SHARD_TOKENS, 500
    try:
        path = tokenfiles.write_token_files(docs, str(tmp_path / "t"))
        found = sorted(tokenfiles.read_token_files(spark, path).collect(), key=lambda r: r.start)
    finally:
        tokenfiles.SHARD_TOKENS = small
    by_id = {}
    for i, t in pairs(rows):
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 0]
        by_id.setdefault(i, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    start = 0
    assert [r.doc_id for r in found] == sorted([i for i, _ in pairs(rows)], key=lambda i: (i is None, i or 0))
    for r in found:
        assert r.start == start and (r.n_tokens, r.ids_crc32) in by_id[r.doc_id]
        start += r.n_tokens
    assert tokenfiles.count_token(spark, path, 0).agg(F.sum("n")).head()[0] >= len(rows)
    own = {i: [*plain.encode(t or "", add_special_tokens=False).ids, 0] for i, t in pairs(rows)}
    assert 50256 in own[90_001]
    for token in (50256, 0, own[rows[7][0]][0], 40_000):
        once = [i for i, t in pairs(rows) if i is not None and sum(j == i for j, _ in pairs(rows)) == 1]
        places = {(r.doc_id, r.at) for r in tokenfiles.find_token(spark, path, token).collect()}
        assert {(i, p) for i, p in places if i in once} == {(i, p) for i in once for p, t in enumerate(own[i]) if t == token}
    longest = max((i for i, _ in pairs(rows) if i is not None), key=lambda i: len(own[i]))
    assert tokenfiles.read_tokens(spark, path, longest).head().tokens == own[longest]
    assert tokenfiles.read_tokens(spark, path, longest, 5, 9).head().tokens == own[longest][5:9]


def test_token_files_of_extreme_ids(spark, tmp_path):
    """The greatest number is a doc_id like any other, and not that of rows without one."""
    ids = [2**63 - 1, None, -(2**63), 2**63 - 2, None, 0, 2**53 + 1, 2**53]
    docs = spark.createDataFrame([(i, f"text {k}") for k, i in enumerate(ids)], "doc_id long, text string").repartition(3)
    path = tokenfiles.write_token_files(docs, str(tmp_path / "t"))
    found = sorted(tokenfiles.read_token_files(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in found] == [*sorted(i for i in ids if i is not None), None, None]
    assert sorted((r.doc_id is None, r.doc_id or 0, r.at) for r in tokenfiles.find_token(spark, path, 0).collect()) == sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens - 1) for r in found)
    assert len(tokenfiles.read_tokens(spark, path, 2**63 - 1).collect()) == 1


def test_strengths_are_fitted_on_all_training_rows(spark, docs, monkeypatch):
    seen, sums = [], lm.fit_sums
    monkeypatch.setattr(lm, "fit_sums", lambda *given: seen.append(sums(*given).persist()) or seen[0])
    found = lm.lm_scores(docs.repartition(40)).collect()
    assert {r.n for r in seen[0].collect()} == {sum(r.n_tokens for r in found if not r.held_out)} and seen[0].count() == 20


def test_chat_round_trip(spark):
    texts = [None, "", "\\", "\\\\</turn>", "### user: x</turn>\n", r"\### Assistant: </turn> ok", "a: b", "##", "#####", "é中", "<|endoftext|>"]
    rows = [(c, t, r, x) for c in (1, None, 5) for t, (r, x) in enumerate((r, x) for r in ("assistant", "user", None, "a: ###b") for x in texts)]
    found = {r.conv_id: r for r in chat.read_back(chat.format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4))).collect()}
    for c in (1, None, 5):
        turns = [(r or "", x or "") for k, _, r, x in rows if k == c]
        loss = "".join(x for r, x in turns if r == "assistant")
        shown = "".join(f"### {chat.escape(r, True)}: {chat.escape(x)}</turn>\n" for r, x in turns)
        assert chat.parse(shown) == turns
        digest = hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest()
        assert tuple(found[c])[1:] == (len(turns), digest, len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(shown))


def test_token_counts_against_offsets(spark, docs, rows):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(default_path())
    for rule in tokencounts.RULES:
        wanted = []
        for i, t in pairs(rows):
            t = t or ""
            lines = t.split("\n")
            edges = [0]
            for k, x in enumerate(lines):
                edges.append(edges[-1] + len(x) + (k < len(lines) - 1))
            if len(lines) > 1 and not lines[-1]:
                edges.pop()
            found = [[a, b, 0, 0] for a, b in zip(edges[:-1], edges[1:])]
            for a, b in plain.encode(t, add_special_tokens=False).offsets:
                held = [max(0, min(b, y) - max(a, x)) for x, y, *_ in found]
                inside = [k for k, n in enumerate(held) if n]
                goes = {"first": inside[0], "last": inside[-1], "most": held.index(max(held))}[rule]
                found[goes][2] += 1
                found[goes][3] += len(inside) > 1
            wanted += [(i, k, *x) for k, x in enumerate(found)]
        same(tokencounts.token_counts(docs, rule).collect(), wanted)


@pytest.mark.parametrize("rule", tokencounts.RULES)
def test_token_counts(docs, rows, rule):
    found = tokencounts.token_counts(docs, rule).groupBy("doc_id").agg(F.sum("n_tokens").alias("n"), F.max("end").alias("end")).collect()
    own = Encoder(default_path())
    wanted = {}
    for i, t in pairs(rows):
        wanted[i] = wanted.get(i, 0) + len(own.encode([(t or "").encode()])[0])
    assert {r.doc_id: r.n for r in found} == wanted


@pytest.mark.parametrize("rule", tokencounts.RULES)
def test_token_counts_of_fields(spark, rule):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(default_path())
    rows = [(1, "A title", "the body\nof it", "tail"), (2, None, "", "é中 only"), (3, "", None, ""), (None, "x" * 50, "y z", None)]
    df = spark.createDataFrame(rows, "doc_id long, title string, body string, section string")
    found = tokencounts.field_token_counts(df, ["title", "body", "section"], "\n\n", rule).collect()
    for i, *fields in rows:
        mine = [r for r in found if r.doc_id == i]
        text = "\n\n".join(f or "" for f in fields)
        assert sum(r.n_tokens for r in mine) == len(plain.encode(text, add_special_tokens=False).ids)
        assert [r.field for r in mine] == ["title", "body", "section"][: 3 if fields[-1] else 2]
        assert all(text[r.begin : r.end].removesuffix("\n\n") == (f or "") for r, f in zip(mine, fields))


def test_token_counts_at_given_edges(spark):
    docs = spark.createDataFrame([(1, "hello wonderful world", [8, 100, 0]), (2, "x", None)], "doc_id long, text string, cuts array<int>")
    by_rule = {r: [tuple(x)[1:] for x in tokencounts.token_counts(docs, r, edges="cuts").filter("doc_id = 1").collect()] for r in tokencounts.RULES}
    assert by_rule["first"] == [(0, 0, 8, 2, 1), (1, 8, 21, 1, 0)]
    assert by_rule["last"] == [(0, 0, 8, 1, 0), (1, 8, 21, 2, 1)]
    assert by_rule["most"] == [(0, 0, 8, 1, 0), (1, 8, 21, 2, 1)]


def test_empty_tables(spark):
    docs = spark.createDataFrame([], DOCS)
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    for out in (
        substring.substring_dedup(docs), jaccard.link(docs), decontaminate.contamination(docs, items), quality.quality(docs), mixing.mix(docs),
        lm.lm_scores(docs), tokenfiles.token_files(docs), tokencounts.token_counts(docs), langid.predict(docs, langid.train(docs)),
        chat.read_back(chat.format_turns(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))),
    ):
        assert out.count() == 0


def test_packs_are_scored_once_for_all_strengths(spark, docs, monkeypatch):
    """The fit and the scores come of one look at each pack, and scores are those of the strengths fitted when they are given."""
    seen, of, fitted = [], lm.with_replies, lm.fitted_strengths
    monkeypatch.setattr(lm, "with_replies", lambda *given: seen.append(1) or of(*given))
    monkeypatch.setattr(lm, "fitted_strengths", lambda *given: seen.append(fitted(*given)) or seen[-1])
    found = {r.doc_id: r.score for r in lm.lm_scores(docs).collect()}
    assert seen[0] == 1 and len(seen) == 2
    strengths = tuple(x[k] for x, k in zip(lm.STRENGTHS, seen[1]))
    monkeypatch.undo()
    given = {r.doc_id: r.score for r in lm.lm_scores(docs, strengths=strengths).collect()}
    assert found == pytest.approx(given, rel=1e-9)


def test_log_sums_of_small_probabilities():
    rng = np.random.default_rng(5)
    prior = 10.0 ** -rng.integers(1, 90, 40)
    runs, counts = np.array([0, 8, 16, 24, 25, 33]), [(np.zeros(40), np.zeros(40))] * 2
    found = lm.log_sums(prior, counts, ((32.0, 512.0), (0.5,)), runs)
    wanted = np.add.reduceat(np.log2(prior), runs)
    assert found.shape == (2, 1, 6) and found == pytest.approx(np.stack([wanted, wanted])[:, None])
