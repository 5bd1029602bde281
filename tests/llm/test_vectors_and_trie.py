"""Operators 11 to 13 on small tables with nulls, ties, repeats, hot groups and clashing names, against plain versions."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from quaestor.llm import clustering, forest, trie

VECTORS = "vec_id long, embedding array<float>, label int, n_links string, cluster string, w int"


def _rows(vectors):
    return [(i, v, 0, "x", "y", 1) for i, v in vectors]


def _plain_links(rows, bound=0.9):
    """[(vec_id, n_links, component_id, kept)] by comparing all with all."""
    fine = [v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v in rows]
    label = list(range(len(rows)))
    n = [0] * len(rows)
    unit = [np.array(v, np.float32).astype(float) / np.linalg.norm(np.array(v, np.float32).astype(float)) if f else None for (_, v), f in zip(rows, fine)]
    edges = [(a, b) for a in range(len(rows)) for b in range(a) if fine[a] and fine[b] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= bound]
    for a, b in edges:
        n[a], n[b] = n[a] + 1, n[b] + 1
        x, y = label[a], label[b]
        label = [x if k == y else k for k in label]
    least = defaultdict(list)
    for k, (i, _) in zip(label, rows):
        least[k] += [i] if i is not None else []
    of = [min(least[k], default=None) for k in label]
    return [(i, m, c, i == c) for (i, _), m, c in zip(rows, n, of)]


def _key(r):
    return tuple((x is not None, x) for x in r)


@pytest.mark.parametrize("leaf", [2048, 16])
def test_forest_links_what_comparing_all_links(spark, leaf):
    rng = np.random.default_rng(3)
    hot = rng.standard_normal(16)
    vectors = [v for v in rng.standard_normal((120, 16))]
    vectors += [hot + rng.standard_normal(16) * 0.1 for _ in range(150)]  # a third of all rows are one bundle
    vectors += [v + rng.standard_normal(16) * s for v in vectors[:30] for s in (0.05, 0.2)]
    rows = [(int(i) * 3 - 50, v.astype(np.float32).tolist()) for i, v in zip(rng.permutation(len(vectors)), vectors)]
    rows += [(1000 + k, rows[7][1]) for k in range(80)] + [rows[5], rows[5], (None, rows[9][1]), (None, None), (None, [0.5, 0.25])]
    rows += [(2000, None), (2001, []), (2002, [0.0] * 16), (2003, [float("nan")] + [1.0] * 15), (2004, [None] + [1.0] * 15), (2005, [float("inf")] * 16), (2006, [1.0, 2.0]), (2007, [2.0, 4.0])]
    df = spark.createDataFrame(_rows(rows), VECTORS).repartition(5)
    found = sorted([tuple(r) for r in forest.near_duplicates(df, leaf=leaf, trees=6).collect()], key=_key)
    wanted = sorted(_plain_links(rows), key=_key)
    if leaf > len(rows):
        assert found == wanted
    else:  # links are found by chance; those of bundles are sure
        assert [r[0] for r in found] == [r[0] for r in wanted]
        assert all(f[1] <= w[1] for f, w in zip(found, wanted))
        assert sum(r[1] for r in found) >= 0.97 * sum(r[1] for r in wanted)


def test_balls_are_counted_without_comparison(spark):
    rng = np.random.default_rng(4)
    centre = rng.standard_normal(32)
    rows = [(i, (centre + rng.standard_normal(32) * 0.05).tolist()) for i in range(400)] + [(1000 + i, v.tolist()) for i, v in enumerate(rng.standard_normal((200, 32)))]
    df = spark.createDataFrame(_rows(rows), VECTORS)
    model = forest.fitted(df.selectExpr("embedding AS vec"), leaf=32)
    x = forest.unit(np.array([v for _, v in rows[:400]]))
    assert len(model.centres) == 1 and (model.ball(x) == 0).all()
    found = {r.vec_id: r for r in forest.near_duplicates(df, leaf=32).collect()}
    assert all(found[i].n_links == 399 and found[i].component_id == 0 for i in range(400))


def test_forest_finds_pairs_at_the_bound(spark):
    """Recall over pairs of a cosine of 0.9 to 0.92, the hardest ones, with leaves of a fiftieth of the rows."""
    rng = np.random.default_rng(5)
    base = forest.unit(rng.standard_normal((1000, 64)))
    side = rng.standard_normal((1000, 64))
    side = forest.unit(side - (side * base).sum(1)[:, None] * base)
    angle = np.arccos(rng.uniform(0.901, 0.92, 1000))[:, None]
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([base, np.cos(angle) * base + np.sin(angle) * side]))]
    found = {r.vec_id: r.component_id for r in forest.near_duplicates(spark.createDataFrame(_rows(rows), VECTORS), leaf=40).collect()}
    assert sum(found[i + 1000] == i for i in range(1000)) >= 900


def test_leaves_of_too_many_vectors_are_compared_in_blocks():
    rng = np.random.default_rng(6)
    for main in ({}, {0: 0}):
        ids = np.arange(200)
        balls = np.where(ids < 150, 0, -1) if main else np.full(200, -1)
        tree = forest.Tree(count=[200])
        rows, nodes, part, side, inner = forest._placed(ids, np.zeros(200, np.int64), ids, balls, tree, main, 32)
        met = defaultdict(int)
        for p in np.unique(part):
            at = np.flatnonzero(part == p)
            for a in at:
                for b in at:
                    if rows[a] < rows[b] and (side[a] != side[b] or inner[a]):
                        met[rows[a], rows[b]] += 1
        wanted = {(a, b) for a in range(200) for b in range(a + 1, 200) if balls[a] < 0 or balls[b] < 0 or balls[a] != balls[b]}
        assert set(met) == wanted and set(met.values()) == {1}
        assert max(np.bincount(part)) < (150 if main else 110)
        assert rng is not None


@pytest.mark.parametrize("run", [forest.near_duplicates, clustering.cluster])
def test_no_vectors(spark, run):
    assert run(spark.createDataFrame([], VECTORS)).collect() == []


def _plain_clusters(rows, k, rounds, size):
    kept = [(i, [math.floor(64 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) and abs(x) <= (1 << 27) / 64 for x in v)]
    digest = lambda i: (0, hashlib.sha256(f"1:{i}".encode()).hexdigest()) if i is not None else (1, "")
    c = [v for _, v in sorted(kept, key=lambda r: (digest(r[0]), r[1]))[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    for n in range(rounds + 1):
        own = [min(range(len(c)), key=lambda j: (far(v, c[j]), j)) for _, v in kept]
        if n < rounds:
            for j in range(len(c)):
                mine = [v for (_, v), o in zip(kept, own) if o == j]
                c[j] = [sum(x) // len(mine) for x in zip(*mine)] if mine else c[j]
    d = [far(v, c[o]) for (_, v), o in zip(kept, own)]
    sha = [hashlib.sha256(",".join(map(str, v)).encode()).hexdigest() for v in c]
    return [(i, o, x, sum(y for y, p in zip(d, own) if p == o), sum(d), sha[o]) for (i, _), o, x in zip(kept, own, d)]


@pytest.mark.parametrize(("k", "groups", "spread"), [(16, None, 1.0), (16, 16, 40.0), (5, 1, 3e4), (300, None, 1.0)])
def test_clusters(spark, k, groups, spread):
    rng = np.random.default_rng(7)
    centres = rng.standard_normal((9, 8)) * spread
    rows = [(i, (centres[i % 9] + rng.standard_normal(8) * spread * 0.3).astype(np.float32).tolist()) for i in range(180)]
    rows += [(200 + i, rows[3][1]) for i in range(90)] + [rows[4], rows[4], (None, rows[11][1]), (None, rows[12][1])]
    rows += [(900, None), (901, []), (902, [1.0] * 7), (903, [None] + [0.0] * 7), (904, [float("nan")] * 8), (905, [float("-inf")] + [0.0] * 7), (906, [3e8] * 8)]
    df = spark.createDataFrame(_rows(rows), VECTORS).repartition(3)
    found = [tuple(r)[:6] for r in clustering.cluster(df, k=k, size=8, groups=groups).collect()]
    assert sorted(found, key=_key) == sorted(_plain_clusters(rows, k, 3, 8), key=_key)


def test_bounds_leave_rows_out():
    """Rows far from all other centroids are not looked at, and give the same as comparing all."""
    rng = np.random.default_rng(8)
    centres = (rng.standard_normal((12, 6)) * 300).astype(np.int64)
    x = np.repeat(centres, 50, 0) + rng.integers(-9, 9, (600, 6))
    of = clustering.grouped_centroids(centres, 3)
    own, upper, lower = clustering._first(x, centres, of, 3)
    after = centres + rng.integers(-3, 3, centres.shape)
    looked = []
    whole, clustering.squared = clustering.squared, lambda a, c: looked.append(len(a)) or whole(a, c)
    try:
        new = clustering._next(x, own, upper, lower, after, centres, of, 3)
    finally:
        clustering.squared = whole
    assert (new[0] == whole(x, after).argmin(1)).all() and sum(looked) < 100


TURNS = "conv_id long, turn long, role string, text string, depth int, owner string, ends int"


def _plain_trie(rows, rebuild=True):
    turns = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            turns[c].append((t is not None, t or 0, r or "", hashlib.sha256((x or "").encode()).digest(), x or ""))
    own = {c: [(t[2], t[4]) for t in sorted(v)] for c, v in turns.items()}
    paths = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6 if rebuild else 0
        head = c - math.fmod(c, 100)
        paths[c] = tuple(own.get(int(head), [])[:h] + own[c][h:])
    nodes = defaultdict(list)
    for c in sorted(paths):
        for d in range(len(paths[c]) + 1):
            nodes[paths[c][:d]].append(c)
    children = defaultdict(list)
    for p in nodes:
        if p:
            children[p[:-1]].append(p)
    below = lambda p: [p] + [y for q in children[p] for y in below(q)]
    out = []
    for p, members in nodes.items():
        sub = below(p)
        ends = ",".join(str(c) for c in members if paths[c] == p)
        saved = sum((len(nodes[q]) - 1) * (len(q[-1][1]) if q else 0) for q in sub)
        out.append((members[0], len(p), nodes[p[:-1]][0] if p else None, len(members), len(children[p]), sum(not children[q] for q in sub), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=_key)


def _conversations():
    rng = random.Random(9)
    rows = []
    for c in [*range(180, 260), 400, 500, -7, 7, 2**40, *range(1000, 1060)]:
        n = rng.choice([1, 1, 2, 3, 8])
        for t in range(n):
            text = rng.choice(["hi", "né 中文 🙂", None, "", "bye\x00", "long " * 50]) if c < 1000 or c == 2**40 else "same"
            rows.append((c, t, rng.choice(["user", "assistant", None]) if c < 1000 else "user", text))
    rows += [(300, None, "user", "first"), (300, 0, "user", "b"), (300, 0, "user", "a"), (300, 0, "assistant", "z"), (300, 0, "user", "a")]
    rows += [(310, t, "user", f"turn {t}") for t in range(300)] + [(311, t, "user", f"turn {t}") for t in range(200)]
    rows += [(None, 0, "user", "nobody"), (None, 1, None, None)]
    return rows


@pytest.mark.parametrize("rebuild", [True, False])
def test_trie(spark, rebuild):
    rows = _conversations()
    df = spark.createDataFrame([(*r, 1, "o", 2) for r in rows], TURNS).repartition(4)
    turns = trie.turn_digests(df)
    found = trie.prefix_trie(trie.rebuilt(turns), ["part", "place"]) if rebuild else trie.prefix_trie(turns)
    assert sorted(map(tuple, found.collect()), key=_key) == _plain_trie(rows, rebuild)


def test_trie_of_nothing(spark):
    empty = trie.turn_digests(spark.createDataFrame([], TURNS))
    assert trie.prefix_trie(trie.rebuilt(empty), ["part", "place"]).collect() == []
    assert trie.prefix_trie(trie.turn_digests(spark.createDataFrame([(None, 0, "user", "x", 1, "", 1)], TURNS))).collect() == []


def test_members_of_a_node_are_cut_over_chunks(spark, monkeypatch):
    """A conversation that most others repeat: its list of members comes in many chunks and gives the same digest."""
    monkeypatch.setattr(trie, "CHUNK_BYTES", 40)
    monkeypatch.setattr(trie, "HOT_PART", 10)
    rows = [(c, t, "user", "again") for c in range(200) for t in range(2)] + [(c, 0, "user", "again") for c in range(200, 230)]
    df = spark.createDataFrame([(*r, 1, "o", 2) for r in rows], TURNS)
    assert sorted(map(tuple, trie.prefix_trie(trie.turn_digests(df)).collect()), key=_key) == _plain_trie(rows, False)


def test_tables_in_the_shared_folder_go(spark, monkeypatch, tmp_path):
    """Without spark.checkpoint.dir a local session has a folder of its own; an operator leaves its result there and nothing else."""
    import os

    from quaestor.llm import jaccard, storage

    kept = spark.conf.get("spark.checkpoint.dir", None)
    monkeypatch.setattr(storage, "shared_dir", lambda _: f"file://{tmp_path}")
    docs = spark.createDataFrame([(i, f"a b c d e f g {i % 3}") for i in range(20)], "doc_id long, text string")
    jaccard.link(docs).collect()
    assert len(os.listdir(tmp_path / "tables")) == 1
    assert spark.conf.get("spark.checkpoint.dir", None) == kept


def test_folder_where_none_is_set(spark):
    from quaestor.sources import shared

    class Conf:
        get = staticmethod(lambda key, default: default)

    class Session:
        conf, sparkContext = Conf, spark.sparkContext

    found = shared.shared_dir(Session)
    assert found.startswith("file:///") and shared.shared_dir(Session) == found


def test_names_are_found_as_spark_finds_them(spark):
    from quaestor.llm import decontaminate, mixing, quality

    text = " ".join(f"word{i} of" for i in range(60))
    docs = spark.createDataFrame([(1, text, "web")], "DOC_ID long, Text string, SOURCE string")
    assert quality.quality(docs).head().n_words == 120
    assert decontaminate.contamination(docs, spark.createDataFrame([(1, text)], "item_id long, text string")).head().contaminated
    assert mixing.mix(docs).head()["size"] == 120
    bare = docs.drop("Text")
    for run in (quality.quality, mixing.mix, lambda d: decontaminate.contamination(d, docs.selectExpr("1 AS item_id", "Text AS text"))):
        with pytest.raises(ValueError, match="no column 'text'"):
            run(bare)
    with pytest.raises(ValueError, match="no column 'source'"):
        mixing.mix(docs.drop("SOURCE"))
