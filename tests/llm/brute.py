"""Plain versions of the operators, for small tables."""

import hashlib
import re
from collections import Counter

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text, lower=False):
    return WORD.findall((text or "").translate(UP) if lower else text or "")


def substring(rows, k=13):
    least = {}
    for i, t in rows:
        w = words(t)
        for s in range(len(w) - k + 1):
            g = tuple(w[s : s + k])
            if i is not None:
                least[g] = min(least.get(g, i), i)
    out = []
    for i, t in rows:
        w = words(t)
        gone = set()
        for s in range(len(w) - k + 1):
            m = least.get(tuple(w[s : s + k]))
            if m is not None and (i is None or m < i):
                gone |= set(range(s, s + k))
        kept = " ".join(x for n, x in enumerate(w) if n not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def shingles(text, k):
    w = words(text, lower=True)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def components(rows, percent=80, k=5):
    sets = [shingles(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(rows):
        if i is not None:
            least[find(a)] = min(least.get(find(a), i), i)
    return [(i, len(sets[a]), least.get(find(a))) for a, (i, _) in enumerate(rows)]


def contamination(rows, items, k=10):
    windows = {}
    for item, t in items:
        w = ITEM_WORD.findall((t or "").translate(UP))
        m = min(k, len(w))
        for s in range(len(w) - m + 1) if w else ():
            windows.setdefault(tuple(w[s : s + m]), set()).add(item)
    out = []
    for i, t in rows:
        w = ITEM_WORD.findall((t or "").translate(UP))
        hit, found = set(), set()
        for g, ids in windows.items():
            for s in range(len(w) - len(g) + 1):
                if tuple(w[s : s + len(g)]) == g:
                    hit |= set(range(s, s + len(g)))
                    found |= ids
        ids = sorted(str(x) for x in found if x is not None)
        out.append((i, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return out


def quality_counts(text):
    w, t = words(text), text or ""
    lines = [x for x in t.split("\n") if words(x)]
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    again = set()
    for i in range(len(w) - 2):
        if grams[tuple(w[i : i + 3])] > 1:
            again |= {i, i + 1, i + 2}
    failed = len(w) < 50 or 100 * len(again) > 50 * len(w)
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(again), failed)


def mixing(rows, seed=7):
    """(doc_id, size, source_size, target, taken) of rows (doc_id, source, text)."""
    size = [len(words(t)) for _, _, t in rows]
    names = sorted({s for _, s, _ in rows if s is not None}) + [None] * any(s is None for _, s, _ in rows)
    whole = {n: sum(z for z, r in zip(size, rows) if r[1] == n) for n in names}
    weight = {n: (5, 2, 1)[k % 3] for k, n in enumerate(names)}
    left, free, target = 1.5 * sum(whole.values()), set(names), {}
    while free:
        level = left / sum(weight[n] for n in free)
        over = {n for n in free if weight[n] * level >= 2 * whole[n]}
        if not over:
            target |= {n: weight[n] * level for n in free}
            break
        for n in over:
            target[n] = 2.0 * whole[n]
            left -= target[n]
        free -= over
    draw = lambda i: hashlib.md5(f"{seed}:{'null' if i is None else i}".encode()).hexdigest()
    out = []
    for (i, s, _), z in zip(rows, size):
        times = int(target[s] // whole[s]) if whole[s] else 0
        rest = target[s] - times * whole[s]
        upto = sum(y for (j, r, _), y in zip(rows, size) if r == s and (draw(j), j) <= (draw(i), i))
        out.append((i, z, whole[s], target[s], z * (times + (rest > 0 and upto - z / 2 <= rest))))
    return out
