"""Hard negatives, Jaccard join and spelling variants against brute force in plain Python."""

import itertools
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from basketry.llm import hard_negatives, queries, signature_join, spelling

VECTORS = "vec_id long, embedding array<float>, label int, uid string, score string"


def _negatives(rows, positives=5, negatives=3):
    rows = [
        (i, [max(-hard_negatives.LIMIT, min(hard_negatives.LIMIT, math.floor(256 * x))) for x in v], c)
        for i, v, c in rows
        if c is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    order = lambda r: (-r[0], r[1] is None, r[1] or 0)
    out = []
    for a, (i, v, c) in enumerate(rows):
        if i is None or i % 50:
            continue
        met = [(dot(v, w), j, d) for b, (j, w, d) in enumerate(rows) if b != a and len(v) == len(w)]
        for p, j, _ in sorted((r for r in met if r[2] == c), key=order)[:positives]:
            hard = sorted((r for r in met if r[2] != c and 50 * p <= 100 * r[0] <= 95 * p), key=order)[:negatives]
            out += [(i, j, k + 1, m, p, s) for k, (s, m, _) in enumerate(hard)]
    return sorted(out, key=str)


def _vectors(seed, n):
    rng = random.Random(seed)
    half = lambda: rng.choice([-1.0, -0.5, 0.0, 0.25, 0.5, 1.0]) * rng.choice([1.0, 0.3])
    rows = [(rng.choice([i, i, i, 50 * rng.randint(0, 3)]), [half() for _ in range(rng.choice([7, 7, 7, 20]))], rng.choice([0, 0, 1, 2])) for i in range(n)]
    rows += rows[:20] + [(None, [0.5] * 7, 0), (None, [0.4] * 7, 1), (100, None, 0), (150, [0.5] * 7, None), (200, [], 0), (250, [], 1)]
    return rows + [(300, [float("nan")] * 7, 0), (350, [None] * 7, 1), (400, [float("inf")] * 7, 1), (450, [3e7] * 7, 0), (451, [2e7] * 7, 0), (452, [-3e7] * 7, 1)]


@pytest.mark.parametrize("block", [1 << 20, 64])
def test_hard_negatives(spark, monkeypatch, block):
    monkeypatch.setattr(hard_negatives, "BLOCK", block)
    n = 120 if block == 64 else 300
    rows = _vectors(block, n)
    as_float = spark.createDataFrame([(*r, "x", "y") for r in rows], VECTORS).repartition(3)
    held = [(r.vec_id, r.embedding, r.label) for r in as_float.collect()]
    got = hard_negatives.mine_hard_negatives(as_float, F.col("vec_id") % 50 == 0).collect()
    assert sorted((tuple(r) for r in got), key=str) == _negatives(held)


def test_hard_negatives_of_nothing(spark):
    assert hard_negatives.mine_hard_negatives(spark.createDataFrame([], VECTORS), F.col("vec_id") % 50 == 0).count() == 0


def test_bounds_hold(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    x, y = rng.integers(-300, 300, (40, 37)).astype(float), rng.integers(-300, 300, (50, 37)).astype(float)
    sx, sy = hard_negatives.summaries(x), hard_negatives.summaries(y)
    at, width_before = 0, math.inf
    for width in hard_negatives.grains(37):
        starts = np.arange(0, 37, width)
        w, k = np.diff(np.append(starts, 37)), len(starts)
        middle = (sx[:, at : at + k] * w) @ sy[:, at : at + k].T
        spread = (sx[:, at + k : at + 2 * k] * w) @ sy[:, at + k : at + 2 * k].T
        assert (np.abs(x @ y.T - middle) <= spread + 1e-6).all()
        assert spread.mean() < width_before  # finer segments bound more closely
        width_before, at = spread.mean(), at + 2 * k


def _components(rows, n, percent):
    sets = []
    for _, text in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    least = {i: i for i, _ in rows if i is not None}

    def root(i):
        while least[i] != i:
            i = least[i]
        return i

    for (a, s), (b, t) in itertools.combinations([(i, s) for (i, _), s in zip(rows, sets) if i is not None and s], 2):
        if 100 * len(s & t) >= percent * len(s | t):
            x, y = root(a), root(b)
            least[max(x, y)] = min(x, y)
    return sorted(((i, len(s), None if i is None else root(i)) for (i, _), s in zip(rows, sets)), key=str)


def _texts(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [f"p{i}" for i in range(60)]
    bases = [rng.choices(vocabulary, k=rng.choice([3, 20, 60, 200])) for _ in range(12)]
    rows = []
    for i in range(n):
        w = list(rng.choice(bases)) if rng.random() < 0.8 else rng.choices(vocabulary, k=30)
        for _ in range(rng.choice([0, 0, 1, 2, 5])):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        if rng.random() < 0.3:
            w = passage + w
        rows.append((i, " \t\n"[rng.randrange(3)].join(w).title()))
    rows += [(rows[3][0], rows[7][1]), rows[5], (None, rows[5][1]), (None, None), (n, None), (n + 1, " \n"), (n + 2, "one"), (n + 3, "ONE"), (n + 4, "one two")]
    return rows + [(n + 5, " ".join(f"v{i}" for i in range(9000))), (n + 6, " ".join(f"v{i}" for i in range(8900)))]


@pytest.mark.parametrize("tree,n,percent", [(1024, 4, 85), (5, 4, 85), (16, 3, 60)])
def test_jaccard_components(spark, monkeypatch, tree, n, percent):
    monkeypatch.setattr(signature_join, "TREE", tree)
    rows = _texts(tree, 150)
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, uid string, n string").repartition(3)
    got = signature_join.jaccard_components(docs, n, percent)
    assert sorted((tuple(r) for r in got.collect()), key=str) == _components(rows, n, percent)


def test_jaccard_components_of_nothing(spark):
    assert signature_join.jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_trees_find_links_across(spark):
    """Two trees against each other and one tree in itself give the links that comparing all pairs gives."""
    import numpy as np

    rng = np.random.default_rng(3)
    base = [np.unique(rng.integers(-(2**62), 2**62, rng.integers(1, 300))) for _ in range(15)]
    sets = []
    for _ in range(150):
        s = base[rng.integers(15)]
        sets.append(np.unique(np.append(s[rng.random(len(s)) > 0.06], rng.integers(0, 2**62, rng.integers(1, 4)))))
    linked = lambda a, b: 100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b))

    def groups(pairs):
        root = list(range(len(sets)))
        for i, j in pairs:
            x, y = root[i], root[j]
            root = [min(x, y) if r in (x, y) else r for r in root]
        return root

    forest = signature_join._Forest(np.arange(150), sets, 80)
    forest.traverse(np.arange(150))
    assert forest.roots().tolist() == groups((i, j) for i in range(150) for j in range(i) if linked(sets[i], sets[j]))
    for cut in (1, 40, 75):
        forest = signature_join._Forest(np.arange(150), sets, 80)
        forest.traverse(np.arange(cut), np.arange(cut, 150))
        assert forest.roots().tolist() == groups((i, j) for i in range(cut) for j in range(cut, 150) if linked(sets[i], sets[j]))


def _edits(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def _variants(count, ratio=10):
    near = {w: [v for v in count if _edits(w, v)] for w in count}
    form = {}
    for w in count:
        best = min(near[w], key=lambda v: (-count[v], v), default=None)
        form[w] = best if best is not None and count[best] >= ratio * count[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted(((w, form[w], root(w), count[w], len(near[w]), count[form[w]] if form[w] else None) for w in count), key=str)


@pytest.mark.parametrize("tile,bucket", [(1024, 512), (4, 3), (8, 1 << 20)])
def test_spelling_groups(spark, monkeypatch, tile, bucket):
    monkeypatch.setattr(spelling, "TILE", tile)
    monkeypatch.setattr(spelling, "BUCKET", bucket)
    rng = random.Random(tile)
    words = {"".join(rng.choices("abcé", k=rng.choice([1, 2, 3, 7, 8, 9, 12]))) for _ in range(150)}
    for w in list(words) * 3:
        i = rng.randrange(len(w) + 1)
        words.add(w[:i] + rng.choice(["", "x", "é"]) + w[i + rng.choice([0, 1]) :])
    words.discard("")
    count = {w: rng.choice([1, 2, 2, 3, 25, 300, 4000, 60000]) for w in words}
    rows = [(w, n, "x") for w, n in count.items()] + [(None, 3, "x"), ("", 9, "x"), ("null", None, "x")]
    first = next(iter(count))
    rows += [(first, 5, "x")]  # repeated words add up
    count[first] += 5
    got = spelling.group_variants(spark.createDataFrame(rows, "word string, n long, bucket string"))
    got = [tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in got.collect()]
    assert sorted(got, key=str) == _variants(count)


def test_spelling_of_nothing(spark):
    assert spelling.group_variants(spark.createDataFrame([], "word string, n long")).count() == 0


def test_spelling_query(spark, tmp_path):
    """The query's words, drops included, from whole texts with odd letters, null ids and null texts."""
    rng = random.Random(9)
    stems = ["Straßenbahn", "ÀÉÎÕÜÿþx", "perhaps", "Perhaps", "somethings", "somethin×", "short", "𝒳abcdefgh𝒳", "x" * 3000]
    texts = [" ".join(rng.choices(stems, k=40)) + rng.choice([".", "-ab", "1", ""]) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[0]), (None, None), (99, None), (98, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    count = {}
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                count[run] = count.get(run, 0) + 1
    got = queries.op13_spelling(spark, str(tmp_path))
    got = [tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in got.collect()]
    assert sorted(got, key=str) == _variants({w: n for w, n in count.items() if n >= 2})
