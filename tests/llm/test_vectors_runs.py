"""Clustering, exact search and periodic runs against brute force."""

import hashlib
import math
import random

import numpy as np
import pytest

from loomfield.llm import centroids, runs, topk_search
from pyspark.sql import functions as F

VECTORS = "vec_id long, embedding array<float>, label int, v string, row string, cluster string"


def vectors(spark, rows):
    """Extra columns have names that the operators use inside."""
    return spark.createDataFrame([(i, v, 0, "x", "y", "z") for i, v in rows], VECTORS)


def spread(seed, n, d, groups=5, scale=0.2):
    r = np.random.default_rng(seed)
    middle = r.normal(size=(groups, d)) * scale
    return [[float(np.float32(x)) for x in middle[r.integers(groups)] + r.normal(size=d) * scale / 3] for _ in range(n)]


def odd_rows(d):
    nan, inf = float("nan"), float("inf")
    return [(900, None), (901, [None] + [0.5] * (d - 1)), (902, [nan] * d), (903, [inf] + [0.0] * (d - 1)), (904, [0.1] * (d + 1)), (905, []), (906, [3e38] * d), (None, [0.3] * d), (908, [0.0] * d), (908, [0.0] * d)]


def whole(v):
    return [math.floor(64 * x) for x in v]


def by_hand(rows, k, rounds, d):
    """Centroids and nearest ones in plain Python."""
    good = [(i, whole(v)) for i, v in rows if v is not None and len(v) == d and all(x is not None and abs(x) < 1e6 for x in v)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1])
    c = [v for _, v in sorted(good, key=key)[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for step in range(rounds + 1):
        at = [min((far(v, x), j) for j, x in enumerate(c)) for _, v in good]
        if step < rounds:
            for j in range(len(c)):
                mine = [v for (_, v), (_, a) in zip(good, at, strict=True) if a == j]
                if mine:
                    c[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    return sorted((str(i), j, x) for (i, _), (x, j) in zip(good, at, strict=True)), c


@pytest.mark.parametrize("k,d,n", [(4, 3, 150), (16, 64, 300), (5, 2, 3)])
def test_clusters_equal_brute_force(spark, k, d, n):
    rows = list(enumerate(spread(k, n, d))) + odd_rows(d)
    rows += [(2000 + i, rows[0][1]) for i in range(40)]  # a vector that many rows share
    got = centroids.cluster(vectors(spark, rows), k=k, length=d)
    want, middle = by_hand(rows, k, 3, d)
    assert sorted((str(r.vec_id), r.cluster, r.distance) for r in got.assigned.collect()) == want
    assert [r.centroid for r in got.centroids.orderBy("cluster").collect()] == middle


def test_clusters_of_nothing_and_of_equal_rows(spark):
    assert centroids.cluster(vectors(spark, []), length=3).assigned.collect() == []
    same = centroids.cluster(vectors(spark, [(i, [0.5, 0.5, 0.5]) for i in range(9)]), k=4, length=3)
    assert {(r.cluster, r.distance) for r in same.assigned.collect()} == {(0, 0)} and same.centroids.count() == 4


def test_bounds_never_exceed_distances_and_spare_work():
    r = np.random.default_rng(3)
    for scale in (3, 40, 2**20, 2**26):
        middle = r.integers(-scale, scale + 1, (12, 64))
        x = middle[r.integers(12, size=500)] + r.integers(-max(scale // 4, 1), max(scale // 4, 1) + 1, (500, 64))
        pivots = centroids.choose_pivots(middle)
        table = lambda rows: np.stack([centroids.squared(rows, p) for p in pivots], 1)  # noqa: E731, B023
        real = np.stack([centroids.squared(x, c) for c in middle], 1)
        low = centroids.lower_bounds(table(x), table(middle), table(pivots))
        assert (low <= real).all() and low.max() > 0
        best, distance, done = centroids.nearest(x, table(x), middle, pivots)
        assert (best == real.argmin(1)).all() and (distance == real.min(1)).all()
        if scale > 3:
            assert done < 0.8 * real.size


def top_by_hand(rows, k, asks):
    good = [(i, whole(v)) for i, v in rows if v is not None and all(x is not None and abs(x) < 1e6 for x in v)]
    out = []
    for n, (i, q) in enumerate(good):
        if i is not None and asks(i):
            met = [(-sum(x * y for x, y in zip(q, v, strict=True)), j is None, j) for m, (j, v) in enumerate(good) if m != n and len(v) == len(q)]
            out += [(i, rank + 1, j, -s) for rank, (s, _, j) in enumerate(sorted(met, key=lambda t: (t[0], t[1], t[2] or 0))[:k])]
    return sorted(map(str, out))


@pytest.mark.parametrize("d,n,scale", [(3, 60, 0.05), (20, 200, 0.2), (64, 300, 0.2), (64, 200, 900.0)])
def test_search_equals_brute_force(spark, d, n, scale, monkeypatch):
    monkeypatch.setattr(topk_search, "STRIP", 90)
    monkeypatch.setattr(topk_search, "ASKING", 20)
    rows = list(enumerate(spread(d, n, d, scale=scale))) + odd_rows(d)
    rows += [(2000 + i, rows[0][1]) for i in range(40)] + [(5, rows[5][1])] * 2
    got = topk_search.search(vectors(spark, rows), F.col("vec_id") % 5 == 0, k=7)
    assert sorted(str((r.query_id, r["rank"], r.vec_id, r.score)) for r in got.collect()) == top_by_hand(rows, 7, lambda i: i % 5 == 0)


def test_search_with_few_candidates_or_none(spark):
    ask = F.col("vec_id") % 20 == 0
    assert topk_search.search(vectors(spark, []), ask).collect() == []
    assert topk_search.search(vectors(spark, [(0, [1.0])]), ask).collect() == []
    assert topk_search.search(vectors(spark, [(1, [1.0]), (2, [1.0])]), ask).collect() == []
    assert [tuple(r) for r in topk_search.search(vectors(spark, [(0, [1.0]), (3, [-1.0])]), ask).collect()] == [(0, 1, 3, -4096)]


def test_bounds_drop_candidates_and_no_result():
    r = np.random.default_rng(1)
    x = r.integers(-20, 21, (64, 3000)).astype(float)
    q = x[:, :30] + r.integers(-3, 4, (64, 30))
    left = lambda v: [np.sqrt((v[i:] ** 2).sum(0)) * (1 + topk_search.WIDER) for i in range(16, 64, 16)]
    a, b, s = topk_search._summed(q.T, x, left(q), left(x), np.full(30, -np.inf), 5)
    real = q.T @ x
    assert len(a) < real.size / 3 and (s == real[a, b]).all()
    kept = set(zip(a.tolist(), b.tolist(), strict=True))
    for i in range(30):
        assert {(i, j) for j in np.argsort(-real[i], kind="stable")[:5].tolist()} <= kept


def runs_by_hand(w, least=12):
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, 2 * q):
                found.setdefault((i, j + q), q)
            i = max(j, i) + 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def loops(r):
    n = r.randint(0, r.choice([12, 40, 200]))
    w = [r.choice("abcdefghijklmnopqrstuvwxyz"[: r.choice([1, 2, 2, 3, 5, 26])]) for _ in range(n)]
    for _ in range(r.randint(0, 3) if n else 0):
        a, p = r.randrange(n), r.randint(1, 30)
        part = w[a : a + p]
        w[a + len(part) : a + len(part)] = [part[i % len(part)] for i in range(r.randint(1, 120))]
    return w


def test_runs_equal_brute_force_over_many_documents():
    r = random.Random(11)
    for _ in range(400):
        docs = [loops(r) for _ in range(r.randint(1, 5))]
        assert runs.batch_runs([" ".join(w) for w in docs])[0] == [runs_by_hand(w) for w in docs]


def test_every_gap_is_one_boundary_and_rules_repeat():
    r = random.Random(2)
    for _ in range(50):
        w = np.array([ord(c) for c in loops(r)], np.int64)
        rules = runs.repair(w)
        crossed = [p + left for i, left in enumerate(rules.left.tolist()) for p in rules.at[rules.first[i] : rules.first[i + 1]].tolist()]
        assert sorted(crossed + rules.heads.tolist()) == list(range(len(w)))
        for i, n in enumerate(rules.length.tolist()):
            at = rules.at[rules.first[i] : rules.first[i + 1]].tolist()
            assert len(at) > 1 and len({tuple(w[p : p + n]) for p in at}) == 1


def test_run_frames(spark):
    far = " ".join("x y z".split() * 20_000)
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "a " * 11), (5, "a " * 12), (5, "a " * 12), (None, "p q " * 9 + "r"), (7, far), (8, "é ü 𝄞 " * 5), (9, "a a\x85b " * 6)]
    df = spark.createDataFrame([(i, t, "c", "d") for i, t in rows], "doc_id long, text string, runs string, id string")
    got = sorted((str(r.doc_id), [tuple(x) for x in r.runs], r.collapsed) for r in runs.find_runs(df).collect())
    want = [("1", [], ""), ("2", [], ""), ("3", [], ""), ("4", [], "a " * 10 + "a"), ("5", [(0, 12, 1)], "a"), ("5", [(0, 12, 1)], "a"), ("None", [(0, 18, 2)], "p q r"), ("7", [(0, 60_000, 3)], "x y z"), ("8", [(0, 15, 3)], "é ü 𝄞"), ("9", [(0, 12, 2)], "a a\x85b")]
    assert got == sorted(want)
    assert runs.find_runs(df.limit(0)).collect() == []
