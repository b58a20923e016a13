"""Hard negatives against scoring every pair; bounds that save work; odd rows."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridtide.llm import negatives


def brute(rows, is_anchor, positives=5, count=10, low=30, high=90):
    """rows: (id, label, vector or None)."""
    live = []
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        live.append((i, label, [math.floor(256 * x) for x in v]))
    out = []
    for a, la, va in live:
        if not is_anchor(a):
            continue
        scored = sorted(((sum(x * y for x, y in zip(va, v)), i, l) for i, l, v in live), key=lambda t: (-t[0], t[1]))
        for ps, p, _ in [t for t in scored if t[2] == la and t[1] != a][:positives]:
            good = [(s, i) for s, i, l in scored if l != la and low * ps <= 100 * s <= high * ps]
            out += [(a, p, k + 1, i, ps, s) for k, (s, i) in enumerate(good[:count])]
    return sorted(out)


def mined(spark, rows, every=4, **options):
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").repartition(3)
    whole = df.select("vec_id", "label", negatives.whole_vectors("embedding").alias("v"))
    return sorted(tuple(r) for r in negatives.mine_negatives(whole, F.col("vec_id") % every == 0, **options).collect())


def vectors(n, dims, seed, labels=3, clustered=True):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(labels, dims)) * (1 if clustered else 0) + 0.4
    rows = []
    for i in range(n):
        label = int(rng.integers(labels))
        rows.append((i, label, np.float32(centres[label] + rng.normal(size=dims) * 0.4).tolist()))
    return rows


@pytest.mark.parametrize("clustered", [True, False])
def test_equal_to_scoring_all_pairs(spark, clustered):
    rows = vectors(220, 8, 3, clustered=clustered)
    assert mined(spark, rows) == brute(rows, lambda i: i % 4 == 0)


def test_blocks_and_many_trees(spark, monkeypatch):
    for name, value in (("TREE", 7), ("BUNDLE", 14), ("GROUP", 40), ("SLICE", 9), ("LEAST_GROUP", 16)):
        monkeypatch.setattr(negatives, name, value)
    rows = vectors(260, 6, 9)
    assert mined(spark, rows, positives=3, negatives=4) == brute(rows, lambda i: i % 4 == 0, 3, 4)


def test_ties_copies_and_odd_rows(spark):
    rng = random.Random(2)
    rows = [(i, i % 2, [1.0, 0.5]) for i in range(0, 60)]  # one vector in most rows
    rows += [(100 + i, i % 3, [rng.uniform(-1, 1), rng.uniform(-1, 1)]) for i in range(40)]
    rows += [(200, None, [1.0, 1.0]), (204, 1, None), (208, 1, [1.0, None]), (212, 1, [float("nan"), 1.0]), (216, 0, [float("inf"), 0.0]), (None, 1, [1.0, 1.0])]
    rows += [(220, 1, [0.5]), (224, 2, []), (228, 1, [0.25, 0.25, 0.0])]
    padded = [(i, label, v if v is None else (v + [0.0] * 3)[:3]) for i, label, v in rows]
    assert mined(spark, rows) == brute(padded, lambda i: i % 4 == 0)


def test_repeated_rows_take_places_of_their_own(spark):
    rows = [(0, 0, [1.0, 1.0]), (4, 0, [1.0, 0.9]), (4, 0, [1.0, 0.9]), (5, 1, [0.5, 0.5]), (5, 1, [0.5, 0.5])]
    found = [r for r in mined(spark, rows, positives=5) if r[0] == 0]
    assert [(r[1], r[2], r[3]) for r in found] == [(4, 1, 5), (4, 1, 5), (4, 2, 5), (4, 2, 5)]


def test_empty_tables(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, 0, [1.0]), (2, 1, [1.0])]) == []  # no anchor
    assert mined(spark, [(4, 0, [1.0]), (8, 0, [1.0])]) == []  # one label


def test_too_large_components_fail(spark):
    with pytest.raises(Exception, match="53 bits"):
        mined(spark, [(4, 0, [1e12]), (5, 0, [1e12]), (6, 1, [1e12])])


def test_bounds_spare_work():
    """Anchors close together: most rows are ruled out without being scored."""
    rng = np.random.default_rng(5)
    points = np.floor(rng.normal(size=(1, 16)) * 256 + rng.normal(size=(50, 16)) * 4)
    order, above, edge = negatives.spanning_tree(points)
    points = points[order]
    rows = np.floor(rng.normal(size=(2000, 16)) * 256)
    labels = rng.integers(0, 2, 2000)
    search = negatives.Search(np.arange(50), np.zeros(50, int), points, above, edge, [[(-math.inf, math.inf)]] * 50, True, 5)
    for a in range(0, 2000, 500):
        search.add(np.arange(1000 + a, 1500 + a), labels[a : a + 500], rows[a : a + 500])
    scores = points @ rows.T
    for i, _, best in search.found():
        wanted = sorted((-s, 1000 + j) for j, s in enumerate(scores[i]) if labels[j] == 0)[:5]
        assert [(-s, j) for j, s in best.T.tolist()] == wanted
    assert search.rescored < search.asked / 3


def test_spanning_tree_is_minimal():
    rng = np.random.default_rng(1)
    v = rng.integers(-50, 50, (40, 3)).astype(float)
    order, above, edge = negatives.spanning_tree(v)
    assert sorted(order.tolist()) == list(range(40)) and above[0] == -1
    assert all(above[k] < k for k in range(1, 40))
    for k in range(1, 40):
        assert edge[k] == pytest.approx(np.linalg.norm(v[order[k]] - v[order[above[k]]]))
    # Kruskal
    root = list(range(40))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    total = 0.0
    for d, i, j in sorted((np.linalg.norm(v[i] - v[j]), i, j) for i in range(40) for j in range(i)):
        if top(i) != top(j):
            root[top(i)] = top(j)
            total += d
    assert edge.sum() == pytest.approx(total)


def test_found_groups_by_positive(spark):
    rows = vectors(120, 5, 12)
    ranks = defaultdict(list)
    for a, p, k, *_ in mined(spark, rows):
        ranks[a, p].append(k)
    assert all(sorted(k) == list(range(1, len(k) + 1)) for k in ranks.values())
