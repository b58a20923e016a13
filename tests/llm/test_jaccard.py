"""The parity-sketch join against all pairs."""

import random

import numpy as np
import pytest

from gridtide.llm import components as components_module
from gridtide.llm import jaccard
from gridtide.llm.components import components


def brute(rows, percent=75):
    sets = {}
    for i, t in rows:
        w = (t or "").lower().split()
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    top = {i: i for i in sets}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for a in sets:
        for b in sets:
            common = len(sets[a] & sets[b])
            if a < b and common and 100 * common >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def edited(words, rng, share):
    out = list(words)
    for k in rng.sample(range(len(out)), int(len(out) * share)):
        out[k] = f"n{rng.randrange(10**6)}"
    return out


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    rows, n = [], 0
    for size in [1, 2, 4, 5, 6, 7, 8, 9, 10, 12, 15, 20, 30, 50, 80, 130, 200, 400, 900]:
        base = [f"w{rng.randrange(300)}" for _ in range(size)]
        for _ in range(8):
            rows.append((n, " ".join(base)))
            base = edited(base, rng, rng.choice([0, 0.01, 0.02, 0.03, 0.05]))
            if rng.random() < 0.4:
                base = base + [f"t{rng.randrange(50)}" for _ in range(max(1, size // rng.choice([4, 8, 20])))]
            n += 1
    passage = [f"p{k}" for k in range(60)]
    for _ in range(60):
        rows.append((n, " ".join([f"q{rng.randrange(10**6)}" for _ in range(40)] + passage)))
        n += 1
    rows += [(n, None), (n + 1, ""), (n + 2, " \t\n"), (n + 3, "Solo"), (n + 4, "solo"), (n + 5, "solo x")]
    rng.shuffle(rows)
    return rows


def result(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


def test_equals_all_pairs(spark, corpus):
    df = spark.createDataFrame(corpus, "doc_id long, text string").repartition(3)
    assert result(jaccard.near_duplicates(df)) == brute(corpus)


def test_hot_signatures_are_spread_and_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "HOT", 5)
    rng = random.Random(1)
    base = [f"w{k}" for k in range(120)]
    rows = [(k, " ".join(edited(base, rng, 0.02))) for k in range(300)] + [(1000 + k, " ".join(base)) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    assert result(jaccard.near_duplicates(df)) == brute(rows)


def test_a_group_of_near_copies_meets_a_few_times(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "HOT", 5)
    rng = random.Random(8)
    base = [f"w{k}" for k in range(150)]
    rows = [(k, " ".join(edited(base, rng, 0.01))) for k in range(400)] + [(1000 + k, " ".join([f"v{k}.{j}" for j in range(60)])) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    placed, store = [], jaccard._by_meeting
    monkeypatch.setattr(jaccard, "_by_meeting", lambda rows, buckets: placed.append(rows.count()) or store(rows, buckets))
    assert result(jaccard.near_duplicates(df)) == brute(rows)
    assert placed[0] <= 12 * len(rows)


def test_few_rows_take_few_tasks_whatever_the_shuffle_partitions(spark, corpus, monkeypatch):
    beside = spark.newSession()
    beside.conf.set("spark.sql.shuffle.partitions", "24")
    beside.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    files = []
    for module in (jaccard, components_module):
        store = module.stored

        def counted(df, label, store=store):
            out = store(df, label)
            files.append((label, len(out.inputFiles())))
            return out

        monkeypatch.setattr(module, "stored", counted)
    df = beside.createDataFrame(corpus, "doc_id long, text string").coalesce(3)
    assert result(jaccard.near_duplicates(df)) == brute(corpus)
    assert {"nodes", "meetings", "pairs", "links", "edges", "places", "nearest"} <= {label for label, _ in files}
    most = spark.sparkContext.defaultParallelism
    assert [x for x in files if x[1] > most] == []


def test_hot_meetings_of_like_members_are_one_and_keep_every_pair(spark):
    sets = {1: range(100), 2: range(100), 3: range(1, 100), 4: range(2, 99), 5: range(500, 520), 6: [0, 500]}
    rows = [(True, m, i, 0) for m, ids in sets.items() for i in ids] + [(False, 0, 700, 0)]
    found = {}
    for r in jaccard._hot_gathered(spark.createDataFrame(rows, "hot boolean, meeting long, id long, lead long")).collect():
        assert r["hot"]
        found.setdefault(r["meeting"], set()).add(r["id"])
    assert len(found) <= 5
    assert all(any(set(ids) <= members for members in found.values()) for ids in sets.values())


def test_pieces_of_a_large_group_lose_nothing(spark, corpus, monkeypatch):
    monkeypatch.setattr(jaccard, "PIECE", 7)
    df = spark.createDataFrame(corpus, "doc_id long, text string").repartition(3)
    assert result(jaccard.near_duplicates(df)) == brute(corpus)


def test_other_similarity(spark, corpus):
    few = corpus[:110]
    df = spark.createDataFrame(few, "doc_id long, text string")
    assert result(jaccard.near_duplicates(df, percent=50)) == brute(few, 50)


def test_repeated_rows_shared_ids_null_ids_and_other_columns(spark):
    a, b, c = ("one two three four five six", "seven eight nine ten eleven twelve", "r s t u v w")
    rows = [(5, a, 1), (5, a, 2), (3, a, 0), (5, b, 0), (9, b, 0), (None, a, 0), (7, c, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id int")
    got = sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"] or 0) for r in jaccard.near_duplicates(df).collect())
    assert got == [(0, 2, 0), (3, 2, 3), (5, 2, 3), (5, 2, 3), (5, 2, 3), (7, 2, 7), (9, 2, 3)]


def test_empty_table(spark):
    assert jaccard.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_bit_sketches_bound_the_difference_from_below():
    rng = np.random.default_rng(3)
    for n in (1, 3, 40, 500):
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        for lost in (0, 1, n // 5):
            b = np.unique(np.concatenate((a[lost:], rng.integers(0, 2**63, lost).astype(np.uint64))))
            linked = 100 * len(np.intersect1d(a, b)) >= 75 * len(np.union1d(a, b))
            assert not linked or jaccard.may_link(len(a), jaccard.bit_sketch(a), len(b), jaccard.bit_sketch(b), 75)


def test_bands_hold_every_pair_of_sizes_that_can_be_linked():
    cut = jaccard.bands(75, 12)
    held = {k: (cut.first[k], max(cut.last[k], cut.partner[k]), cut.segments[k]) for k in range(len(cut.segments))}
    for a in range(1, 300):
        for b in range(a, a * 100 // 75 + 1):
            differ = (a + b) * 25 // 175
            assert any(low <= a <= b <= high and segments > differ for low, high, segments in held.values())


def test_components_of_a_path_a_star_and_a_loop(spark):
    path = [(k, k + 1) for k in range(0, 40)]
    star = [(100, 100 + k) for k in range(1, 30)]
    rows = path + star + [(300, 300), (400, 401), (401, 400), (500, None)]
    random.Random(2).shuffle(rows)
    got = {r["u"]: r["v"] for r in components(spark.createDataFrame(rows, "u long, v long")).collect()}
    assert got == {**{k: 0 for k in range(1, 41)}, **{100 + k: 100 for k in range(1, 30)}, 401: 400}
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []
