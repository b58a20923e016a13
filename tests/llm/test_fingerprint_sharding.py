"""Fingerprints and shards."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from gridtide.llm import fingerprint as P
from gridtide.llm import sharding as S
from gridtide.llm.queries import QUERIES, SHARDS


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


@pytest.fixture(scope="module")
def pairs():
    rng = random.Random(3)
    base = [f"w{rng.randrange(4000)}" for _ in range(4000)]
    return [(k, " ".join(base[:n]), " ".join(base[n - m :])) for k, (n, m) in enumerate([(4000, 4000), (4000, 3000), (3000, 600), (800, 800)])]


def test_estimates_are_near_the_truth(spark, pairs):
    df = spark.createDataFrame(pairs, "id int, a string, b string")
    both = P.fingerprints(P.fingerprints(df, "a", "x"), "b", "y")
    out = both.select("id", P.likeness(F.col("x"), F.col("y")).alias("l"), P.containment(F.col("y"), F.col("x")).alias("c")).collect()
    for r in out:
        a, b = (shingles(t) for t in pairs[r["id"]][1:])
        assert abs(r["l"] - len(a & b) / len(a | b)) < 0.08
        assert abs(r["c"] - len(a & b) / len(b)) < 0.12


def test_sketches_merge(spark):
    rng = random.Random(4)
    left = " ".join(f"w{rng.randrange(900)}" for _ in range(700))
    right = " ".join(f"w{rng.randrange(900)}" for _ in range(500))
    df = spark.createDataFrame([(left, right)], "a string, b string")
    df = P.shingle_hashes(P.shingle_hashes(df, "a", "x"), "b", "y")
    whole = P.sketch(F.concat("x", "y"))
    merged = P.merge(P.sketch(F.col("x")), P.sketch(F.col("y")))
    assert df.select((whole == merged).alias("same")).first()["same"]


def test_equal_texts_have_equal_sketches_and_edges_are_defined(spark):
    rows = [(1, "A b C d e f"), (2, "a B c d e f"), (3, None), (4, ""), (5, " \n"), (6, "one two"), (6, "one two"), (7, "x " * 60_000)]
    df = spark.createDataFrame([(*r, [0]) for r in rows], "id int, text string, sketch array<int>")
    out = P.fingerprints(df).orderBy("id").collect()
    got = [(r["id"], list(r["sketch"])) for r in out]
    assert got[0][1] == got[1][1] != []
    assert got[2][1] == got[3][1] == got[4][1] == []
    assert len(got[5][1]) == 1 and got[5] == got[6]
    assert len(got[7][1]) == 1  # one distinct shingle, however long the text
    assert P.fingerprints(df.limit(0)).count() == 0
    like = spark.range(1).select(P.likeness(F.array().cast("array<long>"), F.array().cast("array<long>")).alias("x"))
    assert like.first()["x"] == 1.0


@pytest.mark.parametrize("parts", [1, 3, 50])
def test_next_row_wraps_around(spark, parts):
    rng = random.Random(6)
    ids = rng.sample(range(1000), 80)
    df = spark.createDataFrame([(i, f"t{i}", 1) for i in ids], "id long, text string, range int").repartition(4)
    out = {r["id"]: r["next_text"] for r in P.with_next(df, "id", ["text"], parts).collect()}
    order = sorted(ids)
    assert out == {i: f"t{n}" for i, n in zip(order, order[1:] + order[:1], strict=True)}


def test_next_row_with_ties_nulls_one_row_and_none(spark):
    rows = [(None, "n"), (1, "b"), (1, "a"), (1, "a"), (2, None), (3, "z")]
    df = spark.createDataFrame(rows, "id long, text string")
    out = sorted((r["id"] or 0, r["text"] or "", r["next_text"] or "") for r in P.with_next(df, "id", ["text"], 4).collect())
    assert out == [(0, "n", "a"), (1, "a", "a"), (1, "a", "b"), (1, "b", ""), (2, "", "z"), (3, "z", "n")]
    one = spark.createDataFrame([(5, "x")], "id long, text string")
    assert P.with_next(one, "id", ["text"], 3).first()["next_text"] == "x"
    assert P.with_next(one.limit(0), "id", ["text"], 3).count() == 0


def test_fingerprint_query_against_brute_force(spark, sf_dir):
    given = sorted((r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    out = {r["doc_id"]: r for r in QUERIES["op4_fingerprints"](spark, sf_dir).collect()}
    assert len(out) == len(given)
    same, errors = {}, {"near_edited": [], "near_next": []}
    for k, (doc, text) in enumerate(given):
        after = given[(k + 1) % len(given)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        r = out[doc]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert same.setdefault(text, r["fingerprint"]) == r["fingerprint"]
        assert same.setdefault(edited, r["edited_fingerprint"]) == r["edited_fingerprint"]
        for column, other in (("near_edited", edited), ("near_next", after)):
            a, b = shingles(text), shingles(other)
            errors[column].append(abs(r[column] - (len(a & b) / len(a | b) if a | b else 1.0)))
    for found in errors.values():
        assert sum(found) / len(found) < 0.03


def test_shard_query_against_brute_force(spark, sf_dir):
    given = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    out = QUERIES["op6_shards"](spark, sf_dir).collect()
    assert len(out) == len(given)
    loads, slots, homes, groups = [0] * SHARDS, [[] for _ in range(SHARDS)], {}, {}
    for r in out:
        data = given[r["doc_id"]]
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 16, zlib.crc32(data), "bytes", None)
        loads[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        assert homes.setdefault(data, r["shard"]) == r["shard"]
        groups[data] = groups.get(data, 0) + r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots)
    # Groups stay in one order, that of the texts' digests: no cuts in it have a smaller greatest shard.
    in_order = [groups[d] for d in sorted(groups, key=lambda d: hashlib.sha256(d).digest())]
    assert max(loads) <= least_capacity(in_order, SHARDS)


def test_cells_search_ranges_without_a_nested_loop(spark):
    rng = random.Random(1)
    edges = sorted(rng.sample(range(1, 100_000), 400))
    ranges = list(zip(edges[::2], edges[1::2], strict=True))
    places = rng.sample(range(1, 100_001), 5000)
    found = S._cells(spark.createDataFrame([(p,) for p in places], "place long").repartition(3), ranges, 1000)
    inside = [p for p in places if any(a <= p <= b for a, b in ranges)]
    assert found.count.sum() == len(inside)
    assert {*found.low.tolist(), *found.high.tolist()} <= set(inside)


def least_capacity(sizes, shards):
    low, high = max(sizes), sum(sizes)
    while low < high:
        c, used, held = (low + high) // 2, 1, 0
        for s in sizes:
            if held + s > c:
                used, held = used + 1, 0
            held += s
        low, high = (low, c) if used <= shards else (c + 1, high)
    return low


@pytest.mark.parametrize("most", [64, 1 << 16])
@pytest.mark.parametrize("shards", [1, 7, 40])
def test_capacity_is_the_least(spark, most, shards):
    rng = random.Random(shards)
    sizes = [rng.choice([16, 30, 200, 900, rng.randrange(16, 5000)]) for _ in range(1500)]
    if shards == 7:
        sizes[300] = 900_000  # a group far beyond an even share
    ends, at = [], 0
    for s in sizes:
        at += s
        ends.append((at,))
    capacity, cuts = S.find_cuts(spark.createDataFrame(ends, "place long"), shards, at, most)
    assert capacity == least_capacity(sizes, shards)
    assert len(cuts) == shards - 1 and cuts == sorted(cuts)
    loads = [b - a for a, b in zip([0, *cuts], [*cuts, at], strict=True)]
    assert max(loads) == capacity if shards == 7 else max(loads) <= capacity
    assert set(cuts) <= {e for (e,) in ends} | {0}
    if shards == 40:
        assert max(loads) - min(loads) < 3 * max(sizes)


def test_rows_groups_and_slots(spark):
    rng = random.Random(9)
    rows = [(k, f"g{rng.randrange(200)}" if k % 3 else "hot", rng.choice([None, 0, 20, 300]), "kept", k) for k in range(3000)]
    rows += [(10_000, None, 50, "kept", 1), (10_000, None, 50, "kept", 1), (None, "g1", 7, "kept", 1)]
    df = spark.createDataFrame(rows, "doc_id long, same string, size long, place string, slot long").repartition(5)
    out = S.shard_rows(df, "same", "doc_id", "size", 10).collect()
    assert len(out) == len(rows) and out[0].asDict().keys() == {"doc_id", "same", "size", "place", "shard", "slot"}
    of = {}
    for r in out:
        of.setdefault(r["same"], set()).add(r["shard"])
    assert all(len(s) == 1 for s in of.values())
    by = {}
    for r in out:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert set(by) <= set(range(10))
    again = S.shard_rows(df.repartition(2), "same", "doc_id", "size", 10).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))


def test_empty_table_and_more_shards_than_groups(spark):
    df = spark.createDataFrame([(1, "a", 5), (2, "b", 5)], "doc_id long, same string, size long")
    assert S.shard_rows(df.limit(0), "same", "doc_id", "size", 4).collect() == []
    out = S.shard_rows(df, "same", "doc_id", "size", 4).collect()
    assert len({r["shard"] for r in out}) == 2 and {r["slot"] for r in out} == {0}
