"""Packing: ids against the library, plans against bounds, places of every piece, and the query by brute force."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from gridtide.llm import packing
from gridtide.llm.queries import QUERIES

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids + [0]


def test_ids_equal_the_library(library):
    rng = random.Random(4)
    marks = [chr(c) for c in range(0x260)] + list("Σς中́ſK🙂’ 　")
    texts = ["<|endoftext|>A <|startoftext|>", "It'S we'LL", "a\x0b\x0cb", "x" * 5000, "é" * 3000, "AB," * 4000]
    for _ in range(3000):
        texts.append("".join(rng.choice(marks[:128] if rng.random() < 0.5 else marks) for _ in range(rng.randint(1, 20))))
    encoder = packing.Encoder(PATH)
    for text in texts:
        assert encoder.encode(text.encode()).tolist() == ids_of(library, text)[:-1], repr(text)


def test_remembered_words_are_bounded(monkeypatch):
    monkeypatch.setattr(packing, "CACHED", 10)
    encoder = packing.Encoder(PATH)
    whole = encoder.encode(" ".join(f"word{i} w{i % 7}" for i in range(200)).encode()).tolist()
    assert len(encoder.words) <= 10
    assert whole == packing.Encoder(PATH).encode(" ".join(f"word{i} w{i % 7}" for i in range(200)).encode()).tolist()


def filled(plan):
    """What each sequence of a plan holds, as (offset, length)."""
    out = defaultdict(list)
    rows = plan.rows
    after = {}
    for length, first, *_ in rows:
        after.setdefault(length, []).append(first)
    given = plan._given
    for length, first, sequence, each, offset in rows:
        stop = min([f for f in after[length] if f > first], default=given[length])
        for k in range(stop - first):
            out[sequence + k // each].append((offset + k % each * length, length))
    return out


@given(st.dictionaries(st.integers(1, 40), st.integers(0, 30)), st.integers(40, 60))
@settings(max_examples=200, deadline=None)
def test_plan_places_every_piece_once(counts, capacity):
    plan = packing.plan_sequences(counts, capacity)
    held = filled(plan)
    assert Counter(x for pieces in held.values() for _, x in pieces) == Counter({x: n for x, n in counts.items() if n})
    assert sorted(held) == list(range(plan.sequences))
    for pieces in held.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
        assert sum(3 * x > capacity for _, x in pieces) <= 2


@given(st.lists(st.integers(21, 60), max_size=9))
@settings(max_examples=100, deadline=None)
def test_large_pieces_are_matched_best(sizes):
    """Pieces above a third: as many pairs as any matching has."""

    def most(rest):
        if len(rest) < 2:
            return 0
        x, *others = rest
        best = most(others)
        for i, y in enumerate(others):
            if x + y <= 60:
                best = max(best, 1 + most(others[:i] + others[i + 1 :]))
        return best

    assert packing.plan_sequences(Counter(sizes), 60).sequences == len(sizes) - most(sizes)


def test_small_pieces_follow_best_fit():
    """Against best fit piece by piece, from large to small."""
    rng = random.Random(8)
    for _ in range(30):
        capacity = 100
        sizes = sorted((rng.randint(1, 33) for _ in range(rng.randint(0, 120))), reverse=True)
        gaps = []
        for x in sizes:
            fit = [g for g in gaps if g >= x]
            if fit:
                gaps.remove(min(fit))
                gaps.append(min(fit) - x)
            else:
                gaps.append(capacity - x)
        assert packing.plan_sequences(Counter(sizes), capacity).sequences == len(gaps)


def test_plans_of_huge_tables_stay_small():
    rng = random.Random(2)
    counts = {x: rng.randint(1, 10**12) for x in range(1, 2049)}
    plan = packing.plan_sequences(counts, 2048)
    assert len(plan.rows) < 100_000
    assert plan.sequences < 1.02 * sum(x * n for x, n in counts.items()) / 2048


def check_packing(rows, capacity):
    held = defaultdict(list)
    for r in rows:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in held.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    return len(held)


def test_query_by_brute_force(spark, sf_dir, library):
    rows = QUERIES["op11_packing"](spark, sf_dir).collect()
    wanted = {}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        ids = ids_of(library, r["text"])
        for k in range(0, len(ids), 2048):
            part = ids[k : k + 2048]
            wanted[r["doc_id"], k // 2048] = (k, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows} == wanted
    assert len(rows) == len(wanted)
    used = check_packing(rows, 2048)
    assert used <= 1.01 * sum(n for _, n, _ in wanted.values()) / 2048 + 1


def test_sequences_hold_the_ids(spark, library):
    texts = [(i, t) for i, t in enumerate(["a b c", None, "", "hello, world " * 40, "a b c", "x" * 300])]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    packed = packing.pack_pieces(packing.cut_texts(df, PATH, 16), 16)
    found = defaultdict(dict)
    for r in packing.packed_sequences(packed, "doc_id", "piece").collect():
        assert len(r["ids"]) <= 16
        for p in r["pieces"]:
            found[p["doc_id"]][p["piece"]] = r["ids"][p["offset"] : p["offset"] + p["length"]]
    for doc, text in texts:
        assert sum((found[doc][k] for k in sorted(found[doc])), []) == ids_of(library, text)


def test_edge_rows(spark):
    schema = "length int, sequence_id string, own string, part int, size int"
    rows = [(5, "x", "y", 1, 2)] * 4 + [(None, "x", "y", 1, 2), (0, "x", None, 1, 2), (11, None, "y", 1, 2), (10, "x", "y", None, None)]
    packed = packing.pack_pieces(spark.createDataFrame(rows, schema), 10)
    assert packed.columns == ["length", "own", "part", "size", "sequence_id", "offset"]
    out = packed.collect()
    assert len(out) == 8
    assert sorted(r["length"] or 0 for r in out if r["sequence_id"] is None) == [0, 0, 11]
    assert check_packing([r for r in out if r["sequence_id"] is not None], 10) == 3
    empty = spark.createDataFrame([], "doc_id long, text string, ids string, piece string")
    assert packing.cut_texts(empty, PATH).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
    assert packing.pack_pieces(packing.cut_texts(empty, PATH)).count() == 0


def test_one_length_in_most_rows(spark):
    df = spark.range(3000).selectExpr("id", "IF(id % 3 = 0, 1, CAST(id % 97 AS INT) + 1) AS length").repartition(7)
    out = packing.pack_pieces(df, 128).collect()
    assert len(out) == 3000
    assert check_packing(out, 128) <= sum(r["length"] for r in out) / 128 + 2
