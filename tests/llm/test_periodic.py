"""Periodic runs against a plain search for every period."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gridtide.llm import periodic
from gridtide.llm.queries import QUERIES


def plain_runs(words):
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            run = words[i : j + q]
            smaller = any(run[r:] == run[:-r] for r in range(1, q))
            if len(run) >= max(6, 4 * q) and not smaller:
                out.append((i, len(run), q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_collapsed(words, runs):
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


def patched(rng, n):
    words, letters = [], rng.choice([1, 2, 3, 6])
    while len(words) < n:
        block = [b"%d" % rng.randrange(letters) for _ in range(rng.randint(1, 6))]
        words += (block * rng.randint(1, 9))[: rng.randint(1, 50)]
    return words


def test_runs_equal_a_plain_search():
    rng, met = random.Random(1), 0
    for _ in range(1500):
        words = patched(rng, rng.randint(0, 70))
        wanted = plain_runs(words)
        met += len(wanted)
        assert [tuple(r) for r in periodic.word_runs(words).tolist()] == wanted, words
    assert met > 1000


@given(st.lists(st.integers(0, 2), max_size=80))
@settings(max_examples=300, deadline=None)
def test_runs_of_any_sequence(numbers):
    words = [b"%d" % x for x in numbers]
    assert [tuple(r) for r in periodic.word_runs(words).tolist()] == plain_runs(words)


def test_common_extensions():
    rng = random.Random(5)
    for _ in range(40):
        s = [rng.randint(1, 3) for _ in range(rng.randint(1, 50))]
        tree = periodic.SuffixTree(s)
        closed = [*s, 0]
        assert tree.suffixes.tolist() == sorted(range(len(closed)), key=lambda i: closed[i:])
        for _ in range(60):
            a, b = rng.sample(range(len(closed)), 2)
            k = 0
            while max(a, b) + k < len(s) and s[a + k] == s[b + k]:
                k += 1
            assert tree.common(np.array([a]), np.array([b])).tolist() == [k]


def test_cutting_keeps_every_run():
    words = b"a b c a b c a b c a b c x y a a a a a a z z z q z z z".split()
    runs = [tuple(r) for r in periodic.word_runs(words).tolist()]
    assert runs == [(0, 12, 3), (14, 6, 1)]
    assert b" ".join(periodic.collapsed_words(words, np.array(runs))) == b"a b c x y a z z z q z z z"


@pytest.mark.parametrize("n, period", [(200_000, 1), (200_000, 70_000), (120_000, 40_000), (100_000, 13)])
def test_long_stretches(n, period):
    rng = random.Random(period)
    block = [b"%d" % rng.randrange(400) for _ in range(period)]
    words = (block * (n // period + 1))[:n]
    wanted = [(0, n, period)] if 4 * period <= n else []
    found = [tuple(r) for r in periodic.word_runs(words).tolist()]
    assert [r for r in found if r[2] > period // 2] == wanted


def test_edge_rows(spark):
    rows = [(1, None, "r", "c"), (2, "", "r", "c"), (3, " \t\n", None, "c"), (4, "a a a a a a", "r", None), (4, "a a a a a a", "r", None), (None, "b\x0bb\x0cb b b b é", "r", "c"), (6, "A a A a A a A", "r", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs string, collapsed string")
    found = periodic.find_runs(df)
    assert found.columns == ["doc_id", "text", "runs", "collapsed"]
    out = sorted((str(r["doc_id"]), [tuple(x) for x in r["runs"]], r["collapsed"]) for r in found.collect())
    assert out == [
        ("1", [], ""),
        ("2", [], ""),
        ("3", [], ""),
        ("4", [(0, 6, 1)], "a"),
        ("4", [(0, 6, 1)], "a"),
        ("6", [], "A a A a A a A"),
        ("None", [(0, 6, 1)], "b é"),
    ]
    assert periodic.find_runs(df.limit(0)).count() == 0


def edited(doc_id, text):
    words = [w.decode() for w in (text or "").encode().split()]
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


def test_query_by_brute_force(spark, sf_dir):
    rows = {r["doc_id"]: r for r in QUERIES["op13_periodic_runs"](spark, sf_dir).collect()}
    digest = lambda text: hashlib.sha256(text.encode()).hexdigest()
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert len(rows) == len(documents)
    met = 0
    for d in documents:
        words = edited(d["doc_id"], d["text"])
        row = rows[d["doc_id"]]
        if len(words) > 1500 and not row["n_runs"]:
            continue  # the plain search is quadratic; long texts are compared where the query finds runs
        if len(words) > 6000:
            continue
        runs = plain_runs([w.encode() for w in words])
        best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None, None, None))
        met += len(runs)
        assert (row["n_runs"], row["start"], row["length"], row["period"]) == (len(runs), *best)
        assert row["exponent_milli"] == (1000 * best[1] // best[2] if runs else None)
        assert row["runs_sha256"] == digest("".join(f"{s},{n},{q}\n" for s, n, q in runs))
        assert row["collapsed_sha256"] == digest(plain_collapsed(words, runs))
    assert met > 50
