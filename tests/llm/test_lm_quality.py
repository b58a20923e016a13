"""Language-model scores and the quality classifier."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from gridtide.llm import lm, quality
from gridtide.llm.queries import QUERIES


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [None]


@pytest.fixture(scope="module")
def scored(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    return texts, {r["doc_id"]: r for r in QUERIES["op5_language_model"](spark, sf_dir).collect()}


def test_counts_and_base_score(scored):
    texts, out = scored
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    count = collections.Counter(t for i, text in texts.items() if not held[i] for t in tokens(text))
    n, v = sum(count.values()), len(count)
    assert out.keys() == texts.keys()
    for i, text in texts.items():
        own, r = tokens(text), out[i]
        base = sum(math.log10((count[t] + 1) / (n + v + 1)) for t in own)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(own), sum(count[t] > 0 for t in own), n)
        assert r["base_score"] == pytest.approx(base, rel=1e-9)


def test_held_out_perplexity_beats_the_base(scored):
    _, out = scored
    held = [r for r in out.values() if r["held_out"]]
    n = sum(r["n_tokens"] for r in held)
    model, base = (10 ** (-sum(r[c] for r in held) / n) for c in ("score", "base_score"))
    assert model < 0.8 * base


def test_probabilities_sum_to_one():
    rng = random.Random(2)
    words = pa.array([" ".join(f"w{min(rng.randrange(40), rng.randrange(40))}" for _ in range(3000))])
    key = lm.pair_keys(words)[1]
    every = np.unique(key & lm._WORD)
    # All words in all contexts, so that each context's distribution is complete.
    pairs = np.sort((every[:, None] | np.arange(lm.CONTEXTS, dtype=np.uint64)[None, :]).ravel())
    counts = np.zeros(len(pairs), np.uint64)
    np.add.at(counts, np.searchsorted(pairs, key), np.uint64(1))
    context = (pairs & np.uint64(lm.CONTEXTS - 1)).astype(int)
    customers = np.bincount(context, weights=counts, minlength=lm.CONTEXTS)
    tables = np.bincount(context, weights=np.minimum(counts, 1), minlength=lm.CONTEXTS)
    totals = lm.Totals(customers, tables, float((np.add.reduceat(counts, np.arange(0, len(pairs), lm.CONTEXTS)) > 0).sum()), len(every))
    s = lm.Sampler(pairs, counts, [totals], 1)
    for _ in range(4):
        s.sweep()
    assert np.all(s.tables <= counts) and np.all((s.tables > 0) == (counts > 0))
    t = s.totals
    unknown = (lm.PARENT_STRENGTH + lm.PARENT_DISCOUNT * t.parent_tables) / (t.words + 1) / (lm.PARENT_STRENGTH + t.parent_customers)
    own = (lm.STRENGTH + lm.DISCOUNT * t.tables) / (lm.STRENGTH + t.customers) * unknown
    assert np.bincount(s.context, weights=s.probability(), minlength=lm.CONTEXTS) + own == pytest.approx(np.ones(lm.CONTEXTS))


def test_every_previous_word_is_a_context_of_its_own():
    _, key, rest = lm.pair_keys(pa.array([" ".join(f"w{k} x" for k in range(30_000))]))
    context = (rest << np.uint64(12)) | (key & np.uint64(lm.CONTEXTS - 1))
    assert len(np.unique(context[1::2])) == 30_000  # those of the x


def test_contexts_beyond_the_key_bits_do_not_share_what_they_learn(spark):
    rows = [(k, f"a{k} b{k} " * 6, True) for k in range(9000)] + [(10_000 + k, f"a{k} b{k + 1}", False) for k in range(200)]
    out = lm.score_texts(spark.createDataFrame(rows, "doc_id long, text string, learn boolean"), "learn").collect()
    mean = lambda ids: np.mean([r["score"] / r["n_tokens"] for r in out if r["doc_id"] in ids])
    assert mean(range(200)) > mean(range(10_000, 10_200)) + 0.5


def test_seating_follows_the_restaurant_rule():
    rng = np.random.default_rng(5)
    customers, fresh, discount = np.full(4000, 200), np.full(4000, 3.0), 0.4
    mean = lm.seat(customers, fresh, discount, rng).mean()
    t = 1.0
    for k in range(1, 200):
        t += 3.0 / (3.0 + k - discount * t)
    assert mean == pytest.approx(t, rel=0.03)
    assert lm.seat(np.array([0, 1]), np.ones(2), 0.5, rng).tolist() == [0, 1]


def test_lm_edges(spark):
    rows = [(1, "a b", True, 0.0), (None, "a b", False, 0.0), (2, None, None, 0.0), (2, "", False, 0.0), (3, "zz", False, 0.0), (3, "zz", False, 0.0), (4, "a " * 50_000, True, 0.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, learn boolean, score double")
    out = lm.score_texts(df, "learn").collect()
    assert sorted((r["doc_id"] or 0, r["n_tokens"], r["n_known"]) for r in out) == [(0, 3, 3), (1, 3, 3), (2, 1, 1), (2, 1, 1), (3, 2, 1), (3, 2, 1), (4, 50_001, 50_001)]
    assert {r["train_tokens"] for r in out} == {50_004}
    assert all(r["score"] <= 0 for r in out)
    assert lm.score_texts(df.limit(0), "learn").collect() == []
    unlearned = lm.score_texts(df.filter("doc_id = 3"), "learn").collect()
    assert [(r["n_known"], r["train_tokens"], r["base_score"]) for r in unlearned] == [(0, 0, 0.0)] * 2
    again = lm.score_texts(df.repartition(3), "learn").collect()
    assert sorted(r["score"] for r in again) == sorted(r["score"] for r in out)


def test_held_out_quality(spark, sf_dir):
    out = {r["doc_id"]: r for r in QUERIES["op7_quality"](spark, sf_dir).collect()}
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").collect()
    assert len(out) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in out.items())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in out.values())
    held = [(r["quality"], out[r["doc_id"]]["score"]) for r in labels if out[r["doc_id"]]["held_out"]]
    good, poor = ([s for y, s in held if y == k] for k in (1, 0))
    assert sum(g > p for g in good for p in poor) / (len(good) * len(poor)) > 0.9
    assert sum((s >= 0.3) == (y == 1) for y, s in held) / len(held) > 0.9


def test_statistics_are_of_each_text_alone():
    texts = pa.array(["One two\nthree three", None, "", "AB!! | x", "é" * 200_000])
    x = quality.statistics(texts)
    assert np.array_equal(x[1], x[2]) and not x[1].any()
    for i in range(len(texts)):
        assert np.allclose(x[i], quality.statistics(texts.slice(i, 1))[0])
    assert quality.statistics(texts.slice(0, 0)).shape == (0, x.shape[1])


def walk(trees, row):
    total = trees.start
    for f, c, leaf in zip(trees.feature, trees.cut, trees.leaf, strict=True):
        j = 0
        while j < len(f):
            j = 2 * j + 1 + int(row[f[j]] > c[j])
        total += leaf[j - len(f)]
    return 1 / (1 + math.exp(-total))


def test_trees_learn_and_the_flat_walk_equals_a_plain_one():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 4))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    trees = quality.fit_trees(x, y, trees=40)
    assert ((trees.score(x) > 0.5) == y).mean() > 0.95
    assert trees.score(x[:50]) == pytest.approx([walk(trees, r) for r in x[:50]])


def test_labels_that_teach_nothing(spark):
    docs = spark.createDataFrame([(1, "a", 9.0), (2, None, 9.0), (2, None, 9.0)], "doc_id long, text string, score double")
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = quality.score_quality(docs, quality.learn_quality(docs, none)).collect()
    assert [r["score"] for r in got] == [0.5] * 3
    one = spark.createDataFrame([(1, 1), (1, 1), (2, 1), (None, 0), (2, None), (77, 0)], "doc_id long, quality int")
    assert all(r["score"] > 0.9 for r in quality.score_quality(docs, quality.learn_quality(docs, one)).collect())
    assert quality.score_quality(docs.limit(0), quality.learn_quality(docs.limit(0), one)).collect() == []


def test_seating_goes_on_from_its_state():
    rng = np.random.default_rng(4)
    pairs = np.unique(rng.integers(0, 2**63, 400, dtype=np.uint64))
    counts = rng.integers(0, 90, len(pairs)).astype(np.uint64)
    context = rng.integers(0, 9, len(pairs))
    customers = np.bincount(context, weights=counts, minlength=9)
    totals = [lm.Totals(customers, customers // k, 100.0 * k, 400) for k in (2, 3)]
    whole = lm.Sampler(pairs, counts, totals, 7, context)  # repeats the first round
    first = lm.Sampler(pairs, counts, totals[:1], 7, context)
    for _ in range(lm.SWEEPS):
        first.sweep()
    second = lm.Sampler(pairs, counts, totals[1:], 7, context, first.state())
    for _ in range(2):
        whole.sweep()
        second.sweep()
        assert np.array_equal(whole.tables, second.tables) and np.array_equal(whole.parent_tables, second.parent_tables)
    assert np.array_equal(whole.probability(), second.probability())


def test_order_of_pairs_is_that_of_both_columns():
    rng = np.random.default_rng(6)
    for n, keys, rests in ((0, 1, 1), (1, 1, 1), (500, 40, 3), (500, 3, 500), (500, 500, 1)):
        key, rest = rng.integers(0, keys, n).astype(np.uint64), rng.integers(0, rests, n).astype(np.uint64)
        order, plain = lm._order(key, rest), np.lexsort((rest, key))
        assert sorted(order.tolist()) == list(range(n))
        assert np.array_equal(key[order], key[plain]) and np.array_equal(rest[order], rest[plain])


def test_messages_follow_the_text_not_the_partitions(spark, monkeypatch):
    """A bucket has a message for each part of the contexts and each block; more shuffle partitions are more buckets, not more of those, too."""
    parts, blocks, count, score = [], [], lm._counted, lm._scored
    monkeypatch.setattr(lm, "_counted", lambda merged, told, sums, n: parts.append(n) or count(merged, told, sums, n))
    monkeypatch.setattr(lm, "_scored", lambda docs, answers, sums: blocks.append(answers.select("block").distinct().count()) or score(docs, answers, sums))
    docs = spark.createDataFrame([(k, f"a b{k % 7} c{k} a b", k % 3 > 0) for k in range(60)], "doc_id long, text string, learn boolean")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("2", "40"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            assert lm.score_texts(docs, "learn").count() == 60
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert set(parts) == {1}
    assert max(blocks) <= 2
