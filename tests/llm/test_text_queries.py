"""The registered text queries against their SQL twins, and the pipeline against plain readings."""

import re

import pytest
from compare import connect, difference

import corpus_pipeline
from gridtide.llm import bpe, secrets
from gridtide.llm.queries import GOOD, ORACLE, QUERIES
from gridtide.llm import quality


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_twin(spark, sf_dir, name):
    assert difference(QUERIES[name](spark, sf_dir), connect(sf_dir), ORACLE[name]) is None


def test_every_operator_has_a_query():
    assert [int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES] == list(range(1, 14))


def test_chat_twin_over_long_conversations(spark, tmp_path):
    rows = []
    for conv in range(4):
        rows += [(conv, 0, "system" if conv % 2 else "user", "<b>\\ be kind " * (5 + 40 * conv))]
        rows += [(conv, k, "assistant" if k % 2 else "user", f"é{k} " * ((k * 37) % (900 * conv + 50))) for k in range(1, 60)]
    schema = "conv_id long, turn long, role string, text string"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    con = __import__("duckdb").connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    assert difference(QUERIES["op8_chat"](spark, str(tmp_path)), con, ORACLE["op8_chat"]) is None


def stage(name):
    return next(f for n, f in corpus_pipeline.STAGES if n == name)


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def test_stages_in_order_and_columns(spark, sf_dir, documents):
    names = ["quality classifier", "n-gram Jaccard join", "benchmark decontamination", "secret scans", "BPE encoding and decoding"]
    assert [n for n, _ in corpus_pipeline.STAGES] == names
    for name in names[:-1]:
        assert stage(name)(spark, documents.limit(30), sf_dir).columns == documents.columns


def test_stages_keep_columns_called_like_their_own(spark, sf_dir, documents):
    more = {c: "mine" for c in ("n_words", "n_hit", "hits", "items", "score", "spans", "ids", "component_id", "rep", "_n")}
    from pyspark.sql import functions as F

    docs = documents.limit(40).withColumns({c: F.lit(v) for c, v in more.items()})
    for name, f in corpus_pipeline.STAGES[:-1]:
        out = f(spark, docs, sf_dir)
        assert out.columns == docs.columns, name
        assert all(r[c] == "mine" for r in out.collect() for c in more), name


def test_quality_stage_keeps_what_scores_well(spark, sf_dir, documents):
    kept = texts(stage("quality classifier")(spark, documents, sf_dir))
    trees = quality.learn_quality(documents, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    want = {r["doc_id"] for r in quality.score_quality(documents, trees).collect() if r["score"] >= GOOD}
    assert kept.keys() == want
    poor = {r["doc_id"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 0").collect()}
    good = {r["doc_id"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").collect()}
    assert len(kept.keys() & good) > 0.97 * len(good)
    assert len(kept.keys() & poor) < 0.3 * len(poor)


def test_single_stage_keeps_the_least_of_each_group(spark, sf_dir, documents):
    found = QUERIES["op1_near_duplicates"](spark, sf_dir).collect()
    kept = texts(stage("n-gram Jaccard join")(spark, documents, sf_dir))
    assert kept.keys() == {r["component_id"] for r in found}


def test_single_stage_on_repeated_rows_and_null_ids(spark, sf_dir):
    a, b = "one two three four five six", "seven eight nine ten eleven twelve"
    rows = [(5, a, "en", "s", 1), (5, a, "en", "s", 1), (9, a, "en", "s", 1), (7, b, "en", "s", 1), (7, "z", "en", "s", 1), (None, a, "en", "s", 1), (3, None, "en", "s", 0), (4, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = sorted((r["doc_id"] or -1, r["text"] or "") for r in stage("n-gram Jaccard join")(spark, docs, sf_dir).collect())
    assert out == [(-1, a), (3, ""), (4, ""), (5, a), (7, b)]


def test_later_stages_against_plain_readings(spark, sf_dir, documents):
    given = texts(documents)
    found = QUERIES["op3_decontaminate"](spark, sf_dir).collect()
    clean = texts(stage("benchmark decontamination")(spark, documents, sf_dir))
    assert clean == {r["doc_id"]: given[r["doc_id"]] for r in found if not r["contaminated"]}
    redacted = stage("secret scans")(spark, documents, sf_dir).collect()
    assert {r["doc_id"] for r in redacted} == given.keys()
    assert all(r["n_chars"] == len(r["text"]) and not secrets.spans_of(r["text"]) for r in redacted)
    assert all(r["text"] == given[r["doc_id"]] for r in redacted if not secrets.spans_of(given[r["doc_id"]]))
    coded = stage("BPE encoding and decoding")(spark, documents, sf_dir).collect()
    vocabulary = bpe.Vocabulary(__import__("public_tokenizers").path("byte_bpe_50k.json"))
    assert all(list(r["ids"]) == vocabulary.encode(given[r["doc_id"]]) and r["round_trip"] for r in coded)


def test_run_applies_all_stages(spark, sf_dir, documents):
    docs = documents
    for _, f in corpus_pipeline.STAGES:
        docs = f(spark, docs, sf_dir)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    key = lambda df: sorted((r["doc_id"], tuple(r["ids"])) for r in df.collect())
    assert key(corpus_pipeline.run(spark, sf_dir)) == key(docs)


def test_stages_on_an_empty_table(spark, sf_dir, documents):
    docs = documents.limit(0)
    for _, f in corpus_pipeline.STAGES:
        docs = f(spark, docs, sf_dir)
        assert docs.collect() == []




def test_pipeline_hands_small_batches_to_workers_and_leaves_the_session(spark, tmp_path, monkeypatch):
    key, asked = "spark.sql.execution.arrow.maxBytesPerBatch", []
    before = spark.conf.get(key)
    rows = [(k, "x" * 2000) for k in range(10)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))

    def same(session, docs, sf_dir):
        asked.append((session.conf.get(key), docs.sparkSession.conf.get(key)))
        return docs

    monkeypatch.setattr(corpus_pipeline, "STAGES", [("first", same), ("last", same)])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 10
    assert asked == [("4m", "4m")] * 2
    assert spark.conf.get(key) == before != "4m"
