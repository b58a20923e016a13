"""From raw documents to token ids: each stage works on all that the one before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridtide.llm import bpe, decontaminate, jaccard, quality, secrets
from gridtide.llm.queries import GOOD, table
from gridtide.session import SMALL_BATCHES, pinned_session, scratch_folder


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality trees, fitted on the labelled ones among them, do not reject."""
    trees = quality.learn_quality(docs, table(spark, sf_dir, "labels"))
    scored = quality.score_quality(docs, trees, score="__score")
    return scored.filter(F.col("__score") >= GOOD).drop("__score")


def single_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near duplicates the document of least id; documents without id stay.

    Rows with one id are one document: the one with the least text stays.
    """
    found = jaccard.near_duplicates(docs)
    heads = found.filter("doc_id = component_id").select("doc_id").distinct()
    own = Window.partitionBy("doc_id").orderBy("text", *(c for c in docs.columns if c not in ("doc_id", "text")))
    kept = docs.join(heads, "doc_id", "left_semi").withColumn("__place", F.row_number().over(own)).filter("__place = 1").drop("__place")
    return kept.unionByName(docs.filter("doc_id is null"))


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words lies in benchmark passages."""
    # The documents' own columns give way for a while if they are called like the result's.
    aside = {c: f"_own_{c}" for c in ("n_words", "n_hit", "hits", "items") if c in docs.columns}
    found = decontaminate.find_benchmark(docs.withColumnsRenamed(aside), table(spark, sf_dir, "benchmark"))
    kept = ~decontaminate.is_contaminated("n_words", "n_hit")
    clean = found.withColumn("n_hit", decontaminate.hit_words()).filter(kept)
    return clean.select(*(F.col(aside.get(c, c)).alias(c) for c in docs.columns))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of every secret; ``n_chars`` follows the text."""
    return secrets.redact_secrets(docs).withColumn("n_chars", F.length("text").cast("long"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, round_trip): each text's ids, and whether they decode to it."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    coded = bpe.decode_ids(bpe.encode_texts(docs.select("doc_id", "text"), path), path)
    same = F.coalesce("text", F.lit("")) == F.col("decoded")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", same.alias("round_trip"))


STAGES = [
    ("quality classifier", good_documents),
    ("n-gram Jaccard join", single_documents),
    ("benchmark decontamination", clean_of_benchmark),
    ("secret scans", without_secrets),
    ("BPE encoding and decoding", token_ids),
]

#: No SQL for it: the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stage's rows written and read again.

    The workers of an executor share its memory with those of the stages before;
    they are handed small batches, in a session beside ``spark``.
    """
    spark = pinned_session(spark, SMALL_BATCHES)
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        folder = scratch_folder(spark, "pipeline")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return STAGES[-1][1](spark, docs, sf_dir)
