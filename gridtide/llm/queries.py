"""The operators of this folder as registered queries over the given tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridtide.functions.once import with_columns_once
from gridtide.llm import bpe, chat, decontaminate, fingerprint, jaccard, lm, negatives, packing, pages, periodic, quality, secrets, sharding
from gridtide.llm.oracle import ORACLE

__all__ = ["GOOD", "ORACLE", "QUERIES", "table"]

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

#: Score from which a document counts as good.
GOOD = 0.3


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def id_remainder(column: str, divisor: int):
    """crc32 of the id's text modulo ``divisor``."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % divisor


@query
def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    ids = bpe.encode_texts(texts(spark, sf_dir), path).drop("text")
    decoded = bpe.decode_ids(ids, path)
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@query
def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_benchmark(texts(spark, sf_dir), table(spark, sf_dir, "benchmark"))
    counted = found.select("doc_id", "n_words", decontaminate.hit_words().alias("n_hit"), "items")
    return counted.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        decontaminate.is_contaminated().alias("contaminated"),
    )


@query
def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = texts(spark, sf_dir).withColumn("text", F.coalesce("text", F.lit("")))
    # Several ranges for each partition, so that partitions get about the same number of rows.
    ranges = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Only texts are shuffled: sketches are hashes, which do not compress, and cost little to compute.
    pairs = fingerprint.with_next(own, "doc_id", ["text"], ranges)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.col("text").substr(F.lit(1), n - half), F.col("next_text").substr(F.lit(1), half))
    all_texts = pairs.select("doc_id", n.cast("long").alias("n_chars"), "text", "next_text", edited.alias("edited"))
    for column in ("text", "next_text", "edited"):
        all_texts = fingerprint.fingerprints(all_texts, column, f"{column}_sketch")
    sketch = F.col("text_sketch")
    return all_texts.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint.as_text(sketch).alias("fingerprint"),
        fingerprint.as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        fingerprint.likeness(sketch, F.col("edited_sketch")).alias("near_edited"),
        fingerprint.likeness(sketch, F.col("next_text_sketch")).alias("near_next"),
    )


@query
def op5_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = texts(spark, sf_dir).withColumn("learn", ~(id_remainder("doc_id", 7) == 2))
    scored = lm.score_texts(documents, "learn")
    return scored.withColumn("held_out", id_remainder("doc_id", 7) == 2).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


#: Shards of the documents.
SHARDS = 40


@query
def op6_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = F.coalesce("text", F.lit("")).cast("binary")
    rows = texts(spark, sf_dir).select(
        "doc_id", (F.octet_length(data) + 16).cast("long").alias("size"), F.crc32(data).alias("text_crc32"), F.unhex(F.sha2(data, 256)).alias("same")
    )
    sharded = sharding.shard_rows(rows, "same", "doc_id", "size", SHARDS)
    return sharded.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = texts(spark, sf_dir), table(spark, sf_dir, "labels")
    trees = quality.learn_quality(documents, labels.filter(id_remainder("doc_id", 5) != 0))
    return quality.score_quality(documents, trees).select(
        "doc_id",
        (id_remainder("doc_id", 5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= GOOD).cast("int").alias("predicted"),
    )


@query
def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = F.lit("\\### Assistant: </turn> ok")
    asked = F.array(*(F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role"), marks.alias("text")) for i, r in enumerate(("user", "assistant"))))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    turns = turns.unionByName(spark.range(1).select(F.inline(asked)))
    read = chat.read_windows(chat.format_windows(turns))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    targets = F.array_join("targets", "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("turns_sha256"),
        F.length(targets).cast("long").alias("loss_chars"),
        F.sha2(targets.cast("binary"), 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long").alias("formatted_chars"),
    )


@query
def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pages.extract_text(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def _joined(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


@query
def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(texts(spark, sf_dir))
    base = F.filter("spans", lambda s: s["kind"] != "entropy")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        count("assign"),
        count("access"),
        count("hex"),
        F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
    )


#: Tokens of a packed sequence.
SEQUENCE = 2048


@query
def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.cut_texts(texts(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), SEQUENCE, keep_ids=False)
    packed = packing.pack_pieces(pieces, SEQUENCE)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    whole = rows.select("vec_id", moved.alias("label"), negatives.whole_vectors("embedding").alias("v"))
    return negatives.mine_negatives(whole, F.col("vec_id") % 100 == 0)


def _repeated_from(words, n, g):
    """Words from place ``g % n`` on replaced by repetitions of the first few of them."""
    at = (g % n).cast("int")
    rest = n - at
    period = (1 + F.floor(rest / (3 + g % 8))).cast("int")
    block = F.slice(words, at + 1, period)
    times = F.ceil(rest / period).cast("int")
    return F.concat(F.slice(words, F.lit(1), at), F.slice(F.flatten(F.array_repeat(block, times)), F.lit(1), rest))


@query
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+", -1), lambda w: w != "")
    chosen = with_columns_once(texts(spark, sf_dir), {"words": F.when(h % 10 == 0, words)})
    n, g = F.size("words"), F.floor(h / 10)
    edited = chosen.withColumn("text", F.when(n > 0, F.array_join(_repeated_from(F.col("words"), n, g), " ")).otherwise(F.col("text")))
    found = periodic.find_runs(edited.select("doc_id", "text"))
    # Runs are listed by start and period, so the first of equally repeated ones stays.
    first = F.get("runs", F.lit(0))
    more = lambda a, b: F.when(b["length"] * a["period"] > a["length"] * b["period"], b).otherwise(a)
    best = F.aggregate("runs", first, more)
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *(r[f].cast("string") for f in ("start", "length", "period"))), F.lit("\n")))
    told = with_columns_once(found.select("doc_id", "runs", F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256")), {"best": best})
    return told.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        "collapsed_sha256",
    )
