"""The queries of this subpackage: thin uses of its operators over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    bpe, hard_negatives, line_dedup, media_columns, naming, near_dedup, packing, prefix_trie, quality_rules, recompression, secret_scan, sharding, sql, suffix_array, toxicity,
)
from ._repeats import removed_words
from ._shared import passing_path, text_key, words_of


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text", "lang", "source")
    return quality_rules.quality_rules(docs).drop("lang", "source")


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_documents(spark, sf_dir).select("doc_id", "text"), n_words=3, similarity=0.85)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    model = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", (toxicity.crc_remainder("doc_id") == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def _kept_digests(docs: DataFrame, found: DataFrame, n: int) -> DataFrame:
    """n_words, n_removed and the digest of the kept words; only of changed texts are the operator's kept words needed."""
    words = words_of("text")
    narrow = docs.select("doc_id", text_key("text").alias("k"), F.size(words).cast("long").alias("n_words"), F.sha2(F.array_join(words, " "), 256).alias("all_sha256"))
    cut = found.select("k", "whole", "n_removed", F.sha2("kept", 256).alias("some_sha256"))
    removed = removed_words(n, F.col("n_words"))
    kept = F.when(F.coalesce("whole", F.lit(False)) & (F.col("n_words") >= n), F.sha2(F.lit(""), 256)).when(removed > 0, F.col("some_sha256")).otherwise(F.col("all_sha256"))
    return narrow.join(cut, "k", "left").select("doc_id", "n_words", removed.alias("n_removed"), kept.alias("kept_sha256"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    return _kept_digests(docs, naming.repeats(docs), recompression.WINDOW)


def op5_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = _documents(spark, sf_dir).select("doc_id", "text")
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    done = media_columns.media_features(media_columns.to_media(docs))
    return done.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    return _kept_digests(docs, suffix_array.repeats(docs), suffix_array.SHORTEST)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = _documents(spark, sf_dir).select("doc_id", F.size(words_of("text")).cast("long").alias("n_words"))
    return packing.pack(lengths, "n_words")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    size = (F.octet_length(text) + 1).cast("long").alias("size")
    path = passing_path(spark)
    sharding.write_shards(_documents(spark, sf_dir).select("doc_id", "text", size), path, "size", n_shards=8)
    done = spark.read.schema("doc_id long, text string, slot long, shard int").parquet(path)
    return done.select("doc_id", size, F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text", "source")
    done = line_dedup.drop_boilerplate(docs)
    return done.select("doc_id", "n_lines", "n_lines_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives.hard_negatives(rows, F.col("id") % 50 == 0)


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(_documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


QUERIES = {f.__name__: f for f in (
    op1_quality_rules, op2_minhash_dedup, op3_toxicity, op4_substring_dedup, op5_bpe_roundtrip, op6_media_columns, op7_suffix_array_dedup, op8_best_fit_packing, op9_sharding, op10_line_dedup,
    op11_hard_negatives, op12_secret_scan, op13_prefix_trie,
)}
SQL = sql.SQL
