"""Registered queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import context_mixing, decontaminate, language_id, packing, quality_rules, secret_scan, simhash_dedup, source_mix, spelling_variants, substring_dedup, toxicity, url_filter, vector_codes
from .common import bucket_of, read


def tokenizer_path() -> str:
    """The vocabulary file: from the environment, else from the public tokenizers package."""
    import public_tokenizers

    return os.environ.get("BYTE_BPE_FILE") or public_tokenizers.path("byte_bpe_50k.json")


URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(read(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict", "template", "purity")


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicate_groups(read(spark, sf_dir, "documents"))


def packed(docs: DataFrame, path: str) -> DataFrame:
    pieces = packing.cut_documents(docs, path).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return packing.pack_pieces(pieces).select(F.col("id").alias("doc_id"), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(read(spark, sf_dir, "documents"), tokenizer_path())


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.judge_quality(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    own = bucket_of(F.col("doc_id"), 4) != 2
    model = toxicity.train(docs.filter(own), labels.filter(own))
    return toxicity.score(docs, model).select("doc_id", (~own).alias("held_out"), "score", "predicted")


def op6_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, own = read(spark, sf_dir, "documents"), bucket_of(F.col("doc_id"), 7) != 2
    found = context_mixing.score(docs, docs.filter(own))
    return found.select("doc_id", (~own).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.repeated_passages(read(spark, sf_dir, "documents"))
    return found.withColumnRenamed("other_id", "other_doc_id")


def _span_text(spans):
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.secret_spans(read(spark, sf_dir, "documents"))
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(_span_text(F.filter("spans", lambda s: s["kind"] != "entropy")), 256).alias("base_sha256"), _span_text(F.col("spans")).alias("spans"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = language_id.train(language_id.training_rows(docs))
    return language_id.identify(docs, model).select("doc_id", (bucket_of(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(read(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.variants(read(spark, sf_dir, "documents"))


def op13_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.mix(read(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": op1_url_filter,
    "op2_simhash_dedup": op2_simhash_dedup,
    "op3_packing": op3_packing,
    "op4_quality_rules": op4_quality_rules,
    "op5_toxicity": op5_toxicity,
    "op6_context_mixing": op6_context_mixing,
    "op7_decontaminate": op7_decontaminate,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_secret_scan": op9_secret_scan,
    "op10_language_id": op10_language_id,
    "op11_vector_codes": op11_vector_codes,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_source_mix": op13_source_mix,
}
ORACLES: dict[str, str] = {"op4_quality_rules": quality_rules.SQL, "op11_vector_codes": vector_codes.SQL, "op12_spelling_variants": spelling_variants.SQL, "op13_source_mix": source_mix.SQL}
