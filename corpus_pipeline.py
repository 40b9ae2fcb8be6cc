"""Corpus cleaning in five stages over `documents`; each stage works on what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetloom.llm import decontaminate, language_id, secret_scan, simhash_dedup
from sheetloom.llm.common import read, use_checkpoints
from sheetloom.llm.queries import packed, tokenizer_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language identification rejects go: null texts, texts without a letter, and texts that fit no language.

    Repeated rows stay or go alike; an empty table stays empty; all columns stay."""
    return language_id.keep_identified(docs, language_id.train(language_id.training_rows(docs)))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, the one of least id; of repeated rows one stays.

    Null ids yield to others; an empty table stays empty; all columns stay."""
    return simhash_dedup.keep_first(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more of the words lies in benchmark passages go; null and empty texts stay.

    Repeated rows stay or go alike; an empty table or benchmark changes nothing; all columns stay."""
    return decontaminate.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; n_chars follows the new text. All rows stay, null texts as they are; all columns stay."""
    out = secret_scan.redact_secrets(docs)
    return out.withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns) if "n_chars" in docs.columns else out


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all remaining documents with their place in training sequences; a null text is the end id alone.

    Repeated rows are packed each; an empty table gives no pieces."""
    return packed(docs, tokenizer_path())


STAGES = [("language_id", language), ("near_dedup", near_dedup), ("decontamination", decontaminated), ("secret_scan", without_secrets), ("packing", packing)]

#: Trained models, fingerprint components and tokenisation are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each stage's rows are written as Parquet and read again by the next.

    A stage's folder goes once the next stage is written; the last one holds the result and stays."""
    import uuid

    use_checkpoints(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        out = f"{folder}/{k}_{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
        if k:
            before = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{k - 1}_{STAGES[k - 1][0]}")
            before.getFileSystem(spark._jsc.hadoopConfiguration()).delete(before, True)
    return docs
