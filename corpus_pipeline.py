"""From raw documents to packed training sequences, one staged step after the other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segflow.llm import minhash_dedup, mixing, packing, quality_crf, secret_scan
from segflow.llm.staging import stage

#: Documents of a packed sequence, at most.
MAX_DOCS = 16


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field finds good; those that it rejects go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_crf.keep_good(docs, quality_crf.train(docs, labels))


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, of similarity 0.8 or more. Rows that share an id count as copies; rows with a null id stay."""
    return minhash_dedup.drop_near_duplicates(docs, percent=80)


def secret_scanning(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of each secret; n_chars follows the text."""
    out = secret_scan.redact_secrets(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def temperature_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: each document as often as its source's weight asks for."""
    return mixing.repeat_rows(mixing.mix(docs))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed training sequences: the pieces of all documents with their token ids, sequences and places (packing.sequences joins them)."""
    return packing.pack(packing.cut_into_pieces(docs), max_docs=MAX_DOCS, with_ids=True)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("minhash_near_dedup", minhash_near_dedup),
    ("secret_scanning", secret_scanning),
    ("temperature_mixing", temperature_mixing),
    ("best_fit_packing", best_fit_packing),
]

#: SQL cannot express the classifier's field and the packing; tests use a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
