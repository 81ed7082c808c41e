"""A corpus through five stages: quality, shared lines, near duplicates, mixing, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.llm import lines, mixing, packing, quality, simhash
from storyloom.llm.common import table, written
from storyloom.llm.queries import tokenizer_path
from storyloom.session import shared_folder


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the rules, or are anomalous by the forest fitted on the labelled ones, go."""
    forest = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.judge(docs, forest).filter("kept").select(*docs.columns)


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of ten or more documents go; documents stay, with what is left of their texts and its length."""
    kept = lines.drop_shared_lines(docs, min_docs=10)
    text = F.when(F.col("n_dropped") > 0, F.col("kept_text")).otherwise(F.col("text"))
    changed = {"text": text, "n_chars": F.when(F.col("n_dropped") > 0, F.length("kept_text")).otherwise(F.col("n_chars"))}
    return kept.select(*[changed[c].cast(t).alias(c) if c in changed else F.col(c) for c, t in docs.dtypes])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: five-word shingles, similarity 0.8."""
    return simhash.without_near_duplicates(docs, width=5, similarity=0.8)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: weights 1, 2, 3 in turn, at most three times."""
    mixed = mixing.mix(written(mixing.sized(docs), "mixing"))
    return mixing.repeated(docs, mixed)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in sequences of 2048 tokens."""
    return packing.packed_documents(docs, tokenizer_path("byte_bpe_50k.json"), capacity=2048, end_id=0)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", drop_low_quality),
    ("line_dedup", drop_shared_lines),
    ("simhash_near_dedup", drop_near_duplicates),
    ("source_mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: SQL has no fingerprints, forests or tokenizers; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``. Each stage's result is a Parquet table that the next one reads."""
    docs = table(spark, sf_dir, "documents")
    folder = shared_folder(spark, "pipeline")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}.parquet")
        docs = spark.read.parquet(f"{folder}/{name}.parquet")
    return docs
