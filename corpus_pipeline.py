"""The corpus pipeline: stages applied to documents one after the other, each written as Parquet and read again."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallow.llm import scratch
from tallow.llm.decontaminate import decontaminate
from tallow.llm.jaccard_join import jaccard_components
from tallow.llm.packing import pack
from tallow.llm.pii import pseudonymise
from tallow.llm.quality_rules import apply_rules


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the proven cutoffs."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return apply_rules(docs, labels).where("kept").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least doc_id of each group linked by near-equal shingle sets; of repeated rows one.

    Rows without doc_id can't be told apart and all stay.
    """
    found = scratch.table(jaccard_components(docs), "components")
    others = scratch.table(found.where("doc_id != component_id").select("doc_id").distinct(), "others")
    kept = docs.join(others, "doc_id", "left_anti").select(*docs.columns)
    twice = scratch.table(found.groupBy("doc_id").count().where("count > 1").select("doc_id"), "twice")
    if twice.limit(1).count():
        once = kept.join(twice, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id", "text"])
        kept = kept.join(twice, "doc_id", "left_anti").select(*docs.columns).union(once)
    return kept


def clean_of_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose words are not contaminated: hit words make up less than a twentieth of them."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate(docs, items).where("NOT contaminated").select(*docs.columns)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with surrogates for personal data; n_chars follows the text."""
    out = pseudonymise(docs, key="tallow")
    if "n_chars" in docs.columns:
        changed = F.when(F.col("n_entities") > 0, F.length("text")).otherwise(F.col("n_chars"))
        out = out.withColumn("n_chars", changed.cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=2048)


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", clean_of_benchmarks),
    ("PII", private),
    ("best-fit packing", packed),
]

#: No SQL can express near-copy components and packing; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the whole table documents; a stage's texts are removed once the next has been written."""
    docs = before = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs, last = scratch.table(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-")), docs
        if last is not before:
            scratch.discard(last)
    return docs
