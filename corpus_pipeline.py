"""The corpus pipeline: language ID, n-gram Jaccard join, benchmark decontamination, secret scans, packing.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the one before kept; all but the last
return the columns of ``documents``, whatever their names.  Rows of one ``doc_id`` stay or go together after the first stage, which judges texts.
Null texts are in no language and go; rows without a ``doc_id`` are judged as texts and by no id; very long texts are processed whole;
an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsflow.llm import decontaminate, language_id, ngram_join, packing, secret_scan
from newsflow.llm.queries import tokenizer_path
from newsflow.llm.runtime import free_name, materialize, scratch, without_ids


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language model rejects go."""
    into = free_name(docs, "language")
    # written here, in small batches: whole documents wait in memory while their batch is predicted
    return materialize(language_id.identify(docs, into=into).where(~F.col(into)["rejected"]).drop(into), "known-language")


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies the least ``doc_id`` stays."""
    found = ngram_join.jaccard_components(docs)
    return without_ids(docs, "doc_id", found.where("doc_id <> component_id").select("doc_id"))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.digest(decontaminate.decontaminate(docs, benchmark))
    return without_ids(docs, "doc_id", found.where("contaminated").select("doc_id"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts; every document stays."""
    return secret_scan.redact_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences: a row per piece of a document, with its place."""
    # executors hold what the stages before took, so workers keep fewer encoded words than the operator by itself
    return packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"), end_id=1, cache_entries=200_000)


STAGES = [
    ("language ID", known_language),
    ("n-gram Jaccard join", one_of_each_group),
    ("benchmark decontamination", without_benchmark),
    ("secret scans", without_secrets),
    ("best-fit packing", packed),
]

#: The language model and the packing can't be expressed in SQL.  Tests hold the stages and ``run`` against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        with scratch(spark):  # what a stage writes on its way goes once its result is written
            docs = materialize(stage(spark, docs, sf_dir), f"stage-{k}", lasting=True)
    return STAGES[-1][1](spark, docs, sf_dir)
