"""Corpus pipeline: language ID, line dedup, near-duplicate removal, packing.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it kept, and returns a
table that is written as Parquet and read again as the next stage's `docs`. All but the last return
the columns of `documents`.

Defined results: a null, empty or letterless text goes in the first stage; null ids come first in
the order of lines and last in the choice of a near duplicate; rows that repeat an id and text lose
the same lines, and one of them stays; extra columns are carried along; an empty table gives no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from rillflow.llm import langid, linededup, minhash, packing
from rillflow.llm.common import scratch
from rillflow.llm.queries import held_out


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject; a bounded sample of them trains it."""
    return langid.keep_identified(docs, langid.fit(docs.where(~held_out())))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that stood earlier; those of which nothing is left go."""
    return linededup.dedup_lines(docs, size_col="n_chars" if "n_chars" in docs.columns else None)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that with the smallest id, null last."""
    return minhash.keep_one(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's token pieces with their places in sequences of 4096.

    The memo is smaller than the operator's own: here executors still hold the heap of earlier stages.
    """
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), memo=40_000_000)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("best_fit_packing", best_fit_packing)]

#: The classifier and the packing have no SQL form; tests hold the run against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each result written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch(spark, name)
        out = stage(spark, docs, sf_dir)
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
