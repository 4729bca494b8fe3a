"""The corpus pipeline: toxicity, exact dedup, near dedup, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written to the shared
folder and reread as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession

from pathfold.llm import bpe, jaccard, mixing, radix_dedup, toxicity
from pathfold.scratch import Scratch, free_shuffles, opened

#: Folders of intermediate tables that stages have left.
_LEFT: list[Scratch] = []


def _stage(function):
    """A stage that first deletes what the stages before it have left: their results are
    written by then. Folders that docs still reads stay."""

    @functools.wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        read = docs.inputFiles() if _LEFT else []
        for old in list(_LEFT):
            if old.spark.sparkContext is spark.sparkContext and not any(old.path.rsplit("/", 1)[-1] in file for file in read):
                old.close()
                _LEFT.remove(old)
        free_shuffles(spark)
        before = opened()
        out = function(spark, docs, sf_dir)
        _LEFT.extend(folder for folder in opened() if folder not in before)
        return out

    return run_stage


@_stage
def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold; learnt from the labels of docs."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@_stage
def remove_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document of largest id."""
    return radix_dedup.drop_exact_copies(docs)


@_stage
def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document of smallest id."""
    return jaccard.drop_near_copies(docs)


@_stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.take_mix(docs)


@_stage
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests, one row per document taken."""
    return bpe.encode_documents(docs, bpe.default_spec())


STAGES = [
    ("toxicity", remove_toxic),
    ("exact dedup", remove_copies),
    ("n-gram Jaccard join", remove_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", encode),
]

#: Learnt scores, the knapsack and the token automaton are not SQL; tests/llm holds the
#: stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = scratch.write(stage(spark, docs, sf_dir), f"stage{i}")
    return docs
