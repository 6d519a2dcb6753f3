"""Corpus pipeline: quality rules, near-duplicate removal, decontamination, mixing, token output.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns what the
next one reads, from a table written in between. All but the last return the columns of docs.
Documents may have null or repeated ids: rows are told apart by their content then.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perusal.llm import decontaminate, jaccard_join, mixture, quality_rules, token_output
from perusal.llm.common import Scratch, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Rows travel as they are, so that no column of theirs
    meets one that the rules add."""
    rows = docs.select("text", "lang", "source", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"))
    return quality_rules.quality_rules(rows).filter("kept").select("__row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the least id."""
    return jaccard_join.one_of_each(docs, n=5, threshold=(80, 100))


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes, as documents."""
    return mixture.mixed_texts(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The index of the shards that hold the token ids in training order."""
    return token_output.standard(docs).index


STAGES = [
    ("quality_rules", quality),
    ("jaccard_join", near_duplicates),
    ("decontamination", clean_of_benchmark),
    ("mixture", mixed),
    ("token_output", token_ids),
]

#: SQL has no banded alignment and no tokenizer; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again.

    Rows without text, or with less than the base rule asks for, go in the first stage; rows with null
    or repeated ids are kept apart by their content; equal rows are near copies, of which one stays;
    long texts are read whole; columns beyond those of documents, whatever their names, stay until
    the last stage; an empty table gives an empty index.
    """
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark)
    last = None
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
        if last is not None:
            scratch.drop(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
