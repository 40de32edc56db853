"""Corpus pipeline: five stages from raw documents to a training mixture.

Every stage takes all rows the one before it kept, written as Parquet and read again.  All but the last
return the columns of ``documents``; the last returns the plan of the mixture, one row for each use of a document.

Rows without text (null, empty or white space) pass the first four stages as they are.  Extra columns and
nulls in them pass through.  An empty table gives an empty table.  Rows that repeat an id and its text are one
document: they stay or go together.  Of equal candidates the one with the lower id stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from listforge.llm import decontaminate, jaccard_join, line_dedup, mixing, toxicity
from listforge.llm.common import documents, stored


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity network, trained on this table's labels, does not reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.without_toxic(docs, toxicity.train(docs, labels))


def cut_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Blocks of 25 words or more that an earlier document holds are cut from the later text; a document that
    loses all its words goes."""
    return line_dedup.without_repeats(docs, drop_emptied=True)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of every group linked by five-word shingles with a similarity of 0.8 or more."""
    return jaccard_join.one_of_each(docs, 5, 80)


def drop_benchmark_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage that is a test item within 6 edits in 100 characters."""
    return decontaminate.without_matches(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture of sources in which none is used more than 1.25 times; a null source is the source ''."""
    return mixing.mix_sources(docs, max_repeats=1.25)


STAGES = [("toxicity", clean), ("line_dedup", cut_repeated_lines), ("jaccard_join", drop_near_copies), ("decontamination", drop_benchmark_texts), ("mixing", mix)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
