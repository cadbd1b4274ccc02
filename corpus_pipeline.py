"""A training-corpus pipeline of five stages, each a corpus operator on what the one before kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir). All
but the last return the columns of documents. Between stages the rows are
written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from labelmx.llm import bpe, line_dedup, mixing, ngram_join, toxicity
from labelmx.llm.base import ready, table
from labelmx.llm.queries import MIX, vocabulary_path
from labelmx.plans.durable import stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored under 0.7 by a lexicon learned from the labels."""
    ready(spark)
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that repeat or nearly repeat an earlier one."""
    ready(spark)
    return line_dedup.dedup_lines(docs)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a 5-word shingle similarity of 0.75 or more."""
    ready(spark)
    return ngram_join.keep_one(docs, width=5, threshold=75)


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that expected domain tokens follow the target weights."""
    ready(spark)
    return mixing.mix(docs, mixing.label_domains(table(spark, sf_dir, "labels")), MIX)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded texts."""
    ready(spark)
    return bpe.digests(docs, vocabulary_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", keep_one_of_near_copies),
    ("mixing", mix_to_weights),
    ("BPE", encode),
]
#: Learned scores, hashed words and BPE are beyond SQL; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
