"""A corpus pipeline: quality filter, exact dedup, near copies, mixing to target weights, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept; every stage's result is written to the
shared folder and read again as the next one's docs. Null texts count as empty, rows with null ids are kept apart from none of the stages, repeated rows are
one document after the second stage, and empty tables give no rows; each stage's function says what it does with these.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.common import table, written
from lattica.llm.exact_dedup import kept_documents
from lattica.llm.mixing import resampled
from lattica.llm.near_copies import first_of_each
from lattica.llm.packing import pack
from lattica.llm.quality import THRESHOLD, scored, train
from lattica.llm.queries import LANGUAGES, language_labels


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores THRESHOLD or more stay; empty and null texts have the intercept's score, repeated rows equal ones."""
    weights = train(spark, docs, table(spark, sf_dir, "labels"))
    return scored(spark, docs, weights, score="__score").filter(F.col("__score") >= THRESHOLD).drop("__score")


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that differ only in white space, the longest (then the one with the least id) stays; null and empty texts are one such text."""
    return kept_documents(spark, docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by a Jaccard similarity of 0.8 over five-word shingles, the one with the least id stays; texts without words and rows without id stay."""
    return first_of_each(spark, docs, words=5, percent=80)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Languages are brought to their target shares of tokens by repeating documents; each stays at least once, texts without words too."""
    return resampled(spark, docs, language_labels(spark, sf_dir), LANGUAGES)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences; an empty or null text is the end id alone."""
    return pack(spark, docs)


STAGES = [("quality classifier", quality_filter), ("exact dedup", exact_copies), ("n-gram Jaccard join", near_copies), ("mixing to target weights", mixing), ("best-fit packing", packing)]

#: SQL can express neither the classifiers nor the packing; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`: the last one's rows. An empty table gives none."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(spark, docs, f"stage-{k + 1}")
    return docs
