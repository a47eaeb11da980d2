"""The corpus pipeline: from ``documents`` to tokens of a mixed, deduplicated corpus.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept.
Each stage's output is written as Parquet and read again as the next one's input.

1. toxicity: documents that the fitted field scores 0.5 or more go.
2. line_dedup: lines of 20 or more characters that three or more documents hold
   stay in the largest doc_id only; texts are rewritten, all documents stay.
3. ngram_join: of every class of similar documents, the one of least doc_id stays; texts
   without words, such as punctuation only, are a class with their exact copies alone.
4. mixing: sources are mixed to their target weights; a document comes once per
   pass that takes words of it, cut where its source's target ends, in the order
   of the schedule's slots.
5. sentencepieces: every row is segmented; the result has the first sample's ids
   and digests of all samples; rows that repeat a doc_id are rows of their own.

Null texts are empty throughout, and extra columns of any name are carried to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftline.llm import line_dedup, mixing, ngram_join, sentencepieces, toxicity
from weftline.llm.common import scratch_path, table
from weftline.session import ship


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that aren't toxic, unchanged; the field is fitted on labelled rows of ``docs``."""
    ship(spark)
    return toxicity.clean_documents(docs, toxicity.fit_on(docs, table(spark, sf_dir, "labels")))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, without the repeated lines; n_chars follows the text."""
    ship(spark)
    return line_dedup.without_repeated_lines(docs)


def ngram_join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of similar documents, unchanged."""
    ship(spark)
    return ngram_join.one_per_class(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the mix takes, once per pass."""
    ship(spark)
    return mixing.mixed_texts(docs)


def sentencepieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source and the sampled segmentations of every row."""
    ship(spark)
    return sentencepieces.sample(docs, carry=("source",), ids=True)


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_dedup_stage),
    ("ngram_join", ngram_join_stage),
    ("mixing", mixing_stage),
    ("sentencepieces", sentencepieces_stage),
]

#: The field and the similarity classes aren't expressible in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; every stage but the last is written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        at = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
    return STAGES[-1][1](spark, docs, sf_dir)
