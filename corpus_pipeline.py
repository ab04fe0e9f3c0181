"""A training corpus from documents, in five stages: filter, drop repeated lines, drop near copies, decontaminate, pack.

Every stage is written to the shared folder and read again as the next one's documents, so a lost executor costs a
stage's own tasks only. The last stage returns pieces of packed sequences, which SQL cannot express.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vitalgrid.llm.common import table
from vitalgrid.llm.count_tree import one_of_each
from vitalgrid.llm.decontamination import without_leaks
from vitalgrid.llm.line_frequency import keep_good
from vitalgrid.llm.line_runs import without_repeats
from vitalgrid.llm.packing import packed_documents
from vitalgrid.session import materialize, prepare

ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without lines that over 100 documents of their host share.

    Documents without words (null and blank texts too) go. Equal rows stay or go together; no rows give no rows.
    """
    prepare(spark)
    return keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of line runs of 50 words and more; those left without a word go.

    A null text stays null. Equal rows are one document; no rows give no rows.
    """
    prepare(spark)
    return without_repeats(docs, keep_emptied=False)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles, similarity 0.8 or more; the first document of each component stays.

    Documents without words are copies of nothing and stay. No rows give no rows.
    """
    prepare(spark)
    return one_of_each(docs, size=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Null and blank texts stay; no rows, or no items, change nothing."""
    prepare(spark)
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences, whole documents cut freely. A null or blank text is its end id; no rows, no pieces."""
    prepare(spark)
    return packed_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("ngram_jaccard_join", near_copies),
    ("benchmark_decontamination", decontamination),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces that the stages make of ``documents``; each stage is written to the shared folder and reread."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
