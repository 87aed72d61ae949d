"""A training corpus in five stages, each over all that the one before kept.

Good documents are kept, one of each group of near copies stays, repeated passages are
cut, documents that hold benchmark text go, and what is left is mixed by source.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coppice.llm.common import pick, stored
from coppice.llm.decontaminate import contamination, matches
from coppice.llm.jaccard import similar_groups
from coppice.llm.quality import score_quality
from coppice.llm.queries import mix_documents, table
from coppice.llm.substrings import without_repeats

# Fixed value: the columns of documents.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
# Ids of documents with leaks that are sent to every task; more are joined, which moves the texts.
MAX_SENT = 200_000


def _having(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents whose doc_id is in ``ids``; a null one is kept if ``ids`` holds a null."""
    wanted = ids.select(F.col("doc_id").alias("_id")).distinct()
    rows = pick(docs, *COLUMNS)
    return rows.join(wanted, rows["doc_id"].eqNullSafe(wanted["_id"]), "left_semi")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts to be good. Of rows that share a
    doc_id, all stay if one is good. A null or empty text is scored like any; an empty table stays empty."""
    return _having(docs, score_quality(docs, table(spark, sf_dir, "labels")).filter("predicted = 1"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest doc_id; of
    equal rows one. Documents without words are no copies of each other and stay. Rows
    with different texts under one doc_id stay or go together."""
    groups = similar_groups(docs)
    first = F.col("doc_id").eqNullSafe(F.col("component_id"))
    kept = _having(docs, groups.filter(first))
    # Rows under one doc_id with the same text are one document.
    return kept.dropDuplicates(["doc_id", "text"])


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The texts without passages that an earlier document holds. A document of which
    nothing but blanks is left goes; one that was so before stays, and so does a null text."""
    cut = without_repeats(pick(docs, *COLUMNS))
    left = (F.size("removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return cut.filter(left).withColumn("n_chars", F.when(F.size("removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(
        *COLUMNS
    )


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item. Of rows that share a doc_id, all
    go if one is hit. A null or empty text stays; an empty table stays empty."""
    found = contamination(matches(docs, table(spark, sf_dir, "benchmark"), slack=None))
    bad = stored(found.filter("contaminated").select(F.col("doc_id").alias("_id")).distinct(), "leaks")
    bad = F.broadcast(bad) if bad.count() <= MAX_SENT else bad
    rows = pick(docs, *COLUMNS)
    return rows.join(bad, rows["doc_id"].eqNullSafe(bad["_id"]), "left_anti")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents taken, with size, source_size, target and taken (words, repeats counted). A
    null text or one without words is never taken; an empty table gives no rows."""
    mixed = mix_documents(docs, keep=("text", "lang", "n_chars"))
    return mixed.filter("taken > 0").select(*COLUMNS, "size", "source_size", "target", "taken")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_leaks", benchmark_leaks),
    ("mixture", mixture),
]

# A classifier that is fitted has no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
