"""Tables the registered queries derive from the given ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The columns that identify a line item.
ROW_KEY = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def separable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with a label that a deep enough forest can learn without error.

    ``quality`` depends on the quantity alone. One split cannot tell its three classes
    apart, and the best single split is clearly the one above 35.
    """
    quantity = F.col("l_quantity")
    quality = F.when(quantity <= 10, 3).when(quantity <= 35, 5).otherwise(7)
    return table(spark, sf_dir, "lineitem").select(
        *ROW_KEY, "l_extendedprice", "l_quantity", "l_discount", "l_tax", quality.alias("quality")
    )


def rule_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with a label and a prediction made by a rule, mostly wrong."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_linenumber").alias("label"),
        ((F.col("l_orderkey") + F.col("l_suppkey")) % 7 + 1).alias("prediction"),
    )


def document_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of each labelled document's whole text, and its quality label.

    The statistics are taken before the join, so a shuffle join moves five numbers per
    document and not the text.
    """
    text = F.col("text")
    words = F.filter(F.split(text, r"\s+"), lambda word: word != "")
    stats = (
        table(spark, sf_dir, "documents")
        .select("doc_id", "n_chars", text, words.alias("words"))
        .select(
            "doc_id",
            "n_chars",
            F.size("words").alias("n_words"),
            F.size(F.array_distinct("words")).alias("n_distinct"),
            F.length(F.regexp_replace(text, "[A-Za-z0-9 ]", "")).alias("n_other"),
        )
        .withColumn("distinct_share", F.col("n_distinct") / F.greatest(F.lit(1), "n_words"))
        .withColumn("other_share", F.col("n_other") / F.greatest(F.lit(1), "n_chars"))
        .drop("n_other")
    )
    return stats.join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
