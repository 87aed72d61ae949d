"""Classification metrics as DataFrames.

Everything is derived from the confusion counts, so predictions are read once and
only (label, prediction) counts, already combined in each task, are shuffled: one
label that holds most of the rows costs no more than any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coppice.functions.names import quoted
from coppice.functions.scores import harmonic, ratio


def _present(name: str) -> Column:
    value = F.col(quoted(name)).cast("double")
    return F.coalesce(value, F.raise_error(F.lit(f"null in column {name}")).cast("double"))


def confusion(df: DataFrame, label: str, prediction: str = "prediction", by: Sequence[str] = ()) -> DataFrame:
    """Rows per (label, prediction), within each value of ``by``; a null fails the job."""
    pairs = df.select(*by, _present(label).alias("label"), _present(prediction).alias("prediction"))
    return pairs.groupBy(*by, "label", "prediction").agg(F.count("*").alias("n"))


def per_class(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Support, hits, precision, recall and F1 of each class that occurs as a label."""
    n, none = F.col("n"), F.lit(0).cast("bigint")
    hit = F.when(F.col("label") == F.col("prediction"), n).otherwise(none)
    as_label = F.struct(F.col("label").alias("class"), n.alias("support"), hit.alias("hits"), none.alias("claimed"))
    as_claim = F.struct(F.col("prediction").alias("class"), none.alias("support"), none.alias("hits"), n.alias("claimed"))
    sides = counts.select(*by, F.inline(F.array(as_label, as_claim)))
    totals = sides.groupBy(*by, "class").agg(*[F.sum(c).alias(c) for c in ("support", "hits", "claimed")])
    scored = totals.filter("support > 0").select(
        *by,
        "class",
        "support",
        "hits",
        ratio(F.col("hits"), F.col("claimed")).alias("precision"),
        ratio(F.col("hits"), F.col("support")).alias("recall"),
    )
    return scored.withColumn("f1", harmonic(F.col("precision"), F.col("recall")))


def weighted_f1(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """F1 over all classes, weighted by support; 0 for no rows."""
    f1 = F.sum(F.col("support") * F.col("f1")) / F.sum("support")
    return per_class(counts, by).groupBy(*by).agg(F.coalesce(f1, F.lit(0.0)).alias("f1"))


def accuracy(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Share of rows whose prediction is the label; 0 for no rows."""
    hits = F.sum(F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0))
    return counts.groupBy(*by).agg(F.coalesce(hits / F.sum("n"), F.lit(0.0)).alias("accuracy"))


def summary(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rows, weighted F1 and accuracy together, from one reading of the counts."""
    support = F.sum("support")
    return per_class(counts, by).groupBy(*by).agg(
        F.coalesce(support, F.lit(0)).alias("n_rows"),
        F.coalesce(F.sum(F.col("support") * F.col("f1")) / support, F.lit(0.0)).alias("f1"),
        F.coalesce(F.sum("hits") / support, F.lit(0.0)).alias("accuracy"),
    )


def observed_columns(label: str, classes: int, prediction: str = "prediction") -> list[Column]:
    """Aggregates from which :func:`observed_summary` has the metrics, without a group-by, so that
    they can be taken from rows on their way to a file. Predictions are below ``classes``."""
    value, claimed = (F.col(quoted(name)).cast("double") for name in (label, prediction))
    columns = [F.count("*").alias("n"), F.count_if(value.isNull() | claimed.isNull()).alias("n_null")]
    for c in range(classes):
        columns += [
            F.count_if(value == c).alias(f"support_{c}"),
            F.count_if(claimed == c).alias(f"claimed_{c}"),
            F.count_if((value == c) & (claimed == c)).alias(f"hits_{c}"),
        ]
    return columns


def observed_summary(found: dict[str, int], classes: int) -> tuple[int, float, float]:
    """n_rows, f1, accuracy as :func:`summary` has them; a null fails. A label that the model
    does not know is never hit, so its score is 0, and its rows count."""
    if found["n_null"]:
        raise ValueError(f"{found['n_null']} rows have a null label or prediction")
    total = 0.0
    for c in range(classes):
        support, claimed, hits = (found[f"{name}_{c}"] for name in ("support", "claimed", "hits"))
        # Twice the product over the sum of precision and recall.
        total += support * (2 * hits / (support + claimed) if hits else 0.0)
    n = found["n"]
    hits = sum(found[f"hits_{c}"] for c in range(classes))
    return n, total / n if n else 0.0, hits / n if n else 0.0
