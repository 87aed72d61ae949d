"""Connected components of a graph of links, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coppice.llm.common import folder_of, stored
from coppice.session import remove_folder


def connected(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Per linked node its component's smallest label: node, root (the node that has it), label.

    ``nodes`` has node and label (a node without label ranks last), ``links`` has a and b.
    Each round takes the smallest label among a node and its neighbours, tells it to the node whose
    label it had so far as well, aggregated in each task before the shuffle, and then takes that label's own;
    so rounds grow with the logarithm of a component's width. Labels are written after each round.
    """
    both = stored(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    linked = both.select(F.col("a").alias("node")).distinct().join(nodes, "node")
    best = F.struct(F.col("label").isNull().alias("last"), "label", F.col("node").alias("root"))
    labels = stored(linked.select("node", best.alias("best")), "labels")
    jumped_from = folder_of(labels)
    kind = labels.schema["best"].dataType
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), F.col("best").alias("near")), "b")
        lower = near.join(labels, near["a"] == labels["node"]).filter(F.col("near") < F.col("best"))
        to_both = F.array(F.struct(F.col("a").alias("node"), "near"), F.struct(F.col("best.root").alias("node"), "near"))
        told = lower.select(F.inline(to_both)).select("node", F.col("near").alias("found"), F.lit(None).cast(kind).alias("before"))
        own = labels.select("node", F.col("best").alias("found"), F.col("best").alias("before"))
        grown = own.union(told).groupBy("node").agg(F.min("found").alias("found"), F.max("before").alias("before"))
        ahead = labels.select(F.col("node").alias("root"), F.col("best").alias("ahead"))
        least = F.least("found", "ahead")
        jumped = grown.join(ahead, grown["found.root"] == ahead["root"]).select(
            "node", least.alias("best"), (least != F.col("before")).alias("moved")
        )
        jumped, before = stored(jumped, "labels"), jumped_from
        if before:
            remove_folder(both.sparkSession, before)
        jumped_from = folder_of(jumped)
        labels = jumped.select("node", "best")
        if jumped.filter("moved").isEmpty():
            return labels.select("node", F.col("best.root").alias("root"), F.col("best.label").alias("label"))


def joined(nodes: DataFrame, found: DataFrame, links: DataFrame) -> DataFrame:
    """The components of all links so far, as :func:`connected` gives them: those ``found`` before, and
    the ``links`` since. These are followed between roots alone, since a root has its component's smallest
    label; what no new link reaches is not gone through again.
    """
    old = found.select("node", "root", "label")
    ends = links.select("a", "b")
    for end in ("a", "b"):
        to = old.select(F.col("node").alias(end), F.col("root").alias("to"))
        ends = ends.join(to, end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
    among = connected(nodes, stored(ends.filter("a != b").distinct(), "ends"))
    new = among.select(F.col("node").alias("root"), F.col("root").alias("new_root"), F.col("label").alias("new_label"))
    moved = old.join(new, "root", "left")
    moved = moved.select("node", F.coalesce("new_root", "root").alias("root"), F.when(F.col("new_root").isNull(), F.col("label")).otherwise(F.col("new_label")).alias("label"))
    return stored(moved.union(among.join(old, "node", "left_anti").select("node", "root", "label")), "components")
