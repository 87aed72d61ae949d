"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document draws the key ``-ln(u) / quality``; the smallest keys come first, so a
better document tends to stand earlier. A source gives as many complete passes (epochs)
as its target holds, and then the documents of smallest key up to what is left; the one
on the line is taken up to the line.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coppice.llm.common import stored

# Slices of the key range, twice: an exact running sum is taken in one slice of a slice.
SLICES = 4096


def draw(key: Column, seed: int) -> Column:
    """A number in (0, 1) that follows from the key alone."""
    digits = F.substring(F.md5(F.concat_ws("-", key.cast("string"), F.lit(seed).cast("string"))), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def targets(sizes: DataFrame, weights: Sequence[float], share: float, max_epochs: int) -> DataFrame:
    """Target of each source. ``sizes`` has a row per source: source, source_size.

    Sources by code point, null last, have the weights in turn. A target ends at
    ``max_epochs`` times its source; what it would have above goes to the others by
    weight, until none is above. Sources ordered by what each can take per weight make
    that one pass: the first ones are full, the rest share what those leave.
    """
    turn = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(turn) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), place + 1)
    capped = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(max_epochs))
    by_room = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_room.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_room.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everywhere = Window.partitionBy()
    left = F.sum("source_size").over(everywhere) * F.lit(share) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    level = F.greatest(left / F.sum("weight").over(onward), F.lit(0.0))
    # Once a source is not full, all after it have the same level.
    fits = F.col("level") * F.col("weight") <= F.col("cap")
    first_level = F.min(F.when(fits, F.struct("room", "level"))).over(everywhere)["level"]
    target = F.least(F.coalesce(first_level * F.col("weight"), F.col("cap").cast("double")), F.col("cap").cast("double"))
    return (
        capped.withColumns({"level": level, "room": F.row_number().over(by_room)})
        .withColumn("target", target)
        .select("source", "source_size", "target")
    )


def _line(parts: DataFrame, slice_name: str, rest: str, keys: Sequence[str]) -> DataFrame:
    """Per source the slice in which the running sum of sizes reaches ``rest``, and the
    rest that is left for that slice."""
    order = Window.partitionBy(*keys).orderBy(slice_name)
    upto = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = parts.withColumn("upto", upto).filter((F.col("upto") >= F.col(rest)) & (F.col("upto") - F.col("size") < F.col(rest)))
    return found.select(*keys, slice_name, (F.col(rest) - F.col("upto") + F.col("size")).alias(f"{slice_name}_rest"))


def mix(
    docs: DataFrame,
    size: Column,
    quality: Column,
    weights: Sequence[float] = (1, 2, 3),
    share: float = 1.0,
    max_epochs: int = 3,
    seed: int = 42,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Per row of ``docs``: doc_id, size, source_size, target (its source's), taken (the
    size taken, repeats counted), source, and the columns in ``keep``.

    ``size`` is a whole number, ``quality`` the positive weight of a document. A null
    size counts as 0 and such a document is never taken; a null or not positive quality
    counts as 1; a null source is a source of its own; a null doc_id draws like any
    other value. Documents of equal key go by doc_id and size; rows that agree in these
    too may change places. The same documents give the same mix on any cluster. An empty table
    gives no rows; texts are not read here, however long.

    No source is sorted whole: sizes are summed per slice of the key range (pre-added in
    each task), the slice that holds the line is cut again, and only the rows of that
    slice of a slice, a 16-millionth of the source, get a running sum.
    """
    number = F.coalesce(size, F.lit(0)).cast("long")
    good = F.when(quality > 0, quality).otherwise(1.0)
    key = -F.log(draw(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), seed)) / good
    place = (1 - F.exp(-F.col("key"))) * SLICES
    first = F.least(F.floor(place), F.lit(SLICES - 1))
    base = docs.select("doc_id", "source", *keep, number.alias("size"), key.alias("key"))
    base = base.withColumn("slice", first.cast("int"))
    base = base.withColumn("part", F.least(F.floor((place - F.col("slice")) * SLICES), F.lit(SLICES - 1)).cast("int"))
    base = stored(base, "mix")

    slices = stored(base.groupBy("source", "slice").agg(F.sum("size").alias("size")), "mix-slices")
    sources = targets(slices.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, max_epochs)
    budget = F.round("target").cast("long")
    epochs = F.least(F.floor(budget / F.greatest("source_size", F.lit(1))), F.lit(max_epochs)).cast("long")
    sources = sources.withColumn("epochs", epochs)
    sources = stored(sources.withColumn("rest", budget - F.col("epochs") * F.col("source_size")), "mix-sources")

    def same(left: DataFrame, right: DataFrame, *more: str):
        tests = [left[name].eqNullSafe(right[name]) for name in ("source", *more)]
        return [*tests]

    open_sources = sources.filter("rest > 0").select("source", "rest")
    within = slices.join(open_sources, same(slices, open_sources)).select(slices["source"], "slice", "size", "rest")
    line = _line(within, "slice", "rest", ["source", "rest"]).drop("rest")
    cut = base.join(line, same(base, line, "slice")).select(base["source"], base["slice"], "part", "size", "slice_rest")
    parts = cut.groupBy("source", "slice", "slice_rest", "part").agg(F.sum("size").alias("size"))
    fine = stored(_line(parts, "part", "slice_rest", ["source", "slice", "slice_rest"]), "mix-line")

    fine = fine.select("source", F.col("slice").alias("at_slice"), F.col("part").alias("at_part"), "part_rest")
    limits = sources.join(fine, same(sources, fine), "left").select(
        sources["source"], "source_size", "target", "epochs", "at_slice", "at_part", "part_rest"
    )
    limits = stored(limits, "mix-limits")
    rows = base.join(limits, same(base, limits)).drop(limits["source"])  # one row per source: no row is added
    here = F.struct("slice", "part")
    there = F.struct(F.col("at_slice").alias("slice"), F.col("at_part").alias("part"))
    away = rows.filter(F.col("at_slice").isNull() | (here != there))
    extra = F.when(F.col("at_slice").isNotNull() & (here < there), F.col("size")).otherwise(0)
    on_line = Window.partitionBy("source").orderBy("key", "doc_id", "size")
    before = F.sum("size").over(on_line.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")
    near = rows.filter(F.col("at_slice").isNotNull() & (here == there)).withColumn("before", before)
    some = F.greatest(F.lit(0), F.least(F.col("size"), F.col("part_rest") - F.col("before")))
    both = away.withColumn("extra", extra).unionByName(near.withColumn("extra", some).drop("before"))
    taken = (F.col("epochs") * F.col("size") + F.col("extra")).cast("long")
    return both.select("doc_id", "size", "source_size", "target", taken.alias("taken"), "source", *keep)
