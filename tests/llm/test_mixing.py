import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from coppice.llm.common import pick
from coppice.llm.mixing import mix
from coppice.llm.queries import mix_documents


def water(sizes, weights=(1, 2, 3), share=1.0, epochs=3):
    """Targets by resharing the excess round after round."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, left, open_ = dict.fromkeys(order, 0.0), sum(sizes.values()) * share, set(order)
    while left > 1e-9 and open_:
        total = sum(weight[s] for s in open_)
        part = {s: left * weight[s] / total for s in open_}
        left = 0.0
        for s in list(open_):
            target[s] += part[s]
            cap = epochs * sizes[s]
            if target[s] >= cap:
                left += target[s] - cap
                target[s] = float(cap)
                open_.discard(s)
    return target


def check(rows, **kwargs):
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in rows:
        sizes[r.source] += r["size"]
        taken[r.source] += r.taken
    want = water(sizes, **kwargs)
    epochs = kwargs.get("epochs", 3)
    for r in rows:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source], rel=1e-9, abs=1e-6)
        whole = min(epochs, int(round(r.target)) // max(r.source_size, 1))
        assert whole * r["size"] <= r.taken <= min(epochs, whole + 1) * r["size"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 1
    # At most one document of a source is cut.
    parts = defaultdict(int)
    for r in rows:
        parts[r.source] += bool(r["size"] and r.taken % r["size"])
    assert max(parts.values(), default=0) <= 1


@pytest.mark.parametrize("seed", range(4))
def test_targets_and_sums(spark, seed):
    rng = random.Random(seed)
    rows = []
    for source in [None, "", "a", "é", "b", "Z", "z" * 3][: rng.randint(2, 7)]:
        rows += [(source, rng.choice([0, 1, 5, 100, rng.randint(1, 3000)])) for _ in range(rng.choice([1, 2, 30, 200]))]
    docs = spark.createDataFrame([(i, s, n) for i, (s, n) in enumerate(rows)], "doc_id long, source string, n long")
    share = rng.choice([0.5, 1.0, 2.0, 9.0])
    check(mix(docs, F.col("n"), F.lit(1.0), share=share).collect(), share=share)


def test_same_mix_on_any_layout(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    runs = [sorted(map(tuple, mix_documents(df).collect())) for df in (docs, docs.repartition(7), docs.repartition(3, "text"))]
    assert runs[0] == runs[1] == runs[2]


def test_better_documents_come_first(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), (F.col("id") % 2).alias("good"))
    half = mix(docs, F.lit(1), F.when(F.col("good") == 1, 3.0).otherwise(1.0), share=0.5, keep=["good"])
    share = half.filter("taken > 0").agg(F.avg("good")).first()[0]
    # Of keys with rates 3 and 1, the half of smallest ones: 1 - t^3 + 1 - t = 1, t = 0.6823.
    assert share == pytest.approx(1 - 0.6823**3, abs=0.03)


def test_odd_rows(odd, empty, odd_rows):
    rows = mix_documents(odd).collect()
    assert len(rows) == len(odd_rows)
    check(rows)
    assert mix_documents(empty).collect() == []
    none = mix_documents(pick(odd, "doc_id", "source", "text").filter("text is null")).collect()
    assert {(r["size"], r.source_size, r.target, r.taken) for r in none} == {(0, 0, 0.0, 0)}
    assert [r.taken for r in mix(odd.limit(1), F.lit(None), F.lit(-1.0)).collect()] == [0]
