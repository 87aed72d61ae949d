import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from coppice.llm import quality as Q


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{name}.parquet") for name in ("documents", "labels"))
    rows = Q.score_quality(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    good = np.array([r.score for r in rows if r.quality == 1])
    bad = np.array([r.score for r in rows if r.quality == 0])
    assert len(good) > 50 and len(bad) > 5
    assert (good[:, None] > bad[None, :]).mean() > 0.97
    assert np.mean([(r.predicted == 1) == (r.quality == 1) for r in rows]) > 0.95


def test_columns_and_folds(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{name}.parquet") for name in ("documents", "labels"))
    rows = Q.score_quality(docs, labels).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    # Labels of held-out rows change nothing.
    held = Q.held_out()
    changed = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r.doc_id: r.score for r in Q.score_quality(docs, changed).collect()}
    assert again == {r.doc_id: r.score for r in rows}


def test_bradley_terry_learns_a_ranking():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, len(Q.FEATURES)))
    worth = 2 * x[:, 0] - x[:, 1]
    good = worth + rng.normal(scale=0.2, size=600) > -1
    model = Q.fit(x, good)
    score = model.score(x)
    assert np.corrcoef(score.argsort().argsort(), worth.argsort().argsort())[0, 1] > 0.9
    # As many documents lie below the threshold as have a bad label.
    assert (score < Q.THRESHOLD).sum() == (~good).sum()


@pytest.mark.parametrize("kind", [True, False])
def test_labels_of_one_kind(kind):
    model = Q.fit(np.ones((5, len(Q.FEATURES))), np.full(5, kind))
    assert ((model.score(np.zeros((3, len(Q.FEATURES)))) >= Q.THRESHOLD) == kind).all()


def test_features():
    assert Q.features(None) == Q.features("") == Q.features(" \n")
    for text in ("a", "A!! B!!", "é" * 10, "x " * 50_000, "\x00"):
        row = Q.features(text)
        assert len(row) == len(Q.FEATURES) and np.isfinite(row).all()


def test_odd_rows(spark, odd, odd_rows, empty):
    labels = spark.createDataFrame([(5, 1, 0), (4, 0, 0), (4, 1, 0), (None, 0, 0), (7, None, 1)], "doc_id long, quality int, toxic int")
    rows = Q.score_quality(odd, labels).collect()
    assert len(rows) == len(odd_rows) and all(0 <= r.score <= 1 for r in rows)
    blank = {r.score for r, (_, t) in zip(sorted(rows, key=lambda r: repr(r.doc_id)), sorted(odd_rows, key=lambda r: repr(r[0]))) if t == ""}
    assert len(blank) <= 1
    for some, known in ((empty, labels), (odd, labels.filter("false"))):
        assert len(Q.score_quality(some, known).collect()) == some.count()
    assert Q.score_quality(odd, labels, limit=1).count() == len(odd_rows)


def test_statistics_cover_more_rows_than_the_sample(spark, make):
    """Weights may come from a sample; mean, spread and threshold come from all labelled rows."""
    rng = np.random.default_rng(5)
    word = lambda odd: "".join(rng.choice(list("abcdefgh!" if odd else "abcdefgh"), 4))
    rows = [(i, " ".join(word(i % 3 == 0) for _ in range(rng.integers(3, 30)))) for i in range(600)]
    labels = spark.createDataFrame([(i, int(i % 3 != 0 or i % 2)) for i, _ in rows], "doc_id long, quality int")
    features = Q.statistics(make(rows)).cache()
    x = np.array([Q.features(text) for _, text in rows])
    good = np.array([r.quality > 0 for r in labels.orderBy("doc_id").collect()])
    for limit in (120, 1000):
        model = Q.train(features, labels, F.lit(True), limit)
        assert np.allclose(model.mean, x.mean(0), atol=1e-9) and np.allclose(model.spread, np.maximum(x.std(0), 1e-6), atol=1e-6)
        raw = np.sort(model.raw(x))
        assert model.threshold == (raw[(~good).sum() - 1] + raw[(~good).sum()]) / 2


@pytest.mark.parametrize("most", [0, 3, 1000])
def test_order_statistics_are_exact(spark, most):
    rng = np.random.default_rng(6)
    raw = np.concatenate([rng.normal(size=60), np.full(20, 0.25), [0.0, -0.0, -0.25, 1e300, -1e-300]])
    keys = spark.createDataFrame([(int(k),) for k in Q._keys(raw)], "key long")
    want = np.sort(raw)
    for rank in (0, 30, int(np.searchsorted(want, 0.25)), int(np.searchsorted(want, 0.25)) + 19, len(raw) - 1):
        assert Q.order_statistics(keys, rank, most) == (want[rank], want[min(rank + 1, len(raw) - 1)])
