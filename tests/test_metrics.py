import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.sql import functions as F

from coppice.operators.metrics import accuracy, confusion, per_class, summary, weighted_f1
from plans_text import exchanges, plan_of

SCHEMA = "label double, prediction double"


def evaluate(df, metric):
    return MulticlassClassificationEvaluator(metricName=metric).evaluate(df)


def test_class_never_hit_and_claim_that_is_no_label(spark):
    df = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0), (2.0, 3.0), (4.0, 4.0)], SCHEMA)
    counts = confusion(df, "label")
    assert weighted_f1(counts).first().f1 == pytest.approx(0.583333, abs=1e-6)
    assert accuracy(counts).first().accuracy == 0.5
    scores = {r["class"]: (r.support, r.precision, r.recall, r.f1) for r in per_class(counts).collect()}
    assert scores == {
        1.0: (2, 1.0, 0.5, pytest.approx(2 / 3)),
        2.0: (1, 0.0, 0.0, 0.0),
        4.0: (1, 1.0, 1.0, 1.0),
    }


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 6)), min_size=1, max_size=60))
def test_equal_to_the_evaluator(spark, pairs):
    df = spark.createDataFrame([(float(a), float(b)) for a, b in pairs], SCHEMA)
    row = summary(confusion(df, "label")).first()
    assert row.n_rows == len(pairs)
    assert row.f1 == pytest.approx(evaluate(df, "f1"), abs=1e-12)
    assert row.accuracy == pytest.approx(evaluate(df, "accuracy"), abs=1e-12)


def test_equal_to_the_evaluator_when_one_label_holds_most_rows(spark):
    df = spark.range(100000).select(
        F.when(F.rand(1) < 0.9, 0).otherwise((F.rand(2) * 5).cast("int")).cast("double").alias("label"),
        (F.rand(3) * 5).cast("int").cast("double").alias("prediction"),
    ).persist()
    row = summary(confusion(df, "label")).first()
    assert row.f1 == pytest.approx(evaluate(df, "f1"), abs=1e-12)
    assert row.accuracy == pytest.approx(evaluate(df, "accuracy"), abs=1e-12)
    df.unpersist()


def test_by_group(spark):
    rng = random.Random(7)
    rows = [(g, float(rng.randint(0, 3)), float(rng.randint(0, 3))) for g in range(3) for _ in range(50)]
    df = spark.createDataFrame(rows, f"g int, {SCHEMA}")
    found = {r.g: r.f1 for r in weighted_f1(confusion(df, "label", by=["g"]), by=["g"]).collect()}
    for g in range(3):
        assert found[g] == pytest.approx(evaluate(df.filter(F.col("g") == g), "f1"), abs=1e-12)


def test_no_rows_score_zero(spark):
    counts = confusion(spark.createDataFrame([], SCHEMA), "label")
    assert summary(counts).collect() == [(0, 0.0, 0.0)]
    assert weighted_f1(counts).first().f1 == 0.0
    assert accuracy(counts).first().accuracy == 0.0


def test_null_label_fails(spark):
    df = spark.createDataFrame([(None, 1.0)], SCHEMA)
    with pytest.raises(Exception, match="null in column label"):
        confusion(df, "label").collect()


def test_plan_shuffles_counts_only(spark, sf):
    df = spark.read.parquet(f"{sf}/lineitem.parquet")
    counts = confusion(df, "l_linenumber", "l_quantity")
    plan = plan_of(counts)
    assert exchanges(counts) == 1
    assert "ReadSchema: struct<l_linenumber:int,l_quantity:double>" in plan
    assert plan.count("HashAggregate") >= 2 and "Python" not in plan
