import pytest
from pyspark.sql.types import StructType

from coppice.functions.names import clean_name
from coppice.operators.columns import clean_columns, split_columns
from coppice.operators.features import training_pair
from coppice.sources.delimited import read_delimited


@pytest.mark.parametrize(
    ("header", "names"),
    [
        ("fixed acidity;pH;quality", ["fixed acidity", "ph", "quality"]),
        ('"fixed acidity";"pH";"quality"', ["fixed acidity", "ph", "quality"]),
        ('""""fixed acidity"""";""""pH"""";""""quality""""', ["fixed acidity", "ph", "quality"]),
        ('"""fixed acidity"";""pH"";""quality"""', ["fixed acidity", "ph", "quality"]),
        (" Fixed Acidity ; pH;quality ", ["fixed acidity", "ph", "quality"]),
        ("a.b;quality", ["a.b", "quality"]),
        ("a;;quality", ["a", "_c1", "quality"]),
        ("A;a;quality", ["a0", "a1", "quality"]),
    ],
)
def test_headers(spark, text_file, header, names):
    row = ";".join("1" * len(names))
    df = clean_columns(read_delimited(spark, text_file(f"{header}\n{row}\n")))
    assert df.columns == names
    assert df.count() == 1


def test_quotes_go_before_blanks():
    assert clean_name('" pH "') == "ph"


def test_names_that_become_equal(spark):
    df = spark.createDataFrame([(1, 2)], "`a ` int, a int")
    with pytest.raises(ValueError, match="'a'"):
        clean_columns(df)


def test_split_by_position(spark):
    df = spark.createDataFrame([], StructType.fromDDL("a int, b int, c int, quality int"))
    assert split_columns(df, drop=["b", "not there"]) == (["a", "c"], "quality")


def test_split_by_name(spark):
    df = spark.createDataFrame([], StructType.fromDDL("quality int, a int, b int"))
    assert split_columns(df, "quality") == (["a", "b"], "quality")
    with pytest.raises(ValueError, match="no label"):
        split_columns(df, "grade")


def test_training_pair(spark):
    df = spark.createDataFrame([(1, 2.5, True, 7, "k")], "`fixed acidity` int, b double, flag boolean, quality int, k string")
    pair = training_pair(df, ["fixed acidity", "b", "flag"], "quality", classes=8, keep=["k"])
    row = pair.first()
    assert pair.columns == ["features", "quality", "k"]
    assert list(row.features) == [1.0, 2.5, 1.0] and row.quality == 7.0
    assert pair.schema["quality"].metadata["ml_attr"]["num_vals"] == 8


def test_null_and_nan_features(spark):
    df = spark.createDataFrame([(1.0, 1), (None, 1), (float("nan"), 1)], "a double, quality int")
    with pytest.raises(Exception, match="null|NaN"):
        training_pair(df, ["a"], "quality").collect()
    assert training_pair(df, ["a"], "quality", invalid="skip").count() == 1
    assert training_pair(df, ["a"], "quality", invalid="keep").count() == 3


def test_text_feature_is_refused(spark):
    df = spark.createDataFrame([("x", 1)], "s string, quality int")
    with pytest.raises(Exception, match="string"):
        training_pair(df, ["s"], "quality")


def test_dotted_feature(spark):
    df = spark.createDataFrame([(1.5, 2, 1)], "`a.b` double, c int, quality int")
    assert list(training_pair(df, ["a.b", "c"], "quality").first().features) == [1.5, 2.0]
