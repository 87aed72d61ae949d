import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# Names that operators use for columns of their own, and one that differs in case.
CLASHING = ["TEXT", "n_tokens", "n", "class", "begin", "size", "taken", "score", "label", "digest", "fingerprint", "key", "row"]
LONG = "Long words in a very long text. " * 4000


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text) or (doc_id, text, source), with clashing extra columns."""

    def build(rows, partitions=3):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1])) for r in rows]
        df = spark.createDataFrame(full, SCHEMA).repartition(partitions, F.xxhash64("doc_id", "text"))
        return df.select("*", *[F.lit("x").alias(name) for name in CLASHING])

    return build


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty, blank and very long texts, ties and repeated rows."""
    twin = "one two three four five six seven eight nine ten eleven twelve"
    return [
        (1, None),
        (2, ""),
        (3, " \t\n\r\x0b\x0c "),
        (4, "word"),
        (5, twin),
        (6, twin),
        (6, twin),
        (6, "another text under the same number"),
        (None, twin + " thirteen"),
        (None, None),
        (7, LONG),
        (8, LONG + "end"),
        (9, "é́ ünï \x00 \u3000 😀 MIT License! \x85 x\u2028y"),
        ((1 << 60) + 1, "large number"),
    ]


@pytest.fixture(scope="session")
def odd(make, odd_rows):
    return make(odd_rows)


@pytest.fixture(scope="session")
def empty(make):
    return make([])
