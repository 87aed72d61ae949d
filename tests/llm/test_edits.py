import hashlib
import random

import numpy as np
import pytest

from coppice.llm.edits import (
    _dwell,
    _parsed,
    coarser,
    fingerprint,
    fingerprints,
    level_of,
    likeness,
    PERIOD,
    sample_steps,
    similar,
    walk,
    with_next,
    _codes,
)


def near(a, b):
    return likeness(_parsed(fingerprint(a)), _parsed(fingerprint(b)))


def brute(rows):
    """The contract's columns from sorted rows, each text fingerprinted from scratch."""
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    for (doc_id, text), (_, after) in zip(rows, rows[1:] + rows[:1]):
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        yield (
            doc_id,
            len(text),
            hashlib.sha256(edited.encode()).hexdigest(),
            fingerprint(text),
            fingerprint(edited),
            near(text, edited),
            near(text, after),
        )


@pytest.mark.parametrize("partitions", ["1", "8"])
def test_with_next_as_by_brute_force(spark, sf, odd, odd_rows, partitions):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        for df, rows in ((docs, [(r.doc_id, r.text) for r in docs.collect()]), (odd, odd_rows)):
            found = [tuple(r) for r in with_next(df).collect()]
            assert sorted(found, key=repr) == sorted(brute(rows), key=repr)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_one_row_and_none(make, empty):
    row = with_next(make([(5, "abcdefgh")])).first()
    assert row.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest() and row.near_next == 1.0
    assert with_next(empty).collect() == []


def test_edits_move_few_samples():
    rng = random.Random(1)
    text = "".join(rng.choice("abcdefghij klmnop") for _ in range(3000))
    other = "".join(rng.choice("abcdefghij klmnop") for _ in range(3000))
    edited = list(text)
    for _ in range(20):
        edited.insert(rng.randrange(len(edited)), "z")
        del edited[rng.randrange(len(edited))]
    assert near(text, text) == 1.0 and near(text, other) < 0.1
    assert near(text, "".join(edited)) > 0.7
    assert near(text, text[:2400]) > 0.7 and near(text, text[:1300]) > 0.3
    assert near("", "") == 1.0 and near("", "a") == 0.0


def test_walks():
    assert set(_dwell()) >= {1, 2, 3} and min(_dwell()) == 1
    steps = walk(_codes("hello" * 2000))
    assert all(a < b for a, b in zip(steps, steps[1:])) and 1.8 < steps[-1] / 10_000 < 2.2
    # A walk goes on from where it is.
    assert walk(_codes("lo"), walk(_codes("hel"))[-1])[-1] == walk(_codes("hello"))[-1]
    assert PERIOD & (PERIOD - 1) == 0


def test_grids():
    assert [level_of(n) for n in (0, 1, 42, 43, 85, 86)] == [0, 0, 0, 1, 1, 2]
    for level in (1, 3, 6):
        fine = sample_steps(level - 1)
        assert set(sample_steps(level)[:64]) <= set(fine)
        assert (coarser(level - 1, fine.astype(np.int64) % 251 + 1, level)[:64] == sample_steps(level)[:64] % 251 + 1).all()


def test_similar_queries(spark, make):
    rng = random.Random(2)
    base = ["".join(rng.choice("abcdefghij klmnop") for _ in range(900)) for _ in range(30)]
    rows = [(i, t) for i, t in enumerate(base)] + [(100 + i, t[:700] + base[i - 1][:200]) for i, t in enumerate(base)] + [(200, ""), (201, base[0])]
    prints = fingerprints(make(rows))
    queries = prints.filter("doc_id < 30").selectExpr("doc_id as query_id", "fingerprint")
    found = {(r.query_id, r.doc_id) for r in similar(queries, prints).collect()}
    text = dict(rows)
    want = {(q, d) for q in range(30) for d in text if near(text[q], text[d]) >= 0.5 and text[d]}
    assert len(found & want) >= 0.9 * len(want) and found <= want
    assert {(i, 100 + i) for i in range(30)} <= found and (0, 201) in found
