import hashlib
import re

import numpy as np
import pytest

from pyspark.sql import functions as F

from coppice.llm.common import pick
from coppice.llm.decontaminate import Lookup, benchmark_windows, build_index, contamination, item_windows, matches, merge, term_hashes

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, size=10):
    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(max(len(w) - size, 0) + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + size]), set()).add(str(item))
    lengths = {len(w) for w in windows}
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[tuple(w[i : i + n])]
        near = 0
        for window in windows:
            miss = [sum(a != b for a, b in zip(window, w[i:])) for i in range(len(w) - len(window) + 1)]
            near += sum(m <= (2 if len(window) > 2 else 0) for m in miss)
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        yield doc_id, len(w), len(hit), len(found), digest, bool(hit), near


def compare(spark, docs, benchmark, **kwargs):
    rows = [(r.doc_id, r.text) for r in pick(docs, "doc_id", "text").collect()]
    items = [(r.item_id, r.text) for r in benchmark.collect()]
    found = [tuple(r) for r in contamination(matches(docs, benchmark, **kwargs)).collect()]
    assert sorted(found, key=repr) == sorted(brute(rows, items), key=repr)
    return found


@pytest.mark.parametrize(("max_bytes", "shard_words"), [(1 << 24, 2_000_000), (30_000, 2_000_000), (1 << 24, 5000)])
def test_given_tables(spark, sf, max_bytes, shard_words):
    """All columns, however the windows and the documents are cut."""
    docs, benchmark = (spark.read.parquet(f"{sf}/{name}.parquet") for name in ("documents", "benchmark"))
    docs = docs.filter(F.length("text") < 2500)  # brute force compares every window with every place
    found = compare(spark, docs, benchmark, max_bytes=max_bytes, shard_words=shard_words)
    assert any(row[5] for row in found) and not all(row[5] for row in found)


ITEMS = [
    (1, "a b c d e f g h i j k l"),
    (2, "x y z"),
    (10, "one"),
    (3, "a a a a a a a a a a a"),
    (4, ""),
    (5, None),
    (6, "c d e f g h i j k l"),
    (7, "Large, number"),
]
TEXTS = [
    (1, "0 A-b c d e f g h i j; k l m a b c d e f g h i j"),
    (2, "x y. Z x y z"),
    (3, "One two one"),
    (4, "a " * 25),
    (5, "a b c d e f g h i"),
    (6, "x y"),
    (7, "z"),
]


def test_made_cases(spark, make, odd, empty):
    benchmark = spark.createDataFrame(ITEMS, "item_id long, text string")
    for docs in (make(TEXTS), odd.filter("doc_id is null or doc_id not in (7, 8)"), empty):
        for max_bytes in (1 << 24, 20):
            compare(spark, docs, benchmark, max_bytes=max_bytes)
    # Very long texts too, whole.
    long = {r.doc_id: r for r in contamination(matches(odd, spark.createDataFrame([(1, "very long text")], "item_id long, text string"))).collect()}
    assert (long[7].n_hit, long[7].n_words, long[7].contaminated) == (12000, 28000, True)
    none = contamination(matches(odd, benchmark.filter("false"))).collect()
    assert len(none) == odd.count() and not any(r.contaminated for r in none)


def test_documents_of_a_batch_do_not_run_together(spark, make):
    docs = make([(1, "a b c d e"), (2, "f g h i j")], partitions=1)
    benchmark = spark.createDataFrame([(1, "a b c d e f g h i j")], "item_id long, text string")
    assert [r.n_hit for r in contamination(matches(docs, benchmark)).collect()] == [0, 0]


def test_proximity(spark, make):
    base = "a b c d e f g h i j".split()
    two, three = base.copy(), base.copy()
    two[0] = two[5] = "?x"
    three[1] = three[4] = three[9] = "x"
    docs = make([(1, " ".join(base)), (2, " ".join(two)), (3, " ".join(three)), (4, "b c d e f g h i j"), (5, "x b c d e f g h i j")], 1)
    benchmark = spark.createDataFrame([(1, " ".join(base))], "item_id long, text string")
    found = {r.doc_id: (r.n_hit, r.n_near) for r in contamination(matches(docs, benchmark)).collect()}
    assert found == {1: (10, 1), 2: (0, 1), 3: (0, 0), 4: (0, 0), 5: (0, 1)}


def test_windows_and_ranges():
    assert item_windows([(1, "a b c")], 2).windows == [(0, 1), (1, 2)]
    assert merge([(5, 8), (0, 3), (2, 4), (4, 5)]) == [(0, 8)]


def test_equal_items_are_one_window_in_any_part(spark, make):
    docs = make([(1, "a b c d e f g h i j")])
    benchmark = spark.createDataFrame([(i, "a b c d e f g h i j") for i in range(3)], "item_id long, text string")
    for max_bytes in (1 << 20, 1):
        (row,) = contamination(matches(docs, benchmark, max_bytes=max_bytes)).collect()
        assert (row.n_hit, row.n_items, row.n_near) == (10, 3, 1)


def test_index_holds_every_posting(spark, make, odd, odd_rows):
    """Each word of each document at its place, and nothing else; several shards."""
    for shard_words in (10, 50_000):
        total = 0
        for row in build_index(odd, 10, shard_words).collect():
            stands = {}
            for i, term in enumerate(row.terms):
                for place in row.places[row.bounds[i] : row.bounds[i + 1]]:
                    stands[place] = term
            total += len(stands)
            for start, size in zip(row.starts, row["sizes"]):
                assert all(place in stands for place in range(start, start + size))
            assert len(stands) == sum(row["sizes"]) and row.terms == sorted(row.terms)
        assert total == sum(len(words(text)) for _, text in odd_rows)


def test_windows_that_cannot_occur_are_not_looked_up(monkeypatch):
    """One term is missing in all of them; only as many as the slack may be."""
    from coppice.llm.decontaminate import Shard

    text = [b"w%d" % (i % 40) for i in range(200)]
    codes = term_hashes(text)
    order = np.argsort(codes, kind="stable")
    terms, bounds = np.unique(codes[order], return_index=True)
    shard = {"terms": terms, "bounds": np.append(bounds, 200), "places": order.astype(np.int32), "starts": np.zeros(1, np.int64), "sizes": np.full(1, 200)}
    known = [term_hashes([b"w%d" % ((i + j) % 40) for j in range(10)]).tolist() for i in range(5)]
    foreign = [[*window[:7], 1, 2, 3] for window in known]
    looked, starts_of = set(), Shard.starts_of
    monkeypatch.setattr(Shard, "starts_of", lambda self, windows, *given: looked.update(windows.tolist()) or starts_of(self, windows, *given))
    ((ranges, items, near),) = Lookup(known + foreign, [["a"]] * 10, 2).find(shard)
    assert looked == set(range(5)) and items == ["a"] and ranges and near == 25


def test_benchmark_windows_are_distinct(spark):
    items = spark.createDataFrame([(2, "a b c"), (1, "A b, c"), (3, "b c"), (4, None)], "item_id long, text string")
    found = sorted((r.line, r["items"]) for r in benchmark_windows(items, 2).collect())
    assert found == [("a b", ["1", "2"]), ("b c", ["1", "2", "3"])]


def test_row_groups_of_the_index_are_bounded(spark, make):
    """A task decodes a row group of the index at once: few shards, however well they are compressed, and long ones alone."""
    from urllib.parse import urlparse

    import pyarrow.parquet as pq

    def groups(docs, shard_words):
        (file,) = build_index(docs, shard_words=shard_words).inputFiles()
        found = pq.ParquetFile(urlparse(file).path).metadata
        return [(found.row_group(i).num_rows, found.row_group(i).total_byte_size) for i in range(found.num_row_groups)]

    equal = make([(i, " ".join(f"w{j}" for j in range(2000))) for i in range(40)], partitions=1)
    assert [n for n, _ in groups(equal, 2000)] == [8] * 5
    words = "concat_ws(' ', transform(sequence(1, 400000), x -> substring(md5(concat(id, '-', x)), 1, 12)))"
    long = spark.range(0, 4, 1, 1).selectExpr("id as doc_id", f"{words} as text")
    found = groups(long, 2000)
    assert sum(n for n, _ in found) == 4 and max(n for n, _ in found) <= 2
    assert max(size for _, size in found) < 20_000_000
