import hashlib
import random
import zlib

import pytest

from coppice.llm.runs import Run, collapsed, find_runs, periodic_runs, planted, strongest


def brute(words):
    """Every lag, every stretch, and whether a shorter period does."""
    out = []
    for q in range(1, len(words) // 3 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            stretch = words[i : j + q]
            if len(stretch) >= max(24, 3 * q) and not any(stretch[d:] == stretch[:-d] for d in range(1, q)):
                out.append(Run(i, len(stretch), q))
            i = max(j, i + 1)
    return sorted(out, key=lambda run: (run.start, run.period))


def texts(seed):
    rnd = random.Random(seed)

    def some(n, kinds):
        return [rnd.randrange(kinds) for _ in range(n)]

    kinds = rnd.choice([1, 2, 3, 50, 1000])
    yield some(rnd.randrange(900), kinds)
    period = some(rnd.randrange(1, 300), kinds)
    yield some(rnd.randrange(100), kinds) + period * rnd.randrange(2, 7) + period[: rnd.randrange(200)] + some(50, kinds)
    # Long stretches of one word inside a long period.
    yield ([0] * rnd.randrange(1, 150) + [1]) * rnd.randrange(2, 8)
    short = some(rnd.randrange(1, 12), kinds) * rnd.randrange(1, 20) + [1] * rnd.randrange(50)
    yield some(30, kinds) + (short * rnd.randrange(2, 6))[:1500] + some(30, kinds)
    # Fibonacci words are full of repeats that are just short of a run.
    a, b = ["a"], ["b", "a"]
    while len(b) < rnd.randrange(5, 900):
        a, b = b, b + a
    yield b
    broken = some(rnd.randrange(60, 200), kinds) * 4
    for _ in range(rnd.randrange(4)):
        broken[rnd.randrange(len(broken))] = "z"
    yield broken


@pytest.mark.parametrize("seed", range(25))
def test_runs_are_those_of_brute_force(seed):
    given = list(texts(seed))
    assert find_runs(given) == [brute(words) for words in given]


def test_edges():
    assert find_runs([]) == [] and find_runs([[]]) == [[]]
    assert find_runs([["a"] * 23, ["a"] * 24]) == [[], [Run(0, 24, 1)]]
    assert find_runs([list("abcdefgh") * 3, list("abcdefghi") * 3][:1]) == [[Run(0, 24, 8)]]
    # Equal neighbours do not run into each other.
    assert find_runs([["a"] * 20, ["a"] * 20]) == [[], []]
    for q in (63, 64, 65, 127, 128, 129, 256, 257, 700):
        words = [f"w{i}" for i in range(q)]
        assert find_runs([words * 3]) == [[Run(0, 3 * q, q)]] and find_runs([(words * 3)[1:]]) == [[]]


def test_strongest_and_collapsed():
    assert strongest([]) is None
    assert strongest([Run(5, 30, 10), Run(2, 30, 10), Run(2, 60, 20)]) == Run(2, 30, 10)
    assert strongest([Run(0, 3_000_001, 1_000_000), Run(1, 3_000_002, 1_000_000)]) == Run(1, 3_000_002, 1_000_000)
    assert collapsed(list("xababababy"), [Run(1, 8, 2)]) == list("xaby")
    assert collapsed(list("aaaabbbb"), [Run(0, 4, 1), Run(4, 4, 1)]) == list("ab")


def plain_rewrite(words, doc_id):
    h = zlib.crc32(str(doc_id).encode())
    n = len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def row_of(words):
    runs = brute(words)
    best = max(runs, key=lambda r: (r.length / r.period, -r.start, -r.period), default=None)
    drop = {i for r in runs for i in range(r.start + r.period, r.start + r.length)}
    lines = "".join(f"{r.start},{r.length},{r.period}\n" for r in runs)
    kept = b" ".join(word for i, word in enumerate(words) if i not in drop)
    shown = (best.start, best.length, best.period, 1000 * best.length // best.period) if best else (None,) * 4
    return (len(runs), *shown, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_planted():
    rnd = random.Random(1)
    for doc_id in range(300):
        words = [b"%d" % rnd.randrange(9) for _ in range(rnd.randrange(60))]
        assert planted(words, doc_id) == plain_rewrite(words, doc_id)
    assert planted([b"a"], None) == [b"a"]


def test_odd_rows(odd, odd_rows):
    out = periodic_runs(odd, planted).collect()
    found = [(repr(row.doc_id), *row[1:8]) for row in out]
    expected = []
    for doc_id, text in odd_rows:
        words = (text or "").encode().split()
        if len(words) > 1000:
            assert doc_id in (7, 8)
            continue
        expected.append((repr(doc_id), *row_of(words if doc_id is None else plain_rewrite(words, doc_id))))
    short = [row for row in found if row[0] not in ("7", "8")]
    assert sorted(short, key=repr) == sorted(expected, key=repr)
    # The very long texts are one run of seven words and what follows it.
    assert {row[1:5] for row in found if row[0] in ("7", "8")} == {(1, 0, 28000, 7)}
    assert len(out) == len(odd_rows)


def test_real_documents(spark, sf):
    """Every document of up to 600 words against brute force."""
    documents = spark.read.parquet(f"{sf}/documents.parquet")
    found = {row.doc_id: tuple(row[1:8]) for row in periodic_runs(documents, planted).collect()}
    checked = 0
    for doc_id, text in documents.select("doc_id", "text").collect():
        words = plain_rewrite((text or "").encode().split(), doc_id)
        if len(words) <= 600:
            assert found[doc_id] == row_of(words)
            checked += 1
    assert checked > 100 and any(row[0] for row in found.values())


def test_empty(empty):
    assert periodic_runs(empty).collect() == []
