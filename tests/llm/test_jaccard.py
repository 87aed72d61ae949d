import itertools
import random

import numpy as np
import pytest

from coppice.llm import jaccard as J
from coppice.llm.components import connected


def grams(text):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1)))


def brute(rows, percent=75):
    """n_shingles and smallest reachable doc_id of each row; null ranks last."""
    sets = [grams(text) for _, text in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = {}
    for i, s in enumerate(sets):
        for g in s:
            holders.setdefault(g, []).append(i)
    pairs = {pair for ids in holders.values() for pair in itertools.combinations(ids, 2)}
    for a, b in pairs:
        if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            parent[root(a)] = root(b)
    best = {}
    for i, (doc_id, _) in enumerate(rows):
        rank = (doc_id is None, doc_id or 0)
        best[root(i)] = min(best.get(root(i), rank), rank)
    ids = [best[root(i)] for i in range(len(rows))]
    return sorted([(rows[i][0], len(sets[i]), None if ids[i][0] else ids[i][1]) for i in range(len(rows))], key=repr)


def found(docs, **kwargs):
    return sorted(map(tuple, J.similar_groups(docs, **kwargs).collect()), key=repr)


def copies(seed, groups=12, size=14):
    """Groups of texts at all distances around the threshold, chains among them, with a
    passage that all share."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    shared = [rng.choice(vocabulary) for _ in range(30)]
    rows = []
    for _ in range(groups):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 8, 40, 120]))]
        now = base
        for _ in range(size):
            now = list(now if rng.random() < 0.5 else base)
            for _ in range(rng.randint(0, max(1, len(now) // 25))):
                now[rng.randrange(len(now))] = rng.choice(vocabulary)
            rows.append(" ".join(now + (shared if rng.random() < 0.4 else [])))
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize(("seed", "tile", "hot"), [(0, 1024, 1_000_000), (1, 3, 1_000_000), (2, 4, 0)])
def test_groups_as_by_brute_force(make, seed, tile, hot):
    rows = copies(seed)
    assert found(make(rows), tile=tile, hot=hot) == brute(rows)


def test_odd_rows(odd, odd_rows, empty):
    assert found(odd) == brute(odd_rows)
    assert found(empty) == []


def test_threshold_is_exact(make):
    """Sets of 7 with 6 in common (6/8 = 0.75) are linked, those with 5 are not."""
    base = [f"w{i}" for i in range(11)]
    six = " ".join(base[1:] + ["x"])
    five = " ".join(base[2:] + ["y", "z"])
    rows = [(1, " ".join(base)), (2, six), (3, five)]
    assert found(make(rows)) == brute(rows)
    assert {r[0]: r[2] for r in brute(rows)} == {1: 1, 2: 1, 3: 3} or {r[0]: r[2] for r in brute(rows)}[2] == 1


def test_bound_is_never_below_the_overlap():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 4000, n).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for n in (3, 20, 70, 75, 90, 300, 310)]
    sets.sort(key=len)
    members = J.Members(np.array([len(s) for s in sets]), [np.frombuffer(J.signature(s), np.uint8) for s in sets])
    for i in range(1, len(sets)):
        for low in (0, i - 1):
            common = [len(np.intersect1d(sets[i], sets[j])) for j in range(low, i)]
            assert (members.bounds(i, low) >= common).all()


def test_prefix():
    for n in range(1, 200):
        for common in range(n + 1):
            # If a similar set can miss so many, the prefix is longer than that.
            if 100 * common >= 75 * n:
                assert n - common < J.prefix_size(n, 75)


def test_long_runs_leave_in_pieces(spark):
    sets = spark.createDataFrame([(c, c % 7 + 1, [1, 2] if c < 500 else [c], []) for c in range(700)], "class long, n long, prefix array<long>, hot array<long>")
    tiles = J._tiles(sets.repartition(4), most=100)
    sizes = {r["tile"]: r["count"] for r in tiles.groupBy("tile").count().collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 64)
    try:
        cut = {r["tile"]: r["count"] for r in J._tiles(sets.repartition(4), most=100).groupBy("tile").count().collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert list(sizes.values()) == [500] and set(cut.values()) == {500}


def test_components(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(60)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(70)]
    nodes = spark.createDataFrame([(i, None if i % 10 == 0 else 1000 - i) for i in range(200)], "node long, label long")
    rows = connected(nodes, spark.createDataFrame(links, "a long, b long")).collect()
    parent = {x: x for link in links for x in link}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[root(a)] = root(b)
    labels = {}
    for x in parent:
        labels.setdefault(root(x), []).append((x % 10 == 0, 1000 - x))
    assert {r.node: r.label for r in rows} == {x: (None if min(labels[root(x)])[0] else min(labels[root(x)])[1]) for x in parent}


def test_keys_keep_the_order_of_hashes():
    rng = np.random.default_rng(2)
    grams = np.unique(rng.integers(0, 1 << 63, 5000).astype(np.uint64) * np.uint64(2))
    for groups in (1, 7, 204, 65536):
        keys = J.keys_of(grams, groups)
        assert len(keys) == len(grams) and (keys >> np.uint64(32)).max() < groups
        # A key's counter is that of a hash with this key.
        slots = (grams >> np.uint64(64 - J.TABLE_BITS)).astype(np.int64)
        assert (np.abs(J.slots_of(keys, groups) - slots) <= 1).all() and (J.slots_of(keys, groups) == slots).mean() > 0.99


def test_prefixes_are_those_of_exact_counts(spark, make):
    """The rarest n-grams that others hold too, by all holders; none for a class whose own ones suffice."""
    rows = copies(4) + [(900, " ".join(f"own{i}" for i in range(50)))]
    docs = make(rows, partitions=1)  # a class is a holder once for each task that meets it
    sets = {J.class_of(g): g for g in (J.shingles(text) for _, text in rows) if len(g)}
    _, counts = J._sets(docs, 5)
    found = {}
    for r in J._prefixes(docs, counts, 5, 75, 1_000_000).distinct().collect():
        found.setdefault(r["class"], set()).add(r["gram"])
        assert r["n"] == len(sets[r["class"]]) and not r["late"]
    groups = 32
    holders = {}
    for key, grams in sets.items():
        for k in J.keys_of(grams, groups).tolist():
            holders[k] = holders.get(k, 0) + 1
    for key, grams in sets.items():
        keys = J.keys_of(grams, groups).tolist()
        shared = [k for k in keys if holders[k] > 1]
        size = J.prefix_size(len(grams), 75) - (len(keys) - len(shared))
        assert len(found.get(key, ())) == max(0, size) and found.get(key, set()) <= set(shared)
        if size > 0:
            step = lambda k: int(8 * np.log2(holders[k]))
            assert found[key] == set(sorted(shared, key=lambda k: (step(k), k))[:size])


def test_a_block_returns_fewer_links_than_members():
    """Also where all are similar; none where none are, and no pair is checked twice."""
    rng = np.random.default_rng(8)
    base = np.unique(rng.integers(0, 1 << 62, 400).astype(np.uint64))
    near = [np.delete(base, rng.integers(0, len(base), 20)) for _ in range(30)]
    far = [np.unique(np.concatenate([base[:200], rng.integers(0, 1 << 62, 200).astype(np.uint64)])) for _ in range(30)]
    for sets, links in ((near, 29), (far, 0)):
        sets = sorted(sets, key=len)
        n = np.array([len(s) for s in sets])
        key, side, failed = np.arange(30), np.zeros(30, np.int64), set()
        assert len(J.spanning(key, n, side, key, sets, 75, failed)) == links
        # Members of one component are not compared.
        assert J.spanning(key, n, side, np.zeros(30, np.int64), sets, 75, set()) == []
        before = set(failed)
        J.spanning(key, n, side, key, sets, 75, failed)
        assert failed == before


@pytest.mark.parametrize("few, rounds", [(0.25, {1}), (-1, {2, 3, 4})])
def test_rounds_only_while_many_are_involved(make, monkeypatch, few, rounds):
    """A few n-grams that are left go to the exact stage at once; either way no link is lost."""
    asked = []
    whole = J._likeliest
    monkeypatch.setattr(J, "FEW", few)
    monkeypatch.setattr(J, "_likeliest", lambda *args: asked.append(1) or whole(*args))
    rng = random.Random(3)
    alone = [" ".join(f"u{i}x{k}" for k in range(1000)) for i in range(200)]
    rows = copies(3, groups=2) + [(10_000 + i, text) for i, text in enumerate(alone)]
    rng.shuffle(rows)
    assert found(make(rows)) == brute(rows)
    assert len(asked) in rounds


def test_a_batch_hashes_each_word_once(monkeypatch):
    asked = []
    whole = J.xxhash.xxh3_64_intdigest
    texts = ["a b c d e f", None, "", "A b " * 100, "c"]
    alone = [J.shingles(text) for text in texts]
    monkeypatch.setattr(J.xxhash, "xxh3_64_intdigest", lambda word: asked.append(word) or whole(word))
    together = J.shingles_of(texts)
    assert sorted(asked) == [b"a", b"b", b"c", b"d", b"e", b"f"]
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(alone, together))
