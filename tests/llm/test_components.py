import random

import coppice.llm.components as C
from coppice.llm.common import stored


def graph(spark, labels, links):
    return spark.createDataFrame(list(enumerate(labels)), "node long, label long"), spark.createDataFrame(links, "a long, b long")


def brute(labels, links):
    root = list(range(len(labels)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = sorted((top(a), top(b)), key=lambda i: (labels[i] is None, labels[i] or 0, i))
        root[b] = a
    return {i: (top(i), labels[top(i)]) for link in links for i in link}


def as_dict(found):
    return {r.node: (r.root, r.label) for r in found.collect()}


def test_a_chain_takes_few_rounds(spark, monkeypatch):
    labels = list(range(400))
    random.Random(7).shuffle(labels)
    links = [(i, i + 1) for i in range(399)]
    rounds = []
    monkeypatch.setattr(C, "stored", lambda df, purpose: rounds.append(purpose) or stored(df, purpose))
    found = as_dict(C.connected(*graph(spark, labels, links)))
    assert found == brute(labels, links)
    # Passed on from neighbour to neighbour alone the smallest label takes hundreds of rounds.
    assert rounds.count("labels") <= 16


def test_links_since_join_what_was_found(spark):
    rng = random.Random(3)
    labels = [None if i % 50 == 7 else rng.randrange(60) for i in range(200)]
    before = [(rng.randrange(100), rng.randrange(100)) for _ in range(60)]
    since = [(rng.randrange(200), rng.randrange(200)) for _ in range(40)] + before[:3]
    nodes, first = graph(spark, labels, before)
    _, second = graph(spark, labels, since)
    found = C.connected(nodes, first)
    assert as_dict(found) == brute(labels, before)
    assert as_dict(C.joined(nodes, found, second)) == brute(labels, [*before, *since])
    assert as_dict(C.joined(nodes, found, second.limit(0))) == brute(labels, before)
