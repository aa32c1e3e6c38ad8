"""Runs and rings of links in as many rounds as the longest asks for, and no more."""

from engramflow.operators import cutting
from engramflow.operators import graph as G


def test_many_short_rings(spark, monkeypatch):
    """Rings of three, two and nine nodes and a path of five: the rounds follow nine, not the 710 nodes, and partitions stay as many."""
    rings = [[1000 * size + size * k + i for i in range(size)] for size, n in ((3, 100), (2, 100), (9, 23)) for k in range(n)]
    pairs = [(a, b) for r in rings for a, b in zip(r, r[1:] + r[:1])] + [(k, k + 1) for k in range(5)]
    rounds = []

    def cut(df):
        rounds.append(df)
        return cutting.cut(df)

    monkeypatch.setattr(G, "cut", cut)
    links = spark.createDataFrame(pairs, "node long, other long").repartition(3)
    steps, members, found = G.contract(links)
    assert sorted(map(tuple, found.select("ring", "node").collect())) == sorted((min(r), n) for r in rings for n in r)
    assert sorted((r.node, r.away) for r in members.collect()) == [(1, 4), (2, 3), (3, 2), (4, 1)]
    assert [tuple(r) for r in steps.collect()] == [(0, 5, 4)]
    assert len(rounds) <= 9
    assert members.rdd.getNumPartitions() <= 4
