"""Packs of queries against packs of vectors give what plain products give, whatever the type of the value that has to be equal."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from engramflow.operators import vectors as V


@pytest.mark.parametrize("kind, skip, cells, block", [("int", True, 1 << 21, 3), ("int", False, 7, 3), ("string", True, 7, 3), (None, True, 7, 3), ("int", True, 7, 4096), (None, False, 1 << 21, 4096)])
def test_by_packs(spark, monkeypatch, kind, skip, cells, block):
    monkeypatch.setattr(V, "QUERY_BLOCK", block)
    monkeypatch.setattr(V, "CELLS", cells, raising=False)
    rng, values = random.Random(5), np.random.default_rng(5).normal(size=(20, 4))
    rows = [(i, [float(x) for x in values[rng.randrange(20)]], rng.choice([0, 1, 1, None])) for i in range(60)]
    index = spark.createDataFrame(rows, "id long, v array<double>, label int").repartition(3)
    if kind:
        index = index.withColumn("label", F.col("label").cast(kind))
    queries = index.where("id % 5 = 0").withColumnRenamed("id", "query_id")
    found = V.search_many(index, queries, 4, by="label" if kind else None, floor=-0.5, skip_self=skip)
    want = []
    for q, a, x in rows[::5]:
        near = [(-round(float(np.dot(a, b)), 9), i) for i, b, y in rows if not (skip and i == q) and (not kind or (x is not None and x == y)) and np.dot(a, b) >= -0.5]
        want += [(q, n, i, -s) for n, (s, i) in enumerate(sorted(near)[:4], 1)]
    assert sorted((r.query_id, r["rank"], r.id, round(r.score, 9)) for r in found.collect()) == want


def test_pairs_of_packs_are_dealt_by_number(spark, monkeypatch):
    monkeypatch.setattr(V, "QUERY_BLOCK", 5)
    index = spark.createDataFrame([(i, [float(i % 7), 1.0]) for i in range(60)], "id long, v array<double>").coalesce(1)
    queries = index.where("id < 10").withColumnRenamed("id", "query_id")
    found = V._by_packs(index, queries, 2, None, -np.inf, False)
    assert found.rdd.getNumPartitions() == 12 * 2 // V.PAIRS and found.count() == 12 * 10 * 2
