"""Texts of the same words have the same score, in whatever order their weights are summed."""

import random

from pyspark.sql import functions as F

from engramflow.operators import lexical as L


def shuffled(rng, words):
    return rng.sample(words, len(words))


def test_record_anchors_tie(spark):
    """Other words, as frequent: the sums have the same parts in another order."""
    rng = random.Random(1)
    records = []
    for source in range(60):
        asked = [f"c{k}" for k in range(12)]
        records += [(1000 * source + i, source, shuffled(rng, asked + [f"{'abdefg'[i]}{k}" for k in range(10)])) for i in range(6)]
        records += [(1000 * source + 100 + i, source, [f"{x}{k}" for x in "abcdefg" for k in range(i, 12)]) for i in range(1, 12)]
        records.append((1000 * source + 99, source, asked))
    r = spark.createDataFrame(records, "id long, source long, features array<string>").repartition(7)
    found = L.record_anchors(r.where("id % 1000 = 99").select(F.col("id").alias("episode"), "source", "features"), r, F.col("id") % 1000 < 6)
    assert sorted(x.id % 1000 for x in found.collect()) == [0] * 60


def test_cue_search_ties(spark):
    rng = random.Random(2)
    words = [f"w{k}" for k in range(30)]
    cues = [(i, shuffled(rng, words)) for i in range(300)] + [(1000 + i, words[: i % 30 + 1] + [f"x{i}"]) for i in range(90)]
    found = L.cue_search(spark.createDataFrame(cues, "id long, features array<string>").repartition(7), spark.createDataFrame([(1, words), (2, words[3:19])], "query_id long, features array<string>"), 10)
    assert [r.id for r in found.where("query_id = 1").orderBy("rank").collect()] == list(range(10))
