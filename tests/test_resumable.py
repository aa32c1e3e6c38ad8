"""Spreading in parts against spreading at once."""

import random
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from engramflow.operators import cutting, graph, resumable

EDGE = "association_id long, from_id long, to_id long, weight double, confidence double, polarity int"


@pytest.mark.parametrize("budgets", [[3, 1, 0, 7, None], [None], [10_000]])
def test_any_division_of_the_budget(spark, tmp_path, budgets):
    rng = random.Random(12)
    edges = spark.createDataFrame([(i, rng.randrange(40), rng.randrange(40), rng.random() * 1.2, rng.random(), 1) for i in range(90)], EDGE)
    seeds = spark.createDataFrame([(r, rng.randrange(40), rng.choice([1.0, 0.5, -1.0, 0.9])) for r in (1, 2) for _ in range(4)], "root long, node long, activation double")
    used = 0
    for budget in budgets:
        search = resumable.ResumableSpreading(edges, seeds, str(tmp_path / "s"), 1e-3)
        before = search.state().get("expansions", 0)
        status = search.run(budget)
        now = search.state()
        assert now["status"] == status and (budget is None or now["expansions"] - before <= budget)
        assert (status == resumable.COMPLETE) == (now["pending"] == 0)
        used += 1
    assert status == resumable.COMPLETE and now["call"] == used - 1
    rows = lambda df: sorted((r.root, r.node, round(r.support, 12)) for r in df.collect())
    assert rows(search.supports()) == rows(graph.spreading_activation(edges, seeds, 1e-3))
    again = resumable.ResumableSpreading(edges, seeds, str(tmp_path / "s"), 1e-3)
    assert again.run(5) == resumable.COMPLETE and again.state()["expansions"] == now["expansions"]
    for other in (resumable.ResumableSpreading(edges.withColumn("weight", F.col("weight") / 2), seeds, str(tmp_path / "s"), 1e-3), resumable.ResumableSpreading(edges, seeds.limit(3), str(tmp_path / "s"), 1e-3), resumable.ResumableSpreading(edges, seeds, str(tmp_path / "s"), 0.0)):
        with pytest.raises(ValueError, match="not the one"):
            other.run()


def test_nothing_to_spread(spark, tmp_path):
    search = resumable.ResumableSpreading(spark.createDataFrame([], EDGE), spark.createDataFrame([], "root long, node long, activation double"), str(tmp_path / "s"))
    assert search.run(3) == resumable.COMPLETE and search.supports().count() == 0


def test_query_weighs_the_graph_once(spark, monkeypatch):
    from engramflow.plans import graph_queries

    calls = []
    monkeypatch.setattr(resumable, "conductances", lambda edges, real=resumable.conductances: calls.append(1) or real(edges))
    graph_queries.resumed_spreading(spark, "/root/testdata/sf0.001")
    assert len(calls) == 1


def test_rounds_leave_no_shuffle_files(spark):
    """what the conductances and a round have shuffled is removed when they are done, not when the driver's heap is collected."""
    folders = [str(d) for d in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()]
    files = lambda: {f.name for d in folders for f in Path(d).glob("*/shuffle_*.data")}
    rng = random.Random(5)
    edges = spark.createDataFrame([(i, rng.randrange(40), rng.randrange(40), rng.random(), rng.random(), 1) for i in range(200)], EDGE)
    seeds = spark.createDataFrame([(r, rng.randrange(40), 1.0) for r in range(4)], "root long, node long, activation double")
    before = files()
    found = graph.spreading_activation(edges, seeds, 1e-2)
    until = time.time() + 10
    while files() - before and time.time() < until:
        time.sleep(0.1)
    assert not files() - before
    assert found.count() > 50 and spark.conf.get(cutting.CLEAN_UP) == "false"
    search = resumable.ResumableSpreading(edges, seeds, f"{cutting.shared_folder(spark)}/swept", 1e-2)
    search.run(5), search.run()
    assert search.supports().count() == found.count()


def test_conductances_by_hand(spark):
    rows = [(1, 1, 2, 0.5, 0.5, 1), (2, 2, 1, 0.8, 0.5, -1), (3, 2, 3, 2.0, 1.0, 1), (4, 3, 3, 1.0, 1.0, 1), (5, 1, 3, 0.0, 1.0, 1), (6, None, 1, 1.0, 1.0, 1)]
    got = {(r.node, r.other): round(r.c, 9) for r in graph.conductances(spark.createDataFrame(rows, EDGE)).collect()}
    assert got == {(1, 2): round(0.4 * 0.85 / 2**0.5, 9), (2, 1): round(0.4 * 0.85, 9), (2, 3): 0.85, (3, 2): round(0.85 / 2**0.5, 9)}
