"""What a task holds at once doesn't grow with the batches it gets."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from engramflow.operators import contextual as C
from engramflow.operators import evidence, graph
from engramflow.operators import segments as S


def test_edges_are_scored_in_slices(monkeypatch):
    monkeypatch.setattr(C, "CELLS", 100)
    batches = [pa.record_batch({"edge": pa.array(range(n))}) for n in (0, 35, 5)]
    parts = list(C._slices(iter(batches), 10))
    assert [p.num_rows for p in parts] == [10, 10, 10, 5, 5]
    assert [x for p in parts for x in p.column("edge").to_pylist()] == [*range(35), *range(5)]
    assert [p.num_rows for p in C._slices(iter(batches[2:]), 1000)] == [1] * 5


def test_pieces_are_given_out_in_batches(spark, monkeypatch):
    rows = [(k, None if k == 3 else f"{k} one.\n\n{k} two. " * 20) for k in range(40)]
    docs = spark.createDataFrame(rows, "id long, text string").coalesce(1)
    for what in ("records", "chunks", "paragraphs"):
        monkeypatch.setattr(S, "HELD", 1 << 20)
        want = sorted(map(tuple, S.explode_texts(docs, what).collect()), key=repr)
        monkeypatch.setattr(S, "HELD", 10)
        assert sorted(map(tuple, S.explode_texts(docs, what).collect()), key=repr) == want
        assert len({r[0] for r in want}) == 39
        if what == "records":
            assert all(rows[i][1][a:b] == t for i, _, a, b, t in want)


def test_documents_are_encoded_in_pieces():
    """a batch of documents is encoded in slices of a bounded number of terms; a longer document is one slice."""
    from engramflow.operators import scan

    lists = [["a"] * n if n is not None else None for n in (3, 4, None, 2, 30, 0, 1)]
    batch = pa.record_batch({"id": pa.array(range(7)), "terms": pa.array(lists, pa.list_(pa.string()))})
    parts = list(scan.pieces(batch, ["terms"], 8))
    assert [p.column("id").to_pylist() for p in parts] == [[0, 1, 2], [3], [4], [5, 6]]
    assert [x for p in parts for x in scan._encoded(p.column("terms"), {"a": 0})[2].tolist()] == [3, 4, 0, 2, 30, 0, 1]


def test_clauses_need_not_be_on_every_support(spark):
    rng = random.Random(7)
    rows = [(r, rng.randrange(9), need, rng.choice("xyz"), need == "A", need != "N", rng.randrange(3), rng.randrange(60), rng.random()) for r in range(40) for need in rng.choices("ARN", k=rng.randrange(1, 15))]
    supports = spark.createDataFrame(rows, "request long, episode long, need string, clause string, joint boolean, required boolean, facts long, tokens long, relevance double")
    wanted = supports.groupBy("request", "need").agg(F.collect_set("clause").alias("clauses"))
    a, b = (sorted(evidence.select_v3(s, 3, 5, 120).collect()) for s in (supports, supports.join(wanted, ["request", "need"])))
    assert a == b and len({r.stop for r in a}) > 2


def test_concept_reach_is_dealt_by_rows(spark):
    edges = spark.createDataFrame([(e, c, p) for e in range(30) for c in (e % 3, 3, e % 5) for p in (0, 1)], "from_id long, to_id long, polarity int")
    links = spark.createDataFrame([(0, 1), (1, 0), (3, 3), (4, 9), (None, 2)], "concept long, other long")
    own = {(r.to_id, r.from_id) for r in edges.collect()}
    near = {0: {0, 1}, 1: {0, 1}, 9: {9, 4}}
    want = {c: len({e for k, e in own if k in near.get(c, {c})}) for c in (0, 1, 2, 3, 4, 9)}
    got = graph.concept_reach(edges, links, rows=8)
    assert {r.concept: r.episodes for r in got.collect()} == want
    assert "hashpartitioning(concept#" in (plan := got._jdf.queryExecution().toString()) and f", {3 * -(-len(own) // 8)})" in plan


def test_chains_are_contracted_from_the_start(spark, monkeypatch):
    from engramflow.plans import graph_queries

    rng = random.Random(11)
    edges = spark.createDataFrame([(k, k + 1) for k in range(30) if k % 9] + [(rng.randrange(40), rng.randrange(40)) for _ in range(12)] + [(50, 51), (51, 50)], "from_id long, to_id long")
    starts = spark.createDataFrame([(1,), (10,), (35,), (50,), (99,)], "node long")
    assert sorted(graph.reachable(edges, starts, plain=0).collect()) == sorted(graph.reachable(edges, starts).collect())
    asked = []
    monkeypatch.setattr(graph, "reachable", lambda t, s, plain=graph.PLAIN: asked.append(plain) or t.selectExpr("from_id AS start", "to_id AS node"))
    graph_queries.temporal_reachability(spark, "/root/testdata/sf0.001")
    assert asked == [0]


def test_segments_go_as_they_close():
    given = []

    def blocks():
        for k in range(1000):
            given.append(k)
            yield {"text": "x" * (k % 700), "boundary": k % 3, "at": k}

    out = S.segments_of(blocks())
    first = next(out)
    assert len(given) < 200 and first[0]["at"] == 0
    assert [[b["at"] for b in p] for p in [first, *out]] == S.natural_segments([{"text": "x" * (k % 700), "boundary": k % 3} for k in range(1000)])
