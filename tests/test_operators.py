"""Operators against plain versions on small tables."""

import itertools
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from engramflow.functions import text as T
from engramflow.functions import values as V
from engramflow.operators import contextual, evidence, graph, ingestion, learning, lexical, metrics, segments, vectors


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


EDGE = "association_id long, from_id long, to_id long, weight double, confidence double, polarity int"


def made_graph(rng, nodes, n):
    return [(i, rng.randrange(nodes), rng.randrange(nodes), rng.random(), rng.random(), rng.choice((-1, 0, 1))) for i in range(n)]


def test_spreading_against_exhaustive_paths(spark):
    rng = random.Random(1)
    links = made_graph(rng, 7, 14)
    near = {}
    for _, a, b, w, c, _ in links:
        if a != b and w * c > 0:
            near.setdefault(a, {})[b] = max(near.get(a, {}).get(b, 0), w * c)
            near.setdefault(b, {})[a] = near[a][b] = max(near[a][b], near.get(b, {}).get(a, 0))
    best = {}
    for start, strength in ((0, 0.9), (3, 1.0)):
        for length in range(1, 7):
            for path in itertools.permutations([n for n in range(7) if n != start], length - 1):
                full = (start, *path)
                value = strength
                for a, b in zip(full, full[1:]):
                    value *= near.get(a, {}).get(b, 0) * 0.85 / max(1, len(near.get(b, {}))) ** 0.5
                if value > 0:
                    best[start, full[-1]] = max(best.get((start, full[-1]), 0), value)
    seeds = spark.createDataFrame([(0, 0, 0.9), (3, 3, 1.0), (3, 5, -1.0)], "root long, node long, activation double")
    got = graph.spreading_activation(spark.createDataFrame(links, EDGE), seeds)
    assert {(r.root, r.node): round(r.support, 9) for r in got.collect()} == {k: round(v, 9) for k, v in best.items()}
    total = {}
    for (_, n), a in best.items():
        total[n] = 1 - (1 - total.get(n, 0)) * (1 - a)
    assert {r.node: round(r.activation, 9) for r in graph.noisy_or(got).collect()} == {n: round(a, 9) for n, a in total.items()}


def test_reachability_and_cycles(spark):
    rng = random.Random(2)
    links = [(0, rng.randrange(12), rng.randrange(12)) for _ in range(16)]
    after = {}
    for _, a, b in links:
        after.setdefault(a, set()).add(b)
    want = set()
    for s in range(12):
        seen, todo = set(), list(after.get(s, ()))
        while todo:
            n = todo.pop()
            if n not in seen:
                seen.add(n)
                todo += after.get(n, ())
        want |= {(s, n) for n in seen}
    frame = spark.createDataFrame(links, "scope long, from_id long, to_id long")
    nodes = spark.createDataFrame([(n,) for n in range(12)], "node long")
    loops = {(a, a) for _, a, b in links if a == b}
    got = {tuple(r) for r in graph.reachable(frame, nodes).collect()}
    assert got | loops == want | loops
    assert graph.reachable(frame.limit(0), nodes).count() == 0


def test_chronological_respects_edges_and_notes_cycles(spark):
    nodes = spark.createDataFrame([(1, n, o, n) for n, o in ((1, 3.0), (2, 1.0), (3, None), (4, 2.0), (5, 5.0), (6, 4.0))], "scope long, node long, story_order double, input_rank long")
    edges = spark.createDataFrame([(1, 1, 2), (1, 5, 6), (1, 6, 5), (1, 2, 99)], "scope long, from_id long, to_id long")
    got = [(r.node, r.note) for r in graph.chronological(nodes, edges).orderBy("position").collect()]
    assert got == [(4, ""), (1, ""), (2, ""), (3, ""), (6, "cycle"), (5, "cycle")]


def test_greedy_against_exhaustive(spark):
    rng = random.Random(3)
    data = []
    for request in range(25):
        for need in "abc":
            clauses = [need + str(i) for i in range(rng.randrange(1, 3))]
            for episode in range(6):
                if rng.random() < 0.5:
                    data.append((request, episode, need, rng.choice(clauses), rng.random() < 0.5 and need == "a", clauses, True, rng.randrange(1, 3), rng.randrange(10, 60), rng.random()))
    joint = {}
    data = [(r, e, n, c, joint.setdefault((r, n), j), cs, q, f, t, v) for r, e, n, c, j, cs, q, f, t, v in data]
    frame = spark.createDataFrame(data, "request long, episode long, need string, clause string, joint boolean, clauses array<string>, required boolean, facts long, tokens long, relevance double")
    greedy = {r.request: r for r in evidence.select_v3(frame, 3, 5, 120).collect()}
    best = {r.request: r.covered for r in evidence.select_exhaustive(frame, 3, 5, 120).collect()}
    assert set(greedy) == set(best)
    for k, r in greedy.items():
        assert r.covered <= best[k] and len(r.chosen) <= 3
        assert r.stop in ("complete", "episode_budget", "exhausted", "budget", "no_gain")
    assert sum(r.covered for r in greedy.values()) >= 0.8 * sum(best.values())


def test_select_v1(spark):
    frame = spark.createDataFrame(
        [(1, 1, ["a"], [], [], 1, 0.1, 0.0, 1), (1, 2, ["a", "b"], [], [], 0, 0.0, 0.0, 1), (1, 3, [], ["c"], ["d"], 0, 0.2, 0.0, 2), (1, 4, [], [], [], 0, -1.0, 3.0, 2)],
        "request long, id long, required array<string>, optional array<string>, contextual array<string>, direct int, quality double, redundancy double, group long",
    )
    assert [(r.id, r.step, round(r.value, 6)) for r in evidence.select_v1(frame).orderBy("step").collect()] == [(2, 1, 20.0), (3, 2, 2.7), (1, 3, 0.6)]


def test_folds(spark):
    events = spark.createDataFrame([(1, 1, "success", "q", 0.5), (1, 2, "success", "q", 0.5), (1, 3, "harm", "r", 0.5), (2, 1, "none", "s", 1.0)], "id long, seq long, outcome string, query_hash string, start double")
    assert {r.id: round(r.weight, 9) for r in learning.utility_fold(events).collect()} == {1: 0.3, 2: 0.98}
    feedback = spark.createDataFrame([(1, 1, "f1", "p", True, None), (1, 2, "f1", "p", True, None), (1, 3, "f2", "n", False, None), (1, 4, "f1", "other", False, None)], "id long, seq long, feedback_id string, payload string, positive boolean, start double")
    assert [round(r.weight, 9) for r in learning.feedback_fold(feedback).collect()] == [round((0.2 + 0.2 * 0.8) * 0.8, 9)]
    assert [r.seq for r in learning.refused_feedback(feedback).collect()] == [4]
    edges = spark.createDataFrame([(1, 0.5, 0.5, 1)], "id long, weight double, confidence double, evidence_count long")
    signals = spark.createDataFrame([(1, 0.5, 0.9), (1, 1.0, 0.1), (9, 1.0, 1.0)], "id long, signal double, confidence double")
    assert rows(learning.reinforce(edges, signals).select("id", F.round("weight", 9), "confidence", "evidence_count")) == [(1, 0.64, 0.9, 3)]


def test_gate_and_combine(spark):
    df = spark.createDataFrame([(0.2,), (0.6,), (1.0,), (float("nan"),), (None,), (float("inf"),)], "s double")
    assert [round(r[0], 6) for r in df.select(contextual.gate(F.col("s"), 0.2)).collect()] == [0.0, 0.5, 1.0, 0.0, 0.0, 0.0]
    one = spark.range(1).select(*[contextual.combine(F.lit(0.25), F.lit(1.0), h) for h in ("product", "minimum", "geomean")]).first()
    assert tuple(one) == (0.25, 0.25, 0.5)
    with pytest.raises(ValueError):
        contextual.combine(F.lit(1), F.lit(1), "sum")


def test_segments():
    assert segments.record_spans("a\n\n  b \n\n\nc") == [(0, 1), (5, 6), (10, 11)]
    marked = "[record: 1]\nx\n\ny\n[record: 2]\nz\n"
    assert [marked[a:b] for a, b in segments.record_spans(marked)] == ["[record: 1]\nx\n\ny", "[record: 2]\nz"]
    assert segments.record_spans("") == segments.record_spans(" \n\n ") == []
    text = "\n\n".join(str(i % 10) * 300 for i in range(12))
    parts = segments.paragraphs(text)
    assert all(len(p) <= 1400 for p in parts) and {c for p in parts for c in p} == set("0123456789\n")
    long = "Word. " * 1000
    assert "".join(segments.chunks(long)) == long and all(len(c) <= 2000 for c in segments.chunks(long))
    blocks = [{"text": "x" * 1000, "boundary": 3 if i == 4 else 0, "style": "prose", "role": "front_matter" if i == 0 else "body"} for i in range(20)]
    found = segments.natural_segments(blocks)
    assert found[0] == [1, 2, 3] and sorted({i for s in found for i in s}) == list(range(1, 20))
    assert all(sum(len(blocks[i]["text"]) + 2 for i in s) <= 8000 for s in found)
    reference = [{"text": "r", "boundary": 0, "style": "reference", "role": "body"}] * 25
    assert [len(s) for s in segments.natural_segments(reference)] == [10, 10, 5]


def test_text_forms():
    assert T.casefold("ＡＢＣß") == "abcss"
    assert T.alias(" Café  Noir ") == "café noir" and T.alias("東 京 Tower") == "東京tower"
    assert T.units("don't 東京都 ab", 3) == ["don't", "東京都"] and T.units("ab 東 c", 2) == ["ab", "東"]
    assert T.terms("It's 東京")[0] == "w:it's" and "c2:東京" in T.terms("東京")
    assert T.anchors('say "hello world" and “no” 「東京都」') == ["hello world", "東京都"]
    assert T.features("a b a 東京") == ["w:a", "w:b", "n2:a b", "n2:b a", "c:東", "c:京", "n2:東京"]


def test_values(spark):
    assert V.repair_json('Here: ```json\n{"a": [1, 2,], "b": "x')["a"] == [1, 2]
    assert V.repair_json('{"a": "q\\"uote"} tail') == {"a": 'q"uote'} and V.repair_json("none") is None
    assert V.remap_ids({"association_ids": [1, 2], "x": {"association_id": 2}}, {2: 9}) == {"association_ids": [1, 9], "x": {"association_id": 9}}
    assert V.canonical({"b": 1, "a": [1]}) == '{"a":[1],"b":1}'
    assert [len(p) for p in V.split_message("a" * 3000 + "\n" + "b" * 3000)] == [3000, 3000]
    df = spark.createDataFrame([("2024-01-01T00:00:00+00:00",), ("2024-13-01T00:00:00+00:00",), ("2024-01-01",), (None,)], "t string")
    assert [r[0] for r in df.select(V.utc_canonical(F.col("t"))).collect()] == [True, False, False, False]
    v = V.fake_embedding("x", 64)
    assert len(v) == 64 and abs(sum(x * x for x in v) - 1) < 1e-9
    assert len(spark.createDataFrame([("a",), (None,)], "t string").select(V.embedder()("t")).collect()[0][0]) == 64
    strongest = spark.range(1).select(V.strongest_claim(F.lit("retrieval_only"), F.lit("direct_fact"))).first()[0]
    assert strongest == "direct_fact"


def test_vectors_with_odd_rows(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [float("nan"), 1.0]), (5, [3.0, 4.0]), (6, [2.0, 0.0])], "id long, e array<float>")
    index = vectors.normalise(df, "e").select("id", "v")
    assert rows(index.select("id")) == [(1,), (5,), (6,)]
    q = index.where("id = 1").withColumnRenamed("id", "query_id")
    assert [(r.id, round(r.score, 6), r["rank"]) for r in vectors.search_many(index, q, 2).orderBy("rank").collect()] == [(1, 1.0, 1), (6, 1.0, 2)]
    assert vectors.search_many(index, q, 0).count() == 0 and vectors.search_many(index.limit(0), q, 3).count() == 0


def test_beam_keeps_only_better_nodes(spark):
    edges = spark.createDataFrame([(1, 1, 2, 1.0, 1.0, 1), (2, 2, 3, 1.0, 1.0, -1), (3, 1, 3, 0.1, 1.0, 0)], EDGE)
    seeds = spark.createDataFrame([(0, 1, 1.0)], "root long, node long, score double")
    best, paths = graph.beam_traversal(edges, seeds, 2, 5)
    assert {r.node: round(r.score, 6) for r in best.collect()} == {1: 1.0, 2: 0.85, 3: round(0.85 * 0.5 * 0.85**2, 6)}
    assert paths.count() == 2 + 4


def test_ingestion_checks(spark):
    docs = spark.createDataFrame([(1, "a\n\nb")], "id long, text string")
    assert [r.line for r in ingestion.numbered_lines(docs).orderBy("n").collect()] == ["[L0001] a", "[L0002] b"]
    lines = spark.createDataFrame([(1, n, f"line {n}") for n in range(1, 200)], "id long, n long, line string")
    spans = spark.createDataFrame([(1, 1, 1, 2), (2, 1, 1, 70), (3, 1, 198, 205), (4, 1, 0, 1)] + [(5, 1, i, i) for i in range(1, 10)], "episode long, id long, first long, last long")
    got = {r.episode: (r.reason, r.quote) for r in ingestion.validate_spans(spans, lines).collect()}
    assert got[1] == (None, "line 1\nline 2")
    assert [got[k][0] for k in (2, 3, 4, 5)] == ["span_too_long", "outside_source", "bad_bounds", "too_many_spans"]
    lists = spark.createDataFrame([(1, 1, 1, 10), (1, 1, 2, 11), (1, 2, 1, 10), (1, 2, 2, 12)], "request long, need long, rank long, source long")
    assert [r.source for r in ingestion.round_robin(lists).orderBy("place").collect()] == [10, 12, 11]
    assert ingestion.split_draft("A: one. two. three. four.\nB: five.") == ["A: one. two. three.", "four.", "B: five."]
    episodes = spark.createDataFrame([(1, 7, "bob met Al", ["x"], "observed", 0.9)], "id long, source long, text string, participants array<string>, epistemic_status string, confidence double")
    names = spark.createDataFrame([(7, "Albert", "al"), (7, "Robert", "Bob")], "source long, name string, alias string")
    assert ingestion.complete_participants(episodes, names).first().participants == ["x", "Robert", "Albert"]
    said = ["x [speaker_raw: Ann ]", "[speaker_raw: ???]"]
    told = [(1, ["Bob"], said, "observed", 0.9, " old "), (2, [" ANN"], said, "observed", 0.9, ""), (3, ["Bob"], ["[speaker_raw: ???]"], "asserted", 0.9, None), (4, ["Bob"], said, "speculative", 0.9, ""), (5, [], said, "observed", 0.9, ""), (6, ["Bob"], said, "asserted", 0.3, None), (7, None, None, "observed", 0.9, ""), (8, ["Bob"], said, "observed", 0.9, "a" * 999)]
    down = {r.id: (r.epistemic_status, r.confidence, r.epistemic_note) for r in ingestion.downgrade_attribution(spark.createDataFrame(told, "id long, participants array<string>, quotes array<string>, epistemic_status string, confidence double, epistemic_note string")).collect()}
    note = ingestion.NOT_THE_SPEAKER
    assert down[1] == ("reported", 0.8, "old；" + note) and down[6] == ("reported", 0.3, note) and down[8] == ("reported", 0.8, "a" * 999 + "；")
    assert all(down[k] == (told[k - 1][3], told[k - 1][4], told[k - 1][5]) for k in (2, 3, 4, 5, 7))
    anchors = [("episode", 1, "b", 0.9, True, False, False), ("episode", 1, "a", 0.9, True, False, False), ("concept", 2, "c", 0.9, True, True, True), ("episode", 3, "d", 1.0, True, True, False), ("episode", 4, "e", 1.0, True, False, True), ("episode", 5, "f", 1.0, False, False, False), ("episode", 6, "g", 0.5, True, None, None), ("concept", 7, "h", 0.5, True, False, False), ("concept", 8, "i", 0.1, True, False, False)]
    found = ingestion.learning_anchors(spark.createDataFrame([(1, *a) for a in anchors], "request long, anchor_type string, anchor_id long, contribution_id string, activation double, eligible boolean, contextual boolean, target boolean"))
    assert [(r.anchor_id, r.contribution_id) for r in found.orderBy("rank").collect()] == [(2, "c"), (1, "a"), (7, "h"), (6, "g")]


def test_record_anchors_prefer_rare_shared_features(spark):
    records = spark.createDataFrame([(1, 1, ["a", "b"]), (2, 1, ["a", "c"]), (3, 2, ["b"])], "id long, source long, features array<string>")
    asked = spark.createDataFrame([(9, 1, ["c", "zz"])], "episode long, source long, features array<string>")
    assert lexical.record_anchors(asked, records).first().id == 2


def test_metrics(spark):
    assert metrics.sign_test(0, 0) == 1.0 and abs(metrics.sign_test(9, 1) - 0.021484375) < 1e-12
    pairs = spark.createDataFrame([(k, 1.0 + (k % 3), 1.0) for k in range(60)], "key long, a double, b double")
    r = metrics.bootstrap_ci(pairs, 500).first()
    assert r.low < r.mean < r.high and (r.wins, r.losses) == (40, 0)
    values = spark.createDataFrame([(float(x),) for x in range(11)], "v double")
    assert values.agg(metrics.nearest_rank("v", 0.95)).first()[0] == 10.0 == pd.Series(range(11)).sort_values().iloc[round(10 * 0.95)]
