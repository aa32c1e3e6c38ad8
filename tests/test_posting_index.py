"""The maintained index against one that is built anew from what is left."""

import math
import random
import re
from collections import Counter

from engramflow.operators import posting_index as P

CHANGE = "id long, seq long, op string, terms array<string>"


def plain_search(docs, queries, k):
    n = len(docs)
    mean = sum(map(len, docs.values())) / n if n and any(docs.values()) else 1.0
    df = Counter(t for terms in docs.values() for t in set(terms))
    out = []
    for q, asked in queries:
        scores = {}
        for i, terms in docs.items():
            tf = Counter(terms)
            hit = [t for t in set(asked) if tf[t]]
            if hit:
                parts = [max(1e-6, math.log((n - df[t] + 0.5) / (df[t] + 0.5))) * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * len(terms) / mean)) for t in hit]
                scores[i] = round(math.fsum(parts), 9)
        best = sorted(scores.items(), key=lambda x: (-round(x[1], 7), x[0]))[:k]
        out += [(q, i, round(s, 6)) for i, s in best]
    return sorted(out)


def found(index, spark, queries, k):
    rows = index.search(spark.createDataFrame(queries, "query_id long, terms array<string>"), k).collect()
    return sorted((r.query_id, r.id, round(r.score, 6)) for r in rows)


def changes_of(rng, n, seq):
    words = [f"w{i}" for i in range(30)]
    out = []
    for j in range(n):
        op = rng.choice(["put", "put", "put", "delete"])
        out.append((rng.randrange(40), seq + j, op, [rng.choice(words) for _ in range(rng.randrange(12))] if op == "put" else None))
    return out


def test_changes_and_merges_equal_a_rebuild(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(P, "SEGMENTS", 3)
    monkeypatch.setattr(P, "BUCKETS", 4)
    rng = random.Random(3)
    queries = [(1, ["w1", "w2", "w1"]), (2, ["w5"]), (3, ["nothing"]), (4, [f"w{i}" for i in range(30)]), (5, [])]
    index, docs, newest = P.PostingIndex(spark, str(tmp_path / "index")), {}, {}
    assert found(index, spark, queries, 3) == []
    for epoch in range(1, 6):
        batch = changes_of(rng, 25, 100 * epoch)
        batch += [(i, s - 250, "put", ["late"]) for i, s, _, _ in batch[:5]]  # older than what is there
        rng.shuffle(batch)
        index.apply(spark.createDataFrame(batch, CHANGE), epoch)
        if epoch == 2:  # a batch that runs again
            index.apply(spark.createDataFrame(batch, CHANGE), epoch)
        last = {}
        for c in batch:
            if c[0] not in last or c[1] > last[c[0]][1]:
                last[c[0]] = c
        for i, (_, seq, op, terms) in last.items():
            if seq > newest.get(i, -1):
                newest[i] = seq
                docs.pop(i, None)
                if op == "put":
                    docs[i] = terms
        if epoch in (1, 3, 5):
            assert found(index, spark, queries, 3) == plain_search(docs, queries, 3)
            assert {r.id for r in index.live().where("NOT deleted").collect()} == docs.keys()
    assert 2 * 4 + 1 in index.versions() and len(index.segments()) <= 3
    index.clean()
    assert found(index, spark, queries, 40) == plain_search(docs, queries, 40)


def test_a_search_reads_only_the_asked_buckets(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(P, "BUCKETS", 4)
    index = P.PostingIndex(spark, str(tmp_path / "index"))
    index.apply(spark.createDataFrame([(i, 1, "put", [f"w{i}", "all"]) for i in range(50)], CHANGE), 1)
    hits = index.search(spark.createDataFrame([(1, ["w7"])], "query_id long, terms array<string>"), 5)
    assert [(r.id, r.rank) for r in hits.collect()] == [(7, 1)]
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*b#", plan)


def test_stream(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(P, "BUCKETS", 4)
    for k in range(3):
        spark.createDataFrame([(i, 10 * k + 1, "put", [f"k{k}", "x"]) for i in range(k, 6)] + [(k, 10 * k + 2, "delete", None)], CHANGE).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    index = P.PostingIndex(spark, str(tmp_path / "index"))
    for _ in range(2):  # a second start finds nothing new
        stream = spark.readStream.schema(CHANGE).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
        P.feed(index, stream, str(tmp_path / "checkpoint")).trigger(availableNow=True).start().awaitTermination()
    docs = {i: ["k2", "x"] for i in range(3, 6)}
    assert {r.id: [t.term for t in r.terms] for r in index.live().where("NOT deleted").collect()} == docs
    assert found(index, spark, [(1, ["k2"]), (2, ["k1"])], 9) == plain_search(docs, [(1, ["k2"]), (2, ["k1"])], 9)
