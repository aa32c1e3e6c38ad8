"""The one-bit index against brute force: recall, ties, odd rows."""

import math

import duckdb
import numpy as np

from engramflow.llm import one_bit_search as search


def plain(rows, wanted, k):
    """Exact: rows and wanted are (id, vector)."""
    fine = lambda v: v and all(x is not None and math.isfinite(x) for x in v) and any(v)
    unit = lambda v: np.array(v, float) / np.abs(v).max() / np.linalg.norm(np.array(v, float) / np.abs(v).max())
    rows = {(i, tuple(v)) for i, v in rows if i is not None and fine(v)}
    out = []
    for q, v in {(i, tuple(v)) for i, v in wanted if i is not None and fine(v)}:
        near = [(-round(float(unit(v) @ unit(w)), 9), i) for i, w in rows if (i, w) != (q, v) and len(w) == len(v)]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(near)[:k])]
    return sorted(out)


def found(spark, rows, wanted, k, kind="float"):
    make = lambda r: spark.createDataFrame([(i, v, 1) for i, v in r], f"id long, v array<{kind}>, V2 int")
    index, groups = search.build(make(rows), "id", "v", k)
    got = search.search(index, groups, make(wanted), "id", "v", k).collect()
    return sorted((r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in got), groups


def test_recall_over_many_groups_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(search, "SMALL_GROUP", 100_000)
    monkeypatch.setattr(search, "BLOCK_BYTES", 60_000)
    rng = np.random.default_rng(1)
    for dim, spread, shift in ((64, 0, 0), (20, 0.4, 0), (100, 0.3, 3.0)):
        centres = rng.standard_normal((5, dim))
        v = (rng.standard_normal((1200, dim)) * (spread or 1) + (centres[rng.integers(0, 5, 1200)] if spread else 0) + shift).astype(np.float32)
        rows = [(i, x.tolist()) for i, x in enumerate(v)]
        got, groups = found(spark, rows, rows[::40], 5)
        want = plain(rows, rows[::40], 5)
        assert groups > 1 and len(got) == len(want)
        near = {(q, i) for q, _, i, _ in want}
        assert len(near & {(q, i) for q, _, i, _ in got}) >= 0.97 * len(near)
        real = {(q, i): s for q, _, i, s in plain(rows, rows[::40], 1200)}
        assert all(abs(real[q, i] - s) < 1e-8 for q, _, i, s in got)


def test_estimates_keep_their_bounds():
    rng = np.random.default_rng(2)
    v = rng.standard_normal((3000, 64)) + 0.5
    codes, numbers, mean = search.encode(v, search.rotation(64))
    ids = np.arange(3000)
    payload = [v.tobytes(), np.stack([ids, ids], 1).tobytes(), np.ones(3000, np.int64).tobytes(), ids.tobytes(), codes.tobytes(), numbers.tobytes(), mean.tobytes()]
    block = search.Coded(payload, 3000, 64)
    unit, length = search.units(v[:50])
    out, off = 0, []
    for i in range(50):
        guess, bound = block.estimate(unit[i], search.rotation(64))
        real = block.exact(ids, v[i], length[i])
        out += (np.abs(guess - real) > bound).sum()
        off.append((guess - real).mean())
    assert out < 0.005 * 50 * 3000 and abs(np.mean(off)) < 0.01


def test_odd_rows_and_ties(spark):
    same = [1.0, 2.0, -1.0]
    rows = [(i, same) for i in range(40, 10, -1)] + [(20, same), (7, [2.0, 4.0, -2.0]), (100, [1.0, 0.0, 0.0]), (101, [0.0, 0.0, 0.0]), (102, None), (103, []), (104, [1.0, None, 0.0])]
    rows += [(105, [math.nan, 1.0, 0.0]), (106, [math.inf, 1.0, 0.0]), (None, same), (107, [1.0, 2.0]), (108, [-1.0, -2.0, 1.0]), (109, [1.0, 1.0]), (100, [0.0, 1.0, 0.0])]
    for k in (1, 5):
        assert found(spark, rows, rows, k)[0] == plain(rows, rows, k)
    few = rows[:2]
    assert found(spark, few, few, 5)[0] == plain(few, few, 5)
    assert found(spark, [], few, 5)[0] == [] and found(spark, few, [], 5)[0] == []
    far = [(1, [1e300, 1e300]), (2, [1e-300, 0.0]), (3, [1e300, -1e299])]
    assert found(spark, far, far, 5, "double")[0] == plain(far, far, 5)
    outside = [(500, [1.0, 2.0, -1.0]), (500, [0.5, 0.125, 0.0])]
    assert found(spark, rows, outside, 3)[0] == plain(rows, outside, 3)


def test_query_and_sql(spark):
    sf = "/root/testdata/sf0.01"
    got = sorted((r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in search.query(spark, sf).collect())
    c = duckdb.connect()
    c.sql(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{sf}/embeddings.parquet')")
    assert got == sorted((q, r, v, round(s, 9)) for q, r, v, s in c.sql(search.oracle()).fetchall())
