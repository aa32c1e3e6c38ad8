"""Dominance counts against counting every pair, and op11's places and weights."""

import datetime as dt
import math
import random
import zlib

import duckdb

from engramflow.llm import dominance


def plain(rows):
    out = []
    for i, s, v, _ in rows:
        if s is None or v is None:
            out.append((i, s, v, None, None))
            continue
        above = [(w or 0) for _, s2, v2, w in rows if s2 is not None and v2 is not None and s2 < s and v2 > v]
        out.append((i, s, v, len(above), sum(above)))
    return sorted(out, key=repr)


def counted(spark, rows):
    df = spark.createDataFrame([(*r, 1) for r in rows], "id long, slot long, level long, weight long, SLOT2 int")
    return sorted(map(tuple, dominance.count_above(df).collect()), key=repr)


def test_random_points(spark):
    rng = random.Random(11)
    rows = [(i, rng.choice([None, *range(-70, 300)]), rng.choice([None, -9, -8, *range(40), 1000]), rng.choice([None, 1, 2, 3])) for i in range(700)]
    rows += rows[:20] + [(None, 5, 3, 1), (None, None, 3, 1)] + [(9000 + i, 7, 7, 1) for i in range(200)]
    assert counted(spark, rows) == plain(rows)


def test_levels_as_far_apart_as_longs_are(spark):
    ends = [-(2**63), -(2**63) + 1, -1, 0, 1, 2**62, 2**63 - 1]
    rows = [(i, i * 7 % 5, v, 1) for i, v in enumerate(ends * 3)]
    assert counted(spark, rows) == plain(rows)


def test_no_trie(spark):
    assert counted(spark, []) == []
    rows = [(1, 1, 5, 1), (2, 2, 5, 1), (3, None, 5, 1)]
    assert counted(spark, rows) == plain(rows)
    assert counted(spark, [(1, None, None, 1)]) == [(1, None, None, None, None)]


def test_sales(spark):
    day = dt.datetime(1970, 1, 1)
    rng = random.Random(3)
    rows = [(i, day + dt.timedelta(days=rng.randrange(-40, 40), microseconds=rng.randrange(86400 * 10**6)), rng.choice([None, 0.0, -0.01, -25.005, 9.995, 10.0, 0.285, 1e17, 33.3]) , "x") for i in range(300)]
    rows += [(900, None, 5.0, "x"), (901, day, math.nan, "x"), (902, day, math.inf, "x"), (903, day, 1e300, "x"), (None, day, 9.99, "x"), (5, day, 9.99, "x")]
    sales = spark.createDataFrame(rows, "sale_id long, sold_at timestamp_ntz, total double, Total2 string")

    def level(t):
        if t is None or not math.isfinite(t):
            return None
        v = math.floor(math.floor(100 * t + 0.5) / 1000)
        return v if abs(v) < 2**63 else None

    want = [(i, None if at is None else (at - day) // dt.timedelta(days=1), level(t), 1 if i is None else 1 + zlib.crc32(str(i).encode()) % 3) for i, at, t, _ in rows]
    for zone in ("UTC", "Pacific/Auckland"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            points = [tuple(r) for r in dominance.points_of(sales).collect()]
            assert sorted(points, key=repr) == sorted(want, key=repr)
            got = sorted(map(tuple, dominance.count_above(dominance.points_of(sales)).collect()), key=repr)
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
        assert got == plain(want)


def test_query_and_sql(spark):
    sf = "/root/testdata/sf0.001"
    got = sorted(map(tuple, dominance.query(spark, sf).select("sale_id", "slot", "level", "n_sales", "n_rows").collect()), key=repr)
    c = duckdb.connect()
    c.sql(f"CREATE VIEW sales AS SELECT * FROM read_parquet('{sf}/sales.parquet')")
    assert got == sorted(c.sql(dominance.oracle()).fetchall(), key=repr)
    sales = c.sql("SELECT sale_id, floor(epoch(sold_at) / 86400)::BIGINT, total FROM sales").fetchall()
    rows = [(i, s, None if t is None else math.floor(math.floor(100 * t + 0.5) / 1000), 1 + zlib.crc32(str(i).encode()) % 3) for i, s, t in sales]
    assert got == plain(rows)
