"""Runs against a search of every period, and op13's rows against a plain version."""

import hashlib
import random
import re
import time
import zlib
from fractions import Fraction

import numpy as np

from engramflow.llm import periodic_runs


def plain_runs(w):
    """Every period's stretches of words that equal the one a period on."""
    number, found = {}, {}
    ids = np.array([number.setdefault(x, len(number)) for x in w], np.int64)
    for q in range(1, len(w) // 4 + 1):
        edges = np.flatnonzero(np.diff(ids[:-q] == ids[q:], prepend=False, append=False))
        for s, e in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if e + q - s >= max(6, 4 * q):
                found.setdefault((s, e + q), q)
    return sorted(((s, e, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def texts(rng):
    for _ in range(250):
        yield [rng.choice("aab") for _ in range(rng.randrange(120))]
    for _ in range(250):
        w = []
        while len(w) < rng.randrange(1, 250):
            u = [rng.choice("abcd") for _ in range(rng.randrange(1, 9))]
            w += (u * 8)[: rng.randrange(1, len(u) * 8)]
        yield w
    for _ in range(150):  # words as of Fibonacci's kind: runs of many periods over each other
        x, y = ["a"], ["b"]
        for _ in range(rng.randrange(3, 9)):
            x, y = x * rng.randrange(1, 5) + y, x
        w = x[:400]
        if rng.random() < 0.4:
            w[rng.randrange(len(w))] = "c"
        yield w * rng.randrange(1, 6) if len(w) < 100 else w


def test_runs():
    rng = random.Random(13)
    some = 0
    for w in texts(rng):
        want = plain_runs(w)
        assert periodic_runs.runs_of(w) == want
        assert sorted(periodic_runs.runs_of_piece([ord(c) for c in w]), key=lambda r: (r[0], r[2])) == want
        some += len(want)
    assert some > 500
    w = "x y z".split() + "a b".split() * 5 + "x y z".split()
    assert periodic_runs.runs_of(w) == [(3, 13, 2)]
    assert periodic_runs.runs_of(["a"] * 5) == [] and periodic_runs.runs_of(["a"] * 6) == [(0, 6, 1)]


def test_factors_occur_earlier():
    rng = random.Random(5)
    for _ in range(200):
        w = [rng.randrange(3) for _ in range(rng.randrange(1, 80))]
        at = 0
        for start, length, source in periodic_runs.factorise(w):
            assert start == at
            at += length
            earlier = [j for j in range(start) if w[j : j + length] == w[start:at]]
            longer = [j for j in range(start) if at < len(w) and w[j : j + length + 1] == w[start : at + 1]]
            assert (source in earlier) if source >= 0 else (length == 1 and not earlier)
            assert not longer
        assert at == len(w)


def test_linear():
    rng = random.Random(1)
    for make in (lambda n: ["a"] * n, lambda n: [rng.choice("ab") for _ in range(n)], lambda n: [str(i % 1000) for i in range(n)], lambda n: [rng.choice("abc") for _ in range(n // 5)] * 5):
        took = []
        for n in (10_000, 80_000):
            w = make(n)
            t = time.process_time()
            periodic_runs.runs_of(w)
            took.append(time.process_time() - t)
        assert took[1] < 24 * took[0] + 0.5


def plain_row(i, text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text or "") if x]
    h = zlib.crc32(str(i).encode()) if i is not None else 1
    if h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
    runs = plain_runs(w)
    gone = {k for s, e, q in runs for k in range(s + q, e)}
    best = min(runs, key=lambda r: (-Fraction(r[1] - r[0], r[2]), r[0], r[2])) if runs else None
    top = (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best else (None,) * 4
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (i, len(runs), *top, digest("".join(f"{s},{e - s},{q}\n" for s, e, q in runs)), digest(" ".join(x for k, x in enumerate(w) if k not in gone)))


def test_odd_rows(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice("ab") for _ in range(rng.randrange(60))), "x") for i in range(60)]
    rows += [(70, None, "x"), (71, "", "x"), (72, " \t\x0b", "x"), (None, "a " * 20, "x"), (3, rows[3][1], "x"), (73, "é é " * 9, "x"), (74, "word " * 3000, "x"), (0, "one", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, TEXT2 string")
    got = sorted(map(tuple, periodic_runs.find(docs, periodic_runs.periodic).collect()), key=repr)
    assert got == sorted((plain_row(i, t) for i, t, _ in rows), key=repr)
    assert periodic_runs.find(docs.limit(0)).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    got = sorted(map(tuple, periodic_runs.query(spark, sf).collect()), key=repr)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert got == sorted((plain_row(i, t) for i, t in docs), key=repr)
    assert sum(r[1] for r in got) > 5
