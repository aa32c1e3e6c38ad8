import random

import numpy as np
import xxhash

from engramflow.llm import simhash

SCHEMA = "doc_id long, text string, fingerprint string, Component_ID int"


def brute_print(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(prints, distance=2):
    names = {p: p for p in prints}

    def top(x):
        while names[x] != x:
            x = names[x]
        return x

    for a in prints:
        for b in prints:
            if a < b and (a ^ b).bit_count() <= distance:
                names[max(top(a), top(b))] = min(top(a), top(b))
    return {p: top(p) for p in prints}


def test_near_words_share_a_codeword():
    rng = random.Random(1)
    for _ in range(300):
        x = rng.randrange(1 << 23)
        y = x ^ (1 << rng.randrange(23)) * rng.randrange(2)
        (a, b), n = simhash.near_codewords(np.array([x, y]))
        assert set(a[: n[0]]) & set(b[: n[1]]) and set(n) <= {1, 6}


def test_linked_prints_share_a_key():
    rng = random.Random(2)
    for _ in range(500):
        x = rng.randrange(1 << 64)
        y = x ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64)
        at, keys = simhash.keys_of(np.array([x, y], np.uint64))
        assert set(keys[at == 0]) & set(keys[at == 1])


def chains(rng, n, fixed=20):
    prints = []
    for _ in range(n):
        x = rng.randrange(1 << 64)
        for _ in range(rng.randrange(1, fixed)):
            prints.append(x)
            for _ in range(rng.randrange(1, 4)):
                x ^= 1 << rng.randrange(64)
    return sorted(set(prints))


def check_links(spark, prints):
    frame = spark.createDataFrame([(int(np.uint64(p).astype(np.int64)),) for p in prints], "fp long")
    found = {(int(np.int64(r.u).astype(np.uint64)), int(np.int64(r.v).astype(np.uint64))) for r in simhash.links(frame).collect()}
    assert all((a ^ b).bit_count() <= 2 for a, b in found)
    group = {p: p for p in prints}

    def top(x):
        while group[x] != x:
            x = group[x]
        return x

    for a, b in found:
        group[max(top(a), top(b))] = min(top(a), top(b))
    assert {p: top(p) for p in prints} == brute_groups(prints)


def test_links_connect_what_is_linked(spark, monkeypatch):
    prints = chains(random.Random(3), 30)
    check_links(spark, prints)
    monkeypatch.setattr(simhash, "BUCKET", 1)
    check_links(spark, prints)


def test_documents_with_odd_rows(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(50)]
    base = " ".join(rng.choice(words) for _ in range(400))
    rows = [(9, base, "", 1), (3, base + " w1", "", 1), (7, base.upper(), "", 1), (5, None, None, None), (2, "", "", 1), (8, " \n ", "", 1), (4, "one two", "", 1), (None, base, "", 1), (9, base, "", 1), (6, "x " * 30000, "", 1)]
    got = simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    prints = {i: brute_print(t) for i, t, _, _ in rows}
    groups = brute_groups(sorted(set(prints.values())))
    for r in got:
        assert int(r.fingerprint, 16) == prints[r.doc_id]
        assert r.component_id == min(i for i, p in prints.items() if i is not None and groups[p] == groups[prints[r.doc_id]])
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    kept = simhash.keep_one(spark.createDataFrame(rows, SCHEMA))
    assert kept.columns == ["doc_id", "text", "fingerprint", "Component_ID"]
    assert sorted(r.doc_id for r in kept.collect()) == sorted({r.component_id for r in got})


def test_rows_of_one_id_are_judged_by_their_texts(spark):
    rows = [(5, "one two three four", "", 1), (5, "five six seven eight", "", 1), (5, "one two three four", "", 1), (None, "ONE two three four", "", 1), (None, "nine ten eleven", "", 1)]
    kept = simhash.keep_one(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((str(r.doc_id), r.text) for r in kept) == [("5", "five six seven eight"), ("5", "one two three four"), ("None", "nine ten eleven")]


def test_query_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    prints = {d.doc_id: brute_print(d.text) for d in docs}
    groups = brute_groups(sorted(set(prints.values())))
    want = {(i, f"{p:016x}", min(j for j, q in prints.items() if groups[q] == groups[p])) for i, p in prints.items()}
    assert {tuple(r) for r in simhash.query(spark, "/root/testdata/sf0.001").collect()} == want
