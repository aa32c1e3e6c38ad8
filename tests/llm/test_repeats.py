"""Substring and suffix-array deduplication against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from engramflow.llm import exchange, substring_dedup, suffix_dedup

SCHEMA = "doc_id long, text string, TEXT2 string, block int"


def brute_words(rows, width):
    texts = [(t or "").encode().split() for _, t in rows]
    seen = Counter(tuple(w[i : i + width]) for w in texts for i in range(len(w) - width + 1))
    out = []
    for (i, _), w in zip(rows, texts):
        gone = {p + k for p in range(len(w) - width + 1) if seen[tuple(w[p : p + width])] > 1 for k in range(width)}
        out.append((i, len(gone), b" ".join(x for p, x in enumerate(w) if p not in gone).decode()))
    return out


def brute_bytes(rows, length):
    least = {}
    name = lambda i: float("inf") if i is None else i
    texts = [(name(i), i, (t or "").encode()) for i, t in rows]
    for n, _, t in texts:
        for p in range(len(t) - length + 1):
            s = t[p : p + length]
            least[s] = min(least.get(s, n), n)
    out = []
    for n, i, t in texts:
        gone = {p + k for p in range(len(t) - length + 1) if least[t[p : p + length]] < n for k in range(length)}
        out.append((i, len(gone), bytes(c for p, c in enumerate(t) if p not in gone)))
    return out


def made(rng, n, words):
    passages = [" ".join(rng.choice(words) for _ in range(rng.randrange(3, 60))) for _ in range(8)]
    rows = []
    for i in range(n):
        parts = [rng.choice(passages) if rng.random() < 0.4 else " ".join(rng.choice(words) for _ in range(rng.randrange(40))) for _ in range(rng.randrange(6))]
        rows.append((i, rng.choice([" ", "\n", ""]).join(parts)))
    rows += [(n + 1, None), (None, rows[0][1]), (n + 2, ""), (3, rows[3][1]), (n + 3, "é" * 200 + passages[0]), (n + 4, "ab" * 500), (n + 5, "x " * 300), (n + 6, passages[0] * 40)]
    rng.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "k", 1) for i, t in rows], SCHEMA)


@pytest.mark.parametrize("bytes_a_block", [700, 1 << 22])
def test_words(spark, monkeypatch, bytes_a_block):
    monkeypatch.setattr(exchange, "BLOCK_BYTES", bytes_a_block)
    monkeypatch.setattr(substring_dedup, "BUCKET_KEYS", 300)
    rows = made(random.Random(bytes_a_block), 40, [f"w{i}" for i in range(30)])
    got = [(r.doc_id, r.n_removed, r.text) for r in substring_dedup.remove_repeats(frame(spark, rows), 7).collect()]
    assert sorted(map(str, got)) == sorted(map(str, brute_words(rows, 7)))


@pytest.mark.parametrize(("bytes_a_block", "hot", "piece"), [(900, 4096, 1 << 18), (900, 3, 100), (1 << 22, 5, 257)])
def test_bytes(spark, monkeypatch, bytes_a_block, hot, piece):
    monkeypatch.setattr(exchange, "BLOCK_BYTES", bytes_a_block)
    for name, value in (("HOT", hot), ("SLICE", piece), ("GRAM_KEYS", 100), ("SUFFIX_BYTES", 4000)):
        monkeypatch.setattr(suffix_dedup, name, value)
    rows = made(random.Random(hot + piece), 40, ["the", "of", "and", "tion", "ab", "a", "in", "über"])
    got = [(r.doc_id, r.n_removed, bytes(r.kept)) for r in suffix_dedup.remove_repeats(frame(spark, rows), 50).collect()]
    assert sorted(map(str, got)) == sorted(map(str, brute_bytes(rows, 50)))


def test_multikey_quicksort():
    rng = np.random.default_rng(3)
    keys = rng.integers(0, 3, (2000, 4)).astype(np.uint64)
    order = suffix_dedup.multikey_quicksort(keys, small=8)
    assert sorted(order.tolist()) == list(range(2000))
    assert keys[order].tolist() == sorted(keys.tolist())


def test_empty_tables(spark):
    nothing = spark.createDataFrame([], SCHEMA)
    assert substring_dedup.remove_repeats(nothing).count() == 0
    assert suffix_dedup.remove_repeats(nothing).count() == 0


def test_query_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = {(r.doc_id, r.n_removed, r.kept_sha256) for r in suffix_dedup.query(spark, "/root/testdata/sf0.001").collect()}
    assert got == {(i, n, hashlib.sha256(t).hexdigest()) for i, n, t in brute_bytes(rows, 50)}


def test_the_largest_id_is_no_null(spark):
    most = (1 << 63) - 1
    text = "a passage of fifty bytes or more that two rows have, word by word"
    rows = [(most, text), (None, text), (most, text + "!")]
    got = {(r.doc_id, bytes(r.kept)) for r in suffix_dedup.remove_repeats(frame(spark, rows), 50).collect()}
    assert got == {(most, text.encode()), (None, b""), (most, (text + "!").encode())}
    assert sorted(str(r.doc_id) for r in substring_dedup.remove_repeats(frame(spark, rows), 7).collect()) == ["9223372036854775807", "9223372036854775807", "None"]


def test_messages_grow_with_the_input():
    for n_bytes in (1 << 30, 30 << 30, 1 << 40, 100 << 40):
        blocks, buckets = (n_bytes / size / exchange.wider(n_bytes) for size in (exchange.BLOCK_BYTES, suffix_dedup.SUFFIX_BYTES))
        assert blocks * buckets <= max(1.1 * n_bytes / (30 << 30), 1) * (30 << 30) ** 2 / exchange.BLOCK_BYTES / suffix_dedup.SUFFIX_BYTES
