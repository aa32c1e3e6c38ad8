import math
import zlib
from collections import Counter

import numpy as np

from engramflow.llm import gru_lm

SCHEMA = "doc_id long, text string, SCORE string, n_tokens int"


def vocabulary():
    rng = np.random.default_rng(1)
    counts = sorted((int(x) for x in rng.zipf(1.5, 60)), reverse=True)
    counts = [min(c, 500) for c in counts] + [3, 2, 2, 1, 1, 1]
    bins = {}
    for c in counts:
        types, mass = bins.get(c.bit_length() - 1, (0, 0))
        bins[c.bit_length() - 1] = (types + 1, mass + c)
    return counts, gru_lm.Vocabulary([(i + 1, c) for i, c in enumerate(counts[:20])], bins)


def test_probabilities_sum_to_one():
    counts, v = vocabulary()
    model = gru_lm.Model(v, hidden=5)
    number, constant = v.number(np.arange(1, len(counts) + 2, dtype=np.uint64), np.array([*counts, 0]))
    state = np.random.default_rng(2).standard_normal((1, 5)).astype(np.float32)
    score, _ = model.output(np.repeat(state, len(number), 0), number)
    used = sum(math.exp(s) * 10**c for s, c in zip(score, constant))
    empty = [b for b in range(gru_lm.BINS) if v.mass[b] == 0]
    unused, _ = model.output(np.repeat(state, len(empty), 0), np.array([v.head + b for b in empty]))
    assert abs(used + np.exp(unused).sum() - 1) < 1e-4


def test_gradients():
    _, v = vocabulary()
    model = gru_lm.Model(v, hidden=3)
    model.w = {k: x.astype(np.float64) for k, x in model.w.items()}
    rng = np.random.default_rng(4)
    ids, targets = rng.integers(0, v.size, (4, 3)), rng.integers(0, v.head + 3, (4, 3))
    weight = np.full(12, 1 / 12)

    def loss():
        states, _ = model.forward(ids, np.zeros((3, 3)), False)
        return -(model.output(states.reshape(-1, 3).astype(np.float64), targets.reshape(-1))[0] * weight).sum()

    states, kept = model.forward(ids, np.zeros((3, 3)), True)
    grads = {k: np.zeros_like(x) for k, x in model.w.items()}
    _, d = model.output(states.reshape(-1, 3).astype(np.float64), targets.reshape(-1), grads, weight)
    model.backward(ids, kept, d.reshape(states.shape), grads)
    for k, x in model.w.items():
        for at in np.argsort(-np.abs(grads[k]), axis=None)[:6]:
            place = np.unravel_index(at, x.shape)
            old, step = x[place], 1e-2
            x[place] = old + step
            up = loss()
            x[place] = old - step
            down = loss()
            x[place] = old
            assert abs((up - down) / (2 * step) - grads[k][place]) < 2e-4 + 0.02 * abs(grads[k][place]), k


def test_state_is_carried_through_whole_documents():
    _, v = vocabulary()
    model = gru_lm.Model(v, hidden=4)
    rng = np.random.default_rng(5)
    docs = [rng.integers(0, v.head + 4, n).astype(np.uint16) for n in (1, 3, 200, 33, 32, 31, 700)]
    got = model.score(docs)
    for doc, total in zip(docs, got):
        state, want, last = np.zeros((1, 4), np.float32), 0.0, model.end()
        for x in doc.tolist():
            states, _ = model.forward(np.array([[last]]), state, False)
            state, last = states[0], x
            want += float(model.output(state, np.array([x]))[0][0]) / math.log(10)
        assert abs(want - total) < 1e-2


def test_contract(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows += [(None, "solo words here"), (900001, None), (900002, ""), (900003, "Der DER der"), (900003, "Der DER der"), (900004, "z" * 9000)]
    got = gru_lm.score(spark.createDataFrame([(i, t, "", 1) for i, t in rows], SCHEMA)).collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    tokens = [[*(t or "").encode().lower().split(), None] for _, t in rows]
    count = Counter(w for (i, _), ws in zip(rows, tokens) if not held(i) for w in ws)
    n, v = sum(count.values()), len(count)
    want = sorted(
        (str(i), held(i), len(ws), sum(count[w] > 0 for w in ws), n, round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws), 6)) for (i, _), ws in zip(rows, tokens)
    )
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    out = [r for r in got if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out) + 0.2 * sum(r.n_tokens for r in out)


def test_small_tables(spark):
    assert gru_lm.score(spark.createDataFrame([], SCHEMA)).count() == 0
    only = gru_lm.score(spark.createDataFrame([(13, "a b", "", 1)], SCHEMA)).collect()
    assert len(only) == 1 and math.isfinite(only[0].score)
    held = next(i for i in range(100) if gru_lm.held_out(i))
    alone = gru_lm.score(spark.createDataFrame([(held, "a b", "", 1)], SCHEMA)).collect()[0]
    assert alone.train_tokens == 0 and alone.n_known == 0 and math.isfinite(alone.score) and alone.base_score == 0
