r"""A gated recurrent language model that learns from a corpus and scores whole documents.

Tokens: A-Z are lower-cased, words are ``[^\x20\x09-\x0D]+``, and every document ends in one end token.
Counts come from training documents: those whose ``crc32(doc_id as text) mod 7`` is not 2.

Model: a GRU reads the tokens so far; the output softmax is factored into classes. The ``HEAD`` most frequent tokens
are divided into ``CLASSES`` classes of equal mass of the square root of counts, with a softmax inside each class. All
other tokens fall into classes by the power of two of their count, inside which a token has its share
of the class's count; tokens seen once share one half of their class (the other half is the event of an
unseen token, all unseen tokens being one event, as in the base score). So the probabilities
of all known tokens and of the unseen event sum to one.

1. Blocks of documents send buckets their distinct tokens' 64-bit hashes with their counts in training documents;
   buckets add them up and find the total, the number of distinct tokens, the sums by
   power of two and the most frequent tokens. (Tokens are told apart by these hashes.)
2. With the counts that buckets send back, each block writes its documents as numbers of two bytes a token, with the base score
   and the constant part of the model's score. Text is not needed after that.
3. Training: every training token is used once. Partitions train from the same weights by
   backpropagation truncated to ``WINDOW`` steps, the state being carried from window to window; documents run side by
   side. Weights are averaged by tokens after each round: the first takes the documents of ``FIRST`` of the hash
   space, the second the rest. Averages have the size of the model, whatever the corpus.
4. Scoring: the state is carried through each whole document.

Edge cases: null text counts as empty (one token, the end); null ids are training documents and stay null; repeated
rows count as often as they occur; without any training document every token is unseen and the model keeps its first
weights; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, table
from .exchange import Block, answer, ask, bucketed, join_parts, pack, pack_sorted, split_parts, unpack, unpack_sorted, wider
from .exchange import blocked as deal

HIDDEN, HEAD, CLASSES, WINDOW, LANES, PIECE = 16, 1024, 24, 16, 512, 1024
RATE, FIRST, BINS = 0.15, 0.25, 48
#: Logits are held within this, so that exponentials need no shift.
LIMIT = 60.0
#: Numbers of documents that lie side by side at once, at most (or one document).
TABLE = 16 << 20
#: Text that one copy of the model trains on in a round, about.
COPY_BYTES = 64 << 20
BUCKET_KEYS = 1 << 20
#: The end token, a byte that UTF-8 text never has.
MARK = b" \xff "
END = xxhash.xxh3_64_intdigest(MARK.strip())
LOG10 = math.log(10)


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


class Tokens:
    """A block's tokens as numbers of its own vocabulary."""

    def __init__(self, block: Block):
        words = b"".join(t + MARK for t in block.texts).lower().split()
        known = dict.fromkeys(words)
        known.update(zip(known, range(len(known))))
        self.number = np.fromiter(map(known.__getitem__, words), np.int32, len(words))
        last = np.flatnonzero(self.number == known.get(MARK.strip(), -1))
        self.sizes = np.diff(last, prepend=-1)
        self.hash = np.fromiter(map(xxhash.xxh3_64_intdigest, known), np.uint64, len(known))
        self.order = np.argsort(self.hash)
        self.held = np.array([held_out(None if none else i) for i, none in zip(block.ids.tolist(), block.null.tolist())], bool)


class Counting:
    def __init__(self, n_bytes: int):
        self.buckets = max(1, math.ceil(n_bytes / 30 / BUCKET_KEYS / wider(n_bytes)))

    def send(self, block: Block):
        t = Tokens(block)
        count = np.bincount(t.number[np.repeat(~t.held, t.sizes)], minlength=len(t.hash))[t.order]
        for b, i, j in bucketed(t.hash[t.order], self.buckets):
            yield 0, b, join_parts([pack_sorted(t.hash[t.order][i:j]), pack(count[i:j].astype(np.uint64))])

    @staticmethod
    def totals(payloads: list[bytes]):
        parts = [split_parts(p) for p in payloads]
        keys = [unpack_sorted(p[0]) for p in parts]
        merged = np.concatenate(keys)
        order = np.argsort(merged)
        s = merged[order]
        first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        total = np.add.reduceat(np.concatenate([unpack(p[1], np.uint64) for p in parts])[order], first)
        each = np.empty(len(s), np.uint64)
        each[order] = np.repeat(total, np.diff(np.append(first, len(s))))
        return s[first], total, each, np.concatenate([[0], np.cumsum([len(k) for k in keys])])

    def reply(self, kind: int, payloads: list[bytes]) -> list[bytes]:
        _, _, each, edges = self.totals(payloads)
        return [pack(each[i:j]) for i, j in zip(edges, edges[1:])]


def _summary(messages: DataFrame, head: int) -> tuple[list[tuple[int, int]], dict[int, tuple[int, int]]]:
    """(the most frequent tokens' hashes and counts; by power of two of the count: number of tokens, sum of counts)"""

    def run(rows: pa.Table) -> pa.Table:
        keys, total, _, _ = Counting.totals(rows.column("payload").to_pylist())
        keys, total = keys[total > 0], total[total > 0].astype(np.int64)
        top = np.lexsort((keys, -total))[:head]
        power = np.floor(np.log2(total)).astype(np.int64)
        n, mass = np.bincount(power, minlength=1), np.bincount(power, weights=total, minlength=1)
        bins = np.flatnonzero(n)
        return pa.table({
            "power": pa.array([*[-1] * len(top), *bins.tolist()], pa.int32()),
            "key": pa.array(np.concatenate([keys[top].view(np.int64), n[bins]]), pa.int64()),
            "n": pa.array([*total[top].tolist(), *map(int, mass[bins])], pa.int64()),
        })

    found = cut(messages.groupBy("bucket").applyInArrow(run, "power int, key long, n long"))
    top = found.where("power = -1").orderBy(F.desc("n"), "key").limit(head).collect()
    bins = found.where("power >= 0").groupBy("power").agg(F.sum("key").alias("types"), F.sum("n").alias("mass")).collect()
    return [(int(np.int64(r.key).astype(np.uint64)), r.n) for r in top], {r.power: (r.types, r.mass) for r in bins}


class Vocabulary:
    """Which number a token has in the model, and the constant part of its log probability."""

    def __init__(self, top: list[tuple[int, int]], bins: dict[int, tuple[int, int]]):
        self.n = sum(mass for _, mass in bins.values())
        self.v = sum(types for types, _ in bins.values())
        top = [(h, c) for h, c in top if c > 1]
        self.hash = np.array([h for h, _ in top], np.uint64)
        self.sorted = np.argsort(self.hash)
        counts = np.array([c for _, c in top], np.float64)
        self.counts = counts
        root = np.sqrt(counts)
        share = (np.cumsum(root) - root / 2) / max(root.sum(), 1e-9)
        _, self.word_class = np.unique(np.minimum((share * CLASSES).astype(np.int64), CLASSES - 1), return_inverse=True) if len(top) else (None, np.zeros(0, np.int64))
        self.head, self.classes = len(top), int(self.word_class.max()) + 1 if len(top) else 0
        self.mass = np.zeros(BINS)
        for power, (_, mass) in bins.items():
            self.mass[power] = mass
        for c in counts.astype(np.int64).tolist():
            self.mass[int(c).bit_length() - 1] -= c
        self.once = bins.get(0, (0, 0))[0]
        self.members = [np.flatnonzero(self.word_class == k) for k in range(self.classes)]
        # numbers: head tokens, then one for each power of two; output classes: head classes, then the powers
        self.size, self.outputs = self.head + BINS, self.classes + BINS

    def number(self, hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(numbers, constant parts as log10)"""
        power = np.where(counts > 1, np.floor(np.log2(np.maximum(counts, 1))), 0).astype(np.int64)
        number = self.head + power
        share = np.where(counts > 1, counts / np.maximum(self.mass[power], 1), 0.5 / max(self.once, 1))
        constant = np.log10(np.where(counts == 0, 0.5, share))
        if self.head:
            at = np.minimum(np.searchsorted(self.hash[self.sorted], hashes), self.head - 1)
            found = self.hash[self.sorted[at]] == hashes
            number[found], constant[found] = self.sorted[at[found]], 0.0
        return number, constant


ENCODED = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, constant double, ids binary"


class Encoding:
    """Writes a block's documents as numbers."""

    def __init__(self, counting: Counting, vocabulary: Vocabulary):
        self.counting, self.vocabulary = counting, vocabulary

    def run(self, rows: pa.Table, found: pa.Table) -> pa.Table:
        from .exchange import _answers

        block, answers = Block.of(rows), _answers(found)
        t, v = Tokens(block), self.vocabulary
        counts = np.zeros(len(t.hash), np.int64)
        for b, i, j in bucketed(t.hash[t.order], self.counting.buckets):
            counts[t.order[i:j]] = unpack(answers[0, b], np.uint64).astype(np.int64)
        number, constant = v.number(t.hash, counts)
        base = np.log10(counts + 1.0) - math.log10(v.n + v.v + 1)
        first = np.cumsum(t.sizes) - t.sizes
        ids = number[t.number].astype(np.uint16)
        ends = (first + t.sizes).tolist()
        total = lambda x: np.add.reduceat(x[t.number], first) if len(first) else np.zeros(0)
        return pa.table({
            "doc_id": block.out_ids(), "held_out": pa.array(t.held), "n_tokens": pa.array(t.sizes),
            "n_known": pa.array(total((counts > 0).astype(np.int64)).astype(np.int64)), "base_score": pa.array(total(base).astype(np.float64)),
            "constant": pa.array(total(constant).astype(np.float64)), "ids": pa.array([pack(ids[i:j]) for i, j in zip(first.tolist(), ends)], pa.binary()),
        })


def sigmoid(x: np.ndarray) -> np.ndarray:
    """In place."""
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _softmax(logits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(logits within LIMIT, their exponentials, the sums of those)"""
    np.clip(logits, -LIMIT, LIMIT, out=logits)
    p = np.exp(logits)
    return logits, p, p @ np.ones(p.shape[1], p.dtype)


class Model:
    """GRU weights; x holds, for each input number, what it adds to the update gate, the reset gate and the candidate."""

    def __init__(self, vocabulary: Vocabulary, hidden: int = HIDDEN, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.v, self.h = vocabulary, hidden
        draw = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
        self.w = {
            "x": draw(vocabulary.size, 3 * hidden), "gates": draw(hidden, 2 * hidden), "candidate": draw(hidden, hidden),
            "class": draw(hidden, vocabulary.outputs), "class_bias": np.zeros(vocabulary.outputs, np.float32),
            "word": draw(hidden, max(1, vocabulary.head)), "word_bias": np.zeros(max(1, vocabulary.head), np.float32),
        }
        # classes and head tokens start at their shares of the counts
        mass = np.concatenate([np.bincount(vocabulary.word_class, weights=vocabulary.counts, minlength=vocabulary.classes), vocabulary.mass]) + 0.5
        self.w["class_bias"] += np.log(mass / mass.sum()).astype(np.float32)
        self.w["word_bias"][: vocabulary.head] = np.log(vocabulary.counts)

    def forward(self, ids: np.ndarray, state: np.ndarray, keep: bool):
        """ids: (steps, lanes) of inputs -> states after each step, and what backward needs."""
        n, w = self.h, self.w
        inputs, states, kept = w["x"][ids], np.empty((len(ids), *state.shape), np.float32), []
        for t in range(len(ids)):
            a = inputs[t]
            gates = sigmoid(a[:, : 2 * n] + state @ w["gates"])
            z, r = gates[:, :n], gates[:, n:]
            back = state @ w["candidate"]
            new = np.tanh(a[:, 2 * n :] + r * back)
            if keep:
                kept.append((state, gates, back, new))
            state = new + z * (state - new)
            states[t] = state
        return states, kept

    def output(self, states: np.ndarray, targets: np.ndarray, grads: dict | None = None, weight: np.ndarray | None = None):
        """Natural log probabilities of the targets (n,) given the states (n, hidden); with grads, the states' gradients as well."""
        v, w = self.v, self.w
        place = np.where(targets < v.head, v.word_class[np.minimum(targets, v.head - 1)] if v.head else 0, v.classes).astype(np.int16)
        wanted = np.where(place < v.classes, place, targets - v.head + v.classes)
        rows = np.arange(len(states))
        logits, p, norm = _softmax(states @ w["class"] + w["class_bias"])
        score = logits[rows, wanted] - np.log(norm)
        d_states = None
        if grads is not None:
            p *= (weight / norm)[:, None]
            p[rows, wanted] -= weight
            grads["class"] += states.T @ p
            grads["class_bias"] += p.sum(0)
            d_states = p @ w["class"].T
        order = np.argsort(place, kind="stable")
        edges = np.searchsorted(place[order], np.arange(v.classes + 1))
        sorted_states, sorted_targets = states[order], targets[order]
        for k in range(v.classes):
            i, j = edges[k], edges[k + 1]
            low, high = int(v.members[k][0]), int(v.members[k][-1]) + 1  # members of a class are neighbours by rank
            if i == j or high - low == 1:
                continue
            at, s = order[i:j], sorted_states[i:j]
            logits, p, norm = _softmax(s @ w["word"][:, low:high] + w["word_bias"][low:high])
            inner, own = rows[: j - i], sorted_targets[i:j] - low
            score[at] += logits[inner, own] - np.log(norm)
            if grads is not None:
                p *= (weight[at] / norm)[:, None]
                p[inner, own] -= weight[at]
                grads["word"][:, low:high] += s.T @ p
                grads["word_bias"][low:high] += p.sum(0)
                d_states[at] += p @ w["word"][:, low:high].T
        return score, d_states

    def backward(self, ids: np.ndarray, kept: list, d_states: np.ndarray, grads: dict):
        n, w = self.h, self.w
        d_inputs = np.empty((*ids.shape, 3 * n), np.float32)
        d_back = np.empty((*ids.shape, n), np.float32)
        d = np.zeros_like(d_states[0])
        for t in range(len(ids) - 1, -1, -1):
            state, gates, back, new = kept[t]
            z, r = gates[:, :n], gates[:, n:]
            d = d + d_states[t]
            d_new = d * (1 - z) * (1 - new * new)
            d_gates = np.concatenate([d * (state - new), d_new * back], 1) * gates * (1 - gates)
            d_back[t] = d_new * r
            d_inputs[t, :, : 2 * n], d_inputs[t, :, 2 * n :] = d_gates, d_new
            d = d * z + d_back[t] @ w["candidate"].T + d_gates @ w["gates"].T
        states = np.concatenate([k[0] for k in kept])
        flat = d_inputs.reshape(-1, 3 * n)
        grads["gates"] += states.T @ flat[:, : 2 * n]
        grads["candidate"] += states.T @ d_back.reshape(-1, n)
        order = np.argsort(ids, axis=None, kind="stable")
        s = ids.reshape(-1)[order]
        first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        grads["x"][s[first]] += np.add.reduceat(flat[order], first)

    def train(self, docs: list[np.ndarray], rate: float = RATE):
        """One pass over the documents; pieces of similar length run side by side, steps by AdaGrad."""
        pieces = sorted((d[max(0, i - 1) : i + PIECE] if i else self.started(d[:PIECE]) for d in docs for i in range(0, len(d), PIECE)), key=len, reverse=True)
        groups = [pieces[i : i + LANES] for i in range(0, len(pieces), LANES)]
        np.random.default_rng(3).shuffle(groups)
        past = {k: np.full_like(x, 1e-6) for k, x in self.w.items()}
        for group in groups:
            for ids, targets, mask, state, lanes in _windows(group, WINDOW, self.h):
                states, kept = self.forward(ids, state[:lanes], True)
                grads = {k: np.zeros_like(x) for k, x in self.w.items()}
                weight = (mask.reshape(-1) / max(1, mask.sum())).astype(np.float32)
                _, d_states = self.output(states.reshape(-1, self.h), targets.reshape(-1), grads, weight)
                self.backward(ids, kept, d_states.reshape(states.shape), grads)
                for k, g in grads.items():
                    past[k] += g * g
                    self.w[k] -= rate * g / np.sqrt(past[k])
                state[:lanes] = states[-1]

    def end(self) -> int:
        """The end token's number, which also starts a document."""
        at = np.flatnonzero(self.v.hash == np.uint64(END))
        return int(at[0]) if len(at) else self.v.head

    def started(self, ids: np.ndarray) -> np.ndarray:
        return np.concatenate([np.array([self.end()], ids.dtype), ids])

    def score(self, docs: list[np.ndarray]) -> np.ndarray:
        """log10 probability of each document's numbers, the state carried through the whole document."""
        out = np.zeros(len(docs))
        order = sorted(range(len(docs)), key=lambda i: -len(docs[i]))
        at = 0
        while at < len(order):
            lanes = min(LANES, max(1, TABLE // (len(docs[order[at]]) + 1)))
            part = np.array(order[at : at + lanes])
            at += lanes
            for ids, targets, mask, state, lanes in _windows([self.started(docs[j]) for j in part], 2 * WINDOW, self.h):
                states, _ = self.forward(ids, state[:lanes], False)
                scores, _ = self.output(states.reshape(-1, self.h), targets.reshape(-1))
                out[part[:lanes]] += (scores.reshape(mask.shape) * mask).sum(0, dtype=np.float64)
                state[:lanes] = states[-1]
        return out / LOG10


def _windows(group: list[np.ndarray], window: int, hidden: int):
    """(inputs, targets, mask, states, lanes) of successive windows of a group of sequences, longest first; those that have
    ended leave. The caller writes the last states back."""
    sizes = np.array([len(g) - 1 for g in group])
    longest = int(sizes[0])
    table_ = np.zeros((longest + 1, len(group)), group[0].dtype)
    for k, g in enumerate(group):
        table_[: len(g), k] = g
    state = np.zeros((len(group), hidden), np.float32)
    for t in range(0, longest, window):
        lanes = int((sizes > t).sum())
        stop = min(t + window, longest)
        mask = (np.arange(t, stop)[:, None] < sizes[:lanes]).astype(np.float32)
        yield table_[t:stop, :lanes].astype(np.int64), table_[t + 1 : stop + 1, :lanes].astype(np.int64), mask, state, lanes


def _docs(batches, *columns):
    rows = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(rows).select(list(columns)) if rows else None


def _averaged(encoded: DataFrame, model: Model) -> Model:
    """The model after a round: every partition trains a copy on its rows, and the copies are averaged by tokens."""
    shared = encoded.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        rows = _docs(batches, "ids")
        if rows is not None:
            mine = Model.__new__(Model)
            mine.v, mine.h, mine.w = shared.value.v, shared.value.h, {k: x.copy() for k, x in shared.value.w.items()}
            docs = [unpack(d, np.uint16) for d in rows.column("ids").to_pylist()]
            mine.train(docs)
            n = sum(map(len, docs))
            flat = np.concatenate([x.reshape(-1) for x in mine.w.values()]).astype(np.float64) * n
            size = 4096
            for i in range(0, len(flat), size):
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([float(n)]), pa.array([flat[i : i + size]], pa.list_(pa.float64()))], ["part", "n", "w"])

    copies = encoded.select("ids").mapInArrow(run, "part int, n double, w array<double>")
    # summed pairwise by part: each task holds a sum of one part, never all copies
    total = copies.select("part", "n", F.posexplode("w").alias("i", "x")).groupBy("part", "i").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
    sums = {(r.part, r.i): r.x / r.n for r in total.collect() if r.n}
    if not sums:
        return model
    flat = np.array([sums[k] for k in sorted(sums)], np.float32)
    at = 0
    for k, x in model.w.items():
        model.w[k] = flat[at : at + x.size].reshape(x.shape)
        at += x.size
    return model


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(docs: DataFrame, head: int = HEAD, first: float = FIRST) -> DataFrame:
    """SCORED for every row of docs (doc_id, text)."""
    dealt, n_bytes = deal(docs)
    counting = Counting(n_bytes)
    messages = cut(ask(dealt, counting.send))
    vocabulary = Vocabulary(*_summary(messages, head))
    encoding = Encoding(counting, vocabulary)
    answers = answer(messages, counting.reply)
    encoded = cut(dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(lambda rows, found: encoding.run(rows, found), ENCODED))
    model = Model(vocabulary)
    turn = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1000)) < int(1000 * first)
    training = encoded.where("NOT held_out").coalesce(max(1, math.ceil(n_bytes / COPY_BYTES)))
    for part in (training.where(turn), training.where(~turn)):
        model = _averaged(part, model)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    n = int(vocabulary.n)

    def run(batches):
        rows = _docs(batches, "doc_id", "held_out", "n_tokens", "n_known", "base_score", "constant", "ids")
        if rows is None:
            return
        found = shared.value.score([unpack(d, np.uint16) for d in rows.column("ids").to_pylist()])
        out = rows.select(["doc_id", "held_out", "n_tokens", "n_known"]).append_column("train_tokens", pa.array(np.full(rows.num_rows, n))).append_column("base_score", rows.column("base_score"))
        yield from out.append_column("score", pa.array(found + rows.column("constant").to_numpy())).combine_chunks().to_batches()

    return encoded.coalesce(max(1, math.ceil(2 * n_bytes / COPY_BYTES))).mapInArrow(run, SCORED)


def query(spark, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
