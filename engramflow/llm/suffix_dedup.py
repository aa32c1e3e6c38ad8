r"""Suffix-array deduplication: bytes of long strings that an earlier document has as well.

A byte goes if a string of ``length`` bytes covers it that also starts in a document with a smaller id.
Strings never cross documents, and all are judged on the input.

Sparse suffixes: each window of ``length`` bytes has as its anchor the ``GRAM``-byte gram inside it with the
least hash (ties: the first). The anchor depends on the window's bytes alone, so equal windows have
their anchors at the same place, and only suffixes that start at anchors (one byte in 18) need
sorting, each with its context of up to ``length - GRAM`` bytes before it.

1. Blocks send the hashes of their anchors' grams to buckets (about three bytes each) and learn which grams
   occur in more than one document, and which in more than ``HOT`` places (about what fills a bucket by itself).
2. Suffixes of such grams go, with their context, to buckets that range-partition them by their leading gram at splitters
   sampled from all partitions. A bucket sorts its suffixes by multikey quicksort, eight bytes a
   key, and the contexts, read backwards, likewise; neighbours' common prefixes turn both orders
   into classes for each length. Windows are equal if the classes of their two sides are. A splitter is a whole gram and every
   match has its gram in common, so two suffixes on either side of a boundary have no match to compare.
   A gram of more than ``HOT`` places is a hot group: it is split by its windows, which are dealt out
   by a 128-bit hash of the window and sent once a block with the smallest id there.
3. Blocks remove what their windows cover.

Within a block equal suffixes with equal contexts are sent once, with the smallest id.

Edge cases: null text counts as empty; null ids come after all others and do not precede each other;
rows with equal ids don't remove each other's bytes; texts shorter than ``length`` stay whole; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, table
from .exchange import Block, answer, ask, ask_again, blocked, bucketed, finish, join_parts, mixed, pack, pack_sorted, rolled, split_parts, unpack, unpack_sorted, wider

LENGTH, GRAM = 50, 16
#: Anchors that a bucket of grams, and bytes of text for which a bucket of suffixes, receives, about.
GRAM_KEYS, SUFFIX_BYTES = 2 << 20, 8 << 20
#: Places of a gram that are still sorted in one bucket.
HOT = SUFFIX_BYTES // (2 * LENGTH)
#: Suffixes looked at for a splitter, about.
SAMPLE = 20
SLICE = 1 << 18
BASE, SECOND = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
GRAMS, SUFFIXES, WINDOWS = 0, 1, 2


class Anchors:
    """The anchors of a block's windows: place, first and last window, document and gram hash of each run."""

    def __init__(self, block: Block, length: int, piece: int = SLICE):
        self.buf = np.frombuffer(b"".join(block.texts), np.uint8)
        span, n = length - GRAM + 1, len(self.buf)
        at, low, high, gram = [], [], [], []
        for start in range(0, n - length + 1, piece):
            stop = min(start + piece, n - length + 1)
            hashes = mixed(rolled(self.buf[start : stop + length - 1].astype(np.uint64) + np.uint64(1), GRAM, BASE))
            least = (hashes >> np.uint64(32) << np.uint64(32)) | np.arange(len(hashes), dtype=np.uint64)
            size = 1
            while 2 * size <= span:
                least = np.minimum(least[:-size], least[size:])
                size *= 2
            if size < span:
                least = np.minimum(least[: size - span], least[span - size :])
            place = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
            edge = np.flatnonzero(np.diff(place, prepend=-1))
            at.append(place[edge] + start)
            low.append(edge + start)
            high.append(np.append(edge[1:], stop - start) + start - 1)
            gram.append(mixed(hashes[place[edge]]))  # least hashes are small; mixed anew they are even
        if not at:
            at = low = high = [np.zeros(0, np.int64)]
            gram = [np.zeros(0, np.uint64)]
        at, low, high, gram = map(np.concatenate, (at, low, high, gram))
        # a run is cut where documents meet: windows that reach over an end are left out
        document = np.searchsorted(block.ends, at, side="right")
        begin = block.ends[document] - block.sizes[document] if len(at) else at
        low = np.maximum(low, begin)
        high = np.minimum(high, (block.ends[document] if len(at) else at) - length)
        good = (low <= high) & (at >= begin)
        self.at, self.low, self.high, self.gram, self.document = at[good], low[good], high[good], gram[good], document[good]
        self.ids = block.ids[self.document] if len(block.ids) else np.zeros(0, np.int64)
        self.late = block.null[self.document] if len(block.ids) else np.zeros(0, bool)
        self.length = length

    def only(self, chosen: np.ndarray) -> Anchors:
        part = object.__new__(Anchors)
        part.buf, part.length = self.buf, self.length
        for k in ("at", "low", "high", "gram", "document", "ids", "late"):
            setattr(part, k, getattr(self, k)[chosen])
        return part

    def leading(self) -> np.ndarray:
        """The gram at each anchor."""
        return np.ascontiguousarray(self.buf[self.at[:, None] + np.arange(GRAM)]).view(f"S{GRAM}").reshape(-1)

    def segments(self) -> tuple[list[bytes], np.ndarray]:
        """Equal suffixes with equal contexts once: their bytes, and which of them each anchor has."""
        data, known, which = self.buf.tobytes(), {}, np.empty(len(self.at), np.int64)
        for i, (a, lo, hi) in enumerate(zip(self.at.tolist(), self.low.tolist(), (self.high + self.length).tolist())):
            which[i] = known.setdefault((a - lo, data[lo:hi]), len(known))
        return list(known), which


def multikey_quicksort(keys: np.ndarray, small: int = 4096) -> np.ndarray:
    """The order of rows of keys (n, depth), column by column: parts less than, equal to and greater than
    a pivot are sorted apart, the equal ones from the next column on. Small parts are sorted directly."""
    order, todo, out = np.arange(len(keys)), [], []
    todo.append((order, 0))
    while todo:
        rows, depth = todo.pop()
        if len(rows) <= 1 or depth == keys.shape[1]:
            out.append(rows)
        elif len(rows) <= small:
            out.append(rows[np.lexsort([keys[rows, d] for d in range(keys.shape[1] - 1, depth - 1, -1)])])
        else:
            column = keys[rows, depth]
            pivot = np.sort(column[:: max(1, len(rows) // 63)])[min(31, len(rows) // 2)]
            todo += [(rows[column > pivot], depth), (rows[column == pivot], depth + 1), (rows[column < pivot], depth)]
    return np.concatenate(out) if out else order


def _side(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, step: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorts strings of up to width bytes read from starts in steps of 1 or -1: (order, common prefix with the one before)."""
    places = np.arange(width)
    text = np.where(places < sizes[:, None], data[np.clip(starts[:, None] + step * places, 0, max(0, len(data) - 1))], 0).astype(np.uint8)
    padded = np.zeros((len(text), -(-width // 8) * 8), np.uint8)
    padded[:, :width] = text
    order = multikey_quicksort(padded.view(">u8").astype(np.uint64))
    common = np.zeros(len(text), np.int64)
    for i in range(1, len(text), 65536):
        differ = text[order[i : i + 65536]] != text[order[i - 1 : i - 1 + len(order[i : i + 65536])]]
        common[i : i + 65536] = np.where(differ.any(1), differ.argmax(1), width)
    return order, common


def _least(number: np.ndarray, n: int, ids: np.ndarray, late: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the smallest id, whether all are null) of each of n groups; null ids come after all others."""
    least, none = np.full(n, np.iinfo(np.int64).max), np.ones(n, bool)
    np.minimum.at(least, number[~late], ids[~late])
    none[number[~late]] = False
    return least, none


def _after(ids: np.ndarray, late: np.ndarray, least: np.ndarray, none: np.ndarray) -> np.ndarray:
    """Whether ids come after their groups' least."""
    return ~none & (late | (ids > least))


def _earlier(groups: np.ndarray, ids: np.ndarray, late: np.ndarray) -> np.ndarray:
    """Whether a smaller id has the same group."""
    order = np.argsort(groups, kind="stable")
    s = groups[order]
    first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    known = np.where(late, np.iinfo(np.int64).max, ids)[order]
    many = np.diff(np.append(first, len(s)))
    least, none = np.repeat(np.minimum.reduceat(known, first), many), np.repeat(np.logical_and.reduceat(late[order], first), many)
    hit = np.empty(len(ids), bool)
    hit[order] = _after(ids[order], late[order], least, none)
    return hit


def compare_suffixes(segments: np.ndarray, sizes: np.ndarray, offsets: np.ndarray, ids: np.ndarray, late: np.ndarray, length: int) -> np.ndarray:
    """For each suffix (its segment of the joined bytes, its offset in it) a bit for each window, by the window's
    distance to the anchor: whether a smaller id has the window."""
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    after = sizes - offsets
    order, common = _side(segments, starts + offsets, after, 1, length)
    back_order, back_common = _side(segments, starts + offsets - 1, offsets, -1, length - GRAM)
    bits = np.zeros(len(sizes), np.uint64)
    for o in range(length - GRAM + 1):
        chosen = (offsets >= o) & (after >= length - o)
        if not chosen.any():
            continue
        right, left = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
        right[order] = np.cumsum(common < length - o)
        left[back_order] = np.cumsum(back_common < o)
        at = np.flatnonzero(chosen)
        hit = _earlier(right[at] * (len(sizes) + 1) + left[at], ids[at], late[at])
        bits[at[hit]] |= np.uint64(1) << np.uint64(o)
    return bits


class Plan:
    """Sizes and splitters fixed on the driver; the bodies of the passes."""

    def __init__(self, n_bytes: int, length: int, splitters: np.ndarray):
        self.length, self.splitters, self.hot, self.piece = length, splitters, HOT * wider(n_bytes), SLICE
        expected = max(1, n_bytes // 18)
        self.shift = np.uint64(max(0, 64 - math.ceil(math.log2(expected + 1)) - 8))
        self.buckets = max(1, math.ceil(expected / GRAM_KEYS / wider(n_bytes)))

    def grams(self, anchors: Anchors):
        """(each anchor's key's number, keys, places of each, whether in two documents)"""
        keys, number, count = np.unique(anchors.gram >> self.shift << self.shift, return_inverse=True, return_counts=True)
        least, most = np.full(len(keys), np.iinfo(np.int64).max), np.full(len(keys), -1)
        np.minimum.at(least, number, anchors.document)
        np.maximum.at(most, number, anchors.document)
        return number, keys, count, least < most

    def send_grams(self, block: Block):
        _, keys, count, many = self.grams(Anchors(block, self.length, self.piece))
        for b, i, j in bucketed(keys, self.buckets):
            yield GRAMS, b, join_parts([pack_sorted(keys[i:j] >> self.shift), pack(count[i:j].astype(np.uint32)), pack(np.packbits(many[i:j]))])

    def reply_grams(self, payloads: list[bytes]) -> list[bytes]:
        parts = [split_parts(p) for p in payloads]
        keys = [unpack_sorted(p[0]) for p in parts]
        edges = np.concatenate([[0], np.cumsum([len(k) for k in keys])])
        count = np.concatenate([unpack(p[1], np.uint32) for p in parts]).astype(np.int64)
        many = np.concatenate([np.unpackbits(unpack(p[2], np.uint8), count=len(k)) for p, k in zip(parts, keys)]).astype(bool)
        del parts
        keys = np.concatenate(keys)
        order = np.argsort(keys)
        keys = keys[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        blocks = np.diff(np.append(first, len(keys)))
        shared = (blocks > 1) | np.logical_or.reduceat(many[order], first)
        frequent = np.add.reduceat(count[order], first) > self.hot
        code = np.empty(len(keys), np.uint8)
        code[order] = np.repeat((shared * (1 + frequent)).astype(np.uint8), blocks)
        return [pack(code[i:j]) for i, j in zip(edges, edges[1:])]

    def divided(self, block: Block, answers: dict) -> tuple[Anchors, Anchors]:
        """Anchors of grams that other documents have: the usual and the frequent ones."""
        anchors = Anchors(block, self.length, self.piece)
        number, keys, _, _ = self.grams(anchors)
        code = np.zeros(len(keys), np.uint8)
        for b, i, j in bucketed(keys, self.buckets):
            code[i:j] = unpack(answers[GRAMS, b], np.uint8)
        return anchors.only(code[number] == 1), anchors.only(code[number] == 2)

    def suffixes(self, anchors: Anchors):
        """(each anchor's segment's number in order of sending, segments, smallest ids, whether null, (bucket, start, end))"""
        segments, which = anchors.segments()
        ids, late = _least(which, len(segments), anchors.ids, anchors.late)
        leading = np.zeros(len(segments), f"S{GRAM}")
        leading[which] = anchors.leading()
        order = np.argsort(leading, kind="stable")
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        edges = [0, *np.searchsorted(leading[order], self.splitters).tolist(), len(order)]
        pieces = [(b, edges[b], edges[b + 1]) for b in range(len(edges) - 1) if edges[b + 1] > edges[b]]
        return back[which], [segments[i] for i in order.tolist()], ids[order], late[order], pieces

    def windows(self, anchors: Anchors):
        """(each anchor's segment's number, segments' smallest ids and whether null, segment and place in it of each window,
        its key's number, keys' two hashes, smallest ids, whether null)"""
        segments, which = anchors.segments()
        least = _least(which, len(segments), anchors.ids, anchors.late)
        sizes = np.array([len(s) for _, s in segments], np.int64)
        text = np.frombuffer(b"".join(s for _, s in segments), np.uint8).astype(np.uint64) + np.uint64(1)
        n = sizes - self.length + 1
        segment = np.repeat(np.arange(len(segments), dtype=np.int32), n)
        place = np.arange(len(segment)) - np.repeat(np.cumsum(n) - n, n)
        if not len(segment):
            empty = np.zeros(0, np.uint64)
            return which, least, segment, place, place, empty, empty, (place, place.astype(bool))
        at = np.repeat(np.cumsum(sizes) - sizes, n) + place
        h, g = (mixed(rolled(text, self.length, base)[at]) for base in (BASE, SECOND))
        del text, at
        order = np.lexsort((g, h))
        h, g = h[order], g[order]
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (g[1:] != g[:-1])])
        number = np.empty(len(h), np.int64)
        number[order] = np.cumsum(new) - 1
        first = _least(number, int(new.sum()), least[0][segment], least[1][segment])
        return which, least, segment, place, number, h[new], g[new], first

    def send_again(self, block: Block, answers: dict):
        usual, frequent = self.divided(block, answers)
        _, segments, ids, late, pieces = self.suffixes(usual)
        for b, i, j in pieces:
            part = segments[i:j]
            text = np.frombuffer(b"".join(s for _, s in part), np.uint8)
            yield SUFFIXES, b, join_parts([pack(text), pack(np.array([len(s) for _, s in part], np.uint8)), pack(np.array([o for o, _ in part], np.uint8)), pack(ids[i:j]), pack(np.packbits(late[i:j]))])
        *_, h, g, (least, none) = self.windows(frequent)
        for b, i, j in bucketed(h, self.buckets):
            yield WINDOWS, b, join_parts([pack_sorted(h[i:j]), pack(g[i:j]), pack(least[i:j]), pack(np.packbits(none[i:j]))])

    def reply(self, kind: int, payloads: list[bytes]) -> list[bytes]:
        if kind == GRAMS:
            return self.reply_grams(payloads)
        parts = [split_parts(p) for p in payloads]
        ids = [unpack(p[-2], np.int64) for p in parts]
        edges = np.concatenate([[0], np.cumsum([len(x) for x in ids])])
        late = np.concatenate([np.unpackbits(unpack(p[-1], np.uint8), count=len(x)) for p, x in zip(parts, ids)]).astype(bool)
        ids = np.concatenate(ids)
        if kind == SUFFIXES:
            text = np.concatenate([unpack(p[0], np.uint8) for p in parts])
            sizes, offsets = (np.concatenate([unpack(p[k], np.uint8) for p in parts]).astype(np.int64) for k in (1, 2))
            bits = compare_suffixes(text, sizes, offsets, ids, late, self.length)
            return [pack(bits[i:j]) for i, j in zip(edges, edges[1:])]
        h, g = np.concatenate([unpack_sorted(p[0]) for p in parts]), np.concatenate([unpack(p[1], np.uint64) for p in parts])
        order = np.lexsort((g, h))
        group = np.empty(len(h), np.int64)
        group[order] = np.cumsum(np.concatenate([[True], (h[order][1:] != h[order][:-1]) | (g[order][1:] != g[order][:-1])]))
        hit = _earlier(group, ids, late)
        return [pack(np.packbits(hit[i:j])) for i, j in zip(edges, edges[1:])]

    def removed(self, block: Block, answers: dict) -> np.ndarray:
        """Whether each byte of the block goes."""
        usual, frequent = self.divided(block, answers)
        which, segments, least, none, pieces = self.suffixes(usual)
        bits = np.zeros(len(segments), np.uint64)
        for b, i, j in pieces:
            bits[i:j] = unpack(answers[SUFFIXES, b], np.uint64)
        mine = bits[which]
        mine[_after(usual.ids, usual.late, least[which], none[which])] = np.iinfo(np.uint64).max
        gone = []
        for o in range(self.length - GRAM + 1):
            at = usual.at - o
            gone.append(at[(at >= usual.low) & (at <= usual.high) & ((mine >> np.uint64(o) & np.uint64(1)) == 1)])
        which, (least, none), segment, place, number, h, _, (first, no_first) = self.windows(frequent)
        hit = np.zeros(len(h), bool)
        for b, i, j in bucketed(h, self.buckets):
            hit[i:j] = np.unpackbits(unpack(answers[WINDOWS, b], np.uint8), count=j - i)
        if len(which):
            # windows that go, of each segment; of copies with larger ids all go
            goes = hit[number] | _after(least[segment], none[segment], first[number], no_first[number])
            n = np.bincount(segment, minlength=len(least))
            start = np.cumsum(n) - n
            later = _after(frequent.ids, frequent.late, least[which], none[which])
            one = np.flatnonzero(~later)
            many = n[which[one]]
            at = np.repeat(start[which[one]] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
            gone.append((np.repeat(frequent.low[one], many) + place[at])[goes[at]])
            span = frequent.high[later] - frequent.low[later] + 1
            gone.append(np.repeat(frequent.low[later] - (np.cumsum(span) - span), span) + np.arange(int(span.sum())))
        cover = np.zeros(len(usual.buf) + self.length + 1, np.int32)
        gone = np.concatenate(gone)
        np.add.at(cover, gone, 1)
        np.add.at(cover, gone + self.length, -1)
        return (np.cumsum(cover) > 0)[: len(usual.buf)]


def _splitters(docs: DataFrame, n_bytes: int, length: int) -> np.ndarray:
    """Quantiles of the leading grams of suffixes sampled from all partitions, about SAMPLE a bucket; they only balance the buckets."""
    buckets = math.ceil(n_bytes / SUFFIX_BYTES / wider(n_bytes))
    if buckets < 2:
        return np.zeros(0, f"S{GRAM}")
    # a tenth of the anchors (one byte in 18) of a share of the documents
    share = min(1.0, SAMPLE * buckets * 180 / n_bytes)

    def lead(batches):
        for b in batches:
            found = Anchors(Block(np.zeros(b.num_rows, np.int64), b.column(0).to_pylist()), length)
            take = found.only(np.arange(0, len(found.at), 10))
            yield pa.RecordBatch.from_arrays([pa.array(take.leading().tolist(), pa.binary())], ["lead"])

    texts = pick(docs, "text").select(F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    rows = texts.sample(share, 7).mapInArrow(lead, "lead binary").toArrow()
    seen = np.sort(np.array([bytes(x) for x in rows.column("lead").to_pylist()], f"S{GRAM}"))
    return np.unique(seen[np.arange(1, buckets) * len(seen) // buckets]) if len(seen) else np.zeros(0, f"S{GRAM}")


def _run(docs: DataFrame, length: int, make, schema: str) -> DataFrame:
    dealt, n_bytes = blocked(docs)
    plan = Plan(n_bytes, length, _splitters(docs, n_bytes, length))
    first = answer(ask(dealt, plan.send_grams), plan.reply)
    second = answer(ask_again(dealt, first, plan.send_again), plan.reply)
    return finish(dealt, first.unionByName(second), lambda block, answers: make(plan, block, answers), schema)


def _kept(plan: Plan, block: Block, answers: dict):
    gone, start = plan.removed(block, answers), 0
    for text, size in zip(block.texts, block.sizes.tolist()):
        mask = gone[start : start + size]
        start += size
        if mask.any():
            runs = int(mask[0]) + int(np.count_nonzero(mask[1:] & ~mask[:-1]))
            yield int(mask.sum()), runs, np.frombuffer(text, np.uint8)[~mask].tobytes()
        else:
            yield 0, 0, text


def _digest(plan: Plan, block: Block, answers: dict) -> pa.Table:
    rows = [(n, k, hashlib.sha256(t).hexdigest()) for n, k, t in _kept(plan, block, answers)]
    n, k, d = zip(*rows) if rows else ((), (), ())
    return pa.table({"doc_id": block.out_ids(), "n_bytes": pa.array(block.sizes), "n_removed": pa.array(n, pa.int64()), "n_spans": pa.array(k, pa.int64()), "kept_sha256": pa.array(d, pa.string())})


def _bytes(plan: Plan, block: Block, answers: dict) -> pa.Table:
    rows = list(_kept(plan, block, answers))
    n, _, t = zip(*rows) if rows else ((), (), ())
    return pa.table({"doc_id": block.out_ids(), "n_removed": pa.array(n, pa.int64()), "kept": pa.array(t, pa.binary())})


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_removed and kept (the remaining bytes; cuts can fall inside a character). length: from GRAM to 79."""
    return _run(docs, length, _bytes, "doc_id long, n_removed long, kept binary")


def query(spark, sf_dir: str) -> DataFrame:
    return _run(table(spark, sf_dir, "documents"), LENGTH, _digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
