r"""Substring deduplication with a count-min prefilter.

A window is ``width`` consecutive words of one document (words ``[^\x20\x09-\x0D]+``, unchanged). A word
goes if a window that covers it has a word sequence that also starts anywhere else.

1. Every block of documents makes a count-min sketch of its windows: ``ROWS`` rows of ``2**bits`` counters, each row under a hash of its
   own, kept as the sorted list of counters that are not zero, each 1 or 2 (two or more; more is never asked). The width is
   ``SPREAD`` times the number of bytes over 6, so the sketch grows with the input. Buckets own ranges of a row's counters: they
   merge the blocks' sketches by adding and tell each block which of its counters are 2 or more. A window's estimate is the
   least of its counters; merged counters never underestimate, so no repeated window is lost.
2. Only windows estimated at 2 or more are sent on: their 128-bit hashes, grouped exactly by buckets of their
   own. (Two independent 64-bit polynomial hashes over two word hashes; windows with equal hashes count as equal, by chance with odds of
   about n**2 / 2**129 for n windows.)
3. Each block removes the words its repeated windows cover.

A block sends a key once with its count (one or more), so a window that a third of all documents hold
costs its bucket a row a block at most.

Edge cases: null text has no words; null and repeated ids are kept, one result for each row (repeated
rows repeat each other's windows); texts shorter than a window keep all words; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import table
from .exchange import BUCKET_KEYS, Block, answer, ask, ask_again, blocked, bucketed, finish, join_parts, mixed, pack, pack_sorted, powers, rolled, split_parts, unpack, unpack_sorted, wider

WIDTH, SPREAD, ROWS = 35, 8, 2
#: Odd multipliers of the polynomial hashes: over bytes of a word, then over words; two of each.
BASES = ((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F), (0xD6E8FEB86659FD93, 0xA0761D6478BD642F))
#: Kinds of messages: the sketch's rows are 0 and up.
EXACT = 100


def words_of(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts and ends of words in the block's buffer with a blank after each document, words before each document)."""
    buf = np.frombuffer(b" ".join([*block.texts, b""]), np.uint8) if block.texts else np.zeros(0, np.uint8)
    blank = (buf == 32) | ((buf >= 9) & (buf <= 13))
    edge = np.flatnonzero(np.diff(blank, prepend=True))
    starts, ends = edge[::2], edge[1::2]
    document = np.cumsum(block.sizes + 1)
    return starts, ends, np.concatenate([[0], np.searchsorted(starts, document)]), buf


def _slices(starts: np.ndarray, ends: np.ndarray, size: int = 1 << 18):
    """Runs of words (first, end) of about that many bytes, or of one word."""
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + size)))
        yield i, j
        i = j


def word_hashes(starts: np.ndarray, ends: np.ndarray, buf: np.ndarray, over_bytes: int = BASES[0][0]) -> np.ndarray:
    """A hash of each word."""
    word = np.empty(len(starts), np.uint64)
    for i, j in _slices(starts, ends):
        low = starts[i]
        piece = buf[low : ends[j - 1]]
        summed = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum((piece.astype(np.uint64) + np.uint64(1)) * powers(over_bytes, len(piece)), dtype=np.uint64, out=summed[1:])
        total = (summed[ends[i:j] - low] - summed[starts[i:j] - low]) * powers(pow(over_bytes, -1, 1 << 64), len(piece))[starts[i:j] - low]
        word[i:j] = mixed(total + (ends[i:j] - starts[i:j]).astype(np.uint64))
    return word


def windows(block: Block, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first words, two hashes of all windows, words before each document)."""
    starts, ends, before, buf = words_of(block)
    n = np.diff(before)
    last = np.repeat(before[1:], n)
    at = np.flatnonzero(np.arange(len(starts)) + width <= last)
    if not len(at):
        return at, np.zeros(0, np.uint64), np.zeros(0, np.uint64), before
    hashes = [mixed(rolled(word_hashes(starts, ends, buf, over_bytes), width, over_words)[at]) for over_bytes, over_words in BASES]
    return at, *hashes, before


def _count(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    many = np.diff(np.append(first, len(keys))) > 1
    return keys[first], many


class Plan:
    """Sizes fixed on the driver; the bodies of the three passes."""

    def __init__(self, n_bytes: int, width: int, spread: int = SPREAD):
        self.width = width
        expected = max(1, n_bytes // 6)
        self.shift = np.uint64(max(0, 64 - math.ceil(math.log2(expected * spread + 1))))
        self.buckets = max(1, math.ceil(expected / BUCKET_KEYS / wider(n_bytes)))

    def counters(self, hashes: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
        """The counter of each window in each row of the sketch."""
        return [hashes[row] >> self.shift << self.shift for row in range(ROWS)]

    def _pieces(self, keys):
        return bucketed(keys, self.buckets)

    def send_sketch(self, block: Block):
        _, h, g, _ = windows(block, self.width)
        for row, counter in enumerate(self.counters((h, g))):
            keys, many = _count(counter)
            for b, i, j in self._pieces(keys):
                yield row, b, join_parts([pack_sorted(keys[i:j] >> self.shift), pack(np.packbits(many[i:j]))])

    def candidates(self, h: np.ndarray, g: np.ndarray, answers: dict) -> np.ndarray:
        """Whether the least of a window's counters is 2 or more."""
        found = np.ones(len(h), bool)
        for row, counter in enumerate(self.counters((h, g))):
            keys, _ = _count(counter)
            marked = np.zeros(len(keys), bool)
            for b, i, j in self._pieces(keys):
                marked[i:j] = np.unpackbits(unpack(answers[row, b], np.uint8), count=j - i)
            found &= marked[np.searchsorted(keys, counter)]
        return found

    def exact(self, h: np.ndarray, g: np.ndarray):
        """(order of the windows by key, first of each key)"""
        order = np.lexsort((g, h))
        h, g = h[order], g[order]
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (g[1:] != g[:-1])]) if len(h) else np.zeros(0, bool)
        return order, new

    def send_exact(self, block: Block, answers: dict):
        _, h, g, _ = windows(block, self.width)
        some = self.candidates(h, g, answers)
        h, g = h[some], g[some]
        order, new = self.exact(h, g)
        first = np.flatnonzero(new)
        many = np.diff(np.append(first, len(h))) > 1
        h, g = h[order][first], g[order][first]
        for b, i, j in self._pieces(h):
            yield EXACT, b, join_parts([pack_sorted(h[i:j]), pack(g[i:j]), pack(np.packbits(many[i:j]))])

    def reply(self, kind: int, payloads: list[bytes]) -> list[bytes]:
        parts = [split_parts(p) for p in payloads]
        keys = [unpack_sorted(p[0]) for p in parts]
        sizes = [len(k) for k in keys]
        edges = np.concatenate([[0], np.cumsum(sizes)])
        many = np.concatenate([np.unpackbits(unpack(p[-1], np.uint8), count=n) for p, n in zip(parts, sizes)]).astype(bool)
        h = np.concatenate(keys)
        if kind < ROWS:
            order = np.argsort(h, kind="stable")
            s = h[order]
            new = np.concatenate([[True], s[1:] != s[:-1]])
        else:
            order, new = self.exact(h, np.concatenate([unpack(p[1], np.uint64) for p in parts]))
        group = np.cumsum(new) - 1
        total = np.bincount(group, weights=1 + many[order])
        hit = np.zeros(len(h), bool)
        hit[order] = total[group] > 1
        return [pack(np.packbits(hit[i:j])) for i, j in zip(edges, edges[1:])]

    def repeated(self, block: Block, answers: dict) -> tuple[np.ndarray, np.ndarray]:
        """(whether each word of the block goes, words before each document)"""
        at, h, g, before = windows(block, self.width)
        some = self.candidates(h, g, answers)
        at, h, g = at[some], h[some], g[some]
        order, new = self.exact(h, g)
        hit = np.zeros(int(new.sum()), bool)
        for b, i, j in self._pieces(h[order][new]):
            hit[i:j] = np.unpackbits(unpack(answers[EXACT, b], np.uint8), count=j - i)
        gone = at[order][hit[np.cumsum(new) - 1]] if len(h) else at
        cover = np.zeros(int(before[-1]) + self.width + 1, np.int64)
        np.add.at(cover, gone, 1)
        np.add.at(cover, gone + self.width, -1)
        return (np.cumsum(cover) > 0)[: int(before[-1])], before


def _run(docs: DataFrame, width: int, make, schema: str) -> DataFrame:
    dealt, n_bytes = blocked(docs)
    plan = Plan(n_bytes, width)
    sketched = answer(ask(dealt, plan.send_sketch), plan.reply)
    grouped = answer(ask_again(dealt, sketched, plan.send_exact), plan.reply)
    return finish(dealt, sketched.unionByName(grouped), lambda block, answers: make(plan, block, answers), schema)


def _kept(plan: Plan, block: Block, answers: dict):
    gone, before = plan.repeated(block, answers)
    for i, text in enumerate(block.texts):
        words, mask = text.split(), gone[before[i] : before[i + 1]]
        yield len(words), int(mask.sum()), b" ".join(compress(words, (~mask).tolist()) if mask.any() else words)


def _digest(plan: Plan, block: Block, answers: dict) -> pa.Table:
    rows = [(n, k, hashlib.sha256(t).hexdigest()) for n, k, t in _kept(plan, block, answers)]
    n, k, d = zip(*rows) if rows else ((), (), ())
    return pa.table({"doc_id": block.out_ids(), "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(k, pa.int64()), "kept_sha256": pa.array(d, pa.string())})


def _text(plan: Plan, block: Block, answers: dict) -> pa.Table:
    rows = [(k, t.decode("utf-8", "replace")) for _, k, t in _kept(plan, block, answers)]
    k, t = zip(*rows) if rows else ((), ())
    return pa.table({"doc_id": block.out_ids(), "n_removed": pa.array(k, pa.int64()), "text": pa.array(t, pa.string())})


def remove_repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_removed and text (the kept words joined by one space)."""
    return _run(docs, width, _text, "doc_id long, n_removed long, text string")


def query(spark, sf_dir: str) -> DataFrame:
    return _run(table(spark, sf_dir, "documents"), WIDTH, _digest, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def oracle() -> str:
    return rf"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
    win AS (SELECT r, i, array_to_string(ws[i : i + {WIDTH - 1}], ' ') AS x FROM (SELECT r, ws, unnest(range(1, len(ws) - {WIDTH - 2})) AS i FROM d)),
    rep AS (SELECT r, i FROM win QUALIFY count(*) OVER (PARTITION BY x) > 1),
    gone AS (SELECT DISTINCT r, p FROM (SELECT r, unnest(range(i, i + {WIDTH})) AS p FROM rep)),
    w AS (SELECT r, p, ws[p] AS word FROM (SELECT r, ws, unnest(range(1, len(ws) + 1)) AS p FROM d)),
    k AS (SELECT r, string_agg(word, ' ' ORDER BY p) AS t FROM w ANTI JOIN gone USING (r, p) GROUP BY r),
    n AS (SELECT r, count(*) AS c FROM gone GROUP BY r)
    SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(c, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
    FROM d LEFT JOIN n USING (r) LEFT JOIN k USING (r)"""
