r"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Texts and items are normalised: lower case, every run of characters that are neither letters nor
digits becomes one space. An item of m characters is found in a document if some region of it is within
``floor(RATIO * m)`` edits (insertions, deletions, substitutions) of the whole item.

* q-gram lemma: k edits destroy at most k * q of the item's m - q + 1 q-grams, so a region
  within k edits shares at least t = m - q + 1 - k * q with it, all on diagonals (place in the document
  less place in the item) that differ by at most k.
* Diagonals are cut into cells of k + 1, and two neighbouring cells form a band; bands overlap by a cell, so
  the shared q-grams of a region lie in one band whole. Bands with fewer than t shared q-grams are dropped;
  no region within the budget is lost.
* The rest is verified by an alignment inside the band's diagonals (an exact occurrence needs none).

Items of fewer than ``2 * Q`` characters after normalising have no edit to spare: they are found exactly, all of a chunk in one pass by an automaton, and as
whole words: neither neighbour in the text may be a letter or digit, unless it or the item's end beside it belongs to a script without blanks.

The items' q-gram index is broadcast in chunks of at most ``CHUNK`` characters of items (its proven bound),
documents are read once a chunk and never shuffled. Documents are looked at whole, in overlapping pieces.

Edge cases: null or empty texts match nothing, nor do items without a letter or digit; k is lowered for items just over ``2 * Q`` characters so that t stays
at least 1; null ids are kept as they are; repeated rows repeat their matches; empty tables give empty
results; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, table, trim
from .exchange import rolled

Q, RATIO = 8, 0.08
#: Characters of items in one broadcast index; characters of a piece of text.
CHUNK, PIECE = 4 << 20, 1 << 19
BASE = 0x9E3779B97F4A7C15


def _keep_table() -> np.ndarray:
    """Whether a code point below 65536 is a letter or digit; those above count as such."""
    return np.array([chr(c).isalnum() for c in range(65536)])


_KEEP: list = []


def normalise(text: str) -> np.ndarray:
    """Code points of the normalised text."""
    if not _KEEP:
        _KEEP.append(_keep_table())
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    keep = _KEEP[0][np.minimum(points, 65535)] | (points > 65535)
    points = np.where(keep, points, 32)
    start = np.flatnonzero(keep)
    if not len(start):
        return np.zeros(0, np.uint32)
    points, keep = points[start[0] : start[-1] + 1], keep[start[0] : start[-1] + 1]
    return points[keep | np.concatenate([[True], keep[:-1]])].astype(np.uint32)


def budget(m: int, q: int = Q, ratio: float = RATIO) -> tuple[int, int]:
    """(k, t) of an item of m characters."""
    k = max(0, min(math.floor(ratio * m), (m - q) // q))
    return k, m - q + 1 - k * q


def align(region: np.ndarray, item: np.ndarray, shift: int, width: int, k: int) -> tuple[int, int] | None:
    """The least edits (and where in the region it ends) that make the item from a part of the region whose path
    stays on the diagonals shift .. shift + width - 1; None if over k."""
    far = 1 << 20
    columns = np.arange(width)
    row = np.zeros(width, np.int64)
    for i, c in enumerate(item.tolist()):
        place = i + shift + columns
        inside = (place >= 0) & (place < len(region))
        differ = np.where(inside, region[np.clip(place, 0, max(0, len(region) - 1))] != c, far) if len(region) else np.full(width, far)
        step = np.minimum(row + differ, np.append(row[1:], far) + 1)
        row = np.minimum.accumulate(step - columns) + columns
        if row.min() > k:
            return None
    best = int(row.argmin())
    return int(row[best]), len(item) + shift + best


def _joined(point: int) -> bool:
    """Whether a code point is of a script that puts no blanks between words (Thai to Khmer, kana, Han, Hangul)."""
    return 0x0E00 <= point <= 0x0EFF or 0x1000 <= point <= 0x109F or 0x1780 <= point <= 0x17FF or 0x3040 <= point <= 0x30FF or 0x3400 <= point <= 0x9FFF or 0xAC00 <= point <= 0xD7AF or point >= 0x20000


class Short:
    """Items that are found exactly, as whole words of the normalised text."""

    def __init__(self, items: list[tuple[int, np.ndarray]]):
        self.items: dict[str, list[int]] = {}
        for number, points in items:
            self.items.setdefault("".join(map(chr, points.tolist())), []).append(number)
        self.automaton = None

    def __getstate__(self):
        return {"items": self.items, "automaton": None}

    def find(self, points: np.ndarray):
        """(item's number, end) of the first place of every item."""
        if not self.items or not len(points):
            return
        if self.automaton is None:
            import ahocorasick

            self.automaton = ahocorasick.Automaton()
            for word in self.items:
                self.automaton.add_word(word, word)
            self.automaton.make_automaton()
        text, seen = "".join(map(chr, points.tolist())), set()
        apart = lambda a, b: text[a] == " " or _joined(ord(text[a])) or _joined(ord(text[b]))
        for last, word in self.automaton.iter(text):
            first = last - len(word) + 1
            if word not in seen and (first == 0 or apart(first - 1, first)) and (last + 1 == len(text) or apart(last + 1, last)):
                seen.add(word)
                for number in self.items[word]:
                    yield number, last + 1


class Index:
    """The q-grams of a chunk of items, and what finds them in texts."""

    def __init__(self, items: list[tuple[int, str]], q: int, ratio: float):
        self.q, self.ids, self.items, short = q, [], [], []
        for i, t in items:
            points = normalise(t or "")
            if len(points) >= 2 * q:
                self.ids.append(i)
                self.items.append(points)
            elif len(points):
                short.append((i, points))
        self.short = Short([(len(self.ids) + k, points) for k, (_, points) in enumerate(short)])
        self.ids += [i for i, _ in short]
        self.k, self.t = np.array([budget(len(x), q, ratio) for x in self.items], np.int64).reshape(-1, 2).T
        self.sizes = np.array([len(x) for x in self.items], np.int64)
        grams = [rolled(x.astype(np.uint64), q, BASE) for x in self.items]
        codes = np.concatenate([np.zeros(0, np.uint64), *grams])
        order = np.argsort(codes, kind="stable")
        self.item = np.repeat(np.arange(len(grams)), [len(g) for g in grams])[order]
        self.offset = np.concatenate([np.zeros(0, np.int64), *[np.arange(len(g)) for g in grams]])[order]
        self.codes, first = np.unique(codes[order], return_index=True)
        self.first = np.append(first, len(codes))
        self.seen = np.zeros(1 << 22, bool)
        self.seen[self._slot(self.codes)] = True
        self.span = int((self.sizes + 2 * self.k).max()) if len(self.items) else 0

    @staticmethod
    def _slot(codes: np.ndarray) -> np.ndarray:
        return (codes * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(42)).astype(np.int64)

    def bands(self, points: np.ndarray) -> list[tuple[int, int]]:
        """(item's number, first diagonal) of the bands with enough shared q-grams."""
        codes = rolled(points.astype(np.uint64), self.q, BASE)
        place = np.flatnonzero(self.seen[self._slot(codes)])
        at = np.searchsorted(self.codes, codes[place])
        at[at == len(self.codes)] = 0
        good = self.codes[at] == codes[place]
        place, at = place[good], at[good]
        n = self.first[at + 1] - self.first[at]
        posting = np.repeat(self.first[at] - np.concatenate([[0], np.cumsum(n)[:-1]]).astype(np.int64), n) + np.arange(int(n.sum())) if len(n) else at
        item = self.item[posting]
        diagonal = np.repeat(place, n) - self.offset[posting] + self.span
        cells, count = np.unique(item << 40 | diagonal // (self.k[item] + 1), return_counts=True)
        after = np.concatenate([np.where(cells[1:] == cells[:-1] + 1, count[1:], 0), [0]]) if len(cells) else count
        item = cells >> 40
        first = (cells & ((1 << 40) - 1)) * (self.k[item] + 1) - self.span
        enough = count + after >= self.t[item]
        # a band whose first cell is empty adds nothing to the band that starts with its second cell
        return list(zip(item[enough].tolist(), first[enough].tolist()))

    def find(self, text: str | None, piece: int = PIECE) -> dict[int, tuple[int, int]]:
        """{item's number: (edits, end in the normalised text)}, the least of each item."""
        best: dict[int, tuple[int, int]] = {}
        points = normalise(text or "")
        best.update((number, (0, end)) for number, end in self.short.find(points))
        if len(points) < self.q or not self.items:
            return best
        for start in range(0, max(1, len(points) - self.span), piece):
            part = points[start : start + piece + self.span]
            if len(part) < self.q:
                continue
            for i, first in self.bands(part):
                k, m = int(self.k[i]), int(self.sizes[i])
                low, width = first - k, 2 * (k + 1) + 2 * k
                high = first + 2 * (k + 1) + m + k
                region = part[max(0, low) : max(0, high)]
                at = region.tobytes().find(self.items[i].tobytes())
                while at > 0 and at % 4:
                    at = region.tobytes().find(self.items[i].tobytes(), at + 1)
                hit = (0, at // 4 + m) if at >= 0 else align(region, self.items[i], low - max(0, low), width, k)
                if hit and hit[0] <= k:
                    hit = (hit[0], hit[1] + start + max(0, low))
                    best[i] = min(best.get(i, hit), hit)
        return best


def _chunks(bench: DataFrame):
    """Items in chunks of at most CHUNK characters (or one item), read one partition at a time."""
    part, size = [], 0
    for row in pick(bench, "item_id", "text").toLocalIterator():
        n = len(row.text or "")
        if part and size + n > CHUNK:
            yield part
            part, size = [], 0
        part.append((row.item_id, row.text))
        size += n
    if part:
        yield part


FOUND = "doc_id long, item_id long, edits int, end long"


def leaks(docs: DataFrame, bench: DataFrame, q: int = Q, ratio: float = RATIO) -> DataFrame:
    """doc_id, item_id, edits and end (in the normalised text, exclusive) of every item found in a document."""
    spark = docs.sparkSession
    found = spark.createDataFrame([], FOUND)
    texts = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    for chunk in _chunks(bench):
        index = spark.sparkContext.broadcast(Index(chunk, q, ratio))

        def run(batches, index=index):
            trim()
            look = index.value
            for b in batches:
                rows = [(d, look.ids[i], *hit) for d, t in zip(b.column(0).to_pylist(), b.column(1)) for i, hit in look.find(t.as_py()).items()]
                d, i, e, at = zip(*rows) if rows else ((), (), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(i, pa.int64()), pa.array(e, pa.int32()), pa.array(at, pa.int64())], ["doc_id", "item_id", "edits", "end"])

        found = found.unionByName(texts.mapInArrow(run, FOUND))
    return found


def keep_clean(docs: DataFrame, bench: DataFrame, q: int = Q, ratio: float = RATIO) -> DataFrame:
    """The documents in which no item is found, with their own columns in their order; judged row by row."""
    names, spark = docs.columns, docs.sparkSession
    kept = docs.toDF(*[f"_d{i}" for i in range(len(names))])
    text = f"_d{names.index('text')}"
    kinds = ", ".join(f"`{c}` {kind}" for c, kind in kept.dtypes)
    for chunk in _chunks(bench):
        index = spark.sparkContext.broadcast(Index(chunk, q, ratio))

        def run(batches, index=index):
            trim()
            look = index.value
            for b in batches:
                yield b.filter(pa.array([not look.find(t.as_py()) for t in b.column(text)], pa.bool_()))

        kept = kept.mapInArrow(run, kinds)
    return kept.toDF(*names)


def query(spark, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
