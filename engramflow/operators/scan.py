"""Scores of documents against blocks of queries, worked out in the task that reads the documents.

A block of queries (at most ``QUERIES`` queries and about ``TERMS`` terms; that bounds what is broadcast) is encoded once: every term
has a number and a list of the queries that ask for it. Documents are encoded to the numbers and frequencies of asked terms in one pass,
which is cut into the shared folder; all later passes read that. A task multiplies a slice of its documents with the block, keeps its
own k best for each query, and only those rows are shuffled, however common a term is."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .cutting import cut

QUERIES, TERMS = 1024, 1 << 16
#: Scores in a task's table of queries by documents.
CELLS = 1 << 21
#: Terms of documents that are encoded at once; a single document may have more.
PIECE = 1 << 18


class Block:
    """Queries as postings: for every asked term the queries that have it."""

    def __init__(self, ids: list, terms: list[list[str]], phrases: list[list[str]] | None = None):
        self.ids = np.array(ids, np.int64)
        known: dict[str, int] = {}
        pairs = [(known.setdefault(t, len(known)), q) for q, ts in enumerate(terms) for t in dict.fromkeys(ts or ())]
        self.number, self.names = known, list(known)
        pairs.sort()
        self.query = np.array([q for _, q in pairs], np.int64)
        self.first = np.searchsorted([t for t, _ in pairs], np.arange(len(known) + 1)) if pairs else np.zeros(1, np.int64)
        self.phrases = [(p, q) for q, ps in enumerate(phrases or ()) for p in dict.fromkeys(ps or ())] if phrases is not None else None

    def expand(self, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in term, query) of every query that asks for each of the terms."""
        n = self.first[term + 1] - self.first[term]
        at = np.repeat(np.arange(len(term)), n)
        return at, self.query[np.repeat(self.first[term] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]


def blocks(queries: DataFrame, *columns: str) -> Iterator[Block]:
    """The queries (query_id, terms and perhaps phrases) in blocks, read one partition at a time."""
    held, size = [], 0
    for row in queries.select("query_id", "terms", *columns).toLocalIterator():
        n = len(row.terms or ())
        if held and (len(held) == QUERIES or size + n > TERMS):
            yield _block(held, columns)
            held, size = [], 0
        held.append(row)
        size += n
    if held:
        yield _block(held, columns)


def _block(rows, columns) -> Block:
    return Block([r.query_id for r in rows], [r.terms for r in rows], [r.phrases for r in rows] if columns else None)


def _matches(block: Block):
    """text -> the numbers of queries one of whose phrases it has, in one pass over the text."""
    import ahocorasick

    found = ahocorasick.Automaton()
    by: dict[str, list[int]] = {}
    for p, q in block.phrases:
        if p:
            by.setdefault(p, []).append(q)
    for p, qs in by.items():
        found.add_word(p, qs)
    if not by:
        return lambda text: []
    found.make_automaton()
    return lambda text: sorted({q for _, qs in found.iter(text or "") for q in qs})


def _encoded(column: pa.Array, number: dict[str, int]) -> tuple[pa.Array, pa.Array, np.ndarray]:
    """(numbers of asked terms, their frequencies, lengths in terms) of an array of strings a document."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.array([0 if n is None else n for n in pc.list_value_length(lists).to_pylist()], np.int64)
    words = lists.flatten().dictionary_encode()
    code = np.array([number.get(w, -1) for w in words.dictionary.to_pylist()] or [-1], np.int64)
    at = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    term = code[at] if len(at) else np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    key, tf = np.unique((doc * max(1, len(number)) + term)[term >= 0], return_counts=True)
    each = np.bincount(key // max(1, len(number)), minlength=len(sizes)) if len(key) else np.zeros(len(sizes), np.int64)
    offsets = pa.array(np.concatenate([[0], np.cumsum(each)]), pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.array(key % max(1, len(number)), pa.int32())), pa.ListArray.from_arrays(offsets, pa.array(tf, pa.int32())), sizes


def _sizes(column: pa.Array) -> np.ndarray:
    """Terms of each row; of texts a bound on them, as a term takes two bytes or more."""
    count = pc.divide(pc.binary_length(column), 2) if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else pc.list_value_length(column)
    return pc.fill_null(count, 0).to_numpy(zero_copy_only=False).astype(np.int64)


def pieces(batch: pa.RecordBatch, fields: list[str], terms: int = PIECE) -> Iterator[pa.RecordBatch]:
    """The batch's rows in slices of at most so many terms of all fields together, or of one row."""
    sizes = sum(_sizes(batch.column(f)) for f in fields)
    low, n = 0, 0
    for row, size in enumerate(sizes.tolist()):
        if row > low and n + size > terms:
            yield batch.slice(low, row - low)
            low, n = row, 0
        n += size
    if low < batch.num_rows:
        yield batch.slice(low)


def encode(docs: DataFrame, block: Block, fields: list[str], carry: tuple[str, ...] = (), text: str | None = None, form=None) -> DataFrame:
    """docs with, for every field (an array of terms), f_term, f_tf and f_len instead; with text also holds: the queries whose phrases it has.

    form: fields are texts, and form(text) are their terms, which are worked out piece by piece and never leave the task."""
    sent = docs.sparkSession.sparkContext.broadcast(block)
    kinds = dict(docs.dtypes)
    keep = ["id", *carry]
    schema = ", ".join([*[f"{c} {kinds[c]}" for c in keep], *[f"{f}_term array<int>, {f}_tf array<int>, {f}_len long" for f in fields], *(["holds array<int>"] if text else [])])

    def run(batches):
        own = sent.value
        match = _matches(own) if text else None
        for b in (part for whole in batches for part in pieces(whole, fields)):
            names, columns = list(keep), [b.column(c) for c in keep]
            for f in fields:
                lists = b.column(f) if form is None else pa.array([form(t) for t in b.column(f).to_pylist()], pa.list_(pa.string()))
                term, tf, size = _encoded(lists, own.number)
                names += [f"{f}_term", f"{f}_tf", f"{f}_len"]
                columns += [term, tf, pa.array(size)]
            if text:
                names.append("holds")
                columns.append(pa.array([match(t) for t in b.column(text).to_pylist()], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names)

    return cut(docs.select(*keep, *fields, *([text] if text else [])).mapInArrow(run, schema))


def slices(batches, block: Block, value):
    """(first row, batch slice, table of scores by query and document) of documents few enough for CELLS scores.

    value(batch slice, document, field's arrays) gives each posting's part through postings()."""
    step = max(1, CELLS // max(1, len(block.ids)))
    for b in batches:
        for low in range(0, b.num_rows, step):
            part = b.slice(low, step)
            yield part, value(part)


def postings(part: pa.RecordBatch, field: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, term, tf of each posting, length of each document) of a slice."""
    lists = part.column(f"{field}_term")
    n = np.diff(lists.offsets.to_numpy())
    flat = lambda c: part.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return np.repeat(np.arange(part.num_rows), n), flat(f"{field}_term"), flat(f"{field}_tf"), part.column(f"{field}_len").to_numpy()


def summed(block: Block, n: int, document: np.ndarray, term: np.ndarray, part: np.ndarray) -> np.ndarray:
    """(queries, documents): the sums of parts of the terms that queries ask for."""
    at, query = block.expand(term)
    return np.bincount(query * n + document[at], weights=part[at], minlength=len(block.ids) * n).reshape(len(block.ids), n)


class Best:
    """The k best (score, then smaller id) of every query over what a task reads."""

    def __init__(self, queries: int, k: int):
        self.k, self.rows = k, [[] for _ in range(queries)]
        self.least = np.full(queries, -np.inf)

    def add(self, scores: np.ndarray, ids: np.ndarray, *carried: np.ndarray):
        for q in np.flatnonzero((scores > 0).any(1)):
            row = scores[q]
            use = np.flatnonzero((row > 0) & (row >= self.least[q]))
            if len(use) > self.k:
                kth = np.partition(row[use], len(use) - self.k)[len(use) - self.k]
                use = use[row[use] >= kth]
            held = self.rows[q] + [(-row[i], int(ids[i]), *(c[i] for c in carried)) for i in use.tolist()]
            held.sort(key=lambda r: r[:2])
            self.rows[q] = held[: self.k]
            if len(held) >= self.k:
                self.least[q] = -self.rows[q][-1][0]


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query of what tasks kept, with their rank from 1."""
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)
