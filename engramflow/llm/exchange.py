"""Blocks of whole documents that ask key-ranged buckets about their keys.

Substring operators compare every window of every text with all others. Instead of sending windows about,
documents are dealt once into blocks of some BLOCK_BYTES of text. A block sends each bucket the sorted keys it has there,
packed (differences, byte planes, zstd: one to three bytes a key), and gets a packed answer for the same
list back, so positions never travel. A block that is asked again derives the same list again.

The blocks are one shuffle of the text, packed by zstd, which all passes of a query read (Spark reuses the exchange).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, shuffle_parts

#: Text of a block, and keys that a bucket receives, about, for inputs up to SMALL bytes; both grow with the root of larger inputs (see wider()).
BLOCK_BYTES, BUCKET_KEYS, SMALL = 4 << 20, 4 << 20, 30 << 30
#: Text that a task holds before it packs it.
PIECE_BYTES = 32 << 20
MESSAGE = "bucket int, block int, kind int, payload binary"
ANSWER = "block int, kind int, bucket int, payload binary"


def wider(n_bytes: int) -> float:
    """How much larger blocks and buckets are than for a small input. The root keeps the number of messages, blocks times buckets, in proportion to the
    input; memory of a task grows with it (a factor of 58 from 30 GB to 100 TB)."""
    return max(1.0, math.sqrt(n_bytes / SMALL))


def pack(values: np.ndarray) -> bytes:
    width = values.dtype.itemsize
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(-1, width).T if len(values) else np.zeros(0, np.uint8)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(data: bytes, dtype) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(width, -1).T).view(dtype).reshape(-1)


def pack_sorted(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=keys.dtype.type(0)))


def unpack_sorted(data: bytes, dtype=np.uint64) -> np.ndarray:
    return np.cumsum(unpack(data, dtype), dtype=dtype)


def join_parts(parts: list[bytes]) -> bytes:
    return b"".join(len(p).to_bytes(8, "little") + p for p in parts)


def split_parts(data: bytes) -> list[bytes]:
    parts, at = [], 0
    while at < len(data):
        n = int.from_bytes(data[at : at + 8], "little")
        parts.append(data[at + 8 : at + 8 + n])
        at += 8 + n
    return parts


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def rolled(values: np.ndarray, n: int, base: int) -> np.ndarray:
    """Polynomial hashes modulo 2**64 of all runs of n values, by doubling."""
    total, have, part, size, left = None, 0, values, 1, n
    while left:
        if left & 1:
            if total is None:
                total, have = part, size
            else:
                m = len(values) - have - size + 1
                total = total[:m] * np.uint64(pow(base, size, 1 << 64)) + part[have : have + m]
                have += size
        left >>= 1
        if left:
            m = len(part) - size
            part = part[:m] * np.uint64(pow(base, size, 1 << 64)) + part[size:]
            size *= 2
    return total


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads them evenly (the finalizer of MurmurHash3)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Block:
    """The documents of one block, one after another in one buffer, ordered by id (null last), then text; the ids of null are 0 and marked."""

    def __init__(self, ids: np.ndarray, texts: list[bytes], null: np.ndarray | None = None):
        null = np.zeros(len(texts), bool) if null is None else null
        order = sorted(range(len(texts)), key=lambda i: (null[i], ids[i], texts[i]))
        self.texts = [texts[i] for i in order]
        self.ids, self.null = (ids[order], null[order]) if len(order) else (ids, null)
        self.sizes = np.array([len(t) for t in self.texts], np.int64)
        self.ends = np.cumsum(self.sizes)

    @classmethod
    def of(cls, rows: pa.Table) -> Block:
        """The block that packed pieces make up."""
        ids, null, texts = [np.zeros(0, np.int64)], [np.zeros(0, bool)], []
        for piece in rows.column("piece").to_pylist():
            own, none, sizes, data = split_parts(piece)
            ids.append(unpack(own, np.int64))
            null.append(unpack(none, np.uint8).astype(bool))
            data, at = zstandard.ZstdDecompressor().decompress(data), 0
            for n in unpack(sizes, np.int64).tolist():
                texts.append(data[at : at + n])
                at += n
        return cls(np.concatenate(ids), texts, np.concatenate(null))

    def out_ids(self) -> pa.Array:
        return pa.array(self.ids, mask=self.null)


def _packed(batches):
    """(block, piece): the documents of a task by block, packed whenever PIECE_BYTES of text have come together."""
    held: dict[int, tuple[list[int], list[bytes]]] = {}
    size = 0

    def flush():
        blocks, pieces = [], []
        for block, (ids, texts) in held.items():
            blocks.append(block)
            pieces.append(join_parts([pack(np.array([i or 0 for i in ids], np.int64)), pack(np.array([i is None for i in ids], np.uint8)), pack(np.array([len(t) for t in texts], np.int64)), zstandard.ZstdCompressor(level=1).compress(b"".join(texts))]))
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array(pieces, pa.binary())], ["block", "piece"])

    for b in batches:
        for block, i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
            ids, texts = held.setdefault(block, ([], []))
            ids.append(i)
            texts.append(t)
            size += len(t)
            if size >= PIECE_BYTES:
                yield flush()
                size = 0
    if held:
        yield flush()


def blocked(docs: DataFrame) -> tuple[DataFrame, int]:
    """(block and packed pieces of its documents, dealt by id and text, so rows of one id are spread; the bytes of all texts). Null text is empty."""
    d = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    n_bytes = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(n_bytes / BLOCK_BYTES / wider(n_bytes)))
    parts = shuffle_parts(docs.sparkSession)
    keyed = d.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int").alias("block"), "doc_id", "text")
    return keyed.mapInArrow(_packed, "block int, piece binary").repartition(max(parts, min(blocks, 4 * parts)), "block"), n_bytes


def ask(dealt: DataFrame, run) -> DataFrame:
    """Messages of all blocks; run(Block) yields (kind, bucket, payload)."""

    def send(rows: pa.Table) -> pa.Table:
        block = rows.column("block")[0].as_py()
        return _messages(block, list(run(Block.of(rows))))

    return dealt.groupBy("block").applyInArrow(send, MESSAGE)


def ask_again(dealt: DataFrame, answers: DataFrame, run) -> DataFrame:
    """Like ask; run(Block, answers) also gets {(kind, bucket): payload}."""

    def send(rows: pa.Table, found: pa.Table) -> pa.Table:
        block = rows.column("block")[0].as_py() if rows.num_rows else 0
        return _messages(block, list(run(Block.of(rows), _answers(found))) if rows.num_rows else [])

    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(send, MESSAGE)


def finish(dealt: DataFrame, answers: DataFrame, run, schema: str) -> DataFrame:
    """Rows of the result: run(Block, answers) gives a table."""
    def make(rows: pa.Table, found: pa.Table) -> pa.Table:
        return run(Block.of(rows), _answers(found))

    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(make, schema)


def answer(messages: DataFrame, run) -> DataFrame:
    """Answers of all buckets; run(kind, [payload]) gives a payload for each, in order."""

    def reply(rows: pa.Table) -> pa.Table:
        kind = rows.column("kind")[0].as_py()
        given = run(kind, rows.column("payload").to_pylist())
        return pa.table({"block": rows.column("block"), "kind": rows.column("kind"), "bucket": rows.column("bucket"), "payload": pa.array(given, pa.binary())})

    return messages.groupBy("kind", "bucket").applyInArrow(reply, ANSWER)


def _messages(block: int, sent: list[tuple]) -> pa.Table:
    kinds, buckets, payloads = zip(*sent) if sent else ((), (), ())
    return pa.table({"bucket": pa.array(buckets, pa.int32()), "block": pa.array([block] * len(sent), pa.int32()), "kind": pa.array(kinds, pa.int32()), "payload": pa.array(payloads, pa.binary())})


def _answers(found: pa.Table) -> dict:
    return {(k, b): p for k, b, p in zip(found.column("kind").to_pylist(), found.column("bucket").to_pylist(), found.column("payload").to_pylist())}


def bucketed(sorted_keys: np.ndarray, buckets: int):
    """(bucket, start, end) of ranges of equal width of the high 32 bits."""
    at = np.searchsorted(sorted_keys, (np.arange(buckets + 1, dtype=object) * (1 << 64) // buckets)[1:-1].astype(np.uint64))
    edges = [0, *at.tolist(), len(sorted_keys)]
    for b in range(buckets):
        if edges[b + 1] > edges[b]:
            yield b, edges[b], edges[b + 1]
