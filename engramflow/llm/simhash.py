r"""SimHash near-duplicates found through Golay-code fuzzy hashing.

Fingerprint: texts are lower-cased in A-Z, words are ``[^\x20\x09-\x0D]+``, shingles are ``width`` words
joined by one space, repeats included (fewer words: the whole sequence). A bit of the fingerprint is 1
if it is set in over half the shingles' XXH64 (seed 42); no words give fingerprint zero.

Search: the 64 bits are cut into three segments. Of at most two differing bits, some segment has none
and the segment after it one at most (pigeonhole). A segment of up to 23 bits is read as a
word of the perfect binary Golay code: the codewords within distance 4 of it number one or six, and two words
that differ in one bit share one of them (the nearest to either is within 3 + 1 of the other). So (segment,
index of a codeword near the next segment) for three segments gives 3 to 18 keys a
fingerprint, and all linked pairs meet in a key. Fingerprints that meet are verified by their distance.

Scale: the search runs over distinct fingerprints, so exact copies cost one row. Buckets of up to
``BUCKET`` fingerprints are searched in one place and give a spanning forest of their links, not all pairs. The
members of larger buckets are linked exactly by other keys: every fingerprint is sent to itself and to its 64
one-bit neighbours; two fingerprints differ in at most two bits if and only if they meet in one of those
points, where at most 65 can meet. Nothing is dropped and no group is gathered without a bound.

Edge cases: null text counts as empty; null ids are kept and never become a component's name unless
all ids of the component are null; repeated rows are linked like others; empty tables give empty results;
other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, pick, table
from .components import components

WIDTH, SEED, DISTANCE, BUCKET = 3, 42, 2, 1024
#: (lowest bit, bits) of the segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Generator polynomial of the binary Golay code of length 23: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GOLAY = 0b110001110101


def _remainder(word: int) -> int:
    for bit in range(22, 10, -1):
        if word >> bit & 1:
            word ^= GOLAY << (bit - 11)
    return word


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of each byte at its place; error patterns of weight 4 at most by syndrome; their numbers."""
    syndrome = np.zeros((3, 256), np.int64)
    for place in range(3):
        for byte in range(256):
            word = byte << (8 * place)
            syndrome[place, byte] = _remainder(word & 0x7FFFFF)
    patterns: list[list[int]] = [[] for _ in range(2048)]
    bits = [_remainder(1 << b) for b in range(23)]
    for weight in range(5):
        for chosen in combinations(range(23), weight):
            s = 0
            for b in chosen:
                s ^= bits[b]
            patterns[s].append(sum(1 << b for b in chosen))
    many = np.array([len(p) for p in patterns])
    table_ = np.array([p + [p[0]] * (6 - len(p)) for p in patterns], np.int64)
    return syndrome, table_, many


_CODE: list = []


def near_codewords(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n, 6) message indices (12 bits) of the codewords within distance 4, and how many of the six count."""
    if not _CODE:
        _CODE.extend(_tables())
    syndrome, patterns, many = _CODE
    s = syndrome[0, words & 255] ^ syndrome[1, words >> 8 & 255] ^ syndrome[2, words >> 16 & 255]
    return (words[:, None] ^ patterns[s]) >> 11, many[s]


def keys_of(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows (position in prints, key) of all fingerprints (uint64)."""
    parts = [((prints >> np.uint64(low)) & np.uint64((1 << n) - 1)).astype(np.int64) for low, n in SEGMENTS]
    at, keys = [], []
    for k in range(3):
        index, many = near_codewords(parts[(k + 1) % 3])
        used = np.arange(6)[None, :] < many[:, None]
        at.append(np.nonzero(used)[0])
        keys.append(((np.int64(k) << 40) | (parts[k][:, None] << 12) | index)[used])
    return np.concatenate(at), np.concatenate(keys)


def fingerprint(text: bytes | None, width: int = WIDTH) -> int:
    """The 64-bit fingerprint of a UTF-8 text."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words)] if len(words) < width else list(map(b" ".join, zip(*[words[i:] for i in range(width)])))
    digest = xxhash.xxh64_intdigest
    total = np.zeros(64, np.int64)
    for low in range(0, len(shingles), 65536):
        part = shingles[low : low + 65536]
        hashes = np.fromiter([digest(s, SEED) for s in part], "<u8", len(part))
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > len(shingles), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, h (a hash of the text), fp (the fingerprint's 64 bits as a signed long)."""

    def run(batches):
        for b in batches:
            fps = np.fromiter((fingerprint(t.as_py(), width) for t in b.column(2)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps.view(np.int64))], ["doc_id", "h", "fp"])

    d = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), F.col("text").cast("binary").alias("text"))
    return d.mapInArrow(run, "doc_id long, h long, fp long")


def forest(prints: np.ndarray, distance: int = DISTANCE) -> list[tuple[int, int]]:
    """A spanning forest, as pairs of positions, of the links among a bucket's fingerprints."""
    left, links = np.arange(1, len(prints)), []
    queue = [0]
    while len(left) or queue:
        if not queue:
            queue, left = [int(left[0])], left[1:]
            continue
        at = queue.pop()
        near = np.bitwise_count(prints[left] ^ prints[at]) <= distance
        if near.any():
            found = left[near].tolist()
            links += [(at, x) for x in found]
            queue += found
            left = left[~near]
    return links


def links(prints: DataFrame) -> DataFrame:
    """prints: fp (long, distinct) -> u, v: links at distance 2 or less that connect all that are linked."""

    def explode(batches):
        for b in batches:
            fps = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            at, keys = keys_of(fps.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fps[at])], ["key", "fp"])

    def verify(batches):
        for b in batches:
            u, v = [], []
            for members in b.column(0):
                fps = np.array(members.as_py(), np.int64)
                for x, y in forest(fps.view(np.uint64)):
                    u.append(int(fps[x]))
                    v.append(int(fps[y]))
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    keys = prints.select("fp").mapInArrow(explode, "key long, fp long")
    sized = cut(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    small = keys.join(sized.where(F.col("n") <= BUCKET), "key").groupBy("key").agg(F.collect_list("fp").alias("fps"))
    found = small.select("fps").mapInArrow(verify, "u long, v long")
    crowded = keys.join(sized.where(F.col("n") > BUCKET), "key").select("fp").distinct()
    points = crowded.select("fp", F.explode(F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.shiftleft(F.lit(1).cast("long"), b)) for b in range(64)])).alias("point"))
    stars = points.groupBy("point").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    stars = stars.select(F.array_min("fps").alias("u"), F.explode("fps").alias("v")).where("u != v")
    return found.unionByName(stars).distinct()


def _components(prints: DataFrame) -> DataFrame:
    """fp, component (one of the fingerprints that links reach)."""
    groups = cut(prints.select("fp").distinct())
    return groups.join(components(links(groups)).withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("component", "fp").alias("component"))


def near_duplicates(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, fingerprint (hex), component_id (the smallest doc_id that links reach), one row per document."""
    prints = cut(fingerprints(docs, width))
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    named = cut(_components(prints).join(least, "fp"))
    named = named.join(named.groupBy("component").agg(F.min("least").alias("component_id")), "component").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """One row of docs of each component: the smallest id's (null ids come last), then the smallest hash of the text. Rows are judged by their own
    fingerprints, so rows of one id with different texts have a component each."""
    names = docs.columns
    prints = cut(fingerprints(docs, width))
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("h"))
    kept = prints.join(_components(prints), "fp").groupBy("component").agg(F.min_by(F.struct("doc_id", "h"), order).alias("row")).select(F.col("row.doc_id").alias("_id"), F.col("row.h").alias("_h"))
    safe = docs.toDF(*[f"_d{i}" for i in range(len(names))])
    at, text = f"_d{names.index('doc_id')}", f"_d{names.index('text')}"
    safe = safe.withColumn("_t", F.xxhash64(text))
    return safe.join(kept, F.col(at).cast("long").eqNullSafe(F.col("_id")) & (F.col("_t") == F.col("_h")), "left_semi").dropDuplicates([at, "_t"]).drop("_t").toDF(*names)


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
