"""Approximate nearest neighbours by cosine over randomly rotated one-bit codes.

A vector is made a unit vector, less the mean of its block, made a unit vector o again and rotated at random. Its code is the signs of what results: the
corner ``ō`` of a cube nearest to it. Beside 1 bit a dimension the index keeps three numbers: the length of the residual, its product with the mean,
and ``s = <ō, o>``. For a query's residual q, ``<ō, q> / s`` estimates ``<o, q>`` without bias, with an error of at most
``EPSILON * sqrt(1 - s*s) / (s * sqrt(d - 1))`` but for rare rotations. The query's residual is rounded to ``PLANES`` bits a dimension, so
``<ō, q>`` is a weighted sum of bit counts of code & plane; rounding adds to the error bound.

1. Equal vectors are one class with its k + 1 smallest ids: others can't be among k nearest. Classes are dealt by hash to groups.
2. ``build``: blocks of a group's classes with packed codes, corrections and the original vectors, one row for each block. All are indexed; nothing is fitted on a sample.
3. ``search``: query vectors, packed as well, go to every group. A task holds the blocks of one group, of GROUP_BYTES at most, and streams the queries: it
   reranks the best estimates exactly, and then all whose estimate plus error bound reaches the worst of the best so far.
4. The groups' best meet by query class and join the queries.

Only the number of classes comes to the driver. Nothing is broadcast unless Spark finds it small.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components take no part, nor do null ids; repeated rows (same id and vector) count once; a
query's own row (same id and vector) is no candidate, another vector under its id is one; vectors of different lengths are not compared; ties go
to the smaller id; fewer than k candidates give fewer rows; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, pick, shuffle_parts, table, trim

#: Width of the error bound in standard deviations, and bits of a query's dimension.
EPSILON, PLANES, SEED = 3.0, 6, 12
#: Vectors of a block, of a group (a task's memory) and of a small input's groups, in bytes; query vectors of a pack.
BLOCK_BYTES, GROUP_BYTES, SMALL_GROUP, QUERIES = 2 << 20, 64 << 20, 1 << 20, 256
EVERY, NEAREST = 50, 5

PACKED = "g int, kind int, dim int, n int, payload array<binary>"
PACKED_ARROW = pa.schema([("g", pa.int32()), ("kind", pa.int32()), ("dim", pa.int32()), ("n", pa.int32()), ("payload", pa.list_(pa.binary()))])
FOUND = "h1 long, h2 long, entries array<struct<score:double,id:long,own:boolean>>"
FOUND_ARROW = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("entries", pa.list_(pa.struct([("score", pa.float64()), ("id", pa.int64()), ("own", pa.bool_())])))])


def usable(vectors: DataFrame, id_name: str, vector_name: str) -> DataFrame:
    """id, vector (array<double>), and its class as two hashes; only vectors that have a direction."""
    v = F.col("vector")
    fine = (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < math.inf)) & F.exists(v, lambda x: x != 0)
    named = pick(vectors, id_name, vector_name).toDF("id", "vector").select(F.col("id").cast("long"), v.cast("array<double>"))
    return named.where(F.col("id").isNotNull() & v.isNotNull() & fine).select("id", "vector", F.xxhash64("vector").alias("h1"), F.xxhash64(F.lit(SEED), "vector").alias("h2"))


def classes(rows: DataFrame, k: int) -> DataFrame:
    """h1, h2, vector, ids: the k + 1 smallest ids of each vector."""
    single = rows.groupBy("h1", "h2", "id").agg(F.first("vector").alias("vector"))
    ranked = single.withColumn("n", F.row_number().over(Window.partitionBy("h1", "h2").orderBy("id"))).where(F.col("n") <= k + 1)
    return ranked.groupBy("h1", "h2").agg(F.first("vector").alias("vector"), F.array_sort(F.collect_list("id")).alias("ids"))


def rotation(width: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((width, width)))
    return q * np.sign(np.diag(r))


def scaled(v: np.ndarray) -> np.ndarray:
    """Each row by a power of two, so that squares neither overflow nor vanish; cosines stay as they are."""
    return np.ldexp(v, -np.frexp(np.abs(v).max(axis=1, keepdims=True))[1])


def units(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(unit vectors, zeros added up to whole words of 64 bits; lengths)."""
    length = np.sqrt((v * v).sum(axis=1))
    return np.pad(v / length[:, None], ((0, 0), (0, -v.shape[1] % 64))), length


def encode(v: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, ...]:
    """(codes as words, [residual's length, its product with the mean, s, bits set] of each vector, mean)."""
    u, _ = units(v)
    mean = u.mean(axis=0)
    rest = u - mean
    size = np.sqrt((rest * rest).sum(axis=1))
    x = (rest / np.where(size > 0, size, 1)[:, None]) @ turn.T
    bits = x > 0
    s = np.abs(x).sum(axis=1) / math.sqrt(x.shape[1])
    codes = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)
    return codes, np.stack([size, rest @ mean, np.where(s > 0, s, 1), bits.sum(axis=1)]).astype(np.float64), mean


class Coded:
    """A block of the index: codes, corrections, originals."""

    def __init__(self, payload: list[bytes], n: int, dim: int):
        self.vectors = np.frombuffer(payload[0]).reshape(n, dim)
        self.hashes = np.frombuffer(payload[1], np.int64).reshape(n, 2)
        self.counts, self.ids = np.frombuffer(payload[2], np.int64), np.frombuffer(payload[3], np.int64)
        self.codes = np.frombuffer(payload[4], np.uint64).reshape(n, -1)
        self.size, self.centred, self.s, self.ones = np.frombuffer(payload[5]).reshape(4, n)
        self.mean = np.frombuffer(payload[6])
        self.lengths = np.sqrt((self.vectors * self.vectors).sum(axis=1))
        self.at = np.cumsum(self.counts) - self.counts
        d = 64 * self.codes.shape[1]
        self.slack = np.sqrt(np.maximum(0, 1 - self.s * self.s)) / math.sqrt(d - 1)

    def estimate(self, unit: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(estimated cosines of a unit vector with all, error bounds)."""
        d = len(unit)
        rest = unit - self.mean
        size = math.sqrt(rest @ rest)
        y = turn @ rest
        low = y.min()
        step = (y.max() - low) / ((1 << PLANES) - 1) or 1.0
        level = np.rint((y - low) / step).astype(np.int64)
        off = y - low - step * level
        planes = [np.packbits((level >> j & 1).astype(bool), bitorder="little").view(np.uint64) for j in range(PLANES)]
        shared = sum((np.bitwise_count(self.codes & plane).sum(axis=1, dtype=np.int32) << j for j, plane in enumerate(planes)), np.int32(0))
        product = (2 * (low * self.ones + step * shared) - (low * d + step * level.sum())) / math.sqrt(d)
        bound = EPSILON * self.size / self.s * (size * self.slack + math.sqrt(off @ off / d))
        return self.size * product / self.s + self.centred + self.mean @ unit, bound

    def exact(self, at: np.ndarray, vector: np.ndarray, length: float) -> np.ndarray:
        return (self.vectors[at] * vector).sum(axis=1) / (self.lengths[at] * length)


def _best(entries: list[tuple], keep: int) -> list[tuple]:
    return sorted(set(entries), key=lambda e: (-e[0], e[1]))[:keep]


def nearest(blocks: list[Coded], vectors: np.ndarray, hashes: np.ndarray, turn: np.ndarray, keep: int) -> list[list[tuple]]:
    """For each query vector, its keep best (score, id, own: of the query's class)."""
    unit, length = units(vectors)
    out = []
    for i in range(len(vectors)):
        best: list[tuple] = []
        for block in blocks:
            guess, bound = block.estimate(unit[i], turn)
            first = np.argpartition(-guess, min(2 * keep, len(guess) - 1))[: 2 * keep]
            for again in (False, True):
                floor = best[-1][0] if len(best) == keep else -math.inf
                if again:
                    ahead = guess + bound >= floor - 1e-9
                    ahead[first] = False
                    first = np.flatnonzero(ahead)
                scores = block.exact(first, vectors[i], length[i])
                worst = max(floor, np.partition(scores, -keep)[-keep]) if len(scores) > keep else floor
                for j, score in zip(first[scores >= worst].tolist(), scores[scores >= worst].tolist()):
                    own = bool((block.hashes[j] == hashes[i]).all())
                    best += [(score, x, own) for x in block.ids[block.at[j] : block.at[j] + block.counts[j]].tolist()]
                best = _best(best, keep)
        out.append(best)
    return out


def _record(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _packs(kind: int, full):
    """A function for mapInArrow over (g, h1, h2, vector, ids) that makes rows of PACKED, each of one group and one dimension and at most full(dim) vectors."""

    def close(g: int, dim: int, rows: list[tuple]) -> pa.RecordBatch:
        v = scaled(np.array([r[0] for r in rows], np.float64))
        hashes = np.array([r[1:3] for r in rows], np.int64)
        payload = [v.tobytes(), hashes.tobytes()]
        if kind == 0:
            codes, numbers, mean = encode(v, rotation(v.shape[1] + -v.shape[1] % 64))
            payload += [np.array([len(r[3]) for r in rows], np.int64).tobytes(), np.array([x for r in rows for x in r[3]], np.int64).tobytes(), codes.tobytes(), numbers.tobytes(), mean.tobytes()]
        return _record([(g, kind, dim, len(rows), payload)], PACKED_ARROW)

    def run(batches):
        held: dict[tuple[int, int], list[tuple]] = {}
        for batch in batches:
            for g, h1, h2, vector, ids in zip(*[batch.column(i).to_pylist() if i != 3 else batch.column(i) for i in range(5)]):
                v = vector.values.to_numpy(zero_copy_only=False)
                for key in [key for key in held if key[0] != g]:  # sorted by group
                    yield close(*key, held.pop(key))
                rows = held.setdefault((g, len(v)), [])
                rows.append((v, h1, h2, ids))
                if len(rows) >= full(len(v)):
                    yield close(g, len(v), held.pop((g, len(v))))
        for key, rows in held.items():
            yield close(*key, rows)
        trim()

    return run


def build(vectors: DataFrame, id_name: str, vector_name: str, k: int = NEAREST) -> tuple[DataFrame, int]:
    """(the index, one row for each block, in the shared folder; its number of groups). k: the most neighbours that searches will ask for."""
    spark = vectors.sparkSession
    found = cut(classes(usable(vectors, id_name, vector_name), k))
    n_bytes = 8 * (found.agg(F.sum(F.size("vector"))).first()[0] or 0)
    groups = max(1, -(-n_bytes // GROUP_BYTES), min(64, -(-n_bytes // SMALL_GROUP)))
    dealt = found.withColumn("g", F.pmod("h1", F.lit(groups)).cast("int")).select("g", "h1", "h2", "vector", "ids")
    dealt = dealt.repartition(max(shuffle_parts(spark), min(groups, 4096)), "g").sortWithinPartitions("g")
    return cut(dealt.mapInArrow(_packs(0, lambda dim: max(16, BLOCK_BYTES // (8 * dim))), PACKED)), groups


def search(index: DataFrame, groups: int, queries: DataFrame, id_name: str, vector_name: str, k: int = NEAREST) -> DataFrame:
    """query_id, rank from 1, vec_id, score (double): the k nearest of each query, itself left out."""
    keep = k + 1
    parts = max(shuffle_parts(index.sparkSession), min(groups, 4096))
    rows = usable(queries, id_name, vector_name)
    asked = rows.groupBy("h1", "h2").agg(F.first("vector").alias("vector")).select(F.lit(0).alias("g"), "h1", "h2", "vector", F.array().cast("array<long>").alias("ids"))
    packs = asked.mapInArrow(_packs(1, lambda dim: QUERIES), PACKED).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))

    def run(batches):
        group, blocks, turns = None, {}, {}
        for batch in batches:
            for g, kind, dim, n, payload in zip(*[batch.column(i).to_pylist() for i in range(4)], batch.column(4)):
                if g != group:
                    group, blocks = g, {}
                payload = payload.as_py()
                if kind == 0:
                    blocks.setdefault(dim, []).append(Coded(payload, n, dim))
                elif dim in blocks:
                    turn = turns[dim] if dim in turns else turns.setdefault(dim, rotation(dim + -dim % 64))
                    hashes = np.frombuffer(payload[1], np.int64).reshape(n, 2)
                    found = nearest(blocks[dim], np.frombuffer(payload[0]).reshape(n, dim), hashes, turn, keep)
                    yield _record([(int(h[0]), int(h[1]), [dict(zip(("score", "id", "own"), e)) for e in x]) for h, x in zip(hashes, found)], FOUND_ARROW)
        trim()

    met = index.unionByName(packs.select(*index.columns)).repartition(parts, "g").sortWithinPartitions("g", "kind")
    entries = met.mapInArrow(run, FOUND).select("h1", "h2", F.explode("entries").alias("e")).select("h1", "h2", "e.*")
    order = Window.partitionBy("h1", "h2").orderBy(F.desc("score"), "id")
    top = entries.withColumn("n", F.row_number().over(order)).where(F.col("n") <= keep).groupBy("h1", "h2").agg(F.array_sort(F.collect_list(F.struct("n", "score", "id", "own"))).alias("top"))
    ids = rows.select("id", "h1", "h2").distinct().join(top, ["h1", "h2"])
    others = F.slice(F.filter("top", lambda e: ~(e["own"] & (e["id"] == F.col("id")))), 1, k)
    placed = ids.select(F.col("id").alias("query_id"), F.posexplode(others).alias("p", "e"))
    return placed.select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("e.id").alias("vec_id"), "e.score")


def query(spark, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    index, groups = build(vectors, "vec_id", "embedding")
    return search(index, groups, vectors.where(F.col("vec_id") % EVERY == 0), "vec_id", "embedding")


def oracle() -> str:
    return f"""
    WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x != 0)) > 0),
    s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(c.e, c.e))) AS score
          FROM v q JOIN v c ON q.vec_id % {EVERY} = 0 AND q.vec_id != c.vec_id)
    SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
    FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= {NEAREST}"""
