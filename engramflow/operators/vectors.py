"""Exact dense retrieval. Vectors are array<float>; arithmetic is in double; ties go to the smaller id."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cutting import stored

#: Query vectors that are broadcast, or in one pack: this times the dimension times eight bytes.
QUERY_BLOCK = 4096
#: Scores in a task's table of queries by vectors.
CELLS = 1 << 21
#: Parts in which the packs of one value of by are dealt out.
DEALT = 16
#: Pairs of packs that a task gets, about.
PAIRS = 4


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def normalise(df: DataFrame, column: str, out: str = "v") -> DataFrame:
    """Adds the unit vector; rows whose vector is null, not finite or zero are left out."""
    e = F.col(column).cast("array<double>")
    bad = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    norm = F.sqrt(dot(F.col("_e"), F.col("_e")))
    return df.withColumn("_e", e).where(F.col("_e").isNotNull() & ~bad).withColumn("_n", norm).where("_n > 0").withColumn(out, F.transform("_e", lambda x: x / F.col("_n"))).drop("_e", "_n")


def rejected(df: DataFrame, column: str) -> DataFrame:
    """Vectors that normalise() leaves out, with the reason."""
    e = F.col(column).cast("array<double>")
    reason = F.when(F.col(column).isNull(), "missing").when(F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), "not_finite").when(F.sqrt(dot(e, e)) == 0, "zero")
    return df.withColumn("reason", reason).where("reason IS NOT NULL")


_HITS = "query_id long, id long, score double"


class _Best:
    """The k best rows of each query of a block, merged batch by batch; k 0: all."""

    def __init__(self, queries: int, k: int, floor: float):
        self.k, self.floor = k, floor
        self.ids, self.scores = [np.zeros(0, np.int64)] * queries, [np.zeros(0)] * queries
        self.least = np.full(queries, floor)

    def add(self, scores: np.ndarray, ids: np.ndarray):
        for i in np.flatnonzero(((scores > -np.inf) & (scores >= self.least[:, None])).any(1)).tolist():
            row = scores[i]
            use = np.flatnonzero((row > -np.inf) & (row >= self.least[i]))
            if self.k and len(use) > self.k:
                kth = np.partition(row[use], len(use) - self.k)[len(use) - self.k]
                use = use[row[use] >= kth]
            all_ids, all_scores = np.concatenate([self.ids[i], ids[use]]), np.concatenate([self.scores[i], row[use]])
            order = np.lexsort((all_ids, -all_scores))
            order = order[: self.k] if self.k else order
            self.ids[i], self.scores[i] = all_ids[order], all_scores[order]
            if self.k and len(order) == self.k:
                self.least[i] = max(self.floor, all_scores[order[-1]])

    def meet(self, q: np.ndarray, query_ids: np.ndarray | None, v: np.ndarray, ids: np.ndarray, same: tuple[np.ndarray, np.ndarray] | None = None):
        """Vectors against the block in slices of CELLS scores. query_ids: a query's own id doesn't count; same: codes of queries and vectors that have to be equal."""
        step = max(1, CELLS // max(1, len(q)))
        for low in range(0, len(ids), step):
            own = ids[low : low + step]
            scores = np.round(q @ v[low : low + step].T, 12)  # products of equal vectors differ by their place in a slice; they shall tie
            if same is not None:
                scores[same[0][:, None] != same[1][None, low : low + step]] = -np.inf
            if query_ids is not None:
                scores[query_ids[:, None] == own[None, :]] = -np.inf
            self.add(scores, own)

    def rows(self, query_ids: np.ndarray):
        sizes = [len(x) for x in self.ids]
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(query_ids, sizes)), pa.array(np.concatenate([np.zeros(0, np.int64), *self.ids])), pa.array(np.concatenate([np.zeros(0), *self.scores]))], ["query_id", "id", "score"])


def _matrix(column) -> np.ndarray:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(lists), -1)


def _packed(rows: DataFrame, names: tuple[str, ...], by: str | None, prefix: str, size: int) -> DataFrame:
    """rows in packs of at most size vectors (of one value of by): ids and vectors as bytes. No shuffle: a task packs what it reads."""
    kinds = dict(rows.dtypes)
    schema = f"{prefix}ids binary, {prefix}v binary" + (f", key {kinds[by]}" if by else "")

    def run(batches):
        held: dict = {}
        kind = None

        def pack(key):
            ids, vs = held.pop(key)
            columns = [pa.array([np.array(ids, np.int64).tobytes()], pa.binary()), pa.array([np.concatenate(vs).tobytes()], pa.binary())]
            return pa.RecordBatch.from_arrays(columns + ([pa.array([key], kind)] if by else []), [f"{prefix}ids", f"{prefix}v"] + (["key"] if by else []))

        for b in batches:
            ids, v = b.column(0).to_pylist(), _matrix(b.column(1)) if b.num_rows else None
            keys, kind = (b.column(2).to_pylist(), b.column(2).type) if by else ([None] * len(ids), None)
            for i, key in enumerate(keys):
                own = held.setdefault(key, ([], []))
                own[0].append(ids[i])
                own[1].append(v[i])
                if len(own[0]) == size:
                    yield pack(key)
        for key in list(held):
            yield pack(key)

    return rows.select(*names, *([by] if by else [])).mapInArrow(run, schema)


def _by_packs(index: DataFrame, queries: DataFrame, k: int, by: str | None, floor: float, skip_self: bool) -> DataFrame:
    """Packs of queries against packs of the index, each pair of packs in one call; with by, only packs of one value meet. Packs are stored, so that vectors are
    worked out once and not for each pair, and pairs are dealt into tasks by their number: a batch counts rows, not bytes."""
    asked, held = stored(_packed(queries, ("query_id", "v"), by, "q", QUERY_BLOCK)), stored(_packed(index, ("id", "v"), by, "i", QUERY_BLOCK))

    def run(batches):
        for b in batches:
            for row in range(b.num_rows):
                qi, qv, ii, iv = (np.frombuffer(b.column(c)[row].as_buffer(), t) for c, t in ((0, np.int64), (1, np.float64), (2, np.int64), (3, np.float64)))
                best = _Best(len(qi), k, floor)
                best.meet(qv.reshape(len(qi), -1), qi if skip_self else None, iv.reshape(len(ii), -1), ii)
                yield best.rows(qi)

    if by:  # a value that very many vectors have is dealt out over tasks, its queries go to all of them
        asked = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(DEALT - 1))))
        both = held.withColumn("part", F.pmod(F.xxhash64("iids"), F.lit(DEALT)).cast("int")).join(asked, ["key", "part"])
    else:
        both = held.crossJoin(asked)
    if by:
        n = lambda df, name: df.groupBy("key").agg(F.count(F.lit(1)).alias(name))
        pairs = n(held, "n").join(n(asked.where("part = 0"), "m"), "key").agg(F.coalesce(F.sum(F.col("n") * F.col("m")), F.lit(0))).first()[0]
    else:
        pairs = held.count() * asked.count()
    both = both.select("qids", "qv", "iids", "iv").repartition(max(1, math.ceil(pairs / PAIRS)), F.xxhash64("qids", "iids"))
    return both.mapInArrow(run, _HITS)


def search_many(index: DataFrame, queries: DataFrame, k: int, by: str | None = None, floor: float | None = None, skip_self: bool = False) -> DataFrame:
    """index: id, v (and by); queries: query_id, v (and by) -> query_id, id, score, rank (from 1).

    Up to QUERY_BLOCK query vectors are broadcast: every task multiplies its rows with the block and keeps its own k best for each query.
    More queries go in packs, and packs of queries meet packs of the index (of their value of by, if there is one), so nothing of the queries
    comes to the driver. Either way only k rows of a query and task meet in the final ranking. floor: the least score, asked where the score is
    worked out. k of 0 or less gives nothing."""
    spark = index.sparkSession
    columns = ["id", "v", *([by] if by else [])]
    if k <= 0:
        return spark.createDataFrame([], _HITS).withColumn("rank", F.lit(0))
    least = -np.inf if floor is None else floor
    block = queries.select("query_id", "v", *([by] if by else [])).limit(QUERY_BLOCK + 1).collect()
    if len(block) > QUERY_BLOCK:
        found = _by_packs(index, queries, k, by, least, skip_self)
    elif not block:
        found = spark.createDataFrame([], _HITS)
    else:
        codes = {key: n for n, key in enumerate(dict.fromkeys(r[by] for r in block if r[by] is not None))} if by else None
        keys = np.array([codes.get(r[by], -2) for r in block]) if by else None
        sent = spark.sparkContext.broadcast((np.array([r.query_id for r in block], np.int64), np.array([r.v for r in block], np.float64), codes, keys))

        def local(batches):
            ids, q, codes, keys = sent.value
            best = _Best(len(ids), k, least)
            for b in batches:
                if not b.num_rows:
                    continue
                same = None if keys is None else (keys, np.array([codes.get(x, -1) for x in b.column(2).to_pylist()]))
                best.meet(q, ids if skip_self else None, _matrix(b.column(1)), b.column(0).to_numpy(zero_copy_only=False), same)
            yield best.rows(ids)

        found = index.select(*columns).mapInArrow(local, _HITS)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def activation_seeds(hits: DataFrame) -> DataFrame:
    """hits: root, id, score -> root, id, activation: clipped to [0, 1], positive, the largest of each (root, id)."""
    return hits.groupBy("root", "id").agg(F.max(F.greatest(F.lit(0.0), F.least(F.lit(1.0), "score"))).alias("activation")).where("activation > 0")


def prototype_scores(wanted: DataFrame, vectors: DataFrame, query: DataFrame) -> DataFrame:
    """wanted: id, query_id; vectors: id, v; query: query_id, v -> score of every wanted pair, null where there is no vector."""
    q = query.select("query_id", F.col("v").alias("_q"))
    return wanted.join(vectors.select("id", "v"), "id", "left").join(q, "query_id", "left").select("query_id", "id", dot(F.col("v"), F.col("_q")).alias("score"), F.col("v").isNull().alias("missing"))


def upsert(index: DataFrame, rows: DataFrame, removed: DataFrame | None = None) -> DataFrame:
    """A new index: rows replace those with their ids, removed ids go."""
    kept = index.join(rows.select("id"), "id", "left_anti")
    out = kept.unionByName(rows)
    return out.join(removed.select("id"), "id", "left_anti") if removed is not None else out


def rank_fusion(channels: DataFrame, k: int = 60) -> DataFrame:
    """channels: id, weight, rank -> id, score: the sum of weight / (k + rank)."""
    return channels.groupBy("id").agg(F.sum(F.col("weight") / (k + F.col("rank"))).alias("score"))
