"""Two-key contextual association matching."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def gate(similarity: Column, threshold: float) -> Column:
    """0 up to the threshold, then linear to 1; not finite: 0."""
    value = (similarity - threshold) / max(1e-6, 1 - threshold)
    good = similarity.isNotNull() & ~F.isnan(similarity) & (F.abs(similarity) < float("inf"))
    return F.when(good & (similarity > threshold), F.least(F.lit(1.0), F.greatest(F.lit(0.0), value))).otherwise(F.lit(0.0))


def combine(a: Column, b: Column, how: str) -> Column:
    if how == "product":
        return a * b
    if how == "minimum":
        return F.least(a, b)
    if how == "geomean":
        return F.sqrt(a * b)
    raise ValueError(how)


def match(proposals: DataFrame, mode: str = "cn", how: str = "geomean", context_threshold: float = 0.0, need_threshold: float = 0.0) -> DataFrame:
    """proposals: edge, slot, target, anchor, context_similarity, need_similarity, lifecycle, utility -> the same with key, score, place and reason.

    score = key * anchor / largest anchor * (.5 on probation, 1 if active, else 0) * utility clipped to [0, 1]; mode says which keys count: w none, c
    context, n need, cn both. All proposals are ranked before any cap; those that score nothing have the first reason that holds."""
    c, n = gate(F.col("context_similarity"), context_threshold), gate(F.col("need_similarity"), need_threshold)
    key = {"w": F.lit(1.0), "c": c, "n": n, "cn": combine(c, n, how)}[mode]
    life = F.when(F.col("lifecycle") == "active", 1.0).when(F.col("lifecycle") == "probation", 0.5).otherwise(0.0)
    use = F.greatest(F.lit(0.0), F.least(F.lit(1.0), "utility"))
    most = F.max("anchor").over(Window.partitionBy("slot"))
    scored = proposals.withColumn("key", key).withColumn("score", F.col("key") * F.when(most > 0, F.col("anchor") / most).otherwise(0.0) * life * use)
    reason = (
        F.when(life == 0, "lifecycle").when(use <= 0, "utility").when(F.lit("c" in mode) & (c <= 0), "context").when(F.lit("n" in mode) & (n <= 0), "need").when(F.col("score") <= 0, "anchor")
    )
    place = F.row_number().over(Window.partitionBy("slot").orderBy(F.desc("score"), F.desc("key"), F.desc("anchor"), "edge", "target"))
    return scored.withColumn("place", place).withColumn("reason", reason)


def select_targets(matched: DataFrame, support: DataFrame, floor: float, edge_top_k: int, endpoint_limit: int) -> DataFrame:
    """Proposals that score, times their target's support (target, support); at or above floor, the best of each (target, slot), and of a slot
    the min(edge_top_k, endpoint_limit) first."""
    value = matched.where("reason IS NULL").join(support, "target").withColumn("final", F.col("score") * F.col("support")).where(F.col("final") >= floor)
    one = value.withColumn("_r", F.row_number().over(Window.partitionBy("slot", "target").orderBy(F.desc("final"), "place"))).where("_r = 1")
    return one.withColumn("rank", F.row_number().over(Window.partitionBy("slot").orderBy(F.desc("final"), "place"))).where(F.col("rank") <= min(edge_top_k, endpoint_limit)).drop("_r")


#: Slots whose two vectors are broadcast at once.
SLOTS = 1024
#: Scores in a task's table of slots by edges.
CELLS = 1 << 18
_LIFE = {"active": 1.0, "probation": 0.5}
REASONS = ("lifecycle", "utility", "context", "need", "anchor")


def _gates(similarity: np.ndarray, threshold: float) -> np.ndarray:
    value = np.clip((similarity - threshold) / max(1e-6, 1 - threshold), 0.0, 1.0)
    return np.where(np.isfinite(similarity) & (similarity > threshold), value, 0.0)


class _Scorer:
    """Scores of a batch of edges against all slots of a block, as match() defines them."""

    def __init__(self, rows: list, most: float, mode: str, how: str, thresholds: tuple[float, float]):
        self.slots = np.array([r.slot for r in rows], np.int64)
        self.context, self.need = (np.array([r[c] for r in rows], np.float64) for c in ("context", "need"))
        self.most, self.mode, self.how, self.thresholds = most, mode, how, thresholds

    def __call__(self, b) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(keys, scores, numbers of the first reason that holds or -1) by slot and edge"""
        lists = b.column("v")
        v = lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)
        c, n = _gates(self.context @ v.T, self.thresholds[0]), _gates(self.need @ v.T, self.thresholds[1])
        both = {"product": lambda: c * n, "minimum": lambda: np.minimum(c, n), "geomean": lambda: np.sqrt(c * n)}[self.how]
        key = {"w": lambda: np.ones_like(c), "c": lambda: c, "n": lambda: n, "cn": both}[self.mode]()
        life = np.array([_LIFE.get(x, 0.0) for x in b.column("lifecycle").to_pylist()])
        use = np.clip(b.column("utility").to_numpy(zero_copy_only=False).astype(np.float64), 0.0, 1.0)
        anchor = b.column("anchor").to_numpy(zero_copy_only=False).astype(np.float64)
        share = anchor / self.most if self.most > 0 else np.zeros_like(anchor)
        score = key * share * life * use
        reason = np.full(score.shape, -1, np.int8)
        for i, bad in reversed(list(enumerate((np.broadcast_to(life == 0, score.shape), np.broadcast_to(use <= 0, score.shape), (c <= 0) & ("c" in self.mode), (n <= 0) & ("n" in self.mode), score <= 0)))):
            reason[bad] = i
        return key, score, reason


def _slices(batches, slots: int):
    """Batches of edges in slices of at most CELLS scores: what a task holds doesn't grow with its batches."""
    step = max(1, CELLS // max(1, slots))
    for b in batches:
        for low in range(0, b.num_rows, step):
            yield b.slice(low, step)


def _blocks(edges: DataFrame, slots: DataFrame, mode: str, how: str, thresholds: tuple[float, float]):
    most = edges.agg(F.max("anchor")).first()[0] or 0.0
    held = []
    for row in slots.select("slot", "context", "need").toLocalIterator():
        held.append(row)
        if len(held) == SLOTS:
            yield _Scorer(held, most, mode, how, thresholds)
            held = []
    if held:
        yield _Scorer(held, most, mode, how, thresholds)


_FOUND = "slot long, edge long, target long, key double, anchor double, score double, final double"


def search(edges: DataFrame, slots: DataFrame, support: DataFrame, floor: float, edge_top_k: int, endpoint_limit: int, mode: str = "cn", how: str = "geomean", context_threshold: float = 0.0, need_threshold: float = 0.0) -> DataFrame:
    """edges: edge, target, anchor, lifecycle, utility, v (unit cue vector); slots: slot, context, need (unit vectors); support: target, support ->
    what select_targets(match(...)) gives when every edge is proposed to every slot: slot, edge, target, final, rank.

    Slots are broadcast in blocks; a task scores its edges where it reads them and keeps, of each slot, its best edge by target and the best
    min(edge_top_k, endpoint_limit) of those, so no proposal that fails a gate or a cap is ever shuffled."""
    spark, limit = edges.sparkSession, min(edge_top_k, endpoint_limit)
    held = edges.join(support.select("target", "support"), "target").select("edge", "target", "anchor", "lifecycle", "utility", "support", "v")
    found = spark.createDataFrame([], _FOUND)
    for scorer in _blocks(edges, slots, mode, how, (context_threshold, need_threshold)):
        sent = spark.sparkContext.broadcast(scorer)

        def run(batches, sent=sent):
            own = sent.value
            best: list[dict] = [{} for _ in own.slots]
            for b in _slices(batches, len(own.slots)):
                key, score, reason = own(b)
                final = score * b.column("support").to_numpy(zero_copy_only=False)
                edge, target, anchor = (b.column(c).to_numpy(zero_copy_only=False) for c in ("edge", "target", "anchor"))
                for q, at in zip(*np.nonzero((reason < 0) & (final >= floor))):
                    row = (-final[q, at], -score[q, at], -key[q, at], -anchor[at], int(edge[at]), int(target[at]))
                    old = best[q].get(row[5])
                    if old is None or row < old:
                        best[q][row[5]] = row
                for q, rows in enumerate(best):
                    if len(rows) > 8 * limit:
                        best[q] = {r[5]: r for r in sorted(rows.values())[:limit]}
            rows = [(int(own.slots[q]), e, t, -k, -a, -s, -f) for q, held_ in enumerate(best) for f, s, k, a, e, t in sorted(held_.values())[:limit]]
            columns = zip(*rows) if rows else ((),) * 7
            kinds = (pa.int64(),) * 3 + (pa.float64(),) * 4
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds)], ["slot", "edge", "target", "key", "anchor", "score", "final"])

        found = found.unionByName(held.mapInArrow(run, _FOUND))
    order = (F.desc("final"), F.desc("score"), F.desc("key"), F.desc("anchor"), "edge", "target")
    one = found.withColumn("_r", F.row_number().over(Window.partitionBy("slot", "target").orderBy(*order))).where("_r = 1")
    return one.withColumn("rank", F.row_number().over(Window.partitionBy("slot").orderBy(*order))).where(F.col("rank") <= limit).select("slot", "edge", "target", "final", "rank")


def rejections(edges: DataFrame, slots: DataFrame, mode: str = "cn", how: str = "geomean", context_threshold: float = 0.0, need_threshold: float = 0.0) -> DataFrame:
    """reason (kept for none), n of all proposals of edges to slots, counted where edges are read: a task gives one row a reason."""
    spark = edges.sparkSession
    found = spark.createDataFrame([], "reason string, n long")
    for scorer in _blocks(edges, slots, mode, how, (context_threshold, need_threshold)):
        sent = spark.sparkContext.broadcast(scorer)

        def run(batches, sent=sent):
            total = np.zeros(len(REASONS) + 1, np.int64)
            for b in _slices(batches, len(sent.value.slots)):
                total += np.bincount(sent.value(b)[2].reshape(-1) + 1, minlength=len(total))
            yield pa.RecordBatch.from_arrays([pa.array(["kept", *REASONS]), pa.array(total)], ["reason", "n"])

        found = found.unionByName(edges.select("edge", "anchor", "lifecycle", "utility", "v").mapInArrow(run, "reason string, n long"))
    return found.groupBy("reason").agg(F.sum("n").alias("n")).where("n > 0")


def proposal_key(*columns: str) -> Column:
    return F.sha2(F.concat_ws("\u001f", *[F.col(c).cast("string") for c in columns]), 256)
