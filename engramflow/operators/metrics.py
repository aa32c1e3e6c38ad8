"""Recall, stability and log metrics."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def nearest_rank(values: str, share: float) -> Column:
    """The value at Python's round((n - 1) * share), half to even, of the sorted values of a group."""
    ordered = F.array_sort(F.collect_list(values))
    return F.element_at(ordered, (F.bround((F.count(values) - 1) * share, 0) + 1).cast("int"))


def slot_recall(ranked: DataFrame, slots: DataFrame, k: int) -> DataFrame:
    """ranked: run, id, rank; slots: run, slot, id (any alternative satisfies) -> run, recall (share of slots with an id within k), first_ranks (worst slot's best rank;
    null if some slot has none)."""
    best = slots.join(ranked, ["run", "id"], "left").groupBy("run", "slot").agg(F.min("rank").alias("best"))
    hit = F.when(F.col("best") <= k, 1.0).otherwise(0.0)
    return best.groupBy("run").agg(F.avg(hit).alias("recall"), F.count(F.lit(1)).alias("slots"), F.when(F.count("best") == F.count(F.lit(1)), F.max("best")).alias("question_rank"))


def stability(runs: DataFrame) -> DataFrame:
    """runs: question, slot, repeat, hit, elapsed -> by (question, slot): rate, unstable (0 < rate < 1), elapsed mean and 95th percentile by nearest rank."""
    rate = F.avg(F.col("hit").cast("double"))
    return runs.groupBy("question", "slot").agg(rate.alias("rate"), ((rate > 0) & (rate < 1)).alias("unstable"), F.avg("elapsed").alias("mean_elapsed"), nearest_rank("elapsed", 0.95).alias("p95_elapsed"))


def request_outcomes(log: DataFrame) -> DataFrame:
    """log: request_id, seq, kind (request, response, error), stage, value -> one row a request with its last outcome, null if none."""
    asked = log.where("kind = 'request'").withColumn("_r", F.row_number().over(Window.partitionBy("request_id").orderBy(F.desc("seq")))).where("_r = 1").select("request_id", "stage", F.col("seq").alias("asked"))
    last = log.where("kind <> 'request'").groupBy("request_id").agg(F.max_by("kind", "seq").alias("outcome"), F.max_by("value", "seq").alias("value"))
    return asked.join(last, "request_id", "left")


def frozen_alignment(now: DataFrame, frozen: DataFrame) -> DataFrame:
    """id, text of two candidate lists -> counts of missing ids and changed texts."""
    j = frozen.select("id", F.col("text").alias("_f")).join(now.select("id", F.col("text").alias("_n"), F.lit(True).alias("_has")), "id", "left")
    return j.agg(F.count(F.lit(1)).alias("frozen"), F.count(F.when(F.col("_has").isNull(), 1)).alias("missing"), F.count(F.when(F.col("_has") & ~F.col("_f").eqNullSafe(F.col("_n")), 1)).alias("changed"))


def sign_test(wins: int, losses: int) -> float:
    """Two-sided exact sign test."""
    n = wins + losses
    if not n:
        return 1.0
    tail = sum(math.comb(n, k) for k in range(min(wins, losses) + 1)) / 2**n
    return min(1.0, 2 * tail)


def bootstrap_ci(pairs: DataFrame, draws: int = 20_000, seed: int = 7) -> DataFrame:
    """pairs: a, b -> mean difference with the 95 % interval of its bootstrap, and the sign test. Draws are dealt over tasks by Poisson weights of
    hashes: each pair counts in draw d as often as a Poisson(1) number of hash (pair, d) says."""
    import numpy as np
    import pandas as pd

    def run(batches):
        total, count = np.zeros(draws), np.zeros(draws)
        for pdf in batches:
            for key, x in zip(pdf["key"], pdf["d"]):
                w = np.random.default_rng([seed, int(key) & 0xFFFFFFFF]).poisson(1, draws)
                total += w * x
                count += w
        yield pd.DataFrame({"draw": range(draws), "t": total, "n": count})

    d = pairs.select((F.col("a") - F.col("b")).alias("d"), F.col("key"))
    sums = d.mapInPandas(run, "draw int, t double, n double").groupBy("draw").agg((F.sum("t") / F.sum("n")).alias("m"))
    ends = sums.agg(F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high"))
    base = d.agg(F.avg("d").alias("mean"), F.count(F.when(F.col("d") > 0, 1)).alias("wins"), F.count(F.when(F.col("d") < 0, 1)).alias("losses"))
    return base.join(F.broadcast(ends))
