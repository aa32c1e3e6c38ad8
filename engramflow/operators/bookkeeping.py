"""Runs, tasks, traces, and exact revisits as tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: States in which a task has ended.
ENDED = ("done", "failed", "skipped", "interrupted")
_REWRITES = (re.compile(r"^(?:please )?(?:shorten|summari[sz]e) (?:the|your) (?:last |previous )?answer(?: to (\d{1,3}) (words|sentences))?\.?$", re.I), re.compile(r"^(?:please )?(?:translate|rewrite) (?:the|your) (?:last |previous )?answer (?:in|into) ([A-Za-z]{3,20})\.?$", re.I))


def task_states(events: DataFrame) -> DataFrame:
    """events: run, task, seq, stage, status, at -> the last state of each task, retries, and seconds from first to last event."""
    seconds = (F.max("at").cast("timestamp").cast("double") - F.min("at").cast("timestamp").cast("double")).alias("seconds")
    return events.groupBy("run", "task").agg(F.max_by("stage", "seq").alias("stage"), F.max_by("status", "seq").alias("status"), F.count(F.when(F.col("status") == "retry", 1)).alias("retries"), seconds, F.max("seq").alias("seq"))


def recover(states: DataFrame, leases: DataFrame, as_of: str) -> DataFrame:
    """Tasks of runs (leases: run, expires_at) whose lease is over at as_of and that haven't ended become interrupted; a run without a lease counts as over."""
    j = states.join(leases.select("run", "expires_at"), "run", "left")
    over = F.col("expires_at").isNull() | (F.col("expires_at") <= F.lit(as_of).cast("timestamp"))
    return j.withColumn("status", F.when(over & ~F.col("status").isin(*ENDED), "interrupted").otherwise(F.col("status"))).drop("expires_at")


def run_states(states: DataFrame) -> DataFrame:
    """run, status: running while a task is, else failed or interrupted if one is, else done."""
    has = lambda *s: F.bool_or(F.col("status").isin(*s))
    return states.groupBy("run").agg(F.when(F.bool_or(~F.col("status").isin(*ENDED)), "running").when(has("failed"), "failed").when(has("interrupted"), "interrupted").otherwise("done").alias("status"))


def validate_trace(events: DataFrame) -> DataFrame:
    """events: run, event_id, parent_id, seq, kind -> run, status: broken if a parent is missing or not earlier, or an id repeats; complete if its last event is finalised; else
    incomplete."""
    parents = events.select("run", F.col("event_id").alias("parent_id"), F.col("seq").alias("_p"))
    j = events.join(parents.groupBy("run", "parent_id").agg(F.min("_p").alias("_p")), ["run", "parent_id"], "left")
    bad = F.col("parent_id").isNotNull() & (F.col("_p").isNull() | (F.col("_p") >= F.col("seq")))
    per = j.groupBy("run").agg(F.coalesce(F.bool_or(bad), F.lit(False)).alias("bad"), (F.count_distinct("event_id") < F.count("event_id")).alias("twice"), F.max_by("kind", "seq").alias("last"))
    return per.select("run", F.when(F.col("bad") | F.col("twice"), "broken").when(F.col("last") == "finalised", "complete").otherwise("incomplete").alias("status"))


def revisit_fingerprint(*columns: Column) -> Column:
    """A digest of context, requirements, budget, anchors, source closure, roles and policy, in the order given; null differs from empty."""
    return F.sha2(F.concat_ws("\u001f", *[F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-")) for c in columns]), 256)


def parse_rewrite(text: str | None) -> dict | None:
    """The two restricted rewrites: shorten to a number of words or sentences, translate into a language; None for all else."""
    text = " ".join((text or "").split())
    if m := _REWRITES[0].match(text):
        return {"kind": "shorten", "limit": int(m[1]) if m[1] else None, "unit": m[2].lower() if m[2] else None}
    if m := _REWRITES[1].match(text):
        return {"kind": "translate", "language": m[1].lower()}
    return None


def restore(edges: DataFrame, snapshot: DataFrame, ids: DataFrame) -> DataFrame:
    """edges with the given ids set back to the snapshot: changed ones to their rows there, created ones gone, deleted ones there again."""
    return edges.join(ids, "association_id", "left_anti").unionByName(snapshot.join(ids, "association_id", "left_semi").select(*edges.columns))
