"""Runs and tasks read from the event table: a run is a user, a task a user's key."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bookkeeping as B
from .bindings import EDGES, edges
from .learning_queries import events
from .registry import query

_STATES = """s AS (SELECT user_id AS run, (props->>'$.k')::BIGINT AS task, arg_max(CASE event_type WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed' WHEN 'view' THEN 'retry' ELSE 'running' END, event_id) AS status,
    count(*) FILTER (WHERE event_type = 'view') AS retries FROM events GROUP BY ALL)"""


def states(spark, sf):
    status = F.when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "view", "retry").otherwise("running")
    return B.task_states(events(spark, sf).select(F.col("user_id").alias("run"), F.col("k").alias("task"), F.col("event_id").alias("seq"), F.lit("extract").alias("stage"), status.alias("status"), F.col("ts").alias("at")))


@query("task_states", f"WITH {_STATES} SELECT run, task, status, retries FROM s")
def task_states(spark, sf):
    return states(spark, sf).select("run", "task", "status", "retries")


@query("interrupted_runs", f"""WITH {_STATES}, r AS (SELECT run, CASE WHEN run % 2 = 0 AND status NOT IN ('done', 'failed') THEN 'interrupted' ELSE status END AS status FROM s)
    SELECT run, CASE WHEN bool_or(status NOT IN ('done', 'failed', 'interrupted')) THEN 'running' WHEN bool_or(status = 'failed') THEN 'failed' WHEN bool_or(status = 'interrupted') THEN 'interrupted' ELSE 'done' END AS status FROM r GROUP BY run""")
def interrupted_runs(spark, sf):
    """Runs of even users have a lease that is over."""
    s = states(spark, sf)
    leases = s.select("run").distinct().withColumn("expires_at", F.when(F.col("run") % 2 == 0, F.lit("2023-01-01")).otherwise(F.lit("2030-01-01")).cast("timestamp"))
    return B.run_states(B.recover(s, leases, "2024-06-01"))


@query("trace_validation", """SELECT user_id AS run, CASE WHEN user_id % 5 = 0 THEN 'broken' WHEN arg_max(event_type, event_id) = 'purchase' THEN 'complete' ELSE 'incomplete' END AS status FROM events GROUP BY user_id""")
def trace_validation(spark, sf):
    """Each event's parent is the user's event before it; every fifth user's first event names a parent that there isn't."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("event_id")
    before = F.lag("event_id").over(w)
    parent = F.when(before.isNull() & (F.col("user_id") % 5 == 0), F.lit(-1).cast("long")).otherwise(before)
    rows = events(spark, sf).select(F.col("user_id").alias("run"), "event_id", parent.alias("parent_id"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "purchase", "finalised").otherwise("step").alias("kind"))
    return B.validate_trace(rows)


@query("restored_edges", f"""WITH {EDGES} SELECT polarity, count(*) AS n, round(sum(CASE WHEN association_id % 2 = 0 THEN weight ELSE 0 END), 4) AS total FROM edges GROUP BY polarity""")
def restored_edges(spark, sf):
    """Weights of all edges were set to 0 and even ones deleted; even ids are restored from the snapshot."""
    snapshot = edges(spark, sf)
    now = snapshot.where("association_id % 2 <> 0").withColumn("weight", F.lit(0.0))
    out = B.restore(now, snapshot, snapshot.where("association_id % 2 = 0").select("association_id"))
    return out.groupBy("polarity").agg(F.count("*").alias("n"), F.round(F.sum("weight"), 4).alias("total"))


@query("revisit_fingerprints", f"""WITH {EDGES} SELECT association_id, sha256('=' || from_id || chr(31) || '=' || to_id || chr(31) || CASE WHEN polarity < 0 THEN '-' ELSE '=' || evidence_count END) AS fingerprint FROM edges""")
def revisit_fingerprints(spark, sf):
    e = edges(spark, sf)
    third = F.when(F.col("polarity") >= 0, F.col("evidence_count"))
    return e.select("association_id", B.revisit_fingerprint(F.col("from_id"), F.col("to_id"), third).alias("fingerprint"))
