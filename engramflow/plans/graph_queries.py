"""Graph queries: line items as associations between orders (episodes) and parts (concepts), orders of a customer in time."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators.cutting import shared_folder
from ..operators.resumable import ResumableSpreading
from .bindings import EDGES, TEMPORAL, edges, table, temporal
from .registry import query

#: Concepts are written as negative numbers where both kinds of node share a column.
_NODES = f"{EDGES}, g AS (SELECT association_id, from_id, -1 - to_id AS to_id, polarity, weight, confidence FROM edges)"
_WAYS = f"{_NODES}, ways AS (SELECT from_id AS node, to_id AS other, * FROM g UNION ALL SELECT to_id, from_id, * FROM g)"


def graph(spark, sf):
    return edges(spark, sf).withColumn("to_id", -1 - F.col("to_id")).drop("evidence_count")


@query("edge_stats", f"""WITH {EDGES} SELECT count(*) AS edges, count(*) FILTER (WHERE polarity < 0) AS negative, count(*) FILTER (WHERE weight >= 0.8) AS strong,
    count(*) FILTER (WHERE confidence < 0.95) AS doubtful, count(*) FILTER (WHERE evidence_count > 1) AS repeated, round(avg(weight), 6) AS mean_weight FROM edges""")
def edge_stats(spark, sf):
    """Conditional counts over edges."""
    n = lambda c: F.count(F.when(F.expr(c), 1))
    return edges(spark, sf).agg(F.count("*").alias("edges"), n("polarity < 0").alias("negative"), n("weight >= 0.8").alias("strong"), n("confidence < 0.95").alias("doubtful"), n("evidence_count > 1").alias("repeated"), F.round(F.avg("weight"), 6).alias("mean_weight"))


@query("neighbours_per_node", f"""WITH {_WAYS} SELECT node, rank::INT AS rank, association_id, other, round(weight, 6) AS weight FROM (
    SELECT *, row_number() OVER (PARTITION BY node ORDER BY weight DESC, confidence DESC, association_id) AS rank FROM ways) WHERE rank <= 5""")
def neighbours_per_node(spark, sf):
    g = graph(spark, sf)
    nodes = G.both_ways(g).select("node")
    return G.neighbours(g, nodes, 5).select("node", "rank", "association_id", "other", F.round("weight", 6).alias("weight"))


@query("concept_reach", f"""WITH {EDGES}, links AS (SELECT DISTINCT p_partkey AS concept, (p_partkey + 1) % (SELECT count(*) FROM part) AS other FROM part),
    sides AS (SELECT concept, other FROM links UNION SELECT other, concept FROM links),
    e AS (SELECT to_id AS concept, from_id AS episode FROM edges UNION ALL SELECT s.concept, from_id FROM sides s JOIN edges ON to_id = s.other)
    SELECT concept, count(DISTINCT episode) AS episodes FROM e GROUP BY concept""")
def concept_reach(spark, sf):
    """Distinct episodes of a concept, directly or by one neighbour concept (the next part)."""
    parts = table(spark, sf, "part")
    links = parts.crossJoin(F.broadcast(parts.agg(F.count("*").alias("n")))).select(F.col("p_partkey").alias("concept"), (F.col("p_partkey") + 1) % F.col("n"))
    return G.concept_reach(edges(spark, sf), links.toDF("concept", "other"))


@query("temporal_reachability", f"""WITH RECURSIVE {TEMPORAL}, first AS (SELECT scope, min(from_id) AS node FROM temporal GROUP BY scope),
    r(start, node) AS (SELECT node, to_id FROM first JOIN temporal ON from_id = node UNION SELECT r.start, t.to_id FROM r JOIN temporal t ON t.from_id = r.node)
    SELECT start, count(*) AS reached, min(node) AS least, max(node) AS most FROM r GROUP BY start""")
def temporal_reachability(spark, sf):
    """What before-edges reach from the order with the smallest key of each customer."""
    t = temporal(spark, sf)
    starts = t.groupBy("scope").agg(F.min("from_id").alias("node"))
    return G.reachable(t, starts, plain=0).groupBy("start").agg(F.count("*").alias("reached"), F.min("node").alias("least"), F.max("node").alias("most"))


@query("beam_traversal", f"""WITH {_WAYS}, seeds AS (SELECT o_orderkey % 50 AS root, o_orderkey AS node, o_totalprice / 500000 AS score FROM orders),
    b0 AS (SELECT root, node, max(greatest(0, score)) AS score FROM seeds GROUP BY ALL),
    f0 AS (SELECT * FROM b0 QUALIFY row_number() OVER (PARTITION BY root ORDER BY score DESC, node) <= 20),
    s0 AS (SELECT root, association_id, other, score * weight * confidence * (CASE WHEN polarity < 0 THEN 0.5 ELSE 1 END) * 0.85 AS s FROM (
        SELECT f0.root, f0.score, ways.* FROM f0 JOIN ways USING (node) QUALIFY row_number() OVER (PARTITION BY root, node ORDER BY weight DESC, confidence DESC, association_id) <= 40)),
    n1 AS (SELECT root, other AS node, max(s) AS score FROM s0 GROUP BY ALL),
    f1 AS (SELECT n1.* FROM n1 LEFT JOIN b0 USING (root, node) WHERE b0.score IS NULL OR n1.score > b0.score),
    b1 AS (SELECT root, node, score, 0 AS hops FROM b0 ANTI JOIN f1 USING (root, node) UNION ALL SELECT root, node, score, 1 FROM f1),
    t1 AS (SELECT * FROM f1 QUALIFY row_number() OVER (PARTITION BY root ORDER BY score DESC, node) <= 20),
    s1 AS (SELECT root, other, score * weight * confidence * (CASE WHEN polarity < 0 THEN 0.5 ELSE 1 END) * 0.85 * 0.85 AS s FROM (
        SELECT t1.root, t1.score, ways.* FROM t1 JOIN ways USING (node) QUALIFY row_number() OVER (PARTITION BY root, node ORDER BY weight DESC, confidence DESC, association_id) <= 40)),
    n2 AS (SELECT root, other AS node, max(s) AS score FROM s1 GROUP BY ALL),
    f2 AS (SELECT n2.* FROM n2 LEFT JOIN b1 USING (root, node) WHERE b1.score IS NULL OR n2.score > b1.score),
    b2 AS (SELECT root, node, score, hops FROM b1 ANTI JOIN f2 USING (root, node) UNION ALL SELECT root, node, score, 2 FROM f2)
    SELECT root, hops, count(*) AS nodes, round(sum(score), 4) AS total, round(max(score), 6) AS best FROM b2 GROUP BY ALL""")
def beam_traversal(spark, sf):
    """Two hops, beam 20, for 50 roots at once; every order is a seed."""
    seeds = table(spark, sf, "orders").select((F.col("o_orderkey") % 50).alias("root"), F.col("o_orderkey").alias("node"), (F.col("o_totalprice") / 500000).alias("score"))
    best, _ = G.beam_traversal(graph(spark, sf), seeds, 2, 20)
    return best.groupBy("root", "hops").agg(F.count("*").alias("nodes"), F.round(F.sum("score"), 4).alias("total"), F.round(F.max("score"), 6).alias("best"))


_SPREAD = f"""WITH RECURSIVE {_WAYS}, d AS (SELECT node AS other, count(DISTINCT other) AS degree FROM ways WHERE weight * confidence > 0 GROUP BY node),
    flow AS (SELECT node, other, max(weight * confidence) * 0.85 / sqrt(any_value(degree)) AS c FROM ways JOIN d USING (other) WHERE weight * confidence > 0 GROUP BY ALL),
    s(root, node, support) AS (SELECT o_orderkey % 5, o_orderkey, max(o_totalprice / 500000) FROM orders WHERE o_totalprice > 0 GROUP BY ALL
        UNION SELECT root, other, support * c FROM s JOIN flow USING (node) WHERE support * c > 0.02),
    m AS (SELECT root, node, max(support) AS support FROM s GROUP BY ALL)
    SELECT node, round(CASE WHEN max(support) >= 1 THEN 1 ELSE 1 - exp(sum(ln(1 - least(support, 1 - 1e-16)))) END, 8) AS activation FROM m GROUP BY node"""


@query("spreading_activation", _SPREAD)
def spreading_activation(spark, sf):
    """Activation of all nodes from five roots, over paths of support above 0.02."""
    seeds = table(spark, sf, "orders").select((F.col("o_orderkey") % 5).alias("root"), F.col("o_orderkey").alias("node"), (F.col("o_totalprice") / 500000).alias("activation"))
    return G.noisy_or(G.spreading_activation(graph(spark, sf), seeds, 0.02)).withColumn("activation", F.round("activation", 8))


@query("resumed_spreading", _SPREAD)
def resumed_spreading(spark, sf):
    """The same, stopped after 40 and 400 expansions and resumed."""
    seeds = table(spark, sf, "orders").select((F.col("o_orderkey") % 5).alias("root"), F.col("o_orderkey").alias("node"), (F.col("o_totalprice") / 500000).alias("activation"))
    folder = f"{shared_folder(spark)}/spreading-{uuid.uuid4().hex}"
    search = ResumableSpreading(graph(spark, sf), seeds, folder, 0.02)  # works out conductances and fingerprints once; every call goes by the folder's state
    for budget in (40, 400, None):
        search.run(budget)
    return G.noisy_or(search.supports()).withColumn("activation", F.round("activation", 8))


@query("chronological_order", """SELECT o_custkey AS scope, o_orderkey AS node, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS position, '' AS note FROM orders""")
def chronological_order(spark, sf):
    """Topological order of each customer's orders; the story order is against it, so only the edges decide."""
    nodes = table(spark, sf, "orders").select(F.col("o_custkey").alias("scope"), F.col("o_orderkey").alias("node"), (-F.unix_timestamp("o_orderdate")).cast("double").alias("story_order"), F.col("o_orderkey").alias("input_rank"))
    return G.chronological(nodes, temporal(spark, sf))


@query("temporal_cycle_audit", f"""WITH {TEMPORAL} SELECT scope, node FROM (SELECT scope, from_id AS node FROM temporal WHERE scope % 10 = 0
    UNION SELECT scope, to_id FROM temporal WHERE scope % 10 = 0)""")
def temporal_cycle_audit(spark, sf):
    """Nodes on cycles; customers divisible by ten get an edge from their last order back to the first."""
    t = temporal(spark, sf)
    inner = t.where("scope % 10 = 0")
    first = inner.select("scope", F.col("from_id").alias("n")).exceptAll(inner.select("scope", F.col("to_id").alias("n")))
    last = inner.select("scope", F.col("to_id").alias("n")).exceptAll(inner.select("scope", F.col("from_id").alias("n")))
    back = last.withColumnRenamed("n", "from_id").join(first.withColumnRenamed("n", "to_id"), "scope")
    return G.cyclic_nodes(t.unionByName(back))


@query("cycle_guard", f"""WITH {TEMPORAL} SELECT to_id AS from_id, from_id AS to_id FROM temporal WHERE scope % 7 = 0 UNION SELECT from_id, from_id FROM temporal WHERE scope % 7 = 1""")
def cycle_guard(spark, sf):
    """Proposed before-edges that would close a cycle: reversed edges and loops do, the edges themselves don't."""
    t = temporal(spark, sf)
    bad = t.where("scope % 7 = 0").select(F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id"))
    loops = t.where("scope % 7 = 1").select("from_id", F.col("from_id").alias("to_id"))
    return G.would_cycle(t, bad.unionByName(loops).unionByName(t.where("scope % 7 = 2").select("from_id", "to_id")))


@query("shortcut_targets", f"""WITH {_WAYS} SELECT other AS target, count(DISTINCT association_id) AS edges, min(association_id) AS first_edge FROM ways JOIN orders ON o_orderkey = node
    WHERE o_totalprice / 500000 * weight * confidence >= 0.5 GROUP BY other""")
def shortcut_targets(spark, sf):
    seeds = table(spark, sf, "orders").select(F.col("o_orderkey").alias("node"), (F.col("o_totalprice") / 500000).alias("activation"))
    return G.shortcut_targets(graph(spark, sf), seeds, 0.5).select("target", F.size("via").cast("long").alias("edges"), F.element_at("via", 1).alias("first_edge"))


@query("overlay_neighbours", f"""WITH {EDGES}, o AS (SELECT association_id, from_id, to_id, CASE WHEN association_id % 5 = 1 THEN 1 ELSE weight END AS weight FROM edges WHERE association_id % 3 <> 0)
    SELECT to_id, count(*) AS edges, round(max(weight), 6) AS best FROM o GROUP BY to_id""")
def overlay_neighbours(spark, sf):
    """The graph without every third edge id and with others' weights restored to 1."""
    g = edges(spark, sf)
    restored = g.where("association_id % 5 = 1 AND association_id % 3 <> 0").withColumn("weight", F.lit(1.0))
    return G.overlay(g, g.where("association_id % 3 = 0"), restored).groupBy("to_id").agg(F.count("*").alias("edges"), F.round(F.max("weight"), 6).alias("best"))


@query("association_delta", f"""WITH {EDGES} SELECT kind, count(*) AS n FROM (SELECT CASE WHEN association_id % 11 = 0 THEN 'created' WHEN association_id % 13 = 0 THEN 'deleted'
    WHEN association_id % 17 = 0 AND weight <> least(1, weight + 0.2 * (1 - weight)) THEN 'reinforced' END AS kind FROM edges WHERE NOT (association_id % 11 = 0 AND association_id % 13 = 0)) WHERE kind IS NOT NULL GROUP BY kind""")
def association_delta(spark, sf):
    """Two snapshots of the graph compared: created, reinforced and deleted edges."""
    g = edges(spark, sf)
    after = g.where("association_id % 13 <> 0").withColumn("weight", F.when(F.col("association_id") % 17 == 0, F.least(F.lit(1.0), F.expr("weight + 0.2 * (1 - weight)"))).otherwise(F.col("weight")))
    return G.delta(g.where("association_id % 11 <> 0"), after).groupBy("kind").agg(F.count("*").alias("n"))
