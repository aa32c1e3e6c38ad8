"""Property-graph operators over edge tables (association_id, from_id, to_id, weight, confidence, polarity).

Endpoints are node names of any one type. Loops run until they converge; each round's frontier
is cut into the shared folder, and nothing but row counts comes to the driver."""

from __future__ import annotations

import heapq
import math

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .cutting import cut, released, stored, together

#: Fixed value: what an edge keeps of a score.
DECAY = 0.85


def both_ways(edges: DataFrame) -> DataFrame:
    """node, other and the edge's columns: every edge seen from either end."""
    return edges.select(F.col("from_id").alias("node"), F.col("to_id").alias("other"), *edges.columns).unionByName(
        edges.select(F.col("to_id").alias("node"), F.col("from_id").alias("other"), *edges.columns)
    )


def neighbours(edges: DataFrame, nodes: DataFrame, limit: int) -> DataFrame:
    """The limit best edges of each node: weight, then confidence, both descending, then id.

    Spark cuts each task's edges of a node to the limit before the shuffle, so a hub sends limit rows a task."""
    rank = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("weight"), F.desc("confidence"), "association_id"))
    return both_ways(edges).join(nodes.select("node").distinct(), "node").withColumn("rank", rank).where(F.col("rank") <= limit)


def beam_traversal(edges: DataFrame, seeds: DataFrame, hops: int, beam: int) -> tuple[DataFrame, DataFrame]:
    """(nodes: root, node, score, hops; examined edges: root, hop, association_id, node, other, score), for each root by itself.

    seeds: root, node, score. A hop h (from 0) expands the frontier's beam best nodes by at most 2 * beam edges each;
    score * weight * confidence * (0.5 if the polarity is negative) * DECAY ** (h + 1), so decay compounds. A node is kept if its
    score is better than before; the next frontier are the improved nodes."""
    best = cut(seeds.groupBy("root", "node").agg(F.max(F.greatest(F.lit(0.0), "score")).alias("score")).withColumn("hops", F.lit(0)))
    frontier, paths = best, None
    top = Window.partitionBy("root").orderBy(F.desc("score"), "node")
    fan = Window.partitionBy("root", "node").orderBy(F.desc("weight"), F.desc("confidence"), "association_id")
    ways = both_ways(edges)
    for h in range(hops):
        chosen = frontier.withColumn("_r", F.row_number().over(top)).where(F.col("_r") <= beam).select("root", "node", F.col("score").alias("_s"))
        seen = chosen.join(ways, "node").withColumn("_r", F.row_number().over(fan)).where(F.col("_r") <= 2 * beam)
        value = F.col("_s") * F.col("weight") * F.col("confidence") * F.when(F.col("polarity") < 0, 0.5).otherwise(1.0) * DECAY ** (h + 1)
        step = cut(seen.select("root", F.lit(h).alias("hop"), "association_id", "node", "other", value.alias("score")))
        paths = step if paths is None else paths.unionByName(step)
        new = step.groupBy("root", F.col("other").alias("node")).agg(F.max("score").alias("score"))
        old = best.select("root", "node", F.col("score").alias("_old"))
        frontier = cut(new.join(old, ["root", "node"], "left").where("_old IS NULL OR score > _old").select("root", "node", "score", F.lit(h + 1).alias("hops")))
        best = cut(best.join(frontier.select("root", "node"), ["root", "node"], "left_anti").unionByName(frontier))
    return best, paths


def conductances(edges: DataFrame) -> DataFrame:
    """node, other, c: weight * confidence * DECAY / sqrt(degree of the target) of the best edge each way, the degree being distinct neighbours by positive
    edges; loops don't conduct; a product of weight and confidence counts as 1 at most.

    The best edge of two nodes is the same both ways, so it is looked for once and degrees are plain counts. What is returned is cut."""
    ends = [F.least("from_id", "to_id").alias("node"), F.greatest("from_id", "to_id").alias("other")]
    pairs = stored(edges.where("weight * confidence > 0 AND from_id <> to_id").groupBy(*ends).agg(F.max(F.least(F.lit(1.0), F.col("weight") * F.col("confidence"))).alias("c")))
    ways = pairs.unionByName(pairs.select(F.col("other").alias("node"), F.col("node").alias("other"), "c"))
    degree = ways.groupBy("other").agg(F.count(F.lit(1)).alias("degree"))
    flow = ways.join(degree, "other").select("node", "other", (F.col("c") * DECAY / F.sqrt("degree")).alias("c"))
    flow = cut(flow)
    released(pairs)
    return flow


def spreading_activation(edges: DataFrame, seeds: DataFrame, floor: float = 0.0) -> DataFrame:
    """root, node, support: the largest product of conductances from a root's seeds, to the fixed point.

    seeds: root, node, activation (positive ones count). Supports at or below floor end a path. Conductances are
    at most DECAY, so a path's support falls by DECAY a step and no best path has a cycle: the frontier runs dry by itself. Improvements are appended round by round and the
    best is taken at the end; nothing is written twice."""
    flow = conductances(edges)
    frontier = reached = cut(seeds.where("activation > 0").groupBy("root", "node").agg(F.max("activation").alias("support")))
    while not frontier.isEmpty():
        frontier = better(frontier, flow, reached, floor)
        reached = reached.unionByName(frontier)
    return reached.groupBy("root", "node").agg(F.max("support").alias("support"))


def better(frontier: DataFrame, flow: DataFrame, reached: DataFrame, floor: float) -> DataFrame:
    """root, node, support of what one step from the frontier reaches with more support than so far."""
    value = F.col("support") * F.col("c")
    ahead = frontier.join(flow, "node").where(value > floor).groupBy("root", F.col("other").alias("node")).agg(F.max(value).alias("support"))
    old = reached.select("root", "node", F.col("support").alias("_old"))
    return cut(ahead.join(old, ["root", "node"], "left").groupBy("root", "node", "support").agg(F.max("_old").alias("_old")).where("_old IS NULL OR support > _old").drop("_old"))


def noisy_or(support: DataFrame) -> DataFrame:
    """node, activation: 1 - product of (1 - support) over roots; 1 if any is 1."""
    return support.groupBy("node").agg(F.when(F.max("support") >= 1, 1.0).otherwise(-F.expm1(F.sum(F.log1p(-F.least("support", F.lit(1 - 1e-16)))))).alias("activation"))


def contract(links: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """links: node, other (distinct, no loops) -> (steps: node, other, path; members: path, node, away; rings: ring, node).

    An inner node has one link in and one out. Runs of inner nodes become paths, named by their last node; away is a member's distance from the
    node after the path. steps link the other nodes, through a path or directly (path null). rings are cycles of inner nodes alone.
    Runs are found by doubling pointers, each inner node having one: a run of n nodes takes log2(n) rounds of as many rows as nodes, whatever the
    number of runs."""
    into = links.groupBy(F.col("other").alias("node")).agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("node")
    out = links.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.first("other").alias("next")).where("n = 1").select("node", "next")
    inner = cut(out.join(into, "node"))
    ends = inner.join(inner.select(F.col("node").alias("next"), F.lit(True).alias("goes")), "next", "left")
    # head: where a pointer stands; an open one stands on an inner node, a closed one behind its run
    now = cut(ends.select("node", F.col("next").alias("head"), F.coalesce("goes", F.lit(False)).alias("open"), F.lit(1).cast("long").alias("away"), F.col("node").alias("last"), F.least("node", "next").alias("ring"), F.lit(True).alias("fell")))
    state = lambda: now.agg(F.count(F.when(F.col("open"), 1)).alias("left"), F.count(F.when(F.col("open") & F.col("fell"), 1)).alias("fell")).first()
    at, before = state(), None
    # a round closes a pointer of every run that has an open one; if it closes none and lowers no ring's least node, all that is open is a ring and knows it
    while at.left and (before is None or at.left < before or at.fell):
        far = now.select(F.col("node").alias("head"), F.col("head").alias("_h"), F.col("open").alias("_o"), F.col("away").alias("_a"), F.col("last").alias("_l"), F.col("ring").alias("_r"))
        moved = now.where("open").join(far, "head").select("node", F.col("_h").alias("head"), F.col("_o").alias("open"), (F.col("away") + F.col("_a")).alias("away"), F.col("_l").alias("last"), F.least("ring", "_r").alias("ring"), (F.col("_r") < F.col("ring")).alias("fell"))
        now = cut(together(now.where("NOT open"), moved))
        at, before = state(), at.left
    members = now.where("NOT open").select(F.col("last").alias("path"), "node", "away", F.col("head").alias("end"))
    rings = now.where("open").select("ring", "node")
    outer = links.join(inner.select("node"), "node", "left_anti")
    steps = outer.join(members.select(F.col("node").alias("other"), "path", "end"), "other", "left").select("node", F.coalesce("end", "other").alias("other"), "path").distinct()
    return cut(steps), cut(members), rings


#: Rounds in which a frontier goes link by link before runs of links are contracted.
PLAIN = 6


def reachable(edges: DataFrame, starts: DataFrame, plain: int = PLAIN) -> DataFrame:
    """start, node: everything that directed edges reach from the starts (a start itself if it lies on a cycle), cycles tolerated.

    The frontier goes ahead link by link for a few rounds; if it is still alive, runs of nodes without a branch are contracted and it goes on run by run.
    So a chain of n edges takes log2(n) rounds, and rows are what is reached, never the closure of the graph."""
    links = cut(edges.select(F.col("from_id").alias("node"), F.col("to_id").alias("other")).where("node <> other").distinct())
    frontier = cut(starts.select(F.col("node").alias("start"), "node").distinct().join(links, "node").select("start", F.col("other").alias("node")).distinct())
    reach = frontier
    for _ in range(plain):
        if frontier.isEmpty():
            return reach
        ahead = frontier.join(links, "node").select("start", F.col("other").alias("node")).distinct()
        frontier = cut(ahead.join(reach, ["start", "node"], "left_anti"))
        reach = reach.unionByName(frontier)
    if frontier.isEmpty():
        return reach
    reach = cut(reach)
    steps, members, rings = contract(links)
    # a frontier inside a run reaches the rest of it and the node behind it, one on a ring the whole ring
    inside = cut(frontier.join(members, "node"))
    part = inside.select("start", "path", F.col("away").alias("_a")).join(members, "path").where("away < _a").select("start", "node")
    ring = frontier.join(rings, "node").select("start", "ring").distinct().join(rings, "ring").select("start", "node")
    behind = inside.select("start", F.col("end").alias("node")).distinct()
    seen = cut(frontier.join(members, "node", "left_anti").select("start", "node").unionByName(behind).distinct())
    frontier, whole = seen, None
    while not frontier.isEmpty():
        ahead = cut(frontier.join(steps, "node").select("start", "other", "path").distinct())
        through = ahead.where("path IS NOT NULL").select("start", "path")
        whole = through if whole is None else whole.unionByName(through)
        frontier = cut(ahead.select("start", F.col("other").alias("node")).distinct().join(seen, ["start", "node"], "left_anti"))
        seen = cut(seen.unionByName(frontier))
    out = reach.unionByName(part).unionByName(ring).unionByName(seen)
    if whole is not None:
        out = out.unionByName(whole.distinct().join(members, "path").select("start", "node"))
    return out.distinct()


def would_cycle(edges: DataFrame, proposed: DataFrame) -> DataFrame:
    """proposed edges (from_id, to_id) whose start is already reachable from their end, loops included."""
    back = reachable(edges, proposed.select(F.col("to_id").alias("node"))).select(F.col("start").alias("to_id"), F.col("node").alias("from_id"))
    return proposed.join(back, ["from_id", "to_id"], "left_semi").unionByName(proposed.where("from_id = to_id").select(*proposed.columns)).distinct()


def chronological(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """scope, node, position, note of nodes (scope, node, story_order, input_rank): before-edges (scope, from_id, to_id) are respected;
    free nodes come by story_order (nulls last), story_order, input_rank, node; what a cycle holds is appended in that order."""
    rows = nodes.select("scope", "node", "story_order", "input_rank", F.lit(None).cast("long").alias("to_id")).unionByName(
        edges.select("scope", F.col("from_id").alias("node"), F.lit(None).cast("double").alias("story_order"), F.lit(None).cast("long").alias("input_rank"), "to_id")
    )

    def order(own: list[tuple], links: list[tuple]) -> list[tuple]:
        key = {n: (o is None or o != o, 0.0 if o is None or o != o else o, r, n) for n, o, r in own}
        after: dict[int, set[int]] = {n: set() for n in key}
        waits = dict.fromkeys(key, 0)
        for a, b in links:
            if a in key and b in key and a != b and b not in after[a]:
                after[a].add(b)
                waits[b] += 1
        ready = [(key[n], n) for n in key if not waits[n]]
        heapq.heapify(ready)
        done = []
        while ready:
            _, n = heapq.heappop(ready)
            done.append((n, ""))
            for b in after[n]:
                waits[b] -= 1
                if not waits[b]:
                    heapq.heappush(ready, (key[b], b))
        placed = {n for n, _ in done}
        return done + [(n, "cycle") for n in sorted(set(key) - placed, key=key.get)]

    def batch(done: list[tuple]) -> pa.RecordBatch:
        scope, node, position, note = zip(*done)
        return pa.RecordBatch.from_arrays([pa.array(scope, pa.int64()), pa.array(node, pa.int64()), pa.array(position, pa.int64()), pa.array(note)], ["scope", "node", "position", "note"])

    def run(batches):
        """The rows come sorted by scope; a scope may go on from batch to batch."""
        now, own, links, out = None, [], [], []

        def close():
            out.extend((now, n, k, note) for k, (n, note) in enumerate(order(own, links), 1))
            own.clear()
            links.clear()

        for b in batches:
            for scope, node, story, rank, to in zip(*[c.to_pylist() for c in b.columns]):
                if scope != now and (own or links):
                    close()
                now = scope
                if to is None:
                    own.append((node, story, rank))
                else:
                    links.append((node, to))
            if out:
                yield batch(out)
                out.clear()
        if own or links:
            close()
        if out:
            yield batch(out)

    return rows.repartition("scope").sortWithinPartitions("scope").mapInArrow(run, "scope long, node long, position long, note string")


def cyclic_nodes(edges: DataFrame) -> DataFrame:
    """edges: scope, from_id, to_id -> scope, node of those left when nodes that nothing precedes, or that precede nothing, are peeled off again and again: all on
    cycles or between two. A loop is a cycle of its node.

    Runs without a branch are contracted first, so rounds follow the branching of the graph, not its length."""
    pair = lambda c: F.struct(F.col("scope"), F.col(c).alias("id"))
    links = cut(edges.select(pair("from_id").alias("node"), pair("to_id").alias("other")).distinct())
    loops = links.where("node = other").select("node")
    steps, members, rings = contract(links.where("node <> other"))
    left, n = cut(steps.unionByName(loops.select("node", F.col("node").alias("other"), F.lit(None).cast(steps.schema["path"].dataType).alias("path")))), -1
    while (now := left.count()) != n:
        n = now
        left = cut(left.join(left.select(F.col("other").alias("node")).distinct(), "node", "left_semi"))
        left = cut(left.join(left.select(F.col("node").alias("other")).distinct(), "other", "left_semi"))
    nodes = left.select("node").unionByName(left.select(F.col("other").alias("node"))).unionByName(left.where("path IS NOT NULL").select("path").distinct().join(members, "path").select("node")).unionByName(rings.select("node"))
    return nodes.distinct().select("node.scope", F.col("node.id").alias("node"))


def shortcut_targets(edges: DataFrame, seeds: DataFrame, least: float = 0.05) -> DataFrame:
    """target, via: nodes that one recall edge reaches from seeds (node, activation) with activation * weight * confidence of at
    least that, and the sorted edges."""
    hits = both_ways(edges).join(seeds, "node").where(F.col("activation") * F.col("weight") * F.col("confidence") >= least)
    return hits.groupBy(F.col("other").alias("target")).agg(F.sort_array(F.collect_set("association_id")).alias("via"))


def overlay(edges: DataFrame, hidden: DataFrame, restored: DataFrame) -> DataFrame:
    """The graph without hidden ids and with restored rows in place of those with their ids."""
    gone = hidden.select("association_id").unionByName(restored.select("association_id"))
    return edges.join(gone, "association_id", "left_anti").unionByName(restored)


def delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """association_id, kind (created, reinforced or deleted), before and after weight of edges that differ."""
    a = before.select("association_id", F.col("weight").alias("before_weight"))
    b = after.select("association_id", F.col("weight").alias("after_weight"))
    kind = F.when(F.col("before_weight").isNull(), "created").when(F.col("after_weight").isNull(), "deleted").otherwise("reinforced")
    return a.join(b, "association_id", "full").where("NOT (before_weight <=> after_weight)").withColumn("kind", kind)


#: Rows of a task where a query deals out by their number.
TASK_ROWS = 1 << 19


def concept_reach(edges: DataFrame, concept_links: DataFrame, rows: int = TASK_ROWS) -> DataFrame:
    """concept, episodes: distinct episodes linked to the concept or to one of its neighbour concepts (concept, other).

    Pairs are stored once, and their number says into how many parts they are dealt, so that a task has about rows of them; what is counted is dealt by
    concept and episode, so no concept is one task's work."""
    own = stored(edges.select(F.col("to_id").alias("other"), F.col("from_id").alias("episode")).distinct())
    sides = concept_links.select("concept", "other").unionByName(concept_links.select(F.col("other").alias("concept"), F.col("concept").alias("other")))
    sides = sides.where("concept IS NOT NULL AND other IS NOT NULL AND concept <> other").unionByName(own.select(F.col("other").alias("concept"), "other")).distinct()
    parts = max(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(own.count() / rows))
    pairs = own.repartition(parts, "other").join(sides, "other").select("concept", "episode")
    return pairs.repartition(3 * parts, "concept", "episode").distinct().groupBy("concept").agg(F.count("episode").alias("episodes"))


def protected_truncation(candidates: DataFrame, k: int) -> DataFrame:
    """The k best of candidates (id, score, protected), protected ones first to stay; ordered by score."""
    return candidates.orderBy(F.desc("protected"), F.desc("score"), "id").limit(k).orderBy(F.desc("score"), "id")
