"""Writes and stateful folds of edge strengths, as pure functions of tables of events.

Folds are ordered: every event has a sequence column. Weights that only rise have a closed form; mixed signs are affine maps w -> a w + b, which compose,
so that an edge's events are folded in parts of the sequence and then part by part."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def equivalence_key(kind: Column, a: Column, b: Column) -> Column:
    """semantic relations are undirected, others directed."""
    low, high = F.least(a, b), F.greatest(a, b)
    return F.when(kind == "semantic", F.concat_ws("|", kind, low.cast("string"), high.cast("string"))).otherwise(F.concat_ws("|", kind, a.cast("string"), b.cast("string")))


def reinforce(edges: DataFrame, signals: DataFrame) -> DataFrame:
    """edges: id, weight, confidence, evidence_count; signals: id, signal, confidence -> the edges after all signals: w <- min(1, w + .2 clip(signal) (1 - w)),
    which is 1 - (1 - w) * product(1 - .2 s); confidence is the largest, evidence counts up; ids without an edge are left out."""
    s = F.greatest(F.lit(0.0), F.least(F.lit(1.0), "signal"))
    total = signals.groupBy("id").agg(F.sum(F.log1p(-0.2 * s)).alias("_l"), F.max("confidence").alias("_c"), F.count(F.lit(1)).alias("_n"))
    out = edges.join(total, "id", "left")
    return out.select(
        "id", F.least(F.lit(1.0), 1 - (1 - F.col("weight")) * F.exp(F.coalesce("_l", F.lit(0.0)))).alias("weight"),
        F.greatest("confidence", F.coalesce("_c", "confidence")).alias("confidence"), (F.col("evidence_count") + F.coalesce("_n", F.lit(0))).alias("evidence_count"),
    )


#: Sequence numbers in one part of a fold: an edge's events are folded part by part, then the parts, so no array holds more than a part's events.
PART = 1 << 16


def _fold(events: DataFrame, a: Column, b: Column, start: Column) -> DataFrame:
    """w <- a w + b in order of seq, 0 <= a, a + b <= 1, so that weights stay within [0, 1] and steps compose to one step."""
    steps = events.select("id", "seq", F.expr(f"seq div {PART}").alias("_part"), a.alias("a"), b.alias("b"), start.alias("_start"))
    compose = lambda acc, e: F.struct((acc["a"] * e["a"]).alias("a"), (acc["b"] * e["a"] + e["b"]).alias("b"))
    none = F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b"))
    parts = steps.groupBy("id", "_part").agg(F.array_sort(F.collect_list(F.struct("seq", "a", "b"))).alias("s"), F.min_by("_start", "seq").alias("_start"), F.count(F.lit(1)).alias("n"))
    parts = parts.select("id", "_part", F.aggregate("s", none, compose).alias("m"), "_start", "n")
    whole = parts.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("_part", F.col("m.a").alias("a"), F.col("m.b").alias("b")))).alias("s"), F.min_by("_start", "_part").alias("_start"), F.sum("n").alias("events"))
    return whole.select("id", F.aggregate("s", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("_start"))), lambda w, e: w * e["a"] + e["b"]).alias("weight"), "events")


#: Query hashes that an edge remembers.
MEMORY = 128


def counted_once(events: DataFrame, memory: int = MEMORY) -> DataFrame:
    """events: id, seq, query_hash, ... -> those that count: a query counts unless its hash is among the last memory hashes that counted for the edge (then
    the event changes nothing, the memory neither). A null or empty hash always counts and is not remembered.

    Events go through in order, an edge's in one task, which holds the memory and no events; all that can repeat within the memory is looked at: an event
    whose hash never came before for its edge counts without it."""
    columns = events.columns
    again = events.where(F.col("query_hash").cast("string") != "").groupBy("id", "query_hash").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("id").distinct()
    plain = events.join(again, "id", "left_anti").select(*columns)
    kinds = dict(events.dtypes)

    def run(batches):
        now, seen = None, {}
        for b in batches:
            keep = []
            for i, h in zip(b.column(columns.index("id")).to_pylist(), b.column(columns.index("query_hash")).to_pylist()):
                if i != now:
                    now, seen = i, {}
                key = None if h is None or h == "" else str(h)
                keep.append(key is None or key not in seen)
                if key is not None and key not in seen:
                    seen[key] = True
                    if len(seen) > memory:
                        del seen[next(iter(seen))]
            yield b.filter(pa.array(keep, pa.bool_()))

    some = events.join(again, "id", "left_semi").select(*columns).repartition("id").sortWithinPartitions("id", "seq")
    return plain.unionByName(some.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in columns)))


def utility_fold(events: DataFrame, memory: int = MEMORY) -> DataFrame:
    """events: id, seq, outcome, query_hash, start -> id, weight, events: success w + .2 (1 - w), harm w * .5, else w * .98; a query counts as counted_once()
    says."""
    once = counted_once(events, memory)
    a = F.when(F.col("outcome") == "success", 0.8).when(F.col("outcome") == "harm", 0.5).otherwise(0.98)
    return _fold(once, a, F.when(F.col("outcome") == "success", 0.2).otherwise(0.0), F.col("start"))


def feedback_fold(events: DataFrame, rate: float = 0.2) -> DataFrame:
    """events: id, seq, feedback_id, payload, positive, start (null: a new shortcut, which starts at rate) -> id, weight, events: positive w + r (1 - w), negative
    w (1 - r). A repeated feedback_id with its first payload counts once; with another payload it is refused."""
    first = events.withColumn("_r", F.row_number().over(Window.partitionBy("feedback_id", "id").orderBy("seq"))).where("_r = 1")
    a = F.lit(1 - rate)
    return _fold(first, a, F.when(F.col("positive"), rate).otherwise(0.0), F.coalesce("start", F.lit(rate)))


def refused_feedback(events: DataFrame) -> DataFrame:
    """Events whose feedback_id came before with another payload."""
    first = F.first("payload").over(Window.partitionBy("feedback_id").orderBy("seq"))
    return events.withColumn("_first", first).where("NOT (payload <=> _first)").drop("_first")


def expire(edges: DataFrame, as_of: str) -> DataFrame:
    """probation edges whose expires_at is not after as_of are retired; as_of is a parameter, never the clock."""
    over = (F.col("lifecycle") == "probation") & F.col("expires_at").isNotNull() & (F.col("expires_at") <= F.lit(as_of).cast("timestamp"))
    return edges.withColumn("lifecycle", F.when(over, "retired").otherwise(F.col("lifecycle")))


def append_ledger(ledger: DataFrame, rows: DataFrame, keys: list[str], check: Column) -> DataFrame:
    """rows that pass the check and whose keys are new, the first of each; the ledger itself never changes."""
    fresh = rows.where(check).withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy("seq"))).where("_r = 1").drop("_r")
    return ledger.unionByName(fresh.join(ledger.select(*keys), keys, "left_anti"))


def canonical_receipts(receipts: DataFrame, consumers: DataFrame) -> DataFrame:
    """edge, receipt: the smallest ready verified receipt (edge, receipt, ready, verified), overridden by the edge's first consumer (edge, seq, receipt)."""
    least = receipts.where("ready AND verified").groupBy("edge").agg(F.min("receipt").alias("own"))
    used = consumers.groupBy("edge").agg(F.min_by("receipt", "seq").alias("used"))
    return least.join(used, "edge", "full").select("edge", F.coalesce("used", "own").alias("receipt"))


def merge_concepts(concepts: DataFrame, merges: DataFrame) -> DataFrame:
    """concepts: id, ...; merges: id, canonical_id -> a new version with status and pointer."""
    return concepts.join(merges, "id", "left").withColumn("status", F.when(F.col("canonical_id").isNull(), "active").otherwise("merged"))


def resolve_concepts(drafts: DataFrame, concepts: DataFrame, aliases: DataFrame) -> DataFrame:
    """drafts: draft, name, names (array); concepts: id, name; aliases: id, alias (all in normal form) -> draft, id, how: one concept of that name; else the one
    concept that all of its names that match agree on; else null (a new concept)."""
    # of a name's concepts only the least and the greatest matter: they agree if there is one, and a draft meets each of its names once, however many concepts have it
    ends = lambda low, high: [F.min(low).alias("low"), F.max(high).alias("high")]
    one = lambda met, out: met.groupBy("draft").agg(*ends("low", "high")).where("low = high").select("draft", F.col("low").alias(out))
    by_name = one(drafts.select("draft", "name").join(concepts.groupBy("name").agg(*ends("id", "id")), "name"), "exact")
    by_alias = one(drafts.select("draft", F.explode("names").alias("alias")).join(aliases.groupBy("alias").agg(*ends("id", "id")), "alias"), "agreed")
    out = drafts.select("draft").join(by_name, "draft", "left").join(by_alias, "draft", "left")
    return out.select("draft", F.coalesce("exact", "agreed").alias("id"), F.when(F.col("exact").isNotNull(), "name").when(F.col("agreed").isNotNull(), "alias").otherwise("new").alias("how"))


def add_aliases(aliases: DataFrame, new: DataFrame) -> DataFrame:
    """new (id, alias) that no other concept has; the smallest id gets an alias that several ask for."""
    first = new.groupBy("alias").agg(F.min("id").alias("id")).select("id", "alias")
    return aliases.unionByName(first.join(aliases.select("alias"), "alias", "left_anti").select(*aliases.columns))


#: Words for remembering, of which an endpoint must have one; words that make one person of two; words for one event; main sources in their order.
REMEMBERING = ("想起", "回想", "回忆起", "勾起", "唤起", "记起", "忆起", "떠올", "생각났", "기억났", "思い出", "思い起")
ONE_PERSON = ("同一人物", "同一个人", "同一角色", "指向同一人物", "身份相同")
ONE_EVENT = ("同一事件", "同一场景", "同一情节", "同一段", "更详细描述")
MAIN_SOURCE = r"(?:^|/)main/(\d+)\.json$"


def claims_order(key: Column) -> tuple[Column, Column]:
    """(whether a temporal key says after, whether it says before)."""
    low = F.lower(F.coalesce(key, F.lit("")))
    return (low == "after") | low.endswith("_after"), low.isin("before", "precedes") | low.endswith("_before")


def admission(relations: DataFrame) -> DataFrame:
    """relations: relation_type, relation_key, relation_text, polarity, and of either end (current_, candidate_) id, text, scope, story_time, source_key, segment_index ->
    with reason why a relation of two episodes is refused (null: admitted).

    Recall wants an end that tells of remembering; identity is about one event and never makes two speakers one person; a temporal direction may not be against the order of
    segments of one source, or of main sources, within a scope unless a story time is given. Negative relations claim nothing and are admitted."""
    kind, positive = F.col("relation_type"), F.coalesce("polarity", F.lit(1)) > 0
    end = lambda side, name: F.coalesce(F.col(f"{side}_{name}"), F.lit(""))
    has = lambda text, words: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(text, w))
    told = F.concat_ws(" ", end("current", "text"), end("candidate", "text"))
    text = F.coalesce("relation_text", F.lit(""))
    same = end("current", "source_key") == end("candidate", "source_key")
    place = lambda side: F.when(same, F.col(f"{side}_segment_index").cast("long")).otherwise(F.nullif(F.regexp_extract(end(side, "source_key"), MAIN_SOURCE, 1), F.lit("")).try_cast("long"))
    rank = lambda side: F.struct(place(side).alias("place"), F.col(f"{side}_id").alias("id"))
    blank = lambda side: F.regexp_replace(end(side, "story_time"), r"(?U)\s+", "") == ""
    ordered = (end("current", "scope") == end("candidate", "scope")) & blank("current") & blank("candidate") & place("current").isNotNull() & place("candidate").isNotNull()
    after, before = claims_order(F.col("relation_key"))
    against = (after & (rank("current") < rank("candidate"))) | (before & (rank("current") > rank("candidate")))
    reason = (
        F.when((kind == "recall_trigger") & positive & ~has(told, REMEMBERING), "no_remembering")
        .when((kind == "temporal") & positive & F.coalesce(ordered & against, F.lit(False)), "against_source_order")
        .when((kind == "identity") & (F.coalesce("polarity", F.lit(1)) >= 0) & has(text, ONE_PERSON), "one_person")
        .when((kind == "identity") & (F.coalesce("polarity", F.lit(1)) >= 0) & ~has(text, ONE_EVENT), "not_one_event")
    )
    return relations.withColumn("reason", reason)


def earlier_first(a: Column, b: Column, backwards: Column) -> tuple[Column, Column]:
    """Endpoints of a temporal edge as earlier, later."""
    return F.when(backwards, b).otherwise(a), F.when(backwards, a).otherwise(b)


def edge_weight(judged: Column, cosine: Column, structure: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.80 * judged + 0.10 * (cosine + 1) / 2 + 0.05 * structure + 0.05))


def grown_weight(judged: Column, confidence: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.80 * judged + 0.10 * confidence + 0.05))
