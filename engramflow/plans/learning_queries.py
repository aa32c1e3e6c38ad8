"""Folds over events: the association is user_id, the sequence event_id, feedback and queries come from props."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import contextual as C
from ..operators import evidence as E
from ..operators import ingestion as I
from ..operators import learning as L
from ..operators import planning as P2
from ..operators.resolution import resolve_batch
from ..streaming import probation as P
from .bindings import EDGES, UNIT, edges, table
from .registry import query
from .vector_queries import unit


def events(spark, sf):
    return table(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))


_EVENTS = "ev AS (SELECT *, (props->>'$.k')::BIGINT AS k FROM events)"


@query("reinforced_edges", f"""WITH {EDGES}, s AS (SELECT l_orderkey * 100000000 + l_partkey * 10 + CASE WHEN l_returnflag = 'R' THEN 0 ELSE 2 END AS id, least(1, greatest(0, l_quantity / 40)) AS s, 1 - l_tax AS c FROM lineitem),
    t AS (SELECT id, sum(ln(1 - 0.2 * s)) AS l, max(c) AS c, count(*) AS n FROM s GROUP BY id)
    SELECT association_id AS id, round(least(1, 1 - (1 - weight) * exp(l)), 8) AS weight, round(greatest(confidence, c), 8) AS confidence, evidence_count + n AS evidence_count FROM edges JOIN t ON id = association_id""")
def reinforced_edges(spark, sf):
    """Every edge reinforced once for each of its line items, in closed form."""
    own = edges(spark, sf).select(F.col("association_id").alias("id"), "weight", "confidence", "evidence_count")
    polarity = F.when(F.col("l_returnflag") == "R", 0).otherwise(2)
    signals = table(spark, sf, "lineitem").select((F.col("l_orderkey") * 100000000 + F.col("l_partkey") * 10 + polarity).alias("id"), (F.col("l_quantity") / 40).alias("signal"), (1 - F.col("l_tax")).alias("confidence"))
    return L.reinforce(own, signals).select("id", F.round("weight", 8).alias("weight"), F.round("confidence", 8).alias("confidence"), "evidence_count")


@query("utility_fold", f"""WITH {_EVENTS}, o AS (SELECT user_id AS id, event_id, event_type FROM ev QUALIFY row_number() OVER (PARTITION BY user_id, k ORDER BY event_id) = 1),
    g AS (SELECT id, list(CASE event_type WHEN 'purchase' THEN 1.0 WHEN 'error' THEN -1.0 ELSE 0.0 END::DOUBLE ORDER BY event_id) AS s FROM o GROUP BY id)
    SELECT id, round(list_reduce(s, lambda w, e: CASE WHEN e > 0 THEN w * 0.8::DOUBLE + 0.2::DOUBLE WHEN e < 0 THEN w * 0.5::DOUBLE ELSE w * 0.98::DOUBLE END, 0.5::DOUBLE), 8) AS weight, len(s) AS events FROM g""")
def utility_fold(spark, sf):
    """Legacy utility: purchases are successes, errors harm; a query (props.k) counts once."""
    outcome = F.when(F.col("event_type") == "purchase", "success").when(F.col("event_type") == "error", "harm").otherwise("none")
    rows = events(spark, sf).select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), outcome.alias("outcome"), F.col("k").alias("query_hash"), F.lit(0.5).alias("start"))
    return L.utility_fold(rows).withColumn("weight", F.round("weight", 8))


@query("feedback_fold", f"""WITH {_EVENTS}, o AS (SELECT user_id AS id, event_id, value >= 20 AS p FROM ev QUALIFY row_number() OVER (PARTITION BY user_id, k ORDER BY event_id) = 1),
    g AS (SELECT id, list(CASE WHEN p THEN 1.0 ELSE 0.0 END::DOUBLE ORDER BY event_id) AS s FROM o GROUP BY id)
    SELECT id, round(list_reduce(s, lambda w, e: w * 0.8::DOUBLE + CASE WHEN e > 0 THEN 0.2::DOUBLE ELSE 0::DOUBLE END, 0.2::DOUBLE), 8) AS weight, len(s) AS events FROM g""")
def feedback_fold(spark, sf):
    """Shortcut weights by user feedback: values of 20 or more are positive, feedback ids are (user, k)."""
    rows = events(spark, sf).select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), F.concat_ws(":", "user_id", "k").alias("feedback_id"), F.col("value").cast("string").alias("payload"), (F.col("value") >= 20).alias("positive"), F.lit(None).cast("double").alias("start"))
    return L.feedback_fold(rows).withColumn("weight", F.round("weight", 8))


@query("refused_feedback", f"""WITH {_EVENTS} SELECT event_id AS seq, user_id || ':' || k AS feedback_id FROM (
    SELECT *, first_value(event_type) OVER (PARTITION BY user_id, k ORDER BY event_id) AS f FROM ev) WHERE event_type <> f""")
def refused_feedback(spark, sf):
    rows = events(spark, sf).select(F.col("event_id").alias("seq"), F.concat_ws(":", "user_id", "k").alias("feedback_id"), F.col("event_type").alias("payload"))
    return L.refused_feedback(rows).select("seq", "feedback_id")


@query("expired_edges", """SELECT lifecycle, count(*) AS n FROM (SELECT CASE WHEN l_linestatus = 'O' AND l_shipdate + INTERVAL 30 DAY <= TIMESTAMP '1999-01-01' THEN 'retired'
    WHEN l_linestatus = 'O' THEN 'probation' ELSE 'active' END AS lifecycle FROM lineitem) GROUP BY lifecycle""")
def expired_edges(spark, sf):
    """Open line items are on probation for 30 days from shipping; as of the start of 1999."""
    rows = table(spark, sf, "lineitem").select(F.when(F.col("l_linestatus") == "O", "probation").otherwise("active").alias("lifecycle"), (F.col("l_shipdate") + F.expr("INTERVAL 30 DAY")).cast("timestamp").alias("expires_at"))
    return L.expire(rows, "1999-01-01").groupBy("lifecycle").agg(F.count("*").alias("n"))


@query("ledger_append", f"""WITH {_EVENTS}, f AS (SELECT user_id, k, min(event_id) AS seq FROM ev WHERE value > 5 GROUP BY ALL), base AS (SELECT event_id AS seq, user_id, k FROM ev WHERE event_id % 10 = 0)
    SELECT user_id, count(*) AS entries, max(seq) AS last_seq FROM (SELECT seq, user_id, k FROM base UNION ALL SELECT seq, user_id, k FROM f ANTI JOIN base USING (user_id, k)) GROUP BY user_id""")
def ledger_append(spark, sf):
    """An append-only ledger with idempotency keys (user, k) and a check."""
    rows = events(spark, sf).select(F.col("event_id").alias("seq"), "user_id", "k", "value")
    out = L.append_ledger(rows.where("seq % 10 = 0"), rows, ["user_id", "k"], F.col("value") > 5)
    return out.groupBy("user_id").agg(F.count("*").alias("entries"), F.max("seq").alias("last_seq"))


@query("canonical_receipts", f"""WITH {_EVENTS}, o AS (SELECT k AS edge, min(event_id) AS own FROM ev WHERE event_type IN ('purchase', 'signup') AND value > 10 GROUP BY k),
    u AS (SELECT k AS edge, arg_min(event_id, ts) AS used FROM ev WHERE event_type = 'click' AND k % 3 = 0 GROUP BY k)
    SELECT edge, coalesce(used, own) AS receipt FROM o FULL JOIN u USING (edge)""")
def canonical_receipts(spark, sf):
    e = events(spark, sf)
    receipts = e.select(F.col("k").alias("edge"), F.col("event_id").alias("receipt"), F.col("event_type").isin("purchase", "signup").alias("ready"), (F.col("value") > 10).alias("verified"))
    consumers = e.where("event_type = 'click' AND k % 3 = 0").select(F.col("k").alias("edge"), F.col("ts").alias("seq"), F.col("event_id").alias("receipt"))
    return L.canonical_receipts(receipts, consumers)


@query("concept_resolution", """WITH c AS (SELECT p_partkey AS id, p_name AS name, p_brand || '/' || p_type || '/' || p_size AS alias FROM part),
    d AS (SELECT l_orderkey AS draft, min(p_name) AS name, list_distinct(list(alias)) AS names FROM lineitem JOIN c ON id = l_partkey JOIN part ON p_partkey = l_partkey GROUP BY l_orderkey),
    e AS (SELECT draft, min(id) AS exact FROM d JOIN c USING (name) GROUP BY draft HAVING count(DISTINCT id) = 1),
    a AS (SELECT draft, min(id) AS agreed FROM (SELECT draft, unnest(names) AS alias FROM d) JOIN c USING (alias) GROUP BY draft HAVING count(DISTINCT id) = 1)
    SELECT draft, coalesce(exact, agreed) AS id, CASE WHEN exact IS NOT NULL THEN 'name' WHEN agreed IS NOT NULL THEN 'alias' ELSE 'new' END AS how FROM d LEFT JOIN e USING (draft) LEFT JOIN a USING (draft)""")
def concept_resolution(spark, sf):
    """Drafts (orders with the names of their line items) resolved to parts by name, then by agreeing aliases."""
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.concat_ws("/", "p_brand", "p_type", "p_size").alias("alias"))
    lines = table(spark, sf, "lineitem").join(part, F.col("l_partkey") == F.col("id"))
    drafts = lines.groupBy(F.col("l_orderkey").alias("draft")).agg(F.min("name").alias("name"), F.collect_set("alias").alias("names"))
    return L.resolve_concepts(drafts, part.select("id", "name"), part.select("id", "alias"))


_NAMES = "p_name || ' ' || p_brand AS name, [p_name || ' ' || p_type, p_brand || ' ' || p_size] AS more"


@query("concept_batch", f"""WITH p AS (SELECT p_partkey AS id, p_size > 45 AS old, {_NAMES} FROM part),
    base AS (SELECT list(struct_pack(name := alias, id := id, exact := alias = name)) AS own FROM (SELECT id, name, unnest([name, more[1]]) AS alias FROM p WHERE old)),
    d AS (SELECT id AS seq, [name] || more AS names FROM p WHERE NOT old),
    steps AS (SELECT list(struct_pack(own := []::STRUCT(name VARCHAR, id BIGINT, exact BOOLEAN)[], out := []::STRUCT(seq BIGINT, id BIGINT, how VARCHAR)[], last := 0::BIGINT, seq := seq, names := names) ORDER BY seq) AS s FROM d),
    done AS (SELECT list_reduce(s, lambda a, x: list_transform([struct_pack(
            e := list_distinct(list_transform(list_filter(a.own, lambda o: o.name = x.names[1] AND o.exact), lambda o: o.id)),
            u := list_distinct(flatten(list_filter(list_transform(list_distinct(x.names), lambda n: list_distinct(list_transform(list_filter(a.own, lambda o: o.name = n), lambda o: o.id))), lambda l: len(l) = 1))),
            m := list_distinct(list_transform(list_filter(a.own, lambda o: list_contains(x.names, o.name)), lambda o: o.id)))],
        lambda g: list_transform([struct_pack(c := CASE WHEN len(g.e) = 1 THEN g.e[1] WHEN len(g.u) = 1 THEN g.u[1] WHEN len(g.m) = 1 THEN g.m[1] END, how := CASE WHEN len(g.e) = 1 THEN 'name' WHEN len(g.u) = 1 OR len(g.m) = 1 THEN 'alias' ELSE 'new' END)],
        lambda r: struct_pack(own := a.own || list_transform(list_filter(list_distinct(x.names), lambda n: r.c IS NULL OR len(list_filter(a.own, lambda o: o.name = n)) = 0),
                lambda n: struct_pack(name := n, id := coalesce(r.c, a.last + 1), exact := r.c IS NULL AND n = x.names[1])),
            out := a.out || [struct_pack(seq := x.seq, id := coalesce(r.c, a.last + 1), how := r.how)], last := a.last + CASE WHEN r.c IS NULL THEN 1 ELSE 0 END, seq := x.seq, names := x.names))[1])[1],
        struct_pack(own := (SELECT own FROM base), out := []::STRUCT(seq BIGINT, id BIGINT, how VARCHAR)[], last := (SELECT max(id) FROM p WHERE old), seq := 0::BIGINT, names := []::VARCHAR[])) AS r FROM steps)
    SELECT o.seq, o.id, o.how FROM (SELECT unnest(r.out) AS o FROM done)""")
def concept_batch(spark, sf):
    """Large parts are concepts with two names; the others are drafts in the order of their keys, with names that collide in all ways."""
    two = lambda a, b: F.concat_ws(" ", a, b)
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") > 45).alias("old"), two("p_name", "p_brand").alias("name"), F.array(two("p_name", "p_type"), two("p_brand", F.col("p_size").cast("string"))).alias("more"))
    old = part.where("old")
    drafts = part.where("NOT old").select(F.col("id").alias("seq"), "name", F.col("more").alias("aliases"))
    concepts = old.select("id", "name", F.lit(True).alias("active"), F.lit(None).cast("long").alias("canonical_id"))
    return resolve_batch(drafts, concepts, old.select("id", F.explode(F.array("name", F.col("more")[0])).alias("alias")))[0]


@query("alias_additions", """WITH a AS (SELECT p_partkey AS id, p_brand || '/' || p_size AS alias FROM part WHERE p_partkey % 3 = 0), n AS (SELECT min(p_partkey) AS id, p_brand || '/' || p_size AS alias FROM part WHERE p_partkey % 3 <> 0 GROUP BY ALL)
    SELECT id, count(*) AS aliases FROM (SELECT * FROM a UNION ALL SELECT id, alias FROM n WHERE alias NOT IN (SELECT alias FROM a)) GROUP BY id""")
def alias_additions(spark, sf):
    """Aliases are added without being taken from other concepts."""
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.concat_ws("/", "p_brand", "p_size").alias("alias"))
    return L.add_aliases(part.where("id % 3 = 0"), part.where("id % 3 <> 0")).groupBy("id").agg(F.count("*").alias("aliases"))


@query("concept_merge", """SELECT CASE WHEN p_size > 40 THEN 'merged' ELSE 'active' END AS status, count(*) AS n, sum(CASE WHEN p_size > 40 THEN p_partkey // 10 END)::BIGINT AS pointers FROM part GROUP BY 1""")
def concept_merge(spark, sf):
    part = table(spark, sf, "part")
    merges = part.where("p_size > 40").select(F.col("p_partkey").alias("id"), F.expr("p_partkey div 10").alias("canonical_id"))
    return L.merge_concepts(part.select(F.col("p_partkey").alias("id")), merges).groupBy("status").agg(F.count("*").alias("n"), F.sum("canonical_id").alias("pointers"))


_PAIRS = """t AS (SELECT *, conv_id * 1000 + turn AS id, lead(turn) OVER w AS n_turn, lead(text) OVER w AS n_text FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
    r AS (SELECT id, conv_id % 6 > 2 AS swap, turn, n_turn, conv_id % 2 = 0 AS one, turn % 7 <> 6 AS same_scope, conv_id % 5 <> 0 AS timeless, CASE turn % 5 WHEN 4 THEN -1 ELSE 1 END AS polarity,
        ['recall_trigger', 'identity', 'temporal', 'temporal'][(conv_id + turn) % 4 + 1] AS kind, ['before', 'story_after', 'beside'][turn % 3 + 1] AS k, ['同一事件', '同一人物 同一事件', 'else', '更详细描述'][conv_id % 4 + 1] AS claim, conv_id % 3 = 0 AS remembers
        FROM t WHERE n_turn IS NOT NULL)"""


@query("edge_admission", f"""WITH {_PAIRS} SELECT id, CASE WHEN kind = 'recall_trigger' AND polarity > 0 AND NOT remembers THEN 'no_remembering'
    WHEN kind = 'temporal' AND polarity > 0 AND same_scope AND timeless AND ((k = 'story_after' AND NOT swap) OR (k = 'before' AND swap)) THEN 'against_source_order'
    WHEN kind = 'identity' AND polarity >= 0 AND contains(claim, '同一人物') THEN 'one_person' WHEN kind = 'identity' AND polarity >= 0 AND NOT (contains(claim, '同一事件') OR contains(claim, '更详细描述')) THEN 'not_one_event' END AS reason FROM r""")
def edge_admission(spark, sf):
    """Successive turns of conversations as episodes with proposed relations of all kinds; in half of them the earlier turn is the candidate."""
    own = Window.partitionBy("conv_id").orderBy("turn")
    conv, turn = F.col("conv_id"), F.col("turn")
    rows = table(spark, sf, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"), F.lead("turn").over(own).alias("n_turn"), F.coalesce(F.lead("text").over(own), F.lit("")).alias("n_text")).where("n_turn IS NOT NULL")
    choose = lambda values, k: F.element_at(F.array(*[F.lit(v) for v in values]), (k + 1).cast("int"))
    key = lambda t: F.when(conv % 2 == 0, F.lit("conv")).otherwise(F.concat(F.lit("book/main/"), t.cast("string"), F.lit(".json")))
    swap = conv % 6 > 2
    sides = {}
    for side, other in (("current", swap), ("candidate", ~swap)):
        t = F.when(other, F.col("n_turn")).otherwise(turn)
        said = F.when(other, F.concat("n_text", F.when(conv % 3 == 0, " 想起").otherwise(""))).otherwise(F.col("text"))
        scope = F.when(other & (turn % 7 == 6), "x").otherwise("")
        sides |= {f"{side}_id": conv * 1000 + t, f"{side}_text": said, f"{side}_scope": scope, f"{side}_story_time": F.when((conv % 5 == 0) & other, "noon").otherwise(" "), f"{side}_source_key": key(t), f"{side}_segment_index": t}
    relations = rows.select(
        (conv * 1000 + turn).alias("id"), choose(["recall_trigger", "identity", "temporal", "temporal"], (conv + turn) % 4).alias("relation_type"), choose(["before", "story_after", "beside"], turn % 3).alias("relation_key"),
        choose(["同一事件", "同一人物 同一事件", "else", "更详细描述"], conv % 4).alias("relation_text"), F.when(turn % 5 == 4, -1).otherwise(1).alias("polarity"), *[c.alias(n) for n, c in sides.items()],
    )
    return L.admission(relations).select("id", "reason")


@query("learning_anchors", """WITH c AS (SELECT DISTINCT l_orderkey AS request, CASE WHEN l_returnflag = 'A' THEN 'concept' ELSE 'episode' END AS anchor_type, l_suppkey AS anchor_id, l_partkey || '-' || l_linenumber AS contribution_id, l_quantity AS activation
        FROM lineitem WHERE l_discount < 0.09::DOUBLE AND NOT (l_returnflag <> 'A' AND (l_linestatus = 'O' OR l_partkey % 5 = 0))),
    b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY request, anchor_type, anchor_id ORDER BY activation DESC, contribution_id) = 1)
    SELECT request, anchor_type, anchor_id, contribution_id, rank FROM (SELECT *, (row_number() OVER (PARTITION BY request ORDER BY activation DESC, anchor_type, anchor_id, contribution_id))::INT AS rank FROM b) WHERE rank <= 4""")
def learning_anchors(spark, sf):
    """Line items as base routes to suppliers: at most four endpoints an order; open items came by context, every fifth part is a target."""
    rows = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("request"), F.when(F.col("l_returnflag") == "A", "concept").otherwise("episode").alias("anchor_type"), F.col("l_suppkey").alias("anchor_id"), F.concat_ws("-", "l_partkey", "l_linenumber").alias("contribution_id"),
        F.col("l_quantity").alias("activation"), (F.col("l_discount") < 0.09).alias("eligible"), (F.col("l_linestatus") == "O").alias("contextual"), (F.col("l_partkey") % 5 == 0).alias("target"),
    )
    return I.learning_anchors(rows).select("request", "anchor_type", "anchor_id", "contribution_id", "rank")


@query("attribution_downgrades", f"""WITH t AS (SELECT conv_id * 1000 + turn AS id, turn, role, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next FROM conversations),
    d AS (SELECT *, next IS NOT NULL AND next <> role AND turn % 3 <> 2 AS down FROM t)
    SELECT id, CASE WHEN down THEN 'reported' ELSE ['observed', 'asserted', 'mixed'][turn % 3 + 1] END AS epistemic_status, CASE WHEN down THEN least(0.8, 0.5 + turn % 5 / 10) ELSE 0.5 + turn % 5 / 10 END::DOUBLE AS confidence,
        CASE WHEN NOT down THEN '' WHEN turn % 2 = 0 THEN 'seen；' || '{I.NOT_THE_SPEAKER}' ELSE '{I.NOT_THE_SPEAKER}' END || CASE WHEN NOT down AND turn % 2 = 0 THEN 'seen' ELSE '' END AS epistemic_note FROM d""")
def attribution_downgrades(spark, sf):
    """Turns as episodes that quote the turn after them: who leads one is not who its evidence says speaks."""
    turn = F.col("turn")
    next_role = F.lead("role").over(Window.partitionBy("conv_id").orderBy("turn"))
    rows = table(spark, sf, "conversations").select(
        (F.col("conv_id") * 1000 + turn).alias("id"), F.array(F.upper("role"), F.lit("x")).alias("participants"), F.array(F.concat(F.lit("[speaker_raw:  "), next_role, F.lit(" ]")), F.lit("[speaker_raw: ???]")).alias("quotes"),
        F.when(turn % 3 == 0, "observed").when(turn % 3 == 1, "asserted").otherwise("mixed").alias("epistemic_status"), (0.5 + turn % 5 / 10).alias("confidence"), F.when(turn % 2 == 0, "seen").otherwise("").alias("epistemic_note"),
    )
    return I.downgrade_attribution(rows.withColumn("quotes", F.array_compact("quotes"))).select("id", "epistemic_status", "confidence", "epistemic_note")


@query("planned_queries", """WITH b AS (SELECT item_id, trim(substr(text, 1, 10)) AS a, trim(substr(text, 11, 8)) AS z, trim(text) AS whole FROM benchmark),
    s AS (SELECT *, CASE WHEN item_id % 2 = 0 THEN ['__constraint_slot__ 关系约束：' || a] ELSE [] END || CASE WHEN item_id % 3 = 0 THEN ['__constraint_slot__ 因果约束：why'] ELSE [] END
        || CASE WHEN item_id % 4 <> 1 THEN ['__answer_slot__ 原文中“' || a || '”对应的事实是什么'] ELSE [] END || CASE WHEN item_id % 5 <> 2 AND (z <> a OR item_id % 4 = 1) THEN ['__answer_slot__ 原文中“' || z || '”对应的事实是什么'] ELSE [] END AS slots FROM b),
    r AS (SELECT *, 8 - 1 - len(slots) AS room FROM s), f AS (SELECT *, (2 * room + 2) // 3 AS front FROM r)
    SELECT item_id, array_to_string(slots, '|') AS slots, array_to_string([whole] || slots || list_transform(range(1, front + 1), lambda i: 'term ' || i) || list_transform(range(13 - (room - front), 13), lambda i: 'term ' || i), '|') AS kept FROM f""")
def planned_queries(spark, sf):
    """Benchmark items as questions with two quotations and constraints: their slots, and of these and twelve terms the eight queries that are kept."""
    from pyspark.sql import types as T

    texts = T.ArrayType(T.StringType())

    def slots(q: pd.Series, r: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series([P2.sub_queries(a, b, "", x) for a, b, x in zip(q, r, c)], dtype=object)

    def kept(qs: pd.Series) -> pd.Series:
        return qs.map(lambda x: P2.bounded_queries(list(x), 8))

    slots, kept = F.pandas_udf(slots, texts), F.pandas_udf(kept, texts)
    item, a, z = F.col("item_id"), F.trim(F.substring("text", 1, 10)), F.trim(F.substring("text", 11, 8))
    question = F.concat(F.lit("请说明“"), a, F.lit("”"), F.when(item % 4 == 1, "未经证明").otherwise("；"), F.lit("。以及其他。"), F.when(item % 5 == 2, "不要直接回答").otherwise(""), F.lit("“"), z, F.lit("”"))
    rows = table(spark, sf, "benchmark").select("item_id", F.trim("text").alias("whole"), question.alias("q"), F.when(item % 2 == 0, a).otherwise("").alias("r"), F.when(item % 3 == 0, " why ").otherwise("").alias("c"))
    found = rows.select("item_id", "whole", slots("q", "r", "c").alias("s"))
    terms = F.array(*[F.lit(f"term {k}") for k in range(1, 13)])
    return found.select("item_id", F.array_join("s", "|").alias("slots"), F.array_join(kept(F.concat(F.array("whole"), "s", terms)), "|").alias("kept"))


@query("edge_equivalence", """SELECT k, count(*) AS edges FROM (SELECT CASE WHEN l_linestatus = 'O' THEN 'semantic|' || least(l_suppkey, l_partkey) || '|' || greatest(l_suppkey, l_partkey)
    ELSE 'causal|' || l_suppkey || '|' || l_partkey END AS k FROM lineitem) GROUP BY k""")
def edge_equivalence(spark, sf):
    """Edges that are one: semantic ones in either direction, others in theirs."""
    kind = F.when(F.col("l_linestatus") == "O", "semantic").otherwise("causal")
    return table(spark, sf, "lineitem").select(L.equivalence_key(kind, F.col("l_suppkey"), F.col("l_partkey")).alias("k")).groupBy("k").agg(F.count("*").alias("edges"))


@query("edge_weights", f"""WITH {EDGES} SELECT association_id, round(greatest(0, least(1, 0.8 * weight + 0.1 * (confidence * polarity + 1) / 2 + 0.05 * least(1, evidence_count / 4) + 0.05)), 8) AS direct,
    round(greatest(0, least(1, 0.8 * weight + 0.1 * confidence + 0.05)), 8) AS grown FROM edges""")
def edge_weights(spark, sf):
    g = edges(spark, sf)
    direct = L.edge_weight(F.col("weight"), F.col("confidence") * F.col("polarity"), F.least(F.lit(1.0), F.col("evidence_count") / 4))
    return g.select("association_id", F.round(direct, 8).alias("direct"), F.round(L.grown_weight(F.col("weight"), F.col("confidence")), 8).alias("grown"))


_PROPOSALS = f"""{UNIT}, p AS (SELECT e.vec_id AS edge, s.vec_id AS slot, e.vec_id % 37 AS target, (e.label + 1) / 10 AS anchor, list_dot_product(e.v, s.v) AS c, list_dot_product(e.v, n.v) AS nn,
    CASE e.vec_id % 5 WHEN 0 THEN 'probation' WHEN 1 THEN 'retired' ELSE 'active' END AS lifecycle, (e.vec_id % 11) / 10 AS utility
    FROM unit e, unit s JOIN unit n ON n.vec_id = s.vec_id + 1 WHERE s.vec_id % 20 = 0),
    g AS (SELECT *, CASE WHEN c > 0.05 THEN least(1, (c - 0.05) / 0.95) ELSE 0 END AS gc, CASE WHEN nn > 0.05 THEN least(1, (nn - 0.05) / 0.95) ELSE 0 END AS gn,
    CASE lifecycle WHEN 'active' THEN 1.0 WHEN 'probation' THEN 0.5 ELSE 0 END AS life FROM p),
    m AS (SELECT *, sqrt(gc * gn) AS key, sqrt(gc * gn) * anchor / max(anchor) OVER (PARTITION BY slot) * life * least(1, utility) AS score,
    CASE WHEN life = 0 THEN 'lifecycle' WHEN utility <= 0 THEN 'utility' WHEN gc <= 0 THEN 'context' WHEN gn <= 0 THEN 'need' END AS reason FROM g),
    r AS (SELECT *, row_number() OVER (PARTITION BY slot ORDER BY score DESC, key DESC, anchor DESC, edge, target) AS place FROM m)"""


def proposed(spark, sf):
    """Every vector as an edge's cue, and every twentieth and its successor as a slot's context and need."""
    index = unit(spark, sf)
    life = F.when(F.col("id") % 5 == 0, "probation").when(F.col("id") % 5 == 1, "retired").otherwise("active")
    cues = index.select(F.col("id").alias("edge"), (F.col("id") % 37).alias("target"), ((F.col("label") + 1) / 10).alias("anchor"), life.alias("lifecycle"), ((F.col("id") % 11) / 10).alias("utility"), "v")
    needs = index.where("id % 20 = 1").select((F.col("id") - 1).alias("slot"), F.col("v").alias("need"))
    return cues, index.where("id % 20 = 0").select(F.col("id").alias("slot"), F.col("v").alias("context")).join(needs, "slot")


@query("contextual_match", f"""WITH {_PROPOSALS}, f AS (SELECT *, score * (1 - target / 100) AS final FROM r WHERE reason IS NULL AND score * (1 - target / 100) >= 0.001),
    o AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY slot, target ORDER BY final DESC, place) = 1)
    SELECT slot, edge, target, round(final, 6) AS final, row_number() OVER (PARTITION BY slot ORDER BY final DESC, place)::INT AS rank FROM o QUALIFY row_number() OVER (PARTITION BY slot ORDER BY final DESC, place) <= 8""")
def contextual_match(spark, sf):
    """Two-key matches, multiplied by their targets' support, distinct by target and capped after full ranking."""
    cues, slots = proposed(spark, sf)
    support = spark.range(37).select(F.col("id").alias("target"), (1 - F.col("id") / 100).alias("support"))
    return C.search(cues, slots, support, 0.001, 8, 12, "cn", "geomean", 0.05, 0.05).withColumn("final", F.round("final", 6))


@query("contextual_rejections", f"""WITH {_PROPOSALS} SELECT coalesce(reason, 'kept') AS reason, count(*) AS n FROM r GROUP BY 1""")
def contextual_rejections(spark, sf):
    return C.rejections(*proposed(spark, sf), "cn", "geomean", 0.05, 0.05)


@query("proposal_keys", f"""WITH {EDGES} SELECT association_id, sha256(from_id || chr(31) || to_id || chr(31) || polarity) AS proposal_key FROM edges""")
def proposal_keys(spark, sf):
    return edges(spark, sf).select("association_id", C.proposal_key("from_id", "to_id", "polarity").alias("proposal_key"))


def contributions(spark, sf, requests=100):
    """Requests are customers' order priorities: an order's line items support needs named by return flag and ship year."""
    o = table(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") % requests).alias("request"))
    return table(spark, sf, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("request", F.col("l_orderkey").alias("episode"), F.col("l_partkey").alias("edge_id"), F.concat("l_returnflag", F.year("l_shipdate").cast("string")).alias("need"), F.col("l_linestatus").alias("route"), (F.col("l_quantity") / 50).alias("relevance"), F.col("l_quantity").cast("long").alias("tokens"))


_CONTRIB = """c AS (SELECT o_custkey % 100 AS request, l_orderkey AS episode, l_partkey AS edge_id, l_returnflag || year(l_shipdate) AS need, l_linestatus AS route, l_quantity / 50 AS relevance, l_quantity::BIGINT AS tokens
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


@query("contribution_aggregate", f"""WITH {_CONTRIB} SELECT request, episode, array_to_string(list_sort(list_distinct(list(route))), ',') AS routes, len(list_distinct(list(need))) AS needs, round(max(relevance), 6) AS relevance, max(tokens) AS tokens FROM c GROUP BY ALL""")
def contribution_aggregate(spark, sf):
    a = E.aggregate_contributions(contributions(spark, sf))
    return a.select("request", "episode", F.array_join("routes", ",").alias("routes"), F.size("needs").cast("long").alias("needs"), F.round("relevance", 6).alias("relevance"), "tokens")


@query("coverage_state", f"""WITH {_CONTRIB}, s AS (SELECT DISTINCT request, left(need, 1) AS need, substr(need, 2) AS clause FROM c WHERE tokens > 45),
    q AS (SELECT request, need, CASE WHEN need = 'A' THEN 'joint' ELSE 'alternative' END AS mode, list_distinct(list(clause)) AS clauses FROM (SELECT request, left(need, 1) AS need, substr(need, 2) AS clause FROM c WHERE edge_id % 10 = 0) GROUP BY ALL)
    SELECT q.request, q.need, mode, CASE WHEN mode = 'joint' THEN count(s.clause) = len(any_value(clauses)) ELSE count(s.clause) > 0 END AS covered, count(s.clause) AS held
    FROM q LEFT JOIN s ON s.request = q.request AND s.need = q.need AND list_contains(clauses, s.clause) GROUP BY q.request, q.need, mode""")
def coverage_state(spark, sf):
    """Needs are return flags with ship years as clauses: A wants all of them, others any."""
    c = contributions(spark, sf)
    mode = F.when(F.substring("need", 1, 1) == "A", "joint").otherwise("alternative")
    supports = c.select("request", F.substring("need", 1, 1).alias("need"), mode.alias("mode"), F.substring("need", 2, 9).alias("clause"), (F.col("tokens") > 45).alias("verified"))
    wanted = c.where("edge_id % 10 = 0").groupBy("request", F.substring("need", 1, 1).alias("need"), mode.alias("mode")).agg(F.collect_set(F.substring("need", 2, 9)).alias("clauses"))
    return E.coverage_state(supports, wanted).select("request", "need", "mode", "covered", F.size("held").cast("long").alias("held"))


@query("masked_delta", f"""WITH {_CONTRIB}, t AS (SELECT DISTINCT request, need FROM c), m AS (SELECT DISTINCT request, need FROM c WHERE edge_id % 5 <> 0 UNION SELECT DISTINCT request, 'extra' FROM c WHERE request % 10 = 0)
    SELECT request, count(*) FILTER (WHERE NOT l) AS gained, count(*) FILTER (WHERE l) AS lost, CASE WHEN count(*) FILTER (WHERE l) > 0 THEN 'harmful' WHEN count(*) FILTER (WHERE NOT l) > 0 THEN 'sufficient' ELSE 'no_op' END AS verdict
    FROM (SELECT DISTINCT request FROM c) LEFT JOIN (SELECT request, need, false AS l FROM t ANTI JOIN m USING (request, need) UNION ALL SELECT request, need, true FROM m ANTI JOIN t USING (request, need)) USING (request) GROUP BY request""")
def masked_delta(spark, sf):
    """What requests gain or lose by every fifth edge; some masked sides hold a need that the treatment lacks."""
    c = contributions(spark, sf)
    hidden = c.where("edge_id % 5 = 0").select("edge_id").distinct()
    needs = lambda df: df.groupBy("request").agg(F.collect_set("need").alias("needs"))
    masked = E.mask(c, hidden).select("request", "need").unionByName(c.where("request % 10 = 0").select("request", F.lit("extra").alias("need")))
    return E.masked_delta(needs(c), needs(masked)).select("request", F.size("gained").cast("long").alias("gained"), F.size("lost").cast("long").alias("lost"), "verdict")


@query("edge_attribution", f"""WITH {_CONTRIB}, w AS (SELECT DISTINCT request, CASE WHEN edge_id % 3 = 0 THEN NULL ELSE edge_id END AS edge_id, need FROM c),
    h AS (SELECT request, need, count(*) AS holders, bool_or(edge_id IS NULL) AS base FROM w GROUP BY ALL)
    SELECT request, edge_id, count(*) AS needs, bool_or(NOT base) AS sufficient, bool_or(holders = 1) AS necessary FROM w JOIN h USING (request, need) WHERE edge_id IS NOT NULL GROUP BY ALL""")
def edge_attribution(spark, sf):
    """Single-edge and leave-one-out attribution over all edges; edges divisible by three stand for the base."""
    c = contributions(spark, sf).withColumn("edge_id", F.when(F.col("edge_id") % 3 != 0, F.col("edge_id")))
    return E.attribution(c, c).select("request", "edge_id", "needs", "sufficient", "necessary")


_COUNT = "len(list_filter({h}, lambda n: n[1] = '{k}'))"
_REQUIRED = "(CASE WHEN a.na > 0 AND {a} = a.na THEN 1 ELSE 0 END + CASE WHEN {r} > 0 THEN 1 ELSE 0 END)"


def _need(h: str) -> tuple[str, str, str]:
    """(complete required needs, clauses of the joint need, complete optional needs) of held clauses."""
    a, r, n = (_COUNT.format(h=h, k=k) for k in "ARN")
    return _REQUIRED.format(a=a, r=r), a, f"CASE WHEN {n} > 0 THEN 1 ELSE 0 END"


_OLD, _NEW = _need("a.held"), _need("list_distinct(a.held || c.held)")
_OWN = "STRUCT(id BIGINT, held VARCHAR[], tokens BIGINT, q DOUBLE)[]"
_BLANK = f"l := []::{_OWN}, held := []::VARCHAR[], chosen := []::BIGINT[], nt := 0::BIGINT, na := 0::BIGINT, nr := 0::BIGINT, nn := 0::BIGINT, stop := ''"
_KEEP = "l := a.l, held := a.held, chosen := a.chosen, nt := a.nt, na := a.na, nr := a.nr, nn := a.nn"


@query("greedy_selection", f"""WITH {_CONTRIB.replace(' % 100', '')}, n AS (SELECT request, episode AS id, list_distinct(list(need)) AS held, max(tokens) AS tokens, max(relevance) AS q FROM c GROUP BY ALL),
    w AS (SELECT request, count(DISTINCT CASE WHEN need[1] = 'A' THEN need END) AS na, max(CASE WHEN need[1] = 'R' THEN 1 ELSE 0 END) AS nr, max(CASE WHEN need[1] = 'N' THEN 1 ELSE 0 END) AS nn FROM c GROUP BY request),
    r AS (SELECT request, list(struct_pack(id := id, held := held, tokens := tokens, q := q)) AS own FROM n GROUP BY request),
    s AS (SELECT request, list_reduce(list_transform(range(14), lambda i: struct_pack({_BLANK})), lambda a, x: CASE WHEN a.stop <> '' THEN a
        WHEN {_OLD[0]} = CASE WHEN a.na > 0 THEN 1 ELSE 0 END + a.nr AND {_OLD[2]} = a.nn THEN struct_pack({_KEEP}, stop := 'complete')
        WHEN len(a.chosen) = 12 THEN struct_pack({_KEEP}, stop := 'episode_budget') WHEN len(a.l) = 0 THEN struct_pack({_KEEP}, stop := 'exhausted')
        WHEN len(list_filter(a.l, lambda c: a.nt + c.tokens <= 900)) = 0 THEN struct_pack({_KEEP}, stop := 'budget')
        ELSE list_transform([list_min(list_transform(list_filter(a.l, lambda c: a.nt + c.tokens <= 900), lambda c: struct_pack(r := {_OLD[0]} - {_NEW[0]}, j := {_OLD[1]} - {_NEW[1]}, o := {_OLD[2]} - {_NEW[2]}, t := c.tokens, q := -c.q, id := c.id, c := c)))],
            lambda b: CASE WHEN b.r = 0 AND b.j = 0 AND b.o = 0 THEN struct_pack({_KEEP}, stop := 'no_gain')
                ELSE struct_pack(l := list_filter(a.l, lambda c: c.id <> b.id), held := list_distinct(a.held || b.c.held), chosen := a.chosen || [b.id], nt := a.nt + b.t, na := a.na, nr := a.nr, nn := a.nn, stop := '') END)[1] END,
        struct_pack(l := own::{_OWN}, held := []::VARCHAR[], chosen := []::BIGINT[], nt := 0::BIGINT, na := na::BIGINT, nr := nr::BIGINT, nn := nn::BIGINT, stop := '')) AS a FROM r JOIN w USING (request))
    SELECT request, array_to_string(a.chosen, ',') AS chosen, a.stop AS stop, ({_OLD[0]})::BIGINT AS covered FROM s""")
def greedy_selection(spark, sf):
    """Lexicographic greedy selection within budgets, a request for each customer; tested against exhaustive search."""
    c = contributions(spark, sf, 1 << 40)
    supports = c.select("request", "episode", F.substring("need", 1, 1).alias("need"), F.substring("need", 2, 9).alias("clause"), (F.substring("need", 1, 1) == "A").alias("joint"), "tokens", "relevance").withColumn("facts", F.lit(1).cast("long"))
    chosen = E.select_v3(supports.withColumn("required", F.col("need") != "N"), 12, 20, 900)
    return chosen.withColumn("chosen", F.array_join(F.col("chosen").cast("array<string>"), ","))


_PICK = """list_transform([list_min(list_transform(a.l, lambda c: struct_pack(
            v := -(10 * len(list_filter(c.req, lambda n: NOT list_contains(a.have, n))) + 2 * len(list_filter(c.opt, lambda n: NOT list_contains(a.have, n))) + c.d
                + CASE WHEN len(list_filter(c.ctx, lambda n: NOT list_contains(a.have, n))) > 0 THEN 0.5::DOUBLE ELSE 0 END + c.q - CASE WHEN list_contains(a.groups, c.g) THEN 0.5::DOUBLE ELSE 0 END),
            d := -c.d, id := c.id, c := c)))],
        lambda b: struct_pack(l := list_filter(a.l, lambda c: c.id <> b.id), have := CASE WHEN -b.v <= 0 THEN a.have ELSE a.have || b.c.req || b.c.opt || b.c.ctx END, groups := a.groups || [b.c.g],
            out := CASE WHEN -b.v <= 0 THEN a.out ELSE a.out || [struct_pack(id := b.id, step := (len(a.out) + 1)::BIGINT, value := (-b.v)::DOUBLE)] END, done := -b.v <= 0))[1]"""
_ROW = "STRUCT(id BIGINT, req VARCHAR[], opt VARCHAR[], ctx VARCHAR[], d BIGINT, q DOUBLE, g BIGINT)[]"
_EMPTY = f"l := []::{_ROW}, have := []::VARCHAR[], groups := []::BIGINT[], out := []::STRUCT(id BIGINT, step BIGINT, value DOUBLE)[], done := false"


@query("greedy_selection_v1", f"""WITH {_CONTRIB.replace(' % 100', '')}, n AS (SELECT request, episode AS id, list_distinct(list(need)) AS needs, max(relevance) AS q FROM c GROUP BY ALL),
    r AS (SELECT request, list(struct_pack(id := id, req := list_filter(needs, lambda x: x[1] = 'A'), opt := list_filter(needs, lambda x: x[1] = 'N'), ctx := list_filter(needs, lambda x: x[1] = 'R'), d := id % 2, q := q, g := id % 7)) AS own FROM n GROUP BY request),
    s AS (SELECT request, list_reduce(list_transform(own, lambda x: struct_pack({_EMPTY})), lambda a, x: CASE WHEN a.done OR len(a.l) = 0 THEN a ELSE {_PICK} END,
        struct_pack({_EMPTY.replace(f'[]::{_ROW}', f'own::{_ROW}', 1)})) AS z FROM r)
    SELECT request, o.id AS id, o.step AS step, round(o.value, 8) AS value FROM (SELECT request, unnest(z.out) AS o FROM s)""")
def greedy_selection_v1(spark, sf):
    """Value-greedy selection, a request for each customer; tested against a plain version."""
    c = contributions(spark, sf, 1 << 40)
    a = E.aggregate_contributions(c)
    rows = a.select("request", F.col("episode").alias("id"), F.filter("needs", lambda n: n.startswith("A")).alias("required"), F.filter("needs", lambda n: n.startswith("N")).alias("optional"), F.filter("needs", lambda n: n.startswith("R")).alias("contextual"), (F.col("episode") % 2).alias("direct"), F.col("relevance").alias("quality"), F.lit(0.0).alias("redundancy"), (F.col("episode") % 7).alias("group"))
    return E.select_v1(rows).withColumn("value", F.round("value", 8))


@query("probation_lifecycle", f"""WITH {_EVENTS}, e AS (SELECT user_id AS id, ts, event_id, CASE event_type WHEN 'signup' THEN 'created' WHEN 'purchase' THEN 'success' WHEN 'error' THEN 'harm' ELSE 'noop' END AS kind, k FROM ev WHERE ts <= TIMESTAMP '2024-01-20'),
    born AS (SELECT id, min((ts, event_id)) AS f, min(ts) AS born, min(ts) + INTERVAL 3 DAY AS ends FROM e WHERE kind = 'created' GROUP BY id),
    once AS (SELECT * FROM e JOIN born USING (id) WHERE kind <> 'created' AND (ts, event_id) > f QUALIFY row_number() OVER (PARTITION BY id, k ORDER BY ts, event_id) = 1),
    nth AS (SELECT id, ts AS proved FROM once WHERE kind = 'success' AND ts < ends QUALIFY row_number() OVER (PARTITION BY id ORDER BY ts, event_id) = 2),
    g AS (SELECT id, list(CASE kind WHEN 'success' THEN 1.0 WHEN 'harm' THEN -1.0 ELSE 0.0 END::DOUBLE ORDER BY ts, event_id) AS s FROM once LEFT JOIN nth USING (id) WHERE proved IS NOT NULL OR ts < ends GROUP BY id)
    SELECT id, CASE WHEN proved IS NOT NULL THEN 'active' WHEN ends <= TIMESTAMP '2024-01-20' THEN 'retired' ELSE 'probation' END AS lifecycle,
        strftime(CASE WHEN proved IS NOT NULL THEN proved WHEN ends <= TIMESTAMP '2024-01-20' THEN ends ELSE born END, '%Y-%m-%d %H:%M:%S.%f') AS since,
        round(coalesce(list_reduce(s, lambda w, x: CASE WHEN x > 0 THEN w * 0.8::DOUBLE + 0.2::DOUBLE WHEN x < 0 THEN w * 0.5::DOUBLE ELSE w * 0.98::DOUBLE END, 0::DOUBLE), 0), 8) AS weight, coalesce(len(s), 0)::BIGINT AS events
    FROM born LEFT JOIN nth USING (id) LEFT JOIN g USING (id)""")
def probation_lifecycle(spark, sf):
    """Edges (users) on probation for three days from their first signup: two purchases of different queries in that time make them active; as of a day."""
    kind = F.when(F.col("event_type") == "signup", "created").when(F.col("event_type") == "purchase", "success").when(F.col("event_type") == "error", "harm").otherwise("noop")
    rows = events(spark, sf).select(F.col("user_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), kind.alias("kind"), F.col("k").cast("string").alias("query_hash"))
    return P.lifecycle(rows, "2024-01-20", 3 * 86_400).select("id", "lifecycle", F.date_format("since", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("since"), F.round("weight", 8).alias("weight"), "events")
