"""Segmentation, metrics, lookups, audits and extensions over documents, conversations, orders and events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators import segments as S
from .bindings import EDGES, TEMPORAL, edges, table, temporal
from .learning_queries import events
from .registry import query


def texts(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")


@query("record_spans", r"""WITH b AS (SELECT doc_id AS id, unnest(regexp_split_to_array(text, '\n[ \t]*\n')) AS part FROM documents WHERE text NOT LIKE '%[record: %')
    SELECT id, count(*) AS records, sum(length(part))::BIGINT AS chars FROM (SELECT id, regexp_replace(part, '^\s+|\s+$', '', 'g') AS part FROM b) WHERE part <> '' GROUP BY id""")
def record_spans(spark, sf):
    """Blank-line records of documents without markers."""
    r = S.explode_texts(texts(spark, sf).where("text NOT LIKE '%[record: %'"), "records")
    return r.groupBy("id").agg(F.count("*").alias("records"), F.sum(F.length("text")).alias("chars"))


_SIZES = "coalesce(list_sum(list_transform({0}, lambda y: length(y))), 0)"
_BEGIN = "out := []::VARCHAR[][], now := []::VARCHAR[], fresh := 0"


@query("paragraphs", rf"""WITH r AS (SELECT doc_id AS id, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS l FROM documents),
    s AS (SELECT id, list_reduce(list_transform(l, lambda x: struct_pack({_BEGIN}, r := x)), lambda a, x:
        CASE WHEN a.fresh > 0 AND ({_SIZES.format("a.now")} + 2 * len(a.now) >= 900 OR {_SIZES.format("a.now")} + 2 * len(a.now) + length(x.r) > 1400)
             THEN struct_pack(out := a.out || [a.now], now := list_filter(a.now, lambda y, i: list_sum(list_transform(a.now[i:], lambda z: length(z) + 2)) - 2 <= 200) || [x.r], fresh := 1, r := '')
             ELSE struct_pack(out := a.out, now := a.now || [x.r], fresh := a.fresh + 1, r := '') END, struct_pack({_BEGIN}, r := '')) AS a FROM r WHERE len(l) > 0),
    o AS (SELECT id, CASE WHEN len(a.out) > 0 AND {_SIZES.format("a.now[len(a.now) - a.fresh + 1:]")} < 200 THEN a.out[:len(a.out) - 1] || [a.out[len(a.out)] || a.now[len(a.now) - a.fresh + 1:]] ELSE a.out || [a.now] END AS p FROM s)
    SELECT id, part, length(t) AS chars, sha256(t) AS sha256 FROM (SELECT id, array_to_string(q, chr(10) || chr(10)) AS t, part FROM (SELECT id, unnest(p) AS q, generate_subscripts(p, 1) - 1 AS part FROM o))""")
def paragraphs(spark, sf):
    """ParagraphSegmenter over documents' lines as records; with records of a line each."""
    lines = texts(spark, sf).withColumn("text", F.regexp_replace("text", "\n", "\n\n"))
    return S.explode_texts(lines, "paragraphs").select("id", "part", F.length("text").cast("long").alias("chars"), F.sha2("text", 256).alias("sha256"))


@query("chunks", """SELECT doc_id AS id, length(text)::BIGINT AS chars FROM documents WHERE length(text) > 0""")
def chunks(spark, sf):
    """Chunks of at most 2000 characters lose nothing: their lengths add up."""
    c = S.explode_texts(texts(spark, sf), "chunks")
    return c.groupBy("id").agg(F.sum(F.length("text")).alias("chars"))


_BLOCK = "STRUCT(p BIGINT, n BIGINT, b INTEGER)[]"
_START = f"out := []::{_BLOCK}[], now := []::{_BLOCK}, fresh := 0::BIGINT"
_SIZE = "coalesce(list_sum(list_transform({0}, lambda y: y.n + 2)), 0)"
_CARRY = f"list_filter(a.now, lambda y, i: i > 1 AND {_SIZE.format('a.now[i:]')} <= CASE WHEN i = len(a.now) THEN 1600 ELSE 800 END)"
_SOFT = f"list_max(list_filter(range(len(a.now) - a.fresh + 1, len(a.now)), lambda k: a.now[k + 1].b >= 2 AND {_SIZE.format('a.now[:k]')} >= 3000))"
_CLOSED = "struct_pack(out := a.out || [a.now], now := {0} || [x.r], fresh := 1::BIGINT, r := x.r)"


@query("natural_segments", f"""WITH d AS (SELECT source AS source_key, list(struct_pack(p := doc_id, n := length(coalesce(text, '')), b := CASE WHEN n_chars > 8000 THEN 3 WHEN n_chars > 3000 THEN 2 ELSE 0 END) ORDER BY doc_id) AS l FROM documents GROUP BY source),
    s AS (SELECT source_key, list_reduce(list_transform(l, lambda x: struct_pack({_START}, r := x)), lambda a, x: CASE
        WHEN a.fresh > 0 AND x.r.b >= 3 THEN {_CLOSED.format(f"[]::{_BLOCK}")}
        WHEN a.fresh > 0 AND {_SIZE.format("a.now")} + x.r.n + 2 > 8000 THEN {_CLOSED.format(_CARRY)}
        WHEN a.fresh > 0 AND {_SIZE.format("a.now")} >= 6000 AND (x.r.b >= 2 OR {_SOFT} IS NULL) THEN {_CLOSED.format(_CARRY)}
        WHEN a.fresh > 0 AND {_SIZE.format("a.now")} >= 6000 THEN struct_pack(out := a.out || [a.now[:{_SOFT}]], now := a.now[{_SOFT} + 1:] || [x.r], fresh := len(a.now) - {_SOFT} + 1, r := x.r)
        ELSE struct_pack(out := a.out, now := a.now || [x.r], fresh := a.fresh + 1, r := x.r) END, struct_pack({_START}, r := l[1])) AS a FROM d),
    o AS (SELECT source_key, CASE WHEN a.fresh > 0 THEN a.out || [a.now] ELSE a.out END AS p FROM s)
    SELECT source_key, segment_index, len(q) AS blocks, (length('[source_key: ' || source_key || ']' || chr(10) || '[segment_index: ' || segment_index || ']') + 2 + list_sum(list_transform(q, lambda y: y.n)) + 2 * (len(q) - 1))::BIGINT AS chars
    FROM (SELECT source_key, unnest(p) AS q, generate_subscripts(p, 1) - 1 AS segment_index FROM o)""")
def natural_segments(spark, sf):
    """Documents of a source as one file of blocks; a longer document starts a section."""
    d = table(spark, sf, "documents")
    boundary = F.when(F.col("n_chars") > 8000, 3).when(F.col("n_chars") > 3000, 2).otherwise(0)
    blocks = d.select(F.col("source").alias("source_key"), F.col("doc_id").alias("position"), F.col("text"), boundary.alias("boundary"), F.lit("prose").alias("style"), F.lit("body").alias("role"))
    s = S.segment_files(blocks)
    return s.select("source_key", "segment_index", F.size("positions").cast("long").alias("blocks"), F.length("text").cast("long").alias("chars"))


_TURNS = """t AS (SELECT conv_id AS id, turn AS record, sum(length(text)) OVER w - length(text) AS lo, sum(length(text)) OVER w AS hi FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
    win AS (SELECT DISTINCT conv_id AS id, 100 AS start, 700 AS stop FROM conversations)"""


def turns(spark, sf):
    w = Window.partitionBy("conv_id").orderBy("turn")
    hi = F.sum(F.length("text")).over(w)
    return table(spark, sf, "conversations").select(F.col("conv_id").alias("id"), F.col("turn").alias("record"), (hi - F.length("text")).alias("lo"), hi.alias("hi"))


@query("window_projection", f"""WITH {_TURNS}, h AS (SELECT *, lo >= start AND hi <= stop AS whole FROM win JOIN t USING (id) WHERE lo < stop AND hi > start)
    SELECT id, count(*) FILTER (WHERE whole) AS complete, count(*) FILTER (WHERE NOT whole) AS incomplete, least(700, coalesce(min(lo) FILTER (WHERE NOT whole AND lo >= start), 700))::BIGINT AS consumed_end FROM h GROUP BY id""")
def window_projection(spark, sf):
    """Turns as records of a conversation: those whole within characters 100 to 700."""
    t = turns(spark, sf)
    windows = t.select("id").distinct().withColumn("start", F.lit(100).cast("long")).withColumn("end", F.lit(700).cast("long"))
    p = S.project_window(t, windows)
    return p.select("id", F.size("complete").cast("long").alias("complete"), F.size("incomplete").cast("long").alias("incomplete"), "consumed_end")


@query("window_alignment", f"""WITH {_TURNS} SELECT id, least(100, min(lo))::BIGINT AS lo, greatest(700, max(hi))::BIGINT AS hi FROM win JOIN t USING (id) WHERE lo < stop AND hi > start GROUP BY id""")
def window_alignment(spark, sf):
    t = turns(spark, sf)
    windows = t.select("id").distinct().withColumn("start", F.lit(100).cast("long")).withColumn("end", F.lit(700).cast("long"))
    return S.align_window(t, windows).select("id", "lo", "hi")


@query("quote_verification", """WITH q AS (SELECT doc_id % 500 AS source_id, substr(text, 5, 40) AS quote, doc_id FROM documents)
    SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN d.text IS NULL THEN 'missing_source' WHEN trim(quote) = '' THEN 'empty' WHEN contains(d.text, quote) THEN 'verified' ELSE 'not_found' END AS outcome
    FROM q LEFT JOIN (SELECT * FROM documents WHERE doc_id % 9 <> 0) d ON d.doc_id = source_id) GROUP BY outcome""")
def quote_verification(spark, sf):
    """Quotes looked for in a source; some sources are missing and most quotes are from elsewhere."""
    d = table(spark, sf, "documents")
    quotes = d.select((F.col("doc_id") % 500).alias("source_id"), F.substring("text", 5, 40).alias("quote"))
    return S.verify_quotes(quotes, d.where("doc_id % 9 <> 0").select(F.col("doc_id").alias("source_id"), "text")).groupBy("outcome").agg(F.count("*").alias("n"))


@query("coverage_gaps", """WITH l AS (SELECT doc_id AS id, i AS line FROM (SELECT doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)),
    f AS (SELECT * FROM l WHERE line % 9 NOT IN (0, 1)), g AS (SELECT id, line, line - row_number() OVER (PARTITION BY id ORDER BY line) AS i FROM f)
    SELECT id, min(line) AS first, max(line) AS last, count(*) AS n FROM g GROUP BY id, i HAVING count(*) >= 6""")
def coverage_gaps(spark, sf):
    """Runs of six lines or more that no evidence span covers; spans are lines 9-10, 18-19, ... and line 1."""
    lines = texts(spark, sf).select("id", F.posexplode(F.split("text", "\n")).alias("line", "t")).select("id", (F.col("line") + 1).cast("long").alias("line"))
    last = lines.groupBy("id").agg(F.max("line").alias("m"))
    spans = last.select("id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m"), F.lit(9).cast("long"))).alias("first")).withColumn("last", F.col("first") + 1)
    return S.gaps(lines, spans, 6)


@query("table_counts", " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in ("documents", "embeddings", "orders", "lineitem", "part", "events", "conversations", "pages", "benchmark")))
def table_counts(spark, sf):
    """Application statistics: rows of each table."""
    out = None
    for t in ("documents", "embeddings", "orders", "lineitem", "part", "events", "conversations", "pages", "benchmark"):
        one = table(spark, sf, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("episodes_per_source", """SELECT n AS episodes, count(*) AS sources FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) GROUP BY n""")
def episodes_per_source(spark, sf):
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("episodes")).groupBy("episodes").agg(F.count("*").alias("sources"))


@query("task_counts", "SELECT event_type AS stage, value > 50 AS done, count(*) AS n FROM events GROUP BY ALL")
def task_counts(spark, sf):
    return events(spark, sf).groupBy(F.col("event_type").alias("stage"), (F.col("value") > 50).alias("done")).agg(F.count("*").alias("n"))


@query("sources_without_episodes", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def sources_without_episodes(spark, sf):
    """Customers as sources, pending orders as episodes."""
    return table(spark, sf, "customer").join(table(spark, sf, "orders").where("o_orderstatus = 'P'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("orphan_associations", f"""WITH {EDGES} SELECT association_id, from_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 100 <> 7) AS no_episode, to_id NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 50 <> 3) AS no_concept
    FROM edges WHERE from_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 100 <> 7) OR to_id NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 50 <> 3)""")
def orphan_associations(spark, sf):
    """Dangling endpoints, against node tables that lack some ids."""
    episodes = table(spark, sf, "orders").where("o_orderkey % 100 <> 7").select(F.col("o_orderkey").alias("from_id"), F.lit(False).alias("a"))
    concepts = table(spark, sf, "part").where("p_partkey % 50 <> 3").select(F.col("p_partkey").alias("to_id"), F.lit(False).alias("b"))
    j = edges(spark, sf).join(episodes, "from_id", "left").join(concepts, "to_id", "left")
    return j.where("a IS NULL OR b IS NULL").select("association_id", F.col("a").isNull().alias("no_episode"), F.col("b").isNull().alias("no_concept"))


@query("concepts_without_links", f"""WITH {EDGES} SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT to_id FROM edges WHERE evidence_count > 1)""")
def concepts_without_links(spark, sf):
    """Concepts that no reinforced edge touches, edges being seen from both ends."""
    e = edges(spark, sf).where("evidence_count > 1")
    touched = e.select(F.col("to_id").alias("p_partkey")).unionByName(e.select((-1 - F.col("from_id")).alias("p_partkey")))
    return table(spark, sf, "part").join(touched, "p_partkey", "left_anti").select("p_partkey")


@query("edge_endpoint_projection", f"""WITH {EDGES} SELECT association_id, o_orderpriority AS from_text, p_name AS to_text FROM edges LEFT JOIN orders ON o_orderkey = from_id LEFT JOIN part ON p_partkey = to_id""")
def edge_endpoint_projection(spark, sf):
    return edges(spark, sf).join(table(spark, sf, "orders"), F.col("from_id") == F.col("o_orderkey"), "left").join(table(spark, sf, "part"), F.col("to_id") == F.col("p_partkey"), "left").select("association_id", F.col("o_orderpriority").alias("from_text"), F.col("p_name").alias("to_text"))


@query("temporal_edges_of_scope", f"""WITH {TEMPORAL} SELECT scope, from_id, to_id, date_diff('day', a.o_orderdate, b.o_orderdate)::INT AS days FROM temporal JOIN orders a ON a.o_orderkey = from_id JOIN orders b ON b.o_orderkey = to_id WHERE a.o_custkey = scope AND b.o_custkey = scope""")
def temporal_edges_of_scope(spark, sf):
    o = table(spark, sf, "orders")
    a = o.select(F.col("o_orderkey").alias("from_id"), F.col("o_custkey").alias("scope"), F.col("o_orderdate").alias("d1"))
    b = o.select(F.col("o_orderkey").alias("to_id"), F.col("o_custkey").alias("scope"), F.col("o_orderdate").alias("d2"))
    return temporal(spark, sf).join(a, ["from_id", "scope"]).join(b, ["to_id", "scope"]).select("scope", "from_id", "to_id", F.date_diff("d2", "d1").alias("days"))


@query("timeline_listing", """SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderdate END ASC NULLS LAST, o_orderkey)::INT AS place FROM orders""")
def timeline_listing(spark, sf):
    """Story order with nulls (pending orders) last."""
    order = F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate"))
    return table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy(order.asc_nulls_last(), "o_orderkey")).alias("place"))


@query("live_edges", f"""WITH {EDGES} SELECT association_id, from_id, to_id FROM edges WHERE polarity > 0 AND weight > 0 AND (to_id % 4 <> 0 OR to_id IN (SELECT p_partkey FROM part WHERE p_size > 25))""")
def live_edges(spark, sf):
    """Not retired, positive weight, and recall edges only with a valid receipt."""
    e = edges(spark, sf).where("polarity > 0 AND weight > 0")
    valid = table(spark, sf, "part").where("p_size > 25").select(F.col("p_partkey").alias("to_id"))
    return e.where("to_id % 4 <> 0").unionByName(e.where("to_id % 4 = 0").join(valid, "to_id", "left_semi").select(*e.columns)).select("association_id", "from_id", "to_id")


@query("recall_metrics", """WITH r AS (SELECT o_custkey AS run, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders),
    s AS (SELECT o_custkey AS run, o_orderpriority AS slot, o_orderkey AS id FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT run, slot, min(rank) AS best FROM s LEFT JOIN r USING (run, id) GROUP BY ALL)
    SELECT run, round(avg(CASE WHEN best <= 3 THEN 1.0 ELSE 0.0 END), 6) AS recall, count(*) AS slots, max(best)::INT AS question_rank FROM b GROUP BY run""")
def recall_metrics(spark, sf):
    """Recall at 3 by slot: a customer's orders ranked by price; slots are priorities of finished orders."""
    o = table(spark, sf, "orders").withColumn("run", F.col("o_custkey")).withColumn("id", F.col("o_orderkey"))
    ranked = o.select("run", "id", F.row_number().over(Window.partitionBy("run").orderBy(F.desc("o_totalprice"), "id")).alias("rank"))
    return M.slot_recall(ranked, o.where("o_orderstatus = 'F'").select("run", F.col("o_orderpriority").alias("slot"), "id"), 3).withColumn("recall", F.round("recall", 6))


@query("stability_report", """WITH g AS (SELECT user_id AS question, event_type AS slot, list_sort(list(value)) AS v, avg(CASE WHEN (props->>'$.k')::INT > 30 THEN 1.0 ELSE 0.0 END) AS rate FROM events GROUP BY ALL)
    SELECT question, slot, round(rate, 6) AS rate, rate > 0 AND rate < 1 AS unstable, round(list_avg(v), 6) AS mean_elapsed, v[round_even((len(v) - 1) * 0.95, 0)::INT + 1] AS p95_elapsed FROM g""")
def stability_report(spark, sf):
    """Hit rates and nearest-rank percentiles by question (user) and slot (event type)."""
    e = events(spark, sf).select(F.col("user_id").alias("question"), F.col("event_type").alias("slot"), F.col("event_id").alias("repeat"), (F.col("k") > 30).alias("hit"), F.col("value").alias("elapsed"))
    return M.stability(e).withColumn("rate", F.round("rate", 6)).withColumn("mean_elapsed", F.round("mean_elapsed", 6))


@query("log_summary", """WITH l AS (SELECT user_id * 1000 + (props->>'$.k')::BIGINT AS request_id, event_id AS seq, CASE event_type WHEN 'click' THEN 'request' WHEN 'error' THEN 'error' ELSE 'response' END AS kind, value FROM events),
    a AS (SELECT DISTINCT request_id FROM l WHERE kind = 'request'), o AS (SELECT request_id, arg_max(kind, seq) AS outcome, arg_max(value, seq) AS value FROM l WHERE kind <> 'request' GROUP BY request_id)
    SELECT coalesce(outcome, 'none') AS outcome, count(*) AS requests, round(avg(value), 6) AS mean_value, round(quantile_cont(value, 0.95), 6) AS p95_value FROM a LEFT JOIN o USING (request_id) GROUP BY 1""")
def log_summary(spark, sf):
    """Requests joined to their last outcome, with interpolated percentiles."""
    kind = F.when(F.col("event_type") == "click", "request").when(F.col("event_type") == "error", "error").otherwise("response")
    log = events(spark, sf).select((F.col("user_id") * 1000 + F.col("k")).alias("request_id"), F.col("event_id").alias("seq"), kind.alias("kind"), F.col("event_type").alias("stage"), "value")
    out = M.request_outcomes(log)
    return out.groupBy(F.coalesce("outcome", F.lit("none")).alias("outcome")).agg(F.count("*").alias("requests"), F.round(F.avg("value"), 6).alias("mean_value"), F.round(F.percentile("value", 0.95), 6).alias("p95_value"))


@query("frozen_alignment", """SELECT (SELECT count(*) FROM documents) AS frozen, (SELECT count(*) FROM documents WHERE doc_id % 10 = 3) AS missing, (SELECT count(*) FROM documents WHERE doc_id % 10 <> 3 AND lower(text) <> text) AS changed""")
def frozen_alignment(spark, sf):
    """Frozen candidates against a list that lacks some and has others in lower case."""
    d = texts(spark, sf)
    return M.frozen_alignment(d.where("id % 10 <> 3").withColumn("text", F.lower("text")), d)


@query("occurrence_merge", """SELECT p_name AS name, arg_max(p_partkey, (p_retailprice, length(p_type), p_partkey)) AS representative, array_to_string(list_sort(list_distinct(list(p_brand))), ',') AS aliases, max(p_retailprice) AS best FROM part GROUP BY p_name""")
def occurrence_merge(spark, sf):
    """Occurrences of a concept merged: the representative has the largest (price, type length, id); aliases are united."""
    return table(spark, sf, "part").groupBy(F.col("p_name").alias("name")).agg(
        F.max_by("p_partkey", F.struct("p_retailprice", F.length("p_type"), "p_partkey")).alias("representative"), F.array_join(F.array_sort(F.collect_set("p_brand")), ",").alias("aliases"), F.max("p_retailprice").alias("best")
    )


@query("new_edge_dedupe", """SELECT l_orderkey, l_partkey, max(1 - l_discount) AS confidence, count(*) AS drafts FROM lineitem GROUP BY ALL""")
def new_edge_dedupe(spark, sf):
    """Of the drafts of one (episode, concept) the highest confidence is kept."""
    return table(spark, sf, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.max(1 - F.col("l_discount")).alias("confidence"), F.count("*").alias("drafts"))


@query("page_text_cleaning", r"""SELECT page_id, length(trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')))::BIGINT AS chars, lower(regexp_extract(url, '^[a-z]+://([^/:?#]*)', 1)) AS host FROM pages""")
def page_text_cleaning(spark, sf):
    """Tags stripped and white space collapsed; the logical source key is the host."""
    text = F.trim(F.regexp_replace(F.regexp_replace("html", "<[^>]*>", " "), r"\s+", " "))
    return table(spark, sf, "pages").select("page_id", F.length(text).cast("long").alias("chars"), F.lower(F.regexp_extract("url", "^[a-z]+://([^/:?#]*)", 1)).alias("host"))


@query("need_verdicts", """WITH p AS (SELECT user_id AS need, CASE WHEN value > 250 THEN 'contradicted' WHEN value > 2 THEN 'supported' ELSE 'unknown' END AS v FROM events)
    SELECT need, CASE WHEN bool_or(v = 'contradicted') THEN 'refuted' WHEN bool_and(v = 'supported') THEN 'supported' WHEN bool_or(v = 'supported') THEN 'partial' ELSE 'unknown' END AS verdict FROM p GROUP BY need""")
def need_verdicts(spark, sf):
    """A contradicted premise refutes a need; all supported support it; any known makes it partial."""
    v = F.when(F.col("value") > 250, "contradicted").when(F.col("value") > 2, "supported").otherwise("unknown")
    p = events(spark, sf).select(F.col("user_id").alias("need"), v.alias("v"))
    verdict = F.when(F.bool_or(F.col("v") == "contradicted"), "refuted").when(F.bool_and(F.col("v") == "supported"), "supported").when(F.bool_or(F.col("v") == "supported"), "partial").otherwise("unknown")
    return p.groupBy("need").agg(verdict.alias("verdict"))


@query("active_feedback", """WITH c AS (SELECT user_id, max(event_id) AS commit_at FROM events WHERE event_type = 'purchase' GROUP BY user_id)
    SELECT user_id, (props->>'$.k')::BIGINT % 10 AS need, arg_max(event_type, event_id) AS verdict FROM events LEFT JOIN c USING (user_id) WHERE event_type <> 'purchase' AND event_id > coalesce(commit_at, -1) GROUP BY ALL""")
def active_feedback(spark, sf):
    """A commit (purchase) clears earlier verdicts of its session (user); the latest of each need wins."""
    e = events(spark, sf)
    commit = F.max(F.when(F.col("event_type") == "purchase", F.col("event_id"))).over(Window.partitionBy("user_id"))
    left = e.withColumn("c", commit).where("event_type <> 'purchase' AND event_id > coalesce(c, -1)")
    return left.groupBy("user_id", (F.col("k") % 10).alias("need")).agg(F.max_by("event_type", "event_id").alias("verdict"))


@query("event_windows", """SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def event_windows(spark, sf):
    """Extension: tumbling windows of event time (streaming.windowed is the same over a stream)."""
    from ..streaming.feedback import windowed

    return windowed(events(spark, sf)).withColumn("total", F.round("total", 4))


@query("grouping_sets", """SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderstatus), ())""")
def grouping_sets(spark, sf):
    """Extension: rollup."""
    return table(spark, sf, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("promotion_decision", f"""WITH {EDGES}, e AS (SELECT association_id, evidence_count > 1 AS reinforced, weight > 0.5 AS used, confidence >= 0.95 AS gain, polarity < 0 AS harm FROM edges)
    SELECT CASE WHEN NOT used THEN 'not_used' WHEN harm THEN 'harm' WHEN NOT gain THEN 'no_gain' ELSE 'promoted' END AS decision, count(*) AS n FROM e GROUP BY 1""")
def promotion_decision(spark, sf):
    """Ordered reasons for which a changed edge is not promoted."""
    d = F.when(~(F.col("weight") > 0.5), "not_used").when(F.col("polarity") < 0, "harm").when(~(F.col("confidence") >= 0.95), "no_gain").otherwise("promoted")
    return edges(spark, sf).groupBy(d.alias("decision")).agg(F.count("*").alias("n"))
