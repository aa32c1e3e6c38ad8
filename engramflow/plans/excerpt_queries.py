"""Excerpts, receipts and windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import excerpts as X
from ..operators import graph, lexical
from .bindings import EDGES, edges, table
from .registry import query


@query("learned_edge_receipts", """SELECT doc_id % 300 AS edge FROM documents WHERE length(text) >= 10 GROUP BY 1 HAVING bool_and(doc_id % 4 <> 1 AND doc_id % 9 <> 5)""")
def learned_edge_receipts(spark, sf):
    """Edges whose learned evidence still holds: a quarter of it has an old hash, a ninth no source."""
    d = table(spark, sf, "documents").where("length(text) >= 10")
    digest = F.when(F.col("doc_id") % 4 == 1, F.sha2(F.lit("old"), 256)).otherwise(F.sha2("text", 256))
    rows = d.select((F.col("doc_id") % 300).alias("edge"), F.col("doc_id").alias("source_id"), digest.alias("source_hash"), F.lit(2).alias("start"), F.lit(5).alias("length"), F.substring("text", 3, 5).alias("quote"))
    return X.valid_learned_edges(rows, d.where("doc_id % 9 <> 5").select(F.col("doc_id").alias("source_id"), "text"))


@query("record_resolution", """SELECT status, count(*) AS n FROM (SELECT CASE WHEN doc_id % 8 = 0 THEN 'missing_source' WHEN length(text) < 30 THEN 'outside' WHEN doc_id % 5 = 2 THEN 'changed' ELSE 'resolved' END AS status FROM documents) GROUP BY status""")
def record_resolution(spark, sf):
    d = table(spark, sf, "documents")
    digest = F.when(F.col("doc_id") % 5 == 2, F.sha2(F.lit("x"), 256)).otherwise(F.sha2(F.substring("text", 11, 20), 256))
    refs = d.select(F.col("doc_id").alias("record_id"), F.col("doc_id").alias("source_id"), F.lit(10).cast("long").alias("start"), F.lit(30).cast("long").alias("end"), digest.alias("digest"))
    return X.resolve_records(refs, d.where("doc_id % 8 <> 0").select(F.col("doc_id").alias("source_id"), "text")).groupBy("status").agg(F.count("*").alias("n"))


@query("protected_truncation", f"""WITH {EDGES} SELECT id, round(score, 6) AS score, protected FROM (SELECT association_id AS id, weight * confidence AS score, evidence_count > 1 AS protected FROM edges) ORDER BY protected DESC, score DESC, id LIMIT 200""")
def protected_truncation(spark, sf):
    """The 200 best candidates, those with repeated evidence first to stay (the limit is the feature)."""
    e = edges(spark, sf).select(F.col("association_id").alias("id"), (F.col("weight") * F.col("confidence")).alias("score"), (F.col("evidence_count") > 1).alias("protected"))
    return graph.protected_truncation(e, 200).withColumn("score", F.round("score", 6))


@query("growth_gate", f"""WITH {EDGES} SELECT from_id AS request, association_id AS edge FROM edges WHERE association_id % 2 = 0 AND weight > 0.6 AND from_id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')""")
def growth_gate(spark, sf):
    e = edges(spark, sf).select(F.col("from_id").alias("request"), F.col("association_id").alias("edge"), "weight")
    new = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("request"))
    return X.growth_gate(e.where("edge % 2 = 0").drop("weight"), e.where("weight > 0.6"), new)


@query("open_windows", """WITH t AS (SELECT conv_id AS id, turn, sum(length(text)) OVER w - length(text) AS start, sum(length(text)) OVER w AS stop FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
    SELECT id, start::BIGINT AS start, stop::BIGINT AS stop FROM t WHERE NOT (start < 900 AND stop > 600) AND stop > start""")
def open_windows(spark, sf):
    """Turns that don't touch characters 600 to 900 of their conversation."""
    from .text_queries import turns

    t = turns(spark, sf).select("id", F.col("lo").alias("start"), F.col("hi").alias("end")).where("end > start")
    closed = t.select("id").distinct().withColumn("lo", F.lit(600)).withColumn("hi", F.lit(900))
    return X.open_spans(t, closed).withColumnRenamed("end", "stop")


_PICKED = "struct_pack(used := 0::BIGINT, got := []::BIGINT[], i := 0::BIGINT, n := 0::BIGINT)"


@query("source_excerpts", rf"""WITH d AS (SELECT doc_id AS id, coalesce(text, '') AS text FROM documents),
    b AS (SELECT id, text, list_filter(list_transform(regexp_split_to_array(text, '\n[ \t]*\n'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS r FROM d WHERE length(text) BETWEEN 3001 AND 3999),
    h AS (SELECT *, list_filter(range(1, len(r) + 1), lambda i: contains(lower(r[i]), 'the') OR contains(lower(r[i]), 'der')) AS hits FROM b),
    f AS (SELECT *, list_filter(flatten(list_transform(hits, lambda i: [i, i - 1, i + 1])), lambda i: i BETWEEN 1 AND len(r)) AS p FROM h),
    g AS (SELECT *, list_filter(p, lambda v, i: list_position(p, v) = i)[:12] AS q FROM f),
    e AS (SELECT id, text, r, list_reduce(list_transform(q, lambda v: struct_pack(used := 0::BIGINT, got := []::BIGINT[], i := v::BIGINT, n := length(r[v]) + 2)), lambda a, x:
        CASE WHEN a.used + x.n <= 3000 THEN struct_pack(used := a.used + x.n, got := a.got || [x.i], i := x.i, n := x.n) ELSE a END, {_PICKED}) AS z FROM g),
    x AS (SELECT id, CASE WHEN len(z.got) > 0 THEN array_to_string(list_transform(list_sort(z.got), lambda i: r[i]), chr(10) || chr(10)) ELSE text[:1497] || chr(10) || '...' || chr(10) || text[-1497:] END AS excerpt FROM e
        UNION ALL SELECT id, CASE WHEN length(text) <= 3000 THEN text ELSE substr(text, 4000, 80) END FROM d WHERE length(text) NOT BETWEEN 3001 AND 3999)
    SELECT id, length(excerpt) AS chars, sha256(excerpt) AS sha256 FROM x""")
def source_excerpts(spark, sf):
    """Excerpts of 3000 characters around quotes; tested on small texts."""
    d = table(spark, sf, "documents")
    rows = d.select(F.col("doc_id").alias("id"), "text", F.array(F.substring("text", 4000, 80)).alias("quotes"), F.array(F.lit("the"), F.lit("der")).alias("keywords"))
    return X.excerpts(rows).select("id", F.length("excerpt").cast("long").alias("chars"), F.sha2("excerpt", 256).alias("sha256"))


@query("sparse_search")
def sparse_search(spark, sf):
    """Anchors, trigrams and bigrams fused; benchmark items are the questions."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "source", "text")
    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.concat(F.lit('"'), F.substring("text", 1, 20), F.lit('" '), F.col("text")).alias("text"))
    return lexical.sparse_search(docs, asked, 10).select("query_id", "id", F.round("score", 6).alias("score"), "rank")
