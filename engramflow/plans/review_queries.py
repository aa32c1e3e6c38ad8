"""Review, evaluation and point lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import review as R
from .bindings import EDGES, edges, table
from .registry import query


@query("fact_review", """WITH f AS (SELECT doc_id AS fact, doc_id AS id, substr(text, 10, 25) AS quote FROM documents), h AS (SELECT f.*, d.text, CASE WHEN length(quote) > 0 THEN (length(v) - length(replace(v, quote, ''))) // length(quote) ELSE 0 END AS n, v
    FROM f JOIN (SELECT doc_id, text, text AS v FROM documents) d ON d.doc_id = f.id)
    SELECT fact, id, CASE WHEN n = 0 THEN 'not_visible' WHEN n > 1 THEN 'ambiguous' ELSE 'accept' END AS status, CASE WHEN n = 1 THEN instr(v, quote) - 1 END::BIGINT AS start,
    CASE WHEN n = 1 THEN sha256(id || '|' || (instr(v, quote) - 1) || '|' || quote) END AS span_hash FROM h""")
def fact_review(spark, sf):
    """Quotes of documents that must be literally and once in the whole text, which is the visible window."""
    d = table(spark, sf, "documents")
    facts = d.select(F.col("doc_id").alias("fact"), F.col("doc_id").alias("id"), F.substring("text", 10, 25).alias("quote"))
    windows = d.select(F.col("doc_id").alias("id"), F.lit(0).cast("long").alias("start"), F.length("text").cast("long").alias("end"), "text")
    return R.review_facts(facts, windows)


@query("review_grounding", r"""WITH r AS (SELECT doc_id % 100 AS review, doc_id AS source_id, CASE WHEN doc_id % 3 = 0 THEN 'no such thing' ELSE lower(substr(text, 1, 30)) END AS quote, substr(text, 3, 6) AS part FROM documents)
    SELECT review, coalesce(bool_or(contains(lower(regexp_replace(text, '\s+', '', 'g')), lower(regexp_replace(quote, '\s+', '', 'g'))) AND contains(lower(regexp_replace(quote, '\s+', '', 'g')), lower(regexp_replace(part, '\s+', '', 'g')))), false) AS grounded
    FROM r LEFT JOIN documents d ON d.doc_id = source_id AND d.doc_id % 7 <> 0 GROUP BY review""")
def review_grounding(spark, sf):
    d = table(spark, sf, "documents")
    quote = F.when(F.col("doc_id") % 3 == 0, "no such thing").otherwise(F.lower(F.substring("text", 1, 30)))
    reviews = d.select((F.col("doc_id") % 100).alias("review"), F.col("doc_id").alias("source_id"), quote.alias("quote"), F.array(F.substring("text", 3, 6)).alias("parts"))
    return R.grounded(reviews, d.where("doc_id % 7 <> 0").select(F.col("doc_id").alias("source_id"), "text"))


@query("evidence_cache", """SELECT doc_id AS key, substr(text, 1, 10) AS quote FROM documents WHERE doc_id % 4 <> 1 AND doc_id % 6 <> 2 AND length(text) > 0""")
def evidence_cache(spark, sf):
    """Cached spans re-verified: a quarter has another source hash, others another place."""
    d = table(spark, sf, "documents").where("length(text) > 0")
    digest = F.when(F.col("doc_id") % 4 == 1, F.sha2(F.lit("old"), 256)).otherwise(F.sha2("text", 256))
    quote = F.when(F.col("doc_id") % 6 == 2, F.lit("\u0001")).otherwise(F.substring("text", 1, 10))
    cache = d.select(F.col("doc_id").alias("key"), F.col("doc_id").alias("source_id"), F.lit(0).alias("start"), F.length(quote).alias("length"), quote.alias("quote"), digest.alias("source_hash"))
    return R.cached_evidence(cache, d.select(F.col("doc_id").alias("source_id"), "text")).select("key", "quote")


@query("retrieval_evaluation", r"""WITH d AS (SELECT DISTINCT doc_id, text, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS k FROM (SELECT doc_id, text, ws, unnest(range(1, len(ws) - 1)) AS i FROM (SELECT *, regexp_split_to_array(text, '[ \n]+') AS ws FROM documents))),
    b AS (SELECT item_id AS question, text AS item, array_to_string(regexp_split_to_array(text, '[ \n]+')[1:3], ' ') AS k FROM benchmark),
    r AS (SELECT question, doc_id AS id, contains(text, item) AS gold, row_number() OVER (PARTITION BY question ORDER BY text <> item, abs(length(text) - length(item)), doc_id) AS rank FROM b JOIN d USING (k)),
    m AS (SELECT question, id, id % 2 AS grp FROM r WHERE gold),
    g AS (SELECT question, grp FROM b, (SELECT unnest([0, 1]) AS grp)), s AS (SELECT question, grp, min(rank) AS best FROM g LEFT JOIN (SELECT m.*, rank FROM m JOIN r USING (question, id)) USING (question, grp) GROUP BY ALL)
    SELECT question, round(avg(CASE WHEN best <= 20 THEN 1.0 ELSE 0.0 END), 6) AS recall, CASE WHEN count(best) = count(*) THEN max(best) END::INT AS rank FROM s GROUP BY question""")
def retrieval_evaluation(spark, sf):
    """Questions are benchmark items; documents with an item's first three words are ranked by length difference; gold are those that
    hold the item, in two groups by parity."""
    from pyspark.sql import Window

    words = F.split("text", "[ \n]+")
    three = lambda ws: F.transform(F.sequence(F.lit(0), F.size(ws) - 3), lambda i: F.concat_ws(" ", F.get(ws, i), F.get(ws, i + 1), F.get(ws, i + 2)))
    # split once a row: a lambda's variable is not worked out again for every word
    grams = F.transform(F.array(words), lambda ws: F.when(F.size(ws) > 2, three(ws)).otherwise(F.array().cast("array<string>")))[0]
    d = table(spark, sf, "documents").select("doc_id", "text")
    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("question"), F.col("text").alias("item"), F.array_join(F.slice(words, 1, 3), " ").alias("k"))
    found = d.select("doc_id", F.explode(F.array_distinct(grams)).alias("k")).join(b, "k").select("question", "item", "doc_id")
    pairs = found.join(d, "doc_id").select(
        "question", "doc_id", (F.col("text") != F.col("item")).alias("other"), F.abs(F.length("text") - F.length("item")).alias("away"), F.contains(F.col("text"), F.col("item")).alias("gold")
    )
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("question").orderBy("other", "away", "doc_id")))
    matches = ranked.where("gold").select("question", (F.col("doc_id") % 2).alias("group"), F.col("doc_id").alias("id"))
    groups = b.select("question", F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))).alias("group"))
    return R.evaluate_retrieval(ranked.select("question", F.col("doc_id").alias("id"), "rank"), matches, groups).withColumn("recall", F.round("recall", 6))


@query("growth_reuse", f"""WITH {EDGES}, u AS (SELECT to_id AS from_id, from_id AS to_id FROM edges WHERE association_id % 3 = 0 UNION SELECT from_id, to_id FROM edges WHERE association_id % 5 = 0)
    SELECT (SELECT count(*) FROM edges) AS grown, (SELECT count(DISTINCT e.association_id) FROM edges e JOIN u ON e.from_id = u.from_id AND e.to_id = u.to_id) AS ordered,
    (SELECT count(DISTINCT e.association_id) FROM edges e JOIN (SELECT least(from_id, to_id) AS a, greatest(from_id, to_id) AS b FROM u) u ON least(e.from_id, e.to_id) = a AND greatest(e.from_id, e.to_id) = b) AS unordered""")
def growth_reuse(spark, sf):
    e = edges(spark, sf)
    used = e.where("association_id % 3 = 0").select(F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id")).unionByName(e.where("association_id % 5 = 0").select("from_id", "to_id"))
    return R.growth_reuse(e.select(F.col("association_id").alias("id"), "from_id", "to_id"), used)


@query("evidence_scores", """WITH e AS (SELECT item_id AS question, lower(string_agg(d.text, chr(10))) AS a, list(DISTINCT d.source) AS seen FROM benchmark b JOIN documents d ON d.doc_id % 40 = b.item_id % 40 GROUP BY item_id)
    SELECT question, round((contains(a, 'the')::INT + contains(a, 'zzz')::INT) / 2, 6) AS terms, (contains(a, 'zzz') OR contains(a, 'der'))::INT::DOUBLE AS groups, (list_contains(seen, 'src0')::INT + list_contains(seen, 'src1')::INT) / 2 AS sources FROM e""")
def evidence_scores(spark, sf):
    """Terms, term groups and sources of a question's selected documents (those of its remainder by 40)."""
    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("question"))
    questions = b.select("question", F.array(F.lit("the"), F.lit("ZZZ")).alias("terms"), F.array(F.array(F.lit("zzz"), F.lit("Der"))).alias("term_groups"), F.array(F.lit("src0"), F.lit("src1")).alias("sources"))
    d = table(spark, sf, "documents").select((F.col("doc_id") % 40).alias("m"), "source", "text")
    chosen = b.withColumn("m", F.col("question") % 40).join(d, "m").select("question", "source", "text")
    return R.score_evidence(questions, chosen).withColumn("terms", F.round("terms", 6))


@query("get_many", """SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity = 50)""")
def get_many(spark, sf):
    """Rows by a set of ids."""
    ids = table(spark, sf, "lineitem").where("l_quantity = 50").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf, "orders").join(ids, "o_orderkey", "left_semi").select("o_orderkey", "o_custkey")


@query("reading_cursors", "SELECT doc_id, (CASE WHEN 2000 >= length(text) THEN 2000 ELSE greatest(1, 2000 - 400) END)::INT AS cursor FROM documents")
def reading_cursors(spark, sf):
    return table(spark, sf, "documents").select("doc_id", R.reading_cursor(F.lit(2000), F.length("text")).alias("cursor"))


@query("relation_order", f"""WITH {EDGES} SELECT association_id, row_number() OVER (PARTITION BY from_id ORDER BY evidence_count, polarity DESC, confidence DESC, weight DESC, to_id)::INT AS place FROM edges""")
def relation_order(spark, sf):
    """Relation drafts of an episode in their order."""
    e = edges(spark, sf).select("association_id", "from_id", "to_id", "polarity", "weight", "confidence", F.col("from_id").alias("batch"), F.col("evidence_count").alias("generation"), F.col("polarity").alias("claim_rank"), F.lit(0).alias("relation_rank"), F.lit("").alias("relation_key"), F.lit("").alias("text"))
    return R.relation_order(e).select("association_id", "place")
