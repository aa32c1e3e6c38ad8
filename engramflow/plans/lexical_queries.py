"""Lexical retrieval: documents as episodes with their sources, benchmark items as questions."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import lexical as L
from ..operators.cutting import shared_folder
from ..operators.posting_index import PostingIndex
from .bindings import table
from .registry import query


def docs(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "source", L.ascii_words(F.col("text")).alias("terms"))


def questions(spark, sf):
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), L.ascii_words(F.col("text")).alias("terms"))


_DOCS = """d AS (SELECT doc_id AS id, source, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda w: w <> '') AS terms FROM documents),
    q AS (SELECT item_id AS query_id, unnest(list_distinct(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda w: w <> ''))) AS term FROM benchmark)"""
_BM25 = f"""{_DOCS}, h AS (SELECT id, source, term, count(*) AS tf FROM (SELECT id, source, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
    t AS (SELECT count(DISTINCT source) AS s, avg(len(terms)) AS a FROM d), df AS (SELECT term, count(DISTINCT source) AS df FROM h GROUP BY term),
    bm AS (SELECT query_id, h.id, any_value(h.source) AS source, round(sum(ln(1 + (s - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len(d.terms) / a))), 9) AS score
           FROM h JOIN df USING (term) JOIN d USING (id) JOIN q USING (term), t GROUP BY query_id, h.id)"""


@query("bm25_topk", f"""WITH {_BM25} SELECT query_id, id, round(score, 6) AS score, rank FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM bm) WHERE rank <= 10""")
def bm25_topk(spark, sf):
    return L.bm25_top(docs(spark, sf), questions(spark, sf), 10).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query("postings_stats", f"""WITH {_DOCS}, p AS (SELECT id, source, term, count(*) AS tf FROM (SELECT id, source, unnest(terms) AS term FROM d) GROUP BY ALL)
    SELECT source, count(*) AS postings, count(DISTINCT term) AS terms, max(tf) AS most, sum(tf)::BIGINT AS tokens FROM p GROUP BY source""")
def postings_stats(spark, sf):
    """The posting table (id, term, tf) summed up by source."""
    return L.postings(docs(spark, sf)).groupBy("source").agg(F.count("*").alias("postings"), F.countDistinct("term").alias("terms"), F.max("tf").alias("most"), F.sum("tf").alias("tokens"))


_FUSED = f"""{_BM25}, m AS (SELECT query_id, id, source, score / max(score) OVER (PARTITION BY query_id) AS e FROM bm),
    sp AS (SELECT query_id, source, score / max(score) OVER (PARTITION BY query_id) AS s FROM (SELECT query_id, source, sum(score) AS score FROM bm GROUP BY ALL)),
    v AS (SELECT query_id, id, source, e + 0.35::DOUBLE * coalesce(s, 0) AS v FROM m LEFT JOIN sp USING (query_id, source)),
    b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY best DESC, first) AS place FROM (SELECT query_id, source, max(v) AS best, arg_max(id, (v, -id)) AS first FROM v GROUP BY ALL)),
    f AS (SELECT id, any_value(v.source) AS source, sum(v / best / (60 + place)) / (SELECT count(DISTINCT query_id) FROM bm) AS score FROM v JOIN b USING (query_id, source) GROUP BY id)"""


def fused(spark, sf):
    return L.lexical_votes(docs(spark, sf), questions(spark, sf))


@query("candidate_fusion", f"WITH {_FUSED} SELECT id, round(score, 7) AS score FROM f")
def candidate_fusion(spark, sf):
    """Fused candidates over all questions; all episodes with a term survive."""
    return fused(spark, sf).select("id", F.round("score", 7).alias("score"))


@query("source_representatives", f"WITH {_FUSED} SELECT source, id, round(score, 7) AS score FROM f QUALIFY row_number() OVER (PARTITION BY source ORDER BY score DESC, id) = 1")
def source_representatives(spark, sf):
    return L.representatives(fused(spark, sf)).select("source", "id", F.round("score", 7).alias("score"))


@query("channel_max_fusion", f"""WITH {_BM25}, c AS (SELECT query_id, id, 1.0 AS w, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM bm
    UNION ALL SELECT query_id, id, 1.1, score / len(terms), row_number() OVER (PARTITION BY query_id ORDER BY score / len(terms) DESC, id) FROM bm JOIN d USING (id))
    SELECT query_id, id, round(max(w / (60 + rank)), 6) AS score, round(max(score), 6) AS raw FROM c WHERE rank <= 20 GROUP BY ALL""")
def channel_max_fusion(spark, sf):
    """Two channels (BM25, BM25 by length) fused by the largest weight / (60 + rank), not by the sum."""
    own, asked = docs(spark, sf), questions(spark, sf)
    one = L.bm25_top(own, asked, 20).select("query_id", "id", F.lit(1.0).alias("weight"), "rank", F.col("score").alias("raw"))
    two = L.bm25_top(own, asked, 20, by_length=True).select("query_id", "id", F.lit(1.1).alias("weight"), "rank", F.col("score").alias("raw"))
    return L.channel_fusion(one.unionByName(two)).select("query_id", "id", F.round("score", 6).alias("score"), F.round("raw", 6).alias("raw"))


@query("cue_idf_search", f"""WITH {_DOCS}, c AS (SELECT id, unnest(list_distinct(terms)) AS f FROM d WHERE len(terms) > 0), n AS (SELECT count(*) AS n FROM d),
    i AS (SELECT f, ln((n + 1) / (count(*) + 0.5::DOUBLE)) AS idf FROM c, n GROUP BY f, n), dw AS (SELECT id, sum(idf) AS dw FROM c JOIN i USING (f) GROUP BY id),
    qi AS (SELECT query_id, term AS f, coalesce(idf, ln((n + 1) / 0.5::DOUBLE)) AS idf FROM q LEFT JOIN i ON term = f, n), qw AS (SELECT query_id, sum(idf) AS qw FROM qi GROUP BY query_id),
    s AS (SELECT query_id, id, sum(idf) AS o FROM qi JOIN c USING (f) GROUP BY ALL)
    SELECT query_id, id, round(score, 6) AS score FROM (SELECT query_id, id, sqrt(o / dw * o / qw) AS score FROM s JOIN dw USING (id) JOIN qw USING (query_id))
    QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 10""")
def cue_idf_search(spark, sf):
    cues = docs(spark, sf).select("id", F.array_distinct("terms").alias("features"))
    asked = questions(spark, sf).select("query_id", F.array_distinct("terms").alias("features"))
    return L.cue_search(cues, asked, 10).select("query_id", "id", F.round("score", 6).alias("score"))


@query("record_anchors", """WITH r AS (SELECT conv_id * 1000 + turn AS id, conv_id AS source, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda w: w <> '')) AS fs FROM conversations),
    rf AS (SELECT id, source, unnest(fs) AS f FROM r), n AS (SELECT source, count(*) AS n FROM r GROUP BY source),
    w AS (SELECT source, f, pow(1 + ln((any_value(n) + 1) / (count(*) + 1)::DOUBLE), 2) AS w FROM rf JOIN n USING (source) GROUP BY ALL),
    q AS (SELECT id AS episode, source, f, w FROM rf JOIN w USING (source, f) WHERE id % 2 = 1), qn AS (SELECT episode, sqrt(sum(w)) AS qn FROM q GROUP BY ALL),
    e AS (SELECT id, source, f, w FROM rf JOIN w USING (source, f)), rn AS (SELECT id, sqrt(sum(w)) AS rn FROM e GROUP BY ALL)
    SELECT episode, id, round(score, 6) AS score FROM (SELECT episode, e.id, sum(q.w) / any_value(qn) / any_value(rn) AS score FROM q JOIN e USING (source, f) JOIN qn USING (episode) JOIN rn ON rn.id = e.id WHERE e.id % 2 = 0 GROUP BY ALL)
    QUALIFY row_number() OVER (PARTITION BY episode ORDER BY score DESC, id) = 1""")
def record_anchors(spark, sf):
    """Each assistant turn's best user turn of the same conversation by squared-IDF cosine over all turns."""
    r = table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("conv_id").alias("source"), F.array_distinct(L.ascii_words(F.col("text"))).alias("features"))
    asked = r.where("id % 2 = 1").select(F.col("id").alias("episode"), "source", "features")
    return L.record_anchors(asked, r, F.col("id") % 2 == 0).select("episode", "id", F.round("score", 6).alias("score"))


@query("line_containment", r"""WITH l AS (SELECT DISTINCT source AS source_key, doc_id AS id, trim(unnest(string_split(text, chr(10)))) AS line FROM documents), k AS (SELECT * FROM l WHERE length(line) >= 20),
    n AS (SELECT id, count(*) AS n FROM k GROUP BY id)
    SELECT source_key, a, b, round(c / least(x.n, y.n), 6) AS containment FROM (SELECT p.source_key, p.id AS a, r.id AS b, count(*) AS c FROM k p JOIN k r ON p.source_key = r.source_key AND p.line = r.line AND p.id < r.id GROUP BY ALL)
    JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE c / least(x.n, y.n) >= 0.8""")
def line_containment(spark, sf):
    """Pairs of documents of one source of which one holds four fifths of the other's lines of 20 characters or more."""
    lines = table(spark, sf, "documents").select(F.col("source").alias("source_key"), F.col("doc_id").alias("id"), F.explode(F.split("text", "\n")).alias("line")).withColumn("line", F.trim("line")).where("length(line) >= 20").distinct()
    return L.containment_pairs(lines).withColumn("containment", F.round("containment", 6))


@query("source_key_cohort", f"""WITH {_BM25}, hh AS (SELECT query_id, id, source, score FROM bm QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 20),
    k0 AS (SELECT query_id, source, max(score) AS best, count(*) AS n FROM hh GROUP BY ALL HAVING count(*) >= 2), k AS (SELECT * FROM k0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY n DESC, source) = 1)
    SELECT k.query_id, d.id, k.source AS source_key, round(best * 0.95, 6) AS score FROM k JOIN d ON d.source = k.source ANTI JOIN hh ON hh.query_id = k.query_id AND hh.id = d.id
    QUALIFY row_number() OVER (PARTITION BY k.query_id ORDER BY d.id) <= 40""")
def source_key_cohort(spark, sf):
    hits = L.bm25_top(docs(spark, sf), questions(spark, sf), 20).select("query_id", "id", F.col("source").alias("source_key"), "score")
    return L.cohort(hits, docs(spark, sf).select("id", F.col("source").alias("source_key"))).withColumn("score", F.round("score", 6))


@query("posting_index_search", f"""WITH {_DOCS}, now AS (SELECT id, CASE WHEN quality = 1 AND toxic = 0 THEN terms || terms[1:20] ELSE terms END AS terms FROM d LEFT JOIN labels l ON l.doc_id = id WHERE coalesce(toxic, 0) = 0),
    h AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(terms) AS term FROM now) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
    t AS (SELECT count(*) AS n, avg(len(terms)) AS a FROM now), df AS (SELECT term, count(*) AS df FROM h GROUP BY term),
    bm AS (SELECT query_id, id, round(sum(greatest(0.000001::DOUBLE, ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE))) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len(now.terms) / a))), 9) AS score
        FROM h JOIN df USING (term) JOIN now USING (id) JOIN q USING (term), t GROUP BY query_id, id)
    SELECT query_id, id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM bm) WHERE rank <= 10""")
def posting_index_search(spark, sf):
    """Search in a maintained index: all documents are inserted, labelled ones then replaced (by their text with its first words again) or, if toxic, deleted."""
    rows = docs(spark, sf).select("id", F.lit(1).cast("long").alias("seq"), F.lit("put").alias("op"), "terms")
    labels = table(spark, sf, "labels").select(F.col("doc_id").alias("id"), "quality", "toxic")
    again = rows.join(labels, "id").where("quality = 1 OR toxic = 1").select("id", F.lit(2).cast("long").alias("seq"), F.when(F.col("toxic") == 1, "delete").otherwise("put").alias("op"), F.concat("terms", F.slice("terms", 1, 20)).alias("terms"))
    index = PostingIndex(spark, f"{shared_folder(spark)}/postings-{uuid.uuid4().hex}")
    index.apply(rows, 1)
    index.apply(again, 2)
    return index.search(questions(spark, sf), 10).select("query_id", "id", F.round("score", 6).alias("score"), "rank")
