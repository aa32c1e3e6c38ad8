"""Dense retrieval over embeddings. Query vectors: the rows whose id is divisible by 20."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import register_text
from ..operators import vectors as V
from .bindings import UNIT, table
from .registry import query


def unit(spark, sf):
    return V.normalise(table(spark, sf, "embeddings"), "embedding").select(F.col("vec_id").alias("id"), "label", "v")


def asked(index):
    return index.where("id % 20 = 0").withColumnRenamed("id", "query_id")


_SCORES = f"""WITH {UNIT}, s AS (SELECT q.vec_id AS query_id, u.vec_id AS id, q.label AS query_label, u.label AS label, list_dot_product(q.v, u.v) AS score
    FROM unit q, unit u WHERE q.vec_id % 20 = 0)"""


@query("vector_topk", f"""{_SCORES} SELECT query_id, id, round(score, 6) AS score, rank FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM s) WHERE rank <= 10""")
def vector_topk(spark, sf):
    index = unit(spark, sf)
    return V.search_many(index, asked(index), 10).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query("vector_topk_by_domain", f"""{_SCORES} SELECT query_id, id, round(score, 6) AS score, rank FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM s WHERE label = query_label AND id <> query_id) WHERE rank <= 3""")
def vector_topk_by_domain(spark, sf):
    index = unit(spark, sf)
    return V.search_many(index, asked(index), 3, by="label", skip_self=True).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query("vector_similar_candidates", f"""{_SCORES} SELECT query_id, id, round(score, 6) AS score FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s WHERE id <> query_id AND score >= 0.2) WHERE rank <= 8""")
def vector_similar_candidates(spark, sf):
    """Concept similarity candidates: the 8 best at or above a cosine."""
    index = unit(spark, sf)
    return V.search_many(index, asked(index), 8, floor=0.2, skip_self=True).select("query_id", "id", F.round("score", 6).alias("score"))


@query("vector_activation_seeds", f"""{_SCORES} SELECT query_label AS root, id, round(max(greatest(0, least(1, score))), 6) AS activation FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 8 GROUP BY ALL HAVING max(score) > 0""")
def vector_activation_seeds(spark, sf):
    """Seeds: each cue's 8 best, clipped, the largest of each root (the cue's label) and episode."""
    index = unit(spark, sf)
    cues = asked(index).select("query_id", F.col("label").alias("root"))
    hits = V.search_many(index, asked(index), 8).join(cues, "query_id")
    return V.activation_seeds(hits).select("root", "id", F.round("activation", 6).alias("activation"))


@query("vector_import_comparison", f"""WITH {UNIT}, p AS (SELECT a.vec_id AS id, a.label, max(list_dot_product(a.v, b.v)) AS best
    FROM unit a LEFT JOIN unit b ON a.label = b.label AND a.vec_id % 2 <> b.vec_id % 2 GROUP BY ALL)
    SELECT label, id % 2 AS side, count(*) AS n, round(avg(coalesce(best, -1)), 6) AS mean_best, round(min(coalesce(best, -1)), 6) AS min_best FROM p GROUP BY ALL""")
def vector_import_comparison(spark, sf):
    """Nearest neighbour by cosine between two imports (even and odd ids) inside a source key (label), both ways."""
    index = unit(spark, sf)
    both = []
    for side in (0, 1):
        own = index.where(F.col("id") % 2 == side)
        best = V.search_many(index.where(F.col("id") % 2 != side), own.withColumnRenamed("id", "query_id"), 1, by="label")
        both.append(own.join(best.select(F.col("query_id").alias("id"), "score"), "id", "left").select("label", F.lit(side).cast("long").alias("side"), F.coalesce("score", F.lit(-1.0)).alias("best")))
    return both[0].unionByName(both[1]).groupBy("label", "side").agg(F.count("*").alias("n"), F.round(F.avg("best"), 6).alias("mean_best"), F.round(F.min("best"), 6).alias("min_best"))


@query("vector_evidence_remap", f"""{_SCORES}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s WHERE label = query_label AND id <> query_id AND id % 2 = 1)
    SELECT query_id, id, round(score, 6) AS score FROM r WHERE rank = 1 OR (rank <= 5 AND score >= 0.25)""")
def vector_evidence_remap(spark, sf):
    """Evidence ids in another corpus (odd ids): up to 5 of the same key at or above a cosine, else the best one."""
    index = unit(spark, sf)
    hits = V.search_many(index.where("id % 2 = 1"), asked(index), 5, by="label", skip_self=True)
    return hits.where("rank = 1 OR score >= 0.25").select("query_id", "id", F.round("score", 6).alias("score"))


@query("vector_prototype_scores", f"""WITH {UNIT}, w AS (SELECT vec_id AS id, (vec_id // 20) * 20 AS query_id FROM embeddings UNION ALL SELECT -1, 0)
    SELECT w.query_id, w.id, round(list_dot_product(u.v, q.v), 6) AS score, u.v IS NULL AS missing FROM w LEFT JOIN unit u ON u.vec_id = w.id LEFT JOIN unit q ON q.vec_id = w.query_id""")
def vector_prototype_scores(spark, sf):
    """Scores of a bounded set of ids for each query; ids without a vector are reported."""
    index = unit(spark, sf)
    wanted = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.expr("vec_id div 20 * 20").alias("query_id")).union(spark.range(1).select(F.lit(-1).cast("long"), F.lit(0).cast("long")))
    return V.prototype_scores(wanted, index, asked(index)).withColumn("score", F.round("score", 6))


@query("vector_rank_fusion", f"""{_SCORES}, d AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s),
    g AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s WHERE label = query_label)
    SELECT id, round(sum(w / (60 + rank)), 6) AS score FROM (SELECT id, rank, 1.2 AS w FROM d WHERE rank <= 20 UNION ALL SELECT id, rank, 0.7 AS w FROM g WHERE rank <= 10) GROUP BY id""")
def vector_rank_fusion(spark, sf):
    """Two ranked channels fused by weight / (60 + rank)."""
    index = unit(spark, sf)
    wide = V.search_many(index, asked(index), 20).select("id", "rank", F.lit(1.2).alias("weight"))
    near = V.search_many(index, asked(index), 10, by="label").select("id", "rank", F.lit(0.7).alias("weight"))
    return V.rank_fusion(wide.unionByName(near)).withColumn("score", F.round("score", 6))


@query("vector_upsert", f"""WITH {UNIT} SELECT label, count(*) AS n, round(sum(v[1]), 6) AS first_sum FROM (
    SELECT vec_id, CASE WHEN vec_id % 20 = 0 THEN -1 ELSE label END AS label, v FROM unit WHERE vec_id % 7 <> 3) GROUP BY label""")
def vector_upsert(spark, sf):
    """Index maintenance: query rows are replaced (label -1), ids of remainder 3 by 7 are removed."""
    index = unit(spark, sf)
    new = index.where("id % 20 = 0").withColumn("label", F.lit(-1))
    out = V.upsert(index, new, index.where("id % 7 = 3"))
    return out.groupBy("label").agg(F.count("*").alias("n"), F.round(F.sum(F.get("v", F.lit(0))), 6).alias("first_sum"))


@query("vector_rejected", """SELECT reason, count(*) AS n FROM (SELECT unnest(['missing', 'not_finite', 'zero']) AS reason UNION ALL
    SELECT CASE WHEN embedding IS NULL THEN 'missing' END FROM embeddings) WHERE reason IS NOT NULL GROUP BY reason""")
def vector_rejected(spark, sf):
    """Vectors that can't be indexed, by reason; three bad ones are added to the table's."""
    bad = spark.createDataFrame([(-1, None), (-2, [1.0, float("nan")]), (-3, [0.0, 0.0])], "vec_id long, embedding array<float>")
    rows = table(spark, sf, "embeddings").select("vec_id", "embedding").unionByName(bad)
    return V.rejected(rows, "embedding").groupBy("reason").agg(F.count("*").alias("n"))


@query("query_text_dedupe", r"""WITH q AS (SELECT item_id AS query_id, 'item' AS role, replace(lower(trim(regexp_replace(text, '\s+', ' ', 'g'))), 'ß', 'ss') AS t FROM benchmark UNION ALL
    SELECT item_id, 'again', replace(lower(trim(regexp_replace(text, '\s+', ' ', 'g'))), 'ß', 'ss') FROM benchmark WHERE item_id % 20 = 0)
    SELECT sha256(t) AS text_hash, query_id, role, CASE WHEN n = 1 THEN query_id::VARCHAR ELSE query_id || ':' || n END AS binding FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY role DESC) AS n FROM q)""")
def query_text_dedupe(spark, sf):
    """One physical vector for each normal form of a text, many logical bindings; repeated ids get a suffix."""
    register_text(spark)
    items = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.lit("item").alias("role"), "text")
    both = items.unionByName(items.where("query_id % 20 = 0").withColumn("role", F.lit("again")))
    n = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("role")))
    return both.withColumn("n", n).select(F.expr("sha2(nfkc_casefold_squeeze(text), 256)").alias("text_hash"), "query_id", "role", F.when(F.col("n") == 1, F.col("query_id").cast("string")).otherwise(F.concat_ws(":", "query_id", "n")).alias("binding"))
