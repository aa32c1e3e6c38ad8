"""The engine's tables over the driver's tables: episodes are orders, concepts are parts, associations are line items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def edges(spark: SparkSession, sf: str) -> DataFrame:
    """One row for each (episode, concept, polarity)."""
    polarity = F.when(F.col("l_returnflag") == "R", -1).otherwise(1)
    return (
        table(spark, sf, "lineitem")
        .groupBy(F.col("l_orderkey").alias("from_id"), F.col("l_partkey").alias("to_id"), polarity.alias("polarity"))
        .agg((F.max("l_quantity") / 50).alias("weight"), F.max(1 - F.col("l_discount")).alias("confidence"), F.count(F.lit(1)).alias("evidence_count"))
        .select((F.col("from_id") * 100000000 + F.col("to_id") * 10 + F.col("polarity") + 1).alias("association_id"), "from_id", "to_id", "polarity", "weight", "confidence", "evidence_count")
    )


def temporal(spark: SparkSession, sf: str) -> DataFrame:
    """before-edges between a customer's successive orders."""
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf, "orders").select(F.col("o_custkey").alias("scope"), F.col("o_orderkey").alias("from_id"), F.lead("o_orderkey").over(w).alias("to_id")).where("to_id IS NOT NULL")


EDGES = """edges AS (SELECT from_id * 100000000 + to_id * 10 + polarity + 1 AS association_id, * FROM (
    SELECT l_orderkey AS from_id, l_partkey AS to_id, CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END AS polarity,
           max(l_quantity) / 50 AS weight, max(1 - l_discount) AS confidence, count(*) AS evidence_count
    FROM lineitem GROUP BY ALL))"""
TEMPORAL = """temporal AS (SELECT * FROM (SELECT o_custkey AS scope, o_orderkey AS from_id,
    lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS to_id FROM orders) WHERE to_id IS NOT NULL)"""
UNIT = """unit AS (SELECT vec_id, label, list_transform(e, lambda x: x / n) AS v FROM (
    SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS n FROM (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings)) WHERE n > 0)"""
