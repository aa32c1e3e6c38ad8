"""Drafts against concepts whose names very many share."""

import random

from pyspark.sql import functions as F

from engramflow.operators import learning as L


def test_resolve_shared_names(spark):
    rng = random.Random(3)
    word = lambda n: f"n{rng.randrange(n)}"
    concepts = [(i, word(30)) for i in range(40)] + [(40, None), (41, "twice"), (41, "twice")]
    aliases = [(i, word(40)) for i in range(40)] + [(41, "twice"), (41, "twice"), (7, None)]
    drafts = [(d, rng.choice([word(30), "twice", None]), rng.choice([None, [], [word(40)], [word(40), "twice"], [word(40), None, word(60)]])) for d in range(200)]
    found = L.resolve_concepts(spark.createDataFrame(drafts, "draft long, name string, names array<string>"), spark.createDataFrame(concepts, "id long, name string"), spark.createDataFrame(aliases, "id long, alias string"))
    want = []
    for d, name, names in drafts:
        exact = {i for i, n in concepts if n is not None and n == name}
        agreed = {i for i, a in aliases if a is not None and a in (names or [])}
        want.append((d, min(exact), "name") if len(exact) == 1 else (d, min(agreed), "alias") if len(agreed) == 1 else (d, None, "new"))
    assert sorted(map(tuple, found.collect())) == want


def joined(plan):
    """Rows that the joins of an executed plan made."""
    own = plan.metrics().get("numOutputRows").get().value() if "Join" in plan.nodeName() else 0
    return own + sum(joined(plan.children().apply(i)) for i in range(plan.children().size()))


def test_resolve_makes_no_row_for_each_pair(spark):
    """2,000 drafts and 2,000 concepts of two names: four million rows if all met."""
    rows = spark.range(2000)
    concepts = rows.select("id", (F.col("id") % 2).cast("string").alias("name"))
    drafts = concepts.select(F.col("id").alias("draft"), "name", F.array("name").alias("names"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = L.resolve_concepts(drafts, concepts, concepts.withColumnRenamed("name", "alias"))
        assert {r.how for r in found.collect()} == {"new"}
        assert joined(found._jdf.queryExecution().executedPlan()) <= 10_000
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
