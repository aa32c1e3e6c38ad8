"""Deterministic parts of evidence review and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def occurrences(text, quote):
    """How often a literal quote is in a text, without overlaps."""
    return F.when(F.length(quote) > 0, ((F.length(text) - F.length(F.replace(text, quote, F.lit("")))) / F.length(quote)).cast("long")).otherwise(F.lit(0).cast("long"))


def review_facts(facts: DataFrame, windows: DataFrame) -> DataFrame:
    """facts: fact, id, quote; windows: id, start, end, text (visible parts of sources) -> fact, id, status (accept, not_visible, ambiguous), start, span_hash.

    A quote must be in the visible windows exactly once. The fact's stable id is a digest of source, place and quote."""
    hit = facts.join(windows, "id", "left").withColumn("n", F.coalesce(occurrences(F.col("text"), F.col("quote")), F.lit(0)))
    per = hit.groupBy("fact", "id", "quote").agg(F.sum("n").alias("n"), F.max(F.when(F.col("n") > 0, F.col("start") + F.instr(F.col("text"), F.col("quote")) - 1)).alias("start"))
    status = F.when(F.col("n") == 0, "not_visible").when(F.col("n") > 1, "ambiguous").otherwise("accept")
    place = F.when(F.col("n") == 1, F.col("start"))
    key = F.when(F.col("n") == 1, F.sha2(F.concat_ws("|", F.col("id").cast("string"), F.col("start").cast("string"), "quote"), 256))
    return per.select("fact", "id", status.alias("status"), place.alias("start"), key.alias("span_hash"))


def reading_cursor(end, length, back: int = 400):
    """Where reading goes on after a window that ends at end."""
    return F.when(end >= length, end).otherwise(F.greatest(F.lit(1), end - back))


def grounded(reviews: DataFrame, sources: DataFrame) -> DataFrame:
    """reviews: review, source_id, quote, parts (array); sources: source_id, text -> review, grounded: some frame's quote is in its source and holds all parts,
    white space and case aside."""
    plain = lambda c: F.lower(F.regexp_replace(c, r"\s+", ""))
    ok = F.contains(plain(F.col("text")), plain(F.col("quote"))) & F.forall("parts", lambda p: F.contains(plain(F.col("quote")), plain(p)))
    return reviews.join(sources, "source_id", "left").groupBy("review").agg(F.coalesce(F.bool_or(ok), F.lit(False)).alias("grounded"))


def cached_evidence(cache: DataFrame, sources: DataFrame) -> DataFrame:
    """Cached rows (key, source_id, start, length, quote, source_hash) that still hold: the source's hash and the text at the span are the same."""
    ok = (F.sha2("text", 256) == F.col("source_hash")) & (F.expr("substring(text, start + 1, length)") == F.col("quote"))
    return cache.join(sources, "source_id").where(ok).drop("text")


def evaluate_retrieval(ranked: DataFrame, matches: DataFrame, groups: DataFrame, k: int = 20) -> DataFrame:
    """ranked: question, id, rank; matches: question, group, id; groups: question, group -> question, recall (share of groups with a match within k), rank (the worst
    group's best rank, null unless all groups are met)."""
    best = groups.join(matches.join(ranked, ["question", "id"]).groupBy("question", "group").agg(F.min("rank").alias("best")), ["question", "group"], "left")
    return best.groupBy("question").agg(F.avg(F.when(F.col("best") <= k, 1.0).otherwise(0.0)).alias("recall"), F.when(F.count("best") == F.count(F.lit(1)), F.max("best")).alias("rank"))


def growth_reuse(grown: DataFrame, used: DataFrame) -> DataFrame:
    """grown: id, from_id, to_id; used: from_id, to_id (of answers' paths) -> how many grown edges are used as they are, and in either direction."""
    a = grown.join(used.select("from_id", "to_id").distinct(), ["from_id", "to_id"], "left_semi").select("id").distinct()
    low = lambda df: df.withColumn("_a", F.least("from_id", "to_id")).withColumn("_b", F.greatest("from_id", "to_id"))
    b = low(grown).join(low(used).select("_a", "_b").distinct(), ["_a", "_b"], "left_semi").select("id").distinct()
    return grown.agg(F.count(F.lit(1)).alias("grown")).crossJoin(a.agg(F.count(F.lit(1)).alias("ordered"))).crossJoin(b.agg(F.count(F.lit(1)).alias("unordered")))


def score_evidence(questions: DataFrame, episodes: DataFrame) -> DataFrame:
    """questions: question, terms (array), term_groups (array of arrays), sources (array); episodes: question, source, text (selected ones) -> shares of terms, of
    groups with any term, and of sources that are there."""
    text = episodes.groupBy("question").agg(F.lower(F.array_join(F.collect_list("text"), "\n")).alias("all"), F.collect_set("source").alias("seen"))
    j = questions.join(text, "question", "left").withColumn("all", F.coalesce("all", F.lit("")))
    share = lambda column, ok: F.when(F.size(column) == 0, 1.0).otherwise(F.size(F.filter(column, ok)) / F.size(column))
    return j.select(
        "question", share("terms", lambda t: F.contains(F.col("all"), F.lower(t))).alias("terms"),
        share("term_groups", lambda g: F.exists(g, lambda t: F.contains(F.col("all"), F.lower(t)))).alias("groups"),
        share("sources", lambda s: F.array_contains(F.coalesce("seen", F.array().cast("array<string>")), s)).alias("sources"),
    )


def relation_order(drafts: DataFrame) -> DataFrame:
    """Drafts of relations with their place: generation, claim rank descending, confidence and weight descending, endpoints, key, polarity, text."""
    order = ("generation", F.desc("claim_rank"), F.desc("confidence"), F.desc("weight"), "relation_rank", "from_id", "to_id", "relation_key", "polarity", "text")
    return drafts.withColumn("place", F.row_number().over(Window.partitionBy("batch").orderBy(*order)))
