"""Audits of what is stored: every finding is a row (check, key, reason, detail).

Evidence: episodes name lines of their source's compact view (numbered from 1 without blank ones) and quote them; a span's lines are put together
again by a join on line numbers, so its cost is the length of what is quoted. Storage: references, kinds, domains and vectors of contextual edges, in one pass over the edges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import records

#: How evidence is given, names of nobody, what separates names, and the labels that are languages.
NONE, BASIS = "legacy_unavailable", "reasoning_view_nonempty_lines_v1"
UNKNOWN = ("???", "[username]", "未标注发言者", "未知发言者", "unknown speaker")
SEPARATOR = r"\s*[/／]\s*|[()（）]"
FINDING = ("check", "key", "reason", "detail")


def _finding(df: DataFrame, check: str, key: Column, reason: Column, detail: Column) -> DataFrame:
    return df.select(F.lit(check).alias("check"), key.cast("string").alias("key"), reason.alias("reason"), detail.cast("string").alias("detail"))


def numbered(sources: DataFrame) -> DataFrame:
    """id, n (from 1), line of the lines of a text that are not blank."""
    rows = records.lines_of(sources).where(records.strip(F.col("line")) != "")
    return rows.select("id", F.row_number().over(Window.partitionBy("id").orderBy("pos")).cast("long").alias("n"), "line")


def _typed(episodes: DataFrame) -> DataFrame:
    """episodes with quotes and spans read, and reason: what is wrong with the JSON or its form, null if nothing is."""
    kind = lambda c: F.schema_of_variant(F.try_parse_json(c))
    quotes, spans = F.from_json("quotes_json", "array<string>"), F.from_json("spans_json", "array<array<long>>")
    words = F.coalesce(kind("quotes_json").isin("ARRAY<STRING>", "ARRAY<VOID>"), F.lit(False)) & F.coalesce(F.forall(quotes, lambda q: records.strip(q) != ""), F.lit(False))
    pairs = F.coalesce(kind("spans_json").isin("ARRAY<ARRAY<BIGINT>>", "ARRAY<VOID>"), F.lit(False)) & F.coalesce(F.forall(spans, lambda s: F.size(s) == 2), F.lit(False))
    basis = F.coalesce("basis", F.lit(""))
    reason = (
        F.when(~(words & pairs), "invalid_evidence_json")
        .when(basis == NONE, "evidence_required_but_unavailable")
        .when(basis != BASIS, "unsupported_evidence_basis")
        .when((F.size(quotes) == 0) | (F.size(quotes) != F.size(spans)), "evidence_quote_span_count_mismatch")
    )
    return episodes.withColumn("quotes", quotes).withColumn("spans", spans).withColumn("reason", reason)


def evidence(episodes: DataFrame, sources: DataFrame, required: bool = True) -> DataFrame:
    """episodes: id, source_id, basis, quotes_json, spans_json, participants_json; sources: id, text -> findings of checks evidence and participants.

    Quotes are compared only if all spans of the episode are in range; participants have to be in the quotes, whole or in all their parts."""
    typed = _typed(episodes)
    wrong = typed.where("reason IS NOT NULL")
    if not required:
        wrong = wrong.where("reason <> 'evidence_required_but_unavailable'")
    detail = F.when(F.col("reason") == "unsupported_evidence_basis", F.col("basis")).when(F.col("reason") == "evidence_quote_span_count_mismatch", F.concat_ws("/", F.size("quotes"), F.size("spans")))
    out = _finding(wrong, "evidence", F.col("id"), F.col("reason"), detail)
    good = typed.where("reason IS NULL")
    lines = numbered(records.compact(sources))
    last = lines.groupBy("id").agg(F.max("n").alias("last")).withColumnRenamed("id", "source_id")
    each = good.select("id", "source_id", F.posexplode(F.arrays_zip("quotes", "spans")).alias("k", "x")).select("id", "source_id", "k", F.col("x.quotes").alias("quote"), F.col("x.spans")[0].alias("first"), F.col("x.spans")[1].alias("to"))
    each = each.join(last, "source_id", "left").withColumn("out", (F.col("first") < 1) | (F.col("to") < F.col("first")) | (F.col("to") > F.coalesce("last", F.lit(0))))
    far = each.where("out")
    out = out.unionByName(_finding(far, "evidence", F.col("id"), F.lit("evidence_span_out_of_range"), F.concat_ws(":", "k", "first", "to", F.coalesce("last", F.lit(0)))))
    sound = each.join(far.select("id").distinct(), "id", "left_anti").select("id", "source_id", "k", "quote", F.explode(F.sequence("first", "to")).alias("n"))
    rebuilt = sound.join(lines.withColumnRenamed("id", "source_id"), ["source_id", "n"]).groupBy("id", "k", "quote").agg(F.array_sort(F.collect_list(F.struct("n", "line"))).alias("l"))
    other = rebuilt.where(F.array_join(F.transform("l", lambda x: x["line"]), "\n") != F.col("quote"))
    out = out.unionByName(_finding(other, "evidence", F.col("id"), F.lit("evidence_quote_does_not_match_span"), F.col("k")))
    whole = good.join(far.select("id").distinct(), "id", "left_anti")
    named = whole.select("id", F.lower(F.array_join("quotes", "\n")).alias("said"), F.explode(F.from_json("participants_json", "array<string>")).alias("p")).withColumn("p", records.strip(F.col("p"))).where("p <> ''")
    return out.unionByName(_finding(named.where(~grounded(F.col("p"), F.col("said"))), "participants", F.col("id"), F.lit("participant_not_in_evidence"), F.col("p")))


def grounded(name: Column, text: Column) -> Column:
    """Whether a name, or each of its parts, is nobody's or in a text of lower case."""
    known = lambda x: F.lower(x).isin(*UNKNOWN) | F.contains(text, F.lower(x))
    parts = F.filter(F.transform(F.split(name, SEPARATOR), records.strip), lambda x: x != "")
    return known(name) | ((F.size(parts) > 0) & F.forall(parts, known))


def participants(episodes: DataFrame, sources: DataFrame) -> DataFrame:
    """Findings of participants (array in participants_json) that their source's text does not hold."""
    named = episodes.select("id", "source_id", F.explode(F.from_json("participants_json", "array<string>")).alias("p")).withColumn("p", records.strip(F.col("p"))).where("p <> ''")
    told = named.join(sources.select(F.col("id").alias("source_id"), F.lower("text").alias("said")), "source_id", "left")
    return _finding(told.where(~grounded(F.col("p"), F.coalesce("said", F.lit("")))), "participants", F.col("id"), F.lit("participant_not_in_source"), F.col("p"))


def storage(edges: DataFrame, cues: DataFrame, nodes: DataFrame) -> DataFrame:
    """edges: id, mode, context_cue_id, need_cue_id, to_type, to_id, claim_level; cues: id, kind, domain, dimension, vector (array); nodes: type, id -> findings
    of checks storage (edges) and cues: cues that are missing or of the wrong kind, edges across domains, targets that are no stored episode, claims beyond retrieval, vectors that
    are not whole, finite and of length one."""
    side = lambda n: cues.select(F.col("id").alias(f"{n}_cue_id"), F.col("kind").alias(f"{n}_kind"), F.col("domain").alias(f"{n}_domain"), F.lit(True).alias(f"{n}_there"))
    targets = nodes.where("type = 'episode'").select(F.col("type").alias("to_type"), F.col("id").alias("to_id"), F.lit(True).alias("target"))
    joined = edges.where("mode = 'contextual_recall'").join(side("context"), "context_cue_id", "left").join(side("need"), "need_cue_id", "left").join(targets, ["to_type", "to_id"], "left")
    both = F.col("context_there") & F.col("need_there")
    kinds = F.array_sort(F.array("context_kind", "need_kind")) == F.array(F.lit("context"), F.lit("need"))
    same = F.col("context_cue_id") == F.col("need_cue_id")
    some = F.col("context_there").isNotNull() | F.col("need_there").isNotNull()
    found = {
        "orphan_context_cue": F.col("context_there").isNull(),
        "orphan_need_cue": F.col("need_there").isNull(),
        "invalid_cue_kind": some & ~F.coalesce(both & kinds & ~same, F.lit(False)),
        "cross_domain_edge": F.coalesce(both & (F.col("context_domain") != F.col("need_domain")), F.lit(False)),
        "invalid_target": F.col("target").isNull(),
        "invalid_claim_level": ~F.coalesce(F.col("claim_level") == "retrieval_only", F.lit(False)),
    }
    reasons = F.array_compact(F.array(*[F.when(c, name) for name, c in found.items()]))
    out = joined.select("id", F.explode(reasons).alias("reason"))
    square = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    fine = (F.size("vector") == F.col("dimension")) & F.forall("vector", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & (F.abs(F.sqrt(square) - 1) <= 1e-3)
    bad = cues.where(~F.coalesce(F.col("vector").isNotNull() & fine, F.lit(False)))
    return _finding(out, "storage", F.col("id"), F.col("reason"), F.lit(None)).unionByName(_finding(bad, "cues", F.col("id"), F.lit("invalid_vector"), F.lit(None)))
