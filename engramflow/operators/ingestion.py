"""Deterministic checks of ingestion, growth and learning over rows and texts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Marks that close a quotation or bracket, and pronouns at the start of a sentence of speech or thought.
CLOSING = "^[”’」』】）》〉）)\\]]"
PRONOUN = (
    "(?i)^(?:(?:她|他|它)(?:们|們)?(?:认为|認為|表示|希望|知道|决定|決定|觉得|覺得|发现|發現|注意|承认|承認|询问|詢問|回答|解释|解釋|建议|建議|要求|担心|擔心|意识|意識|计划|計劃|试图|試圖|想|说|說|拒绝|拒絕|同意)"
    "|其(?:认为|認為|表示|希望|决定|決定)|彼女は|彼は|彼らは|(?:she|he|they|it)\\b|그녀는|그는|그들은)"
)
#: Guesses in brackets behind an unknown speaker, and names before one in brackets.
GUESS_AFTER = r"((?:一个)?(?:未标注|未知)发言者|\?\?\?)[（(][^）)]*(?:根据上下文|推测|可能|疑似|似乎|应为|应该是)[^）)]*[）)]"
NAME_BEFORE = r"[A-Za-z\u3400-\u9fff\u3040-\u30ff\uac00-\ud7af·・]{1,32}[（(](\?\?\?|\[USERNAME\]|(?:未标注|未知)发言者)[）)]"
#: States of nodes that are not certain, and words one of which a relation to them must hold.
UNCERTAIN = ("reported", "speculative", "mixed")
QUALIFIERS = ("说法", "声称", "报告", "推测", "猜测", "可能", "尚未确认", "未证实", "未证明", "综合推论", "导入者", "不确定")


def numbered_lines(docs: DataFrame) -> DataFrame:
    """docs: id, text -> id, n (from 1, over lines that aren't blank), line: [L0001] ..."""
    lines = docs.select("id", F.posexplode(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")).alias("n", "line"))
    return lines.select("id", (F.col("n") + 1).cast("long").alias("n"), F.concat(F.format_string("[L%04d] ", F.col("n") + 1), "line").alias("line"))


def speaker_tokens(lines: DataFrame) -> DataFrame:
    """lines: id, n, speaker -> id, speaker, token SPEAKER_001... in order of first appearance."""
    first = lines.where("speaker IS NOT NULL AND speaker <> ''").groupBy("id", "speaker").agg(F.min("n").alias("n"))
    return first.select("id", "speaker", F.format_string("SPEAKER_%03d", F.row_number().over(Window.partitionBy("id").orderBy("n", "speaker"))).alias("token"))


def complete_participants(episodes: DataFrame, aliases: DataFrame) -> DataFrame:
    """episodes: id, source, text, participants; aliases: source, name, alias -> participants completed by names whose alias is in the text, by first
    position."""
    place = F.instr(F.lower("text"), F.lower("alias"))
    found = episodes.join(aliases, "source").withColumn("at", place).where("at > 0 AND NOT array_contains(participants, name)").groupBy("id", "name").agg(F.min("at").alias("at"))
    more = found.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("at", "name"))).alias("m"))
    return episodes.join(more, "id", "left").withColumn("participants", F.concat("participants", F.coalesce(F.transform("m", lambda x: x["name"]), F.array().cast("array<string>")))).drop("m")


def self_containment(text: Column, participants: Column) -> Column:
    """Why a text can't stand by itself, null if it can; a pronoun at its start is bound by any participant."""
    t = F.regexp_replace(text, r"(?U)^\s+", "")
    return F.when(t.rlike(CLOSING), "closing_fragment").when((F.coalesce(F.size(participants), F.lit(0)) <= 0) & t.rlike(PRONOUN), "unbound_pronoun")


#: Speakers that are no names, and the note on an episode that is led by somebody else than who speaks.
NOBODY = ("???", "unknown speaker", "未知发言者", "未标注发言者")
NOT_THE_SPEAKER = "正文首要人物不是证据记录的声明发言者"


def downgrade_attribution(episodes: DataFrame) -> DataFrame:
    """episodes: participants and quotes (arrays), epistemic_status, confidence, epistemic_note: those that are observed or asserted and whose first participant is none of the speakers that their own
    quotes declare become reported, with confidence of 0.8 at most and a note (1,000 characters at most). Episodes without participants or declared speakers stay as they are."""
    strip = lambda c: F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))
    found = F.regexp_extract_all(F.array_join(F.coalesce("quotes", F.array().cast("array<string>")), "\n"), F.lit(r"\[speaker_raw:\s*([^\]]+)\]"), 1)
    declared = F.filter(F.transform(found, strip), lambda x: (x != "") & ~x.isin(*NOBODY))
    first = strip(F.get("participants", F.lit(0)))
    out = F.coalesce((F.size(declared) > 0) & first.isNotNull() & ~F.array_contains(declared, first) & F.col("epistemic_status").isin("observed", "asserted"), F.lit(False))
    note = F.regexp_replace(F.coalesce("epistemic_note", F.lit("")), r"(?U)^\s+|\s+$", "")
    noted = F.when(F.contains(note, F.lit(NOT_THE_SPEAKER)), F.col("epistemic_note")).otherwise(F.substring(F.when(note == "", NOT_THE_SPEAKER).otherwise(F.concat(note, F.lit("；" + NOT_THE_SPEAKER))), 1, 1000))
    return episodes.withColumns({
        "epistemic_note": F.when(out, noted).otherwise(F.col("epistemic_note")),
        "confidence": F.when(out, F.least("confidence", F.lit(0.8))).otherwise(F.col("confidence")),
        "epistemic_status": F.when(out, "reported").otherwise(F.col("epistemic_status")),
    })


def validate_spans(spans: DataFrame, lines: DataFrame) -> DataFrame:
    """spans: episode, id, first, last; lines: id, n, line -> episode, reason (null: good), quote rebuilt from the lines.

    1 to 8 spans, at most 64 lines each and 128 in all, inside the source, with four characters of text or more."""
    size = F.col("last") - F.col("first") + 1
    shape = spans.groupBy("episode").agg(F.count(F.lit(1)).alias("k"), F.max(size).alias("longest"), F.sum(size).alias("total"), F.min(size).alias("shortest"), F.min("first").alias("low"))
    covered = spans.join(lines, "id").where("n BETWEEN first AND last").groupBy("episode").agg(F.count(F.lit(1)).alias("seen"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "n", "line"))), lambda x: x["line"]), "\n").alias("quote"))
    reason = (
        F.when(F.col("k") > 8, "too_many_spans").when((F.col("shortest") < 1) | (F.col("low") < 1), "bad_bounds").when(F.col("longest") > 64, "span_too_long").when(F.col("total") > 128, "too_many_lines")
        .when(F.coalesce("seen", F.lit(0)) < F.col("total"), "outside_source").when(F.length(F.regexp_replace("quote", r"\s", "")) < 4, "uninformative")
    )
    return shape.join(covered, "episode", "left").select("episode", reason.alias("reason"), "quote")


def known_participants(participants: Column) -> Column:
    """Participants without guesses: of an unknown speaker the marker stays."""
    return F.transform(participants, lambda p: F.regexp_replace(F.regexp_replace(p, GUESS_AFTER, "$1"), f"^{NAME_BEFORE}$", "$1"))


def unknown_speakers(text: Column, participants: Column) -> Column:
    """A text without guesses at unknown speakers: the marker stays, the guess goes. Participants are replaced as they are written before names are
    looked for, so that no word before a name is taken for a part of it."""
    cleaned = F.transform(F.coalesce(participants, F.array().cast("array<string>")), lambda p: F.regexp_replace(p, GUESS_AFTER, "$1"))
    marked = lambda acc, p: F.when(p.rlike(f"^{NAME_BEFORE}$"), F.replace(acc, p, F.regexp_replace(p, NAME_BEFORE, "$1"))).otherwise(acc)
    return F.regexp_replace(F.aggregate(cleaned, F.regexp_replace(text, GUESS_AFTER, "$1"), marked), f"(?i){NAME_BEFORE}", "$1")


def growth_guard(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """edges: id, from_id, to_id, text; nodes: node, epistemic_status -> ids refused: a relation to an uncertain node needs a word that says so.

    A node that is missing is of unknown state, which is not uncertain. Claims of a role in an organisation are not checked."""
    plain = edges.where(~F.exists(F.array(*[F.lit(q) for q in QUALIFIERS]), lambda q: F.contains(F.coalesce("text", F.lit("")), q)))
    ends = plain.select("id", F.explode(F.array("from_id", "to_id")).alias("node"))
    return ends.join(nodes.where(F.col("epistemic_status").isin(*UNCERTAIN)), "node", "left_semi").select("id").distinct()


#: What a learning target must have, in order: (the reason for refusing it, SQL condition that must hold; null does not).
TARGET_REASONS = (
    ("request_cancelled", "NOT cancelled"), ("answer_guard_failed", "answer_guard_passed"), ("target_not_delivered", "array_contains(delivered, target)"),
    ("target_returned_by_contextual_expansion", "NOT array_contains(contextual, target)"), ("source_evidence_missing", "size(source_facts) > 0"),
    ("verification_not_source_bound", "verification_status IN ('verified', 'source_bound')"), ("verification_reference_missing", "size(verification_refs) > 0"),
    ("query_or_slot_reference_missing", "context_query_id <> '' AND need_query_id <> '' AND slot_id <> ''"), ("vector_reference_missing", "context_vector_ref <> '' AND need_vector_ref <> ''"),
    ("target_provenance_missing", "size(provenance) > 0"), ("no_recovery_or_costly_reuse_reason", "why IS NOT NULL"),
)


def learning_rejection(targets: DataFrame) -> DataFrame:
    reason = F.lit(None).cast("string")
    for name, condition in reversed(TARGET_REASONS):
        reason = F.when(F.coalesce(F.expr(condition), F.lit(False)), reason).otherwise(name)
    return targets.withColumn("reason", reason)


def learning_anchors(candidates: DataFrame, most: int = 4) -> DataFrame:
    """candidates: request, anchor_type, anchor_id, contribution_id, activation, eligible, contextual, target -> the best route of each endpoint, at most four endpoints a request, with rank.

    Episodes that were found by context in the same round, or are targets, are no anchors. Ties go to the smaller type, id and contribution."""
    away = (F.col("anchor_type") == "episode") & (F.coalesce("contextual", F.lit(False)) | F.coalesce("target", F.lit(False)))
    order = [F.desc("activation"), F.col("anchor_type"), F.col("anchor_id"), F.col("contribution_id")]
    best = F.row_number().over(Window.partitionBy("request", "anchor_type", "anchor_id").orderBy(*order))
    own = candidates.where(F.col("eligible") & ~away).withColumn("_r", best).where("_r = 1").drop("_r")
    return own.withColumn("rank", F.row_number().over(Window.partitionBy("request").orderBy(*order))).where(F.col("rank") <= min(4, max(0, most)))


def residual_plan(missing: DataFrame, required: DataFrame, most: int = 4) -> DataFrame:
    """missing: request, slot; required: request, slot, place -> the missing required slots in plan order, at most four; a request that names an unknown slot
    gets none."""
    joined = missing.join(required, ["request", "slot"], "left")
    bad = joined.where("place IS NULL").select("request").distinct()
    good = joined.join(bad, "request", "left_anti")
    return good.withColumn("rank", F.row_number().over(Window.partitionBy("request").orderBy("place"))).where(F.col("rank") <= most).select("request", "slot", "rank")


def missing_gap(items: DataFrame) -> DataFrame:
    """items: request, need_place, item_place, item, status -> the first unknown item in order of need and item."""
    return items.where("status = 'unknown'").groupBy("request").agg(F.min_by("item", F.struct("need_place", "item_place")).alias("item"))


def admit_concepts(occurrences: DataFrame, aliases: DataFrame, floor: float = 0.595) -> DataFrame:
    """occurrences: name, similarity; aliases: alias, id -> name, id, decision: reuse of a known name, rejection of a single occurrence below the floor,
    else judge."""
    by = occurrences.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.max("similarity").alias("best"))
    known = aliases.groupBy(F.col("alias").alias("name")).agg(F.min("id").alias("id"))
    decision = F.when(F.col("id").isNotNull(), "reuse").when((F.col("n") == 1) & (F.col("best") < floor), "reject").otherwise("judge")
    return by.join(known, "name", "left").select("name", "id", decision.alias("decision"))


def round_robin(lists: DataFrame) -> DataFrame:
    """lists: request, need, rank, source -> request, source, place: needs take turns, each giving its next source that isn't chosen yet."""
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        queues = [list(g.sort_values("rank")["source"]) for _, g in pdf.sort_values("need").groupby("need")]
        out: list = []
        while any(queues):
            for q in queues:
                while q and q[0] in out:
                    q.pop(0)
                if q:
                    out.append(q.pop(0))
        return pd.DataFrame({"request": pdf["request"].iloc[0], "source": out, "place": range(1, len(out) + 1)})

    return lists.groupBy("request").applyInPandas(run, "request long, source long, place long")


def split_draft(text: str, sentences: int = 3, most: int = 520) -> list[str]:
    """Paragraphs of a draft: at most three sentences and 520 characters; a line with another speaker starts anew."""
    out: list[str] = []
    speaker = None
    for line in filter(None, map(str.strip, (text or "").split("\n"))):
        m = re.match(r"^([^\s:：][^:：]{0,38})[:：]", line)
        fresh = bool(m) and m[1] != speaker
        speaker = m[1] if m else speaker
        now: list[str] = []
        for s in re.findall(r"[^.!?。！？]+[.!?。！？]*", line):
            s = s.strip()
            if now and (len(now) == sentences or len(" ".join([*now, s])) > most):
                out.append(" ".join(now))
                now = []
            now.append(s)
        part = " ".join(now)
        if out and not fresh and len(re.findall(r"[.!?。！？]+", out[-1] + part)) <= sentences and len(out[-1]) + len(part) < most:
            out[-1] += " " + part
        elif part:
            out.append(part)
    return out
