r"""Normalised records of a source, reduced to what a reader needs: prose alone, or a compact view with metadata and one translation.

A record begins with a line ``[record: ...`` and goes on to the next one; lines that begin with ``[`` are metadata, others text, which may begin with a language
(``en: ...``) and go on over lines. Everything is done on a table of lines: what record and language a line belongs to is carried forward by windows over a source's lines.
Line ends are those of Unicode.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.dialogue import korean

#: Languages of translations in the order of preference, those that are all kept and those of which one stands in; metadata that the compact view keeps;
#: speakers that are no names.
PRIMARY, FALLBACK = ("zh-CN", "ja", "en"), ("zh-TW", "th", "unknown")
KEPT = ("[record:", "[speaker_raw:", "[evidence_origin:", "[epistemic_status:", "[evidence_generation:", "[epistemic_note:", "[document_role:", "[document_style:")
NOBODY = ("???", "unknown speaker", "未知发言者", "未标注发言者")
PREFIX = r"(?i)^(?:zh-CN|zh-TW|ja|en|ko|th|unknown):\s*"
_BREAKS = "\r\n|[\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def lines_of(sources: DataFrame) -> DataFrame:
    """id, pos (from 0), line, record (0 before the first) of sources (id, text)."""
    rows = sources.select("id", F.posexplode(F.split(F.regexp_replace("text", _BREAKS, "\n"), "\n", -1)).alias("pos", "line"))
    begun = F.sum(F.col("line").startswith("[record:").cast("int")).over(Window.partitionBy("id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("record", begun)


def _joined(order: str, value: str, by: str) -> Column:
    """Values of a group in order, nulls left out, with by between them; null if there is none."""
    held = F.array_sort(F.collect_list(F.when(F.col(value).isNotNull(), F.struct(order, value))))
    return F.when(F.size(held) > 0, F.array_join(F.transform(held, lambda x: x[value]), by))


def _starts(c: Column, prefixes) -> Column:
    return reduce(lambda a, b: a | b, [c.startswith(p) for p in prefixes])


def prose(sources: DataFrame) -> DataFrame:
    """id, text: the records' text without metadata and language marks, with the speaker before it; front matter is left out, a source without records
    is only trimmed."""
    lines, line = lines_of(sources), F.col("line")
    spoken = F.when(line.startswith("[speaker_raw:") & line.endswith("]"), strip(F.substring(line, F.lit(14), F.length(line) - 14)))
    body = F.when((F.ltrim(line) != "") & ~F.regexp_replace(line, r"(?U)^\s+", "").startswith("["), strip(F.regexp_replace(line, PREFIX, "")))
    parts = lines.where("record > 0").select("id", "pos", "record", spoken.alias("speaker"), F.when(body != "", body).alias("body"), (line == "[document_role: front_matter]").alias("front"))
    whole = parts.groupBy("id", "record").agg(F.min_by("speaker", F.when(F.col("speaker").isNotNull(), F.col("pos"))).alias("speaker"), _joined("pos", "body", "\n").alias("body"), F.max("front").alias("front"))
    named = F.col("speaker").isNotNull() & (F.col("speaker") != "") & ~F.lower("speaker").isin(*NOBODY)
    text = F.when(named, F.concat("speaker", F.lit(": "), "body")).otherwise(F.col("body"))
    told = whole.select("id", "record", F.when(~F.col("front"), text).alias("told")).groupBy("id").agg(strip(F.coalesce(_joined("record", "told", "\n\n"), F.lit(""))).alias("_told"))
    return sources.select("id", "text").join(told, "id", "left").select("id", F.coalesce("_told", strip(F.coalesce("text", F.lit("")))).alias("text"))


def compact(sources: DataFrame) -> DataFrame:
    """id, text: each record's metadata that matters, its Chinese, Japanese and English text or the first of the other languages, and the Korean text of its script.

    A language that begins again in a record replaces what it had. Records that are no reference say if nobody is named as speaker; sources without records stay as they are."""
    lines, line = lines_of(sources), F.col("line")
    lang = reduce(lambda c, name: c.when(line.startswith(f"{name}:"), name), [*PRIMARY, *FALLBACK], F.when(F.lit(False), ""))
    marked = lines.select("id", "pos", "line", "record", lang.alias("lang")).withColumn("mark", F.coalesce("lang", F.when(line.startswith("["), "")))
    carried = F.last("mark", ignorenulls=True).over(Window.partitionBy("id", "record").orderBy("pos"))
    held = marked.withColumn("now", F.when(F.col("record") > 0, F.coalesce(carried, F.lit(""))).otherwise(""))
    start = F.max(F.when(F.col("lang").isNotNull(), F.col("pos"))).over(Window.partitionBy("id", "record", "now"))
    text = F.when(F.col("lang").isNotNull(), F.regexp_replace(F.expr("substring(line, length(lang) + 2)"), r"(?U)^\s+", "")).when(strip(line) != "", line)
    spoken = held.where("now <> ''").withColumn("start", start).where("pos >= start").withColumn("said", text)
    translated = spoken.groupBy("id", "record", "now").agg(_joined("pos", "said", "\n").alias("said"))
    place = F.array_position(F.array(*[F.lit(x) for x in (*PRIMARY, *FALLBACK)]), F.col("now")).cast("int")
    told = F.struct(place.alias("place"), F.concat("now", F.lit(": "), F.coalesce("said", F.lit(""))).alias("told"))
    picked = translated.groupBy("id", "record").agg(F.array_sort(F.collect_list(told)).alias("all"))
    first = F.filter("all", lambda x: x["place"] <= len(PRIMARY))
    picked = picked.select("id", "record", F.array_join(F.transform(F.when(F.size(first) > 0, first).otherwise(F.slice("all", 1, 1)), lambda x: x["told"]), "\n").alias("told"))
    meta = F.when(_starts(line, KEPT), line)
    script = F.when(line.startswith("[script_raw:"), line)
    tags = lines.where("record > 0").select("id", "pos", "record", meta.alias("meta"), script.alias("script"), (F.lower(strip(line)) == "[document_style: reference]").alias("reference"), line.startswith("[speaker_raw:").alias("named"))
    tags = tags.groupBy("id", "record").agg(_joined("pos", "meta", "\n").alias("meta"), F.min_by("script", F.when(F.col("script").isNotNull(), F.col("pos"))).alias("script"), F.max("reference").alias("reference"), F.max("named").alias("named"))
    inner = strip(F.regexp_replace(F.substring("script", 13, 1 << 30), r"\]$", ""))
    extra = F.when(~F.col("reference") & ~F.col("named"), "[speaker_raw: ???]")
    whole = tags.join(picked, ["id", "record"], "left").select("id", "record", F.concat_ws("\n", "meta", extra, "told", F.concat(F.lit("ko: "), F.nullif(korean(inner), F.lit("")))).alias("view"))
    head = lines.where("record = 0").groupBy("id").agg(F.regexp_replace(_joined("pos", "line", "\n"), r"(?U)\s+$", "").alias("_head"))
    views = whole.groupBy("id").agg(_joined("record", "view", "\n\n").alias("_view")).join(head, "id", "left")
    return sources.select("id", "text").join(views, "id", "left").select("id", F.when(F.col("_view").isNull(), F.col("text")).otherwise(F.concat(F.coalesce("_head", F.lit("")), F.lit("\n\n"), "_view")).alias("text"))
