"""Excerpts, record windows and receipts bound to sources."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .segments import record_spans

_LEGEND = re.compile(r"^\[aliases?:\s*(.*?)\]\s*$", re.I | re.M | re.S)


def parse_legend(text: str) -> dict[str, dict[str, str]]:
    """[aliases: name: lang=alias | lang=alias; ...] over one line or more -> {name: {lang: alias}}."""
    out: dict[str, dict[str, str]] = {}
    for m in _LEGEND.finditer(text or ""):
        for entry in re.split(r"[;\n]", m[1]):
            name, _, rest = entry.partition(":")
            pairs = dict(tuple(map(str.strip, p.split("=", 1))) for p in rest.split("|") if "=" in p)
            if name.strip() and pairs:
                out.setdefault(name.strip(), {}).update(pairs)
    return out


def grow_window(spans: list[tuple[int, int]], anchor: int, most: int, closed: list[tuple[int, int]] = ()) -> tuple[int, int]:
    """Records around an anchor record: the neighbour that adds fewer characters comes next (ties: the left one), while the window stays within most
    characters and meets no closed span."""
    low = high = anchor
    free = lambda a, b: all(b <= x or a >= y for x, y in closed)
    while True:
        options = []
        if low > 0 and free(spans[low - 1][0], spans[high][1]):
            options.append((spans[low][0] - spans[low - 1][0], 0))
        if high + 1 < len(spans) and free(spans[low][0], spans[high + 1][1]):
            options.append((spans[high + 1][1] - spans[high][1], 1))
        options = [o for o in sorted(options) if spans[high][1] - spans[low][0] + o[0] <= most]
        if not options:
            return spans[low][0], spans[high][1]
        low, high = (low - 1, high) if options[0][1] == 0 else (low, high + 1)


def excerpt(text: str, quotes=(), keywords=(), budget: int = 3000, picks: int = 12) -> str:
    """Verified quotes first, as many as fit; else blocks with keywords and their neighbours, at most twelve picks; else the head and the tail."""
    if len(text) <= budget:
        return text
    out, used = [], 0
    for q in dict.fromkeys(q for q in quotes if q and q in text):
        if used + len(q) + 2 <= budget:
            out.append((text.index(q), q))
            used += len(q) + 2
    if not out and keywords:
        spans = record_spans(text)
        hits = [i for i, (a, b) in enumerate(spans) if any(k.lower() in text[a:b].lower() for k in keywords if k)]
        for i in list(dict.fromkeys(j for h in hits for j in (h, h - 1, h + 1) if 0 <= j < len(spans)))[:picks]:
            a, b = spans[i]
            if used + b - a + 2 <= budget:
                out.append((a, text[a:b]))
                used += b - a + 2
    if out:
        return "\n\n".join(t for _, t in sorted(out))
    half = (budget - 5) // 2
    return text[:half] + "\n...\n" + text[-half:]


def excerpts(requests: DataFrame, budget: int = 3000) -> DataFrame:
    """requests: id, text, quotes, keywords (arrays) -> id, excerpt."""

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "excerpt": [excerpt(t or "", list(q) if q is not None else [], list(k) if k is not None else [], budget) for t, q, k in zip(pdf["text"], pdf["quotes"], pdf["keywords"])]})

    return requests.select("id", "text", "quotes", "keywords").mapInPandas(run, "id long, excerpt string")


def resolve_records(references: DataFrame, sources: DataFrame) -> DataFrame:
    """references: record_id, source_id, start, end, digest (of the record's text); sources: source_id, text -> status: missing_source, outside, changed or resolved."""
    j = references.join(sources.select("source_id", "text"), "source_id", "left")
    own = F.sha2(F.expr("substring(text, int(start) + 1, int(end - start))"), 256)
    bad = (F.col("start") < 0) | (F.col("end") > F.length("text")) | (F.col("start") >= F.col("end"))
    return j.withColumn("status", F.when(F.col("text").isNull(), "missing_source").when(bad, "outside").when(own != F.col("digest"), "changed").otherwise("resolved")).drop("text")


def valid_learned_edges(evidence: DataFrame, sources: DataFrame) -> DataFrame:
    """evidence: edge, source_id, source_hash, start, length, quote; sources: source_id, text -> edges all of whose evidence still holds."""
    ok = F.coalesce((F.sha2("text", 256) == F.col("source_hash")) & (F.expr("substring(text, start + 1, length)") == F.col("quote")), F.lit(False))
    return evidence.join(sources, "source_id", "left").groupBy("edge").agg(F.bool_and(ok).alias("ok")).where("ok").select("edge")


def promotable(ledger: DataFrame) -> DataFrame:
    """Ledger rows that count for promotion: no shadow, no harm, factual, with a gain in recall; in order of id."""
    return ledger.where("NOT is_shadow AND harm = 0 AND factual AND recall_gain > 0").orderBy("id")


def growth_gate(changed: DataFrame, treatment_paths: DataFrame, new_episodes: DataFrame) -> DataFrame:
    """changed: request, edge; paths: request, edge; new episodes: request -> changed edges that a path of the treatment uses, where the treatment has a new episode."""
    return changed.join(treatment_paths.select("request", "edge").distinct(), ["request", "edge"], "left_semi").join(new_episodes.select("request").distinct(), "request", "left_semi")


def open_spans(windows: DataFrame, closed: DataFrame) -> DataFrame:
    """Windows (id, start, end) that overlap no closed span (id, lo, hi) of their id."""
    bad = windows.join(closed, "id").where("start < hi AND end > lo").select("id", "start", "end").distinct()
    return windows.join(bad, ["id", "start", "end"], "left_anti")
