"""Row generators over texts: segments, paragraphs, records and chunks. Offsets are code points."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_RECORD = re.compile(r"^\[record: \d+\][^\n]*$", re.M)
_BLANK = re.compile(r"\n[ \t]*\n")
_PIECE = {"id": pa.int64(), "part": pa.int64(), "start": pa.int64(), "end": pa.int64(), "text": pa.string()}
#: Characters of pieces that a task holds before it gives them out.
HELD = 1 << 20


def _trimmed(text: str, low: int, high: int) -> tuple[int, int] | None:
    high = low + len(text[low:high].rstrip())
    lead = len(text[low:high]) - len(text[low:high].lstrip())
    return (low + lead, high) if low + lead < high else None


def record_spans(text: str) -> list[tuple[int, int]]:
    """Absolute spans of records: from marker to marker where a text has markers, else blank-line blocks; trimmed."""
    marks = [m.start() for m in _RECORD.finditer(text)]
    if marks:
        edges = [*marks, len(text)]
        found = [_trimmed(text, a, b) for a, b in zip(edges, edges[1:])]
    else:
        at, found = 0, []
        for m in _BLANK.finditer(text):
            found.append(_trimmed(text, at, m.start()))
            at = m.end()
        found.append(_trimmed(text, at, len(text)))
    return [s for s in found if s]


def paragraphs(text: str, target: int = 900, most: int = 1400, overlap: int = 200, tail: int = 200) -> list[str]:
    """Records packed to about target characters; one that would pass most starts anew; the last records within overlap are repeated at the
    start of the next; a short tail is joined to what is before."""
    records = [text[a:b] for a, b in record_spans(text)]
    out: list[list[str]] = []
    now: list[str] = []
    fresh = 0  # records of now that no earlier paragraph has
    for r in records:
        size = sum(map(len, now)) + 2 * len(now)
        if now and fresh and (size >= target or size + len(r) > most):
            out.append(now)
            carry, n = [], 0
            for old in reversed(now):
                if n + len(old) > overlap:
                    break
                carry.insert(0, old)
                n += len(old) + 2
            now, fresh = carry, 0
        now = [*now, r]
        fresh += 1
    if now and fresh:
        new = now[len(now) - fresh :]
        if out and sum(map(len, new)) < tail:
            out[-1] = out[-1] + new
        else:
            out.append(now)
    return ["\n\n".join(p) for p in out]


def chunks(text: str, most: int = 2000, least: int = 1000) -> list[str]:
    """Pieces of at most most characters, cut after the last sentence mark at or after least, else hard."""
    out = []
    while len(text) > most:
        cut = max((text.rfind(c, least, most) for c in "。！？.!?\n"), default=-1) + 1 or most
        out.append(text[:cut])
        text = text[cut:]
    return [*out, text] if text else out


def natural_segments(blocks: list[dict], target: int = 6000, most: int = 8000, overlap: int = 800) -> list[list[int]]:
    """blocks: {text, boundary (0-3), style, role} in order -> lists of block positions.

    A boundary of 3 breaks hard and without overlap; once target is reached the best boundary of 2 since half of it is taken, else the
    segment ends before it would pass most; reference style breaks at 10 blocks without overlap; front matter is dropped."""
    return [[b["_at"] for b in part] for part in segments_of(({**b, "_at": i} for i, b in enumerate(blocks)), target, most, overlap)]


def segments_of(blocks: Iterable[dict], target: int = 6000, most: int = 8000, overlap: int = 800) -> Iterator[list[dict]]:
    """natural_segments() as they close: no more than one segment's blocks are held."""
    now: list[dict] = []
    fresh = 0
    size = lambda part: sum(len(b["text"]) + 2 for b in part)

    def close(part, rest, hard):
        nonlocal now, fresh
        carry: list[dict] = []
        if not hard and not rest:
            for b in reversed(part):
                room = overlap if carry else max(2 * overlap, overlap + 256)
                if b.get("style") == "reference" or size([b, *carry]) > room or len(carry) + 1 >= len(part):
                    break
                carry.insert(0, b)
        now, fresh = carry + rest, len(rest)
        return part

    for block in blocks:
        if block.get("role") == "front_matter":
            continue
        reference = block.get("style") == "reference"
        if now and fresh:
            if block.get("boundary", 0) >= 3:
                yield close(now, [], True)
            elif reference and len(now) >= 10:
                yield close(now, [], True)
            elif size([*now, block]) > most:
                yield close(now, [], False)
            elif size(now) >= target:
                soft = [k for k in range(len(now) - fresh + 1, len(now)) if now[k].get("boundary", 0) >= 2 and size(now[:k]) >= target / 2]
                if block.get("boundary", 0) >= 2 or not soft:
                    yield close(now, [], False)
                else:
                    k = max(soft)
                    yield close(now[:k], now[k:], False)
        now = [*now, block]
        fresh += 1
    if now and fresh:
        yield now


def explode_texts(docs: DataFrame, what: str) -> DataFrame:
    """docs: id, text -> id, part (from 0), start, end, text of records, paragraphs or chunks (start and end only of records)."""

    def pieces(i, text):
        if what == "records":
            return [(i, k, a, b, text[a:b]) for k, (a, b) in enumerate(record_spans(text))]
        return [(i, k, None, None, t) for k, t in enumerate(paragraphs(text) if what == "paragraphs" else chunks(text))]

    def batch(rows):
        columns = zip(*rows) if rows else ((),) * len(_PIECE)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _PIECE.values())], list(_PIECE))

    def run(batches):
        rows, size = [], 0
        for b in batches:
            for i, text in zip(b.column(0), b.column(1)):
                found = pieces(i.as_py(), text.as_py() or "")
                rows += found
                size += sum(len(r[-1]) for r in found)
                if size > HELD:
                    yield batch(rows)
                    rows, size = [], 0
        if rows:
            yield batch(rows)

    own = docs.select(F.col("id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(run, "id long, part long, start long, end long, text string")


def segment_files(blocks: DataFrame, **limits) -> DataFrame:
    """blocks: source_key, position, text, boundary, style, role -> source_key, segment_index, positions, text (rendered with its header).

    Blocks come sorted and segments go as they close, so a source of any size takes a segment's memory."""
    schema = pa.schema([("source_key", pa.string()), ("segment_index", pa.int64()), ("positions", pa.list_(pa.int64())), ("text", pa.string())])
    names = ["source_key", "position", "text", "boundary", "style", "role"]

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)

    def read(batches):
        for b in batches:
            columns = [b.column(k) for k in range(len(names))]
            for values in zip(*columns):
                row = dict(zip(names, (v.as_py() for v in values)))
                yield row | {"text": row["text"] or "", "boundary": row["boundary"] or 0}

    def run(batches):
        rows, held = [], 0
        for key, own in groupby(read(batches), lambda row: row["source_key"]):
            for k, part in enumerate(segments_of(own, **limits)):
                body = "\n\n".join(b["text"] for b in part)
                rows.append((key, k, [int(b["position"]) for b in part], f"[source_key: {key}]\n[segment_index: {k}]\n\n{body}"))
                held += len(body)
                if held > HELD:
                    yield batch(rows)
                    rows, held = [], 0
        if rows:
            yield batch(rows)

    own = blocks.select(F.col("source_key").cast("string").alias("source_key"), *names[1:]).repartition("source_key").sortWithinPartitions("source_key", "position")
    return own.mapInArrow(run, "source_key string, segment_index long, positions array<long>, text string")


def project_window(records: DataFrame, windows: DataFrame) -> DataFrame:
    """records: id, record, lo, hi; windows: id, start, end -> id, complete (records inside), incomplete (cut ones), consumed_end: the least start of a cut
    record that begins inside the window, else the window's end."""
    hit = windows.join(records, "id").where("lo < end AND hi > start")
    inside = (F.col("lo") >= F.col("start")) & (F.col("hi") <= F.col("end"))
    return hit.groupBy("id", "start", "end").agg(
        F.array_sort(F.collect_list(F.when(inside, F.col("record")))).alias("complete"), F.array_sort(F.collect_list(F.when(~inside, F.col("record")))).alias("incomplete"),
        F.least("end", F.coalesce(F.min(F.when(~inside & (F.col("lo") >= F.col("start")), F.col("lo"))), "end")).alias("consumed_end"),
    )


def align_window(records: DataFrame, windows: DataFrame) -> DataFrame:
    """Windows widened to all records they touch."""
    return windows.join(records, "id").where("lo < end AND hi > start").groupBy("id", "start", "end").agg(F.least("start", F.min("lo")).alias("lo"), F.greatest("end", F.max("hi")).alias("hi"))


def verify_quotes(quotes: DataFrame, sources: DataFrame) -> DataFrame:
    """quotes: source_id, quote; sources: source_id, text -> outcome of each: missing_source, empty, verified or not_found."""
    joined = quotes.join(sources.select("source_id", "text"), "source_id", "left")
    outcome = F.when(F.col("text").isNull(), "missing_source").when(F.trim("quote") == "", "empty").when(F.instr(F.col("text"), F.col("quote")) > 0, "verified").otherwise("not_found")
    return joined.withColumn("outcome", outcome).drop("text")


def gaps(lines: DataFrame, spans: DataFrame, least: int) -> DataFrame:
    """lines: id, line; spans: id, first, last -> runs of at least that many lines that no span covers, as islands: id, first, last, n."""
    from pyspark.sql import Window

    covered = lines.join(spans, "id").where("line BETWEEN first AND last").select("id", "line").distinct()
    left = lines.select("id", "line").distinct().join(covered, ["id", "line"], "left_anti")
    island = F.col("line") - F.row_number().over(Window.partitionBy("id").orderBy("line"))
    return left.withColumn("_i", island).groupBy("id", "_i").agg(F.min("line").alias("first"), F.max("line").alias("last"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).drop("_i")
