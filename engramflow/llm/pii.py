r"""Personal data by bootstrapped contextual extraction.

1. Base entities (email, ip, card, phone) are found by fixed patterns in each whole text. They are the
   seeds. Candidates are every other chunk without white space that holds a digit or ``@``, stripped of punctuation at its ends, and every run of
   two or more digit groups joined by single blanks, dots, hyphens or brackets.
2. Each seed and candidate (a mention) gives two lexical contexts: the two words before it, and the word
   before with the word after. Contexts and surfaces form a bipartite graph, one edge for each pair with
   its count. Surfaces of over ``LONG`` characters stand in it by a digest, words (or what of a word is beside the mention) by
   their first and last ``ENDS`` characters and their length, so that many mentions beside one long word don't read it each time.
3. Spark scores the graph in ``ROUNDS`` rounds of joins and aggregations. A pattern (context, kind) scores the
   share of its mentions whose surface is believed to be of the kind, ``sum(n * belief) / (sum(n) + 1)``, and needs
   ``MIN_SEEDS`` distinct surfaces that are seeds or believed with ``MIN_BELIEF`` in the round before, so surfaces that were found induce
   new patterns. The belief in a surface is 1 for seeds, else noisy-or over its patterns that score ``MIN_PATTERN`` or more.
4. Candidates whose surface is believed with ``MIN_BELIEF`` or more become further spans of that kind (the
   most believed; ties: the first of the kinds as listed), unless they lie inside a longer one.

The text is read once, in time proportional to its length; the graph is built from the mentions, which are few, and never leaves the
executors. All contexts and surfaces take part; none is capped or broadcast.

Edge cases: null text counts as empty; null and repeated ids are kept, one result for each row; an empty
table gives an empty result; other columns are ignored. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, pick, table, trim

KINDS = ("email", "ip", "card", "phone")
ROUNDS, MIN_SEEDS, MIN_PATTERN, MIN_BELIEF = 3, 3, 0.5, 0.6
#: Characters beyond which a surface is known by its digest and a word by ENDS characters of either end and its length.
LONG, ENDS = 128, 48
#: The base patterns.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_PHONE = re.compile(PATTERNS["phone"])
_NAME_END = re.compile(r"[A-Za-z0-9._%+-]+")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CHUNK = re.compile(r"[^\x20\x09-\x0D]+")
_MARK = re.compile(r"[0-9@]")
_CARD = re.compile(r"[0-9]++(?:[ -][0-9]++)*+")
_GROUPS = re.compile(r"(?<![0-9])\(?[0-9]++(?:(?:\) ?|[ .-]\(?)[0-9]++)++")
_NOT_DIGIT = re.compile(r"[^0-9]")
_PUNCTUATION = ".,;:!?\"'()[]{}<>"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _valid(kind: str, found: str) -> bool:
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in found.split("."))
    digits = _NOT_DIGIT.sub("", found)
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 8 <= len(digits) <= 15


def _emails(text: str):
    """The pattern's matches, looked for at every ``@``: the name before it reaches back to the ``@`` or match before, so no character is read again."""
    done, at = 0, text.find("@")
    while at >= 0:
        name = _NAME_END.match(text[done:at][::-1])
        domain = _DOMAIN.match(text, at + 1) if name else None
        if domain:
            yield at - name.end(), domain.end()
        done = domain.end() if domain else at + 1
        at = text.find("@", max(done, at + 1))


def _ips(text: str):
    """The pattern's matches: each run of digits joined by single dots gives its parts four by four."""
    for run in _DOTTED.finditer(text):
        if run[0].count(".") < 3:
            continue
        parts, at = run[0].split("."), run.start()
        for k in range(0, len(parts) - 3, 4):
            found = ".".join(parts[k : k + 4])
            yield at, at + len(found)
            at += len(found) + 1


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind's number, start, end), by kind, then start."""
    spans = [(0, *s) for s in _emails(text)]
    spans += [(1, s, e) for s, e in _ips(text) if _valid("ip", text[s:e])]
    spans += [(2, m.start(), m.end()) for m in _CARD.finditer(text) if m.end() - m.start() >= 16 and _valid("card", m[0])]
    return spans + [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if _valid("phone", m[0])]


def _surface(found: str) -> str:
    """A surface as the graph has it."""
    return found.lower() if len(found) <= LONG else f"{found[:8].lower()}#{hashlib.md5(found.lower().encode('utf-8', 'replace')).hexdigest()}"


def _word(text: str, start: int, end: int) -> str:
    """A word, text[start:end], as the graph has it."""
    if end - start <= LONG:
        return text[start:end].lower()
    return f"{text[start : start + ENDS].lower()}#{end - start}#{text[end - ENDS : end].lower()}"


def _candidates(text: str, words: list[tuple[int, int]], starts: list[int], covered: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Words with a digit or @ and runs of digit groups that touch no covered span (sorted, apart), by start."""
    found, m = set(), _MARK.search(text)
    while m:
        low, high = words[bisect_right(starts, m.start()) - 1]
        inner = text[low:high]
        start, end = low + len(inner) - len(inner.lstrip(_PUNCTUATION)), low + len(inner.rstrip(_PUNCTUATION))
        if start < end:
            found.add((start, end))
        m = _MARK.search(text, high)
    found.update(g.span() for g in _GROUPS.finditer(text))
    out, at = [], 0
    for start, end in sorted(found):
        while at < len(covered) and covered[at][1] <= start:
            at += 1
        if at == len(covered) or covered[at][0] >= end:
            out.append((start, end))
    return out


def _apart(spans) -> list[tuple[int, int]]:
    """Spans sorted, those that touch or overlap as one."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


def mentions(text: str) -> tuple[list[tuple], list[tuple]]:
    """Base spans, and all mentions as (kind's number or -1, start, end, surface, words before, words around)."""
    base = base_spans(text)
    covered = _apart((s, e) for _, s, e in base)
    if not base and not _MARK.search(text):
        return base, []
    words = [m.span() for m in _CHUNK.finditer(text)]
    starts, ends = [s for s, _ in words], [e for _, e in words]
    spans, rows = base + [(-1, s, e) for s, e in _candidates(text, words, starts, covered)], []
    for k, s, e in spans:
        i, j = bisect_left(starts, s), bisect_right(ends, e)  # words that begin before the mention; the first that ends after it
        before = [_word(text, a, min(b, s)) for a, b in words[max(0, i - 2) : i]]
        after = _word(text, max(starts[j], e), ends[j]) if j < len(words) else ""
        rows.append((k, s, e, _surface(text[s:e]), " ".join(before) if len(before) == 2 else "", f"{before[-1]} _ {after}" if before and after else ""))
    return base, rows


_MENTION = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("surface", pa.string()), ("before", pa.string()), ("around", pa.string())]))
_FOUND = "doc_id long, h long, base array<struct<kind:int,start:long,end:long>>, mentions array<struct<kind:int,start:long,end:long,surface:string,before:string,around:string>>"


def find(docs: DataFrame) -> DataFrame:
    """doc_id, h (a hash of the text), base spans and mentions of every row."""
    names = ("kind", "start", "end", "surface", "before", "around")
    base_type = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        trim()
        for b in batches:
            marked = pc.fill_null(pc.match_substring_regex(b.column(2), "[0-9@]"), False).to_pylist()
            base, rows = [], []
            for i, hit in enumerate(marked):
                x, y = mentions(b.column(2)[i].as_py()) if hit else ([], [])
                base.append([dict(zip(names, s)) for s in x])
                rows.append([dict(zip(names, s)) for s in y])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(base, base_type), pa.array(rows, _MENTION)], ["doc_id", "h", "base", "mentions"])

    d = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), F.col("text").cast("string").alias("text"))
    return d.mapInArrow(run, _FOUND)


def score(edges: DataFrame, seeds: DataFrame, rounds: int = ROUNDS, min_seeds: int = MIN_SEEDS, min_pattern: float = MIN_PATTERN, min_belief: float = MIN_BELIEF) -> DataFrame:
    """edges: context, surface, n; seeds: surface, kind -> surface, kind, belief of surfaces that aren't seeds of the kind."""
    edges = cut(edges)
    all_n = cut(edges.groupBy("context").agg(F.sum("n").alias("all_n")))
    known = seeds.select("surface", "kind", F.lit(1.0).alias("belief"))
    belief, new = known, known.limit(0)
    for _ in range(rounds):
        hits = edges.join(belief, "surface").groupBy("context", "kind").agg(F.sum(F.col("n") * F.col("belief")).alias("s"), F.countDistinct(F.when(F.col("belief") >= min_belief, F.col("surface"))).alias("k"))
        patterns = hits.where(F.col("k") >= min_seeds).join(all_n, "context").select("context", "kind", (F.col("s") / (F.col("all_n") + 1)).alias("score")).where(F.col("score") >= min_pattern)
        found = edges.join(patterns, "context").groupBy("surface", "kind").agg((-F.expm1(F.sum(F.log1p(-F.col("score"))))).alias("belief"))
        new = cut(found.join(seeds, ["surface", "kind"], "left_anti"))
        belief = known.unionByName(new)
    return new


def extract(docs: DataFrame, min_belief: float = MIN_BELIEF, **how) -> DataFrame:
    """doc_id, h (a hash of the text), base and more: arrays of (kind, start, end) for every row of docs."""
    found = cut(find(docs).withColumn("row", F.monotonically_increasing_id()))
    flat = found.select("row", F.explode("mentions").alias("m")).select("row", "m.*")
    seeds = cut(flat.where("kind >= 0").select("surface", "kind").distinct())
    edges = flat.select("surface", F.explode(F.array(F.concat(F.lit("b:"), "before"), F.concat(F.lit("a:"), "around"))).alias("context")).where("length(context) > 2").groupBy("context", "surface").agg(F.count(F.lit(1)).alias("n"))
    belief = score(edges, seeds, min_belief=min_belief, **how).where(F.col("belief") >= min_belief)
    best = belief.withColumn("rank", F.row_number().over(Window.partitionBy("surface").orderBy(F.desc("belief"), "kind"))).where("rank = 1").select("surface", F.col("kind").alias("as_kind"))
    more = flat.where("kind < 0").join(best, "surface").groupBy("row").agg(F.collect_list(F.struct(F.col("as_kind").alias("kind"), "start", "end")).alias("more"))
    inside = lambda x: F.exists("more", lambda y: (y["start"] <= x["start"]) & (y["end"] >= x["end"]) & (y["end"] - y["start"] > x["end"] - x["start"]))
    more = more.select("row", F.filter("more", lambda x: ~inside(x)).alias("more"))
    return found.drop("mentions").join(more, "row", "left").select("doc_id", "h", "base", F.coalesce("more", F.array().cast("array<struct<kind:int,start:long,end:long>>")).alias("more"))


def _joined(spans):
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.sort_array(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, **how) -> DataFrame:
    """docs with every span of the text replaced by its kind in angle brackets; overlapping spans become one, named by the first.

    Rows keep their columns and order of columns; n_chars, where there is one, is set to the new length."""
    names = docs.columns
    safe = docs.toDF(*[f"_d{i}" for i in range(len(names))])
    text, key = f"_d{names.index('text')}", F.col(f"_d{names.index('doc_id')}").cast("long")
    spans = extract(safe.select(key.alias("doc_id"), F.col(text).alias("text")), **how)
    spans = spans.select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"), F.concat("base", "more").alias("_spans")).where(F.size("_spans") > 0).dropDuplicates(["_id", "_h"])

    def run(batches):
        trim()
        for b in batches:
            out = []
            for t, ss in zip(b.column(text).to_pylist(), b.column("_spans").to_pylist()):
                if t is not None and ss:
                    parts, at = [], 0
                    for s in sorted(ss, key=lambda s: (s["start"], s["kind"])):
                        if s["start"] >= at:
                            parts += [t[at : s["start"]], f"<{KINDS[s['kind']]}>"]
                        at = max(at, s["end"])
                    t = "".join(parts) + t[at:]
                out.append(t)
            keep = [c for c in b.schema.names if c not in ("_spans", text)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), *[b.column(c) for c in keep]], [text, *keep])

    joined = safe.join(spans, key.eqNullSafe(F.col("_id")) & (F.xxhash64(text) == F.col("_h")), "left").drop("_id", "_h")
    kinds = dict(safe.dtypes)
    keep = [c for c in joined.columns if c not in ("_spans", text)]
    done = joined.select(text, *keep, "_spans").mapInArrow(run, ", ".join([f"`{text}` string", *[f"`{c}` {kinds[c]}" for c in keep]]))
    if "n_chars" in names:
        at = f"_d{names.index('n_chars')}"
        done = done.withColumn(at, F.length(text).cast(kinds[at]))
    return done.select(*[f"_d{i}" for i in range(len(names))]).toDF(*names)


def query(spark, sf_dir: str) -> DataFrame:
    x = extract(table(spark, sf_dir, "documents"))
    count = [F.size(F.filter(F.col("base")["kind"], lambda x: x == F.lit(KINDS.index(kind)))).cast("long").alias(f"n_{kind}") for kind in KINDS]
    return x.select("doc_id", *count, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.concat("base", "more")).alias("spans"))


def brute_force(text: str | None) -> tuple[list[tuple[str, int, int]], str]:
    """Base spans and their digest by the definition, for tests."""
    spans = [(kind, m.start(), m.end()) for kind in KINDS for m in re.finditer(PATTERNS[kind], text or "") if _valid(kind, m[0])]
    return spans, hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()
