r"""Quality rules: a threshold table compiled into one Spark projection.

Everything is built-in functions over one row at a time, so the plan is a scan and a projection
without a shuffle. Words are ``[^\x20\x09-\x0D]+``.

Edge cases: a null text counts as empty (no words, hence ``base_failed``); a null ``doc_id`` is kept
as it is; repeated rows give repeated results; an empty table gives an empty result; columns of the
input other than ``doc_id`` and ``text`` are ignored.

Repeated windows: word positions and a hash of each three-word window share one 64-bit key, sorted inside the row, so that equal windows are neighbours.
Neighbours are compared word by word. If two neighbours have one hash and different words, the row's windows are
sorted by their words instead. So the count is exact whatever the hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pick

#: Frequent function words of the languages handled.
STOP_WORDS = {
    "en": "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which you were her all she there would their",
    "fr": "le la les de des du et en un une que qui est pour dans sur pas avec ce au il elle par plus",
    "de": "der die das und in den von zu mit sich des auf ist im nicht ein eine als auch es an dem für",
    "es": "el la los las de del y en un una que es por para con no se su al lo como más",
}

#: (measure, comparison that must hold, bound). One failing row rejects the document.
THRESHOLDS = [
    ("n_words", ">=", 50),
    ("n_words", "<=", 10_000_000),
    ("mean_word_length", ">=", 1.5),
    ("mean_word_length", "<=", 30.0),
    ("symbol_ratio", "<=", 0.05),
    ("stop_word_ratio", ">=", 0.01),
    ("duplicate_line_ratio", "<=", 0.5),
    ("repeat_word_ratio", "<=", 0.5),
]

SYMBOLS = "#*$%&|<>"


def _let(value: Column, body) -> Column:
    """body(value) with value computed once for the row: Catalyst may copy an expression, a lambda variable it can't."""
    return F.transform(F.array(value), body)[0]


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _visible(text: Column) -> Column:
    """text without white space"""
    return F.translate(text, " \t\n\x0b\x0c\r", "")


def _repeat_words(words: Column) -> Column:
    """Words inside three-word windows that occur twice or more."""
    n = F.size(words)

    def counted(mask: Column) -> Column:
        def key(i):
            return F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).bitwiseAND(F.bitwise_not(mask)).bitwiseOR(i.cast("long"))

        def one_hash(s, a, b):
            return F.get(s, a).bitwiseOR(mask) == F.get(s, b).bitwiseOR(mask)

        def one_window(s, a, b):
            p, q = F.get(s, a).bitwiseAND(mask).cast("int"), F.get(s, b).bitwiseAND(mask).cast("int")
            return (F.get(words, p) == F.get(words, q)) & (F.get(words, p + 1) == F.get(words, q + 1)) & (F.get(words, p + 2) == F.get(words, q + 2))

        def places(s):
            return F.sequence(F.lit(0), F.size(s) - 1)

        def starts(s):
            hit = F.filter(places(s), lambda j: F.coalesce(one_hash(s, j, j - 1), F.lit(False)) | F.coalesce(one_hash(s, j, j + 1), F.lit(False)))
            return F.array_sort(F.transform(hit, lambda j: F.get(s, j).bitwiseAND(mask).cast("int")))

        def mixed_up(s):
            """Whether neighbours of one hash differ; if none do, all of a hash are equal."""
            return F.exists(places(s), lambda j: F.coalesce(one_hash(s, j, j + 1) & ~one_window(s, j, j + 1), F.lit(False)))

        def starts_by_words():
            windows = F.sort_array(F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(F.get(words, i).alias("a"), F.get(words, i + 1).alias("b"), F.get(words, i + 2).alias("c"), i.alias("i"))))

            def of(s):
                equal = lambda x, y: F.coalesce((x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"]), F.lit(False))
                hit = F.filter(places(s), lambda j: equal(F.get(s, j), F.get(s, j - 1)) | equal(F.get(s, j), F.get(s, j + 1)))
                return F.array_sort(F.transform(hit, lambda j: F.get(s, j)["i"]))

            return _let(windows, of)

        def covered(p):
            return F.when(F.size(p) == 0, F.lit(0).cast("long")).otherwise(
                F.aggregate(F.sequence(F.lit(0), F.size(p) - 1), F.lit(0).cast("long"), lambda acc, k: acc + F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - F.get(p, k), F.lit(3))).cast("long"))
            )

        keys = F.sort_array(F.transform(F.sequence(F.lit(0), n - 3), key))
        return _let(keys, lambda s: _let(F.when(mixed_up(s), starts_by_words()).otherwise(starts(s)), covered))

    mask = F.pow(F.lit(2.0), F.floor(F.log2(n)) + 1).cast("long") - 1
    return F.when(n < 3, F.lit(0).cast("long")).otherwise(_let(mask, counted))


def measures(text: Column) -> Column:
    """A struct of counts and ratios of one text."""
    stop = sorted({w for ws in STOP_WORDS.values() for w in ws.split()})

    def of(t):
        def with_words(words):
            lines = F.filter(F.split(t, "\n"), lambda x: F.length(_visible(x)) > 0)
            return F.struct(
                F.size(words).cast("long").alias("n_words"),
                F.length(_visible(t)).cast("long").alias("word_chars"),
                (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
                _let(lines, lambda x: F.struct((F.size(x)).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("lines"),
                _repeat_words(words).alias("n_repeat_words"),
                F.size(F.filter(words, lambda w: F.lower(w).isin(stop))).cast("long").alias("n_stop_words"),
            )

        return _let(_words(t), with_words)

    return _let(F.coalesce(text, F.lit("")), of)


def ratios(m: Column) -> dict[str, Column]:
    def over(a, b):
        return F.when(m[b] > 0, m[a] / m[b]).otherwise(F.lit(0.0)) if isinstance(b, str) else F.when(b > 0, a / b).otherwise(F.lit(0.0))

    return {
        "n_words": m["n_words"],
        "mean_word_length": over("word_chars", "n_words"),
        "symbol_ratio": over("n_symbols", "word_chars"),
        "stop_word_ratio": over("n_stop_words", "n_words"),
        "duplicate_line_ratio": over(m["lines"]["dup"], m["lines"]["n"]),
        "repeat_word_ratio": over("n_repeat_words", "n_words"),
    }


def compile_rules(thresholds, of: dict[str, Column]) -> Column:
    """The threshold table as one boolean column."""
    verdict = F.lit(True)
    for name, sign, bound in thresholds:
        verdict = verdict & ((of[name] >= bound) if sign == ">=" else (of[name] <= bound))
    return verdict


def judge(docs: DataFrame, thresholds=THRESHOLDS) -> DataFrame:
    """doc_id, the counts, each ratio, base_failed and kept."""
    m = F.col("_m")
    of = ratios(m)
    base = (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
    measured = pick(docs, "doc_id", "text").select("doc_id", measures(F.col("text")).alias("_m"))
    return measured.select(
        "doc_id",
        m["n_words"].alias("n_words"),
        m["word_chars"].alias("word_chars"),
        m["n_symbols"].alias("n_symbols"),
        m["lines"]["dup"].alias("n_dup_lines"),
        m["n_repeat_words"].alias("n_repeat_words"),
        base.alias("base_failed"),
        (~base & compile_rules(thresholds, of)).alias("kept"),
        *[c.alias(k) for k, c in of.items() if k != "n_words"],
    )


def keep_good(docs: DataFrame, thresholds=THRESHOLDS) -> DataFrame:
    """The documents that pass, with their own columns in their order.

    The verdict is worked out on the row itself, so repeated ids and null ids are judged one by one."""
    names = docs.columns
    safe = docs.toDF(*[f"_d{i}" for i in range(len(names))])
    m = F.col("_m")
    base = (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
    judged = safe.withColumn("_m", measures(F.col(f"_d{names.index('text')}")))
    return judged.where(~base & compile_rules(thresholds, ratios(m))).drop("_m").toDF(*names)


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return judge(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def oracle() -> str:
    stop = ", ".join("'" + w + "'" for w in sorted({w for ws in STOP_WORDS.values() for w in ws.split()}))
    of = {
        "n_words": "n_words",
        "mean_word_length": "(CASE WHEN n_words > 0 THEN word_chars::DOUBLE / n_words ELSE 0 END)",
        "symbol_ratio": "(CASE WHEN word_chars > 0 THEN n_symbols::DOUBLE / word_chars ELSE 0 END)",
        "stop_word_ratio": "(CASE WHEN n_words > 0 THEN n_stop::DOUBLE / n_words ELSE 0 END)",
        "duplicate_line_ratio": "(CASE WHEN n_lines > 0 THEN n_dup_lines::DOUBLE / n_lines ELSE 0 END)",
        "repeat_word_ratio": "(CASE WHEN n_words > 0 THEN n_repeat_words::DOUBLE / n_words ELSE 0 END)",
    }
    rules = " AND ".join(f"{of[k]} {sign} {bound}" for k, sign, bound in THRESHOLDS)
    return rf"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
    w AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
                 list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM d),
    win AS (SELECT r, i, [ws[i], ws[i + 1], ws[i + 2]] AS x FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
    rep AS (SELECT r, i FROM win QUALIFY count(*) OVER (PARTITION BY r, x) > 1),
    cov AS (SELECT r, count(DISTINCT p) AS c FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY r),
    m AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(translate(t, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), ''))::BIGINT AS word_chars,
                 (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols, len(ls)::BIGINT AS n_lines,
                 (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(c, 0)::BIGINT AS n_repeat_words,
                 len(list_filter(ws, lambda x: list_contains([{stop}], lower(x))))::BIGINT AS n_stop
          FROM w LEFT JOIN cov USING (r)),
    b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {rules} AS kept FROM b"""
