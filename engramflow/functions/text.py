"""Text normal forms and tokenisers that Spark has no built-in for, as Arrow-batched functions."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

_CJK = "㐀-䶿一-鿿豈-﫿"
_KANA_HANGUL = "぀-ヿ가-힯"
_WIDE = re.compile(f"[{_CJK}{_KANA_HANGUL}]")
_RUN = re.compile(f"[{_CJK}{_KANA_HANGUL}]+")
_LATIN = re.compile(r"[A-Za-z0-9_À-ɏ]+(?:'[A-Za-z0-9_À-ɏ]+)*")
_QUOTED = re.compile("[\"“「『《〈【]([^\"”」』》〉】]+)[\"”」』》〉】]")


def casefold(text: str | None) -> str:
    """NFKC and case folding."""
    return unicodedata.normalize("NFKC", text or "").casefold()


def squeeze(text: str | None) -> str:
    """The normal form of a query: NFKC, case folding, white space collapsed."""
    return " ".join(casefold(text).split())


def alias(text: str | None) -> str:
    """The normal form of an alias: as of a query, without any blank if it has Chinese, Japanese or Korean characters."""
    form = squeeze(text)
    return form.replace(" ", "") if _WIDE.search(form) else form


def _grams(run: str, n: int) -> list[str]:
    return [run[i : i + n] for i in range(len(run) - n + 1)]


def units(text: str | None, n: int) -> list[str]:
    """Search units of the whole text: words of n characters or more and n-grams of CJK runs, distinct in order (a lone character is kept for n = 2)."""
    form = casefold(text)
    found = [(m.start(), [m[0]]) for m in _LATIN.finditer(form) if len(m[0]) >= n]
    for m in _RUN.finditer(form):
        found.append((m.start(), _grams(m[0], n) or ([m[0]] if n == 2 else [])))
    return list(dict.fromkeys(u for _, part in sorted(found) for u in part))


def anchors(text: str | None) -> list[str]:
    """Texts inside quotation marks or brackets of three characters or more besides blanks."""
    found = [casefold(x).strip() for x in _QUOTED.findall(text or "")]
    return list(dict.fromkeys(x for x in found if len("".join(x.split())) >= 3))


def terms(text: str | None) -> list[str]:
    """w: words (with apostrophes); c1: c2: c3: grams of CJK runs; repeats included."""
    form = casefold(text)
    out = ["w:" + m[0] for m in _LATIN.finditer(form)]
    for m in _RUN.finditer(form):
        out += [f"c{n}:{g}" for n in (1, 2, 3) for g in _grams(m[0], n)]
    return out


def features(text: str | None) -> list[str]:
    """Cue features, distinct in order: w: words, c: characters and n2: character pairs of CJK runs, n2: neighbouring words."""
    form = casefold(text)
    words = [m[0] for m in _LATIN.finditer(form)]
    out = ["w:" + w for w in words] + [f"n2:{a} {b}" for a, b in zip(words, words[1:])]
    for m in _RUN.finditer(form):
        out += ["c:" + c for c in m[0]] + ["n2:" + g for g in _grams(m[0], 2)]
    return list(dict.fromkeys(out))


def mapped(f, kind):
    @F.pandas_udf(kind)
    def run(s: pd.Series) -> pd.Series:
        return s.map(f)

    return run


def register_text(spark: SparkSession) -> None:
    """Makes the functions known to SQL by name."""
    for name, f, kind in (
        ("nfkc_casefold", casefold, "string"), ("nfkc_casefold_squeeze", squeeze, "string"), ("alias_form", alias, "string"),
        ("trigram_units", lambda t: units(t, 3), "array<string>"), ("bigram_units", lambda t: units(t, 2), "array<string>"),
        ("quoted_anchors", anchors, "array<string>"), ("mixed_terms", terms, "array<string>"), ("cue_features", features, "array<string>"),
    ):
        spark.udf.register(name, mapped(f, kind))
