r"""Periodic runs of words by the method of Kolpakov and Kucherov.

A run is a stretch of consecutive words with smallest period q (words q apart are equal) and at least ``max(LEAST, TIMES * q)``
words that no neighbouring word extends keeping period q. Words are ``[^\x20\x09-\x0D]+``.

1. A word inside a run of TIMES periods occurs TIMES times in it, so rarer words cut a text into pieces that no run leaves (``pieces``; done
   again inside each piece until nothing changes). Ordinary prose has no piece of LEAST words left; the rest is for what repeats.
2. ``factorise``: a suffix automaton of the piece gives its LZ factors: the longest prefix of what is left that occurs earlier (overlaps
   allowed), with the place of the earlier occurrence.
3. ``crossing``: a run that ends in factor u and touches its start has fewer than period + |previous factor| words before u, or the previous
   factor would have gone on. So longest common extensions to both sides of the boundary, within that reach, give every such run (Main).
4. A run strictly inside a factor is also strictly inside the earlier occurrence: such runs are copied from there.

Everything is linear in the piece (the automaton's transitions are hashed). Each document is worked out by itself in the task that reads it;
nothing is shuffled.

``periodic`` makes the text that the query op13 looks at: some documents' words are repeated with a period, by their id.

Edge cases: null text has no words; a null id leaves the text as it is; no run gives four nulls; repeated rows give a result each; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from array import array
from bisect import bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, table, trim

LEAST, TIMES = 6, 4
WORD = re.compile("[^ \t-\r]+")
RESULT = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
ARROW = pa.schema([("doc_id", pa.int64()), *[(n, pa.int64()) for n in ("n_runs", "start", "length", "period", "exponent_milli")], ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())])


def pieces(ids: np.ndarray) -> list[tuple[int, int]]:
    """Stretches (start, end) of words that each occur TIMES times or more in their stretch, of LEAST words or more; every run lies in one, with
    its neighbouring words if these could extend it."""
    found, todo = [], [(0, len(ids))]
    while todo:
        a, b = todo.pop()
        if b - a < LEAST:
            continue
        _, back, counts = np.unique(ids[a:b], return_inverse=True, return_counts=True)
        often = counts[back] >= TIMES
        if often.all():
            found.append((a, b))
            continue
        edges = np.flatnonzero(np.diff(often, prepend=False, append=False)) + a
        todo += [(int(x), int(y)) for x, y in zip(edges[::2], edges[1::2]) if y - x >= LEAST]
    return sorted(found)


def factorise(w: list[int]) -> list[tuple[int, int, int]]:
    """LZ factors (start, length, start of an earlier occurrence or -1 for a new word).

    States of the suffix automaton keep their first transition in two arrays and, only if they have more, a dictionary: most have one."""
    size, link, first = array("q", [0]), array("q", [-1]), array("q", [-1])  # longest length, suffix link, least end of an occurrence
    sym, to, more = array("q", [-1]), array("q", [-1]), {}
    last = 0
    for i, c in enumerate(w):
        new = len(size)
        size.append(i + 1), link.append(0), first.append(i), sym.append(-1), to.append(-1)
        p = last
        while p >= 0:
            if sym[p] == c:
                break
            if sym[p] < 0:
                sym[p], to[p] = c, new
            else:
                others = more.get(p)
                if others is None:
                    more[p] = {c: new}
                elif c in others:
                    break
                else:
                    others[c] = new
            p = link[p]
        if p >= 0:
            q = to[p] if sym[p] == c else more[p][c]
            if size[p] + 1 == size[q]:
                link[new] = q
            else:
                copy = len(size)
                size.append(size[p] + 1), link.append(link[q]), first.append(first[q]), sym.append(sym[q]), to.append(to[q])
                if q in more:
                    more[copy] = dict(more[q])
                while p >= 0:
                    if sym[p] == c and to[p] == q:
                        to[p] = copy
                    elif p in more and more[p].get(c) == q:
                        more[p][c] = copy
                    else:
                        break
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    factors, i, n = [], 0, len(w)
    while i < n:
        state, k, source = 0, 0, -1
        while i + k < n:
            c = w[i + k]
            then = to[state] if sym[state] == c else more[state].get(c, -1) if state in more else -1
            if then < 0 or first[then] >= i + k:
                break
            state, k = then, k + 1
            source = first[state]
        factors.append((i, max(k, 1), source - k + 1 if k else -1))
        i += max(k, 1)
    return factors


def _z(w: list[int]) -> list[int]:
    """Length of the longest common prefix of w and each of its suffixes."""
    n = len(w)
    z, left, right = [0] * n, 0, 0
    if n:
        z[0] = n
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and w[k] == w[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def crossing(w: list[int], b: int, before: int, after: int):
    """Candidates (start, end, period), ends exclusive, that touch the boundary b and lie between b - reach and b + after, where before and after are the
    lengths of the factors beside b. They may be cut off at the edges of that range, so they are to be checked; smaller periods come first.
    TIMES * period <= length < after + (before + period) bounds the period."""
    most = (before + after) // (TIMES - 1)
    if not most or before + after + most < LEAST:
        return
    reach = min(b, before + most)
    left, right = w[b - reach : b], w[b : b + after]
    mirrored = left[::-1]
    zl = _z(mirrored)  # extensions to the left of b - p
    zr = _z(right)  # to the right of b + p
    across = _z([*right, -1, *left, *right])  # right against what begins in left
    behind = _z([*mirrored, -1, *right[:most][::-1], *mirrored])  # left against what ends in right, backwards
    ahead = min(most, after)
    for p in range(1, most + 1):
        if p <= after:
            lcp = zr[p] if p < after else 0
            lcs = behind[reach + 1 + ahead - p]
            if lcp + lcs + p >= TIMES * p and lcp + lcs + p >= LEAST:
                yield b - lcs, b + p + lcp, p
        if p <= reach:
            lcp = across[after + 1 + reach - p]
            lcs = zl[p] if p < reach else 0
            if lcp + lcs + p >= TIMES * p and lcp + lcs + p >= LEAST:
                yield b - p - lcs, b + lcp, p


def runs_of_piece(w: list[int]) -> list[tuple[int, int, int]]:
    """All runs (start, end, period) of a piece, ends exclusive, by start and period."""
    n = len(w)
    found: list[tuple[int, int, int]] = []
    known: set[tuple[int, int]] = set()

    def add(s: int, e: int, p: int) -> None:
        if (s, e) not in known and (s == 0 or w[s - 1] != w[s - 1 + p]) and (e == n or w[e] != w[e - p]):
            known.add((s, e))
            insort(found, (s, e, p))

    before = 0
    for b, length, source in [*factorise(w), (n, 0, -1)]:
        for s, e, p in crossing(w, b, before, length):
            add(s, e, p)
        if source >= 0 and length > LEAST + 1:
            limit, shift = source + length, b - source
            k = bisect_right(found, (source, n + 1, 0))
            while k < len(found) and found[k][0] < limit:  # what is copied may itself be copied again, further on
                s, e, p = found[k]
                if e < limit:
                    add(s + shift, e + shift, p)
                k += 1
        before = length
    return sorted((s, e, p) for s, e, p in found)


def runs_of(words: list[str]) -> list[tuple[int, int, int]]:
    """All runs (start, end, period) of the words, ends exclusive, by start and period."""
    number: dict[str, int] = {}
    ids = np.fromiter((number.setdefault(x, len(number)) for x in words), np.int64, len(words))
    found = []
    for a, b in pieces(ids):
        found += [(a + s, a + e, p) for s, e, p in runs_of_piece(ids[a:b].tolist())]
    return sorted(found, key=lambda r: (r[0], r[2]))


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run (start, length, period) with the greatest length for its period, compared exactly; then the smallest start, then period."""
    best = None
    for s, e, p in runs:  # by start and period, so that ties keep the first
        if best is None or (e - s) * best[2] > best[1] * p:
            best = (s, e - s, p)
    return best


def collapse(words: list[str], runs: list[tuple[int, int, int]]) -> list[str]:
    """Of each run the first period only."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for s, e, p in runs:
        change[s + p] += 1
        change[e] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0)]


def periodic(doc_id: int | None, words: list[str]) -> list[str]:
    """Every tenth document by the checksum of its id has its words from a place on repeated with a period."""
    if doc_id is None or not words:
        return words
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    times = -(-(n - a) // p)
    return words[:a] + (words[a : a + p] * times)[: n - a]


def describe(doc_id: int | None, words: list[str]) -> tuple:
    runs = runs_of(words)
    best = strongest(runs)
    listed = "".join(f"{s},{e - s},{p}\n" for s, e, p in runs)
    kept = " ".join(collapse(words, runs))
    top = (None, None, None, None) if best is None else (*best, 1000 * best[1] // best[2])
    return doc_id, len(runs), *top, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest()


def find(docs: DataFrame, change=None) -> DataFrame:
    """docs: doc_id long, text string -> RESULT, one row for each. change(doc_id, words) may replace the words."""

    def run(batches):
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = WORD.findall(text.as_py() or "")
                rows.append(describe(doc_id, change(doc_id, words) if change else words))
            columns = list(zip(*rows)) or [[]] * len(ARROW)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, ARROW)], schema=ARROW)
            trim()

    return pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text").mapInArrow(run, RESULT)


def query(spark, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"), periodic)
