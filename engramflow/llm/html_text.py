r"""HTML main-text extraction with host suffix arrays.

1. A page is cut into blocks of text by its tags. Parts that say what they are (scripts, styles, menus, headers,
   footers, sidebars, forms, adverts, notices, reader comments: by tag, role, class or id) are left out. If a page has
   ``article`` or ``main``, its text is in there and the rest of the page goes.
2. The token streams of all of a host's pages are concatenated and sorted as suffixes (host first, then token by token
   up to ``RUN`` tokens, multikey quicksort); equal neighbours are classes of repeated token runs. A host is one task's
   work, or, if it is large, split over blocks by its texts. A run that is on some share of a host's pages is on that share
   of the pages of one of its blocks at least, so blocks name what may be frequent, and only that is counted over all of them: exactly.
3. Tokens covered by a run that is on at least ``MIN_PAGES`` distinct pages and ``MIN_SHARE`` of the host's distinct
   pages are boilerplate and go; the unique runs stay. Inside ``article`` or ``main``, where an author may well repeat a phrase,
   a block goes as a whole only, and only by runs on ``OWN_SHARE`` of the pages. Pages with equal streams count once, so copies
   of one text are not boilerplate; pages without text don't count.

Text: character references are decoded, white space inside a block is one space, blocks are
trimmed and joined in page order by two line breaks; ``<br>`` and table cells part words, not blocks.

Edge cases: null html or a page without text gives the empty text; null ids, urls and repeated rows are kept, one
result for each row; urls without a host share the host ''; unclosed or stray tags are read as browsers
mostly do; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, shuffle_parts, table
from .exchange import mixed
from .suffix_dedup import multikey_quicksort

RUN, MIN_PAGES, MIN_SHARE, OWN_SHARE = 6, 3, 0.3, 0.9
BLOCK_BYTES = 4 << 20
BASE = 0x9E3779B97F4A7C15

#: Elements by what they mean for the text.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript template svg iframe object select button math canvas audio video xmp noframes".split())
DROP = set("nav footer aside form menu dialog head fieldset".split())
BLOCKS = set("p div h1 h2 h3 h4 h5 h6 li ul ol dl dt dd tr table thead tbody tfoot caption blockquote pre section article main header footer nav aside figure figcaption hr address details summary form body html center fieldset menu dialog".split())
CLOSES_P = BLOCKS - {"tr", "thead", "tbody", "tfoot", "caption", "body", "html"}
MAIN = {"article", "main"}
#: Words of classes and ids that name parts other than the text.
NAMES = set(
    "nav navbar navigation menu submenu breadcrumb breadcrumbs header masthead banner topbar footer bottombar sidebar side aside widget widgets rail ad ads adv advert adverts advertisement advertisements advertising adsense sponsor sponsored sponsors promo promotion promoted"
    " cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login signin register share sharing social related recommended recommendations comment comments commentlist disqus reply replies respond form search searchbox pagination pager copyright legal disclaimer skip toolbar".split()
)
ROLES = set("navigation banner contentinfo complementary search form alert dialog menu menubar toolbar".split())

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>?", re.S)
_ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden|style)\b\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HOST = r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/@?#]*@)?([^/:?#]*)"


def _left_out(tag: str, attributes: str, in_main: bool) -> bool:
    if tag in DROP or (tag == "header" and not in_main):
        return True
    if not attributes or tag in ("body", "html"):
        return False
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), next((v for v in values if v), "")
        if name in ("class", "id"):
            if any(w.lower() in NAMES for w in _NAME.findall(value)) and tag not in MAIN | {"h1", "h2", "h3", "h4", "h5", "h6"}:
                return True
            if tag == "article" and re.search(r"(?i)\b(comment|reply|ad|advert|promo|related|teaser)", value):
                return True
        elif name == "role" and value.lower() in ROLES:
            return True
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            return True
        elif name == "style" and re.search(r"(?i)display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
    return False


def blocks_of(page: str | None) -> tuple[list[str], bool]:
    """(blocks of text that are not left out, whether they come from article or main)"""
    page = page or ""
    found: list[tuple[str, bool]] = []
    words: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # tag, whether it leaves out, whether it is main
    out = main = 0
    at, size, lower = 0, len(page), None

    def close_block():
        if words:
            text = " ".join(html.unescape("".join(words)).split())
            if text:
                found.append((text, main > 0))
            words.clear()

    def pop():
        nonlocal out, main
        _, was_out, was_main = stack.pop()
        out -= was_out
        main -= was_main

    while at < size:
        m = _TAG.search(page, at)
        if not out and (m is None or m.start() > at):
            words.append(page[at : m.start() if m else size])
        if m is None:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag in BLOCKS:
                close_block()
            if any(t == tag for t, _, _ in stack):
                while stack[-1][0] != tag:
                    pop()
                pop()
            continue
        if tag in RAW:
            if not m[3].rstrip().endswith("/"):
                lower = page.lower() if lower is None else lower
                end = lower.find(f"</{tag}", at) if len(lower) == size else page.find(f"</{tag}", at)
                at = size if end < 0 else (page.find(">", end) + 1 or size)
            if not out:
                words.append(" ")
            continue
        if tag in BLOCKS:
            close_block()
        if tag in CLOSES_P and any(t == "p" for t, _, _ in stack):
            while stack[-1][0] != "p":
                if stack[-1][0] in BLOCKS - {"p"}:
                    break
                pop()
            if stack[-1][0] == "p":
                pop()
        if tag == "li" and stack and stack[-1][0] == "li":
            pop()
        if tag in ("br", "td", "th", "img"):
            if not out:
                words.append(" ")
        if tag in VOID or (m[3].endswith("/") and tag not in BLOCKS):
            continue
        is_out = _left_out(tag, m[3], main > 0)
        is_main = tag in MAIN or (tag not in MAIN and 'role="main"' in m[3])
        stack.append((tag, is_out, is_main))
        out += is_out
        main += is_main
    if not out:
        close_block()
    own = [t for t, inside in found if inside]
    return (own, True) if own else ([t for t, _ in found], False)


PARSED = "page_id long, url string, host string, own boolean, blocks array<string>"


def parse(pages: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            rows = [blocks_of(h.as_py()) for h in b.column(3)]
            blocks, own = zip(*rows) if rows else ((), ())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(own, pa.bool_()), pa.array(blocks, pa.list_(pa.string()))], ["page_id", "url", "host", "own", "blocks"])

    return pages.select("page_id", "url", "host", "html").mapInArrow(run, PARSED)


class Streams:
    """The token streams of a block's pages, one after another, and their runs' classes."""

    def __init__(self, rows: pa.Table, run: int):
        self.run = run
        blocks, hosts = rows.column("blocks").to_pylist(), rows.column("host").to_pylist()
        self.pages = [i for i, parts in enumerate(blocks) if parts]
        tokens, sizes, host_number = [], [], {}
        ids: dict[str, int] = {}
        for i in self.pages:
            part = [w for b in blocks[i] for w in b.split()]
            tokens += [ids.setdefault(w, len(ids)) for w in part]
            sizes.append(len(part))
        names = list(ids)
        self.token = np.array(tokens, np.int64)
        self.word_hash = np.array([_hash(w) for w in names], np.uint64)
        self.sizes = np.array(sizes, np.int64)
        self.host = np.array([host_number.setdefault(hosts[i], len(host_number)) for i in self.pages], np.int64)
        self.names = list(host_number)
        self.host_hash = np.array([_hash(h) for h in host_number], np.uint64)
        # pages of a host with equal streams are one page
        begin = np.cumsum(self.sizes) - self.sizes
        same: dict[tuple, int] = {}
        self.text = np.array([same.setdefault((h, self.token[b : b + n].tobytes()), len(same)) for h, b, n in zip(self.host.tolist(), begin.tolist(), self.sizes.tolist())], np.int64)
        page = np.repeat(np.arange(len(self.pages)), self.sizes)
        self.at = np.flatnonzero(np.arange(len(self.token)) + run <= np.repeat(begin + self.sizes, self.sizes)) if len(self.token) else np.zeros(0, np.int64)
        self.page = page[self.at] if len(self.at) else self.at

    def classes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(suffixes' class numbers, the classes' keys, their numbers of distinct pages): the suffix array of all
        streams, host by host, cut where neighbours differ within the run."""
        self.owner = self.at  # hosts' numbers of the classes
        if not len(self.at):
            return self.at, np.zeros(0, np.uint64), self.at
        host = self.host[self.page]
        columns = np.column_stack([host, *[self.token[self.at + k] for k in range(self.run)]]).astype(np.uint64)
        order = multikey_quicksort(columns)
        s = columns[order]
        new = np.concatenate([[True], (s[1:] != s[:-1]).any(1)])
        number = np.empty(len(order), np.int64)
        number[order] = np.cumsum(new) - 1
        first = order[new]
        self.owner = host[first]
        key = self.host_hash[self.owner]
        for k in range(self.run):
            key = mixed(key * np.uint64(BASE) + self.word_hash[self.token[self.at[first] + k]])
        pairs = np.unique(np.column_stack([number, self.text[self.page]]), axis=0)
        return number, key, np.bincount(pairs[:, 0], minlength=len(key))

    def hosts(self) -> np.ndarray:
        """Hosts' numbers of distinct pages."""
        pairs = np.unique(np.column_stack([self.host, self.text]), axis=0) if len(self.pages) else np.zeros((0, 2), np.int64)
        return np.bincount(pairs[:, 0], minlength=len(self.names))


def _hash(word: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(word.encode("utf-8", "replace"), 7)


NAMED = "host string, key long"
COUNTED = NAMED + ", n long, pages long"
CLEANED = "page_id long, url string, text string, n_chars long, n_boilerplate long"


class Plan:
    """What the tasks of a block do: name runs, count named ones, take out what is frequent."""

    def __init__(self, run: int, min_pages: int, min_share: float):
        self.run, self.min_pages, self.min_share = run, min_pages, min_share

    def name(self, rows: pa.Table) -> pa.Table:
        """Runs that may be frequent: on the share of this block's pages of their host, of one that is not split on min_pages too."""
        streams = Streams(rows, self.run)
        _, key, pages = streams.classes()
        parts = dict(zip(rows.column("host").to_pylist(), rows.column("parts").to_pylist()))
        least = np.array([self.min_pages if parts[h] == 1 else 1 for h in streams.names], np.int64)
        use = pages >= np.maximum(least, self.min_share * streams.hosts() - 1e-9)[streams.owner]
        return pa.table({"host": pa.array([streams.names[h] for h in streams.owner[use].tolist()], pa.string()), "key": pa.array(key[use].view(np.int64))})

    def count(self, rows: pa.Table, named: pa.Table) -> pa.Table:
        """Distinct pages of this block that have a named run, and those of its host."""
        hosts, asked = named.column("host").to_pylist(), named.column("key").to_pylist()
        n, pages = dict.fromkeys(asked, 0), {}
        if asked and rows.num_rows:
            streams = Streams(rows, self.run)
            _, key, have = streams.classes()
            pages = dict(zip(streams.names, streams.hosts().tolist()))
            key = key.view(np.int64)
            use = np.isin(key, np.array(asked, np.int64))
            n |= zip(key[use].tolist(), have[use].tolist())
        return pa.table({"host": pa.array(hosts, pa.string()), "key": pa.array(asked, pa.int64()), "n": pa.array([n[k] for k in asked], pa.int64()), "pages": pa.array([pages.get(h, 0) for h in hosts], pa.int64())})

    def _gone(self, streams: Streams, number: np.ndarray, found: np.ndarray) -> np.ndarray:
        """Whether tokens are covered by runs of the found classes."""
        edge = np.zeros(len(streams.token) + self.run + 1, np.int64)
        start = streams.at[found[number]] if len(number) else streams.at
        np.add.at(edge, start, 1)
        np.add.at(edge, start + self.run, -1)
        return np.cumsum(edge) > 0

    def finish(self, rows: pa.Table, frequent: pa.Table) -> pa.Table:
        blocks, own, removed = rows.column("blocks").to_pylist(), rows.column("own").to_pylist(), [0] * rows.num_rows
        if frequent.num_rows and rows.num_rows:
            streams = Streams(rows, self.run)
            number, key, _ = streams.classes()
            keys, always = frequent.column("key").to_numpy(), frequent.column("always").to_numpy(zero_copy_only=False)
            here = [self._gone(streams, number, np.isin(key.view(np.int64), k)) for k in (keys, keys[always])]
            for i, at in zip(streams.pages, (np.cumsum(streams.sizes) - streams.sizes).tolist()):
                kept, gone = [], here[own[i]]
                for b in blocks[i]:
                    words = b.split()
                    out = gone[at : at + len(words)]
                    left = [w for w, g in zip(words, out.tolist()) if not g] if not own[i] or out.all() else words
                    at, removed[i] = at + len(words), removed[i] + len(words) - len(left)
                    if left:
                        kept.append(" ".join(left))
                blocks[i] = kept
        texts = ["\n\n".join(parts) for parts in blocks]
        return pa.table({"page_id": rows.column("page_id"), "url": rows.column("url"), "text": pa.array(texts, pa.string()), "n_chars": pa.array(map(len, texts), pa.int64()), "n_boilerplate": pa.array(removed, pa.int64())})


def extract(pages: DataFrame, run: int = RUN, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, own_share: float = OWN_SHARE) -> DataFrame:
    """page_id, url, text, n_chars and n_boilerplate (tokens removed as the host's) of every row."""
    own = pick(pages, "page_id", "url", "html").select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    own = own.withColumn("host", F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), _HOST, 1)))
    sizes = own.groupBy("host").agg(F.sum(F.octet_length("html")).alias("size"))
    n_bytes = sizes.agg(F.sum("size")).first()[0] or 0
    count = max(1, math.ceil(n_bytes / BLOCK_BYTES))
    large = F.broadcast(sizes.where(F.col("size") > BLOCK_BYTES).select("host", F.ceil(F.col("size") / BLOCK_BYTES).cast("int").alias("parts")))  # at most count rows
    in_parts = lambda df: df.join(large, "host", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    block = lambda part: F.pmod(F.xxhash64("host", part), F.lit(count)).cast("int")
    # equal streams of a host meet in one block; pages without text are dealt by page
    part = F.pmod(F.xxhash64("host", F.array_join("blocks", " ")), F.col("parts")).cast("int")
    place = F.when(F.size("blocks") > 0, block(part)).otherwise(F.pmod(F.xxhash64("page_id", "url"), F.lit(count)).cast("int"))
    shuffled = max(shuffle_parts(pages.sparkSession), min(count, 4 * shuffle_parts(pages.sparkSession)))
    dealt = in_parts(parse(own)).withColumn("block", place).repartition(shuffled, "block")
    to_blocks = lambda df: in_parts(df).withColumn("block", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), block))))
    plan = Plan(run, min_pages, min_share)
    named = to_blocks(dealt.groupBy("block").applyInArrow(lambda rows: plan.name(rows), NAMED).distinct()).select("block", "host", "key")
    counted = dealt.groupBy("block").cogroup(named.groupBy("block")).applyInArrow(lambda rows, asked: plan.count(rows, asked), COUNTED)
    total = counted.groupBy("host", "key").agg(F.sum("n").alias("n"), F.sum("pages").alias("pages"))
    least = lambda share: F.greatest(F.lit(min_pages), F.ceil(F.col("pages") * share))
    frequent = to_blocks(total.where(F.col("n") >= least(min_share)).withColumn("always", F.col("n") >= least(own_share))).select("block", "key", "always")
    return dealt.groupBy("block").cogroup(frequent.groupBy("block")).applyInArrow(lambda rows, found: plan.finish(rows, found), CLEANED)


def query(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
