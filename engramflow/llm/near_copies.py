r"""Near copies by the Jaccard similarity of five-word shingles: found by SimHash and min-hash keys, verified exactly.

Shingles: texts are lower-cased in A-Z, words are ``[^\x20\x09-\x0D]+``, shingles are ``WIDTH`` words (fewer words: the
whole sequence); a text is the set of its shingles. Two texts are linked if |A & B| / |A | B| >= 4/5.

1. Documents are dealt into blocks by a digest of their words, so texts of the same words meet and become one node (the smallest id's row).
2. Blocks tell buckets which shingle hashes they hold and hear which of them another node holds (a counter sketch, as in
   substring_dedup: it never takes a shared shingle for a single one). A node of n shingles of which u are its own alone
   shares n - u at most; linked nodes share 4/5 of either, so nodes with 5 (n - u) < 4 n have no link and leave the search, with all texts
   that are nobody's copies. The same counts bound each pair: |A & B| <= m, |A | B| >= n_a + n_b - m, m = min(n_a - u_a, n_b - u_b).
3. The rest is searched by the Golay keys of operator 8 (five-word fingerprints within two bits) and by ``BANDS`` min-hash keys of ``ROWS`` minima each, as
   two bits hold only the closest copies: at a similarity of 0.8 some ten of 64 bits differ. Linked texts miss each other in all bands with
   probability (1 - 0.8^6)^64 < 4e-9.
4. Candidates are verified shingle by shingle in rounds, between which links become components: first every member of a key with the key's
   centre (its node with the fewest shingles of its own), then members with the centres of the key's other components, then all pairs of a key that are
   still in different components and within two exact bounds, that of step 2 and one on the parities of hashed shingles (``parities``), which needs no text. So
   a group of many copies of one text costs a pair a member.

Scale: keys with one member go first. The last round deals a key of more than ``BLOCK`` members in pairs of blocks, so no
task holds more than about twice as many. A centre of many pairs is sent to ``SALTS`` places. Left quadratic: the comparison of parities of a key's
members in different components, a few machine words a pair.

Edge cases: null text counts as empty; null ids come after all others; repeated rows are copies; empty tables stay empty; other columns are
kept and never read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import cut, pick, release, shuffle_parts, trim
from .components import components
from .exchange import PIECE_BYTES, _answers, _messages, answer, bucketed, join_parts, mixed, pack, pack_sorted, rolled, split_parts, unpack, wider
from .exchange import Block as Texts
from .substring_dedup import Plan as Sketch
from .substring_dedup import word_hashes, words_of

WIDTH, ROWS, BANDS, BLOCK = 5, 6, 64, 1024
#: Text of a block of nodes, about; counters of the sketch a shingle.
BLOCK_BYTES, SPREAD = 2 << 20, 64
#: Pairs of a node from which on its text is sent to several places, and how many.
MANY, SALTS = 128, 64
_draw = np.random.default_rng(20)
_TIMES = _draw.integers(0, 1 << 32, (ROWS * BANDS, 1), np.uint32) | np.uint32(1)
_PLUS = _draw.integers(0, 1 << 32, (ROWS * BANDS, 1), np.uint32)
_MIX = _draw.integers(0, 1 << 63, (BANDS, ROWS), np.uint64) * np.uint64(2) + np.uint64(1)
_BAND = _draw.integers(0, 1 << 63, BANDS, np.uint64)


def shingles(text: bytes | None) -> set[bytes]:
    words = (text or b"").lower().split()
    return set(map(b" ".join, zip(*[words[i:] for i in range(WIDTH)]))) if len(words) > WIDTH else {b" ".join(words)}


def linked(a: set[bytes], b: set[bytes]) -> bool:
    if 5 * min(len(a), len(b)) < 4 * max(len(a), len(b)):
        return False
    both = len(a & b)
    return 5 * both >= 4 * (len(a) + len(b) - both)


def keys_of(found: set[bytes]) -> np.ndarray:
    """The keys of a set of shingles, one a band."""
    digest = xxhash.xxh3_64_intdigest
    hashes = np.fromiter(map(digest, found), np.uint64, len(found)).astype(np.uint32)
    least = np.full(ROWS * BANDS, 0xFFFFFFFF, np.uint32)
    for low in range(0, len(hashes), 256):
        x = hashes[None, low : low + 256] * _TIMES
        x += _PLUS
        np.minimum(least, x.min(1), out=least)
    keys = (least.reshape(BANDS, ROWS).astype(np.uint64) * _MIX).sum(1, dtype=np.uint64) + _BAND
    return keys.view(np.int64)


class Nodes:
    """The distinct sequences of words of a block, ordered by digest: text, and id (or null) and hash of the first row of each."""

    def __init__(self, rows: pa.Table):
        best: dict[bytes, tuple] = {}
        for piece in rows.column("piece").to_pylist():
            digests, ids, none, hashes, sizes, data = split_parts(piece)
            ids, none, hashes, sizes = unpack(ids, np.int64), unpack(none, np.uint8), unpack(hashes, np.int64), unpack(sizes, np.int64)
            data, at = zstandard.ZstdDecompressor().decompress(data), 0
            for k, n in enumerate(sizes.tolist()):
                row = (bool(none[k]), int(ids[k]), int(hashes[k]))
                key = digests[16 * k : 16 * k + 16]
                if key not in best or row < best[key][0]:
                    best[key] = (row, data[at : at + n])
                at += n
        keys = sorted(best)
        self.rows, self.texts = [best[k][0] for k in keys], [best[k][1] for k in keys]

    def shingles(self) -> tuple[np.ndarray, np.ndarray]:
        """(node, hash) of every distinct shingle hash of every node of more than WIDTH words; others can only be linked to their equals."""
        block = Texts(np.arange(len(self.texts)), [t.lower() for t in self.texts])
        starts, ends, before, buf = words_of(block)
        words, n = word_hashes(starts, ends, buf), np.diff(before)
        at = np.flatnonzero((np.arange(len(words)) + WIDTH <= np.repeat(before[1:], n)) & np.repeat(n > WIDTH, n)) if len(words) else np.zeros(0, np.int64)
        if not len(at):
            return at, np.zeros(0, np.uint64)
        node = block.ids[np.repeat(np.arange(len(n)), n)[at]]
        hashes = mixed(rolled(words, WIDTH, 0xD6E8FEB86659FD93)[at])
        order = np.lexsort((hashes, node))
        node, hashes = node[order], hashes[order]
        new = np.concatenate([[True], (node[1:] != node[:-1]) | (hashes[1:] != hashes[:-1])])
        return node[new], hashes[new]


def _packed(blocks: int):
    """A task's rows by block; rows of the same words are one from here on (the first of them)."""

    def run(batches):
        trim()
        held: dict[int, dict[bytes, tuple]] = {}
        size = 0

        def flush():
            names, pieces = [], []
            for block, rows in held.items():
                first = [r for r, _ in rows.values()]
                names.append(block)
                pieces.append(join_parts([
                    b"".join(rows), pack(np.array([i for _, i, _ in first], np.int64)), pack(np.array([n for n, _, _ in first], np.uint8)), pack(np.array([h for _, _, h in first], np.int64)),
                    pack(np.array([len(t) for _, t in rows.values()], np.int64)), zstandard.ZstdCompressor(level=1).compress(b"".join(t for _, t in rows.values())),
                ]))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(pieces, pa.binary())], ["block", "piece"])

        for b in batches:
            for i, h, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                t = t or b""
                key = xxhash.xxh3_128_digest(b" ".join(t.lower().split()))
                rows = held.setdefault(int.from_bytes(key[:8], "little") % blocks, {})
                row, old = (i is None, i or 0, h), rows.get(key)
                if old is None:
                    size += len(t)
                if old is None or row < old[0]:
                    rows[key] = (row, t)
                if size >= PIECE_BYTES:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    return run


_NODE = "node long, doc_id long, h long, n int, u int, text binary"


def _nodes(docs: DataFrame) -> DataFrame:
    """node, doc_id, h (a hash of the text) of the first row of each sequence of words; n, u and text only of nodes that may have a link."""
    d = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), F.col("text").cast("binary").alias("text"))
    n_bytes = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(n_bytes / BLOCK_BYTES / wider(n_bytes)))
    parts = shuffle_parts(docs.sparkSession)
    dealt = d.mapInArrow(_packed(blocks), "block int, piece binary").repartition(max(parts, min(blocks, 4 * parts)), "block")
    plan = Sketch(n_bytes, WIDTH, SPREAD)

    def counted(hashes: np.ndarray):
        """(counters, of how many nodes, each hash's counter)"""
        return np.unique(plan.counters((hashes, hashes))[0], return_inverse=True, return_counts=True)

    def send(rows: pa.Table) -> pa.Table:
        trim()
        keys, _, n = counted(Nodes(rows).shingles()[1])
        sent = [(0, b, join_parts([pack_sorted(keys[i:j] >> plan.shift), pack(np.packbits(n[i:j] > 1))])) for b, i, j in bucketed(keys, plan.buckets)]
        return _messages(rows.column("block")[0].as_py(), sent)

    def finish(rows: pa.Table, found: pa.Table) -> pa.Table:
        trim()
        nodes, answers = Nodes(rows), _answers(found)
        node, hashes = nodes.shingles()
        keys, which, _ = counted(hashes)
        shared = np.zeros(len(keys), bool)
        for b, i, j in bucketed(keys, plan.buckets):
            shared[i:j] = np.unpackbits(unpack(answers[0, b], np.uint8), count=j - i)
        n = np.bincount(node, minlength=len(nodes.rows))
        u = n - np.bincount(node, weights=shared[which], minlength=len(nodes.rows)).astype(np.int64)
        may = (n > 0) & (5 * (n - u) >= 4 * n)
        block = rows.column("block")[0].as_py() if rows.num_rows else 0
        return pa.table({
            "node": pa.array((block << 32) + np.arange(len(n), dtype=np.int64)), "doc_id": pa.array([None if r[0] else r[1] for r in nodes.rows], pa.int64()), "h": pa.array([r[2] for r in nodes.rows], pa.int64()),
            "n": pa.array(n, pa.int32()), "u": pa.array(u, pa.int32()), "text": pa.array([t if m else None for t, m in zip(nodes.texts, may.tolist())], pa.binary()),
        })

    answers = answer(dealt.groupBy("block").applyInArrow(send, "bucket int, block int, kind int, payload binary"), plan.reply)
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(finish, _NODE)


def _members(nodes: DataFrame) -> DataFrame:
    """key, node, n, u of the band keys that more than one node has."""

    def run(batches):
        trim()
        for b in batches:
            keys = np.concatenate([np.zeros(0, np.int64), *[keys_of(shingles(t.as_py())) for t in b.column(3)]])
            yield pa.RecordBatch.from_arrays([pa.array(keys), *[pa.array(np.repeat(b.column(k).to_numpy(zero_copy_only=False), BANDS)) for k in range(3)]], ["key", "node", "n", "u"])

    keys = nodes.select("node", "n", "u", "text").mapInArrow(run, "key long, node long, n int, u int").repartition("key")
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    return keys.join(shared.select("key"), "key")


def _within(na, ua, nb, ub):
    """Whether two nodes' counts of shingles, and of those that are theirs alone, allow a similarity of 4/5."""
    m = F.least(na - ua, nb - ub)
    return 5 * m >= 4 * (na + nb - m)


def _centre(*also: str):
    return F.min(F.struct("u", "node", "n", *also)).alias("c")


def _with_centres(members: DataFrame) -> DataFrame:
    """u, v: every member of a key with the key's centre, unless they are of one component."""
    pairs = members.join(members.groupBy("key").agg(_centre("component")), "key").where((F.col("component") != F.col("c.component")) & _within(F.col("n"), F.col("u"), F.col("c.n"), F.col("c.u")))
    return pairs.select(F.col("c.node").alias("u"), F.col("node").alias("v")).distinct()


def _open(members: DataFrame, reached: DataFrame) -> DataFrame:
    """members with their component, of the keys that still have several."""
    now = members.join(reached, "node", "left").withColumn("component", F.coalesce("component", "node"))
    several = now.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("size")).where("low < high").select("key", "size")
    return now.join(several, "key")


def _with_other_centres(open_: DataFrame) -> DataFrame:
    """u, v: members of the smaller components of a key with the centre of its largest, and its centre with theirs."""
    parts = open_.groupBy("key", "component").agg(F.count(F.lit(1)).alias("k"), _centre())
    largest = parts.groupBy("key").agg(F.max_by(F.struct("component", "c"), F.struct("k", -F.col("component"))).alias("top"))
    pairs = open_.join(largest, "key").where(F.col("component") != F.col("top.component")).select("node", "n", "u", F.col("top.c").alias("c"))
    pairs = pairs.where(_within(F.col("n"), F.col("u"), F.col("c.n"), F.col("c.u")))
    return pairs.select(F.col("c.node").alias("u"), F.col("node").alias("v")).distinct()


def parities(found: set[bytes]) -> bytes:
    """A bit for each of some 4 n places: whether an odd number of the shingles fall on it. Two sets' bits differ in no more places than they have shingles
    that only one of them holds; half the places with the other half laid over it (xor) are those of half the width."""
    width = 1 << max(8, (4 * len(found) - 1).bit_length())
    at = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found)) & np.uint64(width - 1)
    return np.packbits(np.bincount(at.astype(np.int64), minlength=width) & 1, bitorder="little").tobytes()


def _folded(bits: bytes, words: int) -> np.ndarray:
    x = np.frombuffer(bits, np.uint64)
    while len(x) > words:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


class _Bits:
    """Parities of some members, at any width that they have."""

    def __init__(self, bits: list[bytes]):
        self.bits, self.words = bits, np.array([len(b) // 8 for b in bits])
        self.at: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def apart(self, bits: bytes, which: np.ndarray) -> np.ndarray:
        """In how many places those members' bits differ from bits, at the narrowest width of them."""
        words = min(len(bits) // 8, int(self.words[which].min()))
        if words not in self.at:
            wide = np.flatnonzero(self.words >= words)
            place = np.zeros(len(self.bits), np.int64)
            place[wide] = np.arange(len(wide))
            self.at[words] = place, np.stack([_folded(self.bits[i], words) for i in wide])
        place, rows = self.at[words]
        return np.bitwise_count(rows[place[which]] ^ _folded(bits, words)).sum(axis=1, dtype=np.int64)


def _all_pairs(open_: DataFrame, texts: DataFrame) -> DataFrame:
    """u, v: the pairs of members of a key in different components that are within the bounds of both counts and parities: a similarity of 4/5 leaves
    (n_a + n_b) / 9 shingles at most that only one of the two holds."""

    def marked(batches):
        trim()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([parities(shingles(t.as_py())) for t in b.column(1)], pa.binary())], ["node", "bits"])

    def run(batches):
        trim()
        for b in batches:
            found: set[tuple[int, int]] = set()
            for i, j, group in zip(*[b.column(c).to_pylist() for c in range(3)]):
                group.sort(key=lambda m: m["node"])
                sides = [[m for m in group if m["own"] == side] for side in (i, j)]
                x, y = ({k: np.array([m[k] for m in side], np.int64) for k in ("node", "component", "n", "u")} for side in sides)
                if not len(x["node"]) or not len(y["node"]):
                    continue
                bits = _Bits([m["bits"] for m in sides[1]])
                for k in range(len(x["node"])):
                    most = np.minimum(x["n"][k] - x["u"][k], y["n"] - y["u"])
                    ok = (5 * most >= 4 * (x["n"][k] + y["n"] - most)) & (y["component"] != x["component"][k])
                    own = int(x["node"][k])
                    may = np.flatnonzero(ok & (y["node"] != own))
                    if len(may):
                        may = may[9 * bits.apart(sides[0][k]["bits"], may) <= x["n"][k] + y["n"][may]]
                        found.update((min(own, v), max(own, v)) for v in y["node"][may].tolist())
            u, v = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    bits = texts.join(open_.select("node").distinct(), "node", "left_semi").select("node", "text").mapInArrow(marked, "node long, bits binary")
    open_ = open_.join(bits, "node")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    dealt = open_.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks").cast("long")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.groupBy("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).agg(F.collect_list(F.struct("node", "component", "own", "n", "u", "bits")).alias("group"))
    return dealt.select("i", "j", "group").mapInArrow(run, "u long, v long").distinct()


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """pairs (u, v) with ok: whether their texts are linked. A u of many pairs is sent to SALTS places, which share its pairs."""

    def run(batches):
        trim()
        for b in batches:
            last, ok = (None, set()), []
            for u, a, c in zip(b.column(0).to_pylist(), b.column(2), b.column(3)):
                last = last if last[0] == u else (u, shingles(a.as_py()))
                ok.append(linked(last[1], shingles(c.as_py())))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ok, pa.bool_())], ["u", "v", "ok"])

    pairs = cut(pairs)
    many = pairs.groupBy("u").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= MANY).select("u", F.lit(SALTS).alias("salts"))
    left = texts.select(F.col("node").alias("u"), F.col("text").alias("a")).join(many, "u", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
    right = pairs.join(texts.select(F.col("node").alias("v"), F.col("text").alias("b")), "v").join(many, "u", "left")
    right = right.withColumn("salt", F.pmod(F.xxhash64("v"), F.coalesce("salts", F.lit(1)).cast("long")).cast("int"))
    return right.join(left, ["u", "salt"]).select("u", "v", "a", "b").mapInArrow(run, "u long, v long, ok boolean")


def _by_fingerprint(texts: DataFrame) -> DataFrame:
    """u, v: nodes whose five-word fingerprints are within two bits, as operator 8 finds them: equal ones by their first node, others by a forest."""

    def run(batches):
        trim()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.fromiter((simhash.fingerprint(t.as_py(), WIDTH) for t in b.column(1)), np.uint64, b.num_rows).view(np.int64))], ["node", "fp"])

    prints = cut(texts.select("node", "text").mapInArrow(run, "node long, fp long"))
    firsts = prints.groupBy("fp").agg(F.min("node").alias("first"))
    same = prints.join(firsts, "fp").where("node <> first").select(F.col("first").alias("u"), F.col("node").alias("v"))
    near = simhash.links(firsts.select("fp")).join(firsts.toDF("u", "a"), "u").join(firsts.toDF("v", "b"), "v")
    return same.unionByName(near.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))).distinct()


def _joined(reached: DataFrame, links: DataFrame) -> DataFrame:
    """reached (node, component) with further links (u, v): only the components that these join go through the search for components."""
    at = lambda end: reached.select(F.col("node").alias(end), F.col("component").alias(f"c_{end}"))
    between = links.join(at("u"), "u", "left").join(at("v"), "v", "left").select(F.coalesce("c_u", "u").alias("u"), F.coalesce("c_v", "v").alias("v"))
    roots = components(between)
    moved = reached.join(roots.toDF("component", "root"), "component", "left").select("node", F.coalesce("root", "component").alias("component"))
    return moved.unionByName(roots).distinct()


def near_copies(docs: DataFrame) -> DataFrame:
    """row (doc_id, h: a hash of the text), component: the first row of each sequence of words in docs, null ids last."""
    spark = docs.sparkSession
    nodes = cut(_nodes(docs))
    release(spark)
    texts = nodes.where("text IS NOT NULL")
    members = cut(_members(texts))
    tested = cut(_verified(_by_fingerprint(texts), texts))
    reached = cut(components(tested.where("ok").select("u", "v")))
    for search in (_with_centres, _with_other_centres, _all_pairs):
        release(spark)
        left = _open(members, reached)
        found = search(left, texts) if search is _all_pairs else search(left)
        known = tested.select(F.least("u", "v").alias("_u"), F.greatest("u", "v").alias("_v"))
        fresh = found.join(known, (F.least("u", "v") == F.col("_u")) & (F.greatest("u", "v") == F.col("_v")), "left_anti")
        fresh = cut(_verified(fresh, texts))
        tested = tested.unionByName(fresh)
        left = found = known = None
        release(spark)
        links = fresh.where("ok").select("u", "v")
        if not links.isEmpty():
            reached = cut(_joined(reached, links))
    release(spark)
    row = F.struct("doc_id", "h").alias("row")
    return nodes.select(row, "node").join(reached, "node", "left").select("row", F.coalesce("component", "node").alias("component"))


def _first(row):
    """The first of rows (doc_id, h); null ids come last."""
    return F.min_by(row, F.struct(row["doc_id"].isNull(), row["doc_id"], row["h"])).alias("row")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of docs of each component: the smallest id's (null ids come last), then the smallest hash of the text."""
    names = docs.columns
    kept = near_copies(docs).groupBy("component").agg(_first(F.col("row"))).select(F.col("row.doc_id").alias("_id"), F.col("row.h").alias("_h"))
    safe = docs.toDF(*[f"_d{i}" for i in range(len(names))])
    at, text = f"_d{names.index('doc_id')}", f"_d{names.index('text')}"
    safe = safe.withColumn("_t", F.xxhash64(text))
    return safe.join(kept, F.col(at).cast("long").eqNullSafe(F.col("_id")) & (F.col("_t") == F.col("_h")), "left_semi").dropDuplicates([at, "_t"]).drop("_t").toDF(*names)
