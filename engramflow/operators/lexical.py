"""Lexical retrieval over term tables: postings, BM25, IDF cosines and fusion. Ties go to the smaller id."""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scan
from .cutting import cut

#: Saturation and length normalisation of BM25.
K1, B = 1.2, 0.75


def ascii_words(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda w: w != "")


def postings(docs: DataFrame, terms: str = "terms") -> DataFrame:
    """docs: id, source, terms -> id, source, term, tf."""
    return docs.select("id", "source", F.explode(terms).alias("term")).groupBy("id", "source", "term").agg(F.count(F.lit(1)).alias("tf"))


class Bm25:
    """idf, mean length and formula over the fields of encoded documents; df and the number of sources count sources.

    idf = log1p((S - df + .5) / (df + .5)); a term's part is idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean length)); terms c1: weigh
    0.15; a query's terms count once; scores are rounded to nine digits, so that copies of a text tie whatever the order of summing."""

    def __init__(self, encoded: DataFrame, block: scan.Block, weights: dict[str, float], k1: float = K1, b: float = B):
        self.block, self.weights, self.k1, self.b = block, weights, k1, b
        totals = encoded.agg(F.countDistinct("source").alias("s"), *[F.avg(f"{f}_len").alias(f) for f in weights]).first()
        light = np.array([0.15 if t.startswith("c1:") else 1.0 for t in block.names])
        self.idf, self.mean = {}, {}
        for f in weights:
            df = np.zeros(len(block.names))
            for r in encoded.select("source", F.explode(f"{f}_term").alias("term")).groupBy("term").agg(F.countDistinct("source").alias("df")).toLocalIterator():
                df[r.term] = r.df
            self.idf[f] = np.log1p((totals.s - df + 0.5) / (df + 0.5)) * light
            self.mean[f] = totals[f] or 1.0

    def __call__(self, part) -> np.ndarray:
        total = 0.0
        for f, weight in self.weights.items():
            doc, term, tf, size = scan.postings(part, f)
            norm = self.k1 * ((1 - self.b) + self.b * size / self.mean[f])
            total = total + weight * scan.summed(self.block, part.num_rows, doc, term, self.idf[f][term] * tf * (self.k1 + 1) / (tf + norm[doc]))
        if "holds" in part.schema.names:
            good = np.zeros(total.shape, bool)
            lists = part.column("holds")
            good[lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(np.arange(part.num_rows), np.diff(lists.offsets.to_numpy()))] = True
            total = np.where(good, total, 0.0)
        return np.round(total, 9)


_TOP = "query_id long, id long, source string, score double"


def _top_of(encoded: DataFrame, block: scan.Block, score, k: int, adjust=None) -> DataFrame:
    """Every task's k best of each query; adjust(batch) gives a factor by document."""
    sent = encoded.sparkSession.sparkContext.broadcast((block, score))

    def run(batches):
        own, value = sent.value
        best = scan.Best(len(own.ids), k)
        for part, scores in scan.slices(batches, own, value):
            if adjust is not None:
                scores = scores * adjust(part)[None, :]
            best.add(scores, part.column("id").to_numpy(), part.column("source").to_pylist())
        rows = [(int(own.ids[q]), i, source, -s) for q, held in enumerate(best.rows) for s, i, source in held]
        columns = zip(*rows) if rows else ((), (), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.float64()))], ["query_id", "id", "source", "score"])

    return encoded.mapInArrow(run, _TOP)


def bm25_top(docs: DataFrame, queries: DataFrame, k: int, weights: dict[str, float] | None = None, phrases: bool = False, by_length: bool = False, form=None) -> DataFrame:
    """docs: id, source and an array of terms (or a text, of which form(text) are the terms) for each field of weights (default: terms); queries: query_id, terms -> query_id, id, source, score,
    rank of the k best documents of each query by the weighed sum of the fields' BM25.

    phrases: docs have text, queries phrases, and only documents that hold one of a query's phrases (lower case) count. by_length: scores are divided
    by the length of the first field. Documents without an asked term have no rank."""
    weights = weights or {"terms": 1.0}
    fields = list(weights)
    found = docs.sparkSession.createDataFrame([], _TOP)
    docs = docs.withColumn("source", F.col("source").cast("string"))
    if phrases:
        docs = docs.withColumn("text", F.lower("text"))
    size = f"{fields[0]}_len"
    adjust = (lambda part: 1.0 / np.maximum(part.column(size).to_numpy(), 1)) if by_length else None
    for block in scan.blocks(queries, *(["phrases"] if phrases else [])):
        encoded = scan.encode(docs, block, fields, ("source",), "text" if phrases else None, form)
        found = found.unionByName(_top_of(encoded, block, Bm25(encoded, block, weights), k, adjust))
    return scan.ranked(found, k)


def top(scores: DataFrame, k: int, by: str = "query_id") -> DataFrame:
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)


def channel_fusion(channels: DataFrame, k: int = 60) -> DataFrame:
    """channels: query_id, id, weight, rank, raw -> the largest weight / (k + rank) of each (query_id, id), with the best raw score."""
    return channels.groupBy("query_id", "id").agg(F.max(F.col("weight") / (k + F.col("rank"))).alias("score"), F.max("raw").alias("raw"))


def candidate_fusion(episodes: DataFrame, sources: DataFrame, ranked: DataFrame | None = None, share: float = 0.35, k: int = 60) -> DataFrame:
    """episodes: query_id, id, source, score; sources: query_id, source, score; ranked: id, rank (dense, graph orders) ->
    id, score: for each query s = ep / max ep + share * src / max src; sources are ranked by their best s; vote s / best of the
    source / (k + the source's rank); votes are averaged over queries, 1 / (k + rank) of each ranked row is added."""
    most = Window.partitionBy("query_id")
    ep = episodes.withColumn("e", F.col("score") / F.max("score").over(most)).select("query_id", "id", "source", "e")
    src = sources.withColumn("s", F.col("score") / F.max("score").over(most)).select("query_id", "source", "s")
    mixed = ep.join(src, ["query_id", "source"], "left").select("query_id", "id", "source", (F.col("e") + share * F.coalesce("s", F.lit(0.0))).alias("v"))
    best = mixed.groupBy("query_id", "source").agg(F.max("v").alias("best"), F.max_by(-F.col("id"), F.struct("v", -F.col("id"))).alias("first"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("best"), F.desc("first")))
    votes = mixed.join(best.withColumn("place", place), ["query_id", "source"]).select("query_id", "id", (F.col("v") / F.col("best") / (k + F.col("place"))).alias("vote"))
    n = episodes.agg(F.countDistinct("query_id").alias("n"))
    total = votes.groupBy("id").agg(F.sum("vote").alias("t")).join(F.broadcast(n)).select("id", (F.col("t") / F.col("n")).alias("x"))
    if ranked is not None:
        total = total.unionByName(ranked.select("id", (1 / (k + F.col("rank"))).alias("x")))
    return total.groupBy("id").agg(F.sum("x").alias("score"))


def representatives(scored: DataFrame) -> DataFrame:
    """The best row of each source: score descending, then id."""
    return scored.withColumn("_r", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("score"), "id"))).where("_r = 1").drop("_r")


def lexical_votes(docs: DataFrame, queries: DataFrame, share: float = 0.35, k: int = 60) -> DataFrame:
    """docs: id, source, terms; queries: query_id, terms -> id, source, score: candidate_fusion() of the BM25 of documents and of sources (sums of their
    documents') without a row for each query and document.

    Three passes over the encoded documents: the best score of each query and the sum of each (query, source); then the best value and first
    document of each (query, source); then each document's votes summed over the queries."""
    spark = docs.sparkSession
    docs = docs.withColumn("source", F.col("source").cast("string"))
    out, asked = None, 0
    for block in scan.blocks(queries):
        encoded = scan.encode(docs, block, ["terms"], ("source",))
        score = Bm25(encoded, block, {"terms": 1.0})
        sent = spark.sparkContext.broadcast((block, score))

        def sums(batches, sent=sent):
            own, value = sent.value
            for part, scores in scan.slices(batches, own, value):
                names, number = np.unique(np.array(part.column("source").to_pylist(), object).astype(str), return_inverse=True)
                by = np.zeros((len(names), len(own.ids)))
                np.add.at(by, number, scores.T)
                most = np.zeros((len(names), len(own.ids)))
                np.maximum.at(most, number, scores.T)
                s, q = np.nonzero(by > 0)
                yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), pa.array(names[s], pa.string()), pa.array(by[s, q]), pa.array(most[s, q])], ["q", "source", "total", "most"])

        own = cut(encoded.mapInArrow(sums, "q int, source string, total double, most double").groupBy("q", "source").agg(F.sum("total").alias("total"), F.max("most").alias("most")))
        scale = {r.q: (r.most, r.total) for r in own.groupBy("q").agg(F.max("most").alias("most"), F.max("total").alias("total")).toLocalIterator()}
        asked += len(scale)
        ep = np.array([scale.get(q, (1.0, 1.0))[0] or 1.0 for q in range(len(block.ids))])
        src = np.array([scale.get(q, (1.0, 1.0))[1] or 1.0 for q in range(len(block.ids))])
        # every source's row of shares goes to its documents, so a task needs those of its own documents only
        shares = own.groupBy("source").agg(F.collect_list("q").alias("qs"), F.collect_list("total").alias("totals"))
        held = encoded.join(shares, "source", "left")
        scales = spark.sparkContext.broadcast((block, score, ep, src))

        def values(part, own_, value, ep_, src_):
            scores = value(part)
            v = scores / ep_[:, None]
            for d, (qs, totals) in enumerate(zip(part.column("qs").to_pylist(), part.column("totals").to_pylist())):
                if qs:
                    v[qs, d] += share * np.array(totals) / src_[qs]
            return np.where(scores > 0, v, 0.0)

        def firsts(batches, scales=scales):
            own_, value, ep_, src_ = scales.value
            for part, v in scan.slices(batches, own_, lambda p: values(p, own_, value, ep_, src_)):
                ids, sources = part.column("id").to_numpy(), part.column("source").to_pylist()
                q, d = np.nonzero(v > 0)
                order = np.lexsort((ids[d], -v[q, d]))
                best: dict = {}
                for i in order.tolist():
                    best.setdefault((int(q[i]), sources[d[i]]), (float(v[q[i], d[i]]), int(ids[d[i]])))
                rows = [(a, s, x, i) for (a, s), (x, i) in best.items()]
                columns = zip(*rows) if rows else ((), (), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.int32(), pa.string(), pa.float64(), pa.int64()))], ["q", "source", "best", "first"])

        best = held.mapInArrow(firsts, "q int, source string, best double, first long").groupBy("q", "source").agg(F.max("best").alias("best"), F.max_by(-F.col("first"), F.struct("best", -F.col("first"))).alias("first"))
        place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("best"), F.desc("first")))
        places = best.withColumn("place", place).groupBy("source").agg(F.collect_list("q").alias("pq"), F.collect_list("best").alias("bests"), F.collect_list("place").alias("places"))

        def votes(batches, scales=scales):
            own_, value, ep_, src_ = scales.value
            for part, v in scan.slices(batches, own_, lambda p: values(p, own_, value, ep_, src_)):
                total = np.zeros(part.num_rows)
                for d, (qs, bests, at) in enumerate(zip(*[part.column(c).to_pylist() for c in ("pq", "bests", "places")])):
                    if qs:
                        total[d] = (v[qs, d] / np.array(bests) / (k + np.array(at))).sum()
                hit = np.flatnonzero((v > 0).any(0))
                yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(hit)), part.column("source").take(pa.array(hit)), pa.array(total[hit])], ["id", "source", "x"])

        one = held.join(places, "source", "left").mapInArrow(votes, "id long, source string, x double")
        out = one if out is None else out.unionByName(one)
    if out is None:
        return spark.createDataFrame([], "id long, source string, score double")
    return out.groupBy("id").agg(F.first("source").alias("source"), (F.sum("x") / max(asked, 1)).alias("score"))


class Cosine:
    """sqrt(overlap / weight of the document * overlap / weight of the query) with idf of asked features and the documents' own weights.

    Rounded to twelve digits: weights are sums in any order, and documents of the same features shall tie."""

    def __init__(self, block: scan.Block, idf: np.ndarray, none: float):
        self.block, self.idf = block, idf
        weight = np.where(idf > 0, idf, none)
        self.query = np.bincount(block.query, weights=np.repeat(weight, np.diff(block.first)), minlength=len(block.ids))

    def __call__(self, part) -> np.ndarray:
        doc, term, _, _ = scan.postings(part, "features")
        o = scan.summed(self.block, part.num_rows, doc, term, self.idf[term])
        return np.round(np.sqrt(o / np.maximum(part.column("weight").to_numpy(zero_copy_only=False), 1e-300)[None, :] * o / np.maximum(self.query, 1e-300)[:, None]), 12)


def cue_search(cues: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """cues: id, features (distinct); queries: query_id, features (distinct) -> query_id, id, score, rank of the k best: sqrt(overlap / weight of the cue *
    overlap / weight of the query) with idf = ln((N + 1) / (df + .5)), for features no cue has ln((N + 1) / .5)."""
    docs = cues.select("id", F.explode("features").alias("f"))
    n = cues.count()
    idf = cut(docs.groupBy("f").agg(F.log((n + 1) / (F.count(F.lit(1)) + 0.5)).alias("idf")))
    weighed = cues.join(docs.join(idf, "f").groupBy("id").agg(F.sum("idf").alias("weight")), "id").withColumn("source", F.lit("")).withColumnRenamed("features", "terms")
    found = cues.sparkSession.createDataFrame([], _TOP)
    for block in scan.blocks(queries.withColumnRenamed("features", "terms")):
        known = np.zeros(len(block.names))
        names = cues.sparkSession.createDataFrame([(t,) for t in block.names], "f string")
        for r in idf.join(F.broadcast(names), "f").toLocalIterator():
            known[block.number[r.f]] = r.idf
        encoded = scan.encode(weighed.withColumnRenamed("terms", "features"), block, ["features"], ("source", "weight"))
        found = found.unionByName(_top_of(encoded, block, Cosine(block, known, float(np.log((n + 1) / 0.5))), k))
    return scan.ranked(found, k).select("query_id", "id", "score", "rank")


def record_anchors(episodes: DataFrame, records: DataFrame, eligible: Column | None = None) -> DataFrame:
    """episodes: episode, source, features; records: id, source, features (distinct) -> the record of its source with the best cosine of
    idf weights w = (1 + ln((n + 1) / (df + 1)))^2, n and df over all records of the source; features that no record has have
    df 0; only eligible records are chosen; ties: the smaller id."""
    r = records.select("id", "source", F.explode("features").alias("f"))
    n = records.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    w = r.groupBy("source", "f").agg(F.count(F.lit(1)).alias("df")).join(n, "source").select("source", "f", F.pow(1 + F.log((F.col("n") + 1) / (F.col("df") + 1)), 2).alias("w"))
    q = episodes.select("episode", "source", F.explode("features").alias("f")).join(n, "source").join(w, ["source", "f"], "left")
    q = q.select("episode", "source", "f", F.coalesce("w", F.pow(1 + F.log(F.col("n") + 1), 2)).alias("w"))
    qn = q.groupBy("episode").agg(F.sqrt(F.sum("w")).alias("qn"))
    rn = r.join(w, ["source", "f"]).groupBy("id").agg(F.sqrt(F.sum("w")).alias("rn"))
    chosen = r if eligible is None else r.where(eligible)
    cos = q.join(chosen, ["source", "f"]).groupBy("episode", "id").agg(F.sum("w").alias("s")).join(qn, "episode").join(rn, "id").select("episode", "id", (F.col("s") / F.col("qn") / F.col("rn")).alias("score"))
    # sums of the same weights differ by their order in the last digits; such scores are ties
    return cos.withColumn("_r", F.row_number().over(Window.partitionBy("episode").orderBy(F.desc(F.round("score", 10)), "id"))).where("_r = 1").drop("_r")


def containment_pairs(lines: DataFrame, least: float = 0.8) -> DataFrame:
    """lines: source_key, id, line (distinct) -> pairs (source_key, a, b, containment) of one key, a < b, whose shared lines are at least that share
    of the smaller set.

    Prefix filter: a smaller set of n lines that lacks at most (1 - least) * n of them in the other shares one of any
    floor((1 - least) * n) + 1. Those are chosen to be its rarest, so lines that very many documents have seldom join; candidate pairs are
    verified on the whole sets."""
    sets = lines.groupBy("source_key", "id").agg(F.collect_set("line").alias("s")).withColumn("n", F.size("s"))
    df = lines.groupBy("source_key", "line").agg(F.count(F.lit(1)).alias("df"))
    place = F.row_number().over(Window.partitionBy("source_key", "id").orderBy("df", "line"))
    probes = lines.join(df, ["source_key", "line"]).withColumn("r", place).join(sets.select("source_key", "id", "n"), ["source_key", "id"]).where(F.col("r") <= F.floor((1 - least) * F.col("n") + 1e-9) + 1)
    small, other = probes.select("source_key", "line", F.col("id").alias("x")), lines.select("source_key", "line", F.col("id").alias("y"))
    pairs = small.join(other, ["source_key", "line"]).where("x <> y").select("source_key", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    whole = pairs.join(sets.select("source_key", F.col("id").alias("a"), F.col("s").alias("sa")), ["source_key", "a"]).join(sets.select("source_key", F.col("id").alias("b"), F.col("s").alias("sb")), ["source_key", "b"])
    share = F.size(F.array_intersect("sa", "sb")) / F.least(F.size("sa"), F.size("sb"))
    return whole.select("source_key", "a", "b", share.alias("containment")).where(F.col("containment") >= least)


def cohort(hits: DataFrame, members: DataFrame, per_key: int = 40, total: int = 64, ratio: float = 0.95) -> DataFrame:
    """hits: query_id, id, source_key, score; members: id, source_key -> other members of the query's one key that anchors hit twice or more (most hits, then
    key), at most per_key, with ratio of the key's best score."""
    keys = hits.groupBy("query_id", "source_key").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("best")).where("n >= 2")
    one = keys.withColumn("_r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("n"), "source_key"))).where("_r = 1")
    found = one.join(members, "source_key").join(hits.select("query_id", "id"), ["query_id", "id"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("id"))
    return found.withColumn("_r", rank).where(F.col("_r") <= min(per_key, total)).select("query_id", "id", "source_key", (F.col("best") * ratio).alias("score"))


#: Weights of the sparse channels, and of the columns text and source key.
CHANNELS = {"anchor": 1.40, "trigram": 1.00, "bigram": 1.10}
TEXT_WEIGHT, KEY_WEIGHT = 1.0, 0.15


def sparse_search(docs: DataFrame, queries: DataFrame, limit: int) -> DataFrame:
    """docs: id, source, text; queries: query_id, text -> query_id, id, score, raw, rank.

    Three channels of search units of whole texts (quoted anchors as phrases, words and trigrams, words and bigrams) are each ranked by BM25 with the source key as a
    light second column, cut at 2 * limit, and fused by the largest weight / (60 + rank); ties: the best raw score, then id."""
    from ..functions.text import register_text, units

    register_text(docs.sparkSession)
    found = None
    for name, weight in CHANNELS.items():
        unit = "trigram_units" if name != "bigram" else "bigram_units"
        anchors = name == "anchor"
        asked = queries.select("query_id", F.expr(f"{unit}(text)" if not anchors else "flatten(transform(quoted_anchors(text), a -> split(a, ' ')))").alias("terms"), F.expr("quoted_anchors(text)").alias("phrases"))
        own = docs.select("id", "source", F.col("text").alias("words"), F.col("source").cast("string").alias("key"), *(["text"] if anchors else []))
        form = partial(units, n=2 if name == "bigram" else 3)
        best = bm25_top(own, asked.where(F.size("terms") > 0), 2 * limit, {"words": TEXT_WEIGHT, "key": KEY_WEIGHT}, phrases=anchors, form=form)
        channel = best.select("query_id", "id", F.lit(weight).alias("weight"), "rank", F.col("score").alias("raw"))
        found = channel if found is None else found.unionByName(channel)
    fused = channel_fusion(found)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("raw"), "id"))
    return fused.withColumn("rank", place).where(F.col("rank") <= limit)
