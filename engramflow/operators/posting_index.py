"""A maintained inverted index: segments of postings, documents that supersede each other, and changes of document frequencies.

    index = PostingIndex(spark, folder)
    index.apply(changes, epoch)     # changes: id, seq, op (put or delete), terms
    index.search(queries, k)        # queries: query_id, terms

A batch of changes becomes a segment of four tables: ``docs`` (what every changed document is now, in buckets of ids), ``postings`` and ``frequencies`` (by how many
documents a term's frequency has changed; both in buckets of terms) and ``totals``. Nothing that was written before is written again. A posting is dead if a
later segment has a document of its id, so a search reads the asked terms' buckets and the ids of the segments after the first one. Once
there are more than SEGMENTS segments they are merged into one.

Every version of the index is a manifest that names its segments, written last. A batch that runs again, as after a lost driver,
starts from the version before it and writes the same version, so epochs come out once (``feed`` makes them of a stream's batches).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Buckets of terms and ids, and segments that a search may have to look through.
BUCKETS, SEGMENTS = 32, 8
#: Saturation and length normalisation of BM25, and the least weight of a term that most documents have.
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6

DOCS = "b int, id long, seq long, deleted boolean, length long, terms array<struct<term:string,tf:long>>"
POSTINGS = "b int, term string, id long, seq long, tf long, length long"
FREQUENCIES = "b int, term string, delta long"
TOTALS = "n long, length long"
TABLES = {"docs": DOCS, "postings": POSTINGS, "frequencies": FREQUENCIES, "totals": TOTALS}


def bucket(of: str) -> Column:
    return F.pmod(F.xxhash64(of), F.lit(BUCKETS)).cast("int")


def counted(changes: DataFrame) -> DataFrame:
    """id, seq, deleted, length, terms (array of term, tf): the last change of each id."""
    last = F.max_by(F.struct("seq", "op", "terms"), F.struct("seq", F.col("op") == "delete"))
    rows = changes.groupBy("id").agg(last.alias("c")).select("id", "c.seq", (F.col("c.op") == "delete").alias("deleted"), F.when(F.col("c.op") != "delete", F.col("c.terms")).alias("terms"))
    each = rows.select("id", F.explode("terms").alias("term")).where("term IS NOT NULL").groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"))
    lists = each.groupBy("id").agg(F.sum("tf").alias("length"), F.array_sort(F.collect_list(F.struct("term", "tf"))).alias("terms"))
    none = F.array().cast("array<struct<term:string,tf:long>>")
    return rows.drop("terms").join(lists, "id", "left").select("id", "seq", "deleted", F.coalesce("length", F.lit(0)).alias("length"), F.coalesce("terms", none).alias("terms"))


class PostingIndex:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _files(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        return path, path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """Versions whose manifest is whole: 2 * epoch, and 2 * epoch + 1 after its merge."""
        path, files = self._files()
        at = path(f"{self.path}/manifest")
        if not files.exists(at):
            return []
        names = [s.getPath() for s in files.listStatus(at)]
        return sorted(int(p.getName().split("=")[1]) for p in names if files.exists(path(p, "_SUCCESS")))

    def segments(self, before: int | None = None) -> list[str]:
        """Names of the segments, first to last, of the last version (before another)."""
        found = [v for v in self.versions() if before is None or v < before]
        if not found:
            return []
        return [r.segment for r in self.spark.read.parquet(f"{self.path}/manifest/version={found[-1]}").orderBy("place").collect()]

    def _publish(self, version: int, segments: list[str]) -> None:
        rows = self.spark.createDataFrame(list(enumerate(segments)), "place int, segment string")
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/version={version}")

    def read(self, name: str, segments: list[str]) -> DataFrame:
        out = self.spark.createDataFrame([], TABLES[name] + ", segment int")
        for k, s in enumerate(segments):
            out = out.unionByName(self.spark.read.schema(TABLES[name]).parquet(f"{self.path}/{s}/{name}").withColumn("segment", F.lit(k)))
        return out

    def _write(self, segment: str, name: str, df: DataFrame) -> None:
        df = df.select(*[f.split()[0] for f in TABLES[name].split(", ")])
        if name == "totals":
            df.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/{segment}/{name}")
        else:
            df.repartition("b").sortWithinPartitions("b", "id" if name == "docs" else "term").write.mode("overwrite").partitionBy("b").parquet(f"{self.path}/{segment}/{name}")

    def _postings(self, segment: str, docs: DataFrame) -> None:
        each = docs.where("NOT deleted").select("id", "seq", "length", F.explode("terms").alias("t"))
        self._write(segment, "postings", each.select("id", "seq", "length", "t.*").withColumn("b", bucket("term")))

    def apply(self, changes: DataFrame, epoch: int) -> None:
        """One batch as the segment of its epoch. A change that is not newer (seq) than what the index has of its id is left out; of one batch the newest counts."""
        have = self.segments(before=2 * epoch)
        name = f"segment-{epoch}"
        ids = changes.select("id").distinct()
        held = self.read("docs", have).join(ids, "id", "left_semi").groupBy("id").agg(F.max_by(F.struct("seq", "deleted", "length", "terms"), "seq").alias("old"))
        fresh = counted(changes).join(held.select("id", F.col("old.seq").alias("_s")), "id", "left").where("_s IS NULL OR seq > _s").drop("_s")
        self._write(name, "docs", fresh.withColumn("b", bucket("id")))
        fresh = self.read("docs", [name])
        self._postings(name, fresh)
        gone = held.join(fresh.select("id"), "id", "left_semi").where("NOT old.deleted")
        up = fresh.where("NOT deleted").select(F.explode("terms.term").alias("term"), F.lit(1).cast("long").alias("d"))
        down = gone.select(F.explode("old.terms.term").alias("term"), F.lit(-1).cast("long").alias("d"))
        self._write(name, "frequencies", up.unionByName(down).groupBy("term").agg(F.sum("d").alias("delta")).where("delta <> 0").withColumn("b", bucket("term")))
        n = fresh.where("NOT deleted").select(F.lit(1).cast("long").alias("n"), "length").unionByName(gone.select(F.lit(-1).cast("long").alias("n"), (-F.col("old.length")).alias("length")))
        self._write(name, "totals", n.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("length")))
        self._publish(2 * epoch, [*have, name])
        if len(have) + 1 > SEGMENTS:
            self.merge(epoch)

    def live(self, segments: list[str] | None = None) -> DataFrame:
        """The newest row of every id, deleted ones too (their seq keeps late changes out)."""
        docs = self.read("docs", self.segments() if segments is None else segments)
        return docs.groupBy("id").agg(F.max_by(F.struct("seq", "deleted", "length", "terms"), "seq").alias("d")).select("id", "d.*")

    def merge(self, epoch: int) -> None:
        """All segments of the epoch's version as one; those that it replaces go when the next version is there."""
        have = self.segments(before=2 * epoch + 1)
        name = f"merged-{epoch}"
        self._write(name, "docs", self.live(have).withColumn("b", bucket("id")))
        self._postings(name, self.read("docs", [name]))
        self._write(name, "frequencies", self.read("frequencies", have).groupBy("b", "term").agg(F.sum("delta").alias("delta")).where("delta <> 0"))
        self._write(name, "totals", self.read("totals", have).agg(F.sum("n").alias("n"), F.sum("length").alias("length")))
        self._publish(2 * epoch + 1, [name])

    def clean(self) -> None:
        """Remove the segments that the last version does not name, and older manifests: for when nothing reads older versions."""
        path, files = self._files()
        keep, versions = set(self.segments()), self.versions()
        for status in files.listStatus(path(self.path)):
            name = status.getPath().getName()
            if name.startswith(("segment-", "merged-")) and name not in keep:
                files.delete(status.getPath(), True)
        for v in versions[:-1]:
            files.delete(path(f"{self.path}/manifest/version={v}"), True)

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """query_id, id, score, rank of each query's k best documents by BM25; a query's terms count once, documents without an asked term have no rank, ties
        (in nine digits) go to the smaller id. idf = ln((N - n + .5) / (n + .5)), LEAST_IDF at least."""
        segments = self.segments()
        asked = queries.select("query_id", F.explode(F.array_distinct("terms")).alias("term")).where("term IS NOT NULL").withColumn("b", bucket("term"))
        buckets = [r.b for r in asked.select("b").distinct().collect()]  # at most BUCKETS numbers: the folders to read
        words = asked.select("b", "term").distinct()
        n, length = self.read("totals", segments).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("length"), F.lit(0))).first()
        mean = length / n if n and length else 1.0
        df = self.read("frequencies", segments).where(F.col("b").isin(buckets)).join(words, ["b", "term"], "left_semi").groupBy("term").agg(F.sum("delta").alias("df"))
        idf = F.greatest(F.lit(LEAST_IDF), F.log((F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5)))
        hits = self.read("postings", segments).where(F.col("b").isin(buckets)).join(words, ["b", "term"], "left_semi")
        later = self.read("docs", segments).where("segment > 0").groupBy("id").agg(F.max("segment").alias("_newest"))
        alive = hits.join(later, "id", "left").where("_newest IS NULL OR segment >= _newest").select("id", "term", "tf", "length")
        part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * ((1 - B) + B * F.col("length") / mean))
        weighed = alive.join(df.select("term", idf.alias("idf")), "term").select("id", "term", part.alias("part"))
        scores = asked.select("query_id", "term").join(weighed, "term").groupBy("query_id", "id").agg(F.round(F.sum("part"), 9).alias("score"))
        return scores.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)


def feed(index: PostingIndex, stream: DataFrame, checkpoint: str, first: int = 1):
    """A writer that applies a stream of changes batch by batch: batch n is epoch first + n, whether it runs once or again."""
    return stream.writeStream.foreachBatch(lambda df, n: index.apply(df, first + n)).option("checkpointLocation", checkpoint)
