"""Logs, artifacts, snapshots and sessions as files that Spark reads and writes."""

from __future__ import annotations

import json
import re
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_SECRET = re.compile(r"(?i)(api[_-]?key|authorization|token|secret|password|cookie)")
_URL_QUERY = re.compile(r"(https?://[^\s?#\"']+)\?[^\s\"']*")
HIDDEN = "[redacted]"


def redact(value):
    """Values under secret-looking keys and queries of URLs are hidden, at any depth."""
    if isinstance(value, dict):
        return {k: HIDDEN if _SECRET.search(str(k)) else redact(v) for k, v in value.items()}
    if isinstance(value, list):
        return [redact(v) for v in value]
    return _URL_QUERY.sub(r"\1?" + HIDDEN, value) if isinstance(value, str) else value


@F.pandas_udf(StringType())
def redact_json(s: pd.Series) -> pd.Series:
    """JSON texts redacted; what isn't JSON is redacted as a string."""

    def one(text):
        if text is None:
            return None
        try:
            return json.dumps(redact(json.loads(text)), sort_keys=True, ensure_ascii=False)
        except ValueError:
            return redact(text)

    return s.map(one)


def append_log(events: DataFrame, path: str, payload: str = "payload") -> None:
    """Appends events as JSON lines with their payload redacted."""
    events.withColumn(payload, redact_json(payload)).write.mode("append").json(path)


def read_log(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(events, lines that can't be parsed)."""
    names = [f.strip().split()[0] for f in schema.split(",")]
    lines = spark.read.text(path).where("trim(value) <> ''")
    parsed = lines.withColumn("_e", F.from_json("value", schema + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    return parsed.where("_e._bad IS NULL").select(*[F.col("_e")[n].alias(n) for n in names]), parsed.where("_e._bad IS NOT NULL").select("value")


def put_artifacts(artifacts: DataFrame, path: str) -> DataFrame:
    """Stores content (binary or string) under its SHA-256, each once; returns the keys."""
    keyed = artifacts.withColumn("key", F.sha2(F.col("content").cast("binary"), 256)).dropDuplicates(["key"])
    keyed.write.mode("append").parquet(path)
    return keyed.select("key")


def get_artifacts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).dropDuplicates(["key"])


def publish(tables: dict[str, DataFrame], path: str) -> str:
    """Two-phase publication: all tables of a version are written before the version is named in epochs."""
    spark = next(iter(tables.values())).sparkSession
    version = uuid.uuid4().hex
    for name, df in tables.items():
        df.write.parquet(f"{path}/versions/{version}/{name}")
    try:
        last = spark.read.schema("epoch long, version string").json(f"{path}/epochs").agg(F.max("epoch")).first()[0] or 0
    except Exception as e:  # no epoch yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        last = 0
    spark.createDataFrame([(last + 1, version)], "epoch long, version string").coalesce(1).write.mode("append").json(f"{path}/epochs")
    return version


def snapshot(spark: SparkSession, path: str, *names: str) -> dict[str, DataFrame]:
    """The tables of the newest published version; later publications don't change them."""
    version = spark.read.schema("epoch long, version string").json(f"{path}/epochs").orderBy(F.desc("epoch")).first().version
    return {n: spark.read.parquet(f"{path}/versions/{version}/{n}") for n in names}


def fingerprint(df: DataFrame) -> DataFrame:
    """One row: a digest of the rows, whatever their order or partitions: their hashes are added up and digested."""
    row = F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)]), {"ignoreNullFields": "false"}), 256)
    part = [F.sum(F.conv(F.substring(row, 1 + 12 * k, 12), 16, 10).cast("decimal(38,0)")).cast("string") for k in range(5)]
    return df.agg(F.sha2(F.concat_ws(":", F.count(F.lit(1)).cast("string"), *[F.coalesce(p, F.lit("0")) for p in part]), 256).alias("fingerprint"))


def write_session(spark: SparkSession, path: str, session_id: str, state: dict) -> None:
    """A session's state with its checksum; the newest row of a session counts."""
    if not re.fullmatch(r"[0-9a-f]{32}", session_id):
        raise ValueError("a session id has 32 hexadecimal digits")
    body = json.dumps(state, sort_keys=True)
    spark.createDataFrame([(session_id, body)], "session_id string, body string").select("session_id", "body", F.sha2("body", 256).alias("checksum"), F.current_timestamp().alias("at")).write.mode("append").parquet(path)


def read_session(spark: SparkSession, path: str, session_id: str) -> dict:
    row = spark.read.parquet(path).where(F.col("session_id") == session_id).orderBy(F.desc("at")).select("body", (F.sha2("body", 256) == F.col("checksum")).alias("whole")).first()
    if row is None or not row.whole:
        raise ValueError("no whole checkpoint of this session")
    return json.loads(row.body)


def timeline_markdown(events: DataFrame) -> DataFrame:
    """events: scope, position, title -> one line of Markdown each, a heading before each scope, in order of (scope, n)."""
    heads = events.select("scope").distinct().select("scope", F.lit(0).cast("long").alias("n"), F.concat(F.lit("## "), F.col("scope").cast("string")).alias("value"))
    lines = events.select("scope", F.col("position").cast("long").alias("n"), F.concat(F.col("position").cast("string"), F.lit(". "), F.col("title")).alias("value"))
    return heads.unionByName(lines).orderBy("scope", "n")
