"""The corpus pipeline: five stages over documents, each written as Parquet and read again by the next.

1. quality: the rules' rejects go.
2. near_duplicates: of each group linked by a similarity of 0.8 or more in five-word shingles, one row stays (the smallest id).
3. decontaminate: documents that hold a benchmark item go.
4. pii: personal data in texts becomes its kind in angle brackets; n_chars follows.
5. tokens: the texts as SentencePiece ids.

All stages but the last return the columns of documents. Edge cases are those of the operators: null texts fail the
quality rules, null ids come last in stage 2, rows are judged one by one whatever their ids, empty tables stay empty, other columns are kept
even if their names clash.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from engramflow.llm import decontaminate, near_copies, pii, quality_rules, sentencepiece
from engramflow.llm.common import shared_folder, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies.keep_one(docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepiece.encode(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontaminate", leaks), ("pii", private), ("tokens", tokens)]

#: SQL has no form of stages 2 to 5.
ORACLE_SQL = None


def _remove(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir. What lies between them is written to the shared folder and removed when the stage after it is written;
    only the last stage's input stays, as the result is read from it."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, last = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = f"{folder}/{name}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
            if last:
                _remove(spark, last)
            last = path
    return docs
