"""Access paths over the stored tables: filters that reach the scan, and the order in which rows are listed."""

from __future__ import annotations

import json
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Kinds of cue prototypes.
CUE_KINDS = ("context", "need")
_SPEAKER = re.compile(r"^\[speaker_raw:\s*(.*?)\]$")


def by_key(episodes: DataFrame, source_key: str, run: int | None = None) -> DataFrame:
    """Episodes of a source key, of one extraction run if asked, by segment and id."""
    found = episodes.where(F.col("source_key") == source_key)
    return (found if run is None else found.where(F.col("extraction_run_id") == run)).orderBy("segment_index", "id")


def by_source(episodes: DataFrame, source_id: int) -> DataFrame:
    return episodes.where(F.col("source_id") == source_id).orderBy("id")


def paragraphs_of(paragraphs: DataFrame, source_id: int) -> DataFrame:
    return paragraphs.where(F.col("source_id") == source_id).orderBy("paragraph_index", "id")


def source_ids(episodes: DataFrame) -> DataFrame:
    """source_id of all sources that have episodes, each once."""
    return episodes.select("source_id").distinct().orderBy("source_id")


def ids_of_sources(episodes: DataFrame, sources: DataFrame) -> DataFrame:
    """source_id, id of the episodes of sources (source_id; repeated ones count once)."""
    return episodes.join(sources.select("source_id").distinct(), "source_id", "left_semi").select("source_id", "id").orderBy("source_id", "id")


def contextual(edges: DataFrame, state: str | None = None) -> DataFrame:
    """Edges of contextual recall, in one state if asked, by id."""
    found = edges.where("association_mode = 'contextual_recall'")
    return (found.where(F.col("lifecycle_state") == state) if state else found).orderBy("id")


def prototypes(cues: DataFrame, domain: str | None = None, kind: str | None = None) -> DataFrame:
    """Cue prototypes of a domain and kind, by id."""
    if kind and kind.casefold() not in CUE_KINDS:
        raise ValueError("a cue is of context or need")
    found = cues.where(F.col("domain") == domain) if domain else cues
    return (found.where(F.col("cue_kind") == kind.casefold()) if kind else found).orderBy("id")


def active_vectors(concepts: DataFrame) -> DataFrame:
    return concepts.where("status = 'active'").select("id", "embedding").orderBy("id")


def alias_snapshot(concepts: DataFrame, aliases: DataFrame) -> DataFrame:
    """Every concept with each of its aliases (concept_id, alias_id, normalized_alias), once with null if it has none."""
    own = aliases.select(F.col("concept_id").alias("id"), "alias_id", "normalized_alias")
    return concepts.join(own, "id", "left").orderBy("id", "alias_id")


def sources_without_paragraphs(sources: DataFrame, episodes: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """id, source_key, segment_index: sources with episodes and no paragraphs, with the least key and segment of their episodes."""
    keys = episodes.groupBy(F.col("source_id").alias("id")).agg(F.min("source_key").alias("source_key"), F.min("segment_index").alias("segment_index"))
    bare = sources.select("id").join(paragraphs.select(F.col("source_id").alias("id")).distinct(), "id", "left_anti")
    return bare.join(keys, "id").select("id", "source_key", "segment_index")


def fact_id(source_id: Column, episode_id: Column, source_sha256: Column, start: Column, end: Column, claim: Column) -> Column:
    """f_ and the digest of what a fact claims of which place, whatever needs or contexts it is annotated with."""

    @F.pandas_udf(T.StringType())
    def canonical(episode: pd.Series, claim: pd.Series, end: pd.Series, sha: pd.Series, source: pd.Series, start: pd.Series) -> pd.Series:
        rows = zip(claim, end, episode, source, sha, start)
        return pd.Series([json.dumps({"claim": c.strip(), "end": int(e), "episode_id": int(p), "source_id": int(i), "source_sha256": h, "start": int(s)}, ensure_ascii=False, sort_keys=True, separators=(",", ":")) for c, e, p, i, h, s in rows], dtype=object)

    return F.concat(F.lit("f_"), F.sha2(canonical(episode_id, claim, end, source_sha256, source_id, start), 256))


def encode_vectors(vector: Column) -> Column:
    """Little-endian 32-bit floats of unit length; null for vectors that are null, zero or not finite."""

    @F.pandas_udf(T.BinaryType())
    def encode(vectors: pd.Series) -> pd.Series:
        def of(v):
            x = None if v is None else np.asarray(v, np.float32)
            length = 0.0 if x is None or not len(x) or not np.isfinite(x).all() else float(np.linalg.norm(x))
            return (x / np.float32(length)).astype("<f4").tobytes() if length > 0 else None

        return vectors.map(of)

    return encode(vector)


def decode_vectors(blob: Column, dimension: int) -> Column:
    """The floats of a blob of that dimension; null for blobs of another size."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def decode(blobs: pd.Series) -> pd.Series:
        return blobs.map(lambda b: np.frombuffer(b, "<f4").astype(np.float32) if b is not None and len(b) == 4 * dimension else None)

    return decode(blob)


def paragraph_text(text: str | None) -> str:
    """A paragraph as its embedding is made of: records' marks, alias legends, script commands and other metadata go, speakers stay as ``speaker: ...``, blank
    lines are one; the whole paragraph if nothing is left."""
    out: list[str] = []
    legend = script = False
    for line in (x.strip() for x in (text or "").splitlines()):
        if script:
            script = not line.endswith("]")
        elif not line:
            if out and out[-1]:
                out.append("")
        elif line == "[speaker_alias_legend]":
            legend = True
        elif line.startswith("[record:"):
            legend = False
        elif legend:
            continue
        elif line.startswith("[script_raw:"):
            script = not line.endswith("]")
        elif named := _SPEAKER.match(line):
            if named[1].strip():
                out.append(f"speaker: {named[1].strip()}")
        elif not line.startswith(("[source_key:", "[segment_index:")) and not (line.startswith("[") and line.endswith("]")):
            out.append(line)
    return "\n".join(out).strip() or (text or "").strip()


def paragraph_texts(text: Column) -> Column:
    @F.pandas_udf(T.StringType())
    def clean(texts: pd.Series) -> pd.Series:
        return texts.map(paragraph_text)

    return clean(text)
