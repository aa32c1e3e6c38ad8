"""Access paths, codecs and paragraph texts on small rows."""

import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from engramflow.operators import access as A


def test_lists(spark):
    e = spark.createDataFrame([(3, "k", 1, 7, 2), (1, "k", 1, 7, 1), (2, "k", 0, 8, 1), (4, "l", 0, 9, 1)], "id long, source_key string, segment_index int, source_id long, extraction_run_id long")
    ids = lambda df: [r.id for r in df.collect()]
    assert ids(A.by_key(e, "k")) == [2, 1, 3] and ids(A.by_key(e, "k", 1)) == [2, 1] and ids(A.by_key(e, "z")) == []
    assert ids(A.by_source(e, 7)) == [1, 3] and [r[0] for r in A.source_ids(e).collect()] == [7, 8, 9]
    assert [tuple(r) for r in A.ids_of_sources(e, spark.createDataFrame([(9,), (7,), (9,), (1,)], "source_id long")).collect()] == [(7, 1), (7, 3), (9, 4)]
    p = spark.createDataFrame([(1, 7, 1), (2, 7, 0)], "id long, source_id long, paragraph_index int")
    assert ids(A.paragraphs_of(p, 7)) == [2, 1]
    bare = A.sources_without_paragraphs(spark.createDataFrame([(7,), (8,), (9,), (10,)], "id long"), e, p)
    assert sorted(map(tuple, bare.collect())) == [(8, "k", 0), (9, "l", 0)]
    edges = spark.createDataFrame([(2, "contextual_recall", "active"), (1, "contextual_recall", "probation"), (3, "semantic", "active")], "id long, association_mode string, lifecycle_state string")
    assert ids(A.contextual(edges)) == [1, 2] and ids(A.contextual(edges, "active")) == [2]
    cues = spark.createDataFrame([(2, "d", "need"), (1, "d", "context"), (3, "e", "need")], "id long, domain string, cue_kind string")
    assert ids(A.prototypes(cues)) == [1, 2, 3] and ids(A.prototypes(cues, "d", "NEED")) == [2]
    with pytest.raises(ValueError):
        A.prototypes(cues, kind="other")
    concepts = spark.createDataFrame([(1, "active", [1.0]), (2, "merged", [1.0])], "id long, status string, embedding array<float>")
    assert ids(A.active_vectors(concepts)) == [1]
    shot = A.alias_snapshot(concepts.select("id"), spark.createDataFrame([(1, 5, "b"), (1, 4, "a")], "concept_id long, alias_id long, normalized_alias string"))
    assert [(r.id, r.normalized_alias) for r in shot.collect()] == [(1, "a"), (1, "b"), (2, None)]


def test_codec_and_fact_ids(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, None), (4, [float("nan"), 1.0])], "id long, v array<float>")
    coded = df.select("id", A.encode_vectors(F.col("v")).alias("b"))
    got = {r.id: r.b for r in coded.collect()}
    assert bytes(got[1]) == np.array([0.6, 0.8], "<f4").tobytes() and got[2] is got[3] is got[4] is None
    assert [r[0] for r in coded.where("id = 1").select(A.decode_vectors(F.col("b"), 2)).collect()] == [[np.float32(0.6), np.float32(0.8)]]
    assert coded.where("id = 1").select(A.decode_vectors(F.col("b"), 3)).first()[0] is None
    fact = spark.createDataFrame([(7, 1, "ab", 2, 5, " Ünïcode ")], "s long, e long, h string, a long, z long, c string")
    plain = json.dumps({"source_id": 7, "episode_id": 1, "source_sha256": "ab", "start": 2, "end": 5, "claim": "Ünïcode"}, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    assert fact.select(A.fact_id(*[F.col(c) for c in "sehazc"])).first()[0] == "f_" + hashlib.sha256(plain.encode()).hexdigest()


def test_paragraph_texts(spark):
    text = "[source_key: a]\n[speaker_alias_legend]\nAnn = A\n\n[record: 1]\n[speaker_raw:  Ann ]\n[script_raw: x\n[record: no\ny]\n\n \n en: hi \n[meta]\n[open\n[script_raw: one]\n[speaker_raw: ]\nlast"
    assert A.paragraph_text(text) == "speaker: Ann\n\nen: hi\n[open\nlast"
    assert A.paragraph_text("[a]\n[b] ") == "[a]\n[b]" and A.paragraph_text(None) == ""
    assert spark.createDataFrame([(text,), (None,)], "t string").select(A.paragraph_texts(F.col("t"))).collect()[1][0] == ""
