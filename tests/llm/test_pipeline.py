"""The pipeline's stages against plain versions of them."""

import corpus_pipeline
from engramflow.llm import decontaminate, pii, sentencepiece

from .test_near_copies import brute_components


def plain_good(text):
    words = (text or "").encode().split()
    windows = {}
    for i in range(len(words) - 2):
        windows.setdefault(tuple(words[i : i + 3]), []).append(i)
    repeated = {p + k for places in windows.values() if len(places) > 1 for p in places for k in range(3)}
    return len(words) >= 50 and 100 * len(repeated) <= 50 * len(words)


def test_stages(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = decontaminate.Index([(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()], decontaminate.Q, decontaminate.RATIO)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r for r in docs.collect()}
        after = stage(spark, docs, sf)
        if name != "tokens":
            assert after.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        after.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        rows = {r.doc_id: r for r in docs.collect()}
        assert docs.count() == len(rows) and set(rows) <= set(before)
        if name == "quality":
            assert all(plain_good(r.text) for r in rows.values())
            assert all(any(c in r.text for c in "#*$%&|<>!") for i, r in before.items() if i not in rows and plain_good(r.text))
        elif name == "near_duplicates":
            ids = sorted(before)
            assert set(rows) == {ids[k] for k in brute_components([before[i].text for i in ids])}
        elif name == "decontaminate":
            assert set(rows) == {i for i, r in before.items() if not items.find(r.text)}
        elif name == "pii":
            assert set(rows) == set(before)
            for i, r in rows.items():
                spans, _ = pii.brute_force(before[i].text)
                assert spans or r.text == before[i].text
                assert not pii.brute_force(r.text)[0] and r.n_chars == len(r.text)
        else:
            tokenizer = sentencepiece.Tokenizer(sentencepiece.read_model(open(sentencepiece.MODEL, "rb").read()))
            assert all(tokenizer.decode(r.ids) == before[i].text for i, r in rows.items())
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf).collect()} == set(rows)


ODD = "doc_id long, text string, lang string, source string, n_chars long, TEXT string, Doc_ID int"


def odd_rows():
    own = lambda k: " ".join(f"the {k}{i} of" for i in range(30))
    other = own("other")
    return [
        (5, own("x"), "en", "s", 1, "t", 1), (5, other, None, None, None, None, None), (5, own("x"), "en", "s", 1, "t", 1), (None, own("y"), "en", "s", 2, "t", 1), (None, own("x"), "en", "s", 3, None, 2),
        ((1 << 63) - 1, own("z"), "en", "s", 4, "t", 1), (7, None, "en", "s", 5, "t", 1), (8, "", None, "s", 6, "t", 1), (9, own("q") + " write to a.b@c.de", "en", "s", 7, "t", 1),
    ]


def test_odd_rows_through_every_stage(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.createDataFrame(odd_rows(), ODD)
    counts = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, sf)
        if name != "tokens":
            assert docs.dtypes == spark.createDataFrame([], ODD).dtypes
            docs = docs.toDF(*[f"c{i}" for i in range(7)])
            docs.write.parquet(str(tmp_path / str(k)))
            docs = spark.read.parquet(str(tmp_path / str(k))).toDF(*[c.split()[0] for c in ODD.split(", ")])
        rows = docs.collect()
        counts.append(len(rows))
        if name == "near_duplicates":
            assert sorted(str(r[0]) for r in rows) == ["5", "5", "9", "9223372036854775807", "None"]
        if name == "pii":
            assert any("<email>" in r[1] and r[4] == len(r[1]) for r in rows)
    assert counts == [7, 5, 5, 5, 5]


def test_empty_tables_through_every_stage(spark):
    sf = "/root/testdata/sf0.001"
    for _, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
        assert stage(spark, docs, sf).count() == 0


def test_a_cluster_without_a_shared_folder_is_refused():
    from types import SimpleNamespace

    import pytest

    from engramflow.operators.cutting import shared_folder

    conf = SimpleNamespace(get=lambda key: None)
    none = SimpleNamespace(getCheckpointDir=lambda: SimpleNamespace(isEmpty=lambda: True))
    context = lambda master: SimpleNamespace(sparkContext=SimpleNamespace(getConf=lambda: conf, master=master, _jsc=SimpleNamespace(sc=lambda: none)))
    with pytest.raises(ValueError):
        shared_folder(context("spark://host:7077"))
    assert "engramflow-" in shared_folder(context("local[4]"))
