from engramflow.functions import text
from engramflow.operators import excerpts as X
from engramflow.operators import lexical


def test_windows_and_legends():
    spans = [(0, 10), (12, 20), (22, 60), (62, 70)]
    assert X.grow_window(spans, 1, 20) == (0, 20)
    assert X.grow_window(spans, 1, 1000) == (0, 70)
    assert X.grow_window(spans, 1, 1000, [(5, 8)]) == (12, 70)
    assert X.grow_window(spans, 3, 5) == (62, 70)
    assert X.parse_legend("x\n[aliases: Ann: en=Annie | de=Anna; Bob: en=Rob]\ny") == {"Ann": {"en": "Annie", "de": "Anna"}, "Bob": {"en": "Rob"}}


def test_excerpt():
    text = "\n\n".join(f"block {i} " + "x" * 90 for i in range(100))
    assert X.excerpt("short", budget=10) == "short"
    assert X.excerpt(text, quotes=["block 50 x", "absent"], budget=300) == "block 50 x"
    got = X.excerpt(text, keywords=["BLOCK 50 "], budget=400)
    assert [p[:8] for p in got.split("\n\n")] == ["block 49", "block 50", "block 51"]
    assert len(X.excerpt(text, budget=300)) <= 300


def test_sparse_search(spark):
    docs = spark.createDataFrame([(1, "s1", "the red fox runs"), (2, "s2", "a red box"), (3, "s3", "東京都の話"), (4, "s4", None)], "id long, source string, text string")
    asked = spark.createDataFrame([(1, 'where is the "red fox"?'), (2, "東京")], "query_id long, text string")
    got = {(r.query_id, r["rank"]): r.id for r in lexical.sparse_search(docs, asked, 5).collect()}
    assert got[1, 1] == 1 and got[2, 1] == 3


def test_sparse_search_reads_whole_texts(spark):
    """a word after the first 96 distinct ones, of a document or of a question, is found like the others."""
    many = " ".join(f"word{i}" for i in range(300))
    docs = spark.createDataFrame([(1, "s1", f"{many} zebra"), (2, "s2", "a red box"), (3, "s3", "東" + "京都の話を長く書く" * 30 + "猫犬鳥")], "id long, source string, text string")
    asked = spark.createDataFrame([(1, "zebra"), (2, " ".join(f"other{i}" for i in range(300)) + " box"), (3, "猫犬鳥"), (4, " ".join(f'"no phrase {i}"' for i in range(30)) + ' "red box"')], "query_id long, text string")
    got = {(r.query_id, r["rank"]): r.id for r in lexical.sparse_search(docs, asked, 5).collect()}
    assert [got.get((q, 1)) for q in (1, 2, 3, 4)] == [1, 2, 3, 2]
    assert len(text.units(many, 3)) == 300 and len(text.anchors(" ".join(f'"abc {i}"' for i in range(30)))) == 30
