"""Dialogue files by hand, read as a data source and through Spark's own reader."""

import json

from engramflow.sources import dialogue as D

SCENE = {
    "GroupId": 5,
    "content": [
        {"ScriptKr": "#all;hide"},
        {"ScriptKr": "1;Ann;01\n3;Mika;02;text [ff00aa]x[-]", "TextEn": "Hello [ruby=a]there[/ruby]  [USERNAME]", "TextJp": " "},
        {"ScriptKr": "#wait;1500"},
        {"ScriptKr": "#na;;wind", "TextCn": "风"},
        {"ScriptKr": "#wait;2500", "TextEn": ""},
        "no record",
        {"ScriptKr": "#st;[1];serial", "TextEn": "#st;x", "BGName": "hall"},
        {"ScriptKr": "2; Bob ;03", "TextTh": "sawasdee", "GroupId": "own"},
        {"ScriptKr": "#nextepisode;x", "TextEn": "Next: the end"},
        {"ScriptKr": "#title;A title", "TextEn": "A title"},
        {"ScriptKr": "#wait;x", "TextTw": "t"},
        {"ScriptKr": "4;Eve;00;", "TextEn": "silent", "Transition": 1},
    ],
}
WANT = [
    ("a/1.json", 1, "Mika", {"en": "Hello there [USERNAME]"}, "text x", 3, "5"),
    ("a/1.json", 3, "", {"zh-CN": "风"}, "wind", 1, "5"),
    ("a/1.json", 7, "Bob", {"th": "sawasdee"}, "", 2, "own"),
    ("a/1.json", 9, "", {"en": "A title"}, "A title", 3, "5"),
    ("a/1.json", 10, "", {"zh-TW": "t"}, "", 1, "5"),
    ("a/1.json", 11, "Eve", {"en": "silent"}, "", 3, "5"),
]


def files(root):
    (root / "a").mkdir(parents=True)
    (root / "a/1.json").write_text(json.dumps(SCENE), encoding="utf-8")
    (root / "a/2.json").write_text('{"content": [{"TextEn": "x", "TextEn": "y"}]}')
    (root / "b.JSON").write_bytes(json.dumps({"content": [{"TextEn": "só"}]}, ensure_ascii=False).encode("utf-16"))
    (root / "c.json").write_text('{"other": 1}')
    (root / "d.txt").write_text("not read")


def rows(df):
    return sorted((r.source_key, r.record_index, r.speaker, r.languages, r.korean, r.boundary, r.group_id) for r in df.collect())


def test_both_ways_to_read(spark, tmp_path):
    root = tmp_path / "scenes"
    files(root)
    want = sorted([*WANT, ("b.JSON", 0, "", {"en": "só"}, "", 0, None)], key=lambda r: r[:2])
    assert rows(D.read(spark, str(root))) == want
    spark.dataSource.register(D.DialogueSource)
    records = spark.read.format("dialogue").load(str(root))
    assert records.rdd.getNumPartitions() == 4
    assert rows(D.blocks(records)) == want
    errors = {r.source_key: r.error for r in records.where("error IS NOT NULL").collect()}
    assert errors.keys() == {"a/2.json", "c.json"} and "repeated key" in errors["a/2.json"] and errors["c.json"] == "no dialogue"


def test_no_files(spark, tmp_path):
    spark.dataSource.register(D.DialogueSource)
    (tmp_path / "none").mkdir()
    assert D.blocks(D.dialogue_records(spark.createDataFrame([], "source_key string, content binary"))).count() == 0
