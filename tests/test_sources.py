"""Files, logs, stores and streams."""

import json

import pytest
from pyspark.sql import functions as F

from engramflow.sources import files, stores
from engramflow.streaming import feedback


def test_files(spark, tmp_path):
    (tmp_path / "Book").mkdir()
    (tmp_path / "Book" / "ch10.txt").write_text("# Title\n\nOne.\n\n[[memory {\"k\": 1}]] Two.", encoding="utf-8")
    (tmp_path / "Book" / "ch2.txt").write_bytes("Ann: hi there\nBob: yes\nAnn: bye".encode("utf-16"))
    (tmp_path / "a.json").write_text('{"x": {"y": ["one", "<b>two</b>"]}, "n": 3}')
    (tmp_path / "bad.json").write_text('{"a": 1, "a": 2}')
    (tmp_path / "gb.txt").write_bytes("中文".encode("gb18030"))
    (tmp_path / "bin.txt").write_bytes(b"\x00\x01")
    (tmp_path / "x.png").write_bytes(b"1")
    found = files.scan(spark, str(tmp_path))
    assert [r.source_key for r in found.collect()] == ["a.json", "bad.json", "bin.txt", "Book/ch2.txt", "Book/ch10.txt", "gb.txt", "x.png"]
    blocks = files.read_blocks(found.where("supported")).collect()
    by = {}
    for b in sorted(blocks, key=lambda b: (b.source_key, b.position)):
        by.setdefault(b.source_key, []).append(b)
    assert [(b.text, b.section) for b in by["a.json"]] == [("one", "x / y"), ("two", "x / y")]
    assert "repeated key" in by["bad.json"][0].error and "control" in by["bin.txt"][0].error
    assert [b.speaker for b in by["Book/ch2.txt"]] == ["Ann", "Bob", "Ann"]
    assert [b.text for b in by["Book/ch10.txt"]] == ["# Title", "One.", "Two."] and by["Book/ch10.txt"][0].boundary == 3 and json.loads(by["Book/ch10.txt"][2].attributes) == {"k": 1}
    assert by["gb.txt"][0].text == "中文"
    scopes = spark.createDataFrame([("A/B/c.txt",), ("c.txt",)], "k string").select(files.timeline_scope(F.col("k"))).collect()
    assert [r[0] for r in scopes] == ["a:b", "root"]
    with pytest.raises(ValueError):
        files.strict_json('{"a": NaN}')


def test_logs_and_stores(spark, tmp_path):
    log = spark.createDataFrame([(1, '{"api_key": "s", "u": "http://h/p?q=1", "n": [{"token": 2}]}')], "id long, payload string")
    stores.append_log(log, str(tmp_path / "log"))
    (tmp_path / "log" / "broken.json").write_text("{not json\n")
    good, bad = stores.read_log(spark, str(tmp_path / "log"), "id long, payload string")
    assert json.loads(good.first().payload) == {"api_key": stores.HIDDEN, "n": [{"token": stores.HIDDEN}], "u": "http://h/p?" + stores.HIDDEN}
    assert bad.count() == 1
    a = spark.createDataFrame([("x",), ("x",), ("y",)], "content string")
    stores.put_artifacts(a, str(tmp_path / "art"))
    stores.put_artifacts(a, str(tmp_path / "art"))
    assert stores.get_artifacts(spark, str(tmp_path / "art")).count() == 2
    stores.publish({"e": spark.range(3)}, str(tmp_path / "db"))
    old = stores.snapshot(spark, str(tmp_path / "db"), "e")["e"]
    stores.publish({"e": spark.range(5)}, str(tmp_path / "db"))
    assert old.count() == 3 and stores.snapshot(spark, str(tmp_path / "db"), "e")["e"].count() == 5
    assert stores.fingerprint(spark.range(9)).first()[0] == stores.fingerprint(spark.range(9).repartition(4).orderBy(F.desc("id"))).first()[0] != stores.fingerprint(spark.range(8)).first()[0]
    stores.write_session(spark, str(tmp_path / "s"), "0" * 32, {"a": 1})
    stores.write_session(spark, str(tmp_path / "s"), "0" * 32, {"a": 2})
    assert stores.read_session(spark, str(tmp_path / "s"), "0" * 32) == {"a": 2}
    with pytest.raises(ValueError):
        stores.write_session(spark, str(tmp_path / "s"), "../x", {})


def test_streams(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = feedback.windowed(feedback.read_events(spark, str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("windows").outputMode("complete").option("checkpointLocation", str(tmp_path / "c1")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(str, spark.table("windows").select("start", "event_type", "n").collect())) == sorted(map(str, feedback.windowed(events).select("start", "event_type", "n").collect()))
    source = feedback.read_events(spark, str(tmp_path / "in"), maxFilesPerTrigger=10).select(F.col("user_id").alias("id"), "ts", (F.col("value") > 20).alias("positive"))
    q = feedback.fold_weights(source).writeStream.format("memory").queryName("weights").outputMode("update").option("checkpointLocation", str(tmp_path / "c2")).start()
    q.processAllAvailable()
    q.stop()
    want = {}
    for r in events.orderBy("ts").collect():
        want[r.user_id] = want.get(r.user_id, 0.2) * 0.8 + (0.2 if r.value > 20 else 0)
    assert {r.id: round(r.weight, 9) for r in spark.table("weights").collect()} == {k: round(v, 9) for k, v in want.items()}
