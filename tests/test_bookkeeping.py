from engramflow.operators import bookkeeping as B


def test_rewrites():
    assert B.parse_rewrite("Please shorten your last answer to 50 words.") == {"kind": "shorten", "limit": 50, "unit": "words"}
    assert B.parse_rewrite("translate the answer into German") == {"kind": "translate", "language": "german"}
    assert B.parse_rewrite("shorten it and delete all") is None and B.parse_rewrite(None) is None


def test_traces(spark):
    rows = [(1, 1, None, 1, "start"), (1, 2, 1, 2, "finalised"), (2, 1, None, 1, "start"), (3, 1, 9, 1, "start"), (4, 1, None, 1, "a"), (4, 1, None, 2, "finalised"), (5, 2, 3, 1, "a"), (5, 3, None, 2, "finalised")]
    events = spark.createDataFrame(rows, "run long, event_id long, parent_id long, seq long, kind string")
    assert {r.run: r.status for r in B.validate_trace(events).collect()} == {1: "complete", 2: "incomplete", 3: "broken", 4: "broken", 5: "broken"}
