import random

from engramflow.llm import pii

SCHEMA = "doc_id long, text string, DOC_ID2 string, spans int"


def test_base_spans_follow_the_definition():
    rng = random.Random(5)
    bits = ["a.b+c@d-e.f.g", "@", "x@y", "é@é.com", "1.2.3.4", "300.1.2.3", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 123-4567", "+1.2", "9" * 30, " ", ", ", "é", "word", "\n", "a@b.c@d.e"]
    for _ in range(2000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(12)))
        want, _ = pii.brute_force(text)
        assert [(pii.KINDS[k], s, e) for k, s, e in pii.base_spans(text)] == want


def test_patterns_discover_unseen_identifiers(spark):
    rows = [(i, f"word{'x' * i} my card number 4111 1111 1111 {x} thanks a lot", "", 0) for i, x in enumerate(("1111", "1129", "1137", "1145", "1152"))]
    rows = [r for r in rows if pii.base_spans(r[1])]
    assert len(rows) >= 3
    rows += [(50, "is my card number 4111111111111112 thanks so", "", 0), (51, "page 4111111111111112b of", "", 0), (52, None, None, None), (53, "", "", 1), (None, "mail a@b.com", "", 1), (53, "", "", 1)]
    got = {(r.doc_id, tuple((s.kind, s.start, s.end) for s in r.more)) for r in pii.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert (50, ((2, 18, 34),)) in got and (51, ()) in got and (52, ()) in got and (None, ()) in got
    assert pii.extract(spark.createDataFrame([], SCHEMA)).count() == 0


def test_grouped_digits_and_new_patterns(spark):
    """Surfaces with blanks are found by context; what was found makes patterns of its own in the next round."""
    phones = [f"+1 555 123 45{60 + i}" for i in range(12)]
    rows = [(100 + i, f"please call {p} today", "", 0) for i, p in enumerate(phones)]
    unseen = ["(555) 987-6543", "555 987 6544", "555.987.6545", "555 987 6546"]
    rows += [(10 + i, f"please call {p} today", "", 0) for i, p in enumerate(unseen)]
    rows += [(20 + i, f"her own desk {p} rings", "", 0) for i, p in enumerate(unseen)]
    rows += [(30, "her own desk 12-34-56 rings", "", 0), (31, "in 2020 35 people", "", 0), (32, "call 5", "", 0)]
    frame = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.more] for r in pii.extract(frame).collect()}
    for i, p in enumerate(unseen):
        assert got[10 + i] == [(3, 12, 12 + len(p))] and got[20 + i] == [(3, 13, 13 + len(p))]
    assert got[30] == [(3, 13, 21)] and got[31] == got[32] == []
    assert {r.doc_id: len(r.more) for r in pii.extract(frame, rounds=1).collect()}[30] == 0


def test_long_texts_take_linear_time():
    import time

    n = 5_000_000
    for text in ("1" * n, "a" * n + "@b", "a@" * (n // 2), "1." * (n // 2), "1 " * (n // 20), "+1" + "(" * n, "a" * n + "@" + "b" * n, "x" * n + " 4111 1111 1111 1111 " + "y" * n, "(" * n, "1-(" * (n // 10), "x" * n + " " + "1.2.3.4," * 50_000):
        start = time.perf_counter()
        base, rows = pii.mentions(text)
        assert time.perf_counter() - start < 30
        assert all(len(r[3]) <= pii.LONG and len(r[4]) <= 2 * pii.LONG + 1 for r in rows)
    assert [(k, e - s) for k, s, e in pii.base_spans("x" * n + " 4111 1111 1111 1111 " + "y" * n)] == [(2, 19)]


def test_extra_columns_that_differ_in_case(spark):
    rows = [(1, "mail a@b.com", "no 1.2.3.4", 2)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, TEXT string, Doc_Id int")
    assert [tuple(map(tuple, r.base)) for r in pii.extract(frame).collect()] == [((0, 5, 12),)]
    out = pii.redact(frame)
    assert out.columns == ["doc_id", "text", "TEXT", "Doc_Id"] and [tuple(r) for r in out.collect()] == [(1, "mail <email>", "no 1.2.3.4", 2)]


def test_redact_replaces_spans_and_keeps_columns(spark):
    rows = [(1, "write a@b.com or +1 555 123 4567 now", "k", 3), (2, None, None, None), (None, "ip 1.2.3.4", "k", 1), (1, "write a@b.com or +1 555 123 4567 now", "k", 3)]
    out = pii.redact(spark.createDataFrame(rows, SCHEMA))
    assert out.columns == ["doc_id", "text", "DOC_ID2", "spans"]
    assert sorted(str(r.text) for r in out.collect()) == ["None", "ip <ip>", "write <email> or <phone> now", "write <email> or <phone> now"]


def test_query_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    got = {r.doc_id: r for r in pii.query(spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == len(docs)
    for d in docs:
        spans, digest = pii.brute_force(d.text)
        assert got[d.doc_id].base_sha256 == digest
        assert got[d.doc_id].n_email == sum(s[0] == "email" for s in spans)
        assert {f"{k}:{s}:{e}" for k, s, e in spans} <= set(filter(None, got[d.doc_id].spans.split(",")))
