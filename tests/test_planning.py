from pyspark.sql import functions as F

from engramflow.functions import values as V
from engramflow.operators import ingestion as I
from engramflow.operators import planning as P


def test_sub_queries():
    slot = P.ANSWER_SLOT.format
    assert P.sub_queries("谁说了“你好”，不要直接回答“再见”？“也许”并非事实，“再”", " 相识 ", None, "因") == ["__constraint_slot__ 关系约束：相识", "__constraint_slot__ 因果约束：因", slot("你好")]
    assert P.sub_queries(" ".join(f'"q{k}"' for k in range(9)), "r") == ["__constraint_slot__ 关系约束：r", *[slot(f"q{k}") for k in range(5)]]
    assert P.sub_queries(None) == [] and P.sub_queries('"aa" and "aa"') == [slot("aa")]
    assert P.atomic_slots(["apples, pears and plums", "a", None, "a"]) == ["apples, pears and plums", "a"]
    note = "（独立证据槽，不能由同列另一条件替代）"
    assert P.atomic_slots(["红色的苹果、绿色的梨子、桃"], ["甲", "乙"]) == ["红色的苹果、绿色的梨子、桃", f"甲、乙：红色的苹果{note}", f"甲、乙：绿色的梨子{note}"]
    assert P.atomic_slots(["小红与小明的最初约定"]) == ["小红与小明的最初约定", "小红本人直接陈述或表现的最初约定", "小明直接陈述或被转述的最初约定"]
    for whole in ("“红色的苹果、绿色的梨子”", "红色的苹果、绿色的梨子还是桃", "__answer_slot__ 红色的苹果、绿色的梨子"):
        assert P.atomic_slots([whole]) == [whole]
    assert P.atomic_slots(["红色的苹果、绿色的梨子"], whole="红色的苹果、绿色的梨子") == ["红色的苹果、绿色的梨子"]
    rest = [f"r{i}" for i in range(10)]
    assert P.bounded_queries(["q", *rest, "__answer_slot__ s", " q ", None, ""], 8) == ["q", "r0", "r1", "r2", "r3", "r8", "r9", "__answer_slot__ s"]
    assert P.bounded_queries(["q", "a", "q"], 8) == ["q", "a"] and P.bounded_queries(["q", *rest], 0) == ["q", *rest]
    assert P.bounded_queries(["q", *[f"__constraint_slot__ {k}" for k in range(5)], "z"], 3) == ["q", "__constraint_slot__ 0", "__constraint_slot__ 1"]
    assert P.bounded_queries(["q", *rest], 1) == ["q"]


def test_columns(spark):
    df = spark.createDataFrame([(" Hel lo ", ""), ("你好", None), ("Hello there", " Explore "), ("你好", "brainstorm"), (None, "CHAT"), (None, None)], "q string, shape string")
    assert [r[0] for r in df.select(P.request_mode(F.col("q"), F.col("shape"))).collect()] == ["conversational", "conversational", "exploratory", "exploratory", "conversational", "factual"]
    df = spark.createDataFrame([("谁写了它，其别名是什么",), ("上述实体",), ("Is he there?",), (None,)], "q string")
    assert [r[0] for r in df.select(P.is_follow_up(F.col("q"))).collect()] == [True, True, False, False]
    got = spark.range(1).select(P.modality(F.lit("It MAY rain")), P.modality(F.lit("x")), P.negation(F.lit("从未")), P.negation(F.lit("cannot")), P.negation(F.lit(None).cast("string"))).first()
    assert got[:] == ("modal_or_conditional", "", "explicit_negation", "", "")
    ask = ["Please try your very best to recall x", "请你竭尽全力地回想", "he said: try your best to recall", "maximum", None]
    df = spark.createDataFrame([(i, q) for i, q in enumerate(ask)], "i int, q string")
    assert [r[0] for r in df.orderBy("i").select(V.wants_maximum(F.col("q"))).collect()] == [True, True, False, False, False]


def test_drafts(spark):
    rows = [(0, "” he left", []), (1, "She left", []), (2, "She left", ["Ann"]), (3, "他认为好", None), (4, "Sheila left", []), (5, None, [])]
    df = spark.createDataFrame(rows, "i int, t string, p array<string>")
    assert [r[0] for r in df.orderBy("i").select(I.self_containment(F.col("t"), F.col("p"))).collect()] == ["closing_fragment", "unbound_pronoun", None, "unbound_pronoun", None, None]
    rows = [(0, "未知发言者（推测是老师）说", ["???(可能是甲)"]), (1, "他向老师（???）说", ["老师（???）"]), (2, "a Bob([username]) b", None), (3, "plain", ["Bob"])]
    df = spark.createDataFrame(rows, "i int, t string, p array<string>").orderBy("i")
    assert [tuple(r) for r in df.select(I.unknown_speakers(F.col("t"), F.col("p")), I.known_participants(F.col("p"))).collect()] == [
        ("未知发言者说", ["???"]), ("他向???说", ["???"]), ("a [username] b", None), ("plain", ["Bob"]),
    ]


def test_growth_and_learning(spark):
    edges = spark.createDataFrame([(1, 1, 2, "因为"), (2, 1, 2, "可能因为"), (3, 2, 3, "x"), (4, 9, 1, None)], "id long, from_id long, to_id long, text string")
    nodes = spark.createDataFrame([(1, "reported"), (2, "observed"), (3, None)], "node long, epistemic_status string")
    assert sorted(r.id for r in I.growth_guard(edges, nodes).collect()) == [1, 4]
    good = dict(target=7, cancelled=False, answer_guard_passed=True, delivered=[7], contextual=[8], source_facts=["f"], verification_status="verified", verification_refs=["v"], context_query_id="c", need_query_id="n", slot_id="s", context_vector_ref="a", need_vector_ref="b", provenance=["p"], why="recovery")
    bad = [("request_cancelled", "cancelled", True), ("answer_guard_failed", "answer_guard_passed", None), ("target_not_delivered", "delivered", []), ("target_returned_by_contextual_expansion", "contextual", [7]), ("source_evidence_missing", "source_facts", []), ("verification_not_source_bound", "verification_status", "guessed"), ("verification_reference_missing", "verification_refs", None), ("query_or_slot_reference_missing", "slot_id", ""), ("vector_reference_missing", "need_vector_ref", ""), ("target_provenance_missing", "provenance", []), ("no_recovery_or_costly_reuse_reason", "why", None)]
    schema = "target long, cancelled boolean, answer_guard_passed boolean, delivered array<long>, contextual array<long>, source_facts array<string>, verification_status string, verification_refs array<string>, context_query_id string, need_query_id string, slot_id string, context_vector_ref string, need_vector_ref string, provenance array<string>, why string"
    rows = [good, *({**good, name: value} for _, name, value in bad)]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], schema)
    assert [r.reason for r in I.learning_rejection(df.coalesce(1)).collect()] == [None, *(b[0] for b in bad)]
