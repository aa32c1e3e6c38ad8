import math
import random
import re

from engramflow.llm import decontaminate

SCHEMA = "doc_id long, text string, ITEM_ID string, edits int"


def normal(text):
    return " ".join(re.sub(r"[\W_]+", " ", (text or "").lower()).split())


def brute(text, item):
    """Least edits between the item and any part of the text."""
    row = list(range(len(item) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for j, d in enumerate(item, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[j - 1] + 1))
        row, best = new, min(best, new[-1])
    return best


def check(spark, rows, items):
    want = set()
    for d, t in rows:
        for i, x in items:
            m = len(normal(x))
            if 0 < m < 2 * decontaminate.Q and f" {normal(x)} " in f" {normal(t)} ":
                want.add((d, i, 0))
            if m >= 2 * decontaminate.Q and (e := brute(normal(t), normal(x))) <= decontaminate.budget(m)[0]:
                want.add((d, i, e))
    docs = spark.createDataFrame([(d, t, "k", 1) for d, t in rows], SCHEMA)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = [(r.doc_id, r.item_id, r.edits) for r in decontaminate.leaks(docs, bench).collect()]
    assert set(got) == want
    clean = decontaminate.keep_clean(docs, bench)
    assert clean.columns == docs.columns
    found = {d for d, _, _ in want}
    assert sorted(str(r.doc_id) for r in clean.collect()) == sorted(str(d) for d, _ in rows if d not in found)
    return want


def edited(rng, text, n):
    chars = list(text)
    for _ in range(n):
        at = rng.randrange(len(chars))
        kind = rng.randrange(3)
        chars[at : at + (kind != 0)] = [rng.choice("abcdefgh ")] * (kind != 1)
    return "".join(chars)


def test_against_brute_force(spark):
    rng = random.Random(8)
    words = ["the", "of", "tion", "über", "and", "ess", "in", "won", "Ñoz", "que"]
    text = lambda n: " ".join(rng.choice(words) + rng.choice(words) * rng.randrange(2) for _ in range(n))
    items = [(i, text(rng.randrange(4, 40))) for i in range(12)] + [(90, None), (91, "too short"), (92, ""), (93, "Short answer!"), (94, "Won"), (95, "too short"), (96, "?!")]
    rows = []
    for d in range(60):
        item = items[rng.randrange(12)][1]
        body = edited(rng, item, rng.randrange(0, 2 + len(item) // 8)) if d % 3 else ""
        rows.append((d, f"{text(rng.randrange(30))} {body.upper() if d % 2 else body.replace(' ', '!! ')} {text(rng.randrange(30))}"))
    rows += [(100, None), (101, ""), (None, items[0][1]), (102, items[1][1]), (102, items[1][1]), (103, "..." * 50 + items[2][1])]
    rows += [(104, "the short, answer is here"), (105, "short answers"), (106, "It is too short"), (107, "too short too short"), (108, "won"), (109, "wonder")]
    want = check(spark, rows, items)
    assert len(want) > 15


def test_long_texts_and_empty_tables(spark):
    rng = random.Random(9)
    index = decontaminate.Index([(7, "whoever finds this passage in a long text wins nothing")], decontaminate.Q, decontaminate.RATIO)
    filler = " ".join(rng.choice(["ab", "cd", "efg"]) for _ in range(3000))
    for at in range(0, 120, 7):
        assert list(index.find(filler[:at] + " whoever finds this passage in a long text wins nothing. " + filler, piece=64)) == [0]
    docs = spark.createDataFrame([], SCHEMA)
    assert decontaminate.leaks(docs, spark.createDataFrame([(1, "x" * 50)], "item_id long, text string")).count() == 0
    docs = spark.createDataFrame([(1, "x" * 50, "", 1)], SCHEMA)
    assert decontaminate.leaks(docs, spark.createDataFrame([], "item_id long, text string")).count() == 0
    assert decontaminate.keep_clean(docs, spark.createDataFrame([], "item_id long, text string")).count() == 1


def test_short_items_in_scripts_without_blanks():
    index = decontaminate.Index([(1, "北京大学"), (2, "カフェ"), (3, "한국"), (4, "cat")], decontaminate.Q, decontaminate.RATIO)
    found = lambda text: {index.ids[i]: hit for i, hit in index.find(text).items()}
    assert found("我在北京大学学习") == {1: (0, 6)}
    assert found("新しいカフェです。한국어") == {2: (0, 6), 3: (0, 11)}
    assert found("cats concat cat") == {4: (0, 15)} and found("一cat二") == {4: (0, 4)}


def test_exact_passages_of_the_tables(spark):
    d = "/root/testdata/sf0.01"
    docs = [(r.doc_id, normal(r.text)) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    items = [(r.item_id, normal(r.text)) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    exact = {(i, k) for i, t in docs for k, x in items if len(x) >= 16 and x in t}
    got = {(r.doc_id, r.item_id, r.edits) for r in decontaminate.query(spark, d).collect()}
    assert exact and exact == {(i, k) for i, k, e in got if e == 0}
    assert math.isclose(len(got), len(exact), rel_tol=0.5)
