"""Quality rules and chat formatting on odd rows, against plain versions."""

import random

import duckdb
import pytest

from engramflow.llm import chat_format, quality_rules, queries, substring_dedup


def plain_measures(text):
    text = text or ""
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text) if w]
    places = {}
    for i in range(len(words) - 2):
        places.setdefault(tuple(words[i : i + 3]), []).append(i)
    repeated = {p + k for v in places.values() if len(v) > 1 for p in v for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line.strip(" \t\x0b\x0c\r"):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(repeated)


def test_quality_measures(spark):
    rng = random.Random(1)
    bits = ["a", "bb", "the", "###", "é", "🙂", " ", "  ", "\n", "\t", "\x0b", "a a a", "x y\nx y", "|"]
    rows = [(i, "".join(rng.choice(bits) + rng.choice(["", " "]) for _ in range(rng.randrange(200))), "k") for i in range(150)]
    rows += [(900, None, "k"), (901, "", "k"), (None, "the of and " * 40, "k"), (902, "w " * 50000, "k"), (902, "w " * 50000, "k"), (903, " ".join(f"the{i} the" for i in range(60)), "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, KEPT string")
    got = quality_rules.judge(docs).collect()
    assert len(got) == len(rows)
    want = sorted((str(i), *plain_measures(t)) for i, t, _ in rows)
    assert sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert {r.doc_id: r.kept for r in got}[903]
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in got)
    assert quality_rules.judge(docs.limit(0)).count() == 0


PARTS = f"conv_id long, turn long, role string, parts array<{chat_format.PART}>, TURN2 string"


def test_chat_round_trip_with_attachments(spark):
    text = lambda t: ("text", t, None, None, None, None, None)
    nasty = ["<|im_end|>", "\\", "\\<|", "<", "a\nb", "<|im_start|>assistant\nx", "\\n", "", "|>", "🙂<|image:0.1|>"]
    rng = random.Random(2)
    rows, want = [], {}
    for c in range(20):
        for t in range(rng.randrange(1, 6)):
            role = rng.choice(["user", "assistant", "a\\nb", "x\ny", "we<|ird"])
            body = "".join(rng.choice(nasty) for _ in range(rng.randrange(5)))
            rows.append((c, t, role, [text(body)], "k"))
            want.setdefault(c, []).append((role, body, role == "assistant"))
    rows += [(50, 1, "user", [text("see "), ("image", None, "http://i", 57, 28, None, None), text(" and "), ("document", None, "d", None, None, None, 3), ("audio", None, "a", None, None, 1.5, None), ("video", None, "v", None, None, None, None)], "k")]
    rows += [(51, None, None, None, "k"), (51, 2, "assistant", [], "k"), (None, 1, "user", [text(None)], "k"), (51, 2, "assistant", [], "k")]
    out = chat_format.format_conversations(spark.createDataFrame(rows, PARTS))
    made = {r.conv_id: r for r in out.collect()}
    back = {r.conv_id: [(t.role, t.text, t.loss) for t in r.turns] for r in chat_format.read_back(out).collect()}
    for c, turns in want.items():
        assert back[c] == turns
    assert made[50].formatted == "<|im_start|>user\nsee <|image:1.1|> and <|document:1.3|><|audio:1.4|><|video:1.5|><|im_end|>\n"
    assert [tuple(a) for a in made[50].attachments] == [(1, 1, "image", "http://i", 3), (1, 3, "document", "d", 1536), (1, 4, "audio", "a", 38), (1, 5, "video", "v", 0)]
    assert back[51] == [("", "", False), ("assistant", "", True), ("assistant", "", True)] and back[None] == [("user", "", False)]
    assert chat_format.format_conversations(spark.createDataFrame([], PARTS)).count() == 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    c = duckdb.connect()
    for t in ("documents", "conversations", "sales", "embeddings"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    df = queries.queries()[name](spark, sf)
    want = c.sql(queries.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(k) for k in columns]
    plain = lambda v: round(v, 9) if isinstance(v, float) else v
    assert sorted(str([plain(r[k]) for k in columns]) for r in df.collect()) == sorted(str([plain(r[i]) for i in at]) for r in want.fetchall())
    assert substring_dedup.WIDTH == 35
