import random
import struct

import sentencepiece as library

from engramflow.llm import sentencepiece as S

SCHEMA = "doc_id long, text string, IDS string, n_tokens int"


def as_unigram(data):
    """The same pieces as a unigram model of the library, with our log scores."""
    model = S.read_model(data)

    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    message = lambda number, body: varint(number << 3 | 2) + varint(len(body)) + body
    out = b""
    for piece, score, kind in zip(model["pieces"], S.log_scores(model), model["kinds"]):
        out += message(1, message(1, piece.encode()) + varint(2 << 3 | 5) + struct.pack("<f", score) + varint(3 << 3) + varint(kind))
    out += message(2, varint(3 << 3) + varint(1) + varint(35 << 3) + varint(1))
    for number, value in S._fields(data):
        if number == 3:
            out += message(3, value)
    return out


def data():
    with open(S.MODEL, "rb") as f:
        return f.read()


def test_same_segmentation_as_the_library(spark):
    raw = as_unigram(data())
    other = library.SentencePieceProcessor(model_proto=raw)
    ours = S.Tokenizer(S.read_model(raw))
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).collect()]
    texts += ["", " ", "  two  blanks ", "line\nbreak\n\n", "漢字かな交じり文 🙂🙂", "a" * 3000, "▁x", "\x00\x7f", "naïve Ünïcödé", "x́", "١٢٣"]
    ids, sizes = ours.encode(texts)
    at = 0
    scores = dict(enumerate(ours.scores))
    different = 0
    for text, n in zip(texts, sizes.tolist()):
        got, want = ids[at : at + n].tolist(), other.encode(text)
        at += n
        if got != want:  # only where sums of log scores tie within single precision
            different += 1
            assert abs(sum(scores[i] for i in got) - sum(scores[i] for i in want)) < 1e-2
        if "▁" not in text:
            assert ours.decode(got) == text == other.decode(got)
    assert different <= len(texts) // 10


def brute(tokenizer, pieces, text):
    """Best score by plain dynamic programming over the whole text, without units or trie."""
    text = tokenizer.normalise(text)
    best = [0.0] + [float("-inf")] * len(text)
    for i in range(len(text)):
        single = False
        for j in range(i + 1, min(len(text), i + 20) + 1):
            if text[i:j] in pieces:
                single |= j == i + 1
                best[j] = max(best[j], best[i] + pieces[text[i:j]])
        if not single:
            best[i + 1] = max(best[i + 1], best[i] + tokenizer.unknown_score)
    return best[-1]


def test_best_score():
    model = S.read_model(data())
    tokenizer = S.Tokenizer(model)
    pieces = {p: s for p, s, k in zip(model["pieces"], S.log_scores(model), model["kinds"]) if k == S.NORMAL}
    rng = random.Random(6)
    for _ in range(200):
        text = "".join(rng.choice(["the", " ", "  ", "tion", "é", "漢", "q", "Zx", "\n", "un", "able"]) for _ in range(rng.randrange(1, 25)))
        ids = tokenizer.encode([text])[0].tolist()
        got, run = 0.0, 0
        for i in ids:
            if i in set(tokenizer.bytes.tolist()):
                run += 1
                continue
            got += tokenizer.scores[i]
        unknown = sum(c not in pieces for c in tokenizer.normalise(text))
        assert abs(got + unknown * tokenizer.unknown_score - brute(tokenizer, pieces, text)) < 1e-6


def test_double_array():
    rng = random.Random(7)
    keys = sorted({bytes(rng.choice(b"ab\x00\xff") for _ in range(rng.randrange(1, 9))) for _ in range(400)})
    base, check, value = S.double_array(keys)
    for n, key in enumerate(keys):
        state = 0
        for c in key:
            after = base[state] + c + 1
            assert check[after] == state
            state = after
        assert value[state] == n


def test_rows(spark):
    rows = [(1, "hello world", "", 1), (2, None, None, None), (3, "", "", 1), (None, "hello world", "", 1), (1, "hello world", "", 1), (4, "x " * 20000, "", 1)]
    out = S.encode(spark.createDataFrame(rows, SCHEMA))
    got = out.collect()
    assert len(got) == 6 and all(r.round_trip for r in got)
    assert {r.doc_id: r.n_tokens for r in got}[2] == 0
    back = {r.doc_id: r.text for r in S.decode(out).collect()}
    assert back[1] == "hello world" and back[2] == "" and back[4] == "x " * 20000
    assert S.encode(spark.createDataFrame([], SCHEMA)).count() == 0
