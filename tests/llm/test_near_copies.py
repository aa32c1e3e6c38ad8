import random

import numpy as np

from engramflow.llm import near_copies

SCHEMA = "doc_id long, text string, component string, H int"


def plain(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or {tuple(words)}


def brute_components(texts):
    """{position: first position of its component}"""
    sets, top = [plain(t) for t in texts], list(range(len(texts)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                top[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(texts))]


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"n{rng.randrange(10**6)}"
    return words


def family(rng, n, length=120, edits=6):
    base = [f"w{rng.randrange(10**5)}" for _ in range(length)]
    return [" ".join(edited(rng, base, rng.randrange(edits))) for _ in range(n)]


def test_components_against_brute_force(spark, monkeypatch):
    rng = random.Random(1)
    texts = [t for _ in range(40) for t in family(rng, rng.randrange(1, 5))] + family(rng, 60) + family(rng, 20, 8, 3) + [None, "", " \n", "a b", "A  b", "a b c"]
    rng.shuffle(texts)
    rows = [(i, t, "", 1) for i, t in enumerate(texts)]
    want = {i: x for i, x in enumerate(brute_components(texts))}
    assert 40 < len(set(want.values())) < len(texts) - 40
    for block in (near_copies.BLOCK, 7):
        monkeypatch.setattr(near_copies, "BLOCK", block)
        firsts = {tuple((t or "").lower().split()): i for i, t in reversed(list(enumerate(texts)))}
        got = near_copies.near_copies(spark.createDataFrame(rows, SCHEMA)).collect()
        least = {}
        for r in sorted(got, key=lambda r: r.row.doc_id):
            least.setdefault(r.component, r.row.doc_id)
        assert {r.row.doc_id: least[r.component] for r in got} == {i: want[i] for i in firsts.values()}
    kept = near_copies.keep_one(spark.createDataFrame(rows, SCHEMA))
    assert kept.columns == ["doc_id", "text", "component", "H"]
    assert {r.doc_id for r in kept.collect()} == set(want.values())


def test_pairs_at_the_threshold_meet():
    shared = []
    for n in range(400):
        common = {b"c%d-%d" % (n, i) for i in range(200)}
        a, b = (near_copies.keys_of(common | {b"%s%d-%d" % (side, n, i) for i in range(25)}) for side in (b"a", b"b"))
        shared.append(int((a == b).sum()))
    bands = np.array(shared)
    assert bands.min() > 0
    assert 14 < bands.mean() < 20


def test_a_group_around_the_threshold_costs_a_pair_a_member(spark, monkeypatch):
    """Copies of one text with one to eight edits: those with three or fewer are linked to it, most pairs of the rest are alike and not linked."""
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**5)}" for _ in range(150)]
    texts = [" ".join(base)] + [" ".join(edited(rng, base, 1 + i % 8)) for i in range(400)]
    compared, verified = [], near_copies._verified
    monkeypatch.setattr(near_copies, "_verified", lambda pairs, found: compared.append(pairs.count()) or verified(pairs, found))
    got = near_copies.near_copies(spark.createDataFrame([(i, t, "", 1) for i, t in enumerate(texts)], SCHEMA)).collect()
    names: dict = {}
    for r in sorted(got, key=lambda r: r.row.doc_id):
        names.setdefault(r.component, r.row.doc_id)
    assert {r.row.doc_id: names[r.component] for r in got} == dict(enumerate(brute_components(texts)))
    assert sum(compared) < 4 * len(texts)


def test_odd_rows(spark):
    rows = [(1, "one two three", "", 1), (1, "four five six", "", 1), (1, "four five six", "", 1), (None, "ONE two three", "", 1), (None, "seven", "", 1), (None, "seven", "", 1), (2, None, "", 1), (3, "", "", 1)]
    got = near_copies.keep_one(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in got) == [("1", "four five six"), ("1", "one two three"), ("2", "None"), ("None", "seven")]
    assert near_copies.keep_one(spark.createDataFrame([], SCHEMA)).count() == 0


def test_stage_links_what_two_bits_do_not(spark):
    import corpus_pipeline

    docs = corpus_pipeline.quality(spark, spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), "")
    rows = sorted(docs.collect(), key=lambda r: r.doc_id)
    top = brute_components([r.text for r in rows])
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()} == {rows[i].doc_id for i in set(top)}


def test_parities_bound_what_differs():
    rng = random.Random(7)
    tight = []
    for _ in range(300):
        n = rng.choice([3, 20, 60, 64, 65, 130, 500])
        common = [b"c%d" % rng.randrange(10**9) for _ in range(n)]
        a, b = (set(common + [b"x%d" % rng.randrange(10**9) for _ in range(rng.randrange(n // 4 + 2))]) for _ in "ab")
        others = [set(common[: max(1, n // 2)]), b]
        low = near_copies._Bits([near_copies.parities(x) for x in others]).apart(near_copies.parities(a), np.array([0, 1]))
        for x, least in zip(others, low):
            assert least <= len(a ^ x)
        alone = near_copies._Bits([near_copies.parities(b)]).apart(near_copies.parities(a), np.array([0]))[0]
        assert alone <= len(a ^ b)
        tight.append(alone / max(1, len(a ^ b)))
        if near_copies.linked(a, b):
            assert 9 * alone <= len(a) + len(b)
    assert np.mean(tight) > 0.85


def test_a_group_of_unlinked_copies_is_not_read_pair_by_pair(spark, monkeypatch):
    """Copies with five to nine edits each of a text that is not there: within the bound of counts of each other, hardly any linked; the last round reads few of their pairs."""
    rng = random.Random(8)
    base = [f"w{rng.randrange(10**5)}" for _ in range(300)]
    spots = [rng.sample(range(0, 300, 7), 30) for _ in range(20)]
    texts = []
    for i in range(240):  # edits of a few patterns, so that few shingles are a copy's own
        words = list(base)
        for at in rng.sample(spots[i % 20], 10 + i % 5):
            words[at] = f"v{at}-{rng.randrange(3)}"
        texts.append(" ".join(words))
    compared, verified = [], near_copies._verified
    monkeypatch.setattr(near_copies, "_verified", lambda pairs, found: compared.append(pairs.count()) or verified(pairs, found))
    got = near_copies.near_copies(spark.createDataFrame([(i, t, "", 1) for i, t in enumerate(texts)], SCHEMA)).collect()
    names: dict = {}
    for r in sorted(got, key=lambda r: r.row.doc_id):
        names.setdefault(r.component, r.row.doc_id)
    assert {r.row.doc_id: names[r.component] for r in got} == dict(enumerate(brute_components(texts)))
    assert compared[-1] < len(texts)
