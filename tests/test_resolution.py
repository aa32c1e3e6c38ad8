"""A batch of concept drafts against resolving them one after the other."""

import random

import pytest

from engramflow.operators import resolution as R


def plain(drafts, concepts, aliases):
    rows = {i: (name, active, canonical or i) for i, name, active, canonical in concepts}
    owners = {}
    for i, a in aliases:
        if a and i in rows:
            owners.setdefault(a, set()).add((rows[i][2], rows[i][1] and rows[i][0] == a))
    last, out, added = max(rows, default=0), [], []
    for seq, name, more in sorted(drafts):
        name, names = name or "", list(dict.fromkeys([name or "", *(more or [])]))
        exact = {c for c, e in owners.get(name, ()) if e}
        sets = [{c for c, _ in owners.get(n, ())} for n in names]
        unique, matched = {c for s in sets if len(s) == 1 for c in s}, {c for s in sets for c in s}
        found = next(iter(exact)) if len(exact) == 1 else next(iter(unique)) if len(unique) == 1 else next(iter(matched)) if len(matched) == 1 else None
        how = "name" if len(exact) == 1 else "alias" if found is not None else "new"
        if found is None:
            last += 1
            found = last
            rows[found] = (name, True, found)
        for n in names:
            if n and (how == "new" or not owners.get(n)):
                owners.setdefault(n, set()).add((found, rows[found][1] and rows[found][0] == n))
                added.append((n, found))
        out.append((seq, found, how))
    return out, sorted(added)


@pytest.mark.parametrize("seed, part, names", [(1, 1 << 16, 30), (2, 5, 12), (3, 7, 60)])
def test_one_after_the_other(spark, monkeypatch, seed, part, names):
    monkeypatch.setattr(R, "PART", part)
    rng = random.Random(seed)
    word = lambda: f"n{int(names * rng.random() ** 2)}"
    concepts = [(10 * k, word(), rng.random() < 0.8, rng.choice([None, None, 10])) for k in range(1, 7)]
    aliases = [(i, n) for i, n, *_ in concepts if rng.random() < 0.8] + [(10 * rng.randrange(1, 7), word()) for _ in range(6)] + [(10, "")]
    drafts = [(k, rng.choice([word(), word(), word(), "", None]), rng.choice([None, [], [word()], [word(), word(), ""]])) for k in range(90)]
    rng.shuffle(drafts)
    found, added = R.resolve_batch(
        spark.createDataFrame(drafts, "seq long, name string, aliases array<string>"),
        spark.createDataFrame(concepts, "id long, name string, active boolean, canonical_id long"),
        spark.createDataFrame(aliases, "id long, alias string"),
    )
    want, more = plain(drafts, concepts, aliases)
    assert sorted(map(tuple, found.collect())) == want
    assert sorted(map(tuple, added.collect())) == more
    assert {h for *_, h in want} == {"name", "alias", "new"}


def test_nothing(spark):
    empty = lambda s: spark.createDataFrame([], s)
    found, added = R.resolve_batch(empty("seq long, name string, aliases array<string>"), empty("id long, name string, active boolean, canonical_id long"), empty("id long, alias string"))
    assert found.count() == 0 and added.count() == 0


def test_rounds_do_not_follow_chains(spark, monkeypatch):
    """Every draft comes to the concept of the one before it, and many parts meet the same names."""
    cuts = []
    monkeypatch.setattr(R, "cut", lambda df, real=R.cut: cuts.append(1) or real(df))
    concepts, aliases = [(5, "old", True, None)], [(5, "old")]
    for part, drafts in ((1 << 14, [(k, f"n{k}", [f"n{k + 1}"]) for k in range(40)]), (4, [(k, f"n{k % 5}", [f"m{k % 7}"]) for k in range(80)])):
        monkeypatch.setattr(R, "PART", part)
        cuts.clear()
        found, _ = R.resolve_batch(spark.createDataFrame(drafts, "seq long, name string, aliases array<string>"), spark.createDataFrame(concepts, "id long, name string, active boolean, canonical_id long"), spark.createDataFrame(aliases, "id long, alias string"))
        assert sorted(map(tuple, found.collect())) == plain(drafts, concepts, aliases)[0]
        assert len(cuts) <= 20
