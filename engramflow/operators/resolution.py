"""Concepts of a batch of drafts in their order, where an earlier draft's new concept or new alias catches later ones.

A name's owners, when a draft arrives, are those it had before the batch, the new concepts of earlier drafts that bear the name, and, if it had no owner,
the concept of the first draft that bore it. Of a name's owners only its state matters: none, one or several, and the same of the owners that are called by it.
A state changes four times at most, and few drafts change any.

So the sequence is cut into parts. A part goes through its drafts one after the other, given the states in which it finds its names, and says which states it
leaves changed. In each round all parts run at once on the states that follow from the last round's changes: a name's changes are followed in the order of parts, and one
that was made from another state than the name has by then is passed over, as its part has to run again. The first part is always right, any other once
those before it are; when a round finds the same states as the one before, all drafts are as one after the other would make them. As a part mostly
meets names that are settled, rounds follow the depth of changes that cause others, not the number of parts.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cutting import cut
from .numbering import number

#: Sequence numbers of a part.
PART = 1 << 14
#: The one owner of a name or that there are more, what the owner is called, and the same of the owners that are called by the name.
STATE = ("o", "o_more", "o_called", "x", "x_more", "x_called")
_STATE = "struct<o:bigint,o_more:boolean,o_called:string,x:bigint,x_more:boolean,x_called:string>"
_RAN = f"part long, seq long, c long, how string, added array<string>, name string, before {_STATE}, after {_STATE}"
_NONE = (None, False, None)


def _with(owner: tuple, c: int, called: str | None) -> tuple:
    """An owner half of a state (one, more, called) with another owner."""
    one, more, _ = owner
    return (c, False, called) if one is None and not more else owner if one == c or more else (None, True, None)


def _in_order(drafts: list[dict], states: dict[str, tuple], last: int) -> tuple[list[tuple], dict[str, tuple]]:
    """((seq, c, how, names it is added to) of drafts in order, the states that end otherwise than they were); a new concept is last + 1 + seq for the time being."""
    now, out = dict(states), []
    for d in sorted(drafts, key=lambda d: d["seq"]):
        own, names = d["own"], d["names"]
        seen = [now.get(n) or _NONE * 2 for n in names]
        exact = next((s[3:] for n, s in zip(names, seen) if n == own), _NONE)
        agreed = {s[0]: s[2] for s in seen if s[0] is not None}
        if exact[0] is not None:
            c, called, how = exact[0], exact[2], "name"
        elif len(agreed) == 1:
            (c, called), how = *agreed.items(), "alias"
        else:
            c, called, how = last + 1 + d["seq"], None, "new"
        added = []
        for n, s in zip(names, seen):
            if how == "new" or (s[0] is None and not s[1]):
                is_called = n == own if how == "new" else n == called
                now[n] = _with(s[:3], c, called) + (_with(s[3:], c, called) if is_called else s[3:])
                added.append(n)
        out.append((d["seq"], c, how, added))
    return out, {n: s for n, s in now.items() if s != states.get(n)}


def _run(last: int):
    def run(drafts: pa.Table, given: pa.Table) -> pa.Table:
        part = drafts.column("part")[0].as_py() if drafts.num_rows else None
        states = {r["name"]: tuple(r["state"][k] for k in STATE) for r in given.to_pylist() if r["state"] is not None}
        answers, changed = _in_order(drafts.to_pylist(), states, last)
        as_dict = lambda s: None if s is None else dict(zip(STATE, s))
        rows = [(part, seq, c, how, added, None, None, None) for seq, c, how, added in answers] + [(part, None, None, None, None, n, as_dict(states.get(n)), as_dict(s)) for n, s in changed.items()]
        kind = pa.struct([("o", pa.int64()), ("o_more", pa.bool_()), ("o_called", pa.string()), ("x", pa.int64()), ("x_more", pa.bool_()), ("x_called", pa.string())])
        types = {"part": pa.int64(), "seq": pa.int64(), "c": pa.int64(), "how": pa.string(), "added": pa.list_(pa.string()), "name": pa.string(), "before": kind, "after": kind}
        return pa.table({n: pa.array([r[k] for r in rows], t) for k, (n, t) in enumerate(types.items())})

    return run


def _found(changes: DataFrame | None, needs: DataFrame) -> DataFrame:
    """part, name, state: in which states parts find their names; needs: part, name, base; changes: part, name, before, after."""
    if changes is None:
        return needs.select("part", "name", F.col("base").alias("state"))
    told = changes.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("part", "before", "after"))).alias("told"))
    bases = needs.join(told.select("name"), "name", "left_semi").groupBy("name").agg(F.first("base").alias("base"))
    lines = f"array<struct<part:bigint,state:{_STATE}>>"
    start = F.struct(F.col("base").alias("state"), F.array().cast(lines).alias("line"))
    follow = lambda a, x: F.when(
        x["before"].eqNullSafe(a["state"]), F.struct(x["after"].alias("state"), F.concat(a["line"], F.array(F.struct(x["part"].alias("part"), x["after"].alias("state")))).alias("line"))
    ).otherwise(a)
    lined = told.join(bases, "name").select("name", F.aggregate("told", start, follow)["line"].alias("line"))
    before = F.filter("line", lambda x: x["part"] < F.col("part"))
    return needs.join(lined, "name", "left").select("part", "name", F.when(F.size(before) > 0, F.element_at(before, -1)["state"]).otherwise(F.col("base")).alias("state"))


def _state(c: Column, called: Column, exact: Column) -> Column:
    def half(c: Column, name: str) -> list[Column]:
        one = F.min(c) == F.max(c)
        return [F.when(one, F.min(c)).alias(name), F.coalesce(~one, F.lit(False)).alias(f"{name}_more"), F.when(one, F.max(F.when(c.isNotNull(), called))).alias(f"{name}_called")]

    return F.struct(*half(c, "o"), *half(F.when(exact, c), "x"))


def resolve_batch(drafts: DataFrame, concepts: DataFrame, aliases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """drafts: seq (unique, from 0), name, aliases (array); concepts: id, name, active, canonical_id (null: itself); aliases: id, alias; names all in normal form ->
    (seq, id, how: name, alias or new; alias, id: what is added to the aliases).

    A draft is the one active concept that is called by its name; else the one concept that its unambiguous names agree on; else
    a new concept, numbered on in the order of drafts. A new concept gets all its names, another those that nobody had. Empty and null names own nothing."""
    last = concepts.agg(F.max("id")).first()[0] or 0
    own = F.coalesce("name", F.lit(""))
    names = F.filter(F.array_distinct(F.concat(F.array(own), F.coalesce("aliases", F.array().cast("array<string>")))), lambda n: n != "")
    named = cut(drafts.select(F.expr(f"seq div {PART}").alias("part"), "seq", own.alias("own"), names.alias("names")))
    rows = concepts.select("id", F.col("name").alias("called"), "active", F.coalesce("canonical_id", "id").alias("c"))
    called = rows.where("active").select(F.col("id").alias("c"), F.col("called").alias("c_called"))
    owned = aliases.join(rows, "id").where("alias <> ''").join(called, "c", "left").withColumn("exact", F.col("active") & (F.col("called") == F.col("alias")))
    base = owned.groupBy(F.col("alias").alias("name")).agg(_state(F.col("c"), F.col("c_called"), F.col("exact")).alias("base"))
    needs = cut(named.select("part", F.explode("names").alias("name")).distinct().join(base, "name", "left").select("part", "name", F.col("base").cast(_STATE).alias("base")))
    given = changes = None
    while True:
        now = cut(_found(changes, needs))
        if given is not None and now.join(given.withColumnRenamed("state", "_was"), ["part", "name"]).where("NOT (state <=> _was)").isEmpty():
            break
        given = now
        ran = cut(named.groupBy("part").cogroup(given.groupBy("part")).applyInArrow(_run(last), _RAN))
        changes = ran.where("name IS NOT NULL").select("part", "name", "before", "after")
    answers = ran.where("seq IS NOT NULL").select("seq", "c", "how", "added")
    numbered = number(answers.where("how = 'new'").select("seq"), ["seq"], "new_id", last)
    keys = numbered.select((F.lit(last + 1) + F.col("seq")).alias("c"), "new_id")
    final = answers.join(numbered, "seq", "left").join(keys.withColumnRenamed("new_id", "_other"), "c", "left")
    final = cut(final.select("seq", F.coalesce("new_id", "_other", "c").alias("id"), "how", "added"))
    return final.select("seq", "id", "how"), final.select(F.explode("added").alias("alias"), "id")
