"""Evidence coverage, selection under budgets and counterfactuals, one request at a time."""

from __future__ import annotations

from itertools import combinations

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def coverage_state(supports: DataFrame, requirements: DataFrame) -> DataFrame:
    """supports: request, need, mode, clause, verified; requirements: request, need, mode (joint or alternative), clauses (array), required ->
    covered by need: alternative any, joint all of the clauses; only verified supports of the need's mode and clauses count."""
    held = supports.where("verified").groupBy("request", "need", "mode").agg(F.collect_set("clause").alias("held"))
    joined = requirements.join(held, ["request", "need", "mode"], "left").withColumn("held", F.array_sort(F.array_intersect("clauses", F.coalesce("held", F.array().cast("array<string>")))))
    covered = F.when(F.col("mode") == "joint", F.size(F.array_except("clauses", "held")) == 0).otherwise(F.size("held") > 0)
    return joined.withColumn("covered", covered)


def aggregate_contributions(contributions: DataFrame) -> DataFrame:
    """contributions: request, episode, route, need, relevance, tokens -> one row an episode with all routes and needs."""
    return contributions.groupBy("request", "episode").agg(F.array_sort(F.collect_set("route")).alias("routes"), F.array_sort(F.collect_set("need")).alias("needs"), F.max("relevance").alias("relevance"), F.max("tokens").alias("tokens"))


def mask(contributions: DataFrame, hidden: DataFrame) -> DataFrame:
    """contributions without those whose edge_id is hidden."""
    return contributions.join(hidden.select("edge_id"), "edge_id", "left_anti")


def masked_delta(treatment: DataFrame, masked: DataFrame) -> DataFrame:
    """request, needs of both sides -> gained, lost and verdict: what the treatment has more is gained, what it lacks is lost; harm dominates."""
    both = treatment.select("request", F.col("needs").alias("a")).join(masked.select("request", F.col("needs").alias("b")), "request", "full")
    none = F.array().cast("array<string>")
    a, b = F.coalesce("a", none), F.coalesce("b", none)
    out = both.select("request", F.array_except(a, b).alias("gained"), F.array_except(b, a).alias("lost"))
    return out.withColumn("verdict", F.when(F.size("lost") > 0, "harmful").when(F.size("gained") > 0, "sufficient").otherwise("no_op"))


def _each_request(rows: DataFrame, work, schema: pa.Schema, ddl: str) -> DataFrame:
    """work(rows of one request as dictionaries) -> dictionaries of the result; a task goes through its requests one after the other."""

    def run(batches):
        held, out = [], []
        for batch in batches:
            for r in batch.to_pylist():
                if held and held[-1]["request"] != r["request"]:
                    out += work(held)
                    held = []
                held.append(r)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
                out = []
        if held and (out := work(held)):
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return rows.repartition("request").sortWithinPartitions("request").mapInArrow(run, ddl)


_VALUED = pa.schema([("request", pa.int64()), ("id", pa.int64()), ("step", pa.int64()), ("value", pa.float64())])
_CHOSEN = pa.schema([("request", pa.int64()), ("chosen", pa.list_(pa.int64())), ("stop", pa.string()), ("covered", pa.int64())])


def select_v1(candidates: DataFrame) -> DataFrame:
    """candidates: request, id, required, optional, contextual (arrays of slots), direct, quality, redundancy, group -> request, id, step, value.

    value = 10 * new required + 2 * new optional + direct + .5 if a contextual slot is new + quality - .5 * (redundancy + 1 if the group is
    already there); ties: direct, then id. The best is taken out before the test that ends at 0 or less."""

    def run(rows: list[dict]) -> list[dict]:
        left, have, groups, out = list(rows), set(), set(), []
        while left:
            def value(c):
                new = set(c["required"]) - have
                optional = set(c["optional"]) - have
                near = 0.5 if set(c["contextual"]) - have else 0.0
                return 10 * len(new) + 2 * len(optional) + c["direct"] + near + c["quality"] - 0.5 * (c["redundancy"] + (c["group"] in groups))

            best = min(left, key=lambda c: (-value(c), -c["direct"], c["id"]))
            v = value(best)
            left.remove(best)
            if v <= 0:
                break
            out.append({"request": best["request"], "id": best["id"], "step": len(out) + 1, "value": float(v)})
            have |= set(best["required"]) | set(best["optional"]) | set(best["contextual"])
            groups.add(best["group"])
        return out

    return _each_request(candidates, run, _VALUED, "request long, id long, step long, value double")


def _complete(needs: dict, held: set) -> int:
    return sum(all((n, c) in held for c in cs) if joint else any((n, c) in held for c in cs) for n, (joint, cs) in needs.items())


def _parse(supports: list[dict]) -> tuple[list[dict], dict, dict]:
    required, optional = {}, {}
    rows = {}
    for r in supports:
        (required if r["required"] else optional)[r["need"]] = (r["joint"], list(r["clauses"]))
        if r["clause"] in list(r["clauses"]):
            c = rows.setdefault(r["episode"], {"id": r["episode"], "held": set(), "facts": 0, "tokens": 0, "relevance": 0.0})
            c["held"].add((r["need"], r["clause"]))
            c["facts"], c["tokens"], c["relevance"] = max(c["facts"], r["facts"]), max(c["tokens"], r["tokens"]), max(c["relevance"], r["relevance"])
    return sorted(rows.values(), key=lambda c: c["id"]), required, optional


def _greedy(rows: list[tuple], required: list[tuple], optional: list[tuple], episodes: int, facts: int, tokens: int) -> tuple[list, str, int]:
    """rows: id, bits of held clauses, facts, tokens, relevance; required, optional: joint, bits of the need's clauses -> chosen, stop, bits that they hold."""
    chosen, held, n_facts, n_tokens, left = [], 0, 0, 0, rows
    done = lambda needs, bits: sum(bits & m == m if joint else bits & m != 0 for joint, m in needs)
    together = 0
    for joint, m in required:
        together |= m if joint else 0
    while True:
        old, old_optional = done(required, held), done(optional, held)
        if old == len(required) and old_optional == len(optional):
            return chosen, "complete", held
        if len(chosen) == episodes:
            return chosen, "episode_budget", held
        if not left:
            return chosen, "exhausted", held
        best = rank = None
        for c in left:
            if n_facts + c[2] <= facts and n_tokens + c[3] <= tokens:
                new = held | c[1]
                value = (done(required, new) - old, (new & ~held & together).bit_count(), done(optional, new) - old_optional, -c[2], -c[3], c[4], -c[0])
                if rank is None or value > rank:
                    best, rank = c, value
        if best is None:
            return chosen, "budget", held
        if rank[:3] == (0, 0, 0):
            return chosen, "no_gain", held
        chosen.append(best[0])
        held |= best[1]
        n_facts, n_tokens = n_facts + best[2], n_tokens + best[3]
        left = [c for c in left if c is not best]


def select_v3(supports: DataFrame, episodes: int, facts: int, tokens: int) -> DataFrame:
    """supports: request, episode, need, clause, joint, clauses, required, facts, tokens, relevance -> request, chosen (in order), stop, covered. Without a column
    clauses a need has those of all its request's supports.

    Lexicographic greedy: new required needs, progress of joint ones, new optional needs, fewer facts, fewer tokens, relevance, smaller id; budgets of
    episodes, facts and tokens. Clauses are bits of a number, and rows are read by column."""
    names = ["request", "episode", "need", "clause", "joint", "required", "facts", "tokens", "relevance", *(["clauses"] if "clauses" in supports.columns else [])]

    def choose(request, own):
        bits, wanted, rows = {}, {}, {}
        for episode, need, clause, joint, required, n_facts, n_tokens, relevance, *rest in own:
            asked = rest[0] if rest else (clause,)
            code = 0
            for c in asked:
                bit = bits.setdefault((need, c), 1 << len(bits))
                code |= bit
            key = (required, need)
            wanted[key] = (joint, code if rest else code | wanted.get(key, (0, 0))[1])
            if clause in asked:
                r = rows.get(episode, (episode, 0, 0, 0, 0.0))
                rows[episode] = (episode, r[1] | bits[need, clause], max(r[2], n_facts), max(r[3], n_tokens), max(r[4], relevance))
        needs = [[w for (r, _), w in wanted.items() if bool(r) == kind] for kind in (True, False)]
        chosen, stop, held = _greedy(list(rows.values()), *needs, episodes, facts, tokens)
        return request, chosen, stop, sum(held & m == m if joint else held & m != 0 for joint, m in needs[0])

    def batch(out):
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), _CHOSEN)], schema=_CHOSEN)

    def run(batches):
        """The rows come sorted by request; a request may go on from batch to batch."""
        now, held, out = None, [], []
        for b in batches:
            if not b.num_rows:
                continue
            requests, *columns = [c.to_pylist() for c in b.columns]
            rows, at = list(zip(*columns)), 0
            for i in range(len(rows) + 1):
                if i == len(rows) or requests[i] != now:
                    held += rows[at:i]
                    at = i
                    if i < len(rows):
                        if held:
                            out.append(choose(now, held))
                        now, held = requests[i], []
            if out:
                yield batch(out)
                out = []
        if held:
            yield batch([choose(now, held)])

    return supports.select(*names).repartition("request").sortWithinPartitions("request").mapInArrow(run, "request long, chosen array<long>, stop string, covered long")


def select_exhaustive(supports: DataFrame, episodes: int, facts: int, tokens: int, most: int = 12) -> DataFrame:
    """The most required needs that any choice within the budgets covers; requests of more than most candidates have none."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, required, _ = _parse(pdf.to_dict("records"))
        best = None
        if len(rows) <= most:
            best = 0
            for n in range(1, min(episodes, len(rows)) + 1):
                for part in combinations(rows, n):
                    if sum(c["facts"] for c in part) <= facts and sum(c["tokens"] for c in part) <= tokens:
                        best = max(best, _complete(required, set().union(*[c["held"] for c in part])))
        return pd.DataFrame({"request": [pdf["request"].iloc[0]], "covered": pd.array([best], "Int64")})

    return supports.groupBy("request").applyInPandas(run, "request long, covered long")


def attribution(contributions: DataFrame, requirements: DataFrame) -> DataFrame:
    """contributions: request, edge_id (null: base), need; requirements: request, need -> request, edge_id, sufficient, necessary, needs: of every
    identified edge, what it adds to the base alone, and what is lost when only it is left out."""
    wanted = contributions.join(requirements.select("request", "need").distinct(), ["request", "need"], "left_semi").select("request", "edge_id", "need").distinct()
    base = wanted.where("edge_id IS NULL").select("request", "need").distinct()
    edges = wanted.where("edge_id IS NOT NULL")
    holders = wanted.groupBy("request", "need").agg(F.count(F.lit(1)).alias("holders"))
    alone = edges.join(base, ["request", "need"], "left_anti").join(holders, ["request", "need"])
    gains = alone.groupBy("request", "edge_id").agg(F.count(F.lit(1)).alias("gained"), F.count(F.when(F.col("holders") == 1, 1)).alias("lost_without"))
    return edges.groupBy("request", "edge_id").agg(F.count(F.lit(1)).alias("needs")).join(gains, ["request", "edge_id"], "left").select(
        "request", "edge_id", "needs", (F.coalesce("gained", F.lit(0)) > 0).alias("sufficient"), (F.coalesce("lost_without", F.lit(0)) > 0).alias("necessary")
    )
