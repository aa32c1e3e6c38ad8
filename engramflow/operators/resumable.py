"""Spreading activation under a budget: stopped after so many expansions, and resumed later to the same result.

The state lies in a folder that all machines see: improvements of supports, one table for each call and none ever rewritten; what is still to be
expanded; and, written last, a manifest with the fingerprints of graph and request. A call expands the best of what is open, wave by wave, until the budget is used up or nothing is left. Supports
only rise and the largest product of conductances does not depend on the order of expansions, so any division into calls ends where one call does.

An expansion is one node of one root whose links are followed.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.stores import fingerprint
from .cutting import cut, swept
from .graph import better, conductances
from .numbering import number

COMPLETE, BUDGET = "complete", "expansion_budget"


class ResumableSpreading:
    """edges: association_id, from_id, to_id, weight, confidence, polarity; seeds: root, node, activation; floor: supports at or below it end a path."""

    def __init__(self, edges: DataFrame, seeds: DataFrame, folder: str, floor: float = 0.0):
        self.spark, self.folder, self.floor = edges.sparkSession, folder.rstrip("/"), float(floor)
        self.flow = conductances(edges)
        self.seeds = cut(seeds.where("activation > 0").groupBy("root", "node").agg(F.max("activation").cast("double").alias("support")))
        graph, request = fingerprint(self.flow).first()[0], fingerprint(self.seeds).first()[0]
        self.key = {"graph": graph, "request": request, "floor": self.floor}

    def _last(self) -> dict | None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/manifest")
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        done = [s.getPath() for s in files.listStatus(path)] if files.exists(path) else []
        calls = sorted(int(p.getName().split("=")[1]) for p in done if files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))
        if not calls:
            return None
        found = json.loads(self.spark.read.text(f"{self.folder}/manifest/call={calls[-1]}").first().value)
        for name in self.key:
            if found[name] != self.key[name]:
                raise ValueError(f"the {name} is not the one that this search began with")
        return found

    def _read(self, name: str, call: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}/call={call}")

    def _all(self, calls: int) -> DataFrame:
        out = self._read("supports", 0)
        for k in range(1, calls + 1):
            out = out.unionByName(self._read("supports", k))
        return out

    def run(self, budget: int | None = None) -> str:
        """Expand at most budget more (None: all); COMPLETE, or BUDGET if something is left. Raises ValueError if graph or request have changed."""
        last = self._last()
        call, expansions = (last["call"] + 1, last["expansions"]) if last else (0, 0)
        if last:
            pending = self._read("pending", call - 1)
            known = self._all(call - 1)
            gained = None
        else:
            pending = self.seeds
            known = gained = self.seeds
        used, left = 0, pending.count()
        while left and (budget is None or used < budget):
            wave, rest = pending, None
            if budget is not None and left > budget - used:
                placed = number(pending.withColumn("_s", -F.col("support")), ["_s", "root", "node"], "_k")
                wave, rest = placed.where(F.col("_k") <= budget - used).select(*pending.columns), placed.where(F.col("_k") > budget - used).select(*pending.columns)
            used += left if rest is None else budget - used
            gain = better(wave, self.flow, known, self.floor)
            known = known.unionByName(gain)
            gained = gain if gained is None else gained.unionByName(gain)
            pending = gain if rest is None else cut(rest.join(gain.select("root", "node"), ["root", "node"], "left_anti").unionByName(gain))
            left = pending.count()
        with swept(self.spark):
            (gained if gained is not None else known.limit(0)).write.mode("overwrite").parquet(f"{self.folder}/supports/call={call}")
            pending.write.mode("overwrite").parquet(f"{self.folder}/pending/call={call}")
        status = COMPLETE if not left else BUDGET
        note = json.dumps({**self.key, "call": call, "expansions": expansions + used, "pending": left, "status": status})
        self.spark.createDataFrame([(note,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.folder}/manifest/call={call}")
        return status

    def state(self) -> dict:
        """The last manifest: call, expansions so far, pending, status; empty before the first call."""
        return self._last() or {}

    def supports(self) -> DataFrame:
        """root, node, support as far as the search has come."""
        last = self._last()
        if not last:
            return self.seeds
        return self._all(last["call"]).groupBy("root", "node").agg(F.max("support").alias("support"))
