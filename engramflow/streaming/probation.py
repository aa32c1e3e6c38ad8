"""Edges on probation: state kept by edge, expiry by timers of event time.

Events (id, ts, seq, kind, query_hash) are ``created``, ``success``, ``harm`` or ``noop``. The first ``created`` puts an edge on probation for a time; so many successes of
different queries before it is over make it active for good; else it is retired when the time comes, and nothing brings it back. Until then its
utility rises by successes (w + .2 (1 - w)), halves by harm and fades by the rest (w * .98); a query counts once, as far as the memory goes.

``lifecycle`` says what tables of events come to; ``live`` keeps the same as a stream: events wait in the state until the watermark has passed them, so that
they are applied in the order of (ts, seq) however they arrive; what comes later than the watermark allows is left out by Spark.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.learning import MEMORY, _fold, counted_once
from ..operators.numbering import number

#: Seconds on probation, and successes of different queries that end it.
TTL, SUCCESSES = 2_592_000, 2
#: Seconds for which a retired edge is remembered by a stream, so that late events do not create it anew.
REMEMBERED = 2_592_000
RESULT = "id long, lifecycle string, since timestamp, weight double, events long"


def lifecycle(events: DataFrame, as_of: str, ttl: int = TTL, successes: int = SUCCESSES, memory: int = MEMORY) -> DataFrame:
    """id, lifecycle (probation, active or retired), since (when that began), weight, events (that counted) of every edge created by as_of."""
    rows = number(events.where(F.col("ts") <= F.lit(as_of).cast("timestamp")).withColumnRenamed("seq", "_seq"), ["ts", "_seq", "id"], "seq")
    born = rows.where("kind = 'created'").groupBy("id").agg(F.min("seq").alias("_first"), F.min("ts").alias("born"))
    born = born.withColumn("ends", (F.col("born").cast("double") + F.lit(float(ttl))).cast("timestamp"))
    later = rows.where("kind <> 'created'").join(born, "id").where("seq > _first")
    once = counted_once(later.select("id", "seq", "ts", "kind", "query_hash", "ends"), memory)
    proofs = once.where("kind = 'success' AND query_hash <> '' AND ts < ends")
    nth = proofs.withColumn("_n", F.row_number().over(Window.partitionBy("id").orderBy("seq"))).where(F.col("_n") == successes).select("id", F.col("ts").alias("proved"))
    counted = once.join(nth, "id", "left").where("proved IS NOT NULL OR ts < ends")
    a = F.when(F.col("kind") == "success", 0.8).when(F.col("kind") == "harm", 0.5).otherwise(0.98)
    folded = _fold(counted, a, F.when(F.col("kind") == "success", 0.2).otherwise(0.0), F.lit(0.0))
    over = F.col("ends") <= F.lit(as_of).cast("timestamp")
    out = born.join(nth, "id", "left").join(folded, "id", "left")
    state = F.when(F.col("proved").isNotNull(), "active").when(over, "retired").otherwise("probation")
    since = F.coalesce("proved", F.when(over, F.col("ends")), "born")
    return out.select("id", state.alias("lifecycle"), since.alias("since"), F.coalesce("weight", F.lit(0.0)).alias("weight"), F.coalesce("events", F.lit(0)).cast("long").alias("events"))


class Probation(StatefulProcessor):
    """The state of an edge: what it is, and events that the watermark has not passed."""

    def __init__(self, ttl: int = TTL, successes: int = SUCCESSES, memory: int = MEMORY, remembered: int = REMEMBERED):
        self.ttl, self.successes, self.memory, self.remembered = ttl * 1000, successes, memory, remembered * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.edge = handle.getValueState("edge", "lifecycle string, born long, since long, weight double, events long, proofs int, seen string")
        self.waiting = handle.getListState("waiting", "us long, seq long, kind string, query_hash string")

    def _rows(self, key, edge) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"id": [key[0]], "lifecycle": [edge["lifecycle"]], "since": [pd.Timestamp(edge["since"], unit="us")], "weight": [edge["weight"]], "events": [edge["events"]]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        edge = self.edge.get() if self.edge.exists() else None
        if edge is not None and edge[0] == "retired":
            return
        found = []
        for part in rows:
            us = part["ts"].astype("datetime64[us]").astype("int64")
            found += [(int(t), int(s), str(k), None if pd.isna(h) else str(h)) for t, s, k, h in zip(us, part["seq"], part["kind"], part["query_hash"])]
        if found:
            self.waiting.appendList(found)
            for at in {t // 1000 + 1 for t, *_ in found}:
                self.handle.registerTimer(at)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        kept = self.edge.get() if self.edge.exists() else None
        names = ("lifecycle", "born", "since", "weight", "events", "proofs", "seen")
        edge = dict(zip(names, kept)) if kept is not None else None
        if edge is not None and edge["lifecycle"] == "retired":
            if edge["since"] + self.remembered * 1000 <= passed:
                self.edge.clear()
            return
        waiting = sorted(tuple(r) for r in self.waiting.get()) if self.waiting.exists() else []
        ready, before = [r for r in waiting if r[0] < passed], dict(edge) if edge else None
        for us, _, kind, query in ready:
            if edge is not None and edge["lifecycle"] == "probation" and us >= edge["born"] + self.ttl * 1000:
                break
            if kind == "created":
                if edge is None:
                    edge = dict(zip(names, ("probation", us, us, 0.0, 0, 0, "[]")))
                    self.handle.registerTimer((us + self.ttl * 1000) // 1000 + 1)
                continue
            if edge is None:
                continue
            seen = json.loads(edge["seen"])
            if query and query in seen:
                continue
            if query:
                edge["seen"] = json.dumps([*seen, query][-self.memory :])
            w = edge["weight"]
            edge["weight"] = w * 0.8 + 0.2 if kind == "success" else w * 0.5 if kind == "harm" else w * 0.98
            edge["events"] += 1
            if kind == "success" and query:
                edge["proofs"] += 1
                if edge["proofs"] == self.successes and edge["lifecycle"] == "probation":
                    edge["lifecycle"], edge["since"] = "active", us
        if edge is not None and edge["lifecycle"] == "probation" and edge["born"] + self.ttl * 1000 < passed:
            edge["lifecycle"], edge["since"] = "retired", edge["born"] + self.ttl * 1000
            self.waiting.clear()
            self.handle.registerTimer(edge["since"] // 1000 + self.remembered + 1)
        elif ready:
            left = [r for r in waiting if r[0] >= passed]
            if left:
                self.waiting.put(left)
            else:
                self.waiting.clear()
        if edge is not None and edge != before:
            self.edge.update(tuple(edge[n] for n in names))
            yield from self._rows(key, edge)

    def close(self) -> None:
        pass


def live(events: DataFrame, late: str = "1 hour", **settings) -> DataFrame:
    """A stream of events -> RESULT whenever an edge changes. The session's state store must be RocksDB (see state_store)."""
    waiting = events.withWatermark("ts", late)
    return waiting.groupBy("id").transformWithStateInPandas(Probation(**settings), RESULT, "update", "eventTime")


def state_store(spark) -> None:
    """Timers need a state store that keeps order."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
