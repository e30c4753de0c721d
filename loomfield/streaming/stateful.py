"""Stateful stream operator: first-seen content and running tension of each document, both for a time to live.

State is keyed by (document, shard), the shard being the content hash modulo `shards`,
so one document that is a third of the stream is still many keys.  A key holds

  seen   content hash -> when it was first seen and its cti, an entry of the state
         store each, so nothing of unbounded size is read or written at once
  sums   chunks, scored chunks, sum and maximum of cti over what `seen` holds

Time is event time.  Content is new if `seen` doesn't hold it; once the watermark
has passed its first sight by `ttl`, it is forgotten and its cti leaves the sums.
Repeats do not prolong it.  Rows later than the watermark are dropped by Spark.

Needs the RocksDB state store (`STORE`).  A restart goes on from the checkpoint.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Setting and value that the session of such a stream needs.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

OUT = "document_id string, shard int, kind string, content_hash string, chunk_index long, cti double, arrived timestamp, chunks long, scored long, sum_cti double, max_cti double"
_COLUMNS = [c.split()[0] for c in OUT.split(", ")]


def _number(x: float | None) -> float | None:
    return None if x is None or math.isnan(x) else float(x)


def _millis(at: datetime) -> int:
    return round(at.replace(tzinfo=at.tzinfo or timezone.utc).timestamp() * 1000)


class FirstSeen(StatefulProcessor):
    def __init__(self, ttl: timedelta):
        self.ttl = round(ttl.total_seconds() * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getMapState("seen", "content_hash string", "at long, cti double")
        self.sums = handle.getValueState("sums", "chunks long, scored long, sum_cti double, max_cti double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        chunks, scored, total, most = self.sums.get() if self.sums.exists() else (0, 0, 0.0, None)
        soonest, changed = None, False
        for pdf in rows:
            fresh = []
            for content, index, cti, arrived in pdf.sort_values(["arrived", "chunk_index"], kind="stable")[["content_hash", "chunk_index", "cti", "arrived"]].itertuples(index=False):
                if self.seen.containsKey((content,)):
                    continue
                cti, at = _number(cti), _millis(arrived.to_pydatetime())
                self.seen.updateValue((content,), (at, cti))
                chunks, changed = chunks + 1, True
                if cti is not None:
                    scored, total, most = scored + 1, total + cti, cti if most is None else max(most, cti)
                soonest = at if soonest is None else min(soonest, at)
                fresh.append((key[0], key[1], "chunk", content, index, cti, arrived, None, None, None, None))
            if fresh:
                yield pd.DataFrame(fresh, columns=_COLUMNS)
        if changed:
            self.sums.update((chunks, scored, total, most))
            self._wake(soonest + self.ttl)
            yield self._told(key, chunks, scored, total, most)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        gone, live, soonest = [], [], None
        for (content,), (at, cti) in self.seen.iterator():
            if at + self.ttl <= now:
                gone.append(content)
            else:
                live.append(_number(cti))
                soonest = at if soonest is None else min(soonest, at)
        for content in gone:
            self.seen.removeKey((content,))
        if soonest is not None:
            self._wake(soonest + self.ttl)
        if gone:
            known = [c for c in live if c is not None]
            sums = len(live), len(known), math.fsum(known), max(known, default=None)
            self.sums.update(sums) if live else self.sums.clear()
            yield self._told(key, *sums)

    def _wake(self, at: int) -> None:
        """One timer a key: the first entry that ends."""
        timers = [t for batch in self.handle.listTimers() for t in (batch if isinstance(batch, list) else [batch])]
        if any(t <= at for t in timers):
            return
        for t in timers:
            self.handle.deleteTimer(t)
        self.handle.registerTimer(at)

    def _told(self, key, chunks: int, scored: int, total: float, most: float | None) -> pd.DataFrame:
        return pd.DataFrame([(key[0], key[1], "sums", None, None, None, None, chunks, scored, total, most)], columns=_COLUMNS)

    def close(self) -> None:
        pass


def first_seen(units: DataFrame, ttl: timedelta = timedelta(hours=24), late: str = "1 hour", shards: int = 64) -> DataFrame:
    """units(document_id, chunk_index, content_hash, cti, arrived), streaming -> rows of two kinds.

    `chunk`: content that is new to its document, once.  `sums`: what a shard holds now, whenever that changes; the last
    of each shard add up (`running`).  Rows without a content_hash or time are left out; a null document is one.  Of rows
    that repeat a content in one Arrow batch the first by time and chunk_index is new.
    """
    keyed = units.where("content_hash IS NOT NULL AND arrived IS NOT NULL").withWatermark("arrived", late)
    keyed = keyed.select("document_id", F.pmod(F.xxhash64("content_hash"), F.lit(shards)).cast("int").alias("shard"), "content_hash", F.col("chunk_index").cast("long").alias("chunk_index"), F.col("cti").cast("double").alias("cti"), "arrived")
    return keyed.groupBy("document_id", "shard").transformWithStateInPandas(FirstSeen(ttl), OUT, "Update", "EventTime")


def running(told: DataFrame, order: str = "batch") -> DataFrame:
    """Running tension of each document from the last `sums` of its shards, by the column `order`: chunks, avg_cti, max_cti."""
    last = told.where("kind = 'sums'").groupBy("document_id", "shard").agg(F.max_by(F.struct("chunks", "scored", "sum_cti", "max_cti"), order).alias("s"))
    per = last.groupBy("document_id").agg(F.sum("s.chunks").alias("chunks"), (F.sum("s.sum_cti") / F.nullif(F.sum("s.scored"), F.lit(0))).alias("avg_cti"), F.max("s.max_cti").alias("max_cti"))
    return per.where("chunks > 0")
