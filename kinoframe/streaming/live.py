"""Live relations: gating, GOP replay and counters over Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from kinoframe.scratch import shared_path


def drained(stream: DataFrame, mode: str, name: str, schema: str, per_batch: bool = True, store: dict[str, str] | None = None) -> DataFrame:
    """Runs a streaming DataFrame over all that is there, and what it wrote as a table.

    Batches write their own folders, so that a batch that is repeated replaces itself; in complete mode the last counts.
    """
    spark = stream.sparkSession
    out, place = shared_path(spark, name), shared_path(spark, f"{name}-stream")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number if per_batch else 0}")

    before = {k: spark.conf.get(k, None) for k in store or {}}
    for k, v in (store or {}).items():
        spark.conf.set(k, v)
    try:
        stream.writeStream.outputMode(mode).option("checkpointLocation", place).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    return spark.read.schema(f"{schema}, batch int").parquet(out).drop("batch")


def gated(packets: DataFrame) -> DataFrame:
    """Packets of a stream from its first key packet on. State: whether a key packet has been seen."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = state.exists and bool(state.get[0])
        rows = pd.concat(list(batches)).sort_values("seq")
        keep = rows["is_key"].cummax() | seen
        state.update((bool(seen or rows["is_key"].any()),))
        yield rows.loc[keep, ["stream_index", "seq"]]

    return packets.groupBy("stream_index").applyInPandasWithState(step, "stream_index long, seq long", "seen boolean", "append", GroupStateTimeout.NoTimeout)


#: State of the cache lives in RocksDB, which keyed lists and timers need.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
CACHED = "stream_index long, groups long, packets long, bytes long, first_seq long"


class GopCache(StatefulProcessor):
    """The last groups of a stream's packets and the open one, within bounds.

    State: a list of closed groups and one of the open one's packets, so that packets are appended and nothing is written again
    but when a group closes. A stream that is idle for ``idle_ms`` is forgotten.
    """

    def __init__(self, groups: int, frames: int, size: int, idle_ms: int | None):
        self.most, self.frames, self.size, self.idle = groups, frames, size, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.closed = handle.getListState("closed", "seqs array<bigint>, sizes array<bigint>")
        self.open = handle.getListState("open", "seq bigint, size bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        closed = [tuple(map(list, g)) for g in self.closed.get()]
        open_ = [tuple(p) for p in self.open.get()]
        held, shut = len(open_), False
        total = sum(n for _, n in open_)
        for r in pd.concat(list(rows)).sort_values("seq").itertuples():
            if not self.most:
                continue
            if r.is_key and open_:
                closed = [*closed, ([q for q, _ in open_], [n for _, n in open_])][-self.most :]
                open_, total, held, shut = [], 0, -1, True
            open_.append((int(r.seq), int(r.size)))
            total += int(r.size)
            if len(open_) > self.frames or total > self.size:
                open_, total, held = [], 0, -1
        if shut:
            self.closed.put(closed)
        if held < 0 or not open_:
            self.open.put(open_) if open_ else self.open.clear()
        elif len(open_) > held:
            self.open.appendList(open_[held:])
        if self.idle is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle)
        packets = [(q, n) for qs, ns in closed for q, n in zip(qs, ns)] + open_
        yield pd.DataFrame({"stream_index": [key[0]], "groups": [len(closed) + bool(open_)], "packets": [len(packets)], "bytes": [sum(n for _, n in packets)], "first_seq": pd.array([packets[0][0] if packets else None], dtype="Int64")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.closed.clear()
        self.open.clear()
        yield pd.DataFrame({"stream_index": [key[0]], "groups": [0], "packets": [0], "bytes": [0], "first_seq": pd.array([None], dtype="Int64")})

    def close(self) -> None:
        pass


def gop_cache(packets: DataFrame, groups: int, frames: int = 4096, size: int = 64 << 20, idle_ms: int | None = None) -> DataFrame:
    """What a late watcher would be sent of each stream after each batch: its last ``groups`` closed groups and the open one.

    A key packet closes the open group unless that is empty. A packet that takes the open group past ``frames`` packets or
    ``size`` bytes clears it, itself with it, so that a stream without key packets stays within bounds.
    """
    mode = "ProcessingTime" if idle_ms is not None else "None"
    return packets.groupBy("stream_index").transformWithStateInPandas(GopCache(groups, frames, size, idle_ms), CACHED, "Update", mode)


def windows(events: DataFrame, width: str, late: str) -> DataFrame:
    """Events of each type in event-time windows, with a watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def idle_sessions(events: DataFrame, key: str, gap: str) -> DataFrame:
    """Connections of a key: runs of events with less than ``gap`` between them."""
    return events.groupBy(key, F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last")).drop("w")
