"""Fan-out of published media to watchers: gating, configuration epochs, late joins and replay.

``packets``: channel, seq, kind ('video' or 'audio'), is_key, is_header, size, and for headers a ``digest`` of their body.
``watchers``: channel, watcher, join_seq (the packet before which the watcher joined).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes a replay may hold.
REPLAY_BUDGET = 1 << 20


def upto(*keys: str):
    return Window.partitionBy(*keys).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)


def config_epochs(packets: DataFrame) -> DataFrame:
    """Packets with ``epoch``: how many times a header of the channel's kind has changed so far.

    The first header of a kind begins no epoch, nor does the same header sent again.
    """
    own = Window.partitionBy("channel", "kind", "is_header").orderBy("seq")
    changed = F.col("is_header") & F.lag("digest").over(own).isNotNull() & (F.lag("digest").over(own) != F.col("digest"))
    return packets.withColumn("_changed", changed.cast("int")).withColumn("epoch", F.sum("_changed").over(upto("channel"))).drop("_changed")


def group_ids(packets: DataFrame) -> DataFrame:
    """Packets with ``gop_id`` within their epoch: a key picture opens a group unless the open one is empty."""
    w = Window.partitionBy("channel", "epoch").orderBy("seq")
    opens = F.col("is_key") & (F.row_number().over(w) > 1)
    return packets.withColumn("_opens", opens.cast("int")).withColumn("gop_id", F.sum("_opens").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_opens")


def wanted(kind: Column, seen_key: Column, is_key: Column, is_header: Column, audio_only: Column) -> Column:
    """Whether a watcher is sent a packet: headers always, video from a key picture on, audio after one or without video."""
    return is_header | seen_key | F.when(kind == "video", is_key).otherwise(audio_only)


def delivered(packets: DataFrame, watchers: DataFrame) -> DataFrame:
    """(channel, watcher, seq) of the live packets that each watcher is sent after joining.

    A watcher's gate opens at the first key picture at or after its join, so the join needs that one number a watcher;
    packets meet watchers by an equality on the channel, which adaptive execution may broadcast or split.
    """
    keys = packets.where("is_key and kind = 'video'").select("channel", F.col("seq").alias("key_seq"))
    gate = watchers.join(keys, "channel", "left").groupBy("channel", "watcher", "join_seq").agg(F.min(F.when(F.col("key_seq") >= F.col("join_seq"), F.col("key_seq"))).alias("gate_seq"))
    video = packets.groupBy("channel").agg((F.count_if(F.col("kind") == "video") == 0).alias("audio_only"))
    rows = packets.join(gate.join(video, "channel"), "channel").where("seq >= join_seq")
    seen = F.coalesce(F.col("seq") > F.col("gate_seq"), F.lit(False))
    return rows.where(wanted(F.col("kind"), seen, F.col("is_key"), F.col("is_header"), F.col("audio_only"))).select("channel", "watcher", "seq")


def replayed(packets: DataFrame, watchers: DataFrame, budget: int = REPLAY_BUDGET, keep: int = 8) -> DataFrame:
    """(channel, watcher, seq) of the cached packets that a watcher is sent when it joins.

    Of the groups cached at that time (those of the current epoch, the last ``keep``), the longest run of whole groups at
    the end whose bytes stay within ``budget``; a leading group without a key picture gives its audio only.
    """
    grouped = group_ids(config_epochs(packets))
    rows = grouped.join(watchers, "channel").where("seq < join_seq")
    last = rows.groupBy("channel", "watcher").agg(F.max("epoch").alias("now"))
    rows = rows.join(last, ["channel", "watcher"]).where("epoch = now and not is_header")
    groups = rows.groupBy("channel", "watcher", "gop_id").agg(F.sum("size").alias("bytes"), F.bool_or("is_key").alias("keyed"))
    back = Window.partitionBy("channel", "watcher").orderBy(F.col("gop_id").desc())
    groups = groups.withColumn("_bytes", F.sum("bytes").over(back.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_n", F.row_number().over(back))
    kept = groups.where((F.col("_bytes") <= budget) & (F.col("_n") <= keep)).select("channel", "watcher", "gop_id", "keyed")
    return rows.join(kept, ["channel", "watcher", "gop_id"]).where("keyed or kind = 'audio'").select("channel", "watcher", "seq")


def idle(events: DataFrame, now_us: int, ping_us: int = 30_000_000, timeout_us: int = 60_000_000) -> DataFrame:
    """Connections with what is due at a time: ``timeout``, ``ping`` or nothing, by the time since their last event."""
    last = events.groupBy("conn_id").agg(F.max("at_us").alias("last_us"))
    silent = F.lit(now_us) - F.col("last_us")
    return last.withColumn("due", F.when(silent >= timeout_us, "timeout").when(silent >= ping_us, "ping"))


def pressure(queued: Column, warning: int = 1 << 20, high: int = 2 << 20, critical: int = 4 << 20) -> Column:
    """Level of a connection by its queued bytes."""
    return F.when(queued >= critical, "critical").when(queued >= high, "high").when(queued >= warning, "warning").otherwise("normal")


def oversized_header(size: Column, is_header: Column, most: int = 256 << 10) -> Column:
    """Headers that are refused for their size."""
    return is_header & (size > most)
