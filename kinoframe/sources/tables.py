"""Adapters: driver tables as the canonical relations (packets, streams, audio chunks, subtitle events).

Every relation carries its order as a column (``seq`` or ``pts_us``); times are microseconds as long.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: str) -> Column:
    """Microseconds since 1970 of a timestamp without time zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST({ts} AS TIMESTAMP_NTZ))")


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets of many short streams: one stream a user."""
    return table(spark, sf_dir, "events").select(
        F.lit(0).alias("asset_id"),
        F.col("user_id").alias("stream_index"),
        F.col("event_id").alias("seq"),
        micros("ts").alias("pts_us"),
        F.length("props").cast("long").alias("size"),
        (F.col("event_type") == "purchase").alias("is_key"),
        (F.col("event_type") == "error").alias("is_corrupt"),
        F.col("value").alias("measure"),
        "event_type",
    )


#: The same relation in DuckDB.
PACKETS = """
    SELECT 0 AS asset_id, user_id AS stream_index, event_id AS seq, epoch_us(ts) AS pts_us,
           CAST(length(props) AS BIGINT) AS size, event_type = 'purchase' AS is_key,
           event_type = 'error' AS is_corrupt, value AS measure, event_type
    FROM events
"""


def typed_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets of few long streams: one stream an event type, in the order of their names."""
    codes = F.expr("CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END")
    return packets(spark, sf_dir).withColumn("stream_index", codes.cast("long"))


TYPED = f"""
    SELECT * REPLACE (CAST(CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2
                      WHEN 'signup' THEN 3 ELSE 4 END AS BIGINT) AS stream_index) FROM ({PACKETS})
"""


def line_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets at bench scale: one stream a supplier. ``seq`` is a struct, as order and line number alone repeat."""
    order = ("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", "l_quantity", "l_returnflag")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("stream_index"),
        F.struct(*order).alias("seq"),
        micros("l_shipdate").alias("pts_us"),
        F.col("l_quantity").cast("long").alias("size"),
        (F.col("l_returnflag") == "R").alias("is_key"),
    )


LINES = """
    SELECT l_suppkey AS stream_index, epoch_us(l_shipdate) AS pts_us,
           row(l_orderkey, l_linenumber, l_partkey, l_shipdate, l_quantity, l_returnflag) AS seq,
           CAST(l_quantity AS BIGINT) AS size, l_returnflag = 'R' AS is_key
    FROM lineitem
"""


def streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stream descriptions: one asset a brand, with kind, geometry and disposition."""
    part = table(spark, sf_dir, "part")
    return part.select(
        F.col("p_brand").alias("asset_id"),
        F.col("p_partkey").alias("stream_index"),
        F.expr("CASE p_size % 3 WHEN 0 THEN 'video' WHEN 1 THEN 'audio' ELSE 'subtitle' END").alias("kind"),
        (F.col("p_size") * 16).cast("long").alias("width"),
        (F.col("p_size") * 9).cast("long").alias("height"),
        (F.col("p_partkey") % 5 == 0).alias("is_default"),
        (F.col("p_partkey") % 11 == 0).alias("attached_pic"),
        (F.col("p_partkey") % 7 != 0).alias("has_packets"),
        F.col("p_type").alias("title"),
    )


STREAMS = """
    SELECT p_brand AS asset_id, p_partkey AS stream_index,
           CASE p_size % 3 WHEN 0 THEN 'video' WHEN 1 THEN 'audio' ELSE 'subtitle' END AS kind,
           CAST(p_size * 16 AS BIGINT) AS width, CAST(p_size * 9 AS BIGINT) AS height,
           p_partkey % 5 = 0 AS is_default, p_partkey % 11 = 0 AS attached_pic, p_partkey % 7 <> 0 AS has_packets,
           p_type AS title
    FROM part
"""


def cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subtitle events: a script a conversation, an event a turn."""
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("script_id"),
        F.col("turn").alias("read_order"),
        (F.col("turn") % 3).alias("layer"),
        (F.col("turn") * 1000).alias("start_ms"),
        (F.length("text") * 10).cast("long").alias("duration_ms"),
        F.col("role").alias("style"),
        "text",
    )


CUES = """
    SELECT conv_id AS script_id, turn AS read_order, turn % 3 AS layer, turn * 1000 AS start_ms,
           CAST(length(text) * 10 AS BIGINT) AS duration_ms, role AS style, text
    FROM conversations
"""


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audio chunks: 64 samples a vector at 16 kHz, so 4000 us each; 10 assets."""
    return table(spark, sf_dir, "embeddings").select(
        (F.col("vec_id") % 10).alias("asset_id"),
        F.floor(F.col("vec_id") / 10).alias("index"),
        (F.floor(F.col("vec_id") / 10) * 4000).alias("pts_us"),
        F.lit(16000).alias("sample_rate"),
        F.lit(1).alias("channels"),
        F.col("embedding").alias("data"),
    )


CHUNKS = """
    SELECT vec_id % 10 AS asset_id, vec_id // 10 AS "index", (vec_id // 10) * 4000 AS pts_us, 16000 AS sample_rate,
           1 AS channels, embedding AS data
    FROM embeddings
"""
