"""All queries over the reference's operators, gathered from the plan modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kinoframe.plans import byte_queries, codec_queries, layout_queries, media_queries, picture_queries, recipe_queries, scan_queries, script_queries, timeline_queries, timing_queries, value_queries

MODULES = (scan_queries, timeline_queries, media_queries, byte_queries, recipe_queries, value_queries, picture_queries, codec_queries, timing_queries, script_queries, layout_queries)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
for module in MODULES:
    QUERIES |= module.QUERIES
    ORACLE |= module.ORACLE
