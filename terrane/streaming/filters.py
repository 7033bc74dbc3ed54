"""Tag queries over streams: a selection is stateless, so it runs on a streaming DataFrame as it does on a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.functions.box import Box
from terrane.plans import goql


def select(features: DataFrame, query: str, box: Box | None = None) -> DataFrame:
    """Rows (streaming or not) with category, tags and, for a box, its four columns."""
    parsed = goql.parse(query)
    rows = features.filter(goql.compile_query(parsed, lambda k: F.try_element_at("tags", F.lit(k)), F.col("category")))
    return rows if box is None else rows.filter(box.overlaps())


def windowed_counts(events: DataFrame, time: str, key: Column, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by tumbling window; rows later than ``late`` behind the watermark are dropped by Spark."""
    return events.withWatermark(time, late).groupBy(F.window(time, window).alias("window"), key.alias("key")).agg(F.count("*").alias("n"))
