"""Activity by weekday and hour of day."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tidemark.functions.timestamps import weekday_name
from tidemark.operators.rollups import merge_rollup


def activity_heatmap(rollup: DataFrame) -> DataFrame:
    """Cells in the order monday..sunday, 0..23; cells without events are left out."""
    return (
        merge_rollup(rollup, ["weekday", "hour"], ["events"])
        .orderBy("weekday", "hour")
        .select(weekday_name("weekday").alias("weekday"), "hour", "events")
    )
