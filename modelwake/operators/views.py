"""Tables ready for plotting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def drift_matrix(table: DataFrame, window_ids: Sequence[int]) -> DataFrame:
    """Features by windows in numeric window order; 0 where a pair is absent."""
    wide = table.groupBy("feature").pivot("window_id", list(window_ids)).agg(F.first("intensity"))
    named = wide.select("feature", *[F.col(f"`{w}`").alias(f"w{w}") for w in window_ids])
    return named.fillna(0.0, [f"w{w}" for w in window_ids])


def box_stats(table: DataFrame, value: str) -> DataFrame:
    """Median, quartiles and count per feature over its windows (one row per window, so small)."""
    points = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    boxes = table.groupBy("feature").agg(points.alias("_p"), F.count(value).alias("n_windows"))
    return boxes.select(
        "feature", "n_windows", F.col("_p")[0].alias("q1"), F.col("_p")[1].alias("median"), F.col("_p")[2].alias("q3")
    )


def mean_difference_series(delta: DataFrame) -> DataFrame:
    return delta.select("feature", "window_id", F.format_string("Window %d", "window_id").alias("label"), "mean_diff")
