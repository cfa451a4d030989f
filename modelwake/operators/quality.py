"""Regression quality per window: scores, error groups and error bias."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modelwake.functions.exprs import ratio
from modelwake.functions.metrics import r2
from modelwake.operators.joins import null_safe_join
from modelwake.operators.ordered import exact_percentiles
from modelwake.session import BROADCAST_ROWS

UNDER, OVER, MAJORITY = "underestimation", "overestimation", "majority"
ERROR_GROUPS = (MAJORITY, UNDER, OVER)

#: Shares of rows that form the under- and overestimation groups.
TAILS = (0.05, 0.95)


def regression_quality(df: DataFrame, y: str, p: str, by: Sequence[str] = ("window_id",)) -> DataFrame:
    """r2_score, rmse, mean_error and error_std per group, in one aggregate."""
    error = (F.col(p) - F.col(y)).cast("double")
    return df.groupBy(*by).agg(
        F.count("*").alias("n_rows"),
        r2(F.col(y), F.col(p)).alias("r2_score"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.avg(error).alias("mean_error"),
        F.stddev_samp(error).alias("error_std"),
    )


def performance_series(quality: DataFrame, windows: DataFrame) -> DataFrame:
    """One row per planned window; a window without a value gets 0."""
    names = ("r2_score", "rmse", "mean_error", "error_std")
    joined = windows.join(quality, "window_id", "left")
    return joined.select(
        "window_id",
        F.format_string("Window %d", "window_id").alias("label"),
        "window_start",
        "window_end",
        *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in names],
    )


def with_error_groups(
    df: DataFrame, y: str, p: str, by: Sequence[str], rows: int, groups: int = BROADCAST_ROWS + 1
) -> DataFrame:
    """Add ``error`` and ``error_group``: at or below the 5% quantile of the group's errors,
    at or above the 95% quantile, or between. ``groups`` bounds the number of groups."""
    scored = df.withColumn("error", (F.col(p) - F.col(y)).cast("double")).where(F.col("error").isNotNull())
    limits = exact_percentiles(scored, by, "error", TAILS, rows, "_limits")
    if groups <= BROADCAST_ROWS:
        limits = F.broadcast(limits)
    labelled = null_safe_join(scored, limits, list(by))
    # Compared at nine places: interpolating between equal errors may leave a trace in the last bits.
    error, low, high = (F.round(c, 9) for c in (F.col("error"), F.col("_limits")[0], F.col("_limits")[1]))
    group = F.when(error <= low, UNDER).when(error >= high, OVER).otherwise(MAJORITY)
    return labelled.withColumn("error_group", group).drop("_limits")


def error_group_stats(grouped: DataFrame, by: Sequence[str]) -> DataFrame:
    """Count, mean and sample deviation of the error in every error group."""
    return grouped.groupBy(*by, "error_group").agg(
        F.count("*").alias("n_rows"),
        F.avg("error").alias("mean_error"),
        F.stddev_samp("error").alias("std_error"),
    )


def error_bias(grouped: DataFrame, features: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Mean of every numeric feature in the three error groups, and the range between the tails.

    Features are aggregated side by side and turned into rows afterwards, so the
    input is not multiplied by the number of features.
    """
    aggregates = []
    for f in features:
        value = F.col(f).cast("double")
        for g in ERROR_GROUPS:
            aggregates.append(F.avg(F.when(F.col("error_group") == g, value)).alias(f"{f}.{g}"))
        aggregates += [F.min(value).alias(f"{f}.min"), F.max(value).alias(f"{f}.max")]
    wide = grouped.groupBy(*by).agg(*aggregates)
    entries = [
        F.struct(
            F.lit(f).alias("feature"),
            (
                F.abs(F.col(f"`{f}.{OVER}`") - F.col(f"`{f}.{UNDER}`"))
                * 100
                / F.nullif(F.col(f"`{f}.max`") - F.col(f"`{f}.min`"), F.lit(0.0))
            ).alias("range"),
            F.col(f"`{f}.{MAJORITY}`").alias("majority_value"),
            F.col(f"`{f}.{UNDER}`").alias("under_value"),
            F.col(f"`{f}.{OVER}`").alias("over_value"),
        )
        for f in features
    ]
    return wide.select(*by, F.explode(F.array(*entries)).alias("e")).select(*by, "e.*")


def most_common(counted: DataFrame, keys: Sequence[str], value: str, n: str = "n") -> DataFrame:
    """Most frequent value per group from counted values; the smallest wins a tie."""
    best = counted.where(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.min(F.struct((-F.col(n)).alias("neg"), F.col(value).alias("v"))).alias("best"),
        F.count("*").alias("distinct_values"),
    )
    return best.select(*keys, F.col("best.v").alias(value), (-F.col("best.neg")).alias(n), "distinct_values")


def category_bias(grouped: DataFrame, features: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Most frequent value of every categorical feature in each error group."""
    texts = grouped.select(*by, "error_group", *[F.col(f).cast("string").alias(f) for f in features])
    long = texts.unpivot([*by, "error_group"], list(features), "feature", "value")
    counted = long.groupBy(*by, "error_group", "feature", "value").agg(F.count("*").alias("n"))
    return most_common(counted, [*by, "error_group", "feature"], "value").drop("distinct_values")


def error_tails(df: DataFrame, y: str, p: str, by: Sequence[str], rows: int) -> DataFrame:
    """Excess kurtosis of the error and how far its 99% point lies from its median."""
    scored = df.withColumn("error", (F.col(p) - F.col(y)).cast("double")).withColumn("_gap", F.abs("error"))
    shape = scored.groupBy(*by).agg(F.kurtosis("error").alias("kurtosis"), F.skewness("error").alias("skewness"))
    points = exact_percentiles(scored, by, "_gap", [0.5, 0.99], rows, "_points")
    return null_safe_join(shape, points, list(by)).select(
        *by,
        "kurtosis",
        "skewness",
        F.col("_points")[0].alias("median_gap"),
        F.col("_points")[1].alias("p99_gap"),
        ratio(F.col("_points")[1], F.col("_points")[0]).alias("tail_ratio"),
    )
