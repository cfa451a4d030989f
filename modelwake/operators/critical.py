"""Flag critical windows and put the monitoring report together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modelwake.operators.quality import ERROR_GROUPS

#: A window is poor when its r2, rounded to three places, is below this.
R2_LIMIT = 0.7

ISO = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def reported(value: Column, digits: int) -> Column:
    """Half-up rounding of the decimal value. The first step drops the noise of the last bits."""
    return F.round(F.round(value, 9), digits)


def poor_performance(r2_score: str = "r2_score") -> Column:
    """A missing r2 counts as 0, as in the performance series."""
    return reported(F.coalesce(F.col(r2_score), F.lit(0.0)), 3) < R2_LIMIT


def flag_windows(windows: DataFrame, quality: DataFrame, drifted: DataFrame) -> DataFrame:
    """One row per window: its drifted columns, whether it performs poorly, whether it is critical."""
    joined = windows.join(quality, "window_id", "left").join(drifted, "window_id", "left")
    names = F.coalesce(F.col("drifted"), F.array().cast("array<string>"))
    return joined.select(
        "window_id", "window_start", "window_end", "r2_score",
        names.alias("drifted"),
        poor_performance().alias("poor_performance"),
        (poor_performance() | (F.size(names) > 0)).alias("is_critical"),
    )


def status_of(n_critical: Column, total: Column) -> Column:
    return F.when(n_critical > F.floor(total / 2), "critical").when(n_critical > 0, "warning").otherwise("stable")


def summarize(flags: DataFrame) -> DataFrame:
    """One row: totals, status and the sorted union of drifted columns."""
    totals = flags.agg(
        F.count("*").alias("total_windows"),
        F.count_if("is_critical").alias("critical_windows"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("drifted")))).alias("drifted_features"),
    )
    return totals.withColumn("status", status_of(F.col("critical_windows"), F.col("total_windows")))


def critical_entries(flags: DataFrame) -> DataFrame:
    return flags.where("is_critical").select(
        "window_id",
        F.struct(F.col("window_start").alias("start"), F.col("window_end").alias("end")).alias("time_range"),
        F.struct(F.col("drifted").alias("drifted_features"), "poor_performance").alias("issues"),
    )


def window_reports(
    flags: DataFrame, quality: DataFrame, groups: DataFrame, bias: DataFrame, drift: DataFrame
) -> DataFrame:
    """One nested row per window: range, metrics, error distribution, drift and feature performance.

    Every input is already aggregated to a few rows per window.
    """
    metrics = quality.select(
        "window_id",
        F.struct(
            reported(F.coalesce("r2_score", F.lit(0.0)), 3).alias("r2_score"),
            *[reported(F.coalesce(c, F.lit(0.0)), 2).alias(c) for c in ("rmse", "mean_error", "error_std")],
        ).alias("metrics"),
    )

    def group_struct(name: str) -> Column:
        mine = F.col("error_group") == name
        return F.struct(
            reported(F.coalesce(F.max(F.when(mine, F.col("mean_error"))), F.lit(0.0)), 2).alias("mean"),
            reported(F.coalesce(F.max(F.when(mine, F.col("std_error"))), F.lit(0.0)), 2).alias("std"),
        ).alias(name)

    distribution = groups.groupBy("window_id").agg(
        F.struct(*[group_struct(g) for g in ERROR_GROUPS]).alias("error_distribution")
    )
    scores = drift.groupBy("window_id").agg(
        F.map_from_entries(
            F.array_sort(F.collect_list(F.struct("feature", F.struct("score", "detected").alias("v"))))
        ).alias("feature_scores")
    )
    performance = bias.groupBy("window_id").agg(
        F.map_from_entries(
            F.array_sort(
                F.collect_list(
                    F.struct(
                        "feature",
                        F.struct(
                            reported(F.coalesce("range", F.lit(0.0)), 2).alias("range"),
                            *[reported(F.coalesce(c, F.lit(0.0)), 3).alias(c) for c in ("majority_value", "under_value", "over_value")],
                        ).alias("v"),
                    )
                )
            )
        ).alias("feature_performance")
    )
    joined = flags
    for part in (metrics, distribution, scores, performance):
        joined = joined.join(part, "window_id", "left")
    unknown = F.lit("unknown")
    return joined.select(
        "window_id",
        F.struct(
            F.coalesce(F.date_format("window_start", ISO), unknown).alias("start"),
            F.coalesce(F.date_format("window_end", ISO), unknown).alias("end"),
        ).alias("time_range"),
        "metrics",
        "error_distribution",
        F.struct(F.col("drifted").alias("drifted_features"), "feature_scores").alias("drift_analysis"),
        "feature_performance",
        "is_critical",
    )
