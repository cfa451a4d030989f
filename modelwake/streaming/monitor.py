"""The monitor on a stream of scored events."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modelwake.functions.metrics import r2
from modelwake.operators.critical import R2_LIMIT


@dataclass(frozen=True)
class ReferenceStats:
    """Mean and deviation of target and prediction over the reference period."""

    target_mean: float
    target_std: float
    prediction_mean: float
    prediction_std: float

    @classmethod
    def of(cls, reference: DataFrame, y: str, p: str) -> "ReferenceStats":
        row = reference.agg(F.avg(y), F.stddev_pop(y), F.avg(p), F.stddev_pop(p)).first()
        return cls(*[float(v or 0.0) for v in row])


def read_events(spark: SparkSession, glob: str, schema: str) -> DataFrame:
    """File stream; ``glob`` names a directory or a pattern such as ``events*.parquet``."""
    return spark.readStream.schema(schema).parquet(glob)


def windowed_metrics(
    events: DataFrame, ts: str, y: str, p: str, stats: ReferenceStats, window: str = "1 day",
    slide: str | None = None, delay: str = "1 hour",
) -> DataFrame:
    """Quality and mean shift per time window; works on a stream and on a batch alike.

    Without ``slide`` windows follow each other; with it they overlap. Rows older
    than the watermark are dropped on a stream. Only the sums of the open windows
    are kept as state.
    """
    timed = events.withColumn("_time", F.col(ts).cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark("_time", delay)
    error = F.col(p) - F.col(y)
    grouped = timed.groupBy(F.window("_time", window, slide) if slide else F.window("_time", window)).agg(
        F.count("*").alias("n_rows"),
        r2(F.col(y), F.col(p)).alias("r2_score"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.avg(error).alias("mean_error"),
        F.avg(y).alias("_mean_y"),
        F.avg(p).alias("_mean_p"),
    )

    def shift(mean: str, base: float, std: float):
        return F.abs(F.col(mean) - base) / max(std, 1e-9)

    return grouped.select(
        F.col("window.start").cast("timestamp_ntz").alias("window_start"),
        F.col("window.end").cast("timestamp_ntz").alias("window_end"),
        "n_rows", "r2_score", "rmse", "mean_error",
        shift("_mean_y", stats.target_mean, stats.target_std).alias("target_shift"),
        shift("_mean_p", stats.prediction_mean, stats.prediction_std).alias("prediction_shift"),
        (F.round(F.coalesce("r2_score", F.lit(0.0)), 3) < R2_LIMIT).alias("poor_performance"),
    )


def run_to_table(metrics: DataFrame, output: str, checkpoint: str) -> None:
    """Write closed windows to Parquet until all present input is processed.

    Offsets and state live in ``checkpoint``; a restart with the same folder goes on
    where the last run stopped.
    """
    query = (
        metrics.writeStream.outputMode("append")
        .format("parquet")
        .option("path", output)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
