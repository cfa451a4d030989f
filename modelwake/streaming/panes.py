"""Stream monitoring from panes: every row is aggregated once, windows of any length are put together from panes.

A pane is a short, fixed span of time. The stream keeps a few sums per pane, class of the
target and class of the prediction as state; their number depends on time and classes, not
on rows. Each micro-batch hands the changed panes to a table that is replaced as a whole,
so all panes are visible, the newest too, and a repeated batch changes nothing.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from modelwake.functions.exprs import chi2_tail
from modelwake.operators.critical import poor_performance
from modelwake.operators.drift import P_LEVEL, numeric_long
from modelwake.operators.ordered import exact_percentiles
from modelwake.session import bounded_broadcast
from modelwake.sources import versions

#: Classes of a reference histogram, of equal frequency.
CLASSES = 9

_KEYS = ("pane", "y_class", "p_class")
_SUMS = ("n", "m", "sy", "syy", "sp", "se", "see")


@dataclass(frozen=True)
class Reference:
    """What the stream is held against: centre, deviation and histogram of target and prediction.

    ``edges`` are the upper limits of all classes but the last, ``shares`` the shares of the
    reference rows in them; a handful of numbers per column.
    """

    means: tuple[float, float]
    deviations: tuple[float, float]
    edges: tuple[tuple[float, ...], tuple[float, ...]]
    shares: tuple[tuple[float, ...], tuple[float, ...]]

    @classmethod
    def of(cls, reference: DataFrame, y: str, p: str, rows: int, classes: int = CLASSES) -> "Reference":
        found = exact_percentiles(numeric_long(reference, [y, p]), ["feature"], "x", [i / classes for i in range(1, classes)], rows)
        limits = {r["feature"]: r["q"] for r in found.collect()}
        edges = [tuple(sorted(set(limits.get(c) or ()))) for c in (y, p)]
        totals = reference.agg(
            *[f(F.col(c)) for c in (y, p) for f in (F.avg, F.stddev_pop, F.count)],
            *[F.count_if(class_of(F.col(c), e) == i) for c, e in zip((y, p), edges, strict=True) for i in range(len(e) + 1)],
        ).first()
        counts = list(totals[6:])
        shares, at = [], 0
        for place, e in enumerate(edges):
            n = totals[3 * place + 2]
            shares.append(tuple(c / n if n else 0.0 for c in counts[at : at + len(e) + 1]))
            at += len(e) + 1
        return cls(
            (totals[0] or 0.0, totals[3] or 0.0), (totals[1] or 0.0, totals[4] or 0.0), tuple(edges), tuple(shares)
        )


def class_of(value: Column, edges: Sequence[float]) -> Column:
    """The number of edges below ``value``; null for null."""
    above = reduce(Column.__add__, [(value > F.lit(float(e))).cast("int") for e in edges], F.lit(0))
    return F.when(value.isNotNull(), above)


def paned(events: DataFrame, ts: str, y: str, p: str, reference: Reference, pane: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """pane, the classes of target and prediction, and their sums; on a stream and on a batch alike.

    Rows without target or prediction count in ``n`` alone. Sums are taken around the reference
    means, so squares lose nothing when panes are added up. On a stream, rows
    later than ``delay`` are dropped once their pane is closed.
    """
    timed = events.withColumn("_time", F.col(ts).cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark("_time", delay)
    both = F.col(y).isNotNull() & F.col(p).isNotNull()
    dy, error = F.col(y) - F.lit(reference.means[0]), F.col(p) - F.col(y)
    sums = {
        "n": F.count("*"), "m": F.count_if(both), "sy": F.sum(F.when(both, dy)), "syy": F.sum(F.when(both, dy * dy)),
        "sp": F.sum(F.when(both, F.col(p) - F.lit(reference.means[1]))), "se": F.sum(error), "see": F.sum(error * error),
    }
    grouped = timed.groupBy(
        F.window("_time", pane).alias("w"), class_of(F.col(y), reference.edges[0]).alias("y_class"), class_of(F.col(p), reference.edges[1]).alias("p_class")
    ).agg(*[F.coalesce(s, F.lit(0)).alias(name) for name, s in sums.items()])
    return grouped.select(F.col("w.start").cast("timestamp_ntz").alias("pane"), "y_class", "p_class", *sums)


def upsert_panes(batch: DataFrame, batch_id: int, root: str) -> None:
    """Replace the panes of ``batch`` in the stored table.

    The table and the number of the batch become valid together, so a batch that comes again
    after a restart is recognised and left out.
    """
    spark = batch.sparkSession
    stored = versions.current(spark, root)
    if stored is not None and stored.notes["batch"] >= batch_id:
        return
    if stored is not None:
        matches = reduce(Column.__and__, [F.col(f"old.{k}").eqNullSafe(F.col(f"new.{k}")) for k in _KEYS])
        kept = stored.read(spark).alias("old").join(batch.alias("new"), matches, "left_anti")
        batch = kept.unionByName(batch)
    versions.publish(batch, root, {"batch": batch_id})


def run_panes(panes: DataFrame, root: str, checkpoint: str) -> DataFrame:
    """Keep the pane table below ``root`` up to date until all present input is processed; returns it.

    Offsets and state live in ``checkpoint``; a restart with the same folders goes on where
    the last run stopped.
    """
    query = (
        panes.writeStream.outputMode("update")
        .foreachBatch(lambda batch, batch_id: upsert_panes(batch, batch_id, root))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return stored_panes(panes.sparkSession, root, panes.schema)


def stored_panes(spark: SparkSession, root: str, schema) -> DataFrame:
    stored = versions.current(spark, root)
    return spark.createDataFrame([], schema) if stored is None else stored.read(spark)


def window_drift(panes: DataFrame, reference: Reference, spread) -> DataFrame:
    """Chi-square test of the class counts of every window against the reference shares.

    A class that the reference does not know gives p = 0. Expected counts add up to the
    window, so classes without a row add nothing to the statistic.
    """
    spark = panes.sparkSession
    parts = []
    for name, key, shares in zip(("target", "prediction"), ("y_class", "p_class"), reference.shares, strict=True):
        rows = spark.createDataFrame([(i, float(s)) for i, s in enumerate(shares)], f"{key} int, share double")
        per_pane = panes.where(F.col(key).isNotNull()).groupBy("pane", key).agg(F.sum("n").alias("n"))
        counts = spread(per_pane).groupBy("window_start", key).agg(F.sum("n").alias("n"))
        known = F.sum(F.when(F.col("share") > 0, F.col("n") * F.col("n") / F.col("share")))
        found = counts.join(bounded_broadcast(rows, len(shares)), key).groupBy("window_start").agg(
            F.sum("n").alias("n"), known.alias("squares"), F.count_if(F.col("share") <= 0).alias("new")
        )
        df = sum(s > 0 for s in shares) - 1
        statistic = F.greatest(F.col("squares") / F.col("n") - F.col("n"), F.lit(0.0))
        tail = chi2_tail(statistic, F.lit(df)) if df > 0 else F.lit(1.0)
        parts.append(
            found.select(
                "window_start",
                F.when(F.col("new") > 0, F.lit(float("inf"))).otherwise(statistic).alias(f"{name}_statistic"),
                F.when(F.col("new") > 0, 0.0).when(statistic <= 0, 1.0).otherwise(tail).alias(f"{name}_p_value"),
            )
        )
    return parts[0].join(parts[1], "window_start", "full")


def window_view(panes: DataFrame, reference: Reference, length: int, pane: str = "1 day") -> DataFrame:
    """Quality, mean shift and drift of every window of ``length`` panes; windows start at every pane.

    Windows follow each other where ``length`` is 1, and overlap beyond. Every window that
    holds a row has one row of the result. Only panes are copied to their windows, never
    the rows behind them.
    """
    back = F.expr(f"INTERVAL {pane}")
    starts = F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda i: F.col("pane") - i * back)

    def spread(df: DataFrame) -> DataFrame:
        return df.withColumn("window_start", F.explode(starts))

    sums = panes.groupBy("pane").agg(*[F.sum(n).alias(n) for n in _SUMS])
    whole = spread(sums).groupBy("window_start").agg(*[F.sum(n).alias(n) for n in _SUMS])
    m = F.col("m")
    squares = F.col("syy") - F.try_divide(F.col("sy") * F.col("sy"), m)
    shifts = [F.abs(F.try_divide(F.col(s), m)) / max(d, 1e-9) for s, d in zip(("sy", "sp"), reference.deviations, strict=True)]
    quality = whole.select(
        "window_start",
        (F.col("window_start") + length * back).alias("window_end"),
        F.col("n").alias("n_rows"),
        F.when(squares > 0, 1 - F.col("see") / squares).alias("r2_score"),
        F.sqrt(F.try_divide("see", m)).alias("rmse"),
        F.try_divide("se", m).alias("mean_error"),
        shifts[0].alias("target_shift"),
        shifts[1].alias("prediction_shift"),
    )
    drift = window_drift(panes, reference, spread)
    joined = quality.join(drift, "window_start", "left")
    drifted = F.array_compact(F.array(*[F.when(F.col(f"{c}_p_value") < P_LEVEL, F.lit(c)) for c in ("prediction", "target")]))
    return joined.withColumn("drifted", drifted).withColumns({
        "poor_performance": poor_performance(),
        "is_critical": poor_performance() | (F.size("drifted") > 0),
    })
