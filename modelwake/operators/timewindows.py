"""Calendar splits, reference/current splits and data-driven time windows."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modelwake.roles import TimeConfig

_WEEK, _DAY, _HOUR = timedelta(weeks=1), timedelta(days=1), timedelta(hours=1)
_MICRO = timedelta(microseconds=1)


def ntz(moment: datetime | str) -> Column:
    return F.lit(str(moment)).cast("timestamp_ntz")


def calendar_split(df: DataFrame, ts: str, config: TimeConfig = TimeConfig()) -> DataFrame:
    """Add ``split``; rows outside the configured months are dropped.

    The year is a range on the raw column, so it reaches the Parquet scan.
    """
    month = F.month(ts)
    year = (F.col(ts) >= ntz(f"{config.year}-01-01")) & (F.col(ts) < ntz(f"{config.year + 1}-01-01"))
    split = (
        F.when(month.isin(*config.train_months), "train")
        .when(month == config.val_month, "val")
        .when(month == config.test_month, "test")
    )
    return df.where(year).withColumn("split", split).where(F.col("split").isNotNull())


def reference_current_split(
    df: DataFrame, ts: str, reference_end: str, current_end: str | None = None, start: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Two inclusive slices; a row exactly at ``reference_end`` is in both. Without ``current_end`` the second is open."""
    reference = df.where(F.col(ts) <= ntz(reference_end))
    if start is not None:
        reference = reference.where(F.col(ts) >= ntz(start))
    current = df.where(F.col(ts) >= ntz(reference_end))
    return reference, current if current_end is None else current.where(F.col(ts) <= ntz(current_end))


@dataclass(frozen=True)
class WindowPlan:
    """``count`` adjacent windows of equal length over ``[start, start + span]``.

    ``rows`` is the number of rows the plan was made from. Window i (from 0) holds
    the rows with i*span/count <= ts - start <= (i+1)*span/count, so a row on a
    border is in two windows.
    """

    start: datetime | None
    span: timedelta
    count: int
    rows: int

    @property
    def length(self) -> timedelta:
        return self.span / self.count if self.count else _HOUR

    def _border(self, index, up: bool):
        """Border ``index`` in microseconds after start, rounded into the window.

        The split into quotient and remainder keeps the product inside 64 bits.
        """
        whole, rest = divmod(self.span // _MICRO, self.count)
        lift = self.count - 1 if up else 0
        if isinstance(index, int):
            return index * whole + (index * rest + lift) // self.count
        fraction = F.floor((index * rest + lift) / self.count).cast("long") if rest else F.lit(0)
        return index * whole + fraction

    def table(self, spark: SparkSession) -> DataFrame:
        """One row per window: ``window_id`` from 1, ``window_start``, ``window_end``."""
        rows = [
            (
                i + 1,
                self.start + self._border(i, up=True) * _MICRO,
                self.start + self._border(i + 1, up=False) * _MICRO,
            )
            for i in range(self.count)
        ]
        schema = "window_id int, window_start timestamp_ntz, window_end timestamp_ntz"
        return spark.createDataFrame(rows, schema)

    def assign(self, df: DataFrame, ts: str) -> DataFrame:
        """Add ``window_id``; rows outside all windows are dropped, border rows appear twice.

        Pure arithmetic per row: no join and no shuffle.
        """
        if not self.count:
            return df.withColumn("window_id", F.lit(None).cast("int")).where(F.lit(False))
        offset = F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '{self.start}', `{ts}`)")
        step = max((self.span // _MICRO) / self.count, 1.0)
        guess = F.floor(F.col("_off") / F.lit(step))
        g, off = F.col("_guess"), F.col("_off")
        last = F.when(off >= self._border(g + 1, up=True), g + 1).when(off >= self._border(g, up=True), g)
        first = F.when(off <= self._border(g, up=False), g - 1).when(off <= self._border(g + 1, up=False), g)
        located = (
            df.withColumn("_off", offset)
            .withColumn("_guess", guess)
            .withColumn("_first", F.greatest(first.otherwise(g + 1), F.lit(0)))
            .withColumn("_last", F.least(last.otherwise(g - 1), F.lit(self.count - 1)))
        )
        # A row is in one window, or in two neighbours. The test sits behind the explode,
        # where the optimizer does not copy the arithmetic into a filter.
        one = F.when(F.col("_first") <= F.col("_last"), F.col("_first") + 1).cast("int")
        two = F.when(F.col("_first") < F.col("_last"), F.col("_last") + 1).cast("int")
        placed = located.select(*df.columns, F.explode(F.array(one, two)).alias("window_id"))
        return placed.where(F.col("window_id").isNotNull())


def window_unit(span: timedelta) -> timedelta:
    if span >= 4 * _WEEK:
        return _WEEK
    if span >= _WEEK:
        return _DAY
    if span >= 2 * _DAY:
        return 6 * _HOUR
    return _HOUR


def size_windows(start: datetime | None, end: datetime | None, rows: int) -> WindowPlan:
    """Window count from the time span and the row count (at least four rows per window)."""
    if rows < 2:
        return WindowPlan(start, _HOUR, 1 if rows else 0, rows)
    span = end - start
    wanted = max(1, span // window_unit(span))
    return WindowPlan(start, span, min(wanted, rows // 4), rows)


def plan_windows(df: DataFrame, ts: str) -> WindowPlan:
    """One small aggregate over the time column; a single row reaches the driver."""
    if not isinstance(df.schema[ts].dataType, T.TimestampNTZType):
        df = df.withColumn(ts, F.col(ts).cast("timestamp_ntz"))
    low, high, rows = df.agg(F.min(ts), F.max(ts), F.count("*")).first()
    return size_windows(low, high, rows)


def interval_metric_buckets(df: DataFrame, ts: str, unit: str) -> DataFrame:
    """Add ``bucket``: the hour, day, week or month a row falls in."""
    return df.withColumn("bucket", F.date_trunc(unit, F.col(ts)).cast("timestamp_ntz"))
