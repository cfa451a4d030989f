"""The monitoring run: windows, quality, drift, flags, and profiles of the critical windows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modelwake.operators import critical, drift, profile, quality
from modelwake.operators.timewindows import WindowPlan, plan_windows
from modelwake.session import bounded_broadcast, materialize
from modelwake.sources.files import as_json


@dataclass
class MonitoringRun:
    """Lazy tables of one run. Only the window plan and the drift-method choice touch the driver.

    ``regime`` chooses distances or tests for the drift of all columns, and ``methods`` names
    the method of single columns. A distance has one limit whatever the number of rows, so
    chance alone passes it in small windows; tests take the number of rows into account.
    """

    reference: DataFrame
    current: DataFrame
    ts: str
    target: str
    prediction: str
    numeric: Sequence[str]
    categorical: Sequence[str]
    regime: str = "distance"
    methods: Mapping[str, str] | None = None

    def _methods(self, columns: Sequence[str]) -> dict[str, str]:
        return {c: m for c, m in (self.methods or {}).items() if c in columns}

    @property
    def spark(self) -> SparkSession:
        return self.current.sparkSession

    @cached_property
    def plan(self) -> WindowPlan:
        return plan_windows(self.current, self.ts)

    @cached_property
    def reference_rows(self) -> int:
        return self.reference.count()

    @property
    def rows(self) -> int:
        """Bound of assigned plus reference rows, and so of any group; a border row counts twice."""
        return 2 * self.plan.rows + self.reference_rows

    @cached_property
    def windows(self) -> DataFrame:
        return self.plan.table(self.spark)

    @cached_property
    def assigned(self) -> DataFrame:
        return self.plan.assign(self.current, self.ts)

    @cached_property
    def quality(self) -> DataFrame:
        return quality.regression_quality(self.assigned, self.target, self.prediction)

    @cached_property
    def series(self) -> DataFrame:
        return quality.performance_series(self.quality, self.windows)

    @cached_property
    def grouped(self) -> DataFrame:
        return quality.with_error_groups(
            self.assigned, self.target, self.prediction, ["window_id"], self.rows, self.plan.count
        )

    @cached_property
    def target_drift(self) -> DataFrame:
        """Drift of target and prediction, every window against the whole reference."""
        columns = [self.target, self.prediction]
        return drift.drift_table(
            self.reference, self.assigned, columns, [], self.rows, self._methods(columns), regime=self.regime
        )

    @cached_property
    def flags(self) -> DataFrame:
        """One stored row per window: every later step reads it instead of repeating the drift tests."""
        return materialize(critical.flag_windows(self.windows, self.quality, drift.drifted_names(self.target_drift)))

    @property
    def summary(self) -> DataFrame:
        return critical.summarize(self.flags)

    @cached_property
    def critical_rows(self) -> DataFrame:
        """Current rows of the critical windows only."""
        ids = self.flags.where("is_critical").select("window_id")
        return self.assigned.join(bounded_broadcast(ids, self.plan.count), "window_id", "left_semi")

    def feature_drift(self, only_critical: bool = True) -> DataFrame:
        rows = self.critical_rows if only_critical else self.assigned
        columns = [*self.numeric, *self.categorical]
        return drift.drift_table(
            self.reference, rows, self.numeric, self.categorical, self.rows, self._methods(columns), regime=self.regime
        )

    def _stacked(self, only_critical: bool) -> DataFrame:
        return profile.stack(self.reference, self.critical_rows if only_critical else self.assigned)

    def numeric_profile(self, only_critical: bool = True) -> DataFrame:
        return profile.numeric_profile(self._stacked(only_critical), self.numeric, self.rows)

    def category_profile(self, only_critical: bool = True) -> DataFrame:
        return profile.category_profile(self._stacked(only_critical), self.categorical)

    def reports(self) -> DataFrame:
        groups = quality.error_group_stats(self.grouped, ["window_id"])
        bias = quality.error_bias(self.grouped, self.numeric, ["window_id"])
        return critical.window_reports(self.flags, self.quality, groups, bias, self.target_drift)

    def report_json(self, run_time: str, model_type: str) -> DataFrame:
        """One JSON text per window and one for the summary, under the given run time."""
        windows = as_json(self.reports()).select(F.lit("window").alias("kind"), "report")
        stamped = self.summary.select(
            F.lit(run_time).alias("analysis_timestamp"), F.lit(model_type).alias("model_type"), "*"
        )
        return windows.unionByName(as_json(stamped).select(F.lit("summary").alias("kind"), "report"))
