import json
from dataclasses import replace
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from modelwake.operators import cohorts, critical, profile, quality, views
from modelwake.plans.monitoring import MonitoringRun
from modelwake.sources import files

FLAG = "window_id int, drifted array<string>, is_critical boolean"


@pytest.mark.parametrize(
    "n_critical, total, status", [(0, 4, "stable"), (2, 4, "warning"), (3, 4, "critical"), (2, 3, "critical"), (1, 3, "warning")]
)
def test_status(frame, n_critical, total, status):
    flags = frame([(i, ["b", "a"] if i < n_critical else [], i < n_critical) for i in range(total)], FLAG)
    row = critical.summarize(flags).first()
    assert (row.status, row.critical_windows, row.total_windows) == (status, n_critical, total)
    assert row.drifted_features == (["a", "b"] if n_critical else [])


@pytest.mark.parametrize("r2, poor", [(0.6994, True), (0.6996, False), (0.7, False), (None, True)])
def test_the_rounded_r2_is_compared(frame, r2, poor):
    df = frame([(r2,)], "r2_score double").select(critical.poor_performance().alias("poor"))
    assert df.first().poor is poor


@pytest.fixture
def run(frame):
    start = datetime(2024, 1, 1)
    rows = []
    for i in range(800):
        late = i >= 600
        rows.append((start + timedelta(hours=i), float(i % 10), (i % 10) + (8.0 if late and i % 2 else 0.1), float(i % 7), "ab"[i % 2]))
    df = frame(rows, "ts timestamp_ntz, y double, p double, k double, c string")
    cut = start + timedelta(hours=300)
    reference = df.where(F.col("ts") <= F.lit(str(cut)).cast("timestamp_ntz"))
    current = df.where(F.col("ts") >= F.lit(str(cut)).cast("timestamp_ntz"))
    return MonitoringRun(reference, current, "ts", "y", "p", ["k"], ["c"])


def test_run_flags_the_late_windows(run):
    # Windows of 37 rows: a test knows what chance does to them, a distance does not.
    run = replace(run, regime="test")
    flags = run.flags.orderBy("window_id").collect()
    assert len(flags) == run.plan.count == 20
    assert not flags[0].is_critical and flags[-1].is_critical and flags[-1].poor_performance
    assert run.summary.first().total_windows == 20


def test_methods_of_single_columns(run):
    named = replace(run, methods={"p": "ks", "k": "psi", "c": "chi2"})
    assert {r.method for r in named.target_drift.where("feature = 'p'").collect()} == {"ks"}
    assert {r.method for r in named.target_drift.where("feature = 'y'").collect()} == {"wasserstein"}
    assert {(r.feature, r.method) for r in named.feature_drift(False).collect()} == {("k", "psi"), ("c", "chi2")}


def test_only_critical_windows_are_profiled(run):
    critical_ids = {r.window_id for r in run.flags.where("is_critical").collect()}
    assert {r.window_id for r in run.critical_rows.select("window_id").distinct().collect()} == critical_ids
    assert {r.window_id for r in run.feature_drift().collect()} == critical_ids
    assert {r.window_id for r in run.numeric_profile().collect()} == critical_ids | {0}
    assert {r.window_id for r in run.category_profile().collect()} == critical_ids | {0}


def test_report_json(run):
    texts = run.report_json("2024-05-01T00:00:00", "forest").collect()
    windows = sorted((json.loads(t.report) for t in texts if t.kind == "window"), key=lambda w: w["window_id"])
    summary = [json.loads(t.report) for t in texts if t.kind == "summary"][0]
    assert len(windows) == 20 and summary["model_type"] == "forest"
    assert set(windows[0]["metrics"]) == {"r2_score", "rmse", "mean_error", "error_std"}
    assert set(windows[0]["error_distribution"]) == {"majority", "underestimation", "overestimation"}
    assert "k" in windows[0]["feature_performance"] and "y" in windows[0]["drift_analysis"]["feature_scores"]
    assert windows[0]["time_range"]["start"].startswith("2024-01-13T12:00:00")


def test_reports_survive_the_round_trip(spark, run, tmp_path):
    files.write_json_report(run.reports(), str(tmp_path / "r"))
    got = {r.window_id: r for r in files.read_window_reports(spark, str(tmp_path / "r")).collect()}
    windows = {r.window_id: r for r in run.windows.collect()}
    assert len(got) == 20
    for r in run.reports().collect():
        back = got[r.window_id]
        assert (back.metrics, back.error_distribution, back.is_critical) == (r.metrics, r.error_distribution, r.is_critical)
        assert (back.time_range.start, back.time_range.end) == windows[r.window_id][1:3]
        assert back.drift_analysis.drifted_features == r.drift_analysis.drifted_features and back.feature_performance == r.feature_performance
        assert back.drift_analysis.feature_scores == r.drift_analysis.feature_scores
    bare = str(tmp_path / "bare")
    spark.createDataFrame([('{"window_id": 3, "time_range": {"start": "unknown"}, "metrics": {"rmse": 2.5}}',)], "value string").write.text(bare)
    row = files.read_window_reports(spark, bare).first()
    assert row.metrics.rmse == 2.5 and row.metrics.r2_score == 0.0 and row.error_distribution.majority.std == 0.0
    assert row.time_range.start is None and row.drift_analysis.drifted_features == [] and row.feature_performance == {} and row.is_critical is False


def test_series_fills_windows_without_values(run):
    only_first = run.quality.where("window_id = 1")
    rows = quality.performance_series(only_first, run.windows).orderBy("window_id").collect()
    assert rows[0].r2_score > 0.9 and rows[5].r2_score == 0.0 and rows[9].label == "Window 10"


@pytest.mark.parametrize("rows", [10, 10**9])
def test_error_groups_on_both_paths(frame, rows):
    df = frame([(1, 0.0, float(i)) for i in range(101)], "window_id int, y double, p double")
    groups = quality.with_error_groups(df, "y", "p", ["window_id"], rows)
    got = {r.error_group: r.n_rows for r in quality.error_group_stats(groups, ["window_id"]).collect()}
    assert got == {"underestimation": 6, "overestimation": 6, "majority": 89}


def test_drift_matrix_and_boxes(frame):
    table = frame([(1, "k", 0.5), (12, "k", 0.25), (2, "c", 1.0)], "window_id int, feature string, intensity double")
    rows = {r.feature: r for r in views.drift_matrix(table, [1, 2, 12]).collect()}
    assert rows["k"].asDict() == {"feature": "k", "w1": 0.5, "w2": 0.0, "w12": 0.25}
    assert views.box_stats(table, "intensity").where("feature = 'k'").first().median == 0.375


def test_quality_delta_can_use_zero_for_categories(frame):
    df = frame([(0, "a"), (0, "b"), (1, "a")], "window_id int, c string")
    table = profile.category_profile(df, ["c"])
    assert profile.quality_delta(table, 1).first().mean_diff is None
    row = profile.quality_delta(table, 1, zero_for_missing=True).first()
    assert row.mean_diff == 0.0 and row.unique_diff == 0.0


def test_patterns(frame):
    def pattern(values):
        series = frame([(i, float(v)) for i, v in enumerate(values)], "window_id int, m double")
        return cohorts.drop_pattern(series, "m").first()

    assert pattern([1, 1, 1, 0.2, 0.9, 1, 0.95]).pattern == "sudden"
    assert pattern([1, 0.9, 0.8, 0.7, 0.6]).pattern == "gradual"
    assert pattern([1, 1, 1, 0, 0, 0]).pattern == "mixed"
    assert pattern([0.5, 0.5, 0.5]).pattern == "no clear pattern"
    assert pattern([1, 1, 1, 0, 0, 0]).drop_window == 3


def test_hot_query_in_ranking(frame):
    rows = [(1, i, float(i % 97), i % 5 == 0) for i in range(2000)] + [(2, 9000, 1.0, False)]
    df = frame(rows, "q int, id int, s double, rel boolean")
    got = {r.q: r for r in cohorts.ranking_metrics(df, "q", "s", F.col("rel"), "id", 10).collect()}
    best = sorted(rows[:2000], key=lambda r: (-r[2], r[1]))[:10]
    assert got[1].precision_at_k == sum(r[3] for r in best) / 10 and got[1].n_relevant == 400
    assert got[2].ndcg_at_k == 0.0 and got[2].recall_at_k is None


def test_recommendations_cover_unknown_findings(frame):
    rows = cohorts.recommend(frame([("stable",), ("other",)], "finding string")).collect()
    assert {r.finding: r.action is None for r in rows} == {"stable": False, "other": True}
