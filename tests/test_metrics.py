import math

import pytest
from pyspark.sql import functions as F

from modelwake.functions import metrics as M
from modelwake.functions.exprs import chi2_tail, erfc, ks_tail, normal_two_sided

BINARY = [(0, 0), (0, 1), (1, 1), (1, 1), (1, 0), (0, 0)]
PAIRS = [(1.0, 1.1), (2.0, 2.2), (3.0, 2.8), (4.0, 4.2), (5.0, 4.8)]


def test_confusion_and_rates(frame):
    row = M.with_rates(M.confusion(frame(BINARY, "y int, p int"), "y", "p")).first()
    assert (row.tn, row.fp, row.fn, row.tp) == (2, 1, 1, 2)
    assert row.false_negative_rate == pytest.approx(1 / 3)
    assert row.false_positive_rate == pytest.approx(1 / 3)
    assert row.selection_rate == 0.5


def test_confusion_with_swapped_classes(frame):
    row = M.confusion(frame(BINARY, "y int, p int"), "y", "p", negative=1, positive=0).first()
    assert (row.tn, row.fp, row.fn, row.tp) == (2, 1, 1, 2)


def test_selection_rate_is_prevalence_not_predicted_share(frame):
    rows = [(1, 1), (0, 1), (0, 1), (0, 0)]
    row = M.with_rates(M.confusion(frame(rows, "y int, p int"), "y", "p")).first()
    assert row.selection_rate == 0.25
    assert row.predicted_positive_rate == 0.75


def test_classification_bundle(frame):
    row = M.classification_metrics(frame(BINARY, "y int, p int"), "y", "p").first()
    assert set(row.asDict()) == set(M.CLASSIFICATION)
    assert row.accuracy_score == pytest.approx(0.6666666)


def test_regression_bundle(frame):
    row = M.regression_metrics(frame(PAIRS, "y double, p double"), "y", "p", rows=5).first()
    assert row.mean_prediction == pytest.approx(3.02)
    assert row.mean_absolute_error == pytest.approx(0.18, abs=0.01)
    assert row.r2_score == pytest.approx(0.98, abs=0.01)


def test_regression_bundle_is_the_same_on_the_split_path(frame, monkeypatch):
    df = frame([(1.0 * i, i + (i * 7 % 5) / 3.0, i % 2) for i in range(50)], "y double, p double, g int")
    small = M.regression_metrics(df, "y", "p", ["g"], rows=50).orderBy("g").collect()
    monkeypatch.setattr(M, "SPLIT_ROWS", 0)
    large = M.regression_metrics(df, "y", "p", ["g"], rows=50).orderBy("g").collect()
    for a, b in zip(small, large):
        assert a.asDict() == pytest.approx(b.asDict())


@pytest.mark.parametrize(
    "rows, expected",
    [([(1, 1), (2, 2), (3, 4), (4, 4)], 0.25), ([], 0.0), ([(0.0, 0.4), (0.0, 0.4)], 0.0)],
)
def test_error_rate(frame, rows, expected):
    df = frame([(float(a), float(b)) for a, b in rows], "y double, p double")
    assert df.agg(M.error_rate(F.col("y"), F.col("p")).alias("e")).first().e == expected


def test_error_rate_with_given_difference(frame):
    df = frame([(0,), (0,), (1,), (0,)], "d int")
    assert df.agg(M.error_rate(F.col("d"), F.col("d"), F.col("d")).alias("e")).first().e == 0.25


@pytest.mark.parametrize(
    "rows, accuracy", [([(0, 0), (1, 1)], 1.0), ([(0, 1), (1, 0)], 0.0), ([(0, 0), (0, 1), (1, 1), (1, 0)], 0.5)]
)
def test_accuracy(frame, rows, accuracy):
    assert M.classification_metrics(frame(rows, "y int, p int"), "y", "p").first().accuracy_score == accuracy


@pytest.mark.parametrize(
    "rows, mae", [([(1, 1), (2, 2)], 0.0), ([(1, 2), (2, 3)], 1.0), ([(1, 1.5), (2, 2.5), (3, 3.5)], 0.5)]
)
def test_mean_absolute_error(frame, rows, mae):
    df = frame([(float(a), float(b)) for a, b in rows], "y double, p double")
    assert M.regression_metrics(df, "y", "p", rows=3).first().mean_absolute_error == mae


def test_constant_target_has_no_r2(frame):
    df = frame([(1.0, 1.0), (1.0, 2.0)], "y double, p double")
    assert M.regression_metrics(df, "y", "p", rows=2).first().r2_score is None


def test_auc_counts_ties_half_on_both_paths(frame):
    scores = [(i % 3 == 0, (i * 5 % 7) / 7.0) for i in range(40)]
    df = frame([(int(y), s) for y, s in scores], "y int, s double")
    pos, neg = [s for y, s in scores if y], [s for y, s in scores if not y]
    wins = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    for split_above in (10**9, 0):
        assert M.auc(df, "y", "s", 40, split_above=split_above).first().auc == pytest.approx(wins)


def test_hard_label_auc_equals_the_rank_auc(frame):
    df = frame([(y, float(p)) for y, p in BINARY], "y int, p double")
    ranked = M.auc(df, "y", "p", 6).first().auc
    assert M.classification_metrics(df, "y", "p").first().auc_score == pytest.approx(ranked)


def test_weighted_scores_of_three_classes(frame):
    rows = [("a", "a"), ("a", "b"), ("b", "b"), ("b", "b"), ("c", "a")]
    row = M.weighted_prf(frame(rows, "y string, p string"), "y", "p").first()
    assert row.precision == pytest.approx((2 * 0.5 + 2 * (2 / 3) + 0) / 5)
    assert row.recall == pytest.approx((2 * 0.5 + 2 * 1.0 + 0) / 5)


def test_metric_report_keeps_going_after_an_unknown_metric(frame):
    df = frame(PAIRS, "y double, p double")
    rows = {r.metric: r for r in M.metric_report(df, "y", "p", "regression", ["mae", "nope"]).collect()}
    assert rows["mae"].value == pytest.approx(0.18)
    assert rows["nope"].value is None and "nope" in rows["nope"].error
    assert {r.metric for r in M.metric_report(df, "y", "p", "regression").collect()} == {"mse", "mae", "r2"}
    with pytest.raises(ValueError):
        M.metric_report(df, "y", "p", "ranking")


def test_degradation_table(frame):
    df = frame([(0, 0, 0), (1, 1, 0), (1, 1, 1), (0, 0, 1)], "y int, a int, b int")
    rows = {r.metric: r for r in M.model_degradation(df, "y", "a", "b").collect()}
    assert rows["accuracy"].regular == 1.0 and rows["accuracy"].degradation_pct == 50.0
    assert set(rows) == set(M.COMPARED)


def test_tail_probabilities(spark):
    values = [0.0, 0.01, 0.5, 1.0, 2.0, 2.99, 3.0, 4.5, 8.0]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for row in df.select("x", erfc(F.col("x")).alias("e"), normal_two_sided(F.col("x")).alias("z")).collect():
        assert row.e == pytest.approx(math.erfc(row.x), rel=1e-9, abs=1e-13)
        assert row.z == pytest.approx(math.erfc(row.x / math.sqrt(2)), rel=1e-9, abs=1e-13)


def chi2_reference(x: float, df: int) -> float:
    """Upper tail by the recurrence over the degrees of freedom, in plain floats."""
    tail = math.erfc(math.sqrt(x / 2)) if df % 2 else math.exp(-x / 2)
    for k in range(3 if df % 2 else 4, df + 1, 2):
        tail += (x / 2) ** (k / 2 - 1) * math.exp(-x / 2) / math.gamma(k / 2)
    return tail


@pytest.mark.parametrize("df", [1, 2, 3, 4, 5, 10, 31])
def test_chi_square_tail(spark, df):
    frame = spark.createDataFrame([(x, df) for x in (0.1, 1.0, 5.0, 20.0, 60.0)], "x double, df int")
    for row in frame.select("x", chi2_tail(F.col("x"), F.col("df")).alias("p")).collect():
        assert row.p == pytest.approx(chi2_reference(row.x, df), rel=1e-9)


def test_known_chi_square_quantiles(spark):
    frame = spark.createDataFrame([(3.841459, 1), (5.991465, 2), (11.070498, 5)], "x double, df int")
    for row in frame.select(chi2_tail(F.col("x"), F.col("df")).alias("p")).collect():
        assert row.p == pytest.approx(0.05, abs=1e-6)


def test_ks_tail(spark):
    frame = spark.createDataFrame([(0.0, 10, 10), (0.5, 20, 20), (1.0, 100, 100)], "d double, n int, m int")
    p = [r.p for r in frame.select(ks_tail(F.col("d"), F.col("n"), F.col("m")).alias("p")).collect()]
    assert p[0] == 1.0 and 0.005 < p[1] < 0.02 and p[2] < 1e-10


def test_given_differences_are_cut_after_the_sum(frame):
    df = frame([(0.5,), (0.5,), (0.5,), (0.5,)], "d double")
    assert df.agg(M.error_rate(F.col("d"), F.col("d"), F.col("d")).alias("e")).first().e == 0.5


def test_rows_without_both_values_are_not_scored(frame):
    rows = [(1, 1), (1, 0), (0, 1), (0, 0), (1, None), (None, 1), (None, None)]
    df, plain = frame(rows, "y int, p int"), frame(rows[:4], "y int, p int")
    for make in (M.classification_metrics, M.class_report, M.weighted_prf):
        assert sorted(make(df, "y", "p").collect()) == sorted(make(plain, "y", "p").collect())
    assert M.metric_report(df, "y", "p", "binary_classification").collect() == M.metric_report(plain, "y", "p", "binary_classification").collect()
