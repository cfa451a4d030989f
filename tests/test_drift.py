import math
import random

import pytest
from pyspark.sql import functions as F

from modelwake.operators import drift

REF, CUR = "x double, c string, b int", "window_id int, x double, c string, b int"


def samples(seed=1, n_ref=250, n_cur=160):
    rng = random.Random(seed)
    ref = [(round(rng.gauss(0, 3), 1), rng.choice("aabc"), rng.randint(0, 1)) for _ in range(n_ref)]
    cur = [(1 + i % 2, round(rng.gauss(1 + i % 2, 2), 1), rng.choice("abbc"), int(rng.random() < 0.7)) for i in range(n_cur)]
    cur += [(3, 50.0, "new", 0), (3, -50.0, "a", 1), (4, 0.5, "a", 1)]
    return ref, cur


@pytest.fixture
def data(frame):
    ref, cur = samples()
    return ref, cur, frame(ref, REF), frame(cur, CUR)


def cdf(values, x):
    return sum(v <= x for v in values) / len(values)


def by_window(cur, i):
    return {w: [r[i] for r in cur if r[0] == w] for w in {r[0] for r in cur}}


@pytest.mark.parametrize("split_above", [10**9, 0])
def test_ks_is_the_largest_gap_of_the_pooled_sample(data, split_above):
    ref, cur, rdf, cdf_ = data
    reference = [r[0] for r in ref]
    for row in drift.ks(rdf, cdf_, ["x"], 1000, split_above).collect():
        mine = by_window(cur, 1)[row.window_id]
        expected = max(abs(cdf(reference, x) - cdf(mine, x)) for x in {*reference, *mine})
        assert row.statistic == pytest.approx(expected)


@pytest.mark.parametrize("split_above", [10**9, 0])
def test_wasserstein_is_the_area_between_the_curves(data, split_above):
    ref, cur, rdf, cdf_ = data
    reference = [r[0] for r in ref]
    centre = sum(reference) / len(reference)
    spread = math.sqrt(sum((x - centre) ** 2 for x in reference) / len(reference))
    for row in drift.wasserstein(rdf, cdf_, ["x"], 1000, split_above).collect():
        mine = by_window(cur, 1)[row.window_id]
        points = sorted({*reference, *mine})
        area = sum(abs(cdf(reference, a) - cdf(mine, a)) * (b - a) for a, b in zip(points, points[1:]))
        assert row.statistic == pytest.approx(area / spread)


def test_chi_square_and_new_categories(data):
    ref, cur, rdf, cdf_ = data
    shares = {c: sum(r[1] == c for r in ref) / len(ref) for c in "abc"}
    for row in drift.chi_square(rdf, cdf_, ["c"]).collect():
        mine = by_window(cur, 2)[row.window_id]
        if "new" in mine:
            assert row.p_value == 0.0 and row.new_categories == 1
            continue
        expected = sum((mine.count(c) - p * len(mine)) ** 2 / (p * len(mine)) for c, p in shares.items())
        assert row.statistic == pytest.approx(expected) and row.df == 2
        assert row.p_value == pytest.approx(math.exp(-expected / 2))


def test_jensen_shannon_with_missing_and_new_categories(data):
    ref, cur, rdf, cdf_ = data
    for row in drift.jensen_shannon(rdf, cdf_, ["c"]).collect():
        mine = by_window(cur, 2)[row.window_id]
        total = 0.0
        for c in {*mine, "a", "b", "c"}:
            p, q = sum(r[1] == c for r in ref) / len(ref), mine.count(c) / len(mine)
            total += p * math.log(2 * p / (p + q)) if p else 0
            total += q * math.log(2 * q / (p + q)) if q else 0
        assert row.statistic == pytest.approx(math.sqrt(total / 2))


def test_proportion_z(data):
    ref, cur, rdf, cdf_ = data
    h, n = sum(r[2] == 0 for r in ref), len(ref)
    for row in drift.proportion_z(rdf, cdf_, ["b"]).collect():
        mine = by_window(cur, 3)[row.window_id]
        k, m = mine.count(0), len(mine)
        pool = (h + k) / (n + m)
        z = (k / m - h / n) / math.sqrt(pool * (1 - pool) * (1 / n + 1 / m))
        assert row.statistic == pytest.approx(z)
        assert row.p_value == pytest.approx(math.erfc(abs(z) / math.sqrt(2)))


def test_binned_divergence_is_zero_without_drift(frame):
    rows = [(float(i % 50), "a", 0) for i in range(500)]
    df = frame(rows, REF)
    row = drift.binned_divergence(df, df.withColumn("window_id", F.lit(1)), ["x"], 1000).first()
    assert row.psi == pytest.approx(0) and row.kl == pytest.approx(0)


def test_method_choice(frame):
    rows = [(float(i), "abcdefg"[i % 7], i % 2) for i in range(100)]
    df = frame(rows, REF)
    assert drift.choose_methods(df, ["x"], ["c", "b"], regime="test") == {"x": "ks", "c": "chi2", "b": "z"}
    assert drift.choose_methods(df, ["x"], ["c"], {"c": "psi"})["c"] == "psi"
    assert drift.choose_methods(df, ["x"], ["c"]) == {"x": "wasserstein", "c": "jensen_shannon"}
    assert drift.choose_methods(df.unionAll(df), ["x"], ["c"]) == {"x": "wasserstein", "c": "jensen_shannon"}
    with pytest.raises(ValueError, match="regime"):
        drift.choose_methods(df, ["x"], [], regime="other")


def test_nulls_infinities_and_changed_types(frame):
    """A feature without reference values is new; infinite values leave other windows alone; 1 and 1.0 are one category."""
    ref = frame([(None, float(i), i % 3) for i in range(30)], "new double, x double, c int")
    rows = [(1.0, float(i), float(i % 3), 1) for i in range(30)]
    rows += [(2.0, float("inf") if i == 3 else float("nan") if i == 4 else float(i), float(i % 3), 2) for i in range(30)]
    cur = frame(rows, "new double, x double, c double, window_id int")
    for regime in ("distance", "test"):
        table = {(r.window_id, r.feature): r for r in drift.drift_table(ref, cur, ["new", "x"], ["c"], 1000, regime=regime).collect()}
        assert table[1, "new"].statistic is None and table[1, "new"].detected
        assert not table[1, "x"].detected and not table[2, "x"].detected
        assert not table[1, "c"].detected and table[1, "c"].method in ("jensen_shannon", "chi2")


def test_vanished_class_has_a_row(frame):
    ref = frame([("a",), ("a",), ("b",), ("b",)], "y string")
    cur = frame([("a", 1), ("c", 1), ("b", 2)], "y string, window_id int")
    got = {(r.window_id, r.label): (r.share, r.ref_share) for r in drift.prior_shift(ref, cur, "y").collect()}
    assert got == {(1, "a"): (0.5, 0.5), (1, "b"): (0.0, 0.5), (1, "c"): (0.5, 0.0), (2, "a"): (0.0, 0.5), (2, "b"): (1.0, 0.5)}


def test_drift_table_directions(data):
    _, _, rdf, cdf_ = data
    table = drift.drift_table(rdf, cdf_, ["x"], ["c", "b"], 1000, regime="test").collect()
    assert {r.method for r in table} == {"ks", "chi2", "z"}
    for r in table:
        assert r.detected == (r.p_value < 0.05) and r.intensity == pytest.approx(1 - r.p_value)
    distances = drift.drift_table(rdf, cdf_, ["x"], [], 1000, {"x": "wasserstein"}).collect()
    for r in distances:
        assert r.p_value is None and r.intensity == r.score and r.detected == (r.score >= 0.1)


def test_every_method_can_be_chosen(data):
    _, _, rdf, cdf_ = data
    for method in ("psi", "kl"):
        rows = drift.drift_table(rdf, cdf_, ["x"], [], 1000, {"x": method}).collect()
        assert {r.method for r in rows} == {method} and len(rows) == 4


def test_reference_is_not_repeated_per_window(data):
    """No cross join or nested loop over window and reference values is planned."""
    _, _, rdf, cdf_ = data
    for df in (drift.ks(rdf, cdf_, ["x"], 1000), drift.wasserstein(rdf, cdf_, ["x"], 1000)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan
