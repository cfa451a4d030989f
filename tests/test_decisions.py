"""Searches, ranks, corrected tests, findings and node tables against plain Python."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from modelwake.learning import nodes
from modelwake.learning.importance import tree_importance
from modelwake.learning.pipeline import boosted_classifier, forest_regression
from modelwake.operators import cohorts, drift, profile, sampling


def nulls_first(*values):
    return [(v is not None, v if v is not None else 0) for v in values]


@pytest.mark.parametrize("n", [0, 1, 40, 150, 260, 400, 1000])
def test_head(frame, n):
    pick = random.Random(4)
    # Two thirds of the rows share the first column; the last column tells all rows apart.
    rows = [(7 if pick.random() < 0.67 else pick.choice([None, 1, 9]), pick.choice([None, "a", "b"]), i) for i in range(400)]
    pick.shuffle(rows)
    got = sampling.head(frame(rows, "x int, y string, id int"), ["x", "y", "id"], n)
    expected = sorted(rows, key=lambda r: (nulls_first(r[0]), [(r[1] is not None, r[1] or "")], r[2]))[:n]
    assert Counter(map(tuple, got.collect())) == Counter(expected)


def test_head_takes_some_of_equal_rows_and_repeats_itself(frame):
    rows = [(1.0, "first")] + [(float("nan"), "last")] * 3 + [(2.0, f"t{i}") for i in range(30)]
    got = sampling.head(frame(rows, "x double, id string").repartition(5), ["x"], 11)
    once, again = Counter(map(tuple, got.collect())), Counter(map(tuple, got.collect()))
    assert once == again and sum(once.values()) == 11 and set(once.values()) == {1} and (1.0, "first") in once
    assert sampling.head(frame([], "x int"), ["x"], 5).count() == 0


def test_head_leaves_no_limit_in_the_plan(frame):
    got = sampling.head(frame([(i % 3, i) for i in range(50)], "x int, id int"), ["x", "id"], 20)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert got.count() == 20 and "GlobalLimit" not in plan


def test_cohort_ranks(frame):
    pick = random.Random(8)
    rows = [("all", None, 1000, 5.0)] + [("a", f"v{i}", 10 * pick.randrange(1, 4), float(pick.randrange(3, 9))) for i in range(200)]
    rows += [("b", "x", 0, None), ("b", "y", 10, 5.0), ("b", "z", 10, 7.0), ("b", "nan", 10, float("nan"))]
    got = cohorts.rank_cohorts(frame(rows, "cohort string, v string, n_rows long, mae double"), ["v"])
    ranks = {(r.cohort, r.v): r.impact_rank for r in got.collect()}
    value = {(c, v): round(n / 1000 * (m - 5.0), 9) for c, v, n, m in rows if c == "a"}
    levels = sorted(set(value.values()), reverse=True)
    assert {k: r for k, r in ranks.items() if k[0] == "a"} == {k: levels.index(x) + 1 for k, x in value.items()}
    assert [ranks["b", v] for v in ("nan", "z", "y", "x")] == [1, 2, 3, 4]


def benjamini_hochberg(p_values, alpha):
    ordered = sorted(p_values)
    limit = max((p for i, p in enumerate(ordered, 1) if p <= alpha * i / len(ordered)), default=-1.0)
    return {p: p <= limit for p in p_values}


@pytest.mark.parametrize("seed", range(3))
def test_step_up(frame, seed):
    pick = random.Random(seed)
    p_values = [round(pick.random() ** (4 if i % 3 else 1), 3) for i in range(60)]
    tests = frame([(i, p) for i, p in enumerate(p_values)] + [(99, None)], "id int, p_value double")
    got = {r.id: r.shifted for r in cohorts.step_up(tests, ["id"], 0.1).collect()}
    expected = benjamini_hochberg(p_values, 0.1)
    assert got.pop(99) is None and got == {i: expected[p] for i, p in enumerate(p_values)}
    assert 0 < sum(got.values()) < 60


def test_nothing_is_significant_among_even_p_values(frame):
    tests = frame([(i, (i + 1) / 20) for i in range(20)], "id int, p_value double")
    assert cohorts.step_up(tests, ["id"]).where("shifted").count() == 0
    assert cohorts.step_up(tests.limit(0), ["id"]).count() == 0


def test_cohort_shift_tests(frame):
    pick = random.Random(2)
    ref = frame([(pick.gauss(0, 1), pick.choice("ab")) for _ in range(800)], "x double, c string")
    # One cohort as before, one moved, one with other categories.
    rows = [("same", pick.gauss(0, 1), pick.choice("ab")) for _ in range(300)]
    rows += [("moved", pick.gauss(1, 1), pick.choice("ab")) for _ in range(300)]
    rows += [("mixed", pick.gauss(0, 1), pick.choice("abbbbz")) for _ in range(300)]
    got = cohorts.cohort_shift_tests(ref, frame(rows, "g string, x double, c string"), "g", ["x"], ["c"], 2000).collect()
    assert {(r.g, r.feature): r.shifted for r in got} == {
        ("same", "x"): False, ("same", "c"): False, ("moved", "x"): True, ("moved", "c"): False, ("mixed", "x"): False, ("mixed", "c"): True,
    }


def test_prior_shift_is_tested(frame):
    ref = frame([("a",)] * 60 + [("b",)] * 40, "y string")
    cur = frame([("a", 1)] * 60 + [("b", 1)] * 40 + [("a", 2)] * 20 + [("b", 2)] * 80, "y string, window_id int")
    got = {r.window_id: (r.chi2, r.chi2_p_value) for r in drift.prior_shift(ref, cur, "y").collect()}
    assert got[1] == (pytest.approx(0), 1.0)
    assert got[2][0] == pytest.approx((20 - 60) ** 2 / 60 + (80 - 40) ** 2 / 40) and got[2][1] < 1e-9


def test_category_mismatch(frame):
    train = frame([("a", 1), ("a", 2), ("b", 1), (None, 1)], "c string, n int")
    serving = frame([("b", 1), ("z", 1)], "c string, n int")
    got = profile.category_mismatch(train, serving, ["c", "n"]).collect()
    assert {(r.feature, r.value, r.n_train, r.n_serving, r.only_in) for r in got} == {
        ("c", "a", 2, 0, "train"), ("c", "z", 0, 1, "serving"), ("n", "2", 1, 0, "train"),
    }


def test_model_findings(frame):
    pick = random.Random(6)
    grid = [0.25, 0.5, 0.75]
    segments = {"fine": (0.5, 0.5, "ab"), "rare": (0.02, 0.5, "ab"), "late": (0.5, 0.75, "ab"), "new": (0.5, 0.5, "abq"), None: (0.5, 0.5, "ab")}
    rows = []
    for name, (share, cut, values) in segments.items():
        for i in range(400):
            y = int(i < share * 400)
            rows.append((name, values[i % len(values)], y, pick.uniform(cut, 1) if y else pick.uniform(0, cut - 1e-6)))
    rows += [("fine", "a", None, 0.1), ("fine", "a", 1, None)]
    df = frame(rows, "s string, c string, y int, p double")
    got = cohorts.model_findings(df.where("c <> 'q'"), df, "s", ["c"], "y", "p", grid).collect()
    f1 = defaultdict(dict)
    for s, _, y, p in rows:
        for t in grid if None not in (y, p) else []:
            tp, n = f1[s].get(t, (0, 0))
            f1[s][t] = (tp + (y == 1 and p >= t), n + (y == 1) + (p >= t))
    moved = {s for s, at in f1.items() if max(2 * a / b for a, b in at.values()) - 2 * at[0.5][0] / at[0.5][1] > 0.01}
    found = {(r.s, r.finding): r.evidence for r in got}
    assert {s for s, f in found if f == "threshold"} == moved == {"late"} and found["late", "threshold"] == 0.75
    assert found["rare", "rare_class"] == pytest.approx(0.02) and found["new", "new_categories"] == 1.0
    assert len(found) == 3
    actions = cohorts.recommend(cohorts.model_findings(df, df, "s", ["c"], "y", "p", grid)).collect()
    assert len(actions) == 2 and all(r.action for r in actions)
    with pytest.raises(ValueError):
        cohorts.model_findings(df, df, "s", ["c"], "y", "p", [0.1])


@pytest.fixture(scope="module")
def measured(spark):
    pick = random.Random(3)
    rows = [(i, pick.uniform(0, 10), pick.choice("abcdef"), pick.gauss(0, 1)) for i in range(400)]
    rows = [(i, x, c, 3 * x + "abcdef".index(c) % 3 * 5 + e, int(x + e > 5)) for i, x, c, e in rows]
    return spark.createDataFrame(rows, "id long, x double, c string, y double, big int")


def walk(table, tree, vector):
    node = table[tree, 0]
    while node.left_child >= 0:
        x = vector[node.feature]
        left = x <= node.threshold if node.categories is None else x in node.categories
        node = table[tree, node.left_child if left else node.right_child]
    return node.prediction


def test_forest_as_a_table(spark, measured):
    model = forest_regression(measured, ["x"], ["c"], "y", trees=7, maxDepth=4)
    table = nodes.node_table(model.stages[-1], spark).cache()
    scored = model.transform(measured).select("id", "_features", "prediction").cache()
    got = {r.id: r.score for r in nodes.forest_scores(scored, ["id"], "_features", table).collect()}
    assert got == pytest.approx({r.id: r.prediction for r in scored.collect()})
    by_node = {(r.tree, r.node): r for r in table.collect()}
    for r in nodes.leaves(scored.limit(20), ["id", "_features"], "_features", table).collect():
        assert r.prediction == walk(by_node, r.tree, r._features)
    own = {r.feature: r.importance for r in nodes.node_importance(table, ["x", "c"]).collect()}
    assert own == pytest.approx({r.feature: r.importance for r in tree_importance(model, ["x", "c"], spark).collect()})


def test_boosted_model_as_a_table(spark, measured):
    train, valid = measured.where("id % 4 > 0"), measured.where("id % 4 = 0")
    model = boosted_classifier(train, valid, ["x"], ["c"], "big", rounds=6)
    table = nodes.node_table(model.stages[-1], spark)
    scored = model.transform(measured).select("id", "_features", "prediction")
    got = {r.id: float(r.score > 0) for r in nodes.boosted_scores(scored, ["id"], "_features", table).collect()}
    assert got == {r.id: r.prediction for r in scored.collect()}
