"""The split path of every ordered operator gives the rows of the plain path."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from modelwake.operators import ordered
from modelwake.operators.ordered import asof_join, exact_percentiles, running_totals

PATHS = [10**9, 0]


def hot_rows(n=600, seed=5):
    """Two thirds of the rows in one group."""
    rng = random.Random(seed)
    return [("hot" if rng.random() < 0.67 else rng.choice("abc"), rng.randint(0, 5000)) for _ in range(n)]


@pytest.mark.parametrize("split_above", PATHS)
def test_running_totals(frame, split_above):
    rows = sorted(set(hot_rows()))
    df = frame([(g, x, x % 7) for g, x in rows], "g string, x int, v int")
    got = running_totals(df, ["g"], "x", ["v"], len(rows), split_above, previous=["x"]).collect()
    by_group = {}
    for r in sorted(got, key=lambda r: (r.g, r.x)):
        done, previous = by_group.get(r.g, (0, None))
        assert r.cum_v == done + r.v and r.prev_x == previous
        assert r.tot_v == sum(x % 7 for g, x in rows if g == r.g)
        by_group[r.g] = (r.cum_v, r.x)
    assert len(got) == len(rows)


@pytest.mark.parametrize("split_above", PATHS)
def test_percentiles(frame, split_above):
    rows = hot_rows()
    df = frame([*rows, ("hot", None)], "g string, x int")
    got = exact_percentiles(df, ["g"], "x", [0.0, 0.05, 0.5, 1.0], len(rows), split_above=split_above).collect()
    for r in got:
        values = sorted(x for g, x in rows if g == r.g)
        position = 0.05 * (len(values) - 1)
        low = values[int(position)]
        expected = low + (values[int(position) + 1] - low) * (position - int(position))
        assert r.q == pytest.approx([values[0], expected, statistics.median(values), values[-1]])


def brute_asof(spine, facts, strict, backward):
    out = []
    for key, t in spine:
        sign = 1 if backward else -1
        seen = [(ft, v) for fk, ft, v in facts if fk == key and (sign * ft < sign * t or (not strict and ft == t))]
        best = (max if backward else min)(seen, default=(None, None))
        out.append((key, t, best[1]))
    return sorted(out, key=str)


@pytest.mark.parametrize("split_above", PATHS)
@pytest.mark.parametrize("strict", [True, False])
@pytest.mark.parametrize("backward", [True, False])
def test_asof_join(frame, split_above, strict, backward):
    rng = random.Random(3)
    facts = sorted({(g, x) for g, x in hot_rows(300, 1)})
    facts = [(g, x, i) for i, (g, x) in enumerate(facts)]
    spine = hot_rows(300, 2) + [(None, 5), ("nobody", 7)] + [(g, x) for g, x, _ in rng.sample(facts, 50)]
    got = asof_join(
        frame(spine, "k string, t int"), frame(facts, "fk string, ft int, v int").withColumnRenamed("fk", "k"),
        "k", "t", "ft", ["v"], 1000, strict, backward, split_above,
    ).collect()
    assert sorted([(r.k, r.t, r.v) for r in got], key=str) == brute_asof(spine, facts, strict, backward)


def test_split_parts_spread_a_hot_group(frame):
    from modelwake.operators.ordered import range_split

    df = frame([("hot", i) for i in range(20_000)], "g string, x int")
    sizes = [r["count"] for r in range_split(df, ["g"], ["x"]).groupBy("_part").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * 20_000 / 8


def test_spine_rows_without_key_do_not_share_a_task(frame):
    spine = frame([(None, i) for i in range(2000)], "k string, t int")
    facts = frame([("a", 1, 1)], "k string, ft int, v int")
    joined = asof_join(spine, facts, "k", "t", "ft", ["v"], 2001)
    parts = joined.groupBy(F.spark_partition_id()).count().count()
    assert joined.count() == 2000 and parts > 1


def test_percentiles_of_infinite_and_missing_values_agree_on_both_paths(frame):
    inf = float("inf")
    rows = [("a", 1.0), ("a", inf), ("a", inf), ("a", inf), ("b", None), ("c", -inf), ("c", 2.0), ("c", 3.0), ("d", 4.0)]
    df = frame(rows, "g string, x double")
    points = [0.0, 0.25, 0.5, 0.75, 1.0]
    plain = {r.g: r.q for r in ordered.exact_percentiles(df, ["g"], "x", points, 100).collect()}
    split = {r.g: r.q for r in ordered.exact_percentiles(df, ["g"], "x", points, 100, split_above=0).collect()}
    assert plain == split and plain["b"] is None and plain["a"][1:] == [inf] * 4


def test_global_rank_numbers_all_rows(spark):
    df = spark.range(1000).selectExpr("id", "md5(string(id)) AS d")
    got = ordered.global_rank(df, ["d", "id"], "rank").collect()
    assert [r.rank for r in sorted(got, key=lambda r: (r.d, r.id))] == list(range(1, 1001))


def test_split_asof_join_has_no_join(frame):
    spine = frame([("hot", i) for i in range(50)], "k string, t int")
    facts = frame([("hot", 3 * i, i) for i in range(20)], "k string, ft int, v int")
    joined = asof_join(spine, facts, "k", "t", "ft", ["v"], 1000, split_above=0)
    assert "Join" not in joined._jdf.queryExecution().executedPlan().toString()
    assert [r.v for r in joined.orderBy("t").collect()] == [None, *[min((t - 1) // 3, 19) for t in range(1, 50)]]
