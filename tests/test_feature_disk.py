"""What the feature tables leave on disk while they are built, and the steps changed for it."""

import os
import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from modelwake.operators import rolling
from modelwake.operators.joins import interval_join
from modelwake.plans import features as P
from modelwake.session import checkpoint_root, discard, materialize
from modelwake.sources import tables

DAY = timedelta(days=1)
TS = datetime(2020, 3, 2)
TXN = "customer_id long, article_id long, t_dat timestamp_ntz, price double, sales_channel_id int"


@pytest.fixture
def shop(frame):
    rng = random.Random(5)
    txns = [
        (rng.choice([1, 2, 3, None]), rng.choice([10, 11, 12]), TS - rng.randint(-3, 90) * DAY, float(rng.randint(1, 9)), rng.randint(1, 2))
        for _ in range(200)
    ]
    articles = [(10, "d1", "s2", 5), (11, "d0", "s1", 12), (12, "d1", "s1", None)]
    customers = [(1, 30.0, "x", None, "ACTIVE", "none"), (2, None, None, 1, None, None)]
    return (
        frame(txns, TXN),
        frame(articles, "article_id long, department_no string, section_no string, perceived_colour_master_id int"),
        frame(customers, "customer_id long, age double, FN string, Active int, club_member_status string, fashion_news_frequency string"),
    )


def folders(spark) -> set[str]:
    root = checkpoint_root(spark).removeprefix("file:")
    return {x for x in (os.listdir(root) if os.path.isdir(root) else ()) if x.startswith("stage-")}


def read_by(df) -> set[str]:
    return {os.path.basename(os.path.dirname(x)) for x in df.inputFiles()}


def shuffle_files(spark) -> set[str]:
    found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {x for x in (found.apply(i).getName() for i in range(found.size())) if x.startswith("shuffle_")}


def exchanges(df) -> list[str]:
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    return [line for line in plan.splitlines() if "Exchange " in line]


def test_a_stored_table_leaves_no_shuffle_files(spark):
    before = shuffle_files(spark)
    stored = materialize(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    for _ in range(50):
        if not shuffle_files(spark) - before:
            break
        time.sleep(0.1)
    assert not shuffle_files(spark) - before
    assert stored.count() == 7
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
    discard(stored)
    assert not folders(spark) & read_by(stored)


def test_churn_features_keep_only_the_tables_that_are_read(spark, frame, shop):
    txns, articles, customers = shop
    labels = frame([(c, t, 0) for c in (1, 2, None) for t in (TS, TS - 28 * DAY)], "customer_id long, timestamp timestamp_ntz, churn int")
    before = folders(spark)
    table = P.churn_features(labels, txns, articles, customers, rows=1000)
    assert table.count() == 6
    assert folders(spark) - before == read_by(table)
    # The daily rows, label rows and weekly rows meet in one shuffle, by customer; the other one is of the customers.
    assert len([x for x in exchanges(table) if "Exchange hashpartitioning" in x and "_t" in x]) == 0
    assert len([x for x in exchanges(table) if "REPARTITION_BY_NUM" in x]) == 1


def test_item_sales_features_keep_only_the_tables_that_are_read(spark, frame, shop):
    txns, articles, customers = shop
    labels = frame([(a, t, 1.0) for a in (10, 12, 55, None) for t in (TS, TS - 28 * DAY)], "article_id long, timestamp timestamp_ntz, sales double")
    before = folders(spark)
    table = P.item_sales_features(labels, txns, articles, customers, rows=1000)
    assert table.count() == 8
    assert folders(spark) - before == read_by(table)
    # Labels and sales are dealt out by label as they are: no partial sums, which have a column per week and figure.
    assert len(exchanges(table)) == 2


def test_week_buckets_keep_only_the_tables_that_are_read(spark, frame, shop):
    txns, articles, _ = shop
    labels = frame([(c, t) for c in (1, 2, None) for t in (TS, TS - 28 * DAY)], "customer_id long, timestamp timestamp_ntz")
    before = folders(spark)
    grain = P.stored_grain(txns)
    table = P.week_buckets(labels, grain, articles, 1000, tidy=True)
    got = {(r.customer_id, r.timestamp): r for r in table.collect()}
    assert folders(spark) - before == read_by(table)
    plain = P.week_buckets(labels, P.stored_grain(txns), articles, 1000)
    assert got == {(r.customer_id, r.timestamp): r for r in plain.collect()}
    assert len(got) == 6


def test_weekly_aggregates_leave_the_grain_to_its_owner(spark, frame, shop):
    txns, articles, _ = shop
    labels = frame([(1, TS)], "customer_id long, timestamp timestamp_ntz")
    grain = P.stored_grain(txns)
    weekly = P.weekly_aggregates(labels, grain, articles, 1000)
    assert weekly.count() == 1 and grain.count() == rolling.purchase_grain(txns).count()


def test_interval_join_lists_an_interval_once_in_most_blocks(frame):
    spine = frame([(1, TS + i * DAY) for i in range(140)], "k long, ts timestamp_ntz")
    facts = frame([(1, TS - i * timedelta(hours=11)) for i in range(-400, 200)], "k long, t timestamp_ntz")
    joined = interval_join(spine, facts, "k", "ts", "t", 7, 5)
    got = sorted((r.ts, r.t, r.step) for r in joined.collect())
    expected = sorted(
        (ts, t, -((t - ts) // (7 * DAY)))
        for ts in (TS + i * DAY for i in range(140))
        for t in (TS - i * timedelta(hours=11) for i in range(-400, 200))
        if ts - 35 * DAY <= t < ts
    )
    assert got == expected
    moved = joined._jdf.queryExecution().executedPlan().toString()
    assert "explode(sequence(" in moved


def test_grain_moves_by_customer_and_day(shop):
    firsts = rolling.first_purchases(rolling.purchase_grain(shop[0]))
    assert len(exchanges(firsts)) == 2  # the purchases, and the days by customer


def write(spark, folder, orders, lines):
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz").write.parquet(f"{folder}/orders.parquet")
    spark.createDataFrame(
        lines, "l_orderkey long, l_partkey long, l_extendedprice double, l_returnflag string"
    ).write.parquet(f"{folder}/lineitem.parquet")


def test_labels_are_made_without_moving_them(spark, tmp_path):
    rng = random.Random(3)
    start, end = datetime(1996, 1, 1), datetime(2001, 1, 1)
    days = [start + rng.randint(-40, 1900) * DAY for _ in range(60)] + [start, start + 6 * DAY, start + 7 * DAY, end + 3 * DAY, None]
    orders = [(i, rng.choice([1, 2, 3, None]), d) for i, d in enumerate(days)]
    lines = [(rng.randrange(len(days)), rng.choice([7, 8, 9, None]), rng.choice([1.0, 2.5, None]), "R") for _ in range(150)]
    write(spark, tmp_path, orders, lines)
    times = [start + 28 * i * DAY for i in range((end - start).days // 28 + 1)]

    churn = tables.churn_labels(spark, str(tmp_path))
    expected = {
        (c, t): int(not any(o[1] is not None and o[1] == c and o[2] and t <= o[2] < t + 7 * DAY for o in orders))
        for c in {o[1] for o in orders} for t in times
    }
    got = [(r.customer_id, r.timestamp, r.churn) for r in churn.collect()]
    assert len(got) == len(expected) and {(c, t): x for c, t, x in got} == expected
    assert 0 in expected.values()
    assert len(exchanges(churn)) == 1

    sales = tables.item_sales_labels(spark, str(tmp_path))
    day = {o[0]: o[2] for o in orders}
    expected = {
        (a, t): sum(x[2] or 0.0 for x in lines if a is not None and x[1] == a and day[x[0]] and t <= day[x[0]] < t + 7 * DAY)
        for a in {x[1] for x in lines} for t in times
    }
    got = [(r.article_id, r.timestamp, r.sales) for r in sales.collect()]
    assert len(got) == len(expected)
    assert {(a, t): x for a, t, x in got} == pytest.approx(expected)
    plan = sales._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode") < plan.index("Aggregate")
    assert "LeftOuter" not in plan
