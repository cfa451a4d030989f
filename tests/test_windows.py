from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from modelwake.operators.timewindows import (
    calendar_split,
    plan_windows,
    reference_current_split,
    size_windows,
    window_unit,
)
from modelwake.roles import TimeConfig

START = datetime(2024, 1, 1)


def times(frame, *offsets):
    return frame([(START + o,) for o in offsets], "ts timestamp_ntz")


@pytest.mark.parametrize(
    "span, unit",
    [
        (timedelta(days=1), timedelta(hours=1)),
        (timedelta(days=2), timedelta(hours=6)),
        (timedelta(weeks=1), timedelta(days=1)),
        (timedelta(weeks=4), timedelta(weeks=1)),
        (timedelta(weeks=4) - timedelta(seconds=1), timedelta(days=1)),
    ],
)
def test_unit_follows_the_span(span, unit):
    assert window_unit(span) == unit


@pytest.mark.parametrize("rows, count", [(0, 0), (1, 1), (2, 0), (3, 0), (4, 1), (8, 2), (400, 24)])
def test_window_count_is_bound_by_the_rows(rows, count):
    assert size_windows(START, START + timedelta(days=1), rows).count == count


def test_border_rows_are_in_two_windows(frame):
    df = times(frame, *[timedelta(hours=h) for h in (0, 1, 2, 3, 4, 5, 6, 8)])
    plan = plan_windows(df, "ts")
    assert plan.count == 2
    rows = {r.window_id: r.n for r in plan.assign(df, "ts").groupBy("window_id").agg(F.count("*").alias("n")).collect()}
    assert rows == {1: 5, 2: 4}


def test_equal_times_make_one_empty_window_holding_all_rows(frame):
    df = times(frame, *[timedelta(0)] * 4)
    plan = plan_windows(df, "ts")
    assert plan.count == 1 and plan.assign(df, "ts").count() == 4
    row = plan.table(df.sparkSession).first()
    assert row.window_start == row.window_end == START


def test_assignment_equals_the_range_join(frame, spark):
    offsets = [timedelta(microseconds=(i * i * 7_919_333) % 2_419_199_999_999) for i in range(400)]
    df = times(frame, *offsets)
    plan = plan_windows(df, "ts")
    outside = df.unionByName(times(frame, timedelta(days=-1), timedelta(days=900)))
    got = sorted((r.ts, r.window_id) for r in plan.assign(outside, "ts").collect())
    windows = [(r.window_id, r.window_start, r.window_end) for r in plan.table(spark).collect()]
    expected = sorted((START + o, i) for o in offsets for i, a, b in windows if a <= START + o <= b)
    assert got == expected and len({i for _, i in got}) == plan.count
    assert windows[-1][2] == max(START + o for o in offsets)


def test_windows_sort_as_numbers(frame, spark):
    df = times(frame, *[timedelta(hours=h / 4) for h in range(49)])
    ids = [r.window_id for r in plan_windows(df, "ts").table(spark).orderBy("window_id").collect()]
    assert ids == list(range(1, 13))


def test_reference_and_current_share_the_cut(frame):
    df = times(frame, *[timedelta(days=d) for d in range(6)])
    reference, current = reference_current_split(df, "ts", "2024-01-03", "2024-01-05", start="2024-01-02")
    assert reference.count() == 2 and current.count() == 3


def test_calendar_split_drops_other_months_and_years(frame):
    rows = [(datetime(2020, m, 1),) for m in range(1, 13)] + [(datetime(2019, 3, 1),)]
    split = calendar_split(frame(rows, "ts timestamp_ntz"), "ts", TimeConfig())
    counts = {r.split: r["count"] for r in split.groupBy("split").count().collect()}
    assert counts == {"train": 6, "val": 1, "test": 1}
