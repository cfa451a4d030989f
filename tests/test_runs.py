"""The two whole runs: task data and the command line monitor."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from modelwake.__main__ import main
from modelwake.plans.task_data import fetch_splits, sampled_labels
from modelwake.roles import TASKS, TimeConfig


def test_task_data_is_built_once(spark, tmp_path):
    calls = []

    def build(task):
        calls.append(task.name)
        start = F.lit("2020-01-06").cast("timestamp_ntz")
        labels = spark.range(300).select(
            F.col("id").alias("customer_id"), (start + F.expr("make_dt_interval(cast(id % 40 * 7 as int))")).alias("timestamp"), F.lit(1).alias("churn")
        )
        return sampled_labels(labels, task, "train", 200)

    for _ in range(2):
        task, splits = fetch_splits(spark, str(tmp_path), "shop", "user-churn", build, {"subsample": 200})
        assert task is TASKS["user-churn"] and set(splits) == {"train", "val", "test"}
        assert splits["train"].agg(F.max("timestamp")).first()[0] < datetime(2020, 7, 1)
        assert 0 < sum(d.count() for d in splits.values()) < 200
    assert calls == ["user-churn"]
    fetch_splits(spark, str(tmp_path), "shop", "user-churn", build, {"subsample": 200}, TimeConfig(val_month=9))
    assert len(calls) == 2


def test_only_training_labels_are_sampled(spark):
    labels = spark.range(50).select(F.col("id").alias("customer_id"), F.lit("2020-01-01").cast("timestamp_ntz").alias("timestamp"))
    task = TASKS["user-churn"]
    assert sampled_labels(labels, task, "train", 10).count() == 10
    assert sampled_labels(labels, task, "val", 10).count() == 50
    assert sampled_labels(labels, task, "train", 0).count() == 50


def test_command_line_monitor(spark, tmp_path):
    rng = random.Random(4)
    start = datetime(2011, 1, 1)
    with open(tmp_path / "hourly.csv", "w") as out:
        out.write("ts,instant,temp,hr,season,cnt\n")
        for i in range(59 * 24):
            temp = rng.random() + (0.8 if i > 45 * 24 else 0)
            count = 10 * (i % 24) + 50 * min(temp, 1) + (200 if i > 50 * 24 else 0)
            out.write(f"{start + timedelta(hours=i)},{i},{temp:.3f},{i % 24},{'ws'[i % 2]},{count:.1f}\n")
    output = str(tmp_path / "out")
    main([
        "--data-path", str(tmp_path / "hourly.csv"), "--output", output, "--target", "cnt", "--numeric", "temp", "hr",
        "--categorical", "season", "--reference-end", "2011-01-28 23:00:00", "--current-end", "2011-02-28 23:00:00",
        "--regime", "test", "--method", "temp=wasserstein",
    ])
    summary = spark.read.json(f"{output}/summary").first()
    windows = spark.read.json(f"{output}/windows")
    assert summary.total_windows == windows.count() == 4
    assert summary.critical_windows >= 1 and summary.status in ("warning", "critical")
    assert spark.read.json(f"{output}/feature_drift").where("feature = 'temp' and method = 'wasserstein' and detected").count() >= 1
    assert spark.read.parquet(f"{output}/scored/current").where("prediction is null").count() == 0
