"""Train, validation and test tables of a prediction task, built once and then read back."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession

from modelwake.operators.sampling import hash_sample
from modelwake.operators.timewindows import calendar_split
from modelwake.roles import TASKS, TaskSpec, TimeConfig
from modelwake.sources import files


def sampled_labels(labels: DataFrame, task: TaskSpec, split: str, subsample: int = 0, seed: int = 0) -> DataFrame:
    """Training labels reduced to ``subsample`` rows when it is positive; other splits stay whole."""
    if split == "train" and subsample > 0:
        return hash_sample(labels, task.identifiers, subsample, seed)
    return labels


def fetch_splits(
    spark: SparkSession,
    root: str,
    dataset: str,
    task_name: str,
    make_table: Callable[[TaskSpec], DataFrame],
    settings: dict | None = None,
    time_config: TimeConfig = TimeConfig(),
) -> tuple[TaskSpec, dict[str, DataFrame]]:
    """The three calendar splits of a feature table.

    ``make_table`` builds the whole table; it is called only when the splits for this
    data set, task, time configuration and ``settings`` are not stored yet.
    """
    task = TASKS[task_name]
    key = {**(settings or {}), **asdict(time_config)}
    folder = files.split_folder(root, dataset, task.name, key)
    stored = files.read_splits(spark, folder)
    if stored is None:
        files.write_splits(calendar_split(make_table(task), task.identifiers[-1], time_config), folder)
        stored = files.read_splits(spark, folder)
    return task, stored
