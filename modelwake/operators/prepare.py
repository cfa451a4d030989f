"""Row-level preparation: errors, coercion and category alignment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modelwake.functions.exprs import to_number
from modelwake.roles import ColumnRoles, TaskType


def append_error(df: DataFrame, roles: ColumnRoles, task: TaskType | str) -> DataFrame:
    """Regression: prediction - target. Binary: whether they differ. Anything else raises."""
    if roles.target not in df.columns:
        raise ValueError(f"the table has no target column {roles.target}")
    y, p = F.col(roles.target), F.col(roles.prediction)
    if task == TaskType.REGRESSION:
        return df.withColumn(roles.error, p - y)
    if task == TaskType.BINARY:
        return df.withColumn(roles.error, p != y)
    raise ValueError(f"no error is defined for {task}")


def coerce(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    """Numbers from text (unreadable text gives null) and categories as text."""
    changes = {c: to_number(c) for c in numeric}
    changes.update({c: F.col(c).cast("string") for c in categorical})
    return df.withColumns(changes)


def yes_no_label(df: DataFrame, column: str, positive: str = "Yes") -> DataFrame:
    return df.withColumn(column, F.when(F.col(column) == positive, 1).otherwise(0))


def align_categories(train: DataFrame, test: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Test rows with values unseen in training set to null.

    One join per column on the distinct training values; AQE broadcasts it when the
    vocabulary turns out small.
    """
    aligned = test
    for c in columns:
        known = train.select(F.col(c).alias("_v")).where(F.col("_v").isNotNull()).distinct()
        joined = aligned.join(known, aligned[c] == known["_v"], "left")
        aligned = joined.select(*[F.col("_v").alias(c) if n == c else aligned[n] for n in aligned.columns])
    return aligned


def rename_lower(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lower() for c in df.columns])

