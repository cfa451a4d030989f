"""Preparation and tree models as persistable Spark ML pipelines."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modelwake.operators.drift import numeric_long
from modelwake.operators.ordered import exact_percentiles
from modelwake.operators.prepare import append_error
from modelwake.operators.timewindows import reference_current_split
from modelwake.functions.metrics import metric_report
from modelwake.roles import ColumnRoles, SemanticType, TaskType

VECTOR = "_features"

#: Filler of missing categories.
MISSING = "missing"

#: Rows that one task trains on. A forest of 50 trees keeps some 400 bytes of each in memory.
TRAINING_ROWS = 100_000


def numeric_scaling(df: DataFrame, columns: Sequence[str], rows: int) -> dict[str, tuple[float, float, float]]:
    """Exact median, and mean and population deviation after imputation, per column.

    Two small aggregates; three numbers per column reach the driver. A constant
    column keeps the scale 1, a column without values gets zeros.
    """
    medians = {
        r["feature"]: r["q"][0]
        for r in exact_percentiles(numeric_long(df, columns), ["feature"], "x", [0.5], rows).collect()
    }
    filled = {c: F.coalesce(F.col(c).cast("double"), F.lit(float(medians.get(c, 0.0)))) for c in columns}
    moments = df.agg(
        *[a for c in columns for a in (F.avg(filled[c]).alias(f"{c}.m"), F.stddev_pop(filled[c]).alias(f"{c}.s"))]
    ).first()
    return {
        c: (float(medians.get(c, 0.0)), float(moments[f"{c}.m"] or 0.0), float(moments[f"{c}.s"] or 0.0) or 1.0)
        for c in columns
    }


def scaling_stage(scaling: dict[str, tuple[float, float, float]]) -> SQLTransformer:
    terms = [
        f"(coalesce(cast(`{c}` as double), double('{m!r}')) - double('{mean!r}')) / double('{std!r}') as `{c}_scaled`"
        for c, (m, mean, std) in scaling.items()
    ]
    return SQLTransformer(statement=f"SELECT *, {', '.join(terms)} FROM __THIS__")


def category_stages(columns: Sequence[str], one_hot: bool = True) -> list:
    """Fill, cast to text, index and encode. An unseen value becomes the all-zero vector."""
    terms = [f"coalesce(cast(`{c}` as string), '{MISSING}') as `{c}_text`" for c in columns]
    stages = [
        SQLTransformer(statement=f"SELECT *, {', '.join(terms)} FROM __THIS__"),
        StringIndexer(
            inputCols=[f"{c}_text" for c in columns],
            outputCols=[f"{c}_index" for c in columns],
            handleInvalid="keep",
            stringOrderType="alphabetAsc",
        ),
    ]
    if one_hot:
        # The indexer gives unseen values a last index of their own; dropLast removes its slot.
        stages.append(
            OneHotEncoder(
                inputCols=[f"{c}_index" for c in columns],
                outputCols=[f"{c}_hot" for c in columns],
                dropLast=True,
            )
        )
    return stages


def preparation(df: DataFrame, roles: ColumnRoles, rows: int) -> list:
    """Stages from the raw columns to the feature vector, statistics taken from ``df``.

    Timestamp features are treated like categories.
    """
    numeric, categorical = roles.numerical, roles.categorical + roles.timestamps
    if not numeric and not categorical:
        raise ValueError("there is no numerical, categorical or time feature to prepare")
    stages, inputs = [], []
    if numeric:
        stages.append(scaling_stage(numeric_scaling(df, numeric, rows)))
        inputs += [f"{c}_scaled" for c in numeric]
    if categorical:
        stages += category_stages(categorical)
        inputs += [f"{c}_hot" for c in categorical]
    return [*stages, VectorAssembler(inputCols=inputs, outputCol=VECTOR)]


def dealt_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The columns of the rows for training, dealt out by hash, ``TRAINING_ROWS`` to a task.

    Trainers keep every row as a wide point in the partition it comes in, and files hold
    millions of short rows in one. Rows go by all their values, keys too, so a retry deals
    them alike.
    """
    parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // TRAINING_ROWS))
    placed = df.select(*columns, F.xxhash64(*df.columns).alias("_deal"))
    return placed.repartition(parts, "_deal").drop("_deal")


def boosted_trees(task: TaskType | str, label: str, prediction: str, seed: int = 42, **params):
    """Gradient-boosted classifier or regressor by task; any other task raises."""
    makers = {TaskType.BINARY: GBTClassifier, TaskType.REGRESSION: GBTRegressor}
    if task not in makers:
        raise ValueError(f"{task} not supported")
    return makers[task](featuresCol=VECTOR, labelCol=label, predictionCol=prediction, seed=seed, **params)


@dataclass(frozen=True)
class FitRecord:
    """What was trained, on how much."""

    task_type: str
    target: str
    identifiers: tuple[str, ...]
    n_features: int
    n_rows: int


class TabularModel:
    """A preparation and a model fitted together, with the column roles beside them."""

    def __init__(self, roles: ColumnRoles, task: TaskType, fitted: PipelineModel | None = None):
        self.roles, self.task, self.fitted, self.record = roles, task, fitted, None

    def fit(self, df: DataFrame, estimator=None) -> "TabularModel":
        self.roles.validate(df, need_target=True)
        rows = df.count()
        estimator = estimator or boosted_trees(self.task, self.roles.target, self.roles.prediction)
        labelled = df.withColumn(self.roles.target, F.col(self.roles.target).cast("double"))
        self.fitted = Pipeline(stages=[*preparation(df, self.roles, rows), estimator]).fit(dealt_rows(labelled, [*self.roles.features, self.roles.target]))
        self.record = FitRecord(
            TaskType(self.task).value, self.roles.target, tuple(self.roles.identifiers), len(self.roles.features), rows
        )
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        """The input columns plus ``prediction``."""
        self.roles.validate(df)
        return self.fitted.transform(df).select(*df.columns, self.roles.prediction)

    def predict_with_error(self, df: DataFrame) -> DataFrame:
        self.roles.validate(df, need_target=True)
        return append_error(self.predict(df), self.roles, self.task)

    def evaluate(self, df: DataFrame, metrics: Sequence[str] | None = None) -> DataFrame:
        self.roles.validate(df, need_target=True)
        scored = self.predict(df).withColumn(self.roles.target, F.col(self.roles.target).cast("double"))
        return metric_report(scored, self.roles.target, self.roles.prediction, TaskType(self.task).value, metrics)

    def save(self, path: str) -> None:
        """Stages and roles; data is not saved."""
        self.fitted.write().overwrite().save(f"{path}/stages")
        roles = {
            "types": {c: t.value for c, t in self.roles.types.items()},
            "identifiers": list(self.roles.identifiers),
            "target": self.roles.target,
            "prediction": self.roles.prediction,
            "error": self.roles.error,
            "task": TaskType(self.task).value,
        }
        spark = SparkSession.getActiveSession()
        spark.createDataFrame([(json.dumps(roles),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/roles")

    @classmethod
    def load(cls, path: str) -> "TabularModel":
        spark = SparkSession.getActiveSession()
        saved = json.loads(spark.read.text(f"{path}/roles").first()["value"])
        types = {c: SemanticType(t) for c, t in saved["types"].items()}
        roles = ColumnRoles(types, tuple(saved["identifiers"]), saved["target"], saved["prediction"], saved["error"])
        return cls(roles, TaskType(saved["task"]), PipelineModel.load(f"{path}/stages"))


def category_bins(df: DataFrame, categorical: Sequence[str]) -> int:
    """Bins that tree models need for the widest categorical column: its values, missing and unseen; 32 at least."""
    if not categorical:
        return 32
    row = df.agg(*[F.count_distinct(F.col(c).cast("string")).alias(f"d{i}") for i, c in enumerate(categorical)]).first()
    return max(32, *(n + 2 for n in row))


def forest_regression(
    reference: DataFrame, numeric: Sequence[str], categorical: Sequence[str], target: str,
    prediction: str = "prediction", trees: int = 50, seed: int = 0, **params,
) -> PipelineModel:
    """Random forest trained on the reference rows only."""
    if not numeric and not categorical:
        raise ValueError("a forest needs at least one numeric or categorical column")
    stages = category_stages(categorical, one_hot=False) if categorical else []
    inputs = [*numeric, *[f"{c}_index" for c in categorical]]
    stages.append(VectorAssembler(inputCols=inputs, outputCol=VECTOR))
    stages.append(
        RandomForestRegressor(
            featuresCol=VECTOR, labelCol=target, predictionCol=prediction, numTrees=trees, seed=seed,
            **({"maxBins": category_bins(reference, categorical)} | params),
        )
    )
    return Pipeline(stages=stages).fit(dealt_rows(reference, [*numeric, *categorical, target]))


def score_periods(
    data: DataFrame, ts: str, reference_end: str, current_end: str, target: str, numeric: Sequence[str],
    categorical: Sequence[str], start: str | None = None, prediction: str = "prediction", **params,
) -> tuple[DataFrame, DataFrame]:
    """Reference and current rows with the prediction of a forest trained on the reference."""
    reference, current = reference_current_split(data, ts, reference_end, current_end, start)
    model = forest_regression(reference, numeric, categorical, target, prediction, **params)
    kept = [*data.columns, prediction]
    return model.transform(reference).select(*kept), model.transform(current).select(*kept)


def boosted_classifier(
    train: DataFrame, valid: DataFrame, numeric: Sequence[str], categorical: Sequence[str], label: str,
    prediction: str = "prediction", rounds: int = 100, depth: int = 3, rate: float = 0.1, seed: int = 42,
) -> PipelineModel:
    """Boosted binary classifier; boosting stops when the validation rows no longer improve."""
    both = train.withColumn("_valid", F.lit(False)).unionByName(valid.withColumn("_valid", F.lit(True)))
    typed = both.withColumn(label, F.col(label).cast("double"))
    stages = category_stages(categorical, one_hot=False) if categorical else []
    inputs = [*numeric, *[f"{c}_index" for c in categorical]]
    stages += [
        VectorAssembler(inputCols=inputs, outputCol=VECTOR, handleInvalid="keep"),
        GBTClassifier(
            featuresCol=VECTOR, labelCol=label, predictionCol=prediction, maxIter=rounds, maxDepth=depth,
            stepSize=rate, seed=seed, validationIndicatorCol="_valid", validationTol=0.01,
            maxBins=category_bins(typed, categorical),
        ),
    ]
    return Pipeline(stages=stages).fit(dealt_rows(typed, [*numeric, *categorical, label, "_valid"]))
