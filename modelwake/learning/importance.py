"""Feature importance and partial dependence of a fitted model."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modelwake.operators.sampling import shuffled_beside
from modelwake.session import materialize


def tree_importance(model: PipelineModel, features: Sequence[str], spark) -> DataFrame:
    """Importance of each input slot of a tree model whose slots are the features themselves."""
    weights = model.stages[-1].featureImportances
    return spark.createDataFrame(
        [(f, float(weights[i])) for i, f in enumerate(features)], "feature string, importance double"
    )


def permutation_importance(
    model: PipelineModel, df: DataFrame, keys: Sequence[str], features: Sequence[str],
    target: str, prediction: str, seed: int = 0,
) -> DataFrame:
    """Growth of the mean squared error when one feature is shuffled over all rows.

    Every row is scored as it is and once with each feature replaced, in one pass.
    """
    kept = list(dict.fromkeys([*keys, *features, target]))
    rows = materialize(shuffled_beside(df.select(*kept), keys, features, seed).drop(*set(keys) - {*features, target}))

    def case(place: int) -> Column:
        values = [F.col(f"_new_{i}" if i == place else f).alias(f) for i, f in enumerate(features)]
        return F.struct(F.lit(place).alias("_case"), *values)

    cases = F.explode(F.array(*[case(i) for i in range(-1, len(features))])).alias("_row")
    scored = model.transform(rows.select(F.col(target).alias("_target"), cases).select("_target", "_row.*"))
    error = F.col(prediction) - F.col("_target")
    means = scored.agg(*[F.avg(F.when(F.col("_case") == i, error * error)).alias(f"_mse_{i}") for i in range(-1, len(features))])
    parts = [F.struct(F.lit(f).alias("feature"), F.col(f"_mse_{i}").alias("mse"), F.col("_mse_-1").alias("base_mse")) for i, f in enumerate(features)]
    compared = means.select(F.explode(F.array(*parts)).alias("_part")).select("_part.*")
    return compared.withColumn("importance", F.col("mse") - F.col("base_mse"))


def partial_dependence(
    model: PipelineModel, df: DataFrame, feature: str, grid: Sequence[float], prediction: str
) -> DataFrame:
    """Mean prediction with ``feature`` set to each grid value in every row."""
    values = F.explode(F.array(*[F.lit(float(v)) for v in grid]))
    spread = df.drop(feature).withColumn(feature, values)
    scored = model.transform(spread)
    return scored.groupBy(F.col(feature).alias("grid_value")).agg(
        F.avg(prediction).alias("mean_prediction"), F.count("*").alias("n_rows")
    )


def individual_expectation(
    model: PipelineModel, df: DataFrame, keys: Sequence[str], feature: str, grid: Sequence[float], prediction: str
) -> DataFrame:
    """The predictions behind ``partial_dependence``, one per row and grid value."""
    values = F.explode(F.array(*[F.lit(float(v)) for v in grid]))
    scored = model.transform(df.drop(feature).withColumn(feature, values))
    return scored.select(*keys, F.col(feature).alias("grid_value"), prediction)
