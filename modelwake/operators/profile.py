"""Data-quality profiles per window and their distance from the reference profile."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modelwake.functions.exprs import ratio
from modelwake.operators.drift import WINDOW, category_long, comparable, counted, numeric_long
from modelwake.operators.joins import null_safe_join
from modelwake.operators.ordered import exact_percentiles
from modelwake.operators.quality import most_common
from modelwake.session import bounded_broadcast

#: ``window_id`` of the reference rows in a stacked table.
REFERENCE_ID = 0


def stack(reference: DataFrame, current: DataFrame) -> DataFrame:
    """Reference rows as window 0 on top of the window-assigned current rows."""
    return reference.withColumn(WINDOW, F.lit(REFERENCE_ID)).unionByName(current, allowMissingColumns=True)


def _row_counts(stacked: DataFrame, features: Sequence[str]) -> DataFrame:
    """Rows and nulls per (window, feature), aggregated side by side."""
    wide = stacked.groupBy(WINDOW).agg(
        F.count("*").alias("_n"), *[F.count_if(F.col(f).isNull()).alias(f"{f}.miss") for f in features]
    )
    entries = [F.struct(F.lit(f).alias("feature"), F.col(f"`{f}.miss`").alias("missing")) for f in features]
    return wide.select(WINDOW, F.col("_n").alias("n_rows"), F.explode(F.array(*entries)).alias("e")).select(
        WINDOW, "n_rows", "e.*"
    )


def _with_shares(profile: DataFrame) -> DataFrame:
    n = F.col("n_rows")
    return profile.select(
        "*",
        (ratio(F.col("missing"), n) * 100).alias("missing_pct"),
        (ratio(F.col("unique_values"), n) * 100).alias("unique_pct"),
        (ratio(F.col("most_common_n"), n) * 100).alias("most_common_pct"),
    )


def numeric_profile(stacked: DataFrame, features: Sequence[str], rows: int) -> DataFrame:
    """Summary of numeric columns, one row per (window, feature)."""
    keys = [WINDOW, "feature"]
    long = numeric_long(stacked, features, [WINDOW])
    finite = F.when(F.abs("x") < float("inf"), F.col("x"))
    stats = long.groupBy(*keys).agg(
        F.avg(finite).alias("mean"),
        F.stddev_samp(finite).alias("std"),
        F.min(finite).alias("min"),
        F.max(finite).alias("max"),
        F.count_if(F.abs("x") == float("inf")).alias("infinite"),
    )
    quartiles = exact_percentiles(long, keys, "x", [0.25, 0.5, 0.75], rows, "_q")
    common = most_common(counted(long), keys, "x").select(
        *keys, F.col("x").alias("most_common"), F.col("n").alias("most_common_n"),
        F.col("distinct_values").alias("unique_values"),
    )
    joined = _row_counts(stacked, features)
    for part in (stats, quartiles, common):
        joined = null_safe_join(joined, part, keys)
    named = joined.withColumns({"q25": F.col("_q")[0], "median": F.col("_q")[1], "q75": F.col("_q")[2]})
    filled = named.fillna(0, ["unique_values", "most_common_n", "infinite"])
    return _with_shares(filled.drop("_q"))


def category_profile(stacked: DataFrame, features: Sequence[str]) -> DataFrame:
    """Summary of categorical columns, one row per (window, feature)."""
    keys = [WINDOW, "feature"]
    common = most_common(counted(category_long(stacked, features, [WINDOW])), keys, "value").select(
        *keys, F.col("value").alias("most_common"), F.col("n").alias("most_common_n"),
        F.col("distinct_values").alias("unique_values"),
    )
    joined = null_safe_join(_row_counts(stacked, features), common, keys)
    return _with_shares(joined.fillna(0, ["unique_values", "most_common_n"]))


def quality_delta(profile: DataFrame, n_features: int, zero_for_missing: bool = False) -> DataFrame:
    """Absolute change of mean and deviation and signed change of the unique share against window 0.

    Categorical columns have neither mean nor deviation: null, or 0 with ``zero_for_missing``.
    """
    for name in ("mean", "std"):
        if name not in profile.columns:
            profile = profile.withColumn(name, F.lit(None).cast("double"))
    base = profile.where(F.col(WINDOW) == REFERENCE_ID).select(
        "feature", *[F.col(c).alias(f"_ref_{c}") for c in ("mean", "std", "unique_pct")]
    )
    joined = profile.where(F.col(WINDOW) != REFERENCE_ID).join(bounded_broadcast(base, n_features), "feature")
    changes = {
        "mean_diff": F.abs(F.col("mean") - F.col("_ref_mean")),
        "std_diff": F.abs(F.col("std") - F.col("_ref_std")),
        "unique_diff": F.col("unique_pct") - F.col("_ref_unique_pct"),
    }
    if zero_for_missing:
        changes = {k: F.coalesce(v, F.lit(0.0)) for k, v in changes.items()}
    return joined.select(WINDOW, "feature", *[v.alias(k) for k, v in changes.items()])


def category_changes(reference: DataFrame, current: DataFrame, features: Sequence[str]) -> DataFrame:
    """Categories that appear only in a window (new) or only in the reference (unused).

    Unused is the reference total less the shared ones, so no category list is
    repeated per window.
    """
    ref = category_long(reference, features).distinct().withColumn("_known", F.lit(True))
    sizes = ref.groupBy("feature").agg(F.count("*").alias("_size"))
    seen = category_long(current, features, [WINDOW]).distinct()
    found = seen.join(ref, ["feature", "value"], "left").groupBy(WINDOW, "feature").agg(
        F.count_if(F.col("_known").isNull()).alias("new_categories"), F.count("_known").alias("_shared")
    )
    joined = found.join(bounded_broadcast(sizes, len(features)), "feature", "left")
    unused = F.coalesce("_size", F.lit(0)) - F.col("_shared")
    return joined.select(WINDOW, "feature", "new_categories", unused.alias("unused_categories"))


def histogram(stacked: DataFrame, features: Sequence[str], bins: int = 10) -> DataFrame:
    """Counts over ``bins`` equal bins between the reference minimum and maximum.

    Values outside fall into bin 0 or bins + 1. A constant column has one bin.
    """
    keys = [WINDOW, "feature"]
    reference = numeric_long(stacked.where(F.col(WINDOW) == REFERENCE_ID), features)
    limits = reference.groupBy("feature").agg(F.min("x").alias("_low"), F.max("x").alias("_high"))
    placed = numeric_long(stacked, features, [WINDOW]).join(bounded_broadcast(limits, len(features)), "feature")
    width = (F.col("_high") - F.col("_low")) / bins
    slot = (
        F.when(F.col("x") < F.col("_low"), 0)
        .when(F.col("x") > F.col("_high"), bins + 1)
        .when(F.col("x") == F.col("_high"), bins)
        .otherwise(F.least(F.floor((F.col("x") - F.col("_low")) / width).cast("int") + 1, F.lit(bins)))
    )
    return placed.groupBy(*keys, slot.cast("int").alias("bin")).agg(F.count("*").alias("n_rows"))


def outlier_counts(stacked: DataFrame, features: Sequence[str], rows: int) -> DataFrame:
    """Values beyond 1.5 interquartile ranges of the reference quartiles."""
    reference = numeric_long(stacked.where(F.col(WINDOW) == REFERENCE_ID), features)
    quartiles = exact_percentiles(reference, ["feature"], "x", [0.25, 0.75], rows, "_q")
    spread = F.col("_q")[1] - F.col("_q")[0]
    limits = quartiles.select(
        "feature", (F.col("_q")[0] - 1.5 * spread).alias("low"), (F.col("_q")[1] + 1.5 * spread).alias("high")
    )
    placed = numeric_long(stacked, features, [WINDOW]).join(bounded_broadcast(limits, len(features)), "feature")
    return placed.groupBy(WINDOW, "feature").agg(
        F.count("*").alias("n_rows"),
        F.count_if((F.col("x") < F.col("low")) | (F.col("x") > F.col("high"))).alias("n_outliers"),
    )


def serving_mismatch(train: DataFrame, serving: DataFrame) -> DataFrame:
    """Columns whose presence, type or share of nulls differs between training and serving."""
    spark = train.sparkSession
    types = [dict(train.dtypes), dict(serving.dtypes)]
    columns = list(dict.fromkeys([*types[0], *types[1]]))
    schema = "feature string, train_type string, serving_type string"
    declared = spark.createDataFrame([(c, types[0].get(c), types[1].get(c)) for c in columns], schema)

    def null_shares(df: DataFrame, name: str) -> DataFrame:
        shares = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in df.columns])
        return shares.unpivot([], df.columns, "feature", name)

    joined = declared.join(null_shares(train, "train_null_share"), "feature", "left").join(
        null_shares(serving, "serving_null_share"), "feature", "left"
    )
    same_type = F.col("train_type").eqNullSafe(F.col("serving_type"))
    same_nulls = F.abs(F.col("train_null_share") - F.col("serving_null_share")) < 0.01
    return joined.withColumn("mismatch", ~(same_type & F.coalesce(same_nulls, F.lit(False))))


def category_mismatch(train: DataFrame, serving: DataFrame, features: Sequence[str]) -> DataFrame:
    """Categories that only one of training and serving has, with their rows on that side."""
    train, serving = comparable(train, serving, features)
    sides = category_long(train, features).withColumn("side", F.lit("train")).unionByName(
        category_long(serving, features).withColumn("side", F.lit("serving"))
    )
    counts = sides.groupBy("feature", "value").agg(
        F.count_if(F.col("side") == "train").alias("n_train"), F.count_if(F.col("side") == "serving").alias("n_serving")
    )
    one_sided = (F.col("n_train") == 0) | (F.col("n_serving") == 0)
    return counts.where(one_sided).withColumn("only_in", F.when(F.col("n_serving") == 0, "train").otherwise("serving"))
