"""Categories as numbers, by joins instead of a vocabulary on the driver."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modelwake.functions.exprs import hash_fraction, one_row
from modelwake.operators.ordered import global_rank
from modelwake.session import bounded_broadcast, materialize

#: Filler of missing categories.
MISSING = "missing"
#: Slots of one one-hot column at most; wider columns are for indices or target means.
MOST_SLOTS = 4096


def category(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(MISSING))


def fit_dictionary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """feature, value, index and size: the distinct values of every column numbered from 0 in their order.

    Distinct values are ranked over stored ranges, so no task and no driver sees all of them.
    ``size`` is the number of values, which is also the index of unseen ones.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), category(c).alias("value")) for c in columns]))
    values = df.select(pairs.alias("v")).select("v.*").distinct()
    ranked = global_rank(values, ["feature", "value"], "place")
    # One row per column.
    sizes = ranked.groupBy("feature").agg(F.min("place").alias("first"), F.count("*").alias("size"))
    placed = ranked.join(bounded_broadcast(sizes, len(columns)), "feature")
    return materialize(placed.select("feature", "value", (F.col("place") - F.col("first")).alias("index"), "size"))


def encode(df: DataFrame, dictionary: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``df`` with ``c_index`` for every column; an unseen value gets the number of known ones.

    One equi-join per column, which AQE broadcasts for small dictionaries and splits for hot values.
    """
    known = dictionary.groupBy("feature").agg(F.max("size").alias("size"))
    for c in columns:
        values = dictionary.where(F.col("feature") == c).select(F.col("value").alias("_value"), F.col("index").alias("_index"))
        size = one_row(known.where(F.col("feature") == c).agg(F.coalesce(F.max("size"), F.lit(0)).alias("size")))["size"]
        joined = df.withColumn("_value", category(c)).join(values, "_value", "left")
        df = joined.withColumn(f"{c}_index", F.coalesce("_index", size)).drop("_value", "_index")
    return df


def one_hot(encoded: DataFrame, dictionary: DataFrame, columns: Sequence[str], most: int = MOST_SLOTS) -> DataFrame:
    """``c_hot`` arrays from the indices; unseen values are all zeros. Raises for columns of more than ``most`` values."""
    rows = dictionary.where(F.col("feature").isin(*columns)).groupBy("feature").agg(F.max("size").alias("size")).collect()
    sizes = {r["feature"]: r["size"] for r in rows}
    wide = sorted(c for c, n in sizes.items() if n > most)
    if wide:
        raise ValueError(f"more than {most} categories in {', '.join(wide)}")

    def hot(c: str) -> Column:
        if not sizes.get(c):
            return F.array().cast("array<int>")
        own = F.col(f"{c}_index") + 1
        return F.transform(F.sequence(F.lit(1), F.lit(sizes[c])), lambda i: (i == own).cast("int"))

    slots = {f"{c}_hot": hot(c) for c in columns}
    return encoded.withColumns(slots)


def _mean(total: Column, n: Column, prior: Column, weight: float) -> Column:
    """A category's mean, drawn to the prior as if ``weight`` rows had it."""
    return (F.coalesce(total, F.lit(0.0)) + weight * prior) / (F.coalesce(n, F.lit(0)) + weight)


def out_of_fold_means(
    df: DataFrame, keys: Sequence[str], columns: Sequence[str], target: str, folds: int = 5, weight: float = 20.0, seed: int = 0
) -> DataFrame:
    """``df`` with ``c_mean``: the mean target of a row's category over the rows of the other folds.

    Folds come from a hash of the row key, so a row's own target never enters its own
    feature, and a category of single rows gets nothing but the prior. Rows are aggregated to
    (category, fold) first; the join back is on both, which also divides a hot category.
    Rows without a target count in no mean.
    """
    df = df.withColumn("_fold", F.floor(hash_fraction(keys, seed) * folds).cast("int"))
    y = F.col(target).cast("double")
    # One row per fold.
    per_fold = df.groupBy("_fold").agg(F.coalesce(F.sum(y), F.lit(0.0)).alias("_fy"), F.count(y).alias("_fn"))
    whole = one_row(df.agg(F.sum(y).alias("y"), F.count(y).alias("n")))
    priors = per_fold.select("_fold", F.coalesce(F.try_divide(whole["y"] - F.col("_fy"), whole["n"] - F.col("_fn")), F.lit(0.0)).alias("_prior"))
    df = df.join(bounded_broadcast(priors, folds), "_fold", "left")
    for c in columns:
        cells = df.groupBy(category(c).alias("_value"), "_fold").agg(F.coalesce(F.sum(y), F.lit(0.0)).alias("_y"), F.count(y).alias("_n"))
        sums = cells.groupBy("_value").agg(F.sum("_y").alias("_ty"), F.sum("_n").alias("_tn"))
        others = cells.join(sums, "_value").select("_value", "_fold", (F.col("_ty") - F.col("_y")).alias("_oy"), (F.col("_tn") - F.col("_n")).alias("_on"))
        joined = df.withColumn("_value", category(c)).join(others, ["_value", "_fold"], "left")
        df = joined.withColumn(f"{c}_mean", _mean(F.col("_oy"), F.col("_on"), F.col("_prior"), weight)).drop("_value", "_oy", "_on")
    return df.drop("_fold", "_prior")


def fit_target_means(df: DataFrame, columns: Sequence[str], target: str, weight: float = 20.0) -> DataFrame:
    """feature, value, mean and prior over all rows, for scoring; stored."""
    y = F.col(target).cast("double")
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), category(c).alias("value")) for c in columns]))
    cells = df.select(pairs.alias("v"), y.alias("y")).groupBy("v.feature", "v.value").agg(F.sum("y").alias("total"), F.count("y").alias("n"))
    prior = F.coalesce(one_row(df.agg(F.avg(y).alias("prior")))["prior"], F.lit(0.0))
    return materialize(cells.select("feature", "value", _mean(F.col("total"), F.col("n"), prior, weight).alias("mean"), prior.alias("prior")))


def apply_target_means(df: DataFrame, means: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``df`` with ``c_mean`` from the fitted means; an unseen value gets the prior."""
    prior = F.coalesce(one_row(means.agg(F.max("prior").alias("prior")))["prior"], F.lit(0.0))
    for c in columns:
        values = means.where(F.col("feature") == c).select(F.col("value").alias("_value"), F.col("mean").alias("_mean"))
        df = df.withColumn("_value", category(c)).join(values, "_value", "left").withColumn(f"{c}_mean", F.coalesce("_mean", prior)).drop("_value", "_mean")
    return df
