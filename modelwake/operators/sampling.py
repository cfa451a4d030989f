"""Samples, splits and data corruption, all decided by hashes of the row key.

The same key gives the same decision on every run, retry and partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from modelwake.functions.exprs import hash_fraction, hash_normal, one_row
from modelwake.operators.ordered import global_rank, running_totals
from modelwake.session import materialize


def _digest(keys: Sequence[str], seed: int | str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def hash_sample(df: DataFrame, keys: Sequence[str], n: int, seed: int = 0) -> DataFrame:
    """Exactly ``n`` rows (or all, if fewer), those with the smallest key hashes.

    Counts per hash prefix (at most 65,536) tell which prefix holds the n-th row. All rows
    below it are taken where they are; only rows of that one prefix are ordered.
    """
    digest = _digest(keys, seed)
    prefix = F.substring(digest, 1, 4)
    counts = df.groupBy(prefix.alias("_prefix")).agg(F.count("*").alias("_n"))
    upto = counts.selectExpr("_prefix", "sum(_n) OVER (ORDER BY _prefix) - _n AS _before").where(F.col("_before") < n)
    edge = one_row(upto.agg(F.max("_prefix").alias("_prefix"), F.max("_before").alias("_before")))
    inside = df.where(prefix < edge["_prefix"])
    place = F.row_number().over(Window.partitionBy("_prefix").orderBy("_digest", *keys))
    last = df.withColumns({"_prefix": prefix, "_digest": digest}).where(F.col("_prefix") == edge["_prefix"]).withColumn("_place", place)
    return inside.unionByName(last.where(F.col("_place") <= n - edge["_before"]).select(*df.columns))


def head(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """The first ``n`` rows (or all, if fewer) in the order of the columns, nulls first.

    A search, not a sort of whole rows: counts per value of the first column, added up over
    ranges, tell which value holds the n-th row. Rows before it are taken where they are;
    rows of that value go on to the next column. Which of several rows equal in all columns
    of ``order`` are taken at the end is decided once and stored. No task holds all n rows.
    """
    taken, edge, left = df.limit(0), df, n
    for c in order:
        if left <= 0:
            return taken
        counts = edge.groupBy(F.col(c).alias("_value")).agg(F.count("*").alias("_n"))
        sums = running_totals(counts, [], "_value", ["_n"], 0, -1).withColumn("_before", F.col("cum__n") - F.col("_n"))
        within = sums.where(F.col("_before") < left)
        found = materialize(within.agg(*[F.max_by(x, "_before").alias(x) for x in ("_value", "_n")], F.max("_before").alias("_before")))
        row = found.first()
        if row["_before"] is None:
            return taken
        value = one_row(found)["_value"]
        below = F.col(c).isNull() & value.isNotNull() | (F.col(c) < value)
        taken = taken.unionByName(edge.where(below))
        edge, left = edge.where(F.col(c).eqNullSafe(value)), left - row["_before"]
        if row["_n"] <= left:
            return taken.unionByName(edge)
    numbered = materialize(edge.withColumn("_part", F.spark_partition_id()))
    counts = numbered.groupBy("_part").agg(F.count("*").alias("_n"))
    # One row per partition.
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(F.lit(1)))
    last = materialize(numbered.join(before, "_part").where(F.col("_before") < left).withColumn("_place", place))
    return taken.unionByName(last.where(F.col("_place") <= left - F.col("_before")).select(*df.columns))


def hash_split(df: DataFrame, keys: Sequence[str], test_share: float = 0.2, seed: int = 42) -> DataFrame:
    """Add ``split`` (train/test) by the key hash."""
    side = F.when(hash_fraction(keys, seed) < test_share, "test").otherwise("train")
    return df.withColumn("split", side)


def add_noise(df: DataFrame, keys: Sequence[str], columns: Sequence[str], scale: float = 0.5, seed: int = 0) -> DataFrame:
    """Add normal noise of ``scale`` sample deviations to each numeric column."""
    spread = df.agg(*[F.stddev_samp(c).alias(f"_sd{i}") for i, c in enumerate(columns)])
    sd = one_row(spread)
    noisy = {c: F.col(c) + hash_normal(keys, seed + i) * sd[f"_sd{i}"] * scale for i, c in enumerate(columns)}
    return df.withColumns(noisy)


def shuffle_values(
    df: DataFrame, keys: Sequence[str], column: str, share: float = 0.3, seed: int = 0
) -> DataFrame:
    """Permute ``column`` among a random share of the rows.

    The chosen rows in key order receive the values in hash order, over the whole table
    and whatever its size. ``keys`` must identify a row.
    """
    chosen = df.where(hash_fraction(keys, f"{seed}m") < share).select(*keys, F.struct(F.col(column).alias("v")).alias("_new"))
    takers = global_rank(chosen.select(*keys), keys, "_rank")
    hashed = chosen.withColumn("_digest", _digest(keys, f"{seed}p"))
    givers = global_rank(hashed, ["_digest", *keys], "_rank").select("_rank", "_new")
    moved = takers.join(givers, "_rank").select(*keys, "_new")
    joined = df.join(moved, list(keys), "left")
    value = F.when(F.col("_new").isNotNull(), F.col("_new.v")).otherwise(F.col(column))
    return joined.withColumn(column, value).select(*df.columns)


def shuffled_beside(df: DataFrame, keys: Sequence[str], columns: Sequence[str], seed: int = 0) -> DataFrame:
    """Add ``_new_i``, column i of ``columns`` permuted over all rows, for every column.

    The values are those of ``shuffle_values`` with share 1 and the seeds seed, seed + 1, ...
    The rows are numbered in key order once; all columns meet them by that number, so the
    rows shuffle once, not twice for every column.
    """
    stored = materialize(df)
    moved = global_rank(stored, keys, "_rank")
    for i, c in enumerate(columns):
        hashed = stored.select(*keys, F.col(c).alias(f"_new_{i}"), _digest(keys, f"{seed + i}p").alias("_digest"))
        givers = global_rank(hashed, ["_digest", *keys], "_rank").select("_rank", f"_new_{i}")
        moved = moved.join(givers, "_rank")
    return moved.drop("_rank")


def flip_labels(df: DataFrame, keys: Sequence[str], label: str, share: float = 0.15, seed: int = 0) -> DataFrame:
    flipped = F.when(hash_fraction(keys, f"{seed}f") < share, 1 - F.col(label)).otherwise(F.col(label))
    return df.withColumn(label, flipped)


def corrupt(
    df: DataFrame, keys: Sequence[str], numeric: Sequence[str], categorical: Sequence[str], label: str, seed: int = 0
) -> DataFrame:
    """Noise on numbers, shuffled categories and flipped labels together."""
    noisy = add_noise(df, keys, numeric, seed=seed)
    for i, c in enumerate(categorical):
        noisy = shuffle_values(noisy, keys, c, seed=seed + 100 + i)
    return flip_labels(noisy, keys, label, seed=seed)
