"""Ordered operators that stay distributed when one group holds most of the rows.

Running totals, exact percentiles and as-of joins all need rows in order inside a
group. A plain window puts a whole group into one task. Callers state an upper bound
``rows`` for the rows of any one group. Above ``split_above`` the operators cut the
ordered rows of every group into ranges, work inside each range, and carry one small
row per (group, range) across ranges.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from modelwake.operators.joins import same_keys
from modelwake.session import materialize

#: Rows of one group up to which a plain window is used.
SPLIT_ROWS = 5_000_000

_PART = "_part"


def range_split(df: DataFrame, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Add ``_part``, which never decreases along (group, order).

    The part numbers are stored with the rows, so a lost executor cannot make two
    readers of the result disagree about them.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *group, *order)
    return materialize(ranged.withColumn(_PART, F.spark_partition_id()))


def global_rank(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """Add ``name``, the place (from 1) of every row in the order of columns that identify it.

    Rows are numbered inside stored ranges; one count per range carries the numbers across.
    """
    split = range_split(df, [], order)
    counts = split.groupBy(_PART).agg(F.count("*").alias("_n"))
    # One row per range: bounded by the number of partitions.
    before = Window.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(_PART, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(_PART).orderBy(*order))
    placed = split.withColumn("_inside", inside).join(F.broadcast(offsets), _PART)
    return placed.select(*df.columns, (F.col("_inside") + F.col("_before")).alias(name))


def running_totals(
    df: DataFrame,
    group: Sequence[str],
    order: str,
    measures: Sequence[str],
    rows: int,
    split_above: int = SPLIT_ROWS,
    previous: Sequence[str] = (),
) -> DataFrame:
    """Add ``cum_m`` (inclusive running sum) and ``tot_m`` (group sum) for every measure.

    ``prev_c`` holds column c of the row before, for every c in ``previous``.
    ``df`` must hold each (group, order) once.
    """
    group = list(group)
    if rows <= split_above:
        upto = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        whole = Window.partitionBy(*group)
        return df.select(
            "*",
            *[F.sum(m).over(upto).alias(f"cum_{m}") for m in measures],
            *[F.sum(m).over(whole).alias(f"tot_{m}") for m in measures],
            *[F.lag(c).over(Window.partitionBy(*group).orderBy(order)).alias(f"prev_{c}") for c in previous],
        )

    split = range_split(df, group, [order])
    before = Window.partitionBy(*group).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*group)
    sums = split.groupBy(*group, _PART).agg(
        *[F.sum(m).alias(m) for m in measures],
        *[F.max_by(c, order).alias(c) for c in previous if c not in group],
    )
    offsets = sums.select(
        *group,
        _PART,
        *[F.coalesce(F.sum(m).over(before), F.lit(0)).alias(f"off_{m}") for m in measures],
        *[F.sum(m).over(whole).alias(f"tot_{m}") for m in measures],
        *[F.lag(c).over(Window.partitionBy(*group).orderBy(_PART)).alias(f"edge_{c}") for c in previous],
    )
    inside = Window.partitionBy(*group, _PART).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    row_before = Window.partitionBy(*group, _PART).orderBy(order)
    local = split.select(
        "*",
        *[F.sum(m).over(inside).alias(f"loc_{m}") for m in measures],
        F.lag(F.lit(True), 1, False).over(row_before).alias("_inner"),
        *[F.lag(c).over(row_before).alias(f"near_{c}") for c in previous],
    )
    joined = local.join(offsets, same_keys(local, offsets, group + [_PART]))
    return joined.select(
        *[local[c] for c in df.columns],
        *[(local[f"loc_{m}"] + offsets[f"off_{m}"]).alias(f"cum_{m}") for m in measures],
        *[offsets[f"tot_{m}"] for m in measures],
        *[
            F.when(local["_inner"], local[f"near_{c}"]).otherwise(offsets[f"edge_{c}"]).alias(f"prev_{c}")
            for c in previous
        ],
    )


def exact_percentiles(
    df: DataFrame,
    group: Sequence[str],
    value: str,
    probabilities: Sequence[float],
    rows: int,
    name: str = "q",
    split_above: int = SPLIT_ROWS,
) -> DataFrame:
    """Linear-interpolated percentiles per group as an array column; nulls are ignored."""
    group = list(group)
    if rows <= split_above:
        wanted = F.array(*[F.lit(float(p)) for p in probabilities])
        return df.groupBy(*group).agg(F.percentile(F.col(value), wanted).alias(name))

    counts = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("n"))
    ranked = running_totals(counts, group, value, ["n"], rows, split_above)
    # Groups without a value keep their row, as in the other plan.
    groups = df.select(*group).distinct()
    picks = []
    for i, p in enumerate(probabilities):
        position = F.lit(float(p)) * (F.col("tot_n") - 1)
        picks.append(F.min(F.when(F.col("cum_n") > F.floor(position), F.col(value))).alias(f"lo{i}"))
        picks.append(F.min(F.when(F.col("cum_n") > F.ceil(position), F.col(value))).alias(f"hi{i}"))
    found = ranked.groupBy(*group).agg(F.max("tot_n").alias("tot_n"), *picks)
    interpolated = []
    for i, p in enumerate(probabilities):
        position = F.lit(float(p)) * (F.col("tot_n") - 1)
        weight = position - F.floor(position)
        lo, hi = F.col(f"lo{i}"), F.col(f"hi{i}")
        # Between equal values, infinite ones too, there is nothing to interpolate.
        interpolated.append(F.when(lo == hi, lo).otherwise((1 - weight) * lo + weight * hi))
    joined = groups.join(found, same_keys(groups, found, group), "left")
    points = F.when(F.col("tot_n").isNotNull(), F.array(*interpolated))
    return joined.select(*[groups[c] for c in group], points.alias(name))


def asof_join(
    spine: DataFrame,
    facts: DataFrame,
    key: str,
    spine_time: str,
    fact_time: str,
    values: Sequence[str],
    rows: int,
    strict: bool = True,
    backward: bool = True,
    split_above: int = SPLIT_ROWS,
) -> DataFrame:
    """Left as-of join: every spine row with the ``values`` of the nearest fact of its key.

    Backward takes the latest fact before the spine row (``strict``) or up to it;
    forward takes the earliest fact after it or from it on. ``facts`` must hold each
    (key, time) once; ``rows`` bounds the facts and spine rows of one key together.
    """
    spine_first = strict == backward
    spine_rank, fact_rank = (0, 1) if spine_first else (1, 0)
    left = spine.select(
        F.col(key).alias("_k"),
        F.col(spine_time).alias("_t"),
        F.lit(spine_rank).alias("_side"),
        F.struct(*[F.col(c) for c in spine.columns]).alias("_row"),
    )
    right = facts.where(F.col(key).isNotNull()).select(
        F.col(key).alias("_k"),
        F.col(fact_time).alias("_t"),
        F.lit(fact_rank).alias("_side"),
        F.struct(*[F.col(c) for c in values]).alias("_val"),
    )
    both = left.unionByName(right, allowMissingColumns=True)
    # Spine rows without a key match nothing; spread them instead of giving them one task.
    both = both.withColumn("_free", F.when(F.col("_k").isNull(), F.xxhash64("_row") % 1024))

    step = 1 if backward else -1
    ranks = [F.col("_t"), F.col("_side")] if backward else [F.col("_t").desc(), F.col("_side").desc()]
    if rows <= split_above:
        upto = Window.partitionBy("_k", "_free").orderBy(*ranks).rowsBetween(Window.unboundedPreceding, 0)
        matched = both.withColumn("_hit", F.last("_val", ignorenulls=True).over(upto))
    else:
        split = range_split(both, ["_k", "_free"], ["_t", "_side"])
        keys = ["_k", "_free", _PART]
        nearest = F.max_by if backward else F.min_by
        edge = split.groupBy(*keys).agg(
            nearest("_val", F.when(F.col("_val").isNotNull(), F.struct("_t", "_side"))).alias("_edge")
        )
        earlier = (
            Window.partitionBy("_k", "_free")
            .orderBy(F.col(_PART) * step)
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        carried = edge.select(*keys, F.last("_edge", ignorenulls=True).over(earlier).alias("_carry"))
        # What a range carries goes ahead of its rows; in one window with them, no join follows.
        ahead = carried.where(F.col("_carry").isNotNull()).select(*keys, F.col("_carry").alias("_val"), F.lit(0).alias("_place"))
        placed = split.withColumn("_place", F.lit(1)).unionByName(ahead, allowMissingColumns=True)
        inside = Window.partitionBy(*keys).orderBy("_place", *ranks).rowsBetween(Window.unboundedPreceding, 0)
        matched = placed.withColumn("_hit", F.last("_val", ignorenulls=True).over(inside))
    return matched.where(F.col("_side") == spine_rank).select(
        "_row.*", *[F.col("_hit")[c].alias(c) for c in values]
    )
