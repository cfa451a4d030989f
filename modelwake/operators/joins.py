"""Equi joins with nulls, and the interval join that sorts facts into equal time steps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modelwake.functions.exprs import micros_between

#: Length of a time block of the interval join, in intervals: half of the intervals lie in one block.
BLOCK_SPANS = 2


def same_keys(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> Column:
    condition = F.lit(True)
    for name in columns:
        condition = condition & left[name].eqNullSafe(right[name])
    return condition


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Equi join in which a null key matches a null key; keeps the left copy of the keys."""
    renamed = right.select(
        *[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys]
    )
    condition = F.lit(True)
    for k in keys:
        condition = condition & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return left.join(renamed, condition, how).drop(*[f"_r_{k}" for k in keys])


def join_all(frames: Sequence[DataFrame], keys: Sequence[str], how: str = "left") -> DataFrame:
    first, *others = frames
    for other in others:
        first = first.join(other, list(keys), how)
    return first


def interval_join(
    spine: DataFrame, facts: DataFrame, key: str, spine_time: str, fact_time: str, step_days: int, steps: int
) -> DataFrame:
    """Inner join of each spine row with the facts of its key in the ``steps`` time steps before it.

    Adds ``step`` from 1: ts - step*d <= t < ts - (step-1)*d. Both sides carry a time
    block of ``BLOCK_SPANS`` whole intervals, so a join partition holds one key in one
    block, not one key over all time. The spine row appears in the blocks of both ends of
    its interval, which for every other row is the same one.

    Both sides are shuffled and merged. A size estimated before rows are exploded would
    have the spine broadcast, through the driver, with many times that size.
    """
    span = step_days * steps

    def block(time: Column) -> Column:
        return F.floor(F.unix_date(time.cast("date")) / F.lit(span * BLOCK_SPANS)).cast("int")

    first, last = block(F.col(spine_time) - F.expr(f"INTERVAL {span} DAY")), block(F.col(spine_time))
    blocks = spine.withColumn("_block", F.explode(F.sequence(first, last)))
    placed = facts.withColumn("_block", block(F.col(fact_time))).withColumnRenamed(key, "_key")
    joined = blocks.hint("merge").join(
        placed,
        (blocks[key] == placed["_key"])
        & (blocks["_block"] == placed["_block"])
        & (placed[fact_time] < blocks[spine_time])
        & (placed[fact_time] >= blocks[spine_time] - F.expr(f"INTERVAL {span} DAY")),
    ).drop("_key", "_block")
    micros = F.lit(step_days * 86_400_000_000)
    gap = micros_between(fact_time, spine_time)
    return joined.withColumn("step", F.ceil(gap / micros).cast("int"))
