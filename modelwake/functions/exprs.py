"""Column expressions shared by the operators; all of them stay inside the JVM."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def one_row(totals: DataFrame) -> Column:
    """The single row of an ungrouped aggregate as a struct, read as a scalar subquery (no join)."""
    return totals.select(F.struct(*totals.columns).alias("row")).scalar()


def ratio(a: Column, b: Column) -> Column:
    """Double division; null instead of an error when ``b`` is zero."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def correlation(x: Column, y: Column) -> Column:
    """Pearson correlation of the rows with both values; null when one of them is constant.

    The built-in one divides by zero there, an error in ANSI mode.
    """
    both = x.isNotNull() & y.isNotNull()
    spread = F.stddev_pop(F.when(both, x)) * F.stddev_pop(F.when(both, y))
    return F.try_divide(F.covar_pop(x, y), spread)


def slope(y: Column, x: Column) -> Column:
    """Slope of the least-squares line; null when ``x`` is constant."""
    return F.try_divide(F.covar_pop(y, x), F.var_pop(F.when(y.isNotNull(), x)))


def micros_between(start: str, end: str) -> Column:
    """Microseconds from column ``start`` to column ``end``."""
    return F.expr(f"timestampdiff(MICROSECOND, `{start}`, `{end}`)")


def hash_fraction(keys: Sequence[str], seed: int | str) -> Column:
    """A value in [0, 1) that depends only on the keys and the seed, so retries repeat it."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(float(2**32))


def hash_normal(keys: Sequence[str], seed: int) -> Column:
    """Standard normal value per key by the Box-Muller transform of two hash fractions."""
    radius = F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - hash_fraction(keys, f"{seed}r")))
    return radius * F.cos(F.lit(2 * math.pi) * hash_fraction(keys, f"{seed}a"))


def erfc(x: Column) -> Column:
    """Complementary error function for x >= 0: power series below 3, continued fraction above."""
    start = F.struct(x.alias("term"), x.alias("total"))
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(80)),
        start,
        lambda acc, n: F.struct(
            (-acc["term"] * x * x / n).alias("term"),
            (acc["total"] + (-acc["term"] * x * x / n) / (n * 2 + 1)).alias("total"),
        ),
        lambda acc: F.lit(1.0) - acc["total"] * F.lit(2 / math.sqrt(math.pi)),
    )
    fraction = F.aggregate(
        F.sequence(F.lit(60), F.lit(1), F.lit(-1)),
        x,
        lambda acc, n: x + (n / F.lit(2.0)) / acc,
        lambda acc: F.exp(-x * x) / F.lit(math.sqrt(math.pi)) / acc,
    )
    return F.when(x < 3.0, series).otherwise(fraction)


def normal_two_sided(z: Column) -> Column:
    return erfc(F.abs(z) / F.lit(math.sqrt(2.0)))


def chi2_tail(statistic: Column, df: Column) -> Column:
    """P(X >= statistic) for ``df`` degrees of freedom.

    The tail for df is the one for df-2 plus one term, so a finite sum over the
    degrees of freedom gives it. Terms are summed as logarithms to keep them finite.
    """
    half = statistic / F.lit(2.0)
    odd = (df % 2) == 1
    base = F.when(odd, erfc(F.sqrt(half))).otherwise(F.exp(-half))
    first = F.when(
        odd, F.log(half) * 0.5 - half - F.lit(math.lgamma(1.5))
    ).otherwise(F.log(half) - half)
    steps = F.floor((df - F.when(odd, 3).otherwise(4)) / 2).cast("int")
    offset = F.when(odd, 0.5).otherwise(1.0)
    terms = F.aggregate(
        F.when(steps >= 1, F.sequence(F.lit(1), steps)).otherwise(F.array().cast("array<int>")),
        F.struct(first.alias("log_term"), F.exp(first).alias("total")),
        lambda acc, k: F.struct(
            (acc["log_term"] + F.log(half) - F.log(offset + k)).alias("log_term"),
            (acc["total"] + F.exp(acc["log_term"] + F.log(half) - F.log(offset + k))).alias("total"),
        ),
        lambda acc: acc["total"],
    )
    extra = F.when(df >= 3, terms).otherwise(0.0)
    tail = F.when(df <= 0, 1.0).when(statistic <= 0, 1.0).otherwise(base + extra)
    return F.least(tail, F.lit(1.0))


def ks_tail(distance: Column, n: Column, m: Column) -> Column:
    """Asymptotic two-sample Kolmogorov-Smirnov p-value."""
    lam = F.sqrt(n.cast("double") * m / (n + m)) * distance
    total = F.aggregate(
        F.sequence(F.lit(1), F.lit(100)),
        F.lit(0.0),
        lambda acc, k: acc
        + F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(F.lit(-2.0) * k * k * lam * lam),
    )
    return F.when(lam < 0.2, 1.0).otherwise(F.greatest(F.least(total, F.lit(1.0)), F.lit(0.0)))


def bucket_of(value: Column, edges: Sequence[float]) -> Column:
    """Number of ``edges`` (ascending) at or below ``value``, by a balanced tree of comparisons."""

    def branch(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(value < edges[middle], branch(low, middle)).otherwise(branch(middle + 1, high))

    return branch(0, len(edges))


def to_number(column: str) -> Column:
    """Text to double; text that is not a number becomes null."""
    return F.expr(f"try_cast(`{column}` as double)")
