"""Distribution drift of every window against the whole reference.

The reference is aggregated once and met by equi joins on (feature, value). Its
values are never repeated per window: what the values missing from a window add
to a statistic follows from the totals.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modelwake.functions.exprs import bucket_of, chi2_tail, correlation, ks_tail, normal_two_sided, ratio
from modelwake.operators.ordered import SPLIT_ROWS, asof_join, exact_percentiles, running_totals
from modelwake.session import bounded_broadcast

WINDOW = "window_id"

#: Drift rules: p-value methods detect below the level, distances at or above it.
P_LEVEL = 0.05
DISTANCE_LEVEL = 0.1
P_VALUE_METHODS = ("ks", "chi2", "z")
REGIMES = ("distance", "test")
FEW_VALUES = 5
PSI_FLOOR = 1e-4
SCALE_FLOOR = 0.001
DATASET_SHARE = 0.5


def numeric_long(df: DataFrame, features: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Rows (keys, feature, x) with x double, nulls left out."""
    numbers = df.select(*keys, *[F.col(f).cast("double").alias(f) for f in features])
    long = numbers.unpivot(list(keys), list(features), "feature", "x")
    return long.where(F.col("feature").isNotNull() & F.col("x").isNotNull())


def category_long(df: DataFrame, features: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Rows (keys, feature, value) with value text, nulls left out."""
    texts = df.select(*keys, *[F.col(f).cast("string").alias(f) for f in features])
    long = texts.unpivot(list(keys), list(features), "feature", "value")
    return long.where(F.col("feature").isNotNull() & F.col("value").isNotNull())


def finite_long(df: DataFrame, features: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Rows (keys, feature, x) without NaN and infinite values: one of them would void every sum it enters."""
    return numeric_long(df, features, keys).where(~F.isnan("x") & (F.abs("x") < float("inf")))


def comparable(reference: DataFrame, current: DataFrame, features: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Both sides with the features as double where they are numbers of different types, so that 1 and 1.0 agree."""
    kinds = [dict(df.dtypes) for df in (reference, current)]
    plain = ("tinyint", "smallint", "int", "bigint", "float", "double")
    changed = [
        f for f in features
        if kinds[0][f] != kinds[1][f] and all(k[f] in plain or k[f].startswith("decimal") for k in kinds)
    ]
    casts = {f: F.col(f).cast("double") for f in changed}
    return (reference.withColumns(casts), current.withColumns(casts)) if casts else (reference, current)


def counted(long: DataFrame) -> DataFrame:
    return long.groupBy(*long.columns).agg(F.count("*").alias("n"))


def _positions(reference: DataFrame, current: DataFrame, features: Sequence[str], rows: int, split_above: int) -> tuple[DataFrame, DataFrame]:
    """Every distinct current value with the running counts of its window and of the reference.

    ``rows`` bounds the rows of both sides together, for one feature.
    """
    ref = counted(finite_long(reference, features))
    cur = counted(finite_long(current, features, [WINDOW]))
    pool = (
        ref.withColumnRenamed("n", "rn")
        # Written as a function of n, the zero keeps the count in use: both readers of ``cur`` share one shuffle.
        .unionByName(cur.select("feature", "x", F.least("n", F.lit(0)).alias("rn")))
        .groupBy("feature", "x")
        .agg(F.sum("rn").alias("rn"))
        .withColumn("rs", F.col("rn") * F.col("x"))
    )
    ranked = running_totals(pool, ["feature"], "x", ["rn", "rs"], rows, split_above).select(
        "feature",
        "x",
        "rn",
        F.col("tot_rn").alias("n_ref"),
        F.try_divide("tot_rs", "tot_rn").alias("ref_mean"),
        F.col("cum_rn").alias("ref_rank"),
        # A feature without reference values has nulls here, and a null statistic.
        F.try_divide("cum_rn", "tot_rn").alias("ref_cdf"),
        F.try_divide(F.col("cum_rn") - F.col("rn"), F.col("tot_rn")).alias("ref_cdf_before"),
        F.try_divide(F.col("x") * F.col("cum_rn") - F.col("cum_rs"), F.col("tot_rn")).alias("ref_area"),
        (F.try_divide(F.col("tot_rs") - F.col("cum_rs"), F.col("tot_rn")) - F.col("x") * (1 - F.try_divide("cum_rn", "tot_rn"))).alias("ref_tail"),
    )
    placed = cur.join(ranked, ["feature", "x"])
    positions = running_totals(placed, [WINDOW, "feature"], "x", ["n"], rows, split_above, previous=["x", "ref_cdf", "ref_area"])
    positions = positions.withColumn("cur_cdf", F.col("cum_n") / F.col("tot_n")).withColumn(
        "cur_cdf_before", (F.col("cum_n") - F.col("n")) / F.col("tot_n")
    )
    return positions, ranked


def ks(reference: DataFrame, current: DataFrame, features: Sequence[str], rows: int, split_above: int = SPLIT_ROWS) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov distance and asymptotic p-value per (window, feature).

    Between two neighbouring values of the window its distribution is flat and the
    reference rises, so the largest gap lies at a value of the window or just before one.
    """
    positions, _ = _positions(reference, current, features, rows, split_above)
    gap = F.greatest(
        F.abs(F.col("ref_cdf") - F.col("cur_cdf")), F.abs(F.col("ref_cdf_before") - F.col("cur_cdf_before"))
    )
    found = positions.groupBy(WINDOW, "feature").agg(
        F.max(gap).alias("statistic"), F.max("tot_n").alias("n_cur"), F.max("n_ref").alias("n_ref")
    )
    tail = ks_tail(F.col("statistic"), F.col("n_ref"), F.col("n_cur"))
    return found.withColumn("p_value", F.when(F.col("n_ref") > 0, tail))


def wasserstein(reference: DataFrame, current: DataFrame, features: Sequence[str], rows: int, split_above: int = SPLIT_ROWS) -> DataFrame:
    """Wasserstein-1 distance over the reference deviation (population), per (window, feature).

    The area between the curves is added up over the gaps between neighbouring window
    values. The reference area in a gap comes from its running sums. Where the curves
    cross inside a gap, an as-of lookup finds the reference value at the crossing.
    """
    positions, ranked = _positions(reference, current, features, rows, split_above)
    level = F.col("cur_cdf_before")
    crosses = (F.col("prev_ref_cdf") < level) & (level < F.col("ref_cdf_before"))
    gaps = positions.withColumn("_cross_key", F.when(crosses, F.col("feature"))).withColumn(
        "_cross_rank", level * F.col("n_ref")
    )
    marks = ranked.where(F.col("rn") > 0).select(
        F.col("feature").alias("_cross_key"),
        F.col("ref_rank").cast("double").alias("_cross_rank"),
        F.col("x").alias("cross_x"),
        F.col("ref_area").alias("cross_area"),
    )
    looked = asof_join(
        gaps, marks, "_cross_key", "_cross_rank", "_cross_rank", ["cross_x", "cross_area"], rows * 2,
        strict=False, backward=False, split_above=split_above,
    )
    inner = F.col("ref_area") - F.col("prev_ref_area")
    width = F.col("x") - F.col("prev_x")
    below = level * (F.col("cross_x") - F.col("prev_x")) - (F.col("cross_area") - F.col("prev_ref_area"))
    above = (F.col("ref_area") - F.col("cross_area")) - level * (F.col("x") - F.col("cross_x"))
    area = (
        F.when(F.col("prev_x").isNull(), F.col("ref_area"))
        .when(F.col("cross_x").isNotNull(), below + above)
        .otherwise(F.abs(inner - level * width))
    )
    tail = F.when(F.col("cum_n") == F.col("tot_n"), F.col("ref_tail")).otherwise(0.0)
    found = looked.groupBy(WINDOW, "feature").agg(
        F.sum(area + tail).alias("distance"), F.max("tot_n").alias("n_cur"), F.max("n_ref").alias("n_ref")
    )
    spread = ranked.groupBy("feature").agg(
        F.sqrt(F.try_divide(F.sum(F.col("rn") * F.pow(F.col("x") - F.col("ref_mean"), 2)), F.max("n_ref"))).alias("ref_std")
    )
    joined = found.join(bounded_broadcast(spread, len(features)), "feature")
    return joined.select(
        WINDOW, "feature", "n_cur", "n_ref",
        F.when(F.col("n_ref") > 0, F.col("distance") / F.greatest("ref_std", F.lit(SCALE_FLOOR))).alias("statistic"),
    )


def _category_counts(reference: DataFrame, current: DataFrame, features: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Counts of every category seen in a window, next to its count in the reference; and the window counts alone."""
    reference, current = comparable(reference, current, features)
    ref = counted(category_long(reference, features)).withColumnRenamed("n", "rn")
    ref_totals = ref.groupBy("feature").agg(F.sum("rn").alias("n_ref"), F.count("*").alias("k_ref"))
    cur = counted(category_long(current, features, [WINDOW]))
    both = (
        cur.join(ref, ["feature", "value"], "left")
        .join(bounded_broadcast(ref_totals, len(features)), "feature")
        .withColumn("rn", F.coalesce("rn", F.lit(0)))
    )
    return both, cur


def _category_shares(reference: DataFrame, current: DataFrame, features: Sequence[str]) -> DataFrame:
    """The counts with the window totals. The totals are few; AQE broadcasts them on their measured size."""
    both, cur = _category_counts(reference, current, features)
    totals = cur.groupBy(WINDOW, "feature").agg(F.sum("n").alias("n_cur"))
    return both.join(totals, [WINDOW, "feature"])


def chi_square(reference: DataFrame, current: DataFrame, features: Sequence[str]) -> DataFrame:
    """Goodness of fit to the reference shares; a category new to the reference gives p = 0.

    Expected counts add up to the window size, so the statistic is
    sum(n * n / share) / N - N: categories missing from the window add nothing to it.
    """
    shares, _ = _category_counts(reference, current, features)
    seen = F.when(F.col("rn") > 0, F.col("n"))
    found = shares.groupBy(WINDOW, "feature").agg(
        F.sum("n").alias("n_cur"),
        F.max("n_ref").alias("n_ref"),
        F.max("k_ref").alias("k_ref"),
        F.count_if(F.col("rn") == 0).alias("new_categories"),
        F.sum(seen * F.col("n") * F.col("n_ref") / F.col("rn")).alias("squares"),
    )
    statistic = F.col("squares") / F.col("n_cur") - F.col("n_cur")
    df = (F.col("k_ref") - 1).cast("int")
    return found.select(
        WINDOW, "feature", "n_cur", "n_ref", "new_categories",
        df.alias("df"),
        F.when(F.col("new_categories") > 0, F.lit(float("inf"))).otherwise(statistic).alias("statistic"),
        F.when(F.col("new_categories") > 0, 0.0).otherwise(chi2_tail(statistic, df)).alias("p_value"),
    )


def jensen_shannon(reference: DataFrame, current: DataFrame, features: Sequence[str]) -> DataFrame:
    """Jensen-Shannon distance (natural logarithm) of the category shares."""
    shares = _category_shares(reference, current, features)
    p = F.col("rn") / F.col("n_ref")
    q = F.col("n") / F.col("n_cur")
    both = F.when(F.col("rn") > 0, p * F.log(2 * p / (p + q))).otherwise(0.0) + q * F.log(2 * q / (p + q))
    found = shares.groupBy(WINDOW, "feature").agg(
        F.max("n_cur").alias("n_cur"),
        F.max("n_ref").alias("n_ref"),
        F.sum(both).alias("seen"),
        F.sum(p).alias("covered"),
    )
    missing = (1 - F.col("covered")) * math.log(2.0)
    half = F.greatest((F.col("seen") + missing) / 2, F.lit(0.0))
    return found.select(WINDOW, "feature", "n_cur", "n_ref", F.sqrt(half).alias("statistic"))


def proportion_z(reference: DataFrame, current: DataFrame, features: Sequence[str]) -> DataFrame:
    """Pooled two-proportion z-test of the smaller value of a two-valued column."""
    ref = counted(category_long(reference, features)).groupBy("feature").agg(
        F.min("value").alias("level"), F.sum("n").alias("n_ref"), F.min_by("n", "value").alias("ref_hits")
    )
    cur = counted(category_long(current, features, [WINDOW]))
    found = (
        cur.join(bounded_broadcast(ref, len(features)), "feature")
        .groupBy(WINDOW, "feature")
        .agg(
            F.max("n_ref").alias("n_ref"),
            F.max("ref_hits").alias("ref_hits"),
            F.sum("n").alias("n_cur"),
            F.sum(F.when(F.col("value") == F.col("level"), F.col("n")).otherwise(0)).alias("hits"),
        )
    )
    pooled = (F.col("ref_hits") + F.col("hits")) / (F.col("n_ref") + F.col("n_cur"))
    deviation = F.sqrt(pooled * (1 - pooled) * (1 / F.col("n_ref") + 1 / F.col("n_cur")))
    z = F.col("hits") / F.col("n_cur") - F.col("ref_hits") / F.col("n_ref")
    scored = found.withColumn("statistic", F.coalesce(F.try_divide(z, deviation), F.lit(0.0)))
    return scored.select(
        WINDOW, "feature", "n_cur", "n_ref", "statistic", normal_two_sided(F.col("statistic")).alias("p_value")
    )


def reference_bins(reference: DataFrame, features: Sequence[str], rows: int, bins: int = 10) -> DataFrame:
    """Inner bin borders of every feature: the reference quantiles 1/bins, 2/bins, ..."""
    points = [i / bins for i in range(1, bins)]
    return exact_percentiles(finite_long(reference, features), ["feature"], "x", points, rows, "edges")


def _binned(long: DataFrame, edges: DataFrame, n_features: int, keys: Sequence[str], bins: int, prefix: str) -> DataFrame:
    named = edges.select("feature", *[F.col("edges")[i].alias(f"e{i}") for i in range(bins - 1)])
    placed = long.join(bounded_broadcast(named, n_features), "feature")
    slot = bucket_of(F.col("x"), [F.col(f"e{i}") for i in range(bins - 1)])
    return (
        placed.withColumn("_bin", slot)
        .groupBy(*keys, "feature")
        .agg(F.count("*").alias(f"{prefix}_n"), *[F.count_if(F.col("_bin") == i).alias(f"{prefix}{i}") for i in range(bins)])
    )


def binned_divergence(reference: DataFrame, current: DataFrame, features: Sequence[str], rows: int, bins: int = 10) -> DataFrame:
    """Population stability index and KL divergence over reference-quantile bins."""
    edges = reference_bins(reference, features, rows, bins)
    ref = _binned(finite_long(reference, features), edges, len(features), [], bins, "r")
    cur = _binned(finite_long(current, features, [WINDOW]), edges, len(features), [WINDOW], bins, "c")
    both = cur.join(bounded_broadcast(ref, len(features)), "feature")
    psi: Column = F.lit(0.0)
    kl: Column = F.lit(0.0)
    for i in range(bins):
        p = F.greatest(F.col(f"r{i}") / F.col("r_n"), F.lit(PSI_FLOOR))
        q = F.greatest(F.col(f"c{i}") / F.col("c_n"), F.lit(PSI_FLOOR))
        psi = psi + (q - p) * F.log(q / p)
        kl = kl + q * F.log(q / p)
    return both.select(
        WINDOW, "feature", F.col("c_n").alias("n_cur"), F.col("r_n").alias("n_ref"), psi.alias("psi"), kl.alias("kl")
    )


def choose_methods(
    reference: DataFrame,
    numeric: Sequence[str],
    categorical: Sequence[str],
    override: Mapping[str, str] | None = None,
    regime: str = "distance",
) -> dict[str, str]:
    """Drift method per column from the regime and the exact number of distinct reference values.

    The number of rows plays no part, so a method means the same at every size. One row
    per column reaches the driver.
    """
    if regime not in REGIMES:
        raise ValueError(f"unknown regime {regime}; known are {', '.join(REGIMES)}")
    columns = [*numeric, *categorical]
    values = counted(category_long(reference, columns))
    found = {r["feature"]: r["d"] for r in values.groupBy("feature").agg(F.count("*").alias("d")).collect()}
    chosen = {}
    for c in columns:
        distinct = found.get(c, 0)
        # A column without reference values keeps the method of its kind.
        few = 0 < distinct <= FEW_VALUES
        number = c in numeric
        if regime == "distance":
            chosen[c] = "wasserstein" if number and not few else "jensen_shannon"
        elif 0 < distinct <= 2:
            chosen[c] = "z"
        else:
            chosen[c] = "ks" if number and not few else "chi2"
    chosen.update(override or {})
    return chosen


def drift_table(
    reference: DataFrame,
    current: DataFrame,
    numeric: Sequence[str],
    categorical: Sequence[str],
    rows: int,
    methods: Mapping[str, str] | None = None,
    split_above: int = SPLIT_ROWS,
    regime: str = "distance",
) -> DataFrame:
    """Long table (window, feature, type, method, statistic, p_value, score, detected).

    ``regime`` chooses distances or tests, ``methods`` overrides single columns. A column
    without reference values has a null statistic and counts as detected. ``score`` is the p-value of a
    test and the distance of a distance; ``intensity`` always grows with drift.
    """
    chosen = choose_methods(reference, numeric, categorical, methods, regime)
    makers = {
        "ks": lambda f: ks(reference, current, f, rows, split_above),
        "wasserstein": lambda f: wasserstein(reference, current, f, rows, split_above),
        "chi2": lambda f: chi_square(reference, current, f),
        "z": lambda f: proportion_z(reference, current, f),
        "jensen_shannon": lambda f: jensen_shannon(reference, current, f),
        "psi": lambda f: binned_divergence(reference, current, f, rows).withColumnRenamed("psi", "statistic"),
        "kl": lambda f: binned_divergence(reference, current, f, rows).withColumnRenamed("kl", "statistic"),
    }
    parts = None
    for method, make in makers.items():
        columns = [c for c in chosen if chosen[c] == method]
        if not columns:
            continue
        found = make(columns)
        p_value = F.col("p_value") if method in P_VALUE_METHODS else F.lit(None)
        part = found.select(
            WINDOW, "feature",
            F.when(F.col("feature").isin(*numeric), "num").otherwise("cat").alias("feature_type"),
            F.lit(method).alias("method"), "statistic", p_value.cast("double").alias("p_value"),
        )
        parts = part if parts is None else parts.unionByName(part)
    return judged(parts)


def judged(table: DataFrame) -> DataFrame:
    """Add score, detected and intensity according to the direction of each method."""
    is_test = F.col("method").isin(*P_VALUE_METHODS)
    return (
        table.withColumn("score", F.when(is_test, F.col("p_value")).otherwise(F.col("statistic")))
        .withColumn("detected", F.when(is_test, F.col("score") < P_LEVEL).otherwise(F.col("score") >= DISTANCE_LEVEL))
        .withColumn("detected", F.coalesce("detected", F.lit(True)))
        .withColumn("intensity", F.when(is_test, 1 - F.col("score")).otherwise(F.col("score")))
    )


def drifted_names(table: DataFrame) -> DataFrame:
    """Sorted names of the drifted columns of every window (features per window are few)."""
    return table.groupBy(WINDOW).agg(
        F.array_sort(F.collect_set(F.when(F.col("detected"), F.col("feature")))).alias("drifted")
    )


def dataset_drift(table: DataFrame) -> DataFrame:
    """Share of drifted columns per window; half of them make the data set drifted."""
    share = F.avg(F.col("detected").cast("double"))
    return table.groupBy(WINDOW).agg(
        F.count("*").alias("n_columns"),
        F.count_if("detected").alias("n_drifted"),
        share.alias("drift_share"),
        (share >= DATASET_SHARE).alias("dataset_drift"),
    )


def concept_shift(reference: DataFrame, current: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """Correlation of each feature with the target per window, less that of the reference."""

    def correlations(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
        wide = df.groupBy(*keys).agg(*[correlation(F.col(f).cast("double"), F.col(target).cast("double")).alias(f) for f in features])
        return wide.unpivot(list(keys), list(features), "feature", name)

    ref = correlations(reference, [], "ref_corr")
    joined = correlations(current, [WINDOW], "corr").join(bounded_broadcast(ref, len(features)), "feature")
    return joined.select(WINDOW, "feature", "corr", "ref_corr", (F.col("corr") - F.col("ref_corr")).alias("shift"))


def prior_shift(reference: DataFrame, current: DataFrame, label: str) -> DataFrame:
    """Class shares per window beside the reference shares, their difference, and the chi-square test of the window.

    Every class of the reference has a row in every window, vanished ones with share 0.
    """
    tests = chi_square(reference, current, [label]).select(WINDOW, F.col("statistic").alias("chi2"), F.col("p_value").alias("chi2_p_value"))
    reference, current = comparable(reference, current, [label])
    ref = counted(category_long(reference, [label]))
    cur = counted(category_long(current, [label], [WINDOW]))
    totals = cur.groupBy(WINDOW, "feature").agg(F.sum("n").alias("n_cur"))
    zero = F.lit(0).cast("long")
    known = totals.join(ref, "feature").select(WINDOW, "feature", "value", F.col("n").alias("rn"), zero.alias("n"))
    seen = cur.select(WINDOW, "feature", "value", zero.alias("rn"), "n")
    both = known.unionByName(seen).groupBy(WINDOW, "feature", "value").agg(F.sum("rn").alias("rn"), F.sum("n").alias("n"))
    whole = bounded_broadcast(ref.groupBy("feature").agg(F.sum("n").alias("n_ref")), 1)
    shares = both.join(totals, [WINDOW, "feature"]).join(whole, "feature", "left").join(tests, WINDOW, "left")
    return shares.select(
        WINDOW,
        F.col("value").alias("label"),
        ratio(F.col("n"), F.col("n_cur")).alias("share"),
        ratio(F.col("rn"), F.col("n_ref")).alias("ref_share"),
        (ratio(F.col("n"), F.col("n_cur")) - ratio(F.col("rn"), F.col("n_ref"))).alias("shift"),
        "chi2", "chi2_p_value",
    )
