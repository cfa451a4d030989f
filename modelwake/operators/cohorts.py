"""Cohort, metric-change and time-pattern analyses of a performance drop."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from modelwake.functions.exprs import bucket_of, chi2_tail, correlation, normal_two_sided, one_row, ratio, slope
from modelwake.functions.metrics import confusion, with_rates
from modelwake.operators.drift import binned_divergence, chi_square, jensen_shannon, ks
from modelwake.operators.ordered import global_rank
from modelwake.operators.profile import category_changes
from modelwake.session import materialize


def metric_rows(metrics: DataFrame, by: str, names: Sequence[str]) -> DataFrame:
    return metrics.unpivot([by], list(names), "metric", "value")


def compare_periods(metrics: DataFrame, period: str, baseline, impact, names: Sequence[str]) -> DataFrame:
    """Metric table of two periods: values, delta and change in percent."""
    long = metric_rows(metrics, period, names)
    pair = long.groupBy("metric").agg(
        F.max(F.when(F.col(period) == baseline, F.col("value"))).alias("baseline"),
        F.max(F.when(F.col(period) == impact, F.col("value"))).alias("impact"),
    )
    delta = F.col("impact") - F.col("baseline")
    return pair.select(
        "metric", "baseline", "impact", delta.alias("delta"), (ratio(delta, F.abs("baseline")) * 100).alias("change_pct")
    )


def rank_metric_changes(comparison: DataFrame, spread: float = 2.0) -> DataFrame:
    """Metrics by size of change; ``specific`` when the largest is ``spread`` times the median change.

    A handful of metric rows, so one unpartitioned window is fine.
    """
    size = F.abs("change_pct")
    everything = Window.partitionBy(F.lit(1))
    ranked = comparison.withColumn("change_rank", F.rank().over(everything.orderBy(size.desc_nulls_last())))
    largest, middle = F.max(size).over(everything), F.percentile(size, 0.5).over(everything)
    return ranked.withColumn("verdict", F.when(largest >= middle * spread, "specific").otherwise("overall"))


def deviation_alerts(series: DataFrame, value: str, baseline: Column, tolerance: float = 0.3) -> DataFrame:
    """Relative distance of each window from the baseline, and whether it exceeds the tolerance."""
    off = ratio(F.abs(F.col(value) - baseline), F.abs(baseline))
    return series.select(
        "*", baseline.cast("double").alias("baseline"), off.alias("deviation"), (off > tolerance).alias("alert")
    )


def impact_window(alerts: DataFrame, value: str) -> DataFrame:
    """First window that falls out of the baseline band, and how many windows do."""
    fallen = F.col("alert") & (F.col(value) < F.col("baseline"))
    return alerts.agg(
        F.min(F.when(fallen, F.col("window_id"))).alias("impact_start"),
        F.max(F.when(fallen, F.col("window_id"))).alias("impact_end"),
        F.count_if(fallen).alias("n_windows"),
    )


#: A drop is sudden when one step makes up this share of the whole range ...
SUDDEN_SHARE = 0.5
#: ... and gradual when a falling line explains this share of the variance.
GRADUAL_FIT = 0.5


def drop_pattern(series: DataFrame, value: str) -> DataFrame:
    """Sudden, gradual, mixed or no clear pattern; with the window of the largest drop.

    Works on the window table (one row per window), not on raw rows.
    """
    order = Window.partitionBy(F.lit(1)).orderBy("window_id")
    steps = series.withColumn("_drop", F.lag(value).over(order) - F.col(value))
    shape = steps.agg(
        F.max("_drop").alias("largest_drop"),
        F.max_by("window_id", F.struct("_drop", -F.col("window_id"))).alias("drop_window"),
        (F.max(value) - F.min(value)).alias("value_range"),
        slope(F.col(value), F.col("window_id").cast("double")).alias("slope"),
        F.pow(correlation(F.col(value), F.col("window_id").cast("double")), 2).alias("fit"),
    )
    sudden = F.coalesce(ratio(F.col("largest_drop"), F.col("value_range")) >= SUDDEN_SHARE, F.lit(False))
    gradual = F.coalesce((F.col("slope") < 0) & (F.col("fit") >= GRADUAL_FIT), F.lit(False))
    return shape.withColumn(
        "pattern",
        F.when(sudden & gradual, "mixed")
        .when(sudden, "sudden")
        .when(gradual, "gradual")
        .otherwise("no clear pattern"),
    )


def cohort_metrics(df: DataFrame, y: str, p: str, sets: Sequence[Sequence[str]]) -> DataFrame:
    """Error metrics for several segmentations in one pass over the rows.

    Rows are reduced once to the finest combination of all dimensions. The grouping
    sets run on that table. ``cohort`` names the dimensions of a row's set.
    """
    dimensions = list(dict.fromkeys(d for s in sets for d in s))
    error = (F.col(p) - F.col(y)).cast("double")
    finest = df.select(*[F.col(d).cast("string").alias(d) for d in dimensions], error.alias("_e")).groupBy(*dimensions).agg(
        F.count("_e").alias("n"), F.sum("_e").alias("s1"), F.sum(F.abs("_e")).alias("sa"), F.sum(F.col("_e") * F.col("_e")).alias("s2")
    )
    grouped = finest.groupingSets([[F.col(d) for d in s] for s in sets], *dimensions).agg(
        F.grouping_id(*dimensions).alias("_gid"), *[F.sum(c).alias(c) for c in ("n", "s1", "sa", "s2")]
    )
    label = F.lit("")
    last = len(dimensions) - 1
    for s in sets:
        gid = sum(0 if d in s else 1 << (last - i) for i, d in enumerate(dimensions))
        label = F.when(F.col("_gid") == gid, "+".join(s) or "all").otherwise(label)
    return grouped.select(
        label.alias("cohort"),
        *dimensions,
        F.col("n").alias("n_rows"),
        ratio(F.col("s1"), F.col("n")).alias("mean_error"),
        ratio(F.col("sa"), F.col("n")).alias("mae"),
        F.sqrt(ratio(F.col("s2"), F.col("n"))).alias("rmse"),
    )


def rank_cohorts(cohorts: DataFrame, dimensions: Sequence[str], metric: str = "mae", high: float = 0.01) -> DataFrame:
    """Cohorts by their share of the excess error: row share x (cohort - overall).

    ``cohorts`` holds the overall row (cohort ``all``). A cohort whose contribution
    exceeds ``high`` of the overall error is of high impact. The ranks are dense: distinct
    contributions are numbered over stored ranges, so a set of many cohorts takes no
    window of its own. Cohorts without a contribution come last.
    """
    overall = one_row(
        cohorts.where(F.col("cohort") == "all").agg(F.max("n_rows").alias("n"), F.max(metric).alias("m"))
    )
    rest = cohorts.where(F.col("cohort") != "all")
    contribution = ratio(F.col("n_rows"), overall["n"]) * (F.col(metric) - overall["m"])
    level = F.round("contribution", 9)
    plain = level.isNotNull() & ~F.isnan(level)
    scored = rest.withColumn("contribution", contribution).withColumns(
        {
            "high_impact": F.col("contribution") > overall["m"] * high,
            # NaN is the largest value, a missing one comes last.
            "_class": F.when(level.isNull(), 2).when(plain, 1).otherwise(0),
            "_level": F.when(plain, -level).otherwise(0.0),
        }
    )
    stored = materialize(scored.select("cohort", *dimensions, "n_rows", metric, "contribution", "high_impact", "_class", "_level"))
    levels = ["cohort", "_class", "_level"]
    places = global_rank(stored.select(*levels).distinct(), levels, "_place")
    first = places.groupBy("cohort").agg((F.min("_place") - 1).alias("_before"))
    ranks = places.join(first, "cohort").select(*levels, (F.col("_place") - F.col("_before")).cast("int").alias("impact_rank"))
    return stored.join(ranks, levels).select("cohort", *dimensions, "n_rows", metric, "contribution", "impact_rank", "high_impact")


def step_up(tests: DataFrame, keys: Sequence[str], alpha: float = 0.05, p_value: str = "p_value", name: str = "shifted") -> DataFrame:
    """Which of many tests are significant when false discoveries may make up ``alpha`` of the finds.

    Benjamini and Hochberg: of m tests in the order of their p-values, the largest one with
    p <= alpha * place / m is the limit for all. ``keys`` identify a test; tests without a
    p-value do not count and get no decision.
    """
    stored = materialize(tests)
    known = stored.where(F.col(p_value).isNotNull()).select(*keys, p_value)
    placed = global_rank(known, [p_value, *keys], "_place")
    m = one_row(known.agg(F.count("*").alias("m")))["m"]
    limit = one_row(placed.where(F.col(p_value) <= alpha * F.col("_place") / m).agg(F.max(p_value).alias("limit")))["limit"]
    return stored.withColumn(name, F.when(F.col(p_value).isNotNull(), F.coalesce(F.col(p_value) <= limit, F.lit(False))))


def cohort_shift_tests(
    reference: DataFrame, current: DataFrame, cohort: str, numeric: Sequence[str], categorical: Sequence[str], rows: int, alpha: float = 0.05
) -> DataFrame:
    """Has a feature shifted in a cohort? One test per pair, ``shifted`` corrected for their number.

    Kolmogorov-Smirnov for numbers, chi-square for categories, every cohort of the current
    rows against the whole reference.
    """
    keyed = current.withColumn("window_id", F.col(cohort))
    kept = ["window_id", "feature", "method", "statistic", "p_value"]
    tests = []
    if numeric:
        tests.append(ks(reference, keyed, numeric, rows).withColumn("method", F.lit("ks")).select(*kept))
    if categorical:
        tests.append(chi_square(reference, keyed, categorical).withColumn("method", F.lit("chi2")).select(*kept))
    if not tests:
        raise ValueError("a cohort shift needs at least one numeric or categorical column")
    decided = step_up(reduce(DataFrame.unionByName, tests), ["window_id", "feature"], alpha)
    return decided.withColumnRenamed("window_id", cohort)


def cohort_shift(reference: DataFrame, current: DataFrame, cohort: str, numeric: Sequence[str], categorical: Sequence[str], rows: int) -> DataFrame:
    """Feature drift of every cohort of the current rows against the whole reference."""
    keyed = current.withColumn("window_id", F.col(cohort))
    tests = ks(reference, keyed, numeric, rows).select("window_id", "feature", F.lit("ks").alias("method"), "statistic")
    tests = tests.unionByName(
        binned_divergence(reference, keyed, numeric, rows).select(
            "window_id", "feature", F.lit("psi").alias("method"), F.col("psi").alias("statistic")
        )
    )
    if categorical:
        tests = tests.unionByName(
            jensen_shannon(reference, keyed, categorical).select(
                "window_id", "feature", F.lit("jensen_shannon").alias("method"), "statistic"
            )
        )
    return tests.withColumnRenamed("window_id", cohort)


def segment_error_test(df: DataFrame, segment: str, is_error: Column) -> DataFrame:
    """Do error rates differ between segments? Chi-square over all, z of each against the rest."""
    counts = df.groupBy(segment).agg(F.count("*").alias("n_rows"), F.count_if(is_error).alias("n_errors"))
    totals = one_row(
        counts.agg(
            F.sum("n_rows").alias("n"),
            F.sum("n_errors").alias("e"),
            F.count("*").alias("k"),
            F.sum(F.col("n_errors") * F.col("n_errors") / F.col("n_rows")).alias("squares"),
        )
    )
    joined = counts.withColumns({f"_{c}": totals[c] for c in ("n", "e", "k", "squares")})
    rate = F.col("_e") / F.col("_n")
    spread_all = F.col("_squares") - F.col("_e") * rate
    statistic = F.coalesce(F.try_divide(spread_all, rate * (1 - rate)), F.lit(0.0))
    others, other_errors = F.col("_n") - F.col("n_rows"), F.col("_e") - F.col("n_errors")
    gap = ratio(F.col("n_errors"), F.col("n_rows")) - ratio(other_errors, others)
    spread = F.sqrt(rate * (1 - rate) * (1 / F.col("n_rows") + F.try_divide(F.lit(1.0), others)))
    z = F.coalesce(F.try_divide(gap, spread), F.lit(0.0))
    df_ = (F.col("_k") - 1).cast("int")
    return joined.select(
        segment, "n_rows", "n_errors", ratio(F.col("n_errors"), F.col("n_rows")).alias("error_rate"),
        z.alias("z"), normal_two_sided(z).alias("z_p_value"),
        statistic.alias("chi2"), df_.alias("df"), chi2_tail(statistic, df_).alias("chi2_p_value"),
    )


def threshold_sweep(df: DataFrame, y: str, score: str, thresholds: Sequence[float]) -> DataFrame:
    """Confusion counts and rates for every threshold, predicting 1 for scores at or above it.

    Rows are counted per gap between thresholds; running sums over the gaps give all
    thresholds. The grid is the only thing repeated.
    """
    grid = sorted(thresholds)
    slots = df.where(F.col(score).isNotNull()).withColumn("slot", bucket_of(F.col(score), grid)).groupBy("slot").agg(
        F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) == 0).alias("neg")
    )
    steps = df.sparkSession.createDataFrame(
        [(0, None)] + [(i + 1, float(t)) for i, t in enumerate(grid)], "slot int, threshold double"
    )
    filled = steps.join(slots, "slot", "left").fillna(0, ["pos", "neg"])
    from_here = Window.partitionBy(F.lit(1)).orderBy("slot").rowsBetween(0, Window.unboundedFollowing)
    before = Window.partitionBy(F.lit(1)).orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    counts = filled.select(
        "threshold",
        F.sum("neg").over(before).alias("tn"),
        F.sum("neg").over(from_here).alias("fp"),
        F.sum("pos").over(before).alias("fn"),
        F.sum("pos").over(from_here).alias("tp"),
    ).where(F.col("threshold").isNotNull())
    return with_rates(counts).select(
        "threshold", "tn", "fp", "fn", "tp", "accuracy_score", "precision_score", "recall_score", "f1_score", "false_positive_rate"
    )


def calibration(df: DataFrame, y: str, score: str, bins: int = 10) -> DataFrame:
    """Reliability table over equal-width score bins in [0, 1]; ``ece_term`` adds up to the ECE."""
    slot = F.least(F.floor(F.col(score) * bins).cast("int") + 1, F.lit(bins))
    table = df.where(F.col(score).isNotNull() & F.col(y).isNotNull()).groupBy(slot.alias("bin")).agg(
        F.count("*").alias("n_rows"), F.avg(score).alias("mean_score"), F.avg(y).alias("mean_label")
    )
    total = F.sum("n_rows").over(Window.partitionBy(F.lit(1)))  # at most `bins` rows
    gap = F.col("mean_score") - F.col("mean_label")
    return table.select("*", gap.alias("gap"), (F.abs(gap) * F.col("n_rows") / total).alias("ece_term"))


def confidence_band(score: str, bands: int = 10) -> Column:
    return F.least(F.floor(F.col(score) * bands).cast("int") + 1, F.lit(bands))


def fairness_rates(df: DataFrame, y: str, p: str, group: str) -> DataFrame:
    """Error and selection rates per group, and each group's predicted share over the largest one."""
    rates = with_rates(confusion(df, y, p, [group]))
    best = one_row(rates.agg(F.max("predicted_positive_rate").alias("best")))["best"]
    return rates.select(
        group, "false_negative_rate", "false_positive_rate", "selection_rate", "predicted_positive_rate",
        ratio(F.col("predicted_positive_rate"), best).alias("parity_ratio"),
    )


def label_coverage(df: DataFrame, labels: DataFrame, key: str, label: str, segment: str) -> DataFrame:
    joined = df.select(key, segment).join(labels.select(key, label), key, "left")
    return joined.groupBy(segment).agg(
        F.count("*").alias("n_rows"), F.count(label).alias("n_labelled"), ratio(F.count(label), F.count("*")).alias("coverage")
    )


def split_overlap(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """How many keys of the right table also occur in the left one, and how many do not."""
    known = left.select(*keys).distinct().withColumn("_known", F.lit(True))
    probe = right.select(*keys).distinct().join(known, list(keys), "left")
    return probe.agg(
        F.count("_known").alias("overlapping"), F.count_if(F.col("_known").isNull()).alias("clean")
    )


def clean_rows(train: DataFrame, test: DataFrame, keys: Sequence[str]) -> DataFrame:
    return test.join(train.select(*keys).distinct(), list(keys), "left_anti")


def future_leakage(df: DataFrame, feature_time: str, label_time: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows whose newest feature data is not older than the label time."""
    return df.groupBy(*by).agg(
        F.count("*").alias("n_rows"), F.count_if(F.col(feature_time) >= F.col(label_time)).alias("n_leaking")
    )


def period_over_period(series: DataFrame, time: str, value: str, interval: str) -> DataFrame:
    """Each period beside the one ``interval`` earlier (for example ``7 DAY`` or ``1 MONTH``)."""
    earlier = series.select((F.col(time) + F.expr(f"INTERVAL {interval}")).alias(time), F.col(value).alias("previous"))
    joined = series.select(time, value).join(earlier, time, "left")
    delta = F.col(value) - F.col("previous")
    return joined.select(
        time, value, "previous", delta.alias("delta"), (ratio(delta, F.col("previous")) * 100).alias("change_pct")
    )


def diversity(df: DataFrame, item: str, by: Sequence[str]) -> DataFrame:
    """Distinct items and Shannon entropy per group, from item counts.

    entropy = ln N - sum(n ln n) / N needs only sums, not the group total per item.
    """
    counts = df.groupBy(*by, item).agg(F.count("*").alias("n"))
    total = F.sum("n")
    return counts.groupBy(*by).agg(
        F.count(item).alias("distinct_items"),
        total.alias("n_rows"),
        (F.log(total) - F.sum(F.col("n") * F.log("n")) / total).alias("entropy"),
    )


def class_shares(df: DataFrame, label: str, rare: float = 0.05) -> DataFrame:
    """Classes with their share; ``is_rare`` below the limit."""
    counts = df.groupBy(label).agg(F.count("*").alias("n_rows"))
    total = one_row(counts.agg(F.sum("n_rows").alias("n")))
    share = ratio(F.col("n_rows"), total["n"])
    return counts.select(label, "n_rows", share.alias("share"), (share < rare).alias("is_rare"))


def worst_rows(
    df: DataFrame, reference: DataFrame, keys: Sequence[str], by: str, error: str, features: Sequence[str], k: int = 5
) -> DataFrame:
    """The k rows with the largest absolute error per group, with feature z-scores against the reference.

    Spark keeps only k rows per group and task before the shuffle.
    """
    order = Window.partitionBy(by).orderBy(F.abs(error).desc(), *[F.col(c) for c in keys])
    top = df.withColumn("error_rank", F.row_number().over(order)).where(F.col("error_rank") <= k)
    moments = one_row(
        reference.agg(
            *[a for i, f in enumerate(features) for a in (F.avg(f).alias(f"m{i}"), F.stddev_samp(f).alias(f"s{i}"))]
        )
    )
    z = [
        F.try_divide(F.col(f).cast("double") - moments[f"m{i}"], moments[f"s{i}"]).alias(f"{f}_z")
        for i, f in enumerate(features)
    ]
    return top.select(by, "error_rank", *keys, error, *z)


def ranking_metrics(df: DataFrame, query: str, score: str, relevant: Column, tie_break: str, k: int = 10) -> DataFrame:
    """precision@k, recall@k and NDCG@k per query.

    Only the best k rows of a query leave a task; the number of relevant rows is a
    plain aggregate. A query with most of the rows costs no more than others.
    """
    marked = df.select(query, score, tie_break, relevant.cast("int").alias("_rel"))
    order = Window.partitionBy(query).orderBy(F.col(score).desc(), F.col(tie_break))
    top = marked.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= k)
    gains = top.groupBy(query).agg(
        F.sum("_rel").alias("_hits"), F.sum(F.col("_rel") / F.log2(F.col("_rank") + 1)).alias("_dcg")
    )
    totals = marked.groupBy(query).agg(F.sum("_rel").alias("n_relevant"))
    ideal = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.least(F.col("n_relevant"), F.lit(k)), F.lit(1)).cast("int")),
        F.lit(0.0),
        lambda acc, i: acc + 1 / F.log2(i + 1.0),
    )
    has = F.col("n_relevant") > 0
    return totals.join(gains, query).select(
        query, "n_relevant",
        (F.col("_hits") / F.lit(float(k))).alias("precision_at_k"),
        ratio(F.col("_hits"), F.col("n_relevant")).alias("recall_at_k"),
        F.when(has, F.col("_dcg") / ideal).otherwise(0.0).alias("ndcg_at_k"),
    )


#: What to do about each kind of finding.
ACTIONS = {
    "concept_drift": "retrain on a frequent schedule or learn online",
    "data_drift": "retrain on data of the current distribution",
    "new_categories": "engineer features for the new data patterns",
    "rare_class": "augment the data of underrepresented classes",
    "threshold": "adjust the decision threshold",
    "stable": "keep monitoring for drift",
}


def recommend(findings: DataFrame, kind: str = "finding") -> DataFrame:
    """Findings with their recommended action."""
    table = findings.sparkSession.createDataFrame(sorted(ACTIONS.items()), f"`{kind}` string, action string")
    return findings.join(F.broadcast(table), kind, "left")


def model_findings(
    reference: DataFrame, current: DataFrame, segment: str, categorical: Sequence[str], label: str, score: str,
    thresholds: Sequence[float], at: float = 0.5, rare: float = 0.05, gain: float = 0.01,
) -> DataFrame:
    """What a model meets in each segment that retraining on the same data would not mend: segment, finding, evidence.

    ``new_categories``: categories the reference lacks (their number). ``rare_class``: a
    class below ``rare`` of the segment (the smallest share). ``threshold``: another of the
    ``thresholds`` raises F1 by more than ``gain`` over the one in use, ``at`` (the best, the
    smallest of several). ``at`` must be among the thresholds; rows without label or score
    do not count.
    """
    grid = sorted(thresholds)
    if at not in grid:
        raise ValueError(f"{at} is not among the thresholds")
    keyed = current.withColumn("window_id", F.col(segment))
    new = category_changes(reference, keyed, categorical).groupBy("window_id").agg(F.sum("new_categories").alias("_n"))
    news = new.where(F.col("_n") > 0).select("window_id", F.lit("new_categories").alias("finding"), F.col("_n").cast("double").alias("evidence"))

    known = keyed.where(F.col(label).isNotNull() & F.col(score).isNotNull())
    # A few rows per segment: classes times gaps between thresholds.
    slots = known.groupBy("window_id", F.col(label).alias("_label"), bucket_of(F.col(score), grid).alias("_slot")).agg(F.count("*").alias("_n"))
    classes = slots.groupBy("window_id", "_label").agg(F.sum("_n").alias("_n"))
    smallest = classes.groupBy("window_id").agg(ratio(F.min("_n"), F.sum("_n")).alias("evidence"))
    rares = smallest.where(F.col("evidence") < rare).select("window_id", F.lit("rare_class").alias("finding"), "evidence")

    # A row is called positive at all thresholds up to its slot.
    is_positive = F.col("_label") == 1
    reached = slots.where(F.col("_slot") > 0).select("window_id", "_label", "_n", F.explode(F.sequence(F.lit(1), F.col("_slot"))).alias("_at"))
    called = reached.groupBy("window_id", "_at").agg(F.sum(F.when(is_positive, F.col("_n")).otherwise(0)).alias("_tp"), F.sum("_n").alias("_called"))
    actual = classes.where(is_positive).select("window_id", F.col("_n").alias("_actual"))
    f1 = F.round(ratio(2 * F.col("_tp"), F.col("_called") + F.col("_actual")), 9)
    scored = called.join(actual, "window_id").withColumns({"_f1": f1, "_threshold": F.element_at(F.array(*[F.lit(float(t)) for t in grid]), F.col("_at"))})
    best = scored.groupBy("window_id").agg(
        F.max("_f1").alias("_best"), F.max_by("_threshold", F.struct("_f1", -F.col("_at"))).alias("evidence"),
        F.coalesce(F.max(F.when(F.col("_threshold") == at, F.col("_f1"))), F.lit(0.0)).alias("_now"),
    )
    moved = best.where(F.col("_best") - F.col("_now") > gain).select("window_id", F.lit("threshold").alias("finding"), "evidence")
    return news.unionByName(rares).unionByName(moved).withColumnRenamed("window_id", segment)
