"""Every operator as a query over the test tables: name -> (spark, folder) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modelwake.functions import metrics as M
from modelwake.operators import cohorts, drift, prepare, profile, quality, rolling, sampling, views
from modelwake.operators.critical import poor_performance
from modelwake.operators.ordered import asof_join
from modelwake.operators.timewindows import calendar_split, interval_metric_buckets, ntz, plan_windows
from modelwake.plans import features
from modelwake.plans.monitoring import MonitoringRun
from modelwake.roles import ColumnRoles, SemanticType, TaskType, TimeConfig
from modelwake.session import materialize, scratch_path
from modelwake.sources import tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

NUMERIC = list(tables.NUMERIC_FEATURES)
CATEGORICAL = list(tables.CATEGORICAL_FEATURES)


TIE_SHIFT = 1.37e-8


def query(make: Query) -> Query:
    QUERIES[make.__name__] = make
    return make


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that the order of summation does not show.

    A value exactly between two steps would still show it, so all are moved by a
    hundredth of the smallest step first. -0.0 becomes 0.0.
    """
    doubles = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)]
    return df.withColumns({c: F.round(F.col(c) + TIE_SHIFT, digits) + F.lit(0.0) for c in doubles})


def run_of(spark: SparkSession, folder: str) -> MonitoringRun:
    reference, current = tables.reference_and_current(spark, folder)
    return MonitoringRun(reference, current, "ts", "target", "prediction", NUMERIC, CATEGORICAL)


# ---------------------------------------------------------------- windows and quality


@query
def window_bounds(spark, folder):
    return run_of(spark, folder).windows


@query
def order_window_bounds(spark, folder):
    """The order series is long enough for weekly windows."""
    return plan_windows(tables.table(spark, folder, "orders"), "o_orderdate").table(spark)


@query
def window_assignment_counts(spark, folder):
    return run_of(spark, folder).assigned.groupBy("window_id").agg(F.count("*").alias("n_rows"))


@query
def reference_current_split(spark, folder):
    reference, current = tables.reference_and_current(spark, folder)
    tagged = reference.select(F.lit("reference").alias("role"), "event_id", "ts")
    return tagged.unionByName(current.select(F.lit("current").alias("role"), "event_id", "ts"))


@query
def monitor_window_quality(spark, folder):
    run = run_of(spark, folder)
    joined = run.windows.join(run.quality, "window_id", "left")
    return rounded(joined.withColumn("poor_performance", poor_performance()))


@query
def perf_series(spark, folder):
    return rounded(run_of(spark, folder).series)


@query
def error_groups(spark, folder):
    return rounded(quality.error_group_stats(run_of(spark, folder).grouped, ["window_id"]))


@query
def error_bias(spark, folder):
    return rounded(quality.error_bias(run_of(spark, folder).grouped, NUMERIC, ["window_id"]))


@query
def category_bias(spark, folder):
    return quality.category_bias(run_of(spark, folder).grouped, CATEGORICAL, ["window_id"])


@query
def critical_windows(spark, folder):
    flags = run_of(spark, folder).flags
    return rounded(flags.withColumn("drifted", F.array_join("drifted", ",")))


@query
def critical_status(spark, folder):
    summary = run_of(spark, folder).summary
    return summary.withColumn("drifted_features", F.array_join("drifted_features", ","))


@query
def critical_windows_tests(spark, folder):
    """The windows under tests instead of distances."""
    reference, current = tables.reference_and_current(spark, folder)
    run = MonitoringRun(
        reference, current, "ts", "target", "prediction", NUMERIC, CATEGORICAL, "test", {"target": "ks", "prediction": "ks"}
    )
    return rounded(run.flags.withColumn("drifted", F.array_join("drifted", ",")))


def _flat_reports(reports: DataFrame, *more) -> DataFrame:
    groups = [
        F.col(f"error_distribution.{g}.{m}").alias(f"{g}_{m}") for g in quality.ERROR_GROUPS for m in ("mean", "std")
    ]
    performance = [
        F.col("feature_performance")["k"][c].alias(f"k_{c}") for c in ("range", "majority_value", "under_value", "over_value")
    ]
    scores = [F.round(F.col("drift_analysis.feature_scores")[c]["score"] + TIE_SHIFT, 6).alias(f"{c}_score") for c in ("target", "prediction")]
    return reports.select(
        "window_id", *more, "metrics.*", *groups, *performance, *scores,
        F.array_join("drift_analysis.drifted_features", ",").alias("drifted"), "is_critical",
    )


@query
def window_reports(spark, folder):
    return _flat_reports(run_of(spark, folder).reports())


@query
def interval_metrics(spark, folder):
    events = interval_metric_buckets(tables.scored_events(spark, folder), "ts", "day")
    return rounded(quality.regression_quality(events, "target", "prediction", ["bucket"]))


# ---------------------------------------------------------------- drift


@query
def ks_by_window(spark, folder):
    run = run_of(spark, folder)
    columns = [*NUMERIC, "target", "prediction"]
    return rounded(drift.ks(run.reference, run.assigned, columns, run.rows))


@query
def wasserstein_by_window(spark, folder):
    run = run_of(spark, folder)
    columns = [*NUMERIC, "target", "prediction"]
    return rounded(drift.wasserstein(run.reference, run.assigned, columns, run.rows))


@query
def chi2_by_window(spark, folder):
    run = run_of(spark, folder)
    return rounded(drift.chi_square(run.reference, run.assigned, CATEGORICAL))


def _with_flag(df: DataFrame) -> DataFrame:
    return df.withColumn("is_purchase", (F.col("event_type") == "purchase").cast("int"))


@query
def z_by_window(spark, folder):
    run = run_of(spark, folder)
    return rounded(drift.proportion_z(_with_flag(run.reference), _with_flag(run.assigned), ["is_purchase"]))


@query
def js_by_window(spark, folder):
    run = run_of(spark, folder)
    return rounded(drift.jensen_shannon(run.reference, run.assigned, CATEGORICAL))


@query
def psi_by_window(spark, folder):
    run = run_of(spark, folder)
    return rounded(drift.binned_divergence(run.reference, run.assigned, NUMERIC, run.rows).drop("kl"))


@query
def kl_by_window(spark, folder):
    run = run_of(spark, folder)
    return rounded(drift.binned_divergence(run.reference, run.assigned, NUMERIC, run.rows).drop("psi"))


@query
def drift_table(spark, folder):
    return rounded(run_of(spark, folder).feature_drift(only_critical=False))


@query
def critical_feature_drift(spark, folder):
    return rounded(run_of(spark, folder).feature_drift(only_critical=True))


@query
def drift_matrix(spark, folder):
    run = run_of(spark, folder)
    return rounded(views.drift_matrix(run.feature_drift(only_critical=False), range(1, run.plan.count + 1)))


@query
def dataset_drift(spark, folder):
    return rounded(drift.dataset_drift(run_of(spark, folder).feature_drift(only_critical=False)))


@query
def concept_shift(spark, folder):
    run = run_of(spark, folder)
    return rounded(drift.concept_shift(run.reference, run.assigned, NUMERIC, "target"))


@query
def prior_shift(spark, folder):
    run = run_of(spark, folder)
    return rounded(drift.prior_shift(run.reference, run.assigned, "event_type"))


# ---------------------------------------------------------------- data quality


@query
def quality_profile(spark, folder):
    return rounded(run_of(spark, folder).numeric_profile(only_critical=False))


@query
def category_profile(spark, folder):
    return rounded(run_of(spark, folder).category_profile(only_critical=False))


@query
def quality_delta(spark, folder):
    run = run_of(spark, folder)
    return rounded(profile.quality_delta(run.numeric_profile(only_critical=True), len(NUMERIC)))


@query
def mean_difference_series(spark, folder):
    run = run_of(spark, folder)
    delta = profile.quality_delta(run.numeric_profile(only_critical=False), len(NUMERIC))
    return rounded(views.mean_difference_series(delta))


@query
def box_stats(spark, folder):
    run = run_of(spark, folder)
    delta = profile.quality_delta(run.numeric_profile(only_critical=False), len(NUMERIC))
    return rounded(views.box_stats(delta, "mean_diff"))


@query
def new_categories(spark, folder):
    run = run_of(spark, folder)
    return profile.category_changes(run.reference, run.assigned, ["event_type", "user_id"])


@query
def feature_histogram(spark, folder):
    run = run_of(spark, folder)
    return profile.histogram(profile.stack(run.reference, run.assigned), [*NUMERIC, "target"])


@query
def outlier_counts(spark, folder):
    run = run_of(spark, folder)
    stacked = profile.stack(run.reference, run.assigned)
    return profile.outlier_counts(stacked, ["target", "prediction"], run.rows)


@query
def serving_mismatch(spark, folder):
    reference, current = tables.reference_and_current(spark, folder)
    serving = current.withColumn("k", F.when(F.col("hour") >= 12, F.col("k"))).drop("user_id")
    return rounded(profile.serving_mismatch(reference, serving.withColumn("hour", F.col("hour").cast("int"))))


# ---------------------------------------------------------------- retail features


def _grain(spark, folder):
    return rolling.purchase_grain(tables.transactions(spark, folder))


def _stored_grain(spark, folder):
    """For queries that read the purchases several times."""
    return features.stored_grain(tables.transactions(spark, folder))


@query
def churn_labels(spark, folder):
    return tables.churn_labels(spark, folder)


@query
def rolling_article_stats(spark, folder):
    daily = _grain(spark, folder).groupBy("article_id", "t_dat").agg(
        F.sum("n").alias("n"), F.sum("amount").alias("amount")
    )
    return rounded(rolling.rolling_article_stats(daily))


@query
def days_since_last(spark, folder):
    return rolling.purchase_gaps(_grain(spark, folder))


@query
def customer_running_stats(spark, folder):
    return rounded(rolling.customer_running_stats(_stored_grain(spark, folder)))


@query
def customer_running_mode(spark, folder):
    return rolling.customer_running_mode(
        _stored_grain(spark, folder), tables.articles(spark, folder), features.ARTICLE_ATTRIBUTES, features.MODAL_NAMES
    )


@query
def asof_customer(spark, folder):
    labels = tables.churn_labels(spark, folder).select("customer_id", "timestamp")
    stats = rolling.customer_running_stats(_stored_grain(spark, folder))
    values = [c for c in stats.columns if c not in ("customer_id", "t_dat")]
    return rounded(asof_join(labels, stats, "customer_id", "timestamp", "t_dat", values, features.CALENDAR_ROWS))


@query
def asof_article(spark, folder):
    txns = tables.transactions(spark, folder)
    month_after = F.date_trunc("month", F.add_months("t_dat", 1)).cast("timestamp_ntz")
    pairs = txns.select("article_id", month_after.alias("timestamp")).distinct()
    grain = _stored_grain(spark, folder)
    return rounded(features.items_at(pairs, grain, tables.articles(spark, folder), features.CALENDAR_ROWS))


@query
def week_bucket_aggs(spark, folder):
    return rounded(
        features.week_buckets(
            tables.churn_labels(spark, folder), _stored_grain(spark, folder), tables.articles(spark, folder), features.CALENDAR_ROWS,
            tidy=True,
        )
    )


@query
def churn_features(spark, folder):
    return rounded(
        features.churn_features(
            tables.churn_labels(spark, folder),
            tables.transactions(spark, folder),
            tables.articles(spark, folder),
            tables.customers(spark, folder),
        )
    )


@query
def item_sales_features(spark, folder):
    return rounded(
        features.item_sales_features(
            tables.item_sales_labels(spark, folder),
            tables.transactions(spark, folder),
            tables.articles(spark, folder),
            tables.customers(spark, folder),
        )
    )


@query
def calendar_split_orders(spark, folder):
    orders = tables.table(spark, folder, "orders").select("o_orderkey", "o_orderdate")
    return calendar_split(orders, "o_orderdate", TimeConfig(year=1998))


# ---------------------------------------------------------------- metrics


@query
def confusion(spark, folder):
    docs = tables.scored_documents(spark, folder)
    counts = M.with_rates(M.confusion(docs, "y", "p"))
    return rounded(counts.select("tn", "fp", "fn", "tp", "false_negative_rate", "false_positive_rate", "selection_rate", "predicted_positive_rate"))


@query
def classification_metrics(spark, folder):
    return rounded(M.classification_metrics(tables.scored_documents(spark, folder), "y", "p", ["lang"]))


def _classes(df: DataFrame) -> DataFrame:
    def level(c: str):
        return F.floor(F.col(c) / 50).cast("int")

    return df.withColumn("y", level("target")).withColumn("p", level("prediction"))


@query
def class_report(spark, folder):
    return rounded(M.class_report(_classes(tables.scored_events(spark, folder)), "y", "p"))


@query
def weighted_prf(spark, folder):
    return rounded(M.weighted_prf(_classes(tables.scored_events(spark, folder)), "y", "p", ["event_type"]))


@query
def auc_exact(spark, folder):
    rows = tables.row_count(spark, folder, "labels")
    return rounded(M.auc(tables.scored_documents(spark, folder), "y", "score", rows, ["source"]))


# The plans for hot groups, with every group split; their SQL is that of the plain queries.


@query
def ks_by_window_split(spark, folder):
    run = run_of(spark, folder)
    return rounded(drift.ks(run.reference, run.assigned, [*NUMERIC, "target", "prediction"], run.rows, split_above=0))


@query
def wasserstein_by_window_split(spark, folder):
    run = run_of(spark, folder)
    return rounded(drift.wasserstein(run.reference, run.assigned, [*NUMERIC, "target", "prediction"], run.rows, split_above=0))


@query
def auc_exact_split(spark, folder):
    rows = tables.row_count(spark, folder, "labels")
    return rounded(M.auc(tables.scored_documents(spark, folder), "y", "score", rows, ["source"], split_above=0))


@query
def asof_customer_split(spark, folder):
    labels = tables.churn_labels(spark, folder).select("customer_id", "timestamp")
    stats = rolling.customer_running_stats(_stored_grain(spark, folder))
    values = [c for c in stats.columns if c not in ("customer_id", "t_dat")]
    return rounded(asof_join(labels, stats, "customer_id", "timestamp", "t_dat", values, features.CALENDAR_ROWS, split_above=0))


@query
def drift_tests(spark, folder):
    """The drift table in the regime of tests: p-values instead of distances."""
    run = run_of(spark, folder)
    table = drift.drift_table(run.reference, run.assigned, ["k", "hour"], CATEGORICAL, run.rows, regime="test")
    return rounded(table.select("window_id", "feature", "method", "statistic", "p_value", "detected"))


@query
def log_loss(spark, folder):
    docs = tables.scored_documents(spark, folder)
    return rounded(
        docs.groupBy("lang").agg(
            M.log_loss(F.col("y"), F.col("score")).alias("score_log_loss"),
            M.log_loss(F.col("y"), F.col("p")).alias("label_log_loss"),
        )
    )


@query
def regression_metrics(spark, folder):
    rows = tables.row_count(spark, folder, "events")
    return rounded(M.regression_metrics(tables.scored_events(spark, folder), "target", "prediction", ["event_type"], rows))


@query
def metric_report(spark, folder):
    return rounded(
        M.metric_report(
            tables.scored_events(spark, folder), "target", "prediction", "regression", ["mse", "mae", "r2", "gini"]
        )
    )


@query
def model_degradation(spark, folder):
    return rounded(M.model_degradation(tables.scored_documents(spark, folder), "y", "p", "p_other"))


_EVENT_ROLES = ColumnRoles(
    {
        "event_id": SemanticType.NUMERICAL,
        "ts": SemanticType.TIMESTAMP,
        "event_type": SemanticType.CATEGORICAL,
        "k": SemanticType.NUMERICAL,
        "hour": SemanticType.NUMERICAL,
    },
    ("event_id", "ts"),
    "target",
)


@query
def prediction_errors(spark, folder):
    scored = prepare.append_error(tables.scored_events(spark, folder), _EVENT_ROLES, TaskType.REGRESSION)
    return rounded(scored.select("event_id", "target", "prediction", "error"))


@query
def feature_projection(spark, folder):
    return rounded(_EVENT_ROLES.project(tables.scored_events(spark, folder)))


@query
def category_alignment(spark, folder):
    orders = tables.table(spark, folder, "orders")
    segments = tables.table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    joined = orders.join(segments, F.col("o_custkey") == F.col("c_custkey")).select(
        "o_orderkey", F.concat_ws("-", F.col("c_nationkey").cast("string"), "o_orderpriority").alias("cell"), "o_orderdate"
    )
    cut = ntz("1995-03-01")
    train, test = joined.where(F.col("o_orderdate") < cut), joined.where(F.col("o_orderdate") >= cut)
    return prepare.align_categories(train, test, ["cell"]).select("o_orderkey", "cell")


@query
def numeric_coercion(spark, folder):
    orders = tables.table(spark, folder, "orders").select(
        "o_orderkey", F.substring("o_orderpriority", 1, 1).alias("level"),
        F.regexp_extract("o_orderpriority", "^[0-9]-(N?)", 1).alias("mark"), "o_orderstatus",
    )
    texts = orders.select("o_orderkey", F.concat("mark", "level").alias("level"), "o_orderstatus")
    coerced = prepare.coerce(texts, ["level"], ["o_orderkey"])
    return prepare.yes_no_label(coerced, "o_orderstatus", "F")


# ---------------------------------------------------------------- cause analysis

_PERIOD_METRICS = ["mean_absolute_error", "mean_squared_error", "mean_prediction", "median_absolute_error", "r2_score"]


def _periods(spark, folder) -> DataFrame:
    reference, current = tables.reference_and_current(spark, folder)
    both = reference.withColumn("period", F.lit("reference")).unionByName(current.withColumn("period", F.lit("current")))
    rows = 2 * tables.row_count(spark, folder, "events")
    return M.regression_metrics(both, "target", "prediction", ["period"], rows)


@query
def baseline_compare(spark, folder):
    return rounded(cohorts.compare_periods(_periods(spark, folder), "period", "reference", "current", _PERIOD_METRICS))


@query
def metric_change_rank(spark, folder):
    table = cohorts.compare_periods(_periods(spark, folder), "period", "reference", "current", _PERIOD_METRICS)
    return rounded(cohorts.rank_metric_changes(table))


@query
def train_test_gap(spark, folder):
    """Metrics of two hash splits side by side."""
    docs = sampling.hash_split(tables.scored_documents(spark, folder), ["doc_id"])
    table = M.classification_metrics(docs, "y", "p", ["split"])
    return rounded(cohorts.compare_periods(table, "split", "train", "test", list(M.CLASSIFICATION)))


@query
def deviation_alerts(spark, folder):
    series = run_of(spark, folder).series.select("window_id", "r2_score", "rmse")
    return rounded(cohorts.deviation_alerts(series, "r2_score", F.lit(0.95)))


@query
def impact_window(spark, folder):
    series = run_of(spark, folder).series.select("window_id", "r2_score")
    return cohorts.impact_window(cohorts.deviation_alerts(series, "r2_score", F.lit(0.95)), "r2_score")


@query
def drop_pattern(spark, folder):
    return rounded(cohorts.drop_pattern(run_of(spark, folder).series, "r2_score"))


_SETS = [["event_type"], ["day_part"], ["event_type", "day_part"], []]


def _with_day_part(df: DataFrame) -> DataFrame:
    return df.withColumn("day_part", F.floor(F.col("hour") / 6).cast("int"))


@query
def cohort_metrics(spark, folder):
    events = _with_day_part(tables.scored_events(spark, folder))
    return rounded(cohorts.cohort_metrics(events, "target", "prediction", _SETS))


@query
def cohort_rank(spark, folder):
    events = _with_day_part(tables.scored_events(spark, folder))
    table = cohorts.cohort_metrics(events, "target", "prediction", _SETS)
    return rounded(cohorts.rank_cohorts(table, ["event_type", "day_part"]))


@query
def cohort_shift(spark, folder):
    run = run_of(spark, folder)
    return rounded(cohorts.cohort_shift(run.reference, run.current, "event_type", NUMERIC, [], run.rows))


@query
def cohort_shift_tests(spark, folder):
    """Which features shifted in which part of the day, corrected for the number of tests."""
    run = run_of(spark, folder)
    current = _with_day_part(run.current)
    return rounded(cohorts.cohort_shift_tests(run.reference, current, "day_part", [*NUMERIC, "target", "prediction"], CATEGORICAL, run.rows))


@query
def segment_error_test(spark, folder):
    docs = tables.scored_documents(spark, folder)
    return rounded(cohorts.segment_error_test(docs, "lang", F.col("y") != F.col("p")))


@query
def segment_confusion(spark, folder):
    return M.confusion(tables.scored_documents(spark, folder), "y", "p", ["source"])


@query
def segment_residuals(spark, folder):
    run = run_of(spark, folder)
    grouped = quality.with_error_groups(run.current, "target", "prediction", ["event_type"], run.rows)
    return rounded(quality.error_group_stats(grouped, ["event_type"]))


@query
def threshold_sweep(spark, folder):
    grid = [i / 20 for i in range(1, 20)]
    return rounded(cohorts.threshold_sweep(tables.scored_documents(spark, folder), "y", "score", grid))


@query
def error_tails(spark, folder):
    run = run_of(spark, folder)
    return rounded(quality.error_tails(run.assigned, "target", "prediction", ["window_id"], run.rows))


@query
def worst_rows(spark, folder):
    run = run_of(spark, folder)
    scored = run.assigned.withColumn("error", F.round(F.col("prediction") - F.col("target"), 6))
    return rounded(cohorts.worst_rows(scored, run.reference, ["event_id"], "window_id", "error", [*NUMERIC, "target"]))


@query
def ranking_metrics(spark, folder):
    events = tables.scored_events(spark, folder)
    return rounded(cohorts.ranking_metrics(events, "user_id", "target", F.col("event_type") == "purchase", "event_id"))


@query
def calibration(spark, folder):
    return rounded(cohorts.calibration(tables.scored_documents(spark, folder), "y", "score"))


@query
def confidence_cohorts(spark, folder):
    docs = tables.scored_documents(spark, folder).withColumn("band", cohorts.confidence_band("score", 5))
    return rounded(M.classification_metrics(docs, "y", "p", ["band"]))


@query
def fairness_rates(spark, folder):
    return rounded(cohorts.fairness_rates(tables.scored_documents(spark, folder), "y", "p", "lang"))


@query
def label_coverage(spark, folder):
    docs = tables.table(spark, folder, "documents")
    labels = tables.table(spark, folder, "labels")
    return rounded(cohorts.label_coverage(docs, labels, "doc_id", "quality", "source"))


def _order_halves(spark, folder) -> tuple[DataFrame, DataFrame]:
    orders = tables.table(spark, folder, "orders").select("o_custkey", "o_orderdate")
    cut = ntz("2001-06-01")
    return orders.where(F.col("o_orderdate") < cut), orders.where(F.col("o_orderdate") >= cut)


@query
def split_overlap(spark, folder):
    early, late = _order_halves(spark, folder)
    return cohorts.split_overlap(late, early, ["o_custkey"])


@query
def clean_rows(spark, folder):
    early, late = _order_halves(spark, folder)
    return cohorts.clean_rows(late, early, ["o_custkey"])


@query
def future_leakage(spark, folder):
    joined = tables.table(spark, folder, "lineitem").select("l_orderkey", "l_shipdate", "l_returnflag").join(
        tables.table(spark, folder, "orders").select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey")
    )
    return cohorts.future_leakage(joined, "l_shipdate", "o_orderdate", ["l_returnflag"])


@query
def period_over_period(spark, folder):
    orders = tables.table(spark, folder, "orders")
    daily = orders.groupBy("o_orderdate").agg(F.sum("o_totalprice").alias("amount"))
    return rounded(cohorts.period_over_period(daily, "o_orderdate", "amount", "7 DAY"), 4)


@query
def diversity(spark, folder):
    events = interval_metric_buckets(tables.scored_events(spark, folder), "ts", "day")
    return rounded(cohorts.diversity(events, "event_type", ["bucket"]))


@query
def class_shares(spark, folder):
    return rounded(cohorts.class_shares(tables.table(spark, folder, "documents"), "lang", 0.1))


@query
def recommendations(spark, folder):
    """Findings of the monitoring run, each with its action."""
    run = run_of(spark, folder)
    shifts = run.feature_drift(only_critical=False).groupBy("window_id").agg(F.max("detected").alias("shifted"))
    joined = run.flags.join(shifts, "window_id", "left")
    finding = (
        F.when(F.col("shifted"), "data_drift").when(F.col("is_critical"), "concept_drift").otherwise("stable")
    )
    return cohorts.recommend(joined.select("window_id", finding.alias("finding")))


@query
def model_findings(spark, folder):
    """Findings per source for a model that has seen no French texts, each with its action."""
    docs = tables.scored_documents(spark, folder)
    found = cohorts.model_findings(
        docs.where("lang <> 'fr'"), docs, "source", ["lang"], "y", "score", [i / 10 for i in range(1, 10)], rare=0.15
    )
    return rounded(cohorts.recommend(found))


@query
def serving_categories(spark, folder):
    """Customers and event types that only one of training and serving has."""
    run = run_of(spark, folder)
    training = run.reference.where("event_type <> 'signup'")
    return profile.category_mismatch(training, run.current, ["event_type", "user_id"])


# ---------------------------------------------------------------- samples and corruption


@query
def hash_sample(spark, folder):
    return sampling.hash_sample(tables.churn_labels(spark, folder), ["customer_id", "timestamp"], 500, seed=7)


@query
def head_rows(spark, folder):
    return sampling.head(tables.churn_labels(spark, folder), ["timestamp", "customer_id"], 500)


@query
def hash_split(spark, folder):
    orders = tables.table(spark, folder, "orders").select("o_orderkey")
    return sampling.hash_split(orders, ["o_orderkey"])


def _customers_plain(spark, folder) -> DataFrame:
    return tables.table(spark, folder, "customer").select(
        "c_custkey", "c_acctbal", "c_mktsegment", (F.col("c_acctbal") > 0).cast("int").alias("label")
    )


@query
def perturb_noise(spark, folder):
    return rounded(sampling.add_noise(_customers_plain(spark, folder), ["c_custkey"], ["c_acctbal"], seed=3), 3)


@query
def perturb_shuffle(spark, folder):
    return sampling.shuffle_values(_customers_plain(spark, folder), ["c_custkey"], "c_mktsegment", seed=3)


@query
def perturb_flip(spark, folder):
    return sampling.flip_labels(_customers_plain(spark, folder), ["c_custkey"], "label", seed=3)


# ---------------------------------------------------------------- learning


@query
def scaled_features(spark, folder):
    """Median imputation and standardisation of columns with gaps."""
    from modelwake.learning.pipeline import numeric_scaling, scaling_stage

    gaps = tables.scored_events(spark, folder).select("event_id", F.when(F.col("k") >= 20, F.col("k")).alias("k"), "hour")
    rows = tables.row_count(spark, folder, "events")
    scaled = scaling_stage(numeric_scaling(gaps, NUMERIC, rows)).transform(gaps)
    return rounded(scaled.select("event_id", "k_scaled", "hour_scaled"))


@query
def one_hot_slots(spark, folder):
    """Encoder fitted on the reference, applied to current rows with an unseen category."""
    from pyspark.ml import Pipeline
    from pyspark.ml.functions import vector_to_array

    from modelwake.learning.pipeline import category_stages

    reference, current = tables.reference_and_current(spark, folder)
    reference = reference.withColumn("event_type", F.when(F.col("event_type") != "signup", F.col("event_type")))
    fitted = Pipeline(stages=category_stages(CATEGORICAL)).fit(reference)
    slots = fitted.transform(current).select("event_type", F.transform(vector_to_array("event_type_hot"), lambda v: v.cast("int")).alias("h"))
    return slots.groupBy("event_type", F.concat_ws("", F.transform("h", lambda v: v.cast("string"))).alias("slots")).agg(F.count("*").alias("n_rows"))


def _order_periods(spark, folder) -> tuple[DataFrame, DataFrame]:
    orders = tables.table(spark, folder, "orders").withColumn("large", (F.col("o_totalprice") > 250000).cast("int"))
    early = F.col("o_orderdate") < F.lit("1997-01-01").cast("timestamp_ntz")
    return orders.where(early), orders.where(~early)


@query
def category_dictionary(spark, folder):
    """Indices of a narrow and a wide column, fitted on early orders and applied to later ones."""
    from modelwake.learning import dictionary

    early, late = _order_periods(spark, folder)
    columns = ["o_orderpriority", "o_custkey"]
    known = dictionary.fit_dictionary(early, columns)
    encoded = dictionary.one_hot(dictionary.encode(late, known, columns), known, ["o_orderpriority"])
    slots = F.concat_ws("", F.transform("o_orderpriority_hot", lambda v: v.cast("string")))
    return encoded.groupBy("o_orderpriority", F.col("o_orderpriority_index").alias("priority_index"), slots.alias("slots")).agg(
        F.count("*").alias("n_rows"), F.sum("o_custkey_index").alias("custkey_indices"), F.max("o_custkey_index").alias("custkey_last")
    )


@query
def target_means(spark, folder):
    """Out-of-fold means for early orders, fitted means for later ones."""
    from modelwake.learning import dictionary

    early, late = _order_periods(spark, folder)
    columns = ["o_orderpriority", "o_custkey"]
    inside = dictionary.out_of_fold_means(early, ["o_orderkey"], columns, "large", seed=11)
    after = dictionary.apply_target_means(late, dictionary.fit_target_means(early, columns, "large"), columns)
    kept = ["o_orderkey", "o_orderpriority_mean", "o_custkey_mean"]
    both = inside.select(F.lit("train").alias("period"), *kept).unionByName(after.select(F.lit("score").alias("period"), *kept))
    return rounded(both)


def _forest(spark, folder):
    from modelwake.learning.pipeline import forest_regression

    reference, current = tables.reference_and_current(spark, folder)
    reference, current = reference.drop("prediction"), current.drop("prediction")
    return forest_regression(reference, NUMERIC, CATEGORICAL, "target"), reference, current


@query
def rf_regression(spark, folder):
    model, _, current = _forest(spark, folder)
    scored = model.transform(current)
    return M.regression_metrics(scored, "target", "prediction", ["event_type"], tables.row_count(spark, folder, "events"))


@query
def rf_importance(spark, folder):
    from modelwake.learning.importance import tree_importance

    return tree_importance(_forest(spark, folder)[0], [*NUMERIC, *CATEGORICAL], spark)


@query
def permutation_importance(spark, folder):
    from modelwake.learning.importance import permutation_importance as measure

    model, _, current = _forest(spark, folder)
    return measure(model, current, ["event_id"], [*NUMERIC, *CATEGORICAL], "target", "prediction")


@query
def partial_dependence(spark, folder):
    from modelwake.learning.importance import partial_dependence as curve

    model, _, current = _forest(spark, folder)
    return curve(model, current, "k", [0, 25, 50, 75, 99], "prediction")


@query
def forest_by_nodes(spark, folder):
    """Does every current row get the forest's prediction from the joins with its node table?"""
    from modelwake.learning import nodes

    model, _, current = _forest(spark, folder)
    table = materialize(nodes.node_table(model.stages[-1], spark))
    scored = model.transform(current)
    joined = scored.select("event_id", "prediction").join(nodes.forest_scores(scored, ["event_id"], "_features", table), "event_id")
    return joined.select("event_id", (F.abs(F.col("score") - F.col("prediction")) < 1e-9).alias("agrees"))


@query
def importance_by_nodes(spark, folder):
    """Is the importance from the node table that of the model?"""
    from modelwake.learning import nodes
    from modelwake.learning.importance import tree_importance

    model = _forest(spark, folder)[0]
    names = [*NUMERIC, *CATEGORICAL]
    table = materialize(nodes.node_table(model.stages[-1], spark))
    own = nodes.node_importance(table, names).withColumnRenamed("importance", "own")
    joined = tree_importance(model, names, spark).join(own, "feature")
    return joined.select("feature", (F.abs(F.col("own") - F.col("importance")) < 1e-9).alias("agrees"))


def _boosted(spark, folder):
    from modelwake.learning.pipeline import boosted_classifier

    docs = sampling.hash_split(tables.scored_documents(spark, folder).drop("p"), ["doc_id"])
    train, test = docs.where(F.col("split") == "train"), docs.where(F.col("split") == "test")
    return boosted_classifier(train, test, ["score"], ["lang", "source"], "y", "p", rounds=20), test


@query
def boosted_by_nodes(spark, folder):
    """Is the class of every test document the sign of the weighted sum over its leaves?"""
    from modelwake.learning import nodes

    model, test = _boosted(spark, folder)
    table = materialize(nodes.node_table(model.stages[-1], spark))
    scored = model.transform(test)
    joined = scored.select("doc_id", "p").join(nodes.boosted_scores(scored, ["doc_id"], "_features", table), "doc_id")
    return joined.select("doc_id", ((F.col("score") > 0).cast("double") == F.col("p")).alias("agrees"))


@query
def gbt_classifier(spark, folder):
    model, test = _boosted(spark, folder)
    return M.classification_metrics(model.transform(test), "y", "p")


@query
def tabular_regression(spark, folder):
    """Prepared pipeline with a boosted regressor: fit on the reference, score and evaluate the current rows."""
    from modelwake.learning.pipeline import TabularModel, boosted_trees

    reference, current = tables.reference_and_current(spark, folder)
    estimator = boosted_trees(TaskType.REGRESSION, "target", "prediction", maxIter=10)
    model = TabularModel(_EVENT_ROLES, TaskType.REGRESSION).fit(reference.drop("prediction"), estimator)
    return model.evaluate(current.drop("prediction"))


# ---------------------------------------------------------------- sources and sinks


def _order_sums(source: str, orders: DataFrame) -> DataFrame:
    return orders.agg(
        F.lit(source).alias("source"), F.count("*").alias("n_rows"), F.coalesce(F.sum("o_totalprice"), F.lit(0.0)).alias("total"),
        F.coalesce(F.sum(F.col("o_orderkey").cast("long")), F.lit(0)).alias("keys"),
    )


@query
def source_round_trips(spark, folder):
    """Orders written and read back by every source and sink, an empty split and an open reader among them."""
    from functools import reduce

    from modelwake.sources import files

    orders = tables.table(spark, folder, "orders")
    root = scratch_path(spark, "sources")
    plain = orders.select("o_orderdate", "o_orderkey", "o_totalprice")
    plain.withColumnsRenamed({c: c.upper() for c in plain.columns}).write.csv(f"{root}/upper", header=True)
    plain.write.csv(f"{root}/plain", header=True)
    lower = prepare.coerce(files.read_lower_csv(spark, f"{root}/upper"), ["o_orderkey", "o_totalprice"], [])
    files.ingest({"orders": orders}, f"{root}/ingest")
    files.write_by_month(orders, "o_orderdate", f"{root}/months")
    split = F.when(F.col("o_orderdate") < F.lit("2000-07-01").cast("timestamp_ntz"), "train").when(F.col("o_orderdate") < F.lit("2001-01-01").cast("timestamp_ntz"), "val")
    files.write_splits(orders.withColumn("split", split).where("split IS NOT NULL"), f"{root}/splits")
    name = "orders_" + root.rsplit("-", 1)[1]
    reader = files.create_or_replace(orders.where("o_orderkey % 2 = 0"), name)
    found = {
        "csv_time": files.read_time_csv(spark, f"{root}/plain", plain.schema), "csv_lower": lower,
        "ingest": spark.read.parquet(f"{root}/ingest/orders"), "months": spark.read.parquet(f"{root}/months"),
        "replaced": files.create_or_replace(orders, name), "reader": reader,
        **{f"split_{s}": df for s, df in files.read_splits(spark, f"{root}/splits").items()},
    }
    return rounded(reduce(DataFrame.unionByName, [_order_sums(s, df) for s, df in found.items()]), 2)


@query
def report_round_trip(spark, folder):
    """Window reports written as JSON and read back typed, with their time ranges."""
    from modelwake.sources import files

    path = scratch_path(spark, "reports")
    files.write_json_report(run_of(spark, folder).reports(), path)
    return _flat_reports(
        files.read_window_reports(spark, path), F.col("time_range.start").alias("window_start"), F.col("time_range.end").alias("window_end")
    )


# ---------------------------------------------------------------- streaming


def _run_stream(spark, folder, days: int) -> DataFrame:
    """Day panes from the stream, and the view over windows of ``days`` days."""
    from modelwake.streaming import panes

    reference, _ = tables.reference_and_current(spark, folder)
    base = panes.Reference.of(reference, "target", "prediction", tables.row_count(spark, folder, "events"))
    source = tables.table(spark, folder, "events").schema
    stream = spark.readStream.schema(source).parquet(f"{folder}/events*.parquet")
    cells = panes.paned(tables.score_events(stream), "ts", "target", "prediction", base)
    stored = panes.run_panes(cells, scratch_path(spark, "panes"), scratch_path(spark, "stream-state"))
    view = panes.window_view(stored, base, days)
    return rounded(view.withColumn("drifted", F.concat_ws(",", "drifted")))


@query
def stream_window_metrics(spark, folder):
    return _run_stream(spark, folder, 1)


@query
def stream_sliding_metrics(spark, folder):
    return _run_stream(spark, folder, 7)


@query
def stream_quarter_view(spark, folder):
    """Windows of 90 days, one for every day."""
    return _run_stream(spark, folder, 90)
