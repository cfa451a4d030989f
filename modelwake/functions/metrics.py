"""Evaluation metrics as aggregates: one pass, any grouping."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modelwake.functions.exprs import one_row, ratio
from modelwake.operators.joins import null_safe_join
from modelwake.operators.ordered import SPLIT_ROWS, exact_percentiles, running_totals

#: Clip bound of probabilities in the log loss.
LOG_LOSS_EPS = 1e-15

CLASSIFICATION = (
    "accuracy_score",
    "auc_score",
    "f1_score",
    "recall_score",
    "precision_score",
    "false_negative_rate",
    "selection_rate",
    "error_rate",
    "false_positive_rate",
)
REGRESSION = (
    "mean_absolute_error",
    "mean_squared_error",
    "mean_prediction",
    "median_absolute_error",
    "r2_score",
)


def confusion_counts(y: Column, p: Column, negative=0, positive=1) -> list[Column]:
    return [
        F.count_if((y == negative) & (p == negative)).alias("tn"),
        F.count_if((y == negative) & (p == positive)).alias("fp"),
        F.count_if((y == positive) & (p == negative)).alias("fn"),
        F.count_if((y == positive) & (p == positive)).alias("tp"),
    ]


def confusion(df: DataFrame, y: str, p: str, by: Sequence[str] = (), negative=0, positive=1) -> DataFrame:
    return df.groupBy(*by).agg(*confusion_counts(F.col(y), F.col(p), negative, positive))


def error_rate(y: Column, p: Column, diff: Column | None = None) -> Column:
    """Summed absolute difference, the sum cut to an integer, per row with both values; 0 for no rows."""
    gap = F.abs(p - y) if diff is None else diff.cast("double")
    return F.coalesce(ratio(F.sum(gap).cast("long"), F.count(gap)), F.lit(0.0))


def with_rates(counts: DataFrame) -> DataFrame:
    """Rates derived from the columns tn, fp, fn, tp.

    ``selection_rate`` is the share of actual positives; the share of predicted
    positives is ``predicted_positive_rate``.
    """
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    total = tn + fp + fn + tp
    precision = F.coalesce(ratio(tp, tp + fp), F.lit(0.0))
    recall = F.coalesce(ratio(tp, tp + fn), F.lit(0.0))
    f1 = F.coalesce(ratio(tp * 2, tp * 2 + fp + fn), F.lit(0.0))
    return counts.select(
        "*",
        ratio(tp + tn, total).alias("accuracy_score"),
        ((ratio(tp, tp + fn) + ratio(tn, tn + fp)) / 2).alias("auc_score"),
        f1.alias("f1_score"),
        recall.alias("recall_score"),
        precision.alias("precision_score"),
        ratio(fn, fn + tp).alias("false_negative_rate"),
        ratio(fn + tp, total).alias("selection_rate"),
        ratio(tp + fp, total).alias("predicted_positive_rate"),
        ratio(fp, fp + tn).alias("false_positive_rate"),
    )


def classification_metrics(df: DataFrame, y: str, p: str, by: Sequence[str] = ()) -> DataFrame:
    """The nine classification metrics for 0/1 labels, one row per group."""
    counts = df.groupBy(*by).agg(
        *confusion_counts(F.col(y), F.col(p)), error_rate(F.col(y), F.col(p)).alias("error_rate")
    )
    return with_rates(counts).select(*by, *CLASSIFICATION)


def log_loss(y: Column, score: Column) -> Column:
    clipped = F.least(F.greatest(score.cast("double"), F.lit(LOG_LOSS_EPS)), F.lit(1.0 - LOG_LOSS_EPS))
    return -F.avg(y * F.log(clipped) + (F.lit(1.0) - y) * F.log(F.lit(1.0) - clipped))


def r2(y: Column, p: Column) -> Column:
    """1 - SSE/SST; null when the target is constant."""
    scored = y.isNotNull() & p.isNotNull()
    target = F.when(scored, y.cast("double"))
    sst = F.var_pop(target) * F.count(target)
    return F.lit(1.0) - F.try_divide(F.sum((p - y) * (p - y)), F.when(sst > 0, sst))


def regression_metrics(
    df: DataFrame, y: str, p: str, by: Sequence[str] = (), rows: int = SPLIT_ROWS + 1
) -> DataFrame:
    """The five regression metrics, one row per group. ``rows`` bounds the input size."""
    error = F.col(p) - F.col(y)
    plain = [
        F.avg(F.abs(error)).alias("mean_absolute_error"),
        F.avg(error * error).alias("mean_squared_error"),
        F.avg(p).alias("mean_prediction"),
        r2(F.col(y), F.col(p)).alias("r2_score"),
    ]
    if rows <= SPLIT_ROWS:
        middle = F.percentile(F.abs(error), 0.5).alias("median_absolute_error")
        return df.groupBy(*by).agg(*plain, middle).select(*by, *REGRESSION)
    keys = list(by) or ["_all"]
    keyed = df if by else df.withColumn("_all", F.lit(1))
    medians = exact_percentiles(keyed.withColumn("_gap", F.abs(error)), keys, "_gap", [0.5], rows, "_mid")
    joined = null_safe_join(keyed.groupBy(*keys).agg(*plain), medians, keys)
    return joined.withColumn("median_absolute_error", F.col("_mid")[0]).select(*by, *REGRESSION)


def class_report(df: DataFrame, y: str, p: str, by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, F1 and support per true class, from one count per (y, p) cell.

    Like all metrics here it scores the rows with both values; null is no class.
    """
    scored = df.where(F.col(y).isNotNull() & F.col(p).isNotNull())
    cells = scored.groupBy(*by, F.col(y).alias("_y"), F.col(p).alias("_p")).agg(F.count("*").alias("n"))
    hit = F.when(F.col("_y") == F.col("_p"), F.col("n")).otherwise(0)
    roles = F.explode(
        F.array(
            F.struct(F.col("_y").alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted"), hit.alias("tp")),
            F.struct(F.col("_p").alias("label"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted"), F.lit(0).cast("long").alias("tp")),
        )
    )
    sides = cells.select(*by, roles.alias("r")).select(*by, "r.*")
    per_class = sides.groupBy(*by, "label").agg(
        F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("tp").alias("tp")
    )
    return per_class.select(
        *by,
        "label",
        "support",
        F.coalesce(ratio(F.col("tp"), F.col("predicted")), F.lit(0.0)).alias("precision"),
        F.coalesce(ratio(F.col("tp"), F.col("support")), F.lit(0.0)).alias("recall"),
        F.coalesce(ratio(F.col("tp") * 2, F.col("predicted") + F.col("support")), F.lit(0.0)).alias("f1"),
    )


def weighted_prf(df: DataFrame, y: str, p: str, by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall and F1 averaged over the true classes by support."""
    report = class_report(df, y, p, by)
    weighted = [
        ratio(F.sum(F.col(m) * F.col("support")), F.sum("support")).alias(m)
        for m in ("precision", "recall", "f1")
    ]
    return report.groupBy(*by).agg(*weighted)


def score_counts(df: DataFrame, y: str, score: str, by: Sequence[str]) -> DataFrame:
    return df.where(F.col(score).isNotNull()).groupBy(*by, score).agg(
        F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) == 0).alias("neg")
    )


def auc(df: DataFrame, y: str, score: str, rows: int, by: Sequence[str] = (), split_above: int = SPLIT_ROWS) -> DataFrame:
    """Exact area under the ROC curve; equal scores count half."""
    keys = list(by) or ["_all"]
    keyed = df if by else df.withColumn("_all", F.lit(1))
    ranked = running_totals(score_counts(keyed, y, score, keys), keys, score, ["pos", "neg"], rows, split_above)
    below = (F.col("cum_neg") - F.col("neg")) + F.col("neg") / F.lit(2.0)
    area = ranked.groupBy(*keys).agg(
        F.sum(F.col("pos") * below).alias("wins"),
        F.max("tot_pos").alias("n_pos"),
        F.max("tot_neg").alias("n_neg"),
    )
    value = ratio(F.col("wins"), F.col("n_pos").cast("double") * F.col("n_neg"))
    return area.select(*by, "n_pos", "n_neg", value.alias("auc"))


#: Metric names a task report accepts.
REPORT_DEFAULTS = {
    "binary_classification": ("accuracy", "precision", "recall", "f1"),
    "regression": ("mse", "mae", "r2"),
}


def metric_report(df: DataFrame, y: str, p: str, task: str, metrics: Sequence[str] | None = None) -> DataFrame:
    """Rows (metric, value, error). An unknown metric gives a row with ``error`` set, not a failure."""
    if task not in REPORT_DEFAULTS:
        raise ValueError(f"no metrics are known for {task}; known are {', '.join(REPORT_DEFAULTS)}")
    wanted = list(metrics) if metrics is not None else list(REPORT_DEFAULTS[task])
    error = F.col(p) - F.col(y)
    simple = {
        "accuracy": lambda: F.avg((F.col(y) == F.col(p)).cast("double")),
        "mse": lambda: F.avg(error * error),
        "mae": lambda: F.avg(F.abs(error)),
        "r2": lambda: r2(F.col(y), F.col(p)),
    }
    weighted = ("precision", "recall", "f1")
    plain = [m for m in wanted if m in simple]
    results = df.agg(*[simple[m]().cast("double").alias(m) for m in plain], F.count("*").alias("_n"))
    if any(m in weighted for m in wanted):
        means = one_row(weighted_prf(df, y, p))
        results = results.withColumns({m: means[m] for m in weighted})
    known = set(simple) | set(weighted)
    entries = [
        F.struct(
            F.lit(m).alias("metric"),
            (F.col(m) if m in known else F.lit(None)).cast("double").alias("value"),
            F.lit(None if m in known else f"Error calculating {m}: Unsupported metric: {m}").cast("string").alias("error"),
        )
        for m in wanted
    ]
    return results.select(F.explode(F.array(*entries)).alias("r")).select("r.*")


COMPARED = ("accuracy", "precision", "recall", "f1", "log_loss")


def model_degradation(df: DataFrame, y: str, regular: str, corrupted: str) -> DataFrame:
    """Five metrics of two prediction columns and the relative loss in percent, in one pass."""
    aggregates = []
    for side, p in (("regular", regular), ("corrupted", corrupted)):
        counts = confusion_counts(F.col(y), F.col(p))
        aggregates += [c.alias(f"{side}_{n}") for c, n in zip(counts, ("tn", "fp", "fn", "tp"))]
        aggregates.append(log_loss(F.col(y), F.col(p)).alias(f"{side}_log_loss"))
    totals = df.agg(*aggregates)

    def value(side: str, metric: str) -> Column:
        tn, fp, fn, tp = (F.col(f"{side}_{n}") for n in ("tn", "fp", "fn", "tp"))
        forms = {
            "accuracy": ratio(tp + tn, tp + tn + fp + fn),
            "precision": F.coalesce(ratio(tp, tp + fp), F.lit(0.0)),
            "recall": F.coalesce(ratio(tp, tp + fn), F.lit(0.0)),
            "f1": F.coalesce(ratio(tp * 2, tp * 2 + fp + fn), F.lit(0.0)),
            "log_loss": F.col(f"{side}_log_loss"),
        }
        return forms[metric]

    rows = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(m).alias("metric"),
                    value("regular", m).alias("regular"),
                    value("corrupted", m).alias("corrupted"),
                )
                for m in COMPARED
            ]
        )
    )
    table = totals.select(rows.alias("r")).select("r.*")
    change = ratio(F.col("regular") - F.col("corrupted"), F.col("regular")) * 100
    return table.withColumn("degradation_pct", change)
