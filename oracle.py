"""The same queries as DuckDB SQL, written independently of the Spark plans.

Definitions that Spark reaches by running sums and equi joins are stated here in
their direct form: range joins, pooled samples, correlated subqueries, ASOF joins.
Methods of the drift table are distances.
"""

from __future__ import annotations

ORACLE: dict[str, str] = {}


def r(expression: str, name: str, digits: int = 6) -> str:
    """Rounded like the Spark side: moved off exact ties, -0.0 made 0.0."""
    return f"round(CAST({expression} AS DOUBLE) + 1.37e-8::DOUBLE, {digits}) + 0.0 AS {name}"


def reported(expression: str, name: str, digits: int) -> str:
    return f"CAST(round(CAST({expression} AS DECIMAL(28, 9)), {digits}) AS DOUBLE) + 0.0 AS {name}"


def with_(ctes: list[str], body: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n" + body.strip()


# ---------------------------------------------------------------- events

EV = """ev AS (
  SELECT event_id, ts, user_id, event_type, value AS target,
         value + ((event_id % 11) - 5) * (1.0::DOUBLE + 0.02::DOUBLE * d * d) AS prediction,
         CAST(regexp_extract(props, '"k": ?([0-9]+)', 1) AS DOUBLE) AS k,
         CAST(hour(ts) AS DOUBLE) AS hour
  FROM (SELECT *, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS d FROM events))"""
REF = "ref AS (SELECT * FROM ev WHERE ts <= TIMESTAMP '2024-01-10 00:00:00')"
CUR = "cur AS (SELECT * FROM ev WHERE ts >= TIMESTAMP '2024-01-10 00:00:00')"


def windows(source: str, ts: str) -> list[str]:
    return [
        f"bounds AS (SELECT min({ts}) AS lo, epoch_us(max({ts})) - epoch_us(min({ts})) AS span, count(*) AS c FROM {source})",
        """unit AS (SELECT *, CASE WHEN span >= 4*7*86400000000 THEN 7*86400000000
             WHEN span >= 7*86400000000 THEN 86400000000
             WHEN span >= 2*86400000000 THEN 6*3600000000 ELSE 3600000000 END AS u FROM bounds)""",
        "plan AS (SELECT lo, span, least(greatest(1, span // u), c // 4) AS n FROM unit)",
        """win AS (SELECT CAST(i + 1 AS INTEGER) AS window_id,
             lo + to_microseconds(CAST((i * span + n - 1) // n AS BIGINT)) AS window_start,
             lo + to_microseconds(CAST(((i + 1) * span) // n AS BIGINT)) AS window_end
             FROM plan, range((SELECT n FROM plan)) t(i))""",
    ]


WIN = [EV, REF, CUR, *windows("cur", "ts")]
ASG = "asg AS (SELECT cur.*, window_id FROM cur JOIN win ON ts BETWEEN window_start AND window_end)"
BASE = [*WIN, ASG]


def quality_sql(source: str, by: str) -> str:
    return f"""SELECT {by}, count(*) AS n_rows,
      1 - sum((prediction-target)*(prediction-target)) / nullif(var_pop(target)*count(*), 0) AS r2_score,
      sqrt(avg((prediction-target)*(prediction-target))) AS rmse, avg(prediction-target) AS mean_error,
      stddev_samp(prediction-target) AS error_std FROM {source} GROUP BY {by}"""


QUALITY = f"qual AS ({quality_sql('asg', 'window_id')})"
GROUPS = [
    "err AS (SELECT *, prediction - target AS error FROM asg)",
    "lim AS (SELECT window_id, quantile_cont(error, 0.05) AS a, quantile_cont(error, 0.95) AS b FROM err GROUP BY 1)",
    """grp AS (SELECT err.*, CASE WHEN round(error, 9) <= round(a, 9) THEN 'underestimation'
         WHEN round(error, 9) >= round(b, 9) THEN 'overestimation' ELSE 'majority' END AS error_group
         FROM err JOIN lim USING (window_id))""",
]

ORACLE["window_bounds"] = with_(WIN, "SELECT * FROM win")
ORACLE["order_window_bounds"] = with_(windows("orders", "o_orderdate"), "SELECT * FROM win")
ORACLE["window_assignment_counts"] = with_(BASE, "SELECT window_id, count(*) AS n_rows FROM asg GROUP BY 1")
ORACLE["reference_current_split"] = with_(
    [EV, REF, CUR],
    "SELECT 'reference' AS role, event_id, ts FROM ref UNION ALL SELECT 'current', event_id, ts FROM cur",
)
_Q = ", ".join(r(c, c) for c in ("r2_score", "rmse", "mean_error", "error_std"))
_POOR = "round(coalesce(r2_score, 0), 3) < 0.7"
ORACLE["monitor_window_quality"] = with_(
    [*BASE, QUALITY],
    f"SELECT window_id, window_start, window_end, n_rows, {_Q}, {_POOR} AS poor_performance FROM win LEFT JOIN qual USING (window_id)",
)
ORACLE["perf_series"] = with_(
    [*BASE, QUALITY],
    "SELECT window_id, 'Window ' || window_id AS label, window_start, window_end, "
    + ", ".join(r(f"coalesce({c}, 0)", c) for c in ("r2_score", "rmse", "mean_error", "error_std"))
    + " FROM win LEFT JOIN qual USING (window_id)",
)


def group_stats(by: str) -> str:
    return f"SELECT {by}, error_group, count(*) AS n_rows, {r('avg(error)', 'mean_error')}, {r('stddev_samp(error)', 'std_error')} FROM grp GROUP BY {by}, error_group"


ORACLE["error_groups"] = with_([*BASE, *GROUPS], group_stats("window_id"))


def bias(feature: str) -> str:
    def mean(g: str) -> str:
        return f"avg({feature}) FILTER (error_group = '{g}')"

    return f"""SELECT window_id, '{feature}' AS feature,
      abs({mean('overestimation')} - {mean('underestimation')}) * 100 / nullif(max({feature}) - min({feature}), 0) AS range,
      {mean('majority')} AS majority_value, {mean('underestimation')} AS under_value, {mean('overestimation')} AS over_value
      FROM grp GROUP BY 1"""


BIAS = f"bias AS ({bias('k')} UNION ALL {bias('hour')})"
ORACLE["error_bias"] = with_(
    [*BASE, *GROUPS, BIAS],
    "SELECT window_id, feature, " + ", ".join(r(c, c) for c in ("range", "majority_value", "under_value", "over_value")) + " FROM bias",
)
ORACLE["category_bias"] = with_(
    [*BASE, *GROUPS, "c AS (SELECT window_id, error_group, event_type AS value, count(*) AS n FROM grp GROUP BY ALL)"],
    """SELECT window_id, error_group, 'event_type' AS feature, value, n FROM c
       QUALIFY row_number() OVER (PARTITION BY window_id, error_group ORDER BY n DESC, value) = 1""",
)


def long(source: str, columns: list[str], keys: str = "") -> str:
    return " UNION ALL ".join(f"SELECT {keys} '{c}' AS feature, CAST({c} AS DOUBLE) AS x FROM {source}" for c in columns)


def pooled(columns: list[str], source: str = "asg", key: str = "window_id") -> list[str]:
    """Both samples of every (window, feature) sorted together, with both distribution functions."""
    return [
        f"rl AS ({long('ref', columns)})",
        f"cl AS ({long(source, columns, key + ' AS wid,')})",
        "wf AS (SELECT DISTINCT wid, feature FROM cl)",
        """pts AS (SELECT wid, feature, x, sum(rn) AS rn, sum(cn) AS cn FROM (
             SELECT wid, rl.feature, x, 1 AS rn, 0 AS cn FROM rl JOIN wf USING (feature)
             UNION ALL SELECT wid, feature, x, 0, 1 FROM cl) GROUP BY ALL)""",
        """cdf AS (SELECT wid, feature, x,
             CAST(sum(rn) OVER w AS DOUBLE) / sum(rn) OVER (PARTITION BY wid, feature) AS fr,
             CAST(sum(cn) OVER w AS DOUBLE) / sum(cn) OVER (PARTITION BY wid, feature) AS fc,
             lead(x) OVER (PARTITION BY wid, feature ORDER BY x) AS nx,
             sum(rn) OVER (PARTITION BY wid, feature) AS n_ref, sum(cn) OVER (PARTITION BY wid, feature) AS n_cur
             FROM pts WINDOW w AS (PARTITION BY wid, feature ORDER BY x))""",
    ]


KS_P = """CASE WHEN lam < 0.2 THEN 1.0 ELSE greatest(least(list_sum(list_transform(range(1, 101),
  lambda i: (CASE WHEN i % 2 = 1 THEN 2.0::DOUBLE ELSE -2.0::DOUBLE END) * exp(-2.0::DOUBLE * i * i * lam * lam))), 1), 0) END"""
FOUR = ["k", "hour", "target", "prediction"]
ORACLE["ks_by_window"] = with_(
    [
        *BASE, *pooled(FOUR),
        "d AS (SELECT wid, feature, max(abs(fr - fc)) AS statistic, CAST(max(n_cur) AS BIGINT) AS n_cur, CAST(max(n_ref) AS BIGINT) AS n_ref FROM cdf GROUP BY ALL)",
        "l AS (SELECT *, sqrt(CAST(n_ref AS DOUBLE) * n_cur / (n_ref + n_cur)) * statistic AS lam FROM d)",
    ],
    f"SELECT wid AS window_id, feature, {r('statistic', 'statistic')}, n_cur, n_ref, {r(KS_P, 'p_value')} FROM l",
)


def wasserstein(columns: list[str], name: str = "wd") -> list[str]:
    return [
        *pooled(columns),
        "sd AS (SELECT feature, greatest(stddev_pop(x), 0.001) AS s FROM rl GROUP BY 1)",
        f"""{name} AS (SELECT wid AS window_id, feature, CAST(max(n_cur) AS BIGINT) AS n_cur, CAST(max(n_ref) AS BIGINT) AS n_ref,
             sum(abs(fr - fc) * (nx - x)) / any_value(s) AS statistic FROM cdf JOIN sd USING (feature) GROUP BY 1, 2)""",
    ]


ORACLE["wasserstein_by_window"] = with_(
    [*BASE, *wasserstein(FOUR)], f"SELECT window_id, feature, n_cur, n_ref, {r('statistic', 'statistic')} FROM wd"
)


def shares(column: str) -> list[str]:
    return [
        f"rc AS (SELECT CAST({column} AS VARCHAR) AS value, count(*) AS rn FROM ref WHERE {column} IS NOT NULL GROUP BY 1)",
        f"cc AS (SELECT window_id, CAST({column} AS VARCHAR) AS value, count(*) AS cn FROM asg WHERE {column} IS NOT NULL GROUP BY 1, 2)",
        "ws AS (SELECT window_id, sum(cn) AS n_cur FROM cc GROUP BY 1)",
        "vals AS (SELECT value FROM rc UNION SELECT value FROM cc)",
        """sh AS (SELECT ws.window_id, vals.value, coalesce(rn, 0) AS rn, coalesce(cn, 0) AS cn, n_cur, (SELECT sum(rn) FROM rc) AS n_ref
             FROM ws CROSS JOIN vals LEFT JOIN rc USING (value) LEFT JOIN cc ON cc.window_id = ws.window_id AND cc.value = vals.value)""",
    ]


ORACLE["chi2_by_window"] = with_(
    [
        *BASE, *shares("event_type"),
        """st AS (SELECT window_id, CAST(max(n_cur) AS BIGINT) AS n_cur, CAST(max(n_ref) AS BIGINT) AS n_ref,
            count(*) FILTER (rn = 0) AS new_categories, CAST((SELECT count(*) FROM rc) - 1 AS INTEGER) AS df,
            sum((cn - n_cur * rn / n_ref::DOUBLE) ** 2 / (n_cur * rn / n_ref::DOUBLE)) AS x FROM sh GROUP BY 1)""",
    ],
    f"SELECT window_id, 'event_type' AS feature, n_cur, n_ref, new_categories, df, {r('x', 'statistic')}, {r('exp(-x/2) * (1 + x/2)', 'p_value')} FROM st",
)


def erfc(x: str) -> str:
    """Power series; far in the tail the value is 0 at six places."""
    return f"""CASE WHEN {x} > 4.5 THEN 0.0 ELSE 1 - 2 / sqrt(pi()) * list_sum(list_transform(range(0, 100),
      lambda i: (CASE WHEN i % 2 = 0 THEN 1 ELSE -1 END) * pow(({x})::DOUBLE, 2 * i + 1) / (gamma(i + 1.0) * (2 * i + 1)))) END"""


ORACLE["z_by_window"] = with_(
    [
        *BASE,
        "rf AS (SELECT count(*) AS n_ref, count(*) FILTER (event_type <> 'purchase') AS rh FROM ref)",
        "cf AS (SELECT window_id, count(*) AS n_cur, count(*) FILTER (event_type <> 'purchase') AS ch FROM asg GROUP BY 1)",
        "zz AS (SELECT *, (rh + ch) / (n_ref + n_cur)::DOUBLE AS pool FROM cf, rf)",
        "z AS (SELECT *, (ch / n_cur::DOUBLE - rh / n_ref::DOUBLE) / sqrt(pool * (1 - pool) * (1.0 / n_ref::DOUBLE + 1.0 / n_cur::DOUBLE)) AS statistic FROM zz)",
    ],
    f"SELECT window_id, 'is_purchase' AS feature, n_cur, n_ref, {r('statistic', 'statistic')}, {r(erfc('(abs(statistic) / sqrt(2))'), 'p_value')} FROM z",
)


def js(name: str = "jd") -> list[str]:
    return [
        "pq AS (SELECT *, rn / n_ref::DOUBLE AS p, cn / n_cur::DOUBLE AS q FROM sh)",
        f"""{name} AS (SELECT window_id, 'event_type' AS feature, CAST(max(n_cur) AS BIGINT) AS n_cur, CAST(max(n_ref) AS BIGINT) AS n_ref,
             sqrt(greatest(sum((CASE WHEN p > 0 THEN p * ln(2 * p / (p + q)) ELSE 0 END) + (CASE WHEN q > 0 THEN q * ln(2 * q / (p + q)) ELSE 0 END)) / 2, 0)) AS statistic
             FROM pq GROUP BY 1)""",
    ]


ORACLE["js_by_window"] = with_(
    [*BASE, *shares("event_type"), *js()], f"SELECT window_id, feature, n_cur, n_ref, {r('statistic', 'statistic')} FROM jd"
)


def binned(columns: list[str], source: str = "asg", key: str = "window_id") -> list[str]:
    return [
        f"rl AS ({long('ref', columns)})",
        f"cl AS ({long(source, columns, key + ' AS wid,')})",
        "ed AS (SELECT feature, quantile_cont(x, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9]) AS e FROM rl GROUP BY 1)",
        "rb AS (SELECT feature, len(list_filter(e, lambda v: v <= x)) AS bin, count(*) AS n FROM rl JOIN ed USING (feature) GROUP BY ALL)",
        "cb AS (SELECT wid, feature, len(list_filter(e, lambda v: v <= x)) AS bin, count(*) AS n FROM cl JOIN ed USING (feature) GROUP BY ALL)",
        "rt AS (SELECT feature, sum(n) AS n_ref FROM rb GROUP BY 1)",
        "ct AS (SELECT wid, feature, sum(n) AS n_cur FROM cb GROUP BY 1, 2)",
        """bq AS (SELECT ct.wid, ct.feature, n_cur, n_ref, greatest(coalesce(rb.n, 0) / n_ref::DOUBLE, 1e-4::DOUBLE) AS p,
             greatest(coalesce(cb.n, 0) / n_cur::DOUBLE, 1e-4::DOUBLE) AS q
             FROM ct JOIN rt USING (feature) CROSS JOIN range(10) b(bin)
             LEFT JOIN rb ON rb.feature = ct.feature AND rb.bin = b.bin
             LEFT JOIN cb ON cb.feature = ct.feature AND cb.wid = ct.wid AND cb.bin = b.bin)""",
        """bd AS (SELECT wid, feature, CAST(max(n_cur) AS BIGINT) AS n_cur, CAST(max(n_ref) AS BIGINT) AS n_ref,
             sum((q - p) * ln(q / p)) AS psi, sum(q * ln(q / p)) AS kl FROM bq GROUP BY 1, 2)""",
    ]


for _name in ("psi", "kl"):
    ORACLE[f"{_name}_by_window"] = with_(
        [*BASE, *binned(["k", "hour"])], f"SELECT wid AS window_id, feature, n_cur, n_ref, {r(_name, _name)} FROM bd"
    )

DRIFT = [
    *wasserstein(["k", "hour"]),
    *shares("event_type"),
    *js(),
    """dt AS (SELECT window_id, feature, 'num' AS feature_type, 'wasserstein' AS method, statistic FROM wd
           UNION ALL SELECT window_id, feature, 'cat', 'jensen_shannon', statistic FROM jd)""",
]
_DT = f"""SELECT window_id, feature, feature_type, method, {r('statistic', 'statistic')}, CAST(NULL AS DOUBLE) AS p_value,
  {r('statistic', 'score')}, statistic >= 0.1 AS detected, {r('statistic', 'intensity')} FROM dt"""
ORACLE["drift_table"] = with_([*BASE, *DRIFT], _DT)

TARGET_DRIFT = [
    "trl AS (" + long("ref", ["target", "prediction"]) + ")",
    "tcl AS (" + long("asg", ["target", "prediction"], "window_id AS wid,") + ")",
    """tpts AS (SELECT wid, feature, x, sum(rn) AS rn, sum(cn) AS cn FROM (
         SELECT wid, trl.feature, x, 1 AS rn, 0 AS cn FROM trl JOIN (SELECT DISTINCT wid, feature FROM tcl) USING (feature)
         UNION ALL SELECT wid, feature, x, 0, 1 FROM tcl) GROUP BY ALL)""",
    """tcdf AS (SELECT wid, feature, x,
         CAST(sum(rn) OVER w AS DOUBLE) / sum(rn) OVER (PARTITION BY wid, feature) AS fr,
         CAST(sum(cn) OVER w AS DOUBLE) / sum(cn) OVER (PARTITION BY wid, feature) AS fc,
         lead(x) OVER (PARTITION BY wid, feature ORDER BY x) AS nx
         FROM tpts WINDOW w AS (PARTITION BY wid, feature ORDER BY x))""",
    "tsd AS (SELECT feature, greatest(stddev_pop(x), 0.001) AS s FROM trl GROUP BY 1)",
    "td AS (SELECT wid AS window_id, feature, sum(abs(fr - fc) * (nx - x)) / any_value(s) AS score FROM tcdf JOIN tsd USING (feature) GROUP BY 1, 2)",
    "dn AS (SELECT window_id, string_agg(feature, ',' ORDER BY feature) FILTER (score >= 0.1) AS drifted FROM td GROUP BY 1)",
    f"""fl AS (SELECT window_id, window_start, window_end, r2_score, coalesce(drifted, '') AS drifted, {_POOR} AS poor_performance,
         ({_POOR}) OR drifted IS NOT NULL AS is_critical FROM win LEFT JOIN qual USING (window_id) LEFT JOIN dn USING (window_id))""",
]
FLAGGED = [*BASE, QUALITY, *TARGET_DRIFT]
ORACLE["critical_windows"] = with_(
    FLAGGED,
    f"SELECT window_id, window_start, window_end, {r('r2_score', 'r2_score')}, drifted, poor_performance, is_critical FROM fl",
)
ORACLE["critical_status"] = with_(
    FLAGGED,
    """SELECT count(*) AS total_windows, count(*) FILTER (is_critical) AS critical_windows,
       coalesce((SELECT string_agg(DISTINCT feature, ',' ORDER BY feature) FROM td WHERE score >= 0.1), '') AS drifted_features,
       CASE WHEN count(*) FILTER (is_critical) > count(*) // 2 THEN 'critical'
            WHEN count(*) FILTER (is_critical) > 0 THEN 'warning' ELSE 'stable' END AS status FROM fl""",
)


def _group_value(g: str, c: str) -> str:
    return f"(SELECT {c}(error) FROM grp WHERE grp.window_id = fl.window_id AND error_group = '{g}')"


ORACLE["window_reports"] = with_(
    [*FLAGGED, *GROUPS, BIAS],
    "SELECT fl.window_id, "
    + reported("coalesce(fl.r2_score, 0)", "r2_score", 3) + ", "
    + ", ".join(reported(f"coalesce({c}, 0)", c, 2) for c in ("rmse", "mean_error", "error_std")) + ", "
    + ", ".join(
        f"{reported(f'coalesce({_group_value(g, fn)}, 0)', f'{g}_{m}', 2)}"
        for g in ("majority", "underestimation", "overestimation") for m, fn in (("mean", "avg"), ("std", "stddev_samp"))
    ) + ", "
    + ", ".join(reported(f"coalesce({c}, 0)", f"k_{c}", d) for c, d in (("range", 2), ("majority_value", 3), ("under_value", 3), ("over_value", 3)))
    + f", {r('t.score', 'target_score')}, {r('p.score', 'prediction_score')}, drifted, is_critical"
    + """ FROM fl JOIN qual ON qual.window_id = fl.window_id JOIN bias ON bias.window_id = fl.window_id AND bias.feature = 'k'
       JOIN td t ON t.window_id = fl.window_id AND t.feature = 'target' JOIN td p ON p.window_id = fl.window_id AND p.feature = 'prediction'""",
)
ORACLE["critical_feature_drift"] = with_(
    [*FLAGGED, *DRIFT], _DT + " JOIN fl USING (window_id) WHERE is_critical"
)
ORACLE["drift_matrix"] = with_(
    [*BASE, *DRIFT],
    "SELECT feature, " + ", ".join(r(f"coalesce(max(statistic) FILTER (window_id = {i}), 0)", f"w{i}") for i in range(1, 21)) + " FROM dt GROUP BY 1",
)
ORACLE["dataset_drift"] = with_(
    [*BASE, *DRIFT],
    f"""SELECT window_id, count(*) AS n_columns, count(*) FILTER (statistic >= 0.1) AS n_drifted,
        {r('avg((statistic >= 0.1)::INT)', 'drift_share')}, avg((statistic >= 0.1)::INT) >= 0.5 AS dataset_drift FROM dt GROUP BY 1""",
)
ORACLE["interval_metrics"] = with_(
    [EV], f"SELECT bucket, n_rows, {_Q} FROM (" + quality_sql("(SELECT *, CAST(date_trunc('day', ts) AS TIMESTAMP) AS bucket FROM ev)", "bucket") + ")"
)
ORACLE["concept_shift"] = with_(
    BASE,
    " UNION ALL ".join(
        f"SELECT window_id, '{f}' AS feature, {r(f'corr({f}, target)', 'corr')}, {r(f'(SELECT corr({f}, target) FROM ref)', 'ref_corr')}, "
        f"{r(f'corr({f}, target) - (SELECT corr({f}, target) FROM ref)', 'shift')} FROM asg GROUP BY 1"
        for f in ("k", "hour")
    ),
)
ORACLE["prior_shift"] = with_(
    [*BASE, *shares("event_type")],
    f"""SELECT window_id, value AS label, {r('cn / n_cur', 'share')}, {r('rn / n_ref', 'ref_share')},
        {r('cn / n_cur - rn / n_ref', 'shift')}, {r('x', 'chi2')}, {r('exp(-x/2) * (1 + x/2)', 'chi2_p_value')}
        FROM sh JOIN (SELECT window_id, sum((cn - n_cur * rn / n_ref::DOUBLE) ** 2 / (n_cur * rn / n_ref::DOUBLE)) AS x FROM sh GROUP BY 1) USING (window_id)
        WHERE cn > 0 OR rn > 0""",
)

# ---------------------------------------------------------------- data quality

STACK = "stk AS (SELECT 0 AS window_id, * FROM ref UNION ALL SELECT window_id, * EXCLUDE (window_id) FROM asg)"


def profile(columns: list[str]) -> list[str]:
    return [
        STACK,
        f"sl AS ({long('stk', columns, 'window_id,')})",
        "vc AS (SELECT window_id, feature, x, count(*) AS n FROM sl WHERE x IS NOT NULL GROUP BY ALL)",
        "mc AS (SELECT window_id, feature, x AS most_common, n AS most_common_n FROM vc QUALIFY row_number() OVER (PARTITION BY window_id, feature ORDER BY n DESC, x) = 1)",
        """pr AS (SELECT window_id, feature, count(*) AS n_rows, count(*) FILTER (x IS NULL) AS missing, avg(x) AS mean, stddev_samp(x) AS std,
             min(x) AS min, max(x) AS max, count(*) FILTER (isinf(x)) AS infinite, quantile_cont(x, 0.25) AS q25, quantile_cont(x, 0.5) AS median,
             quantile_cont(x, 0.75) AS q75, count(DISTINCT x) AS unique_values FROM sl GROUP BY 1, 2)""",
        """pf AS (SELECT pr.*, most_common, most_common_n, 100.0 * missing / n_rows AS missing_pct, 100.0 * unique_values / n_rows AS unique_pct,
             100.0 * most_common_n / n_rows AS most_common_pct FROM pr LEFT JOIN mc USING (window_id, feature))""",
        """dl AS (SELECT c.window_id, c.feature, abs(c.mean - b.mean) AS mean_diff, abs(c.std - b.std) AS std_diff, c.unique_pct - b.unique_pct AS unique_diff
             FROM pf c JOIN pf b ON b.window_id = 0 AND b.feature = c.feature WHERE c.window_id > 0)""",
    ]


ORACLE["quality_profile"] = with_(
    [*BASE, *profile(["k", "hour"])],
    "SELECT window_id, feature, n_rows, missing, infinite, most_common_n, unique_values, "
    + ", ".join(r(c, c) for c in ("mean", "std", "min", "max", "q25", "median", "q75", "most_common", "missing_pct", "unique_pct", "most_common_pct"))
    + " FROM pf",
)
ORACLE["category_profile"] = with_(
    [
        *BASE, STACK,
        "vc AS (SELECT window_id, event_type AS v, count(*) AS n FROM stk WHERE event_type IS NOT NULL GROUP BY ALL)",
        "mc AS (SELECT window_id, v AS most_common, n AS most_common_n FROM vc QUALIFY row_number() OVER (PARTITION BY window_id ORDER BY n DESC, v) = 1)",
        "pr AS (SELECT window_id, count(*) AS n_rows, count(*) - count(event_type) AS missing, count(DISTINCT event_type) AS unique_values FROM stk GROUP BY 1)",
    ],
    f"""SELECT window_id, 'event_type' AS feature, n_rows, missing, most_common, most_common_n, unique_values,
        {r('100.0 * missing / n_rows', 'missing_pct')}, {r('100.0 * unique_values / n_rows', 'unique_pct')},
        {r('100.0 * most_common_n / n_rows', 'most_common_pct')} FROM pr JOIN mc USING (window_id)""",
)
_DELTA = ", ".join(r(c, c) for c in ("mean_diff", "std_diff", "unique_diff"))
ORACLE["quality_delta"] = with_(
    [*FLAGGED, *profile(["k", "hour"])],
    f"SELECT window_id, feature, {_DELTA} FROM dl JOIN fl USING (window_id) WHERE is_critical",
)
ORACLE["mean_difference_series"] = with_(
    [*BASE, *profile(["k", "hour"])],
    f"SELECT feature, window_id, 'Window ' || window_id AS label, {r('mean_diff', 'mean_diff')} FROM dl",
)
ORACLE["box_stats"] = with_(
    [*BASE, *profile(["k", "hour"])],
    f"""SELECT feature, count(mean_diff) AS n_windows, {r('quantile_cont(mean_diff, 0.25)', 'q1')}, {r('quantile_cont(mean_diff, 0.5)', 'median')},
        {r('quantile_cont(mean_diff, 0.75)', 'q3')} FROM dl GROUP BY 1""",
)
ORACLE["new_categories"] = with_(
    BASE,
    " UNION ALL ".join(
        f"""SELECT window_id, '{c}' AS feature,
        count(DISTINCT {c}) FILTER ({c} NOT IN (SELECT {c} FROM ref)) AS new_categories,
        (SELECT count(DISTINCT {c}) FROM ref) - count(DISTINCT {c}) FILTER ({c} IN (SELECT {c} FROM ref)) AS unused_categories FROM asg GROUP BY 1"""
        for c in ("event_type", "user_id")
    ),
)
ORACLE["feature_histogram"] = with_(
    [
        *BASE, STACK, f"sl AS ({long('stk', ['k', 'hour', 'target'], 'window_id,')})",
        "mm AS (SELECT feature, min(x) AS lo, max(x) AS hi FROM sl WHERE window_id = 0 GROUP BY 1)",
    ],
    """SELECT window_id, feature, CAST(CASE WHEN x < lo THEN 0 WHEN x > hi THEN 11 WHEN x = hi THEN 10
         ELSE least(floor((x - lo) / ((hi - lo) / 10)) + 1, 10) END AS INTEGER) AS bin, count(*) AS n_rows
       FROM sl JOIN mm USING (feature) WHERE x IS NOT NULL GROUP BY ALL""",
)
ORACLE["outlier_counts"] = with_(
    [
        *BASE, STACK, f"sl AS ({long('stk', ['target', 'prediction'], 'window_id,')})",
        "qq AS (SELECT feature, quantile_cont(x, 0.25) AS a, quantile_cont(x, 0.75) AS b FROM sl WHERE window_id = 0 GROUP BY 1)",
    ],
    """SELECT window_id, feature, count(*) AS n_rows, count(*) FILTER (x < a - 1.5 * (b - a) OR x > b + 1.5 * (b - a)) AS n_outliers
       FROM sl JOIN qq USING (feature) GROUP BY ALL""",
)
_MISMATCH = [
    ("event_id", "bigint", "bigint", "0", "0"), ("ts", "timestamp_ntz", "timestamp_ntz", "0", "0"),
    ("user_id", "bigint", None, "0", None), ("event_type", "string", "string", "0", "0"), ("target", "double", "double", "0", "0"),
    ("prediction", "double", "double", "0", "0"), ("k", "double", "double", "0", "avg((hour < 12)::INT)"), ("hour", "double", "int", "0", "0"),
]
ORACLE["serving_mismatch"] = with_(
    [EV, REF, CUR],
    " UNION ALL ".join(
        f"SELECT '{f}' AS feature, '{a}' AS train_type, {f"'{b}'" if b else 'NULL'} AS serving_type, {r(x, 'train_null_share')}, "
        f"{r(y, 'serving_null_share') if y else 'CAST(NULL AS DOUBLE) AS serving_null_share'}, "
        f"{str(a != b or f == 'k').lower()} AS mismatch FROM (SELECT * FROM cur) GROUP BY ALL HAVING true"
        if y and "avg" in y else
        f"SELECT '{f}', '{a}', {f"'{b}'" if b else 'NULL'}, 0.0::DOUBLE, {'0.0::DOUBLE' if y else 'CAST(NULL AS DOUBLE)'}, {str(a != b).lower()}"
        for f, a, b, x, y in sorted(_MISMATCH, key=lambda m: m[0] != "k")
    ),
)

# ---------------------------------------------------------------- retail

TX = """tx AS (SELECT o_custkey AS customer_id, l_partkey AS article_id, o_orderdate AS t_dat, l_extendedprice AS price,
     CASE WHEN l_returnflag = 'R' THEN 2 ELSE 1 END AS sales_channel_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
ART = "art AS (SELECT p_partkey AS article_id, p_brand AS department_no, p_type AS section_no, p_size AS perceived_colour_master_id FROM part)"
CUST = """cst AS (SELECT c_custkey AS customer_id, c_acctbal AS age, nullif(c_mktsegment, 'BUILDING') AS fn, CASE WHEN c_acctbal > 0 THEN 1 END AS active,
     c_mktsegment AS club_member_status, c_nationkey AS fashion_news_frequency FROM customer)"""
TIMES = "lt AS (SELECT unnest(generate_series(TIMESTAMP '1996-01-01', TIMESTAMP '2001-01-01', INTERVAL 28 DAY)) AS timestamp)"
LAB = """lab AS (SELECT customer_id, timestamp, CAST(NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = customer_id AND o_orderdate >= timestamp
     AND o_orderdate < timestamp + INTERVAL 7 DAY) AS INTEGER) AS churn
     FROM (SELECT DISTINCT o_custkey AS customer_id FROM orders) CROSS JOIN lt)"""
RETAIL = [TX, ART, CUST, TIMES, LAB]
ROLL = [
    """rw AS (SELECT article_id, t_dat, sum(price) OVER m / 3 AS amount, count(*) OVER m / 3 AS cnt FROM tx
         WINDOW m AS (PARTITION BY article_id ORDER BY t_dat RANGE BETWEEN INTERVAL 3 MONTH PRECEDING AND CURRENT ROW))""",
    "gap AS (SELECT customer_id, article_id, t_dat, date_diff('day', lag(t_dat) OVER (PARTITION BY customer_id ORDER BY t_dat, article_id), t_dat) AS days FROM tx)",
    "gd AS (SELECT article_id, t_dat, max(days) AS days FROM gap GROUP BY 1, 2)",
    "rs AS (SELECT article_id, t_dat, count(*) AS n_sales, max(amount) AS amount, max(cnt) AS cnt FROM rw GROUP BY 1, 2)",
    "itm AS (SELECT rs.*, days FROM rs JOIN gd USING (article_id, t_dat))",
]
RUN = [
    """run AS (SELECT DISTINCT customer_id, t_dat, count(*) OVER a AS total_purchase_count, sum(price) OVER a AS total_purchase_amount,
         avg(price) OVER a AS avg_purchase_price, count(DISTINCT article_id) OVER a AS total_unique_articles_purchased,
         avg(sales_channel_id - 1) OVER a AS prop_sales_channel_2 FROM tx
         WINDOW a AS (PARTITION BY customer_id ORDER BY t_dat RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))""",
    "run1 AS (SELECT customer_id, t_dat, max(total_purchase_count) AS total_purchase_count, max(total_purchase_amount) AS total_purchase_amount, max(avg_purchase_price) AS avg_purchase_price, max(total_unique_articles_purchased) AS total_unique_articles_purchased, max(prop_sales_channel_2) AS prop_sales_channel_2 FROM run GROUP BY 1, 2)",
]
_RUN_COLUMNS = "total_purchase_count, " + ", ".join(
    r(c, c) for c in ("total_purchase_amount", "avg_purchase_price")
) + ", total_unique_articles_purchased, " + r("prop_sales_channel_2", "prop_sales_channel_2")
ATTRS = (("department_no", "modal_dept_no"), ("section_no", "modal_section_no"), ("perceived_colour_master_id", "modal_color_id"))
MODES = [
    "cd AS (SELECT DISTINCT customer_id, t_dat FROM tx)",
    *[
        f"""rm{i} AS (SELECT cd.customer_id, cd.t_dat, {a} AS v FROM cd JOIN tx ON tx.customer_id = cd.customer_id AND tx.t_dat <= cd.t_dat
              JOIN art USING (article_id) GROUP BY 1, 2, 3
              QUALIFY row_number() OVER (PARTITION BY cd.customer_id, cd.t_dat ORDER BY count(*) DESC, {a}) = 1)"""
        for i, (a, _) in enumerate(ATTRS)
    ],
    "rmode AS (SELECT customer_id, t_dat, "
    + ", ".join(f"rm{i}.v AS {n}" for i, (_, n) in enumerate(ATTRS))
    + " FROM cd LEFT JOIN rm0 USING (customer_id, t_dat) LEFT JOIN rm1 USING (customer_id, t_dat) LEFT JOIN rm2 USING (customer_id, t_dat))",
]

ORACLE["churn_labels"] = with_([TIMES, LAB], "SELECT * FROM lab")
ORACLE["rolling_article_stats"] = with_(
    [TX, *ROLL],
    f"SELECT article_id, t_dat, n_sales, {r('amount', 'rolling_monthly_sales_amount')}, {r('cnt', 'rolling_monthly_sales_count')} FROM rs",
)
ORACLE["days_since_last"] = with_(
    [TX, ROLL[1]],
    "SELECT customer_id, article_id, t_dat, CAST(days AS INTEGER) AS days_since_last_sale, count(*) AS n_rows FROM gap GROUP BY ALL",
)
ORACLE["customer_running_stats"] = with_([TX, *RUN], f"SELECT customer_id, t_dat, {_RUN_COLUMNS} FROM run1")
ORACLE["customer_running_mode"] = with_([TX, ART, *MODES], "SELECT * FROM rmode")
ORACLE["asof_customer"] = with_(
    [*RETAIL, *RUN],
    f"SELECT lab.customer_id, lab.timestamp, {_RUN_COLUMNS} FROM lab ASOF LEFT JOIN run1 ON lab.customer_id = run1.customer_id AND lab.timestamp > run1.t_dat",
)
_ITEM = f"{r('amount', 'rolling_monthly_sales_amount')}, {r('cnt', 'rolling_monthly_sales_count')}, CAST(days AS INTEGER) AS days_since_last_sale"
ORACLE["asof_article"] = with_(
    [TX, ART, *ROLL, "prs AS (SELECT DISTINCT article_id, CAST(date_trunc('month', t_dat + INTERVAL 1 MONTH) AS TIMESTAMP) AS timestamp FROM tx)"],
    f"""SELECT prs.article_id, prs.timestamp, {_ITEM}, department_no, section_no, perceived_colour_master_id
        FROM prs ASOF LEFT JOIN itm ON prs.article_id = itm.article_id AND prs.timestamp > itm.t_dat
        LEFT JOIN art ON art.article_id = prs.article_id""",
)
WEEK = [
    """hit AS (SELECT lab.customer_id, lab.timestamp, CAST(w AS INTEGER) AS w, tx.article_id, tx.price, tx.sales_channel_id FROM lab CROSS JOIN range(1, 6) g(w)
         LEFT JOIN tx ON tx.customer_id = lab.customer_id AND tx.t_dat < lab.timestamp - to_days(CAST(7 * (w - 1) AS INTEGER))
           AND tx.t_dat >= lab.timestamp - to_days(CAST(7 * w AS INTEGER)))""",
    """rich AS (SELECT hit.*, amount, cnt, days FROM hit ASOF LEFT JOIN itm ON hit.article_id = itm.article_id AND hit.timestamp > itm.t_dat)""",
    """wk AS (SELECT customer_id, timestamp, w, count(*) AS num_purchases, sum(price) AS purchased_amount, avg(price) AS avg_purchase_price,
         count(DISTINCT article_id) AS num_unique_articles_purchased, avg(sales_channel_id - 1) AS prop_sales_channel_2,
         avg(amount) AS avg_monthly_sales_amount, avg(cnt) AS avg_monthly_sales_count, avg(days) AS avg_days_since_last_sale FROM rich GROUP BY 1, 2, 3)""",
    *[
        f"""wm{i} AS (SELECT customer_id, timestamp, w, {a} AS v FROM hit JOIN art USING (article_id) GROUP BY 1, 2, 3, 4
              QUALIFY row_number() OVER (PARTITION BY customer_id, timestamp, w ORDER BY count(*) DESC, {a}) = 1)"""
        for i, (a, _) in enumerate(ATTRS)
    ],
    "wks AS (SELECT wk.*, " + ", ".join(f"wm{i}.v AS {n}" for i, (_, n) in enumerate(ATTRS))
    + " FROM wk LEFT JOIN wm0 USING (customer_id, timestamp, w) LEFT JOIN wm1 USING (customer_id, timestamp, w) LEFT JOIN wm2 USING (customer_id, timestamp, w))",
]
_INT_WEEK = ("num_purchases", "num_unique_articles_purchased")
_DBL_WEEK = ("purchased_amount", "avg_purchase_price", "prop_sales_channel_2", "avg_monthly_sales_amount", "avg_monthly_sales_count", "avg_days_since_last_sale")
_WEEK_COLUMNS = ", ".join(
    part
    for w in range(1, 6)
    for part in (
        [f"max({c}) FILTER (w = {w}) AS {c}_{w}_weeks_ago" for c in _INT_WEEK]
        + [r(f"max({c}) FILTER (w = {w})", f"{c}_{w}_weeks_ago") for c in _DBL_WEEK]
        + [f"max({n}) FILTER (w = {w}) AS {n}_{w}_weeks_ago" for _, n in ATTRS]
    )
)
WPIV = f"wpiv AS (SELECT customer_id, timestamp, {_WEEK_COLUMNS} FROM wks GROUP BY 1, 2)"
ORACLE["week_bucket_aggs"] = with_([*RETAIL, *ROLL, *WEEK, WPIV], "SELECT * FROM wpiv")
ORACLE["churn_features"] = with_(
    [*RETAIL, *ROLL, *WEEK, WPIV, *RUN, *MODES, "rall AS (SELECT * FROM run1 JOIN rmode USING (customer_id, t_dat))"],
    f"""SELECT lab.customer_id, lab.timestamp, lab.churn, CAST(weekofyear(lab.timestamp) AS INTEGER) AS week_of_year,
        CAST(month(lab.timestamp) AS INTEGER) AS month_of_year, CAST(day(lab.timestamp) AS INTEGER) AS day_of_month,
        {r('age', 'age')}, CAST(fn IS NOT NULL AS INTEGER) AS fn_not_null, CAST(active IS NOT NULL AS INTEGER) AS is_active,
        club_member_status, fashion_news_frequency, {_RUN_COLUMNS}, modal_dept_no, modal_section_no, modal_color_id,
        wpiv.* EXCLUDE (customer_id, timestamp)
        FROM lab LEFT JOIN cst ON cst.customer_id = lab.customer_id
        ASOF LEFT JOIN rall ON lab.customer_id = rall.customer_id AND lab.timestamp > rall.t_dat
        LEFT JOIN wpiv ON wpiv.customer_id = lab.customer_id AND wpiv.timestamp = lab.timestamp""",
)
_ITEM_WEEK_D = ("sold_amount", "avg_price", "avg_buyer_age", "avg_monthly_purchase_amount", "avg_monthly_purchase_count", "avg_weeks_since_last_purchase")
ORACLE["item_sales_features"] = with_(
    [
        TX, ART, CUST, TIMES,
        """il AS (SELECT article_id, timestamp, coalesce((SELECT sum(price) FROM tx WHERE tx.article_id = a.article_id AND t_dat >= timestamp
             AND t_dat < timestamp + INTERVAL 7 DAY), 0.0) AS sales FROM (SELECT DISTINCT article_id FROM tx) a CROSS JOIN lt)""",
        """cr AS (SELECT customer_id, t_dat, sum(price) OVER m / 3 AS amount, count(*) OVER m / 3 AS cnt FROM tx
             WINDOW m AS (PARTITION BY customer_id ORDER BY t_dat RANGE BETWEEN INTERVAL 3 MONTH PRECEDING AND CURRENT ROW))""",
        "cr1 AS (SELECT customer_id, t_dat, max(amount) AS amount, max(cnt) AS cnt FROM cr GROUP BY 1, 2)",
        """ih AS (SELECT il.article_id, il.timestamp, CAST(w AS INTEGER) AS w, tx.customer_id, tx.price FROM il CROSS JOIN range(1, 6) g(w)
             JOIN tx ON tx.article_id = il.article_id AND tx.t_dat < il.timestamp - to_days(CAST(7 * (w - 1) AS INTEGER))
               AND tx.t_dat >= il.timestamp - to_days(CAST(7 * w AS INTEGER)))""",
        """ir AS (SELECT ih.*, amount, cnt, date_diff('day', cr1.t_dat, ih.timestamp) / 7.0::DOUBLE AS wks, age FROM ih
             ASOF LEFT JOIN cr1 ON ih.customer_id = cr1.customer_id AND ih.timestamp > cr1.t_dat LEFT JOIN cst ON cst.customer_id = ih.customer_id)""",
        """iw AS (SELECT article_id, timestamp, w, count(*) AS num_sales, sum(price) AS sold_amount, avg(price) AS avg_price,
             count(DISTINCT customer_id) AS num_customers, avg(age) AS avg_buyer_age, avg(amount) AS avg_monthly_purchase_amount,
             avg(cnt) AS avg_monthly_purchase_count, avg(wks) AS avg_weeks_since_last_purchase FROM ir GROUP BY 1, 2, 3)""",
    ],
    f"""SELECT il.article_id, il.timestamp, {r('any_value(sales)', 'sales')}, CAST(weekofyear(il.timestamp) AS INTEGER) AS week_of_year,
        CAST(month(il.timestamp) AS INTEGER) AS month_of_year, CAST(day(il.timestamp) AS INTEGER) AS day_of_month,
        any_value(department_no) AS department_no, any_value(section_no) AS section_no, any_value(perceived_colour_master_id) AS perceived_colour_master_id, """
    + ", ".join(
        part for w in range(1, 6) for part in (
            [f"coalesce(max({c}) FILTER (w = {w}), 0) AS {c}_{w}_weeks_ago" for c in ("num_sales", "num_customers")]
            + [r(f"max({c}) FILTER (w = {w})", f"{c}_{w}_weeks_ago") for c in _ITEM_WEEK_D]
        )
    )
    + " FROM il LEFT JOIN art ON art.article_id = il.article_id LEFT JOIN iw ON iw.article_id = il.article_id AND iw.timestamp = il.timestamp GROUP BY 1, 2",
)
ORACLE["calendar_split_orders"] = """SELECT * FROM (SELECT o_orderkey, o_orderdate,
  CASE WHEN month(o_orderdate) BETWEEN 1 AND 6 THEN 'train' WHEN month(o_orderdate) = 7 THEN 'val' WHEN month(o_orderdate) = 8 THEN 'test' END AS split
  FROM orders WHERE year(o_orderdate) = 1998) WHERE split IS NOT NULL"""

# ---------------------------------------------------------------- metrics

DOC = """doc AS (SELECT doc_id, lang, source, quality AS y, toxic, CAST(n_chars >= 1000 AS INTEGER) AS p, CAST(n_chars >= 2000 AS INTEGER) AS p_other,
     n_chars / (n_chars + 1000.0::DOUBLE) AS score FROM labels JOIN documents USING (doc_id))"""


def cells(source: str, by: str = "", y: str = "y", p: str = "p") -> str:
    keys = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f"""SELECT {keys}count(*) FILTER ({y}=0 AND {p}=0) AS tn, count(*) FILTER ({y}=0 AND {p}=1) AS fp,
      count(*) FILTER ({y}=1 AND {p}=0) AS fn, count(*) FILTER ({y}=1 AND {p}=1) AS tp, sum(abs({p}-{y})) AS wrong, count(*) AS n FROM {source} {group}"""


def div(a: str, b: str) -> str:
    return f"({a})::DOUBLE / nullif({b}, 0)"


RATES = {
    "accuracy_score": div("tp+tn", "tp+tn+fp+fn"),
    "auc_score": f"({div('tp', 'tp+fn')} + {div('tn', 'tn+fp')}) / 2",
    "f1_score": f"coalesce({div('2*tp', '2*tp+fp+fn')}, 0)",
    "recall_score": f"coalesce({div('tp', 'tp+fn')}, 0)",
    "precision_score": f"coalesce({div('tp', 'tp+fp')}, 0)",
    "false_negative_rate": div("fn", "fn+tp"),
    "selection_rate": div("fn+tp", "tp+tn+fp+fn"),
    "error_rate": "wrong::DOUBLE / n",
    "false_positive_rate": div("fp", "fp+tn"),
    "predicted_positive_rate": div("tp+fp", "tp+tn+fp+fn"),
}
NINE = [c for c in RATES if c != "predicted_positive_rate"]


def rates(names: list[str]) -> str:
    return ", ".join(r(RATES[c], c) for c in names)


ORACLE["confusion"] = with_(
    [DOC], f"SELECT tn, fp, fn, tp, {rates(['false_negative_rate', 'false_positive_rate', 'selection_rate', 'predicted_positive_rate'])} FROM ({cells('doc')})"
)
ORACLE["classification_metrics"] = with_([DOC], f"SELECT lang, {rates(NINE)} FROM ({cells('doc', 'lang')})")
LEVELS = "lev AS (SELECT event_type, CAST(floor(target/50) AS INTEGER) AS y, CAST(floor(prediction/50) AS INTEGER) AS p FROM ev)"


def per_class(by: str) -> str:
    keys = f"{by}, " if by else ""
    base = f"(SELECT DISTINCT {keys}y AS label FROM lev UNION SELECT DISTINCT {keys}p FROM lev)"
    same = f"AND l.{by} = c.{by}" if by else ""
    return f"""SELECT {f'c.{by}, ' if by else ''}c.label,
      (SELECT count(*) FROM lev l WHERE l.y = c.label {same}) AS support, (SELECT count(*) FROM lev l WHERE l.p = c.label {same}) AS predicted,
      (SELECT count(*) FROM lev l WHERE l.p = c.label AND l.y = c.label {same}) AS tp FROM {base} c"""


_PRF = f"coalesce({div('tp', 'predicted')}, 0) AS precision, coalesce({div('tp', 'support')}, 0) AS recall, coalesce({div('2*tp', 'predicted+support')}, 0) AS f1"
ORACLE["class_report"] = with_(
    [EV, LEVELS, f"pc AS (SELECT *, {_PRF} FROM ({per_class('')}))"],
    f"SELECT label, support, {r('precision', 'precision')}, {r('recall', 'recall')}, {r('f1', 'f1')} FROM pc",
)
ORACLE["weighted_prf"] = with_(
    [EV, LEVELS, f"pc AS (SELECT *, {_PRF} FROM ({per_class('event_type')}))"],
    "SELECT event_type, " + ", ".join(r(f"sum({m} * support) / sum(support)", m) for m in ("precision", "recall", "f1")) + " FROM pc GROUP BY 1",
)
ORACLE["auc_exact"] = with_(
    [DOC],
    f"""SELECT a.source, count(*) FILTER (y = 1) AS n_pos, count(*) FILTER (y = 0) AS n_neg,
      {r('''(SELECT sum(CASE WHEN p1.score > n1.score THEN 1.0 WHEN p1.score = n1.score THEN 0.5 ELSE 0 END)::DOUBLE FROM doc p1, doc n1
          WHERE p1.source = a.source AND n1.source = a.source AND p1.y = 1 AND n1.y = 0) / nullif(count(*) FILTER (y = 1) * count(*) FILTER (y = 0), 0)''', 'auc')}
      FROM doc a GROUP BY a.source""",
)


def loss(p: str) -> str:
    clip = f"least(greatest({p}::DOUBLE, 1e-15::DOUBLE), 1.0::DOUBLE - 1e-15::DOUBLE)"
    return f"-avg(y * ln({clip}) + (1 - y) * ln(1.0::DOUBLE - {clip}))"


ORACLE["log_loss"] = with_([DOC], f"SELECT lang, {r(loss('score'), 'score_log_loss')}, {r(loss('p'), 'label_log_loss')} FROM doc GROUP BY 1")
REGRESSION = {
    "mean_absolute_error": "avg(abs(prediction-target))",
    "mean_squared_error": "avg((prediction-target)*(prediction-target))",
    "mean_prediction": "avg(prediction)",
    "median_absolute_error": "quantile_cont(abs(prediction-target), 0.5)",
    "r2_score": "1 - sum((prediction-target)*(prediction-target)) / nullif(var_pop(target)*count(*), 0)",
}
ORACLE["regression_metrics"] = with_(
    [EV], "SELECT event_type, " + ", ".join(r(e, n) for n, e in REGRESSION.items()) + " FROM ev GROUP BY 1"
)
ORACLE["metric_report"] = with_(
    [EV],
    " UNION ALL ".join(
        f"SELECT '{m}' AS metric, {r(REGRESSION[n], 'value')}, CAST(NULL AS VARCHAR) AS error FROM ev"
        for m, n in (("mse", "mean_squared_error"), ("mae", "mean_absolute_error"), ("r2", "r2_score"))
    )
    + " UNION ALL SELECT 'gini', NULL, 'Error calculating gini: Unsupported metric: gini'",
)
_FIVE = {"accuracy": RATES["accuracy_score"], "precision": RATES["precision_score"], "recall": RATES["recall_score"], "f1": RATES["f1_score"]}
ORACLE["model_degradation"] = with_(
    [
        DOC, f"a AS ({cells('doc')})", f"b AS ({cells('doc', p='p_other')})",
        "m AS ("
        + " UNION ALL ".join(f"SELECT '{m}' AS metric, (SELECT {e} FROM a) AS regular, (SELECT {e} FROM b) AS corrupted" for m, e in _FIVE.items())
        + f" UNION ALL SELECT 'log_loss', (SELECT {loss('p')} FROM doc), (SELECT {loss('p_other')} FROM doc))",
    ],
    f"SELECT metric, {r('regular', 'regular')}, {r('corrupted', 'corrupted')}, {r('(regular - corrupted) / nullif(regular, 0) * 100', 'degradation_pct')} FROM m",
)
ORACLE["prediction_errors"] = with_(
    [EV], f"SELECT event_id, {r('target', 'target')}, {r('prediction', 'prediction')}, {r('prediction - target', 'error')} FROM ev"
)
ORACLE["feature_projection"] = with_([EV], f"SELECT event_type, {r('k', 'k')}, {r('hour', 'hour')}, {r('target', 'target')} FROM ev")
ORACLE["category_alignment"] = """WITH j AS (SELECT o_orderkey, c_nationkey || '-' || o_orderpriority AS cell, o_orderdate FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT o_orderkey, CASE WHEN cell IN (SELECT cell FROM j WHERE o_orderdate < TIMESTAMP '1995-03-01') THEN cell END AS cell
FROM j WHERE o_orderdate >= TIMESTAMP '1995-03-01'"""
ORACLE["numeric_coercion"] = """SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey,
  TRY_CAST((CASE WHEN substr(o_orderpriority, 3, 1) = 'N' THEN 'N' ELSE '' END) || substr(o_orderpriority, 1, 1) AS DOUBLE) AS level,
  CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS o_orderstatus FROM orders"""

# ---------------------------------------------------------------- cause analysis

PERIODS = [
    EV, REF, CUR,
    *[f"m{i} AS (SELECT {', '.join(f'{e} AS {n}' for n, e in REGRESSION.items())} FROM {s})" for i, s in enumerate(("ref", "cur"))],
    "cmp AS (" + " UNION ALL ".join(f"SELECT '{n}' AS metric, m0.{n} AS baseline, m1.{n} AS impact FROM m0, m1" for n in REGRESSION) + ")",
    "chg AS (SELECT *, impact - baseline AS delta, (impact - baseline) / nullif(abs(baseline), 0) * 100 AS change_pct FROM cmp)",
]
_CMP = f"metric, {r('baseline', 'baseline')}, {r('impact', 'impact')}, {r('delta', 'delta')}, {r('change_pct', 'change_pct')}"
ORACLE["baseline_compare"] = with_(PERIODS, f"SELECT {_CMP} FROM chg")
ORACLE["metric_change_rank"] = with_(
    PERIODS,
    f"""SELECT {_CMP}, CAST(rank() OVER (ORDER BY abs(change_pct) DESC NULLS LAST) AS INTEGER) AS change_rank,
      CASE WHEN (SELECT max(abs(change_pct)) FROM chg) >= 2 * (SELECT quantile_cont(abs(change_pct), 0.5) FROM chg) THEN 'specific' ELSE 'overall' END AS verdict FROM chg""",
)


def fraction(key: str, seed: str) -> str:
    return f"(('0x' || substr(md5('{seed}|' || {key}), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


ORACLE["train_test_gap"] = with_(
    [
        DOC, f"sp AS (SELECT *, CASE WHEN {fraction('doc_id', '42')} < 0.2 THEN 'test' ELSE 'train' END AS split FROM doc)",
        f"ms AS (SELECT split, {', '.join(f'{RATES[c]} AS {c}' for c in NINE)} FROM ({cells('sp', 'split')}))",
        "cmp AS (" + " UNION ALL ".join(f"SELECT '{c}' AS metric, max({c}) FILTER (split = 'train') AS baseline, max({c}) FILTER (split = 'test') AS impact FROM ms" for c in NINE) + ")",
        PERIODS[-1],
    ],
    f"SELECT {_CMP} FROM chg",
)
SERIES = [*BASE, QUALITY, "ser AS (SELECT window_id, coalesce(r2_score, 0) AS r2_score, coalesce(rmse, 0) AS rmse FROM win LEFT JOIN qual USING (window_id))"]
ORACLE["deviation_alerts"] = with_(
    SERIES,
    f"""SELECT window_id, {r('r2_score', 'r2_score')}, {r('rmse', 'rmse')}, 0.95::DOUBLE AS baseline,
        {r('abs(r2_score - 0.95) / 0.95', 'deviation')}, abs(r2_score - 0.95) / 0.95 > 0.3 AS alert FROM ser""",
)
ORACLE["impact_window"] = with_(
    SERIES,
    "SELECT min(window_id) AS impact_start, max(window_id) AS impact_end, count(*) AS n_windows FROM ser WHERE r2_score < 0.95 AND abs(r2_score - 0.95) / 0.95 > 0.3",
)
ORACLE["drop_pattern"] = with_(
    [
        *SERIES, "st AS (SELECT *, lag(r2_score) OVER (ORDER BY window_id) - r2_score AS dr FROM ser)",
        """sp AS (SELECT max(dr) AS largest_drop, (SELECT window_id FROM st WHERE dr IS NOT NULL ORDER BY dr DESC, window_id LIMIT 1) AS drop_window,
             max(r2_score) - min(r2_score) AS value_range, regr_slope(r2_score, window_id) AS slope, corr(r2_score, window_id) ** 2 AS fit FROM st)""",
    ],
    f"""SELECT {r('largest_drop', 'largest_drop')}, drop_window, {r('value_range', 'value_range')}, {r('slope', 'slope')}, {r('fit', 'fit')},
        CASE WHEN largest_drop / value_range >= 0.5 AND slope < 0 AND fit >= 0.5 THEN 'mixed' WHEN largest_drop / value_range >= 0.5 THEN 'sudden'
             WHEN slope < 0 AND fit >= 0.5 THEN 'gradual' ELSE 'no clear pattern' END AS pattern FROM sp""",
)
COHORT = [
    EV,
    "dp AS (SELECT event_type, CAST(CAST(floor(hour / 6) AS INTEGER) AS VARCHAR) AS day_part, prediction - target AS e FROM ev)",
    "co AS (" + " UNION ALL ".join(
        f"SELECT '{name}' AS cohort, {a} AS event_type, {b} AS day_part, count(*) AS n_rows, avg(e) AS mean_error, avg(abs(e)) AS mae, sqrt(avg(e*e)) AS rmse FROM dp {g}"
        for name, a, b, g in (
            ("event_type", "event_type", "CAST(NULL AS VARCHAR)", "GROUP BY event_type"),
            ("day_part", "CAST(NULL AS VARCHAR)", "day_part", "GROUP BY dp.day_part"),
            ("event_type+day_part", "event_type", "day_part", "GROUP BY dp.event_type, dp.day_part"),
            ("all", "CAST(NULL AS VARCHAR)", "CAST(NULL AS VARCHAR)", ""),
        )
    ) + ")",
]
ORACLE["cohort_metrics"] = with_(COHORT, f"SELECT cohort, event_type, day_part, n_rows, {r('mean_error', 'mean_error')}, {r('mae', 'mae')}, {r('rmse', 'rmse')} FROM co")
ORACLE["cohort_rank"] = with_(
    [*COHORT, """cr AS (SELECT c.*, c.n_rows::DOUBLE / a.n_rows * (c.mae - a.mae) AS contribution, a.mae AS am FROM co c, co a WHERE a.cohort = 'all' AND c.cohort <> 'all')"""],
    f"""SELECT cohort, event_type, day_part, n_rows, {r('mae', 'mae')}, {r('contribution', 'contribution')},
        CAST(dense_rank() OVER (PARTITION BY cohort ORDER BY round(contribution, 9) DESC) AS INTEGER) AS impact_rank, contribution > am * 0.01 AS high_impact FROM cr""",
)
ORACLE["cohort_shift"] = with_(
    [EV, REF, CUR, *pooled(["k", "hour"], "cur", "event_type"), *binned(["k", "hour"], "cur", "event_type")[2:]],
    f"""SELECT wid AS event_type, feature, 'ks' AS method, {r('max(abs(fr - fc))', 'statistic')} FROM cdf GROUP BY 1, 2
        UNION ALL SELECT wid, feature, 'psi', {r('psi', 'statistic')} FROM bd""",
)
ORACLE["cohort_shift_tests"] = with_(
    [
        EV, REF, CUR, "asg AS (SELECT *, CAST(floor(hour / 6) AS INTEGER) AS window_id FROM cur)", *pooled(FOUR), *shares("event_type"),
        "d AS (SELECT wid, feature, max(abs(fr - fc)) AS statistic, max(n_cur) AS n_cur, max(n_ref) AS n_ref FROM cdf GROUP BY ALL)",
        "l AS (SELECT *, sqrt(CAST(n_ref AS DOUBLE) * n_cur / (n_ref + n_cur)) * statistic AS lam FROM d)",
        "x2 AS (SELECT window_id, sum((cn - n_cur * rn / n_ref::DOUBLE) ** 2 / (n_cur * rn / n_ref::DOUBLE)) AS x FROM sh GROUP BY 1)",
        f"""ts AS (SELECT wid AS day_part, feature, 'ks' AS method, statistic, {KS_P} AS p FROM l
            UNION ALL SELECT window_id, 'event_type', 'chi2', x, exp(-x/2) * (1 + x/2) FROM x2)""",
        "lm AS (SELECT max(p) AS t FROM (SELECT p, row_number() OVER (ORDER BY p) AS i, count(*) OVER () AS m FROM ts) WHERE p <= 0.05::DOUBLE * i / m)",
    ],
    f"SELECT day_part, feature, method, {r('statistic', 'statistic')}, {r('p', 'p_value')}, coalesce(p <= t, false) AS shifted FROM ts, lm",
)
ORACLE["segment_error_test"] = with_(
    [
        DOC, "sg AS (SELECT lang, count(*) AS n_rows, count(*) FILTER (y <> p) AS n_errors FROM doc GROUP BY 1)",
        "tt AS (SELECT sum(n_rows)::DOUBLE AS n, sum(n_errors)::DOUBLE AS e, count(*) AS k FROM sg)",
        """cq AS (SELECT sum((n_errors - n_rows * e / n) ** 2 / (n_rows * e / n) + ((n_rows - n_errors) - n_rows * (1 - e / n)) ** 2 / (n_rows * (1 - e / n))) AS x FROM sg, tt)""",
        """zt AS (SELECT sg.*, k, x, (n_errors / n_rows::DOUBLE - (e - n_errors) / (n - n_rows)) /
              sqrt(e / n * (1 - e / n) * (1 / n_rows::DOUBLE + 1 / (n - n_rows))) AS z FROM sg, tt, cq)""",
    ],
    f"""SELECT lang, n_rows, n_errors, {r('n_errors / n_rows::DOUBLE', 'error_rate')}, {r('z', 'z')}, {r(erfc('(abs(z) / sqrt(2))'), 'z_p_value')},
        {r('x', 'chi2')}, CAST(k - 1 AS INTEGER) AS df, {r('(' + erfc('sqrt(x / 2)') + ') + sqrt(2 * x / pi()) * exp(-x / 2)', 'chi2_p_value')} FROM zt""",
)
ORACLE["segment_confusion"] = with_([DOC], f"SELECT source, tn, fp, fn, tp FROM ({cells('doc', 'source')})")
ORACLE["segment_residuals"] = with_(
    [EV, REF, CUR, "asg AS (SELECT *, event_type AS window_id FROM cur)", *GROUPS], group_stats("event_type")
)
ORACLE["threshold_sweep"] = with_(
    [DOC, "gr AS (SELECT i / 20.0::DOUBLE AS threshold FROM range(1, 20) g(i))", f"cs AS ({cells('(SELECT threshold, y, CAST(score >= threshold AS INTEGER) AS p FROM doc, gr)', 'threshold')})"],
    f"SELECT threshold, tn, fp, fn, tp, {rates(['accuracy_score', 'precision_score', 'recall_score', 'f1_score', 'false_positive_rate'])} FROM cs",
)
ORACLE["error_tails"] = with_(
    [*BASE, GROUPS[0], """mo AS (SELECT window_id, avg(error) AS m, var_pop(error) AS v FROM err GROUP BY 1)""",
     """kk AS (SELECT window_id, avg((error - m) ** 4) / any_value(v) ** 2 - 3 AS kurtosis, avg((error - m) ** 3) / any_value(v) ** 1.5 AS skewness,
          quantile_cont(abs(error), 0.5) AS a, quantile_cont(abs(error), 0.99) AS b FROM err JOIN mo USING (window_id) GROUP BY 1)"""],
    f"SELECT window_id, {r('kurtosis', 'kurtosis')}, {r('skewness', 'skewness')}, {r('a', 'median_gap')}, {r('b', 'p99_gap')}, {r('b / nullif(a, 0)', 'tail_ratio')} FROM kk",
)
ORACLE["worst_rows"] = with_(
    [*BASE, "we AS (SELECT *, round(prediction - target, 6) AS error FROM asg)",
     "wr AS (SELECT *, CAST(row_number() OVER (PARTITION BY window_id ORDER BY abs(error) DESC, event_id) AS INTEGER) AS error_rank FROM we QUALIFY error_rank <= 5)"],
    f"SELECT window_id, error_rank, event_id, {r('error', 'error')}, "
    + ", ".join(r(f"({f} - (SELECT avg({f}) FROM ref)) / (SELECT stddev_samp({f}) FROM ref)", f"{f}_z") for f in ("k", "hour", "target")) + " FROM wr",
)
ORACLE["ranking_metrics"] = with_(
    [EV, "rk AS (SELECT user_id, CAST(event_type = 'purchase' AS INTEGER) AS rel, row_number() OVER (PARTITION BY user_id ORDER BY target DESC, event_id) AS k FROM ev)",
     """ag AS (SELECT user_id, sum(rel) AS n_relevant, sum(rel) FILTER (k <= 10) AS hits, sum(rel / log2(k + 1)) FILTER (k <= 10) AS dcg FROM rk GROUP BY 1)"""],
    f"""SELECT user_id, CAST(n_relevant AS BIGINT) AS n_relevant, {r('hits / 10.0::DOUBLE', 'precision_at_k')}, {r('hits::DOUBLE / nullif(n_relevant, 0)', 'recall_at_k')},
        {r('''CASE WHEN n_relevant > 0 THEN dcg / list_sum(list_transform(range(1, CAST(least(n_relevant, 10) + 1 AS BIGINT)), lambda i: 1 / log2(i + 1))) ELSE 0 END''', 'ndcg_at_k')} FROM ag""",
)
ORACLE["calibration"] = with_(
    [DOC, "cb AS (SELECT CAST(least(floor(score * 10) + 1, 10) AS INTEGER) AS bin, count(*) AS n_rows, avg(score) AS ms, avg(y) AS ml FROM doc GROUP BY 1)"],
    f"""SELECT bin, n_rows, {r('ms', 'mean_score')}, {r('ml', 'mean_label')}, {r('ms - ml', 'gap')},
        {r('abs(ms - ml) * n_rows / (SELECT sum(n_rows) FROM cb)', 'ece_term')} FROM cb""",
)
ORACLE["confidence_cohorts"] = with_(
    [DOC, "bd AS (SELECT *, CAST(least(floor(score * 5) + 1, 5) AS INTEGER) AS band FROM doc)"], f"SELECT band, {rates(NINE)} FROM ({cells('bd', 'band')})"
)
_FAIR = ["false_negative_rate", "false_positive_rate", "selection_rate", "predicted_positive_rate"]
ORACLE["fairness_rates"] = with_(
    [DOC, f"f AS (SELECT lang, {', '.join(f'{RATES[c]} AS {c}' for c in _FAIR)} FROM ({cells('doc', 'lang')}))"],
    f"SELECT lang, {', '.join(r(c, c) for c in _FAIR)}, {r('predicted_positive_rate / nullif((SELECT max(predicted_positive_rate) FROM f), 0)', 'parity_ratio')} FROM f",
)
ORACLE["label_coverage"] = f"""SELECT source, count(*) AS n_rows, count(quality) AS n_labelled, {r('count(quality)::DOUBLE / count(*)', 'coverage')}
  FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1"""
_HALVES = ["late AS (SELECT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '2001-06-01')", "early AS (SELECT o_custkey, o_orderdate FROM orders WHERE o_orderdate < TIMESTAMP '2001-06-01')"]
ORACLE["split_overlap"] = with_(
    _HALVES,
    """SELECT count(DISTINCT o_custkey) FILTER (o_custkey IN (SELECT o_custkey FROM late)) AS overlapping,
       count(DISTINCT o_custkey) FILTER (o_custkey NOT IN (SELECT o_custkey FROM late)) AS clean FROM early""",
)
ORACLE["clean_rows"] = with_(_HALVES, "SELECT o_custkey, o_orderdate FROM early WHERE o_custkey NOT IN (SELECT o_custkey FROM late)")
ORACLE["future_leakage"] = """SELECT l_returnflag, count(*) AS n_rows, count(*) FILTER (l_shipdate >= o_orderdate) AS n_leaking
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1"""
ORACLE["period_over_period"] = f"""WITH d AS (SELECT o_orderdate, sum(o_totalprice) AS amount FROM orders GROUP BY 1)
  SELECT a.o_orderdate, {r('a.amount', 'amount', 4)}, {r('b.amount', 'previous', 4)}, {r('a.amount - b.amount', 'delta', 4)},
  {r('(a.amount - b.amount) / nullif(b.amount, 0) * 100', 'change_pct', 4)} FROM d a LEFT JOIN d b ON b.o_orderdate = a.o_orderdate - INTERVAL 7 DAY"""
ORACLE["diversity"] = with_(
    [EV, "c AS (SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS bucket, event_type, count(*) AS n FROM ev GROUP BY ALL)",
     "s AS (SELECT *, n / sum(n) OVER (PARTITION BY bucket)::DOUBLE AS p FROM c)"],
    f"SELECT bucket, count(*) AS distinct_items, CAST(sum(n) AS BIGINT) AS n_rows, {r('-sum(p * ln(p))', 'entropy')} FROM s GROUP BY 1",
)
ORACLE["class_shares"] = f"""SELECT lang, n_rows, {r('n_rows::DOUBLE / (SELECT count(*) FROM documents)', 'share')},
  n_rows::DOUBLE / (SELECT count(*) FROM documents) < 0.1 AS is_rare FROM (SELECT lang, count(*) AS n_rows FROM documents GROUP BY 1)"""
ORACLE["recommendations"] = with_(
    [*FLAGGED, *DRIFT, "fs AS (SELECT window_id, bool_or(statistic >= 0.1) AS d FROM dt GROUP BY 1)",
     "fi AS (SELECT window_id, CASE WHEN d THEN 'data_drift' WHEN is_critical THEN 'concept_drift' ELSE 'stable' END AS finding FROM fl LEFT JOIN fs USING (window_id))"],
    """SELECT window_id, finding, CASE finding WHEN 'data_drift' THEN 'retrain on data of the current distribution'
       WHEN 'concept_drift' THEN 'retrain on a frequent schedule or learn online' ELSE 'keep monitoring for drift' END AS action FROM fi""",
)

ORACLE["model_findings"] = with_(
    [
        DOC, "gr AS (SELECT i / 10.0::DOUBLE AS t FROM range(1, 10) g(i))",
        """nw AS (SELECT source, 'new_categories' AS finding, count(DISTINCT lang)::DOUBLE AS evidence FROM doc
             WHERE lang NOT IN (SELECT lang FROM doc WHERE lang <> 'fr') GROUP BY 1)""",
        """rr AS (SELECT source, 'rare_class' AS finding, min(n) / sum(n)::DOUBLE AS evidence
             FROM (SELECT source, y, count(*) AS n FROM doc GROUP BY 1, 2) GROUP BY 1)""",
        """f AS (SELECT source, t, round(2.0::DOUBLE * count(*) FILTER (y = 1 AND score >= t) /
             (count(*) FILTER (score >= t) + count(*) FILTER (y = 1)), 9) AS f1 FROM doc, gr GROUP BY 1, 2
             HAVING count(*) FILTER (score >= t) > 0 AND count(*) FILTER (y = 1) > 0)""",
        """th AS (SELECT source, 'threshold' AS finding, first(t ORDER BY f1 DESC, t) AS evidence,
             max(f1) - coalesce(max(f1) FILTER (t = 0.5), 0) AS gain FROM f GROUP BY 1)""",
        """fd AS (SELECT * FROM nw UNION ALL SELECT * FROM rr WHERE evidence < 0.15
             UNION ALL SELECT source, finding, evidence FROM th WHERE gain > 0.01)""",
    ],
    f"""SELECT source, finding, {r('evidence', 'evidence')}, CASE finding WHEN 'new_categories' THEN 'engineer features for the new data patterns'
        WHEN 'rare_class' THEN 'augment the data of underrepresented classes' ELSE 'adjust the decision threshold' END AS action FROM fd""",
)
ORACLE["serving_categories"] = with_(
    [
        EV, REF, CUR, "tr AS (SELECT * FROM ref WHERE event_type <> 'signup')",
        """v AS (SELECT 'event_type' AS feature, event_type AS value, 1 AS a, 0 AS b FROM tr UNION ALL SELECT 'event_type', event_type, 0, 1 FROM cur
             UNION ALL SELECT 'user_id', CAST(user_id AS VARCHAR), 1, 0 FROM tr UNION ALL SELECT 'user_id', CAST(user_id AS VARCHAR), 0, 1 FROM cur)""",
    ],
    """SELECT feature, value, CAST(sum(a) AS BIGINT) AS n_train, CAST(sum(b) AS BIGINT) AS n_serving,
       CASE WHEN sum(b) = 0 THEN 'train' ELSE 'serving' END AS only_in FROM v WHERE value IS NOT NULL GROUP BY 1, 2 HAVING sum(a) = 0 OR sum(b) = 0""",
)

# ---------------------------------------------------------------- samples and corruption

ORACLE["hash_sample"] = with_(
    [TIMES, LAB], "SELECT * FROM lab ORDER BY md5('7|' || customer_id || '|' || CAST(timestamp AS VARCHAR)), customer_id, timestamp LIMIT 500"
)
ORACLE["head_rows"] = with_([TIMES, LAB], "SELECT * FROM lab ORDER BY timestamp, customer_id LIMIT 500")
ORACLE["hash_split"] = f"SELECT o_orderkey, CASE WHEN {fraction('o_orderkey', '42')} < 0.2 THEN 'test' ELSE 'train' END AS split FROM orders"
_CP = "cp AS (SELECT c_custkey, c_acctbal, c_mktsegment, CAST(c_acctbal > 0 AS INTEGER) AS label FROM customer)"
ORACLE["perturb_noise"] = with_(
    [_CP],
    "SELECT c_custkey, "
    + r(
        f"c_acctbal + sqrt(-2.0 * ln(1.0::DOUBLE - {fraction('c_custkey', '3r')})) * cos(2 * pi() * {fraction('c_custkey', '3a')}) * (SELECT stddev_samp(c_acctbal) FROM cp) * 0.5",
        "c_acctbal", 3,
    )
    + ", c_mktsegment, label FROM cp",
)
ORACLE["perturb_shuffle"] = with_(
    [
        _CP, f"ch AS (SELECT c_custkey, c_mktsegment FROM cp WHERE {fraction('c_custkey', '3m')} < 0.3)",
        """rk AS (SELECT *, row_number() OVER (ORDER BY c_custkey) AS t,
             row_number() OVER (ORDER BY md5('3p|' || c_custkey), c_custkey) AS f FROM ch)""",
        "mv AS (SELECT a.c_custkey, b.c_mktsegment FROM rk a JOIN rk b ON a.t = b.f)",
    ],
    "SELECT c_custkey, c_acctbal, coalesce(mv.c_mktsegment, cp.c_mktsegment) AS c_mktsegment, label FROM cp LEFT JOIN mv USING (c_custkey)",
)
ORACLE["perturb_flip"] = with_(
    [_CP], f"SELECT c_custkey, c_acctbal, c_mktsegment, CASE WHEN {fraction('c_custkey', '3f')} < 0.15 THEN 1 - label ELSE label END AS label FROM cp"
)

# ---------------------------------------------------------------- learning and streaming

ORACLE["scaled_features"] = with_(
    [
        EV, "g AS (SELECT event_id, CASE WHEN k >= 20 THEN k END AS k, hour FROM ev)",
        "f AS (SELECT event_id, coalesce(k, (SELECT quantile_cont(k, 0.5) FROM g)) AS k, coalesce(hour, (SELECT quantile_cont(hour, 0.5) FROM g)) AS hour FROM g)",
    ],
    "SELECT event_id, " + ", ".join(r(f"({c} - (SELECT avg({c}) FROM f)) / (SELECT stddev_pop({c}) FROM f)", f"{c}_scaled") for c in ("k", "hour")) + " FROM f",
)
# Every row must agree with the model; which rows there are is the oracle's part.
ORACLE["forest_by_nodes"] = with_([EV, REF, CUR], "SELECT event_id, true AS agrees FROM cur")
ORACLE["importance_by_nodes"] = with_([EV, REF], "SELECT unnest(['event_type', 'hour', 'k']) AS feature, count(*) > 0 AS agrees FROM ref")
ORACLE["boosted_by_nodes"] = with_([DOC], f"SELECT doc_id, true AS agrees FROM doc WHERE {fraction('doc_id', '42')} < 0.2")
ORACLE["one_hot_slots"] = with_(
    [EV, REF, CUR],
    """SELECT event_type, CASE event_type WHEN 'click' THEN '10000' WHEN 'error' THEN '01000' WHEN 'missing' THEN '00100'
       WHEN 'purchase' THEN '00010' WHEN 'view' THEN '00001' ELSE '00000' END AS slots, count(*) AS n_rows FROM cur GROUP BY 1""",
)


def stream(days: int) -> str:
    """Sliding windows of ``days`` days by whole rows: every row is copied to all windows it lies in."""
    starts = f"unnest(generate_series(CAST(date_trunc('day', ts) AS TIMESTAMP) - INTERVAL {days - 1} DAY, CAST(date_trunc('day', ts) AS TIMESTAMP), INTERVAL 1 DAY))"

    def tail(x: str) -> str:
        """The chi-square tail with eight degrees of freedom."""
        return f"exp(-{x} / 2) * (1 + {x} / 2 + {x} ** 2 / 8 + {x} ** 3 / 48)"

    tests = [
        f"""{name[0]}q AS (SELECT quantile_cont({name}, [i / 9.0::DOUBLE for i in range(1, 9)]) AS e FROM ref),
            {name[0]}r AS (SELECT len(list_filter(e, lambda v: {name} > v)) AS c, count(*)::DOUBLE / sum(count(*)) OVER () AS share FROM ref, {name[0]}q GROUP BY 1),
            {name[0]}w AS (SELECT window_start, len(list_filter(e, lambda v: {name} > v)) AS c, count(*) AS n FROM bk, {name[0]}q GROUP BY 1, 2),
            {name[0]}t AS (SELECT window_start, greatest(sum(n * n / share) / sum(n) - sum(n), 0) AS x FROM {name[0]}w JOIN {name[0]}r USING (c) GROUP BY 1)"""
        for name in ("target", "prediction")
    ]
    return with_(
        [
            EV, REF,
            "st AS (SELECT avg(target) AS my, stddev_pop(target) AS sy, avg(prediction) AS mp, stddev_pop(prediction) AS sp FROM ref)",
            f"bk AS (SELECT ev.*, {starts} AS window_start FROM ev)",
            f"wn AS ({quality_sql('bk', 'window_start')})",
            "mn AS (SELECT window_start, avg(target) AS ay, avg(prediction) AS ap FROM bk GROUP BY 1)",
            *tests,
            f"""dr AS (SELECT window_start, a.x AS tx, b.x AS px, {tail('a.x')} AS tp, {tail('b.x')} AS pp
                 FROM tt a JOIN pt b USING (window_start))""",
        ],
        f"""SELECT window_start, window_start + INTERVAL {days} DAY AS window_end, n_rows, {r('r2_score', 'r2_score')}, {r('rmse', 'rmse')}, {r('mean_error', 'mean_error')},
            {r('abs(ay - my) / sy', 'target_shift')}, {r('abs(ap - mp) / sp', 'prediction_shift')},
            {r('tx', 'target_statistic')}, {r('tp', 'target_p_value')}, {r('px', 'prediction_statistic')}, {r('pp', 'prediction_p_value')},
            concat_ws(',', CASE WHEN pp < 0.05 THEN 'prediction' END, CASE WHEN tp < 0.05 THEN 'target' END) AS drifted,
            {_POOR} AS poor_performance, {_POOR} OR pp < 0.05 OR tp < 0.05 AS is_critical
            FROM wn JOIN mn USING (window_start) JOIN dr USING (window_start), st""",
    )


ORACLE["stream_window_metrics"] = stream(1)
ORACLE["stream_sliding_metrics"] = stream(7)
ORACLE["stream_quarter_view"] = stream(90)

#: Splitting hot groups changes the plan, not the answer.
for _name in ("ks_by_window", "wasserstein_by_window", "auc_exact", "asof_customer"):
    ORACLE[f"{_name}_split"] = ORACLE[_name]

ORACLE["drift_tests"] = f"""
SELECT window_id, feature, 'ks' AS method, statistic, p_value, p_value < 0.05 AS detected
FROM ({ORACLE["ks_by_window"]}) WHERE feature IN ('k', 'hour')
UNION ALL
SELECT window_id, feature, 'chi2' AS method, statistic, p_value, p_value < 0.05 AS detected FROM ({ORACLE["chi2_by_window"]})"""

ORACLE["critical_windows_tests"] = with_(
    [
        *BASE, QUALITY, *pooled(["target", "prediction"]),
        "kd AS (SELECT wid AS window_id, feature, max(abs(fr - fc)) AS d, max(n_cur) AS n_cur, max(n_ref) AS n_ref FROM cdf GROUP BY ALL)",
        "kl AS (SELECT *, sqrt(CAST(n_ref AS DOUBLE) * n_cur / (n_ref + n_cur)) * d AS lam FROM kd)",
        f"kp AS (SELECT window_id, feature, {KS_P} AS p FROM kl)",
        "dn AS (SELECT window_id, string_agg(feature, ',' ORDER BY feature) AS drifted FROM kp WHERE p < 0.05 GROUP BY 1)",
    ],
    f"""SELECT window_id, window_start, window_end, {r('r2_score', 'r2_score')}, coalesce(drifted, '') AS drifted, {_POOR} AS poor_performance,
        {_POOR} OR drifted IS NOT NULL AS is_critical FROM win LEFT JOIN qual USING (window_id) LEFT JOIN dn USING (window_id)""",
)

# ---------------------------------------------------------------- sources and sinks

_ORDER_SUMS = f"count(*) AS n_rows, {r('sum(o_totalprice)', 'total', 2)}, CAST(sum(o_orderkey) AS BIGINT) AS keys"
_ORDER_SPLITS = """sp AS (SELECT *, CASE WHEN o_orderdate < TIMESTAMP '2000-07-01' THEN 'train' WHEN o_orderdate < TIMESTAMP '2001-01-01' THEN 'val' END AS split FROM orders)"""
ORACLE["source_round_trips"] = with_(
    [_ORDER_SPLITS, "st AS (SELECT * FROM (VALUES ('csv_time'), ('csv_lower'), ('ingest'), ('months'), ('replaced')) t(source))"],
    f"""SELECT source, {_ORDER_SUMS} FROM orders, st GROUP BY 1
        UNION ALL SELECT 'split_' || split, {_ORDER_SUMS} FROM sp WHERE split IS NOT NULL GROUP BY 1
        UNION ALL SELECT 'split_test', 0, 0.0, 0
        UNION ALL SELECT 'reader', {_ORDER_SUMS} FROM orders WHERE o_orderkey % 2 = 0""",
)
ORACLE["report_round_trip"] = ORACLE["window_reports"].replace("SELECT fl.window_id, ", "SELECT fl.window_id, fl.window_start, fl.window_end, ", 1)

# ---------------------------------------------------------------- categories

_PERIODS = [
    "od AS (SELECT *, CAST(o_totalprice > 250000 AS DOUBLE) AS large FROM orders)",
    "er AS (SELECT * FROM od WHERE o_orderdate < TIMESTAMP '1997-01-01')", "la AS (SELECT * FROM od WHERE o_orderdate >= TIMESTAMP '1997-01-01')",
]
ORACLE["category_dictionary"] = with_(
    [
        *_PERIODS,
        "pd AS (SELECT o_orderpriority, dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS i FROM er GROUP BY 1)",
        "cd AS (SELECT o_custkey, row_number() OVER (ORDER BY CAST(o_custkey AS VARCHAR)) - 1 AS i FROM er GROUP BY 1)",
        "en AS (SELECT la.o_orderpriority, coalesce(pd.i, (SELECT count(*) FROM pd)) AS p, coalesce(cd.i, (SELECT count(*) FROM cd)) AS c FROM la LEFT JOIN pd USING (o_orderpriority) LEFT JOIN cd USING (o_custkey))",
    ],
    """SELECT o_orderpriority, p AS priority_index, (SELECT string_agg(CASE WHEN i = p THEN '1' ELSE '0' END, '' ORDER BY i) FROM pd) AS slots,
       count(*) AS n_rows, CAST(sum(c) AS BIGINT) AS custkey_indices, max(c) AS custkey_last FROM en GROUP BY 1, 2""",
)


def _out_of_fold(column: str) -> str:
    """The mean of a row's category over the rows of other folds, and 20 rows of the prior."""
    same = f"b.{column} = a.{column} AND b.f <> a.f"
    return f"(SELECT coalesce(sum(b.large), 0) FROM fo b WHERE {same}) + 20 * pr.m) / ((SELECT count(*) FROM fo b WHERE {same}) + 20.0::DOUBLE"


def _fitted(column: str) -> str:
    return f"(SELECT coalesce(sum(large), 0) FROM er WHERE er.{column} = la.{column}) + 20 * w.m) / ((SELECT count(*) FROM er WHERE er.{column} = la.{column}) + 20.0::DOUBLE"


ORACLE["target_means"] = with_(
    [
        *_PERIODS, f"fo AS (SELECT *, CAST(floor({fraction('o_orderkey', '11')} * 5) AS INTEGER) AS f FROM er)",
        "pr AS (SELECT g.f, avg(large) AS m FROM (SELECT DISTINCT f FROM fo) g JOIN fo ON fo.f <> g.f GROUP BY 1)", "w AS (SELECT avg(large) AS m FROM er)",
    ],
    f"""SELECT 'train' AS period, o_orderkey, {r('(' + _out_of_fold('o_orderpriority') + ')', 'o_orderpriority_mean')}, {r('(' + _out_of_fold('o_custkey') + ')', 'o_custkey_mean')}
        FROM fo a JOIN pr USING (f)
        UNION ALL SELECT 'score', o_orderkey, {r('(' + _fitted('o_orderpriority') + ')', 'o_orderpriority_mean')}, {r('(' + _fitted('o_custkey') + ')', 'o_custkey_mean')} FROM la, w""",
)
