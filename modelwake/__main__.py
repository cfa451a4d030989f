"""Monitor a CSV series: train on the reference period, report on the current one.

python -m modelwake --data-path hourly.csv --output reports --target cnt \\
    --numeric temp atemp hum windspeed hr weekday --categorical season holiday workingday \\
    --reference-end "2011-01-28 23:00:00" --current-end "2011-02-28 23:00:00"
"""

from __future__ import annotations

import argparse
from collections.abc import Sequence
from datetime import datetime, timezone

from pyspark.sql import functions as F
from pyspark.sql import types as T

from modelwake.learning.pipeline import score_periods
from modelwake.operators.drift import REGIMES
from modelwake.plans.monitoring import MonitoringRun
from modelwake.session import build_session
from modelwake.sources import files


def parse(argv: Sequence[str] | None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="modelwake", description=__doc__, formatter_class=argparse.RawTextHelpFormatter)
    parser.add_argument("--data-path", required=True)
    parser.add_argument("--output", required=True)
    parser.add_argument("--time-column", default="ts")
    parser.add_argument("--target", required=True)
    parser.add_argument("--numeric", nargs="*", default=[])
    parser.add_argument("--categorical", nargs="*", default=[])
    parser.add_argument("--start")
    parser.add_argument("--reference-end", required=True)
    parser.add_argument("--current-end", required=True)
    parser.add_argument("--regime", choices=REGIMES, default="distance", help="distances or tests for the drift of all columns")
    parser.add_argument("--method", nargs="*", default=[], metavar="COLUMN=METHOD", help="drift method of single columns")
    return parser.parse_args(argv)


def main(argv: Sequence[str] | None = None) -> None:
    args = parse(argv)
    spark = build_session()
    # The header gives the order of the columns; types come from their roles.
    header = spark.read.csv(args.data_path, header=True).columns
    texts = {args.time_column, *args.categorical}
    numbers = {args.target, *args.numeric}
    schema = T.StructType(
        [T.StructField(c, T.DoubleType() if c in numbers else T.StringType()) for c in header]
    )
    series = files.read_time_csv(spark, args.data_path, schema, args.time_column)
    series = series.select(*[c for c in header if c in texts | numbers])
    reference, current = score_periods(
        series, args.time_column, args.reference_end, args.current_end, args.target, args.numeric, args.categorical, args.start
    )
    # Stored once: every table of the run reads the scored rows.
    files.write_scored(reference, current, f"{args.output}/scored")
    reference, current = (spark.read.parquet(f"{args.output}/scored/{p}") for p in ("reference", "current"))
    run = MonitoringRun(
        reference, current, args.time_column, args.target, "prediction", args.numeric, args.categorical,
        args.regime, dict(m.split("=", 1) for m in args.method),
    )
    files.write_json_report(run.reports(), f"{args.output}/windows")
    summary = run.summary.withColumn("analysis_timestamp", F.lit(datetime.now(timezone.utc).isoformat()))
    files.write_json_report(summary.withColumn("model_type", F.lit("RandomForestRegressor")), f"{args.output}/summary")
    files.write_json_report(run.feature_drift(), f"{args.output}/feature_drift")
    if args.numeric:
        files.write_json_report(run.numeric_profile(), f"{args.output}/numeric_profile")
    if args.categorical:
        files.write_json_report(run.category_profile(), f"{args.output}/category_profile")
    run.summary.show(truncate=False)


if __name__ == "__main__":
    main()
