"""Readers and writers: CSV with a time column, split tables, reports."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modelwake.operators.prepare import rename_lower
from modelwake.sources import versions

SPLITS = ("train", "val", "test")


def read_time_csv(spark: SparkSession, path: str, schema: T.StructType, time_column: str | None = None) -> DataFrame:
    """CSV with header and declared schema; the time column (the first by default) becomes a timestamp."""
    time_column = time_column or schema.fieldNames()[0]
    declared = T.StructType(
        [T.StructField(f.name, T.StringType()) if f.name == time_column else f for f in schema.fields]
    )
    raw = spark.read.schema(declared).csv(path, header=True)
    return raw.withColumn(time_column, F.to_timestamp_ntz(F.col(time_column)))


def read_lower_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """CSV with lower-cased column names; without a schema every column is text."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return rename_lower(reader.csv(path, header=True))


def split_folder(root: str, dataset: str, task: str, settings: Mapping[str, object]) -> str:
    """Cache folder of a task. It depends on every setting, so other settings never reuse it."""
    digest = hashlib.sha1(json.dumps(dict(settings), sort_keys=True, default=str).encode()).hexdigest()[:12]
    return f"{root}/{dataset}/{task}/{digest}"


MANIFEST = "_splits.json"


def write_splits(df: DataFrame, folder: str) -> None:
    """One directory per split in a single write, then the manifest that makes them valid.

    The manifest has the rows of every split, so an empty split is known as such, and the
    schema. Overwriting deletes the old one first: a write that dies leaves no valid splits.
    """
    spark = df.sparkSession
    df.write.mode("overwrite").partitionBy("split").parquet(folder)
    schema = df.drop("split").schema
    stored = spark.read.schema(T.StructType([*schema.fields, T.StructField("split", T.StringType())])).parquet(folder)
    rows = {r["split"]: r["n"] for r in stored.groupBy("split").agg(F.count("*").alias("n")).collect()}
    versions.write_text(spark, f"{folder}/{MANIFEST}", json.dumps({"rows": {s: rows.get(s, 0) for s in SPLITS}, "schema": schema.json()}))


def read_splits(spark: SparkSession, folder: str) -> dict[str, DataFrame] | None:
    """The three splits, empty ones too, or None unless a write of them was completed."""
    text = versions.read_text(spark, f"{folder}/{MANIFEST}")
    if text is None:
        return None
    saved = json.loads(text)
    schema = T.StructType.fromJson(json.loads(saved["schema"]))
    if not any(saved["rows"].values()):
        return {s: spark.createDataFrame([], schema) for s in SPLITS}
    table = spark.read.schema(T.StructType([*schema.fields, T.StructField("split", T.StringType())])).parquet(folder)
    return {s: table.where(F.col("split") == s).drop("split") for s in SPLITS}


def write_csv_splits(splits: Mapping[str, DataFrame], folder: str) -> None:
    for name, df in splits.items():
        df.write.mode("overwrite").csv(f"{folder}/{name}", header=True)


def ingest(tables: Mapping[str, DataFrame], folder: str) -> None:
    """Store source tables as Parquet, one directory each."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def create_or_replace(df: DataFrame, table: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Create or replace a table at one stroke; returns the stored table.

    Rows go to a folder of their own in the warehouse, then the name in the session catalog
    moves to it, as a view of that folder. Readers see the old rows or the new ones, and a
    query that has begun keeps the version it began with. ``df`` may read the table it replaces.
    """
    spark = df.sparkSession
    version = versions.publish(df, f"{spark.conf.get('spark.sql.warehouse.dir')}/{table}.versions", partition_by=partition_by)
    if spark.catalog.tableExists(table) and spark.catalog.getTable(table).tableType != "VIEW":
        spark.sql(f"DROP TABLE {table}")
    spark.sql(f"CREATE OR REPLACE VIEW {table} AS SELECT * FROM parquet.`{version.folder}`")
    return spark.table(table)


def write_by_month(df: DataFrame, ts: str, folder: str) -> None:
    """Feature tables by month of their label time, for partition pruning."""
    df.withColumn("month", F.date_format(ts, "yyyy-MM")).write.mode("overwrite").partitionBy("month").parquet(folder)


def write_scored(reference: DataFrame, current: DataFrame, folder: str) -> None:
    reference.write.mode("overwrite").parquet(f"{folder}/reference")
    current.write.mode("overwrite").parquet(f"{folder}/current")


def as_json(df: DataFrame, name: str = "report") -> DataFrame:
    """Every row as one JSON text; timestamps in ISO-8601."""
    options = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
    return df.select(F.to_json(F.struct(*df.columns), options).alias(name))


def write_json_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").json(path)


def read_json_report(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").json(path)


#: The nested report of a window.
REPORT_SCHEMA = """window_id int, time_range struct<start: timestamp_ntz, end: timestamp_ntz>,
    metrics struct<r2_score: double, rmse: double, mean_error: double, error_std: double>,
    error_distribution struct<majority: struct<mean: double, std: double>, underestimation: struct<mean: double, std: double>, overestimation: struct<mean: double, std: double>>,
    feature_performance map<string, struct<range: double, majority_value: double, under_value: double, over_value: double>>,
    drift_analysis struct<drifted_features: array<string>, feature_scores: map<string, struct<score: double, detected: boolean>>>,
    is_critical boolean"""


def read_window_reports(spark: SparkSession, path: str) -> DataFrame:
    """Window reports as they were written: typed, with time ranges.

    JSON leaves out what is null, so every rule for a missing field is here: numbers of a
    missing struct are 0, missing lists and maps are empty, an unknown time is null and a
    window without a flag is not critical.
    """
    read = read_json_report(spark, path, REPORT_SCHEMA)
    zero = F.lit(0.0)

    def filled(column: Column, kind: T.StructType) -> Column:
        parts = [
            (filled(column[f.name], f.dataType) if isinstance(f.dataType, T.StructType) else F.coalesce(column[f.name], zero)).alias(f.name)
            for f in kind.fields
        ]
        return F.struct(*parts)

    numbers = {c: filled(F.col(c), read.schema[c].dataType) for c in ("metrics", "error_distribution")}
    drift = F.struct(
        F.coalesce("drift_analysis.drifted_features", F.array().cast("array<string>")).alias("drifted_features"),
        F.coalesce("drift_analysis.feature_scores", F.create_map().cast("map<string, struct<score: double, detected: boolean>>")).alias("feature_scores"),
    )
    features = F.coalesce("feature_performance", F.create_map().cast(read.schema["feature_performance"].dataType))
    flag = F.coalesce("is_critical", F.lit(False))
    return read.withColumns({**numbers, "drift_analysis": drift, "feature_performance": features, "is_critical": flag})


def parse_json(df: DataFrame, column: str, schema: str, drop: Sequence[str] = ()) -> DataFrame:
    """Typed struct from a JSON text column, without the named fields."""
    parsed = F.from_json(F.col(column), schema)
    return df.withColumn(column, parsed.dropFields(*drop) if drop else parsed)
