"""The retail and monitoring tables, mapped onto the TPC-H-like test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from modelwake.operators.timewindows import ntz, reference_current_split

#: The first day and the cut between reference and current, which has no end.
SERIES_START = "2024-01-01"
REFERENCE_END = "2024-01-10 00:00:00"

#: Label times: every 28 days, always a Monday.
LABEL_START, LABEL_END, LABEL_DAYS = "1996-01-01", "2001-01-01", 28

NUMERIC_FEATURES = ("k", "hour")
CATEGORICAL_FEATURES = ("event_type",)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def row_count(spark: SparkSession, folder: str, name: str) -> int:
    """Rows of a table; Parquet answers it from the file footers."""
    return table(spark, folder, name).count()


def transactions(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_extendedprice", "l_returnflag")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("customer_id"),
        F.col("l_partkey").alias("article_id"),
        F.col("o_orderdate").alias("t_dat"),
        F.col("l_extendedprice").alias("price"),
        F.when(F.col("l_returnflag") == "R", 2).otherwise(1).alias("sales_channel_id"),
    )


def articles(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select(
        F.col("p_partkey").alias("article_id"),
        F.col("p_brand").alias("department_no"),
        F.col("p_type").alias("section_no"),
        F.col("p_size").alias("perceived_colour_master_id"),
    )


def customers(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").select(
        F.col("c_custkey").alias("customer_id"),
        F.col("c_acctbal").alias("age"),
        F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")).alias("FN"),
        F.when(F.col("c_acctbal") > 0, 1).alias("Active"),
        F.col("c_mktsegment").alias("club_member_status"),
        F.col("c_nationkey").alias("fashion_news_frequency"),
    )


def _label_times() -> Column:
    return F.explode(
        F.sequence(ntz(LABEL_START), ntz(LABEL_END), F.expr(f"INTERVAL {LABEL_DAYS} DAY"))
    ).alias("timestamp")


def churn_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Customers with an order at every label time; churn = no order in the following week.

    Orders are reduced to the label times in whose week they fall, per customer: that moves a row
    per customer, not one per label.
    """
    orders = table(spark, folder, "orders").select(F.col("o_custkey").alias("customer_id"), "o_orderdate")
    # An order falls into the week after at most one label time: label times are 28 days apart.
    offset = F.datediff("o_orderdate", ntz(LABEL_START))
    slot = F.floor(offset / LABEL_DAYS) * LABEL_DAYS
    in_week = (offset >= 0) & (offset - slot < 7)
    time = F.timestamp_add("DAY", slot.cast("int"), ntz(LABEL_START))
    ordered = orders.groupBy("customer_id").agg(F.collect_set(F.when(in_week, time)).alias("_ordered"))
    spine = ordered.select("customer_id", "_ordered", _label_times())
    # Orders without a customer are nobody's.
    stayed = F.col("customer_id").isNotNull() & F.array_contains("_ordered", F.col("timestamp"))
    return spine.select("customer_id", "timestamp", (~stayed).cast("int").alias("churn"))


def item_sales_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Sold articles at every label time; sales = amount sold in the following week.

    The amounts of an article are gathered, one per label time at most, before its label times
    are listed: that moves a row per article, not one per label.
    """
    txns = transactions(spark, folder)
    offset = F.datediff("t_dat", ntz(LABEL_START))
    slot = F.floor(offset / LABEL_DAYS) * LABEL_DAYS
    in_week = (offset >= 0) & (offset - slot < 7)
    time = F.timestamp_add("DAY", slot.cast("int"), ntz(LABEL_START))
    # Purchases of no such week count for the article being sold at all.
    sums = txns.groupBy("article_id", F.when(in_week, time).alias("_time")).agg(F.sum("price").alias("_sum"))
    entry = F.when(F.col("_time").isNotNull(), F.struct("_time", "_sum"))
    sold = sums.groupBy("article_id").agg(F.map_from_entries(F.collect_list(entry)).alias("_sold"))
    spine = sold.select("article_id", "_sold", _label_times())
    # Purchases without an article are nobody's.
    sales = F.when(F.col("article_id").isNotNull(), F.try_element_at("_sold", F.col("timestamp")))
    return spine.select("article_id", "timestamp", sales.alias("sales")).fillna(0.0, ["sales"])


def score_events(events: DataFrame) -> DataFrame:
    """The monitored series: ``value`` is the target; the error of ``prediction`` grows with time."""
    days = F.datediff(F.col("ts"), F.lit(SERIES_START))
    wobble = (F.col("event_id") % 11 - 5) * (F.lit(1.0) + F.lit(0.02) * days * days)
    return events.select(
        "event_id",
        "ts",
        "user_id",
        "event_type",
        F.col("value").alias("target"),
        (F.col("value") + wobble).alias("prediction"),
        F.get_json_object("props", "$.k").cast("double").alias("k"),
        F.hour("ts").cast("double").alias("hour"),
    )


def scored_events(spark: SparkSession, folder: str) -> DataFrame:
    return score_events(table(spark, folder, "events"))


def reference_and_current(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return reference_current_split(scored_events(spark, folder), "ts", REFERENCE_END)


#: Documents longer than this are predicted to be of good quality.
LENGTH_CUT = 1000


def scored_documents(spark: SparkSession, folder: str) -> DataFrame:
    """The binary task: quality label, length score in [0, 1] and thresholded prediction."""
    docs = table(spark, folder, "documents").select("doc_id", "lang", "source", "n_chars")
    joined = table(spark, folder, "labels").join(docs, "doc_id")
    return joined.select(
        "doc_id", "lang", "source",
        F.col("quality").alias("y"),
        F.col("toxic"),
        (F.col("n_chars") >= LENGTH_CUT).cast("int").alias("p"),
        (F.col("n_chars") >= 2 * LENGTH_CUT).cast("int").alias("p_other"),
        (F.col("n_chars") / (F.col("n_chars") + LENGTH_CUT)).alias("score"),
    )
