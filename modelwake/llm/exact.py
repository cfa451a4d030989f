"""Exact deduplication against a persistent digest index."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modelwake.llm.common import Stages, text_or_empty
from modelwake.sources import versions

SETTINGS = "_index.json"


class DigestIndex:
    """Digests of all texts seen so far, bucketed and sorted by digest, in a folder that outlives the session.

    One row per distinct text: digest (SHA-256), keep_id (the document that stays) and
    batch (the load that brought it). The number of buckets is written into the folder when
    the index is made and read from there afterwards, whatever the session's settings are;
    asking for another number raises. A new index without a number takes the session's
    shuffle partitions.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark = spark
        saved = versions.read_text(spark, f"{path}/{SETTINGS}")
        if saved is None:
            self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
            if versions.holds_files(spark, path):
                raise ValueError(f"{path} holds files but no {SETTINGS}: its number of buckets is unknown")
            versions.write_text(spark, f"{path}/{SETTINGS}", json.dumps({"buckets": self.buckets}))
        else:
            self.buckets = json.loads(saved)["buckets"]
            if buckets not in (None, self.buckets):
                raise ValueError(f"the index in {path} has {self.buckets} buckets, not {buckets}")
        self.table = "digest_index_" + hashlib.md5(path.encode()).hexdigest()
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.table} (digest BINARY, keep_id BIGINT, batch STRING) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{path}'"
        )
        # Another session may have added files.
        spark.catalog.refreshTable(self.table)

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def add(self, groups: DataFrame, batch: str) -> None:
        """Append the digests of ``groups`` (digest, keep_id) that the index does not hold.

        Known digests go by a sort-merge anti-join in which only the new side is shuffled.
        The append is one job that commits as a whole: after a failure it can be repeated.
        """
        fresh = groups.join(self.rows().hint("merge"), "digest", "left_anti")
        fresh = fresh.select("digest", "keep_id", F.lit(batch).alias("batch")).repartition(self.buckets, "digest")
        fresh.write.mode("append").insertInto(self.table)

    def close(self) -> None:
        """Take the table out of the catalogue; the folder stays as it is."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")


def exact_duplicates(docs: DataFrame, index: DigestIndex, batch: str) -> DataFrame:
    """Add the texts of ``docs`` to the index and return what stays.

    One row per row of ``docs``: doc_id, keep_id, group_size (rows of this load with the
    text), kept, text_sha256. Texts are equal when identical; null counts as empty. Inside
    one load the largest doc_id stays; a text known from an earlier load keeps the earlier
    document, and all its new rows go. ``batch`` names the load: a load repeated under its
    name, after a failure for one, gives the same rows again. Rows that repeat the kept doc_id and text are all kept; null doc_ids lose
    against any other, and if all are null, all stay. An empty table gives no rows and
    leaves the index as it is. Other columns are ignored.
    """
    stages = Stages(docs.sparkSession)
    digests = stages.keep(docs.select("doc_id", F.unhex(F.sha2(text_or_empty().cast("binary"), 256)).alias("digest")))
    groups = digests.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    index.add(groups, batch)
    known = index.rows().withColumnRenamed("keep_id", "kept_id")
    # Stored unbucketed, so that the join below shuffles both sides and a text that holds
    # a third of all rows is split over tasks.
    found = stages.keep(groups.join(known.hint("merge"), "digest"))
    own = F.col("batch") == batch
    return digests.join(found, "digest").select(
        "doc_id",
        F.col("kept_id").alias("keep_id"),
        "group_size",
        (own & F.col("doc_id").eqNullSafe(F.col("kept_id"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def duplicates_by_halves(docs: DataFrame, index: DigestIndex) -> DataFrame:
    """``exact_duplicates`` in two loads, the upper half of the doc_ids first; ``group_size`` counts both.

    The second load, which rows without doc_id belong to, meets the index of the first. As
    its ids are the smaller ones, the largest doc_id of every text stays, as in one load.
    """
    stages = Stages(docs.sparkSession)
    ends = docs.agg(F.min("doc_id").cast("decimal(38,0)").alias("low"), F.max("doc_id").cast("decimal(38,0)").alias("high")).first()
    middle = 0 if ends["low"] is None else int(ends["low"] + ends["high"]) // 2
    upper = F.coalesce(F.col("doc_id") > middle, F.lit(False))
    found = [exact_duplicates(docs.where(upper), index, "upper"), exact_duplicates(docs.where(~upper), index, "lower")]
    rows = stages.keep(found[0].unionByName(found[1]))
    sizes = rows.groupBy("text_sha256").agg(F.count("*").alias("group_size"))
    joined = rows.drop("group_size").join(sizes.hint("merge"), "text_sha256")
    return joined.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
