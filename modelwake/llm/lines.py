"""Cross-site boilerplate lines by the number of distinct sites that carry them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modelwake.llm.common import Stages, small

#: A line is boilerplate from this many distinct sites on, and as many different documents.
MIN_SITES = 5
#: Size of a sketch, 2 ** LG_K registers: a standard error of 1.6 %.
LG_K = 12
#: Around a threshold, estimates closer than this share (five standard errors) are counted exactly.
BAND = 0.08


def _line_key(line: Column) -> Column:
    return F.xxhash64(F.trim(line))


def line_spread(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """Lines on ``min_sites`` or more distinct sites: line (hash), n_docs, n_sites, n_carriers, boilerplate.

    A carrier is a document up to copies: all documents of the same set of lines are one.
    One HyperLogLog sketch of the sites and one of the carriers per line hash are built on
    the map side and merged by aggregation, so a line of all documents is no hot key. Lines
    whose estimates lie near the threshold get exact distinct counts.
    """
    stages = Stages(docs.sparkSession)
    # A line counts once in a document.
    distinct_lines = F.array_distinct(F.transform(F.filter(F.split("text", "\n"), lambda line: F.trim(line) != ""), _line_key))
    # Keys are made before the lines are unfolded, and the lines are stored for the exact counts.
    texts = docs.where("text IS NOT NULL").select(F.xxhash64("source").alias("site"), F.sort_array(distinct_lines).alias("lines"))
    keyed = stages.keep(texts.select("site", F.xxhash64("lines").alias("carrier"), F.explode("lines").alias("line")))
    sketched = keyed.groupBy("line").agg(
        F.count("*").alias("n_docs"),
        F.min("site").alias("one"), F.max("site").alias("other"),
        F.hll_sketch_agg("site", F.lit(LG_K)).alias("sites"),
        F.hll_sketch_agg("carrier", F.lit(LG_K)).alias("carriers"),
    )
    estimates = [F.hll_sketch_estimate(c).alias(c) for c in ("sites", "carriers")]
    estimated = stages.keep(
        sketched.where((F.col("n_docs") >= min_sites) & (F.col("one") != F.col("other")))
        .select("line", "n_docs", *estimates)
        .where(F.col("sites") >= min_sites * (1 - BAND))
    )
    close = [F.col(c).between(min_sites * (1 - BAND), min_sites * (1 + BAND)) for c in ("sites", "carriers")]
    near = stages.keep(estimated.where(close[0] | close[1]).select("line"))
    wanted = keyed.join(small(near, near.count()), "line", "left_semi")
    exact_sites = wanted.select("line", "site").distinct().groupBy("line").agg(F.count("*").alias("exact_sites"))
    exact_carriers = wanted.select("line", "carrier").distinct().groupBy("line").agg(F.count("*").alias("exact_carriers"))
    exact = stages.keep(exact_sites.join(exact_carriers, "line"))
    stages.drop(near, keyed)
    n_sites, n_carriers = F.coalesce("exact_sites", "sites"), F.coalesce("exact_carriers", "carriers")
    return (
        estimated.join(exact, "line", "left")
        .select("line", "n_docs", n_sites.alias("n_sites"), n_carriers.alias("n_carriers"))
        .where(F.col("n_sites") >= min_sites)
        .withColumn("boilerplate", F.col("n_carriers") >= min_sites)
    )


def _cleaned(docs: DataFrame, min_sites: int) -> DataFrame:
    """row (a row of ``docs``), its digest and dropped, the places (from 0) of its boilerplate lines, or null."""
    stages = Stages(docs.sparkSession)
    boilerplate = stages.keep(line_spread(docs, min_sites).where("boilerplate").select("line"))
    # Equal texts lose the same lines, so texts are known by their digest: rows that repeat
    # a doc_id or have none need no key of their own.
    digest = [F.xxhash64("text", F.lit(0)).alias("d0"), F.xxhash64(F.lit(1), "text").alias("d1")]
    hashed = docs.where("text IS NOT NULL").select(*digest, F.transform(F.split("text", "\n"), _line_key).alias("lines"))
    lines = hashed.select("d0", "d1", F.posexplode("lines").alias("place", "line"))
    found = lines.join(small(boilerplate, boilerplate.count()), "line", "left_semi")
    places = stages.keep(found.groupBy("d0", "d1").agg(F.sort_array(F.collect_set("place")).alias("dropped")))
    keyed = docs.select(F.struct(*docs.columns).alias("row"), *digest)
    return keyed.join(small(places, places.count()), ["d0", "d1"], "left")


def _kept_text() -> Column:
    text = F.col("row.text")
    kept = F.filter(F.split(text, "\n"), lambda line, i: ~F.array_contains(F.col("dropped"), i))
    return F.when(F.col("dropped").isNull(), text).otherwise(F.array_join(kept, "\n"))


def line_dedup(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """Texts without the lines that recur across sites.

    One row per row of ``docs``: doc_id, text (what stays), n_lines and n_removed. A line is
    compared without blanks at its ends; blank lines always stay and are never counted. A
    line is boilerplate if documents of ``min_sites`` or more sources carry it and if as many
    of these documents differ in their sets of lines. Without the second rule all lines of
    a text that was copied to five sites would go, from every copy; copies are left to the
    deduplication of documents. Copies with edits differ: a line that ``min_sites`` edited
    versions on as many sites have in common is boilerplate.

    A null source is one more site. A null text stays null with no lines; a text of
    boilerplate only becomes empty; its row stays. Repeated rows are judged alike. An empty
    table gives no rows. Other columns are ignored.
    """
    text = F.col("row.text")
    return _cleaned(docs.select("doc_id", "source", "text"), min_sites).select(
        F.col("row.doc_id").alias("doc_id"),
        _kept_text().alias("text"),
        F.when(text.isNull(), 0).otherwise(F.size(F.split(text, "\n"))).cast("long").alias("n_lines"),
        F.coalesce(F.size(F.col("dropped")), F.lit(0)).cast("long").alias("n_removed"),
    )


def without_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """``docs`` with all its columns and rows, its texts cleaned as by ``line_dedup``.

    n_chars, if present, is counted anew for changed texts.
    """
    new = {"text": _kept_text()}
    if "n_chars" in docs.columns:
        counted = F.char_length(_kept_text()).cast(docs.schema["n_chars"].dataType)
        new["n_chars"] = F.when(F.col("dropped").isNotNull(), counted).otherwise(F.col("row.n_chars"))
    return _cleaned(docs, min_sites).select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])
