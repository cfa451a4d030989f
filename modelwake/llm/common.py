"""What the corpus operators share: stored stages, word arrays and connected components."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from modelwake.session import scratch_path

#: Bytes of text that one Python step turns into word arrays at a time.
SLICE_BYTES = 1_000_000
#: Rows of a table that may carry a broadcast hint; every use counts the rows first.
BROADCAST_ROWS = 100_000
#: Rows of a counted table that one task writes.
TASK_ROWS = 10_000
#: With it, a query removes its shuffle files when it ends.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes of a batch that a task hands to Python, as many as are encoded together. Spark's own 64 MB are held beside
#: the heap, and again by the Python worker, in every task at once.
ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
ARROW_BATCH = "6000000"


class Stages:
    """Stored intermediate tables in the shared checkpoint folder.

    ``keep`` writes a table and returns it as read back, so lineage ends at files that
    outlive every executor. ``drop`` deletes tables that nothing reads any more.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        # Python workers import this package: name its folder to them, as PYTHONPATH would.
        root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
        known = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
        if root not in known:
            spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, known)])
        #: Path by identity of the table; the table itself is held, so that no other gets its identity.
        self.paths: dict[int, tuple[DataFrame, str]] = {}

    def keep(self, df: DataFrame) -> DataFrame:
        path = scratch_path(self.spark, "stage")
        # Nothing reads the shuffles of a stored table again; else they stay until the driver collects its garbage.
        # A batch size that the session names itself stays.
        with self._set({SHUFFLE_CLEANUP: "true", ARROW_BYTES: self.spark.conf.get(ARROW_BYTES, ARROW_BATCH)}):
            df.write.option("compression", "zstd").parquet(path)
        stored = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(stored)] = stored, path
        return stored

    @contextmanager
    def _set(self, settings: dict[str, str]) -> Iterator[None]:
        """Settings of the session, for a while."""
        before = {key: self.spark.conf.get(key, None) for key in settings}
        try:
            for key, value in settings.items():
                self.spark.conf.set(key, value)
            yield
        finally:
            for key, value in before.items():
                if value is None:
                    self.spark.conf.unset(key)
                else:
                    self.spark.conf.set(key, value)

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            _, path = self.paths.pop(id(table))
            where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


def few(df: DataFrame, rows: int, each: int = TASK_ROWS) -> DataFrame:
    """``df`` in as many partitions as ``rows`` take at ``each`` a task, or in the fewer that it has.

    A small table costs its tasks and files, not its rows, if each shuffle partition makes one of either. ``rows``
    is a counted bound of what the last stage of ``df`` reads, not only of what it returns: its tasks become fewer.
    """
    return df.coalesce(max(1, -(-rows // each)))


def small(df: DataFrame, rows: int, read: bool = False) -> DataFrame:
    """Broadcast ``df`` only when the counted ``rows`` allow it; if they bound what it reads too, from ``few`` tasks."""
    if rows > BROADCAST_ROWS:
        return df
    return F.broadcast(few(df, rows) if read else df)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def text_slices(batch: pa.RecordBatch, column: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut an Arrow batch into runs of rows of about ``size`` bytes of text; rows stay whole."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    start = 0
    while start < len(sizes):
        before = int(ends[start - 1]) if start else 0
        end = max(start + 1, int(np.searchsorted(ends, before + size, side="right")))
        yield batch.slice(start, end - start)
        start = end


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hashed_words(texts: list[str | None]) -> list[np.ndarray]:
    """64-bit hashes of the words of every text, lower-cased in A-Z and cut at ASCII white space."""
    words: list[bytes] = []
    ends = []
    for text in texts:
        # Lone surrogates cannot be stored in a table; "replace" keeps odd callers alive.
        words.extend((text or "").encode("utf-8", "replace").lower().split())
        ends.append(len(words))
    if not words:
        return [np.empty(0, dtype=np.uint64) for _ in texts]
    column = np.empty(len(words), dtype=object)
    column[:] = words
    codes, distinct = pd.factorize(column)
    hashes = mix(pd.util.hash_array(np.asarray(distinct, dtype=object), categorize=False))[codes]
    return np.split(hashes, ends[:-1])


def windows_hash(words: np.ndarray, length: int) -> np.ndarray:
    """64-bit hash of every run of ``length`` words; empty when there are fewer."""
    n = len(words) - length + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for i in range(length):
        out = out * np.uint64(0x9E3779B97F4A7C15) + words[i : i + n]
    return mix(out)


def components(edges: DataFrame, stages: Stages) -> DataFrame:
    """Connected components of ``edges`` (a, b): node and root, its smallest reachable node, as a stored table.

    Alternating large-star and small-star steps: every step moves edges towards the
    smallest neighbour by an aggregation and an equi-join, so no component is gathered
    anywhere. Nodes without an edge have no row.
    """

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % (1 << 30)), F.bit_xor(F.xxhash64("a", "b"))).first())

    ordered = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now = stages.keep(few(ordered.distinct(), edges.count()))
    before, seen = None, mark(now)
    while seen != before and seen[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # Every edge has two ends.
        near = both.join(small(least, 2 * seen[0], read=True), "a").where("b > a")
        large = near.select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = (
            large.join(small(low, 2 * seen[0], read=True), "a")
            .select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
            .select("e.*")
            .where("a <> b")
            .distinct()
        )
        # Every edge gives two at most.
        after = stages.keep(few(moved, 2 * seen[0]))
        stages.drop(now)
        now, before, seen = after, seen, mark(after)
    # All edges are those of stars by now; a centre is its own root.
    ends = F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("root")), F.struct(F.col("b").alias("node"), F.col("b").alias("root")))
    roots = now.select(F.explode(ends).alias("e")).select("e.*").groupBy("node").agg(F.min("root").alias("root"))
    return stages.keep(few(roots, 2 * seen[0]))


def linked_components(
    members: DataFrame,
    near: Callable[[str, str], Column],
    confirm: Callable[[DataFrame], DataFrame],
    stages: Stages,
    across: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Components of the graph that links nodes of a common bucket if ``confirm`` says so.

    ``members`` has bucket, node and info (a struct). ``near(a, b)`` is a cheap test on two
    info columns, ``confirm`` takes stored candidate pairs (a, b) and returns the linked ones.
    Returns a stored table: node, root; nodes without a link have no row.
    Copies of one text in thousands of versions would give all pairs of a bucket, so two
    rounds first compare the members with one pivot per bucket: the member that shares
    most buckets with others. Buckets that still hold more than one component are searched
    across components only: pair by pair, or by ``across``, which takes their rows (bucket,
    node, info, root, mass) and returns every pair (a, b) of different roots that may be
    linked. Every pair that could join two components is tested; there is no cap.
    """
    # Most buckets hold one node: the others are few enough to meet the members without a shuffle, or shuffle.
    counts = stages.keep(members.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"))
    shared = stages.keep(members.join(small(counts, counts.count()), "bucket"))
    stages.drop(counts)
    mass = shared.groupBy("node").agg(F.sum("n").alias("mass"))
    shared_rows = shared.count()
    shared_mass = stages.keep(few(shared.join(mass, "node"), shared_rows))
    stages.drop(shared)

    def ordered(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    def pivot_pairs(rows: DataFrame, eligible: Column) -> DataFrame:
        choice = F.when(eligible, F.struct("mass", "node"))
        pivots = rows.groupBy("bucket").agg(F.max_by(F.struct("node", "info", "root"), choice).alias("p"))
        return ordered(
            rows.join(pivots, "bucket")
            .where((F.col("node") != F.col("p.node")) & (F.col("root") != F.col("p.root")) & near("info", "p.info"))
            .select(F.col("node").alias("a"), F.col("p.node").alias("b"))
        )

    # A member makes one pair with the pivot at most.
    first = stages.keep(few(pivot_pairs(shared_mass.withColumn("root", F.col("node")), F.lit(True)), shared_rows))
    links = stages.keep(confirm(first))

    def mixed(links: DataFrame, least: int) -> DataFrame:
        roots = components(links, stages)
        joined = shared_mass.where(F.col("n") > least).join(small(roots, roots.count()), "node", "left")
        rows = stages.keep(few(joined.withColumn("root", F.coalesce("root", "node")), shared_rows))
        stages.drop(roots)
        open_buckets = rows.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("bucket")
        return rows.join(open_buckets, "bucket")

    rows = mixed(links, 2)
    # The second pivot comes from outside the component of the first one.
    tops = rows.groupBy("bucket").agg(F.max_by("root", F.struct("mass", "node")).alias("top"))
    second = pivot_pairs(rows.join(tops, "bucket"), F.col("root") != F.col("top")).join(first, ["a", "b"], "left_anti")
    second = stages.keep(few(second, shared_rows))
    links2 = stages.keep(links.unionByName(confirm(second)))

    rows = mixed(links2, 3)
    if across is None:
        other = rows.select("bucket", F.col("node").alias("b"), F.col("info").alias("info_b"), F.col("root").alias("root_b"))
        rest = (
            rows.join(other, "bucket")
            .where((F.col("node") < F.col("b")) & (F.col("root") != F.col("root_b")) & near("info", "info_b"))
            .select(F.col("node").alias("a"), "b")
        )
    else:
        rest = across(rows)
    rest = ordered(rest)
    rest = stages.keep(rest.join(first, ["a", "b"], "left_anti").join(second, ["a", "b"], "left_anti"))
    links3 = stages.keep(links2.unionByName(confirm(rest)))
    stages.drop(shared_mass, first, second, rest, links, links2)
    return components(links3, stages)
