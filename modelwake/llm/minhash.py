"""Near-duplicate documents by min-max hashing with links confirmed on full shingle sets."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modelwake.llm.common import Stages, few, hashed_words, linked_components, mix, small, text_slices, windows_hash

#: Permutations; each gives a minimum and a maximum, so a signature has twice as many values.
PERMUTATIONS = 64
#: Values of a signature that form one band.
BAND_VALUES = 4
BANDS = 2 * PERMUTATIONS // BAND_VALUES
#: Pairs of shingle sets that one task compares.
TASK_PAIRS = 1_000

_GENERATOR = np.random.default_rng(20240607)
_FACTORS = _GENERATOR.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _GENERATOR.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)


def shingle_set(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; a shorter text is one shingle."""
    if not len(words):
        return words
    return np.unique(windows_hash(words, min(width, len(words))) + np.uint64(min(width, len(words))))


def signature(shingles: np.ndarray) -> np.ndarray:
    """Minimum and maximum of every permutation, side by side: min 0, max 0, min 1, max 1, ..."""
    low = np.full(PERMUTATIONS, 0xFFFFFFFF, dtype=np.uint32)
    high = np.zeros(PERMUTATIONS, dtype=np.uint32)
    for start in range(0, len(shingles), 8192):
        part = shingles[start : start + 8192]
        values = ((part[None, :] * _FACTORS[:, None] + _SHIFTS[:, None]) >> np.uint64(32)).astype(np.uint32)
        np.minimum(low, values.min(axis=1), out=low)
        np.maximum(high, values.max(axis=1), out=high)
    return np.column_stack([low, high]).ravel()


def band_hashes(values: np.ndarray) -> np.ndarray:
    grouped = values.reshape(BANDS, BAND_VALUES).astype(np.uint64)
    out = np.arange(1, BANDS + 1, dtype=np.uint64)
    for i in range(BAND_VALUES):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + grouped[:, i])
    return out.view(np.int64)


_SIGNED = pa.schema(
    [
        ("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()),
        ("bands", pa.list_(pa.int64())), ("s0", pa.int64()), ("s1", pa.int64()),
    ]
)


def _signed(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                sizes, digests, bands, bits = [], [], [], []
                for words in hashed_words(part.column("text").to_pylist()):
                    shingles = shingle_set(words, width)
                    values = signature(shingles)
                    sizes.append(len(shingles))
                    digests.append(hashlib.blake2b(shingles.tobytes(), digest_size=16).digest())
                    bands.append(band_hashes(values) if len(shingles) else [])
                    bits.append(np.packbits((values & np.uint32(1)).astype(bool)).view(np.int64))
                sketch = np.array(bits, dtype=np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()),
                        pa.array(bands, pa.list_(pa.int64())), pa.array(sketch[:, 0]), pa.array(sketch[:, 1]),
                    ],
                    schema=_SIGNED,
                )

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                sets = [shingle_set(w, width).tobytes() for w in hashed_words(part.column("text").to_pylist())]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").cast(pa.int64()), pa.array(sets, pa.binary())], names=["doc_id", "shingles"]
                )

    return run


def _confirmed(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                left, right = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, y))
                both = len(np.intersect1d(left, right, assume_unique=True))
                keep.append(100 * both >= percent * (len(left) + len(right) - both))
            kept = pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"])
            yield kept.filter(pa.array(keep, pa.bool_()))

    return run


_DELTA = "p long, x long, n long, d long, elements array<long>"


def _deltas(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The elements in which the set of x differs from that of its pivot p."""
    for batch in batches:
        sizes, counts, elements = [], [], []
        for pivot, own in zip(batch.column("set_p"), batch.column("set_x"), strict=True):
            left, right = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (pivot, own))
            differ = np.setxor1d(left, right, assume_unique=True)
            sizes.append(len(right))
            counts.append(len(differ))
            elements.append(differ.view(np.int64))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("p"), batch.column("x"), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()),
                pa.array(elements, pa.list_(pa.int64())),
            ],
            names=["p", "x", "n", "d", "elements"],
        )


def _pairs_across(rows: DataFrame, set_of: Callable[[DataFrame], DataFrame], percent: int, stages: Stages) -> DataFrame:
    """Pairs of different components in one bucket that may reach the similarity.

    Versions of one text agree in nearly all shingles, so what they share says nothing.
    What counts is how each differs from the bucket's pivot p. With D(x) the symmetric
    difference of x and p, x and y differ in |D(x)| + |D(y)| - 2 |D(x) and D(y)| elements
    and are linked if that is at most c (|x| + |y|), c = (1 - t) / (1 + t). So D(x) and D(y)
    must share g(x) / 2 + g(y) / 2 elements, where g(x) = |D(x)| - c |x|: a prefix join on
    (p, element), rarest elements first, finds all such pairs without listing the others.
    Where that number is not positive, x and y are linked through the member with the
    smallest g; it is paired with all others.
    """
    c = (100 - percent) / (100 + percent)
    pivots = rows.groupBy("bucket").agg(F.max_by("node", F.struct("mass", "node")).alias("p"))
    near_p = stages.keep(rows.join(pivots, "bucket").select("p", F.col("node").alias("x"), "root").distinct())
    pairs = near_p.count()
    sets = set_of(few(near_p.select(F.explode(F.array("p", "x")).alias("doc_id")).distinct(), 2 * pairs))
    set_x = sets.select(F.col("doc_id").alias("x"), F.col("shingles").alias("set_x"))
    set_p = sets.select(F.col("doc_id").alias("p"), F.col("shingles").alias("set_p"))
    both = near_p.select("p", "x").join(set_x, "x").join(set_p, "p").select("p", "x", "set_p", "set_x")
    deltas = stages.keep(few(both, pairs, TASK_PAIRS).mapInArrow(_deltas, _DELTA))
    g = F.col("d") - c * F.col("n")
    known = deltas.join(near_p, ["p", "x"]).select("p", "x", "root", "d", g.alias("g"), "elements")
    best = known.groupBy("p").agg(F.min_by(F.struct("x", "root"), F.struct("g", "x")).alias("best"))
    through_best = known.join(best, "p").where(F.col("root") != F.col("best.root")).select(F.col("x").alias("a"), F.col("best.x").alias("b"))

    elements = deltas.select("p", "x", F.explode("elements").alias("e"))
    frequency = elements.groupBy("p", "e").agg(F.count("*").alias("f"))
    order = elements.join(frequency, ["p", "e"]).groupBy("p", "x").agg(F.sort_array(F.collect_list(F.struct("f", "e"))).alias("order"))
    ranked = stages.keep(
        known.drop("elements").join(order, ["p", "x"]).select("p", "x", "root", "d", "g", F.posexplode("order").alias("i", "fe"))
        .select("p", "x", "root", "d", "g", "i", F.col("fe.e").alias("e"), F.col("fe.f").alias("f"))
        .where("f > 1")
    )
    index = ranked.where(F.col("i") <= F.col("d") - F.greatest(F.lit(1), F.ceil("g")))
    index = index.select("p", "e", *[F.col(k).alias(f"{k}_y") for k in ("x", "root", "d", "g", "i")])
    shared = (F.col("g") + F.col("g_y")) / 2
    hits = ranked.join(index, ["p", "e"]).where(
        (F.col("root") != F.col("root_y"))
        & ((F.col("g_y") < F.col("g")) | ((F.col("g_y") == F.col("g")) & (F.col("x_y") < F.col("x"))))
        & (F.least(F.col("d") - F.col("i"), F.col("d_y") - F.col("i_y")) + 1e-6 >= shared)
    )
    return through_best.unionByName(hits.select(F.col("x").alias("a"), F.col("x_y").alias("b")))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Groups of documents whose word shingle sets have a Jaccard similarity of percent/100 or more.

    Returns one row per row of ``docs``: doc_id, n_shingles, component_id (the smallest
    doc_id reachable over links) and kept (doc_id = component_id).

    A text with fewer words than ``width`` is one shingle; a null, empty or blank text
    has none and is linked with nothing. Equal sets form one class before any banding,
    so copies cost no pairs. Rows that repeat a doc_id are judged by their own text; a
    row without doc_id is linked with nothing and has a null component, and is kept.
    An empty table gives an empty table. Other columns are ignored.

    32 bands of four values miss a link at similarity 0.80 with probability 5e-8.
    """
    stages = Stages(docs.sparkSession)
    # A bit of two 128-bit sketches differs with half the Jaccard distance; 6.5 standard deviations above.
    differs = (100 - percent) / 200
    most_bits = math.ceil(128 * differs + 6.5 * math.sqrt(128 * differs * (1 - differs)))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    schema = "doc_id long, n_shingles long, digest binary, bands array<long>, s0 long, s1 long"
    signed = stages.keep(texts.mapInArrow(_signed(width), schema))
    linkable = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = stages.keep(few(linkable.groupBy("digest").agg(F.min("doc_id").alias("node")), signed.count()))
    heads = linkable.withColumnRenamed("doc_id", "node").join(classes, ["digest", "node"], "left_semi")
    members = heads.select(
        F.explode("bands").alias("bucket"), "node", F.struct(F.col("n_shingles").alias("n"), "s0", "s1").alias("info")
    )

    def near(a: str, b: str) -> F.Column:
        bits = F.bit_count(F.col(f"{a}.s0").bitwiseXOR(F.col(f"{b}.s0"))) + F.bit_count(F.col(f"{a}.s1").bitwiseXOR(F.col(f"{b}.s1")))
        sizes = 100 * F.least(F.col(f"{a}.n"), F.col(f"{b}.n")) >= percent * F.greatest(F.col(f"{a}.n"), F.col(f"{b}.n"))
        return sizes & (bits <= most_bits)

    def set_of(ids: DataFrame) -> DataFrame:
        ids = stages.keep(ids)
        wanted = texts.join(small(ids, ids.count()), "doc_id", "left_semi")
        return stages.keep(wanted.mapInArrow(_sets(width), "doc_id long, shingles binary"))

    def confirm(pairs: DataFrame) -> DataFrame:
        n = pairs.count()
        sets = set_of(few(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), 2 * n))
        x = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x"))
        y = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y"))
        both = few(pairs.join(x, "a").join(y, "b"), n, TASK_PAIRS)
        links = stages.keep(both.mapInArrow(_confirmed(percent), "a long, b long"))
        stages.drop(sets)
        return few(links.distinct(), links.count())

    def across(rows: DataFrame) -> DataFrame:
        return _pairs_across(rows, set_of, percent, stages)

    roots = linked_components(members, near, confirm, stages, across)
    of_class = classes.join(small(roots, roots.count()), "node", "left").select("digest", F.coalesce("root", "node").alias("_root"))
    judged = signed.join(of_class, "digest", "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("_root")).otherwise(F.col("doc_id"))
    return judged.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id"))
    )


def without_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that ``near_duplicates`` keeps, with all their columns.

    Documents are known by doc_id: rows that repeat a kept doc_id all stay, and a
    repeated doc_id goes only if none of its texts is kept. Rows without doc_id stay.
    """
    judged = near_duplicates(docs, width, percent)
    dropped = judged.groupBy("doc_id").agg(F.bool_or("kept").alias("_kept")).where("NOT _kept").select(F.col("doc_id").alias("_id"))
    return docs.join(dropped, docs["doc_id"] == dropped["_id"], "left_anti")
