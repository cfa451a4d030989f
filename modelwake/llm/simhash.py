"""Document fingerprints: SimHash, and block tables that find all fingerprints within a Hamming radius."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from modelwake.llm.common import Stages, linked_components, text_or_empty

#: Bits in which neighbouring fingerprints of one class may differ.
RADIUS = 3
#: Blocks of the 64 bits. At most RADIUS of them can differ, so the others agree.
BLOCKS = 6

_NO_ID = -(1 << 63)
_LANES = [f"_v{i}" for i in range(32)]


def _voted(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``keys``, copies (rows of these keys) and fingerprint of the column ``text``.

    Equal keys must mean equal texts: their votes add up without changing a sign. Terms
    are pairs of neighbouring words in lower case; the last word stands alone. Every
    occurrence votes with the 64 bits of its hash, so a term weighs as often as it occurs.
    Bits i and i + 32 are summed in one long. All sums start on the map side, so neither a
    long text nor a text with many copies is a hot key.
    """
    words = texts.withColumn("_w", F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != ""))
    paired = words.select(*keys, F.arrays_zip("_w", F.slice("_w", F.lit(2), F.size("_w")).alias("_next")).alias("_terms"))
    terms = paired.select(*keys, F.posexplode_outer("_terms").alias("_place", "_t"))
    hashed = terms.select(
        *keys,
        F.when(F.coalesce("_place", F.lit(0)) == 0, 1).otherwise(0).alias("_first"),
        F.when(F.col("_t").isNotNull(), 1).otherwise(0).alias("_one"),
        F.when(F.col("_t").isNotNull(), F.xxhash64("_t._w", "_t._next")).otherwise(F.lit(0)).alias("_h"),
    )
    lane = F.lit((1 << 32) + 1)
    sums = [F.sum(F.shiftrightunsigned("_h", i).bitwiseAND(lane)).alias(name) for i, name in enumerate(_LANES)]
    voted = hashed.groupBy(*keys).agg(F.sum("_first").alias("copies"), F.sum("_one").alias("_n"), *sums)
    bits = []
    for i, name in enumerate(_LANES):
        low, high = F.col(name).bitwiseAND(F.lit((1 << 32) - 1)), F.shiftrightunsigned(name, 32)
        bits.append(F.when(2 * low > F.col("_n"), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
        top = 1 << (i + 32)
        bits.append(F.when(2 * high > F.col("_n"), F.lit(top if top < 1 << 63 else _NO_ID)).otherwise(F.lit(0)).cast("long"))
    return voted.select(*keys, "copies", reduce(Column.bitwiseOR, bits).alias("fingerprint"))


def likeness(a: Column, b: Column) -> Column:
    """Estimated cosine similarity of two texts from their fingerprints, 0 to 1; 1 for equal ones."""
    differ = F.bit_count(a.bitwiseXOR(b))
    return F.when(differ == 0, 1.0).otherwise(F.greatest(F.lit(0.0), F.cos(differ * F.lit(3.141592653589793 / 64))))


def fingerprints(docs: DataFrame) -> DataFrame:
    """_key (doc_id, null as the smallest), _hash (of the text), n_chars, copies, fingerprint: one row per doc_id and text."""
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("_key"), text_or_empty().alias("_text"))
    rows = texts.withColumns({"_hash": F.xxhash64("_text"), "n_chars": F.char_length("_text").cast("long")})
    return _voted(rows, ["_key", "_hash", "n_chars"], "_text")


def neighbours(rows: DataFrame, stages: Stages) -> DataFrame:
    """For each _key: _below_print, the fingerprint of the next lower _key, and _above, _above_n: key and length of the next higher.

    The order is a ring. Keys are range-partitioned and stored with their part; windows run
    inside the parts, and one row per part carries the borders across.
    """
    first = F.struct("_hash", "fingerprint", "n_chars")
    ids = rows.groupBy("_key").agg(F.min_by("fingerprint", first).alias("print"), F.max("n_chars").alias("n"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = stages.keep(ids.repartitionByRange(parts, "_key").withColumn("part", F.spark_partition_id()))
    row = F.struct("_key", "print", "n")
    ends = ranged.groupBy("part").agg(F.min_by(row, "_key").alias("lo"), F.max_by(row, "_key").alias("hi"))
    # At most one row per part: bounded by the number of partitions.
    every = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    one = Window.orderBy("part")
    borders = ends.select(
        "part",
        F.coalesce(F.lag("hi").over(one), F.last("hi").over(every)).alias("under"),
        F.coalesce(F.lead("lo").over(one), F.first("lo").over(every)).alias("over"),
    )
    inside = Window.partitionBy("part").orderBy("_key")
    near = ranged.select("_key", "part", F.lag(row).over(inside).alias("below"), F.lead(row).over(inside).alias("above"))
    joined = near.join(F.broadcast(borders), "part")
    below, above = F.coalesce("below", "under"), F.coalesce("above", "over")
    return joined.select("_key", below["print"].alias("_below_print"), above["_key"].alias("_above"), above["n"].alias("_above_n"))


def fingerprint_classes(prints: DataFrame, stages: Stages, radius: int = RADIUS) -> DataFrame:
    """fingerprint and class_print, the smallest fingerprint reachable over steps of at most ``radius`` bits.

    Two fingerprints within the radius agree in BLOCKS - radius of BLOCKS blocks. Each
    choice of blocks is one permuted table, keyed by the bits of the chosen blocks, so
    every such pair meets in a bucket of some table. Equal fingerprints are one row.
    """
    width = -(-64 // BLOCKS)
    masks = [sum(1 << b for b in range(k * width, min(64, (k + 1) * width))) for k in range(BLOCKS)]
    buckets = []
    for number, blocks in enumerate(combinations(masks, BLOCKS - radius)):
        mask = sum(blocks)
        chosen = F.col("node").bitwiseAND(F.lit(mask if mask < 1 << 63 else mask - (1 << 64)))
        buckets.append(F.xxhash64(F.lit(number), chosen))
    nodes = prints.select(F.col("fingerprint").alias("node")).distinct()
    members = nodes.select(F.explode(F.array(*buckets)).alias("bucket"), "node", F.struct(F.col("node").alias("f")).alias("info"))

    def near(a: str, b: str) -> Column:
        return F.bit_count(F.col(f"{a}.f").bitwiseXOR(F.col(f"{b}.f"))) <= radius

    roots = linked_components(members, near, lambda pairs: pairs, stages)
    return nodes.join(roots, "node", "left").select(F.col("node").alias("fingerprint"), F.coalesce("root", "node").alias("class_print"))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of all texts and of edited ones.

    One row per row of ``docs``: doc_id, n_chars (code points), edited_sha256, fingerprint,
    edited_fingerprint (16 hexadecimal digits), near_edited, near_next, class_id. A text is
    edited by replacing its last third (rounded down) by as much of the start of the next
    document: the next lower doc_id, after the lowest the highest. class_id is the smallest
    doc_id of the class of fingerprints that are linked by steps of at most RADIUS bits:
    few near copies of 5-word Jaccard 0.8 lie that close (see README), so classes hold
    copies and slight edits only.

    A null text counts as empty; a text without words has fingerprint 0. A null doc_id is
    lower than any other. If a doc_id repeats, its text with the smallest hash stands for
    it as the next document; its own rows are judged each by their text, and equal rows
    come as often as given. An only document is its own next one. An empty table gives no
    rows. Other columns are ignored.
    """
    stages = Stages(docs.sparkSession)
    prints = stages.keep(fingerprints(docs))
    ring = stages.keep(neighbours(prints, stages))
    base = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("_key"), text_or_empty().alias("_text"))
    third = (F.char_length("_text") / 3).cast("int")
    # Every document hands on only the start that the one above it needs.
    start = F.substring("_text", F.lit(1), (F.col("_above_n") / 3).cast("int")).alias("_start")
    given = base.join(ring.select("_key", "_above", "_above_n"), "_key").select(F.col("_above").alias("_key"), F.xxhash64("_text").alias("_h"), start)
    received = given.groupBy("_key").agg(F.min_by("_start", "_h").alias("_start"))
    own = base.join(received, "_key").select(
        "_key",
        F.xxhash64("_text").alias("_hash"),
        F.concat(
            F.substring("_text", F.lit(1), F.char_length("_text") - third), F.substring("_start", F.lit(1), third)
        ).alias("_edited"),
    )
    hashed = own.withColumn("edited_sha256", F.sha2(F.col("_edited").cast("binary"), 256))
    edited = _voted(hashed, ["_key", "_hash", "edited_sha256"], "_edited").withColumnRenamed("fingerprint", "_edited_print")
    lowest = prints.where(F.col("_key") != _NO_ID).groupBy("fingerprint").agg(F.min("_key").alias("_least"))
    classes = fingerprint_classes(prints, stages)
    named = classes.join(lowest, "fingerprint", "left").groupBy("class_print").agg(F.min("_least").alias("class_id"))
    of_print = stages.keep(classes.join(named, "class_print").select("fingerprint", "class_id"))
    facts = prints.join(ring, "_key").join(of_print, "fingerprint")
    joined = edited.drop("copies").join(facts, ["_key", "_hash"]).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    text = lambda c: F.lower(F.lpad(F.hex(c), 16, "0"))
    return joined.select(
        F.when(F.col("_key") != _NO_ID, F.col("_key")).alias("doc_id"),
        "n_chars",
        "edited_sha256",
        text("fingerprint").alias("fingerprint"),
        text("_edited_print").alias("edited_fingerprint"),
        likeness(F.col("fingerprint"), F.col("_edited_print")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("_below_print")).alias("near_next"),
        "class_id",
    )
