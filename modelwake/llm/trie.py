"""Prefix trie of conversations from digests of fixed-length blocks of turns."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modelwake.llm.common import Stages
from modelwake.operators.ordered import SPLIT_ROWS, running_totals

#: Turns of one block.
BLOCK = 4
#: Conversation ids that one row of a member list spans.
SPAN = 4096
#: Shards of the continuations of one prefix.
SHARDS = 32

# Fixed values of the rebuilt conversations: how many share a start, and its turns.
FAMILY, HEADS = 20, 4
WORD = r"[^\x20\x09-\x0D]+"

_SUMS = ("a", "b", "c", "d")
_NO_ENDS = hashlib.sha256(b"").hexdigest()


def turns_of(conversations: DataFrame, split_above: int = SPLIT_ROWS) -> DataFrame:
    """conv_id, pos (from 0), digest and words of every turn, ordered by turn (null first), role and digest.

    A conversation may hold most of all rows: beyond ``split_above`` its places are running
    totals over ranges, not one window.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    content = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(F.col("turn").alias("turn"), role.alias("role"), F.unhex(F.md5(content)).alias("digest")).alias("key"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
    )
    same = turns.groupBy("conv_id", "key").agg(F.count("*").alias("n"), F.first("words").alias("words"))
    most = same.groupBy("conv_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    placed = running_totals(same, ["conv_id"], "key", ["n"], most, split_above)
    # Equal rows of a conversation take places one after the other.
    return placed.select(
        "conv_id", F.explode(F.sequence(F.col("cum_n") - F.col("n"), F.col("cum_n") - 1)).alias("pos"), F.col("key.digest").alias("digest"), "words"
    )


def shared_starts(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rebuilt conversations, and conv_id of all of them, also of those without a turn.

    Conversation c begins with the first h turns of conversation c - c % FAMILY and goes on
    with its own turns after its first h; h is the CRC-32 of its number modulo HEADS. Only
    the first turns of the first conversations of families are joined, a few rows each.
    """
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS
    heads = turns.where((F.col("conv_id") % FAMILY == 0) & (F.col("pos") < HEADS - 1))
    head = heads.groupBy(F.col("conv_id").alias("first_id")).agg(
        F.sort_array(F.collect_list(F.struct("pos", "digest", "words"))).alias("head")
    )
    ids = turns.select("conv_id").distinct().withColumn("h", h)
    taken = ids.withColumn("first_id", F.col("conv_id") - F.col("conv_id") % FAMILY).join(head, "first_id", "left")
    none = F.array().cast("array<struct<pos:bigint,digest:binary,words:bigint>>")
    taken = taken.select("conv_id", "h", F.slice(F.coalesce("head", none), 1, F.col("h").cast("int")).alias("head"))
    start = taken.select("conv_id", F.explode("head").alias("t")).select("conv_id", "t.pos", "t.digest", "t.words")
    shifts = taken.select("conv_id", (F.size("head") - F.col("h")).alias("shift"))
    own = turns.where(F.col("pos") >= h).join(shifts, "conv_id")
    own = own.select("conv_id", (F.col("pos") + F.col("shift")).alias("pos"), "digest", "words")
    return start.unionByName(own), ids.select("conv_id")


def _place_sums(block: Column, digest: Column) -> list[Column]:
    """Four 32-bit numbers of a block digest at its place; their sums along a conversation name its prefix."""
    at = F.md5(F.concat(block.cast("string"), F.lit(":"), F.hex(digest)))
    return [F.conv(F.substring(at, 8 * i + 1, 8), 16, 10).cast("long") for i in range(len(_SUMS))]


def _node(sums: list[Column]) -> Column:
    return F.unhex(F.md5(F.concat_ws(",", *[s.cast("string") for s in sums])))


def _joined_digest(turns: Column) -> Column:
    return F.unhex(F.md5(F.array_join(F.transform(turns, lambda t: F.hex(t["digest"])), "")))


def blocks_of(turns: DataFrame, most: int, block: int = BLOCK, split_above: int = SPLIT_ROWS) -> DataFrame:
    """One row per conversation and block of turns: its turns, digest, and the summed digests before it and with it."""
    grouped = turns.groupBy("conv_id", F.expr(f"pos div {block}").alias("block")).agg(
        F.sort_array(F.collect_list(F.struct("pos", "digest", "words"))).alias("turns")
    )
    own = grouped.withColumn("digest", _joined_digest(F.col("turns")))
    summed = own.select("*", *[s.alias(name) for name, s in zip(_SUMS, _place_sums(F.col("block"), F.col("digest")), strict=True)])
    totals = running_totals(summed, ["conv_id"], "block", _SUMS, most, split_above)
    return totals.select(
        "conv_id", "block", "turns", "digest",
        *[(F.col(f"cum_{s}") - F.col(s)).alias(s) for s in _SUMS],
        _node([F.col(f"cum_{s}") for s in _SUMS]).alias("node"),
    )


def trie_nodes(blocks: DataFrame, stages: Stages) -> DataFrame:
    """node, parent, depth, n_convs, conv_id and words of every node but the root.

    Conversations meet by what lies before a block and its digest, so a block that thousands
    share is one row from there on. Where all continuations of a prefix share the block its
    turns are nodes as they stand. Only where siblings differ their turns are taken apart and
    equal beginnings of the blocks are counted together.
    """
    keys = [*_SUMS, "block"]
    variants = stages.keep(
        blocks.groupBy(*keys, "digest").agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.first("turns").alias("turns"))
    )
    # A common start has a hot share of all continuations: its few rows of counts go to all shards.
    siblings = variants.groupBy(*keys).agg(F.count("*").alias("siblings")).where("siblings > 1")
    sharded = siblings.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(SHARDS - 1))))
    met = variants.withColumn("shard", F.pmod(F.hash("digest"), F.lit(SHARDS))).join(sharded, [*keys, "shard"], "left")

    def name(size: Column) -> Column:
        """The node after the first ``size`` turns of the block."""
        sums = _place_sums(F.col("block"), _joined_digest(F.slice("turns", 1, size)))
        return F.when(size == 0, _node([F.col(s) for s in _SUMS])).otherwise(_node([F.col(s) + x for s, x in zip(_SUMS, sums, strict=True)]))

    opened = met.select(*keys, "turns", "n_convs", "conv_id", "siblings", F.explode(F.sequence(F.lit(1), F.size("turns"))).alias("size"))
    last = F.element_at("turns", F.col("size"))
    named = stages.keep(
        opened.select(
            name(F.col("size")).alias("node"), name(F.col("size") - 1).alias("parent"), (last["pos"] + 1).alias("depth"),
            "n_convs", "conv_id", last["words"].alias("words"), "siblings",
        )
    )
    alone = named.where("siblings IS NULL").drop("siblings")
    merged = named.where("siblings > 1").groupBy("node").agg(
        F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.sum("n_convs").alias("n_convs"),
        F.min("conv_id").alias("conv_id"), F.first("words").alias("words"),
    )
    nodes = stages.keep(alone.unionByName(merged))
    stages.drop(variants, named)
    return nodes


def subtree_sums(nodes: DataFrame, values: DataFrame, names: list[str], stages: Stages) -> DataFrame:
    """``names`` of ``values`` (node and names) summed over the subtree of every node.

    Pointers double: after k rounds a node holds the sums of its descendants less than 2^k
    levels below, and points 2^k levels up. Rounds are the logarithm of the depth, and only
    nodes that still have such an ancestor take part. ``nodes`` has node, parent and depth.
    """
    sums = stages.keep(values.select("node", *names))
    pointers = stages.keep(nodes.where("depth > 1").select("node", F.col("parent").alias("up")))
    while pointers.limit(1).count():
        given = pointers.join(sums, "node").groupBy(F.col("up").alias("node")).agg(*[F.sum(n).alias(n) for n in names])
        more = stages.keep(sums.unionByName(given).groupBy("node").agg(*[F.sum(n).alias(n) for n in names]))
        jump = pointers.select(F.col("node").alias("up"), F.col("up").alias("next"))
        further = stages.keep(pointers.join(jump, "up").select("node", F.col("next").alias("up")))
        stages.drop(sums, pointers)
        sums, pointers = more, further
    return sums


def _member_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest per node from rows that arrive by node and span; only the running digest is held."""
    schema = pa.schema([("node", pa.binary()), ("ends_sha256", pa.string())])
    node, running = None, None
    for batch in batches:
        done: list[tuple] = []
        for own, ids in zip(batch.column("node").to_pylist(), batch.column("ids"), strict=True):
            if own != node:
                if running is not None:
                    done.append((node, running.hexdigest()))
                node, running = own, hashlib.sha256()
            else:
                running.update(b",")
            running.update(ids.as_py().encode())
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done) if done else ([], []), schema)], schema=schema)
    if running is not None:
        yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([running.hexdigest()])], schema=schema)


def member_digests(ends: DataFrame, stages: Stages, span: int = SPAN) -> DataFrame:
    """SHA-256 of the ascending, comma-joined conv_ids of every node of ``ends`` (node, conv_id, each pair once).

    Ids are first joined by spans of numbers, at most ``span`` of them a row. Nodes of one
    span are done then; the spans of the others are sorted and streamed through one running
    digest per node, which no task holds whole.
    """
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    spans = stages.keep(ends.groupBy("node", F.floor(F.col("conv_id") / span).alias("span")).agg(ids.alias("ids")))
    counts = spans.groupBy("node").agg(F.count("*").alias("n"), F.first("ids").alias("ids"))
    single = counts.where("n = 1").select("node", F.sha2("ids", 256).alias("ends_sha256"))
    many = spans.join(counts.where("n > 1").select("node"), "node")
    streamed = many.repartition("node").sortWithinPartitions("node", "span").select("node", "ids")
    return single.unionByName(streamed.mapInArrow(_member_digests, "node binary, ends_sha256 string"))


def prefix_trie(conversations: DataFrame, block: int = BLOCK, span: int = SPAN, split_above: int = SPLIT_ROWS) -> DataFrame:
    """The trie of the rebuilt conversations (``shared_starts``), one row per node.

    Columns: conv_id (smallest member), depth, parent_conv_id (null for the root), n_convs
    (members), n_children, n_leaves (childless nodes of the subtree), saved_tokens ((n_convs
    - 1) times the words of the last text, over the subtree) and ends_sha256 (conversations
    that end here).

    Every step groups or joins by key: no conversation, node or member list is gathered in
    one task. A node is named by 128 bits of summed digests of its blocks.

    Null roles and texts count as empty, null turns come first. Turns of the same number are
    ordered by role, then by digest; repeated rows are turns of their own. Rows with a null
    conv_id belong to no conversation and are left out. An empty table has no node, not even
    a root. Other columns are ignored.
    """
    stages = Stages(conversations.sparkSession)
    turns = stages.keep(turns_of(conversations, split_above))
    rebuilt, ids = shared_starts(turns)
    rebuilt = stages.keep(rebuilt)
    most = (rebuilt.agg(F.max("pos")).first()[0] or 0) // block + 1
    blocks = stages.keep(blocks_of(rebuilt, most, block, split_above))
    nodes = trie_nodes(blocks, stages)

    root = F.lit(b"")
    ended = blocks.groupBy("conv_id").agg(F.max_by("node", "block").alias("node"))
    ends = ids.join(ended, "conv_id", "left").select(F.coalesce("node", root).alias("node"), "conv_id")
    digests = stages.keep(member_digests(ends, stages, span))

    whole = ids.agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id")).where("n_convs > 0")
    top = nodes.where("depth = 1")
    children = nodes.where("depth > 1").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    counted = stages.keep(nodes.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long")))
    saved = (F.col("n_convs") - 1) * F.col("words")
    values = counted.select("node", (F.col("n_children") == 0).cast("long").alias("n_leaves"), saved.alias("saved_tokens"))
    sums = subtree_sums(nodes, values, ["n_leaves", "saved_tokens"], stages)

    smallest = whole.first()["conv_id"] if nodes.limit(1).count() else None
    up = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    below = counted.where("depth > 1").join(up, "parent")
    first = counted.where("depth = 1").withColumn("parent_conv_id", F.lit(smallest).cast("long"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    rest = below.unionByName(first).join(sums, "node").join(digests, "node", "left")
    rest = rest.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(_NO_ENDS))).select(columns)

    # The root is the one row of totals; a trie of turnless conversations has it as its only leaf.
    total = values.agg(F.sum("n_leaves").alias("n_leaves"), F.coalesce(F.sum("saved_tokens"), F.lit(0)).alias("saved_tokens"))
    root_row = (
        whole.join(F.broadcast(total)).join(F.broadcast(top.agg(F.count("*").alias("n_children"))))
        .withColumn("node", root).join(digests, "node", "left")
        .select(
            "conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", "n_children",
            F.coalesce("n_leaves", F.lit(1)).alias("n_leaves"), "saved_tokens", F.coalesce("ends_sha256", F.lit(_NO_ENDS)).alias("ends_sha256"),
        )
    )
    return root_row.unionByName(rest)
