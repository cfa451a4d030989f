"""Best-fit packing with a certificate: bins are counted against dual-feasible lower bounds."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modelwake.llm.common import Stages, text_slices
from modelwake.llm.tokens import TOKEN_SLICE, encoder

CAPACITY = 1024
END_OF_TEXT = 2
#: Pieces of one partition, on average; each partition is packed by one task.
PARTITION = 4_000
#: Denominators of the rounding functions among the lower bounds.
ROUNDINGS = range(1, 21)
#: Edges that are tried with each of them; any choice of functions gives a valid bound.
EDGES = 32

_PIECES = "uid long, doc_id long, piece int, start long, length long, ids_crc32 long"
_PLACED = f"{_PIECES}, sequence_id long, offset long, bins long, bound long, open boolean"


def weighted_bound(values: np.ndarray, counts: np.ndarray, capacity: int = CAPACITY) -> int:
    """Least number of bins that dual-feasible functions prove for sizes (1 to ``capacity``) and how often each occurs.

    A function is dual feasible if the values of any sizes that fit into one bin sum to one
    at most, so the sum over all sizes is a number of bins that no packing can undercut. Two
    families and their compositions are tried: sizes at least e count as they are, above
    capacity - e as a whole bin and below e as nothing; and sizes rounded down to a k-th of a
    bin after scaling by (k + 1) / k. Values are integers, so nothing is lost to rounding.
    """
    best = 0
    small_sizes = values[values <= capacity // 2]
    for edge in [0, *small_sizes.tolist()]:
        x = np.where(values > capacity - edge, capacity, np.where(values < edge, 0, values))
        best = max(best, -(-int(x @ counts) // capacity))
    for k in ROUNDINGS:
        for edge in [0, *small_sizes[:: max(1, len(small_sizes) // EDGES)].tolist()]:
            x = np.where(values > capacity - edge, capacity, np.where(values < edge, 0, values))
            scaled = x * (k + 1)
            y = np.where(scaled % capacity == 0, x * k, scaled // capacity * capacity)
            best = max(best, -(-int(y @ counts) // (k * capacity)))
    return best


def lower_bound(sizes: np.ndarray, capacity: int = CAPACITY) -> int:
    """``weighted_bound`` of single sizes."""
    values, counts = np.unique(np.asarray(sizes, dtype=np.int64), return_counts=True)
    return weighted_bound(values, counts, capacity)


def best_fit(sizes: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best fit of ``sizes`` in the given, decreasing order: bin and offset of every size, fill of every bin."""
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    fill: list[int] = []
    # Open bins by the room they have; bit r of ``rooms`` is set while one has room r.
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0
    for i, size in enumerate(sizes.tolist()):
        fitting = rooms >> size
        if fitting:
            room = size + ((fitting & -fitting).bit_length() - 1)
            number = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            number, room = len(fill), capacity
            fill.append(0)
        bins[i], offsets[i] = number, fill[number]
        fill[number] += size
        if room > size:
            by_room[room - size].append(number)
            rooms |= 1 << (room - size)
    return bins, offsets, np.asarray(fill, dtype=np.int64)


def _pieces(path: str, capacity: int, end_id: int, with_ids: bool):
    end = np.asarray([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, number = encoder(path), TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in text_slices(batch, size=TOKEN_SLICE):
                columns: list[list] = [[] for _ in range(7)]
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), tokens.encode_column(part.column("text")), strict=True):
                    ids += end
                    n = len(ids) // 4
                    # Only the first piece may be shorter than a sequence.
                    at, size = 0, (n - 1) % capacity + 1
                    for piece in range(-(-n // capacity)):
                        own = ids[4 * at : 4 * (at + size)]
                        for column, value in zip(columns, (number, doc_id, piece, at, size, zlib.crc32(own), own), strict=True):
                            column.append(value)
                        at, size, number = at + size, capacity, number + 1
                arrays = [pa.array(c, pa.int64()) for c in columns[:6]]
                arrays[2] = arrays[2].cast(pa.int32())
                names = ["uid", "doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    arrays, names = [*arrays, pa.array(columns[6], pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return run


def _packed(capacity: int, turn: int):
    columns = [c.split()[0] for c in _PLACED.split(", ")]

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        # Ties by uid: a repeated task packs alike.
        rows = rows.sort_values(["length", "uid"], ascending=[False, True], ignore_index=True)
        bins, rows["offset"], fill = best_fit(rows["length"].to_numpy(), capacity)
        bound = lower_bound(rows["length"].to_numpy(), capacity)
        rows["bins"], rows["bound"] = len(fill), bound
        rows["sequence_id"] = (turn << 56) + (int(key[0]) << 20) + bins
        if len(fill) > bound:
            # A gap: everything but full sequences is exchanged.
            loose = fill < capacity
        else:
            # Certified: only the emptiest sequence can still be shared with other partitions.
            loose = np.zeros(len(fill), dtype=bool)
            loose[np.argmin(fill)] = fill.min() < capacity
        rows["open"] = loose[bins]
        return rows[columns]

    return run


def best_fit_pieces(
    docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_OF_TEXT, per_partition: int = PARTITION, with_ids: bool = False
) -> DataFrame:
    """Documents packed into as few sequences of at most ``capacity`` tokens as can be found.

    One row per piece: doc_id, piece, start (ids of its document before it), length,
    ids_crc32, sequence_id, offset; with ``with_ids`` also ids, little-endian unsigned
    32-bit. Every document is its token ids and then ``end_id``. Longer documents are cut
    into full pieces, each a sequence of its own, and a first piece with what is left over.

    Pieces are dealt at random into partitions of about ``per_partition`` and each is packed
    by best fit in decreasing order. Its number of sequences is held against the lower bound
    of ``lower_bound``: where both agree no better packing of the partition exists. Partitions
    with a gap give all sequences that are not full, certified ones the emptiest, and the
    pieces of these are dealt anew and packed again. Rounds go on while they save sequences,
    so they end by themselves; a round that saves nothing is not used. Every round is stored,
    so a lost executor repeats one partition of one round, and draws repeat by uid.

    Null or empty texts are one token. Repeated rows are packed as often as they come; a
    null doc_id is packed as well. An empty table gives no pieces. Other columns are ignored.
    """
    stages = Stages(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = _PIECES + (", ids binary" if with_ids else "")
    pieces = stages.keep(texts.mapInArrow(_pieces(tokenizer_path, capacity, end_id, with_ids), schema))
    narrow = pieces.drop("ids")
    full = narrow.where(F.col("length") == capacity)
    names = [c.split()[0] for c in _PIECES.split(", ")] + ["sequence_id", "offset"]
    done = [full.select("*", (-1 - F.col("uid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]

    def packed(rows: DataFrame, count: int, turn: int) -> DataFrame:
        parts = max(1, -(-count // per_partition))
        dealt = rows.withColumn("part", F.pmod(F.xxhash64("uid", F.lit(turn)), F.lit(parts)))
        return stages.keep(dealt.groupBy("part").applyInPandas(_packed(capacity, turn), _PLACED))

    def left(rows: DataFrame) -> tuple[int, int]:
        """Pieces that are exchanged, and the sequences they come from."""
        per_bin = rows.where("open").groupBy("sequence_id").agg(F.count("*").alias("n"))
        return tuple(x or 0 for x in per_bin.agg(F.sum("n"), F.count("*")).first())

    first = narrow.where(F.col("length") < capacity)
    turn, now = 0, packed(first, first.count(), 0)
    count, bins = left(now)
    while bins > 1:
        turn += 1
        after = packed(now.where("open").select(*first.columns), count, turn)
        if after.select("sequence_id").distinct().count() >= bins:
            stages.drop(after)
            break
        done.append(now.where("NOT open").select(*names))
        now = after
        count, bins = left(now)
    placed = now.select(*names)
    for rows in done:
        placed = placed.unionByName(rows)
    if with_ids:
        placed = placed.join(pieces.select("uid", "ids"), "uid")
    return placed.drop("uid")


def certificate(pieces: DataFrame, capacity: int = CAPACITY) -> tuple[int, int]:
    """Sequences of a packing, and the least number that any packing of its pieces needs.

    The bound of the whole table needs only the number of pieces of each length, at most
    ``capacity`` rows.
    """
    lengths = pieces.groupBy("length").agg(F.count("*").alias("n")).collect()
    values = np.asarray([r.length for r in lengths], dtype=np.int64)
    counts = np.asarray([r.n for r in lengths], dtype=np.int64)
    return pieces.select("sequence_id").distinct().count(), weighted_bound(values, counts, capacity)
