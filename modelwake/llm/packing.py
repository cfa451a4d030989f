"""Packing documents into token sequences: concatenate all, cut at fixed places."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modelwake.llm.common import Stages, small, text_slices
from modelwake.llm.tokens import TOKEN_SLICE, Encoder, encoder  # noqa: F401

SEQUENCE = 2048
END_OF_TEXT = 1


def _encoded(path: str):
    end = np.asarray([END_OF_TEXT], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, part = encoder(path), TaskContext.get().partitionId()
        before = 0
        for batch in batches:
            for rows in text_slices(batch, size=TOKEN_SLICE):
                ids = [b + end for b in tokens.encode_column(rows.column("text"))]
                counts = np.asarray([len(b) // 4 for b in ids], dtype=np.int64)
                starts = before + np.cumsum(counts) - counts
                before += int(counts.sum())
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column("doc_id").cast(pa.int64()), pa.array([part] * len(ids), pa.int32()), pa.array(starts),
                        pa.array(counts), pa.array(ids, pa.binary()),
                    ],
                    names=["doc_id", "part", "before", "doc_tokens", "ids"],
                )

    return run


def packed_pieces(docs: DataFrame, tokenizer_path: str, length: int = SEQUENCE, with_ids: bool = False) -> DataFrame:
    """Cut the concatenation of all documents into sequences of ``length`` tokens.

    One row per piece: doc_id, start (ids of its document before it), length, ids_crc32,
    doc_tokens, sequence_id, offset; with ``with_ids`` also ids, little-endian unsigned
    32-bit. Every document is its token ids and then id 1. All sequences are full but the
    last one. The order of documents is that of the input files.

    The first pass encodes every document once, counts the tokens before it inside its
    partition and stores both. The second adds the tokens of all partitions before it, one
    row per partition, which gives the global offset of every document; a document that
    crosses a border of sequences gets a piece, the boundary record, on either side.
    A lost executor repeats the first pass for its partitions before the table is stored;
    the stored table then fixes all offsets.

    Null or empty texts are one token. Repeated rows are packed as often as they come; a
    null doc_id is packed as well. An empty table gives no pieces. Other columns are ignored.
    """
    stages = Stages(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, part int, before long, doc_tokens long, ids binary"
    encoded = stages.keep(texts.mapInArrow(_encoded(tokenizer_path), schema))
    totals = encoded.groupBy("part").agg(F.sum("doc_tokens").alias("tokens"))
    # One row per partition of the input, so a window without partitioning stays small.
    offsets = stages.keep(
        totals.selectExpr("part", "sum(tokens) OVER (ORDER BY part) - tokens AS base")
    )
    at = F.col("base") + F.col("before")
    placed = encoded.join(small(offsets, offsets.count()), "part").withColumn("at", at)
    end = F.col("at") + F.col("doc_tokens")
    cut = F.lit(length)

    def piece(sequence):
        start = F.greatest(F.col("at"), sequence * cut)
        size = F.least(end, (sequence + 1) * cut) - start
        ids = F.substring("ids", ((start - F.col("at")) * 4 + 1).cast("int"), (size * 4).cast("int"))
        return F.struct(
            (start - F.col("at")).alias("start"),
            size.alias("length"),
            F.crc32(ids).alias("ids_crc32"),
            sequence.alias("sequence_id"),
            (start - sequence * cut).alias("offset"),
            *([ids.alias("ids")] if with_ids else []),
        )

    sequences = F.sequence(F.expr(f"at div {length}"), F.expr(f"(at + doc_tokens - 1) div {length}"))
    pieces = placed.select("doc_id", "doc_tokens", F.explode(F.transform(sequences, piece)).alias("p"))
    columns = ["start", "length", "ids_crc32", "sequence_id", "offset"] + (["ids"] if with_ids else [])
    return pieces.select("doc_id", "doc_tokens", *[F.col(f"p.{c}") for c in columns])


def sequences(pieces: DataFrame) -> DataFrame:
    """The packed sequences themselves: sequence_id and ids, from pieces made ``with_ids``.

    A sequence gathers at most its own length of tokens.
    """
    ordered = F.array_sort(F.collect_list(F.struct("offset", F.hex("ids").alias("ids"))))
    joined = F.unhex(F.array_join(F.transform(ordered, lambda p: p["ids"]), ""))
    return pieces.groupBy("sequence_id").agg(joined.alias("ids"))
