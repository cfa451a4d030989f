"""Repeated passages by a sparse suffix array over minimiser positions."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from modelwake.llm.common import Stages, hashed_words, small, text_slices, windows_hash

#: Words of the shortest passage that counts.
PASSAGE = 50
#: Words of a minimiser, and the number of neighbouring ones of which the smallest is selected.
GRAM, NEIGHBOURS = 8, 30
#: Words in which suffixes must agree to count as matched. In a passage of PASSAGE words the
#: first selected position lies among the first NEIGHBOURS ones, so this many words follow it inside.
PREFIX = PASSAGE - NEIGHBOURS + 1
#: Bytes of text places that may be broadcast; beyond, texts and places shuffle.
PLACES_BYTES = 64_000_000
#: A match is one number: its place times this, plus the common words (PASSAGE at most).
_PLACE = 1 << PASSAGE.bit_length()

_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """Minimum or maximum of every run of ``width`` values, by doubling."""
    have = 1
    while have < width:
        step = min(have, width - have)
        values = pick(values[: len(values) - step], values[step:])
        have += step
    return values


def minimisers(words: np.ndarray) -> np.ndarray:
    """Positions whose GRAM-word hash is the smallest of some NEIGHBOURS neighbouring ones.

    The choice depends on the words around alone, so equal passages select equal positions.
    """
    grams = windows_hash(words, GRAM)
    if len(grams) < NEIGHBOURS:
        return np.empty(0, dtype=np.int64)
    smallest = _sliding(grams, NEIGHBOURS, np.minimum)
    zeros = np.zeros(NEIGHBOURS - 1, dtype=np.uint64)
    largest = _sliding(np.concatenate([zeros, smallest, zeros]), NEIGHBOURS, np.maximum)
    return np.flatnonzero(largest == grams)


def hashes_at(words: np.ndarray, places: np.ndarray, length: int) -> np.ndarray:
    out = np.zeros(len(places), dtype=np.uint64)
    for i in range(length):
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + words[places + i]
    return out.view(np.int64)


def sort_keys(words: np.ndarray, places: np.ndarray) -> np.ndarray:
    """A row of PASSAGE bytes per place: one byte of the hash of each word from there on, zeros past the end.

    The order of these rows is the lexicographic one over bytes for words: suffixes that
    agree in k words agree in k bytes. Words of one byte by chance only lengthen a match.
    """
    letters = np.concatenate([(words >> np.uint64(56)).astype(np.uint8), np.zeros(PASSAGE, dtype=np.uint8)])
    return np.lib.stride_tricks.sliding_window_view(letters, PASSAGE)[places]


def _binary(rows: np.ndarray) -> pa.Array:
    ends = np.arange(len(rows) + 1, dtype=np.int32) * PASSAGE
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(rows))])


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows in text_slices(batch):
            owner, places, keys = [], [], []
            for i, words in enumerate(hashed_words(rows.column("text").to_pylist())):
                if len(words) >= PASSAGE:
                    at = minimisers(words)
                    at = at[at + PREFIX <= len(words)]
                    owner.append(np.full(len(at), i))
                    places.append(at)
                    keys.append(sort_keys(words, at))
            if owner:
                of = pa.array(np.concatenate(owner))
                yield pa.RecordBatch.from_arrays(
                    [_binary(np.concatenate(keys)), rows.column("doc_id").take(of), rows.column("h").take(of), pa.array(np.concatenate(places).astype(np.int32))],
                    names=["suffix", "doc_id", "h", "place"],
                )


_SORTED = "suffix binary, doc_id long, h long, place int, part int, edge boolean, common int"


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted suffixes with ``common``, the words shared with the nearer one of both neighbours.

    Equal rows are one. The first and the last row of the partition are its edges. One row
    waits for its successor, so a batch never needs the next one.
    """
    part = TaskContext.get().partitionId()
    waiting, before, first = None, 0, True
    for batch in batches:
        rows = pa.Table.from_batches([batch.select(["suffix", "doc_id", "h", "place"])])
        rows = pa.concat_tables([waiting, rows]).combine_chunks() if waiting is not None else rows
        keys = np.frombuffer(b"".join(rows.column("suffix").to_pylist()), dtype=np.uint8).reshape(-1, PASSAGE)
        same = np.ones(max(0, len(keys) - 1), dtype=bool)
        for name in ("doc_id", "h", "place"):
            values = rows.column(name).to_numpy()
            same &= values[1:] == values[:-1]
        distinct = np.flatnonzero(np.concatenate([[True], ~same])) if len(keys) else np.empty(0, dtype=np.int64)
        if not len(distinct):
            continue
        rows, keys = rows.take(pa.array(distinct)), keys[distinct]
        differ = keys[1:] != keys[:-1]
        shared = np.where(differ.any(axis=1), differ.argmax(axis=1), PASSAGE).astype(np.int32)
        if len(shared):
            common = np.maximum(np.concatenate([[before], shared[:-1]]), shared)
            yield from _marked(rows.slice(0, len(shared)), common, part, first, False)
            first, before = False, int(shared[-1])
        waiting = rows.slice(len(rows) - 1)
    if waiting is not None:
        yield from _marked(waiting, np.asarray([before]), part, True, True)


def _marked(rows: pa.Table, common: np.ndarray, part: int, first: bool, last: bool) -> Iterator[pa.RecordBatch]:
    """Rows that are matched, and the edges of the partition; only edges still need their key."""
    edge = np.zeros(len(rows), dtype=bool)
    edge[0] |= first
    edge[-1] |= last
    wanted = pa.array(np.flatnonzero(edge | (common >= PREFIX)))
    keys = pc.if_else(pa.array(edge), rows.column("suffix").combine_chunks(), pa.scalar(None, pa.binary()))
    columns = [keys, *(rows.column(n).combine_chunks() for n in ("doc_id", "h", "place"))]
    columns += [pa.array(np.full(len(rows), part, dtype=np.int32)), pa.array(edge), pa.array(common.astype(np.int32))]
    yield pa.RecordBatch.from_arrays(columns, names=["suffix", "doc_id", "h", "place", "part", "edge", "common"]).take(wanted)


def matched_suffixes(suffixes: DataFrame, stages: Stages) -> DataFrame:
    """doc_id, h, place and common of the suffixes that share PREFIX words or more with another place.

    The suffixes are sorted over ranges of (key, place), so the copies of one frequent
    suffix spread over as many ranges as they fill. In sorted order the suffix that shares
    most words with a given one is next to it. Across two ranges only their edges meet:
    two rows per range, compared by the same function.
    """
    order = ["suffix", "doc_id", "h", "place"]
    ranged = suffixes.repartitionByRange(*order).sortWithinPartitions(*order)
    compared = stages.keep(ranged.mapInArrow(_compared, _SORTED))
    edges = compared.where("edge").select("part", *order).coalesce(1).sortWithinPartitions("part", *order)
    across = edges.mapInArrow(_compared, _SORTED)
    found = compared.where("NOT edge").unionByName(across.unionByName(compared.where("edge")))
    best = stages.keep(found.where(F.col("common") >= PREFIX).groupBy("doc_id", "h", "place").agg(F.max("common").alias("common")))
    stages.drop(compared)
    return best


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The passages of PASSAGE words that a match can fill: ``common`` words to the right, the rest to the left."""
    for batch in batches:
        for rows in text_slices(batch):
            texts = rows.column("text").to_pylist()
            for i, words in enumerate(hashed_words(texts)):
                wanted = np.zeros(len(words) - PASSAGE + 1, dtype=bool)
                for match in rows.column("places")[i].as_py():
                    place, common = divmod(match, _PLACE)
                    wanted[max(0, place - NEIGHBOURS + 1) : max(0, place + common - PASSAGE + 1)] = True
                starts = np.flatnonzero(wanted)
                spans = np.asarray([m.span() for m in _WORD.finditer(texts[i])], dtype=np.int32).reshape(-1, 2)
                of = pa.array(np.full(len(starts), i))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(hashes_at(words, starts, PASSAGE)), rows.column("doc_id").take(of), rows.column("h").take(of),
                        pa.array(starts.astype(np.int32)), pa.array(spans[starts, 0]), pa.array(spans[starts + PASSAGE - 1, 1]),
                    ],
                    names=["passage", "doc_id", "h", "word", "start", "end"],
                )


def _repeated(rows: DataFrame, key: str, place: str) -> DataFrame:
    """Keys that occur at more than one place, and the smallest doc_id with each.

    Equal rows of the input are one place. Aggregation starts on the map side.
    """
    at = F.xxhash64("doc_id", "h", place)
    found = rows.groupBy(key).agg(F.min(at).alias("lo"), F.max(at).alias("hi"), F.min("doc_id").alias("first_id"))
    return found.where("lo <> hi").select(key, "first_id")


def repeated_passages(docs: DataFrame) -> DataFrame:
    """Passages of PASSAGE words or more that occur more than once.

    One row per passage and place: doc_id, start, end (code points, end exclusive), n_words
    and first. Touching places are one row; words are compared in lower case (A-Z), white
    space does not matter. ``first`` tells whether this document is the one with the
    smallest doc_id among those that hold it, where it would be kept.

    Suffixes are retained at minimiser positions, sorted, and compared with their
    neighbours. A match of k words is extended by PASSAGE - k words to the left or more:
    the passages that result are compared whole, by hash, with those of all other matches,
    because the neighbour in sorted order need not be the place that agrees furthest to
    the left. So every repeat is found, whichever pair of places it comes from. Nothing is
    gathered per suffix or passage, only sums.

    A text that others copy whole is searched once; its copies are one passage each. Rows
    that repeat doc_id and text are one document; rows without doc_id, and texts that are
    null or shorter than PASSAGE words, have no passages. An empty table gives no rows.
    Other columns are ignored.
    """
    stages = Stages(docs.sparkSession)
    known = docs.where("doc_id IS NOT NULL AND text IS NOT NULL")
    texts = known.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text", F.lit(7)).alias("h"), "text")
    facts = stages.keep(
        texts.select("doc_id", "h", F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("n"), F.char_length("text").alias("size"))
    )
    groups = facts.where(F.col("n") >= PASSAGE).groupBy("h").agg(F.min("doc_id").alias("head"), F.max("doc_id").alias("last"))
    copies = stages.keep(facts.join(groups.where("head <> last"), "h").select("doc_id", "h", "n", "size", (F.col("doc_id") == F.col("head")).alias("first")))
    others = stages.keep(copies.where("NOT first").select("doc_id", "h"))
    single = texts.join(small(others, others.count()), ["doc_id", "h"], "left_anti")

    suffixes = stages.keep(single.mapInArrow(_suffixes, "suffix binary, doc_id long, h long, place int"))
    matched = matched_suffixes(suffixes, stages)
    places = stages.keep(matched.groupBy("doc_id", "h").agg(F.collect_list(F.col("place").cast("long") * _PLACE + F.col("common")).alias("places")))
    stages.drop(suffixes, matched)
    # Eight bytes a match, and the fixed part of a row with two keys and an array.
    size = places.agg(F.count("*"), F.coalesce(F.sum(8 * F.size("places") + 64), F.lit(0))).first()
    searched = single.join(small(places, size[0]) if size[1] <= PLACES_BYTES else places, ["doc_id", "h"])
    passage = "passage long, doc_id long, h long, word int, start int, end int"
    windows = stages.keep(searched.mapInArrow(_windows, passage))
    stages.drop(places)
    # Stored, so that both sides shuffle for the join alone and a frequent passage can be split.
    recurring = stages.keep(_repeated(windows, "passage", "word"))
    repeats = windows.join(recurring, "passage")
    # Islands of touching passages: a new one starts behind a gap in the text.
    marks = repeats.select("doc_id", "h", "word", "start", "end", (F.col("doc_id") == F.col("first_id")).alias("first")).distinct()
    text = Window.partitionBy("doc_id", "h", "first").orderBy("word")
    gap = F.coalesce(F.col("word") - F.lag("word").over(text) > PASSAGE, F.lit(True))
    numbered = marks.withColumn("gap", gap.cast("int")).withColumn("island", F.sum("gap").over(text))
    found = (
        numbered.groupBy("doc_id", "h", "first", "island")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"), (F.max("word") - F.min("word") + PASSAGE).cast("long").alias("n_words"))
        .select("doc_id", "start", "end", "n_words", "first")
    )
    whole = copies.distinct().select("doc_id", F.lit(0).alias("start"), F.col("size").alias("end"), F.col("n").alias("n_words"), "first")
    return found.unionByName(whole)
