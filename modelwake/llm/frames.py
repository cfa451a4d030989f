"""Fill-in-the-middle texts from seekable compressed frames."""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modelwake.llm.common import Stages, text_slices

#: Code points of one frame.
FRAME = 32_768
LEVEL = 3

# Fixed values of the output format.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Percent of the texts that are rearranged, and of these that start with the suffix.
REARRANGED, SUFFIX_FIRST = 90, 20

_FRAMES = "units array<long>, ends array<long>, frames binary"
_STORED = f"doc_id long, n long, marked boolean, {_FRAMES}"
_MOVED = f"doc_id long, n long, form string, prefix_chars long, middle_chars long, {_FRAMES}"


class Frames:
    """A text as independent zstandard frames, one after the other, with a table to seek in.

    ``units`` has the code points and ``ends`` the compressed bytes up to the end of every
    frame. Any frame can be read without the others, and all of them together are a valid
    zstandard stream of the whole text.
    """

    def __init__(self, data: bytes = b"", units: list[int] | None = None, ends: list[int] | None = None):
        self.parts = [data] if data else []
        self.units, self.ends = list(units or []), list(ends or [])
        self._pack, self._unpack = zstandard.ZstdCompressor(level=LEVEL), zstandard.ZstdDecompressor()

    @classmethod
    def of(cls, text: str, size: int = FRAME) -> "Frames":
        own = cls()
        for at in range(0, len(text), size):
            own.add(text[at : at + size])
        return own

    @property
    def data(self) -> bytes:
        if len(self.parts) > 1:
            self.parts = [b"".join(self.parts)]
        return self.parts[0] if self.parts else b""

    def add(self, text: str) -> None:
        if text:
            self.add_packed(self._pack.compress(text.encode()), len(text))

    def add_packed(self, frame: bytes, units: int) -> None:
        self.parts.append(frame)
        self.units.append((self.units[-1] if self.units else 0) + units)
        self.ends.append((self.ends[-1] if self.ends else 0) + len(frame))

    def packed(self, i: int) -> bytes:
        return self.data[self.ends[i - 1] if i else 0 : self.ends[i]]

    def unpacked(self, i: int) -> bytes:
        return self._unpack.decompress(self.packed(i))

    def copy_range(self, start: int, end: int, into: "Frames") -> None:
        """Append code points ``start`` to ``end``: whole frames as they are, only cut frames are decompressed."""
        i = bisect_right(self.units, start)
        while start < end:
            low, high = self.units[i - 1] if i else 0, self.units[i]
            if low == start and high <= end:
                into.add_packed(self.packed(i), high - low)
            else:
                into.add(self.unpacked(i).decode()[start - low : min(end, high) - low])
            start, i = high, i + 1


def rearranged(stored: Frames, form: str, first: int, second: int) -> Frames:
    """The output of a text that is cut after ``first`` and ``second`` code points, as frames."""
    if form == "plain":
        return stored
    prefix, middle, suffix = (PREFIX, 0, first), (MIDDLE, first, second), (SUFFIX, second, stored.units[-1])
    out = Frames()
    for mark, start, end in (prefix, suffix, middle) if form == "psm" else (suffix, prefix, middle):
        out.add(mark)
        stored.copy_range(start, end, out)
    return out


def digests(output: Frames, form: str) -> tuple[str, str]:
    """SHA-256 of an output and of the text rebuilt from that output and its form, frame by frame.

    The first pass hashes the ordered frames and finds the marks; the second one seeks the
    parts between them in the order of the text.
    """
    count = len(output.ends)
    marks = [] if form == "plain" else [m.encode() for m in ((PREFIX, SUFFIX, MIDDLE) if form == "psm" else (SUFFIX, PREFIX, MIDDLE))]
    whole, places, tail, at, sizes = hashlib.sha256(), [], b"", 0, []
    for i in range(count):
        data = output.unpacked(i)
        whole.update(data)
        window, low = tail + data, at - len(tail)
        found = window.find(marks[len(places)]) if len(places) < len(marks) else -1
        while found >= 0:
            places.append(low + found)
            found = window.find(marks[len(places)], found + 3) if len(places) < len(marks) else -1
        at += len(data)
        sizes.append(at)
        # A mark may begin in the last two bytes of a frame.
        tail = window[-2:]
    if form == "plain":
        return whole.hexdigest(), whole.hexdigest()
    ends = [*places[1:], at]
    part = {mark: (place + 3, end) for mark, place, end in zip(marks, places, ends, strict=True)}
    rebuilt = hashlib.sha256()
    for mark in (PREFIX, MIDDLE, SUFFIX):
        start, end = part[mark.encode()]
        i = bisect_right(sizes, start)
        while start < end:
            low = sizes[i - 1] if i else 0
            rebuilt.update(output.unpacked(i)[start - low : end - low])
            start, i = sizes[i], i + 1
    return whole.hexdigest(), rebuilt.hexdigest()


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


_FRAME_FIELDS = [("units", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("frames", pa.binary())]


def _store(size: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("marked", pa.bool_()), *_FRAME_FIELDS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                rows = []
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text"), strict=True):
                    text = text.as_py() or ""
                    own = Frames.of(text, size)
                    marked = any(m in text for m in (PREFIX, SUFFIX, MIDDLE))
                    rows.append((doc_id, len(text), marked, own.units, own.ends, own.data))
                yield _batch(rows, schema)

    return run


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Rows of Arrow batches, about a slice of compressed bytes at a time."""
    for batch in batches:
        for part in text_slices(batch, "frames"):
            yield part.to_pylist()


def _move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64())]
    schema = pa.schema([*names, *_FRAME_FIELDS])
    for rows in _rows(batches):
        out = []
        for r in rows:
            first = r["prefix_chars"] or 0
            moved = rearranged(Frames(r["frames"], r["units"], r["ends"]), r["form"], first, first + (r["middle_chars"] or 0))
            out.append((*(r[name] for name, _ in names), moved.units, moved.ends, moved.data))
        yield _batch(out, schema)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64())]
    schema = pa.schema([*names, ("output_sha256", pa.string()), ("restored_sha256", pa.string())])
    for rows in _rows(batches):
        yield _batch([(*(r[name] for name, _ in names), *digests(Frames(r["frames"], r["units"], r["ends"]), r["form"])) for r in rows], schema)


def _text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("form", pa.string()), ("output", pa.string())])
    for rows in _rows(batches):
        for r in rows:
            own = Frames(r["frames"], r["units"], r["ends"])
            text = b"".join(own.unpacked(i) for i in range(len(own.ends))).decode()
            yield _batch([(r["doc_id"], r["form"], text)], schema)


def _draws(doc_id: Column) -> list[Column]:
    """Four unsigned numbers that depend on the id alone."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(docs: DataFrame, frame: int = FRAME) -> DataFrame:
    """Every document rearranged for filling in its middle, as seekable frames.

    One row per row of ``docs``: doc_id, n (code points), form (plain, psm or spm),
    prefix_chars, middle_chars (null if plain), and the output: units, ends and frames as in
    ``Frames``. Cuts and form come from a hash of doc_id, so retries and repeated rows agree.

    Texts are first stored as frames of ``frame`` code points; only their counts are needed to
    choose the cuts. A cut decompresses the frame that it falls into, and all other frames
    move as they are. A task holds one document's compressed frames and one open frame; the
    stored table ends the lineage, so lost executors repeat the cheap second step only.

    Null or empty texts are plain and have no frame. Texts that contain a mark are plain. A
    null doc_id is drawn like an empty number. An empty table gives no rows. Other columns
    are ignored.
    """
    stages = Stages(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    stored = stages.keep(texts.mapInArrow(_store(frame), _STORED))
    h1, h2, h3, h4 = _draws(F.col("doc_id"))
    places = F.col("n") + 1
    first, second = F.least(h1 % places, h2 % places), F.greatest(h1 % places, h2 % places)
    plain = (F.col("n") == 0) | F.col("marked") | (h3 % 100 >= REARRANGED)
    form = F.when(plain, "plain").when(h4 % 100 < SUFFIX_FIRST, "spm").otherwise("psm")
    chosen = stored.withColumn("form", form).select(
        "doc_id", "n", "form",
        F.when(F.col("form") != "plain", first).alias("prefix_chars"),
        F.when(F.col("form") != "plain", second - first).alias("middle_chars"),
        "units", "ends", "frames",
    )
    return chosen.mapInArrow(_move, _MOVED)


def output_digests(moved: DataFrame) -> DataFrame:
    """Digests of outputs and of the texts rebuilt from them, streamed frame by frame."""
    schema = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"
    return moved.mapInArrow(_digest, schema)


def output_texts(moved: DataFrame) -> DataFrame:
    """doc_id, form and output: the rearranged texts themselves."""
    return moved.mapInArrow(_text, "doc_id long, form string, output string")
