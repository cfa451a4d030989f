"""Tables that are replaced as a whole: every version has its folder, a small file names the valid one."""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

POINTER = "_current.json"
#: Versions that stay after a replacement: the valid one, and the one that readers may still have open.
KEPT = 2


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _files(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def read_text(spark: SparkSession, path: str) -> str | None:
    """The text of a small file, or None where there is none."""
    files, where = _files(spark, path), _path(spark, path)
    if not files.exists(where):
        return None
    stream = files.open(where)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def holds_files(spark: SparkSession, path: str) -> bool:
    """Whether the folder exists and has anything in it."""
    files, where = _files(spark, path), _path(spark, path)
    return files.exists(where) and len(files.listStatus(where)) > 0


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Replace a small file at one stroke: readers see the old text or the new one, never a part."""
    draft = f"{path.rsplit('/', 1)[0]}/_draft-{uuid.uuid4().hex}"
    files = _files(spark, path)
    stream = files.create(_path(spark, draft), True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    qualified = files.makeQualified(_path(spark, path))
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(qualified.toUri(), spark._jsc.hadoopConfiguration())
    rename = getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    context.rename(files.makeQualified(_path(spark, draft)), qualified, options)


@dataclass(frozen=True)
class Version:
    """One version of a table and the notes that were published with it."""

    folder: str
    schema: str
    notes: dict
    older: tuple[str, ...]

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(self.schema).parquet(self.folder)


def current(spark: SparkSession, root: str) -> Version | None:
    """The valid version below ``root``, or None before the first one is complete."""
    text = read_text(spark, f"{root}/{POINTER}")
    if text is None:
        return None
    saved = json.loads(text)
    return Version(f"{root}/{saved['folder']}", saved["schema"], saved["notes"], tuple(saved["older"]))


def publish(df: DataFrame, root: str, notes: Mapping[str, object] | None = None, partition_by: Sequence[str] = ()) -> Version:
    """Make ``df`` the valid version below ``root``.

    The rows go to a folder of their own; only then the pointer moves, so a writer that dies
    leaves the old version valid. ``df`` may be read from the version it replaces. The
    version before stays for readers that have it open; older ones are deleted. One writer
    at a time: of two, the last pointer wins.
    """
    spark = df.sparkSession
    before = current(spark, root)
    name = f"version-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(f"{root}/{name}")
    older = [] if before is None else [before.folder.rsplit("/", 1)[1], *before.older]
    # Partition columns come last when the folder is read.
    fields = [f for f in df.schema.fields if f.name not in partition_by] + [df.schema[c] for c in partition_by]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    saved = {"folder": name, "schema": schema, "notes": dict(notes or {}), "older": older[: KEPT - 1]}
    write_text(spark, f"{root}/{POINTER}", json.dumps(saved))
    for gone in older[KEPT - 1 :]:
        _files(spark, root).delete(_path(spark, f"{root}/{gone}"), True)
    return Version(f"{root}/{name}", schema, saved["notes"], tuple(saved["older"]))
