"""Single files put together from the ordered parts that Spark tasks write.

Rows are sorted by range and written by many tasks; the parts then follow one another in a single
file. The driver copies them as a stream of bytes and never holds more than a buffer; rows are
neither collected nor gathered in one task. The file appears under its name when it is complete.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from martwright.operators.workdir import new_folder

BUFFER_BYTES = 1 << 22


def _hadoop(spark: SparkSession):
    return spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()


def write_lines(lines: DataFrame) -> str:
    """A sorted one-column frame as text parts in the work folder; returns their folder."""
    folder = new_folder(lines.sparkSession, "parts")
    lines.write.text(folder)
    return folder


def parts_of(spark: SparkSession, folder: str) -> list[str]:
    """The parts that hold something, in the order of the rows."""
    files, conf = _hadoop(spark)
    place = files.Path(folder)
    found = [
        (s.getPath().getName(), s.getPath().toString())
        for s in place.getFileSystem(conf).listStatus(place)
        if s.isFile() and s.getLen() > 0 and s.getPath().getName().startswith("part-")
    ]
    return [path for _, path in sorted(found)]


def join_parts(spark: SparkSession, target: str, pieces: Iterable[str | bytes | tuple[str, int]]
               ) -> None:
    """Write ``target`` from texts (bytes) and files (paths, or a path and a number of bytes to
    leave out at its start), one after the other; a file already there is replaced."""
    files, conf = _hadoop(spark)
    place = files.Path(target)
    disk = place.getFileSystem(conf)
    draft = files.Path(place.getParent(), f".{place.getName()}.{uuid.uuid4().hex}")
    copy = spark.sparkContext._jvm.org.apache.hadoop.io.IOUtils.copyBytes
    out = disk.create(draft, True)
    try:
        for piece in pieces:
            if isinstance(piece, bytes):
                out.write(piece)
                continue
            path, skipped = (piece, 0) if isinstance(piece, str) else piece
            source = files.Path(path)
            stream = source.getFileSystem(conf).open(source)
            try:
                stream.seek(skipped)
                copy(stream, out, BUFFER_BYTES, False)
            finally:
                stream.close()
    finally:
        out.close()
    if disk.exists(place):
        disk.delete(place, True)
    if not disk.rename(draft, place):
        raise OSError(f"could not put {target} in place")


def remove_folder(spark: SparkSession, folder: str) -> None:
    files, conf = _hadoop(spark)
    place = files.Path(folder)
    place.getFileSystem(conf).delete(place, True)
