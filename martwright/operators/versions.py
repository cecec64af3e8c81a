"""A table folder whose parts are replaced all at once: readers see one version or the next.

New parts are written under names of their own. A small numbered file, the manifest, then names the
parts that make up the table; it appears under its number by one rename that does not overwrite, so
of two writers that start from the same version one fails and can try again. A reader resolves the
manifest once and keeps these files, which nobody changes; a write that stops half way leaves files
that no manifest names. ``vacuum`` removes what has been out of use for long enough.

The file system must rename atomically, as HDFS and local disks do.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import cached_property

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

MANIFESTS = "_manifest"


class Conflict(RuntimeError):
    """Another writer has published a version in between."""


@dataclass(frozen=True)
class Version:
    """``parts``: the folder of each part, below the table's folder."""

    number: int = 0
    parts: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class VersionedFolder:
    spark: SparkSession
    path: str
    part_by: str  # partition column; a part is one of its values

    # --- file system, driver side: names only --------------------------------------------

    @cached_property
    def _jvm(self):
        return self.spark.sparkContext._jvm

    def _at(self, *names: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *names]))

    @cached_property
    def _fs(self):
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        return self._at().getFileSystem(conf)

    def _listed(self, *names: str) -> list:
        place = self._at(*names)
        return list(self._fs.listStatus(place)) if self._fs.exists(place) else []

    def _manifests(self) -> dict[int, object]:
        found = {}
        for status in self._listed(MANIFESTS):
            stem, _, kind = status.getPath().getName().partition(".")
            if kind == "json" and stem.isdigit():
                found[int(stem)] = status
        return found

    def _load(self, number: int) -> Version:
        stream = self._fs.open(self._at(MANIFESTS, f"{number:020}.json"))
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return Version(number, json.loads(text)["parts"])

    # --- versions ------------------------------------------------------------------------

    def current(self) -> Version:
        numbers = self._manifests()
        return self._load(max(numbers)) if numbers else Version()

    def read(self, version: Version, schema: T.StructType, parts: Iterable[str] | None = None
             ) -> DataFrame:
        """Rows of some or all parts of a version, with the partition column."""
        wanted = version.parts if parts is None else set(parts) & version.parts.keys()
        paths = [f"{self.path}/{version.parts[p]}" for p in sorted(wanted)]
        if not paths:
            return self.spark.createDataFrame([], schema)
        whole = T.StructType([*schema.fields, T.StructField("version", T.StringType())])
        reader = self.spark.read.schema(whole).option("basePath", self.path)
        return reader.parquet(*paths).drop("version")

    def write(self, rows: DataFrame) -> dict[str, str]:
        """Write rows under a new name, invisible until published; returns its parts."""
        name = f"version={uuid.uuid4().hex}"
        rows.write.partitionBy(self.part_by).parquet(f"{self.path}/{name}")
        found = {}
        for status in self._listed(name):
            folder = status.getPath().getName()
            if folder.startswith(f"{self.part_by}="):
                found[folder.partition("=")[2]] = f"{name}/{folder}"
        return found

    def publish(self, base: Version, replaced: Iterable[str], parts: dict[str, str]) -> Version:
        """The version after ``base`` in which ``parts`` stand for the ``replaced`` ones.

        Versions that others have published meanwhile are built upon if they left all of
        ``replaced`` alone; otherwise Conflict is raised and nothing has changed.
        """
        replaced = set(replaced) | parts.keys()
        while True:
            last = self.current()
            if any(last.parts.get(p) != base.parts.get(p) for p in replaced):
                raise Conflict(f"{self.path}: version {last.number} replaced the same parts")
            kept = {p: where for p, where in last.parts.items() if p not in replaced}
            after = Version(last.number + 1, {**kept, **parts})
            if self._put(after):
                return after

    def _put(self, version: Version) -> bool:
        """False if the number is taken."""
        body = json.dumps({"parts": version.parts}, indent=1, sort_keys=True).encode()
        draft = self._at(MANIFESTS, f".{uuid.uuid4().hex}.draft")
        stream = self._fs.create(draft, False)
        try:
            stream.write(body)
        finally:
            stream.close()
        files = self._jvm.org.apache.hadoop.fs
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        context = files.FileContext.getFileContext(draft.toUri(), conf)
        plain = self.spark.sparkContext._gateway.new_array(files.Options.Rename, 0)
        try:
            context.rename(draft, self._at(MANIFESTS, f"{version.number:020}.json"), plain)
        except Py4JJavaError as error:
            self._fs.delete(draft, False)
            if "FileAlreadyExistsException" in error.java_exception.getClass().getName():
                return False
            raise
        return True

    def vacuum(self, before: dt.datetime) -> int:
        """Remove manifests published before this UTC time, except the last of them, and the parts
        that no remaining manifest names and that were written before it. Returns the number of
        parts removed. Choose a time earlier than any reader or writer still at work started."""
        cut = int(before.replace(tzinfo=dt.timezone.utc).timestamp() * 1000)
        manifests = self._manifests()
        if not manifests:
            return 0
        kept = {n for n, s in manifests.items() if s.getModificationTime() >= cut}
        kept |= {max(manifests), max([n for n in manifests if n not in kept], default=0)} - {0}
        used = {where for n in kept for where in self._load(n).parts.values()}
        removed = 0
        for status in self._listed():
            name = status.getPath().getName()
            if not name.startswith("version=") or status.getModificationTime() >= cut:
                continue
            parts = [p.getPath().getName() for p in self._listed(name) if p.isDirectory()]
            unused = [p for p in parts if f"{name}/{p}" not in used]
            if len(unused) == len(parts):
                self._fs.delete(self._at(name), True)
            else:
                for part in unused:
                    self._fs.delete(self._at(name, part), True)
            removed += len(unused)
        for number in manifests.keys() - kept:
            self._fs.delete(self._at(MANIFESTS, f"{number:020}.json"), False)
        return removed
