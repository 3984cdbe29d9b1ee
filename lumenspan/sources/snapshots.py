"""Frozen versions of a table: previewed by checksum, written once, found again by content."""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from .artifacts import set_checksum


class Conflict(Exception):
    """The rows or the versions are not those that were previewed."""


@dataclass(frozen=True)
class Preview:
    """What freezing would keep: rows, their checksum, and the last version before."""

    rows: int
    checksum: str
    after: int


@dataclass(frozen=True)
class Snapshot:
    version: int
    checksum: str
    rows: int
    path: str


class Versions:
    """The versions of one table under a folder that driver and executors share.

    ``manifests/<number>`` names a version's files and checksum.  It is written
    aside and renamed into place, which fails if the number is taken: of
    several writers that go for one number one wins.  Files of a version are
    never written again.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark._jvm.org.apache.hadoop.fs

    def _path(self, name: str):
        return self._jvm.Path(f"{self.root}/{name}")

    def _fs(self):
        return self._path("x").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def all(self) -> list[Snapshot]:
        """Every frozen version, oldest first."""
        fs, folder = self._fs(), self._path("manifests")
        if not fs.exists(folder):
            return []
        out = []
        for status in fs.listStatus(folder):
            name = status.getPath().getName()
            if name.isdigit():
                with_stream = fs.open(status.getPath())
                try:
                    body = self.spark._jvm.org.apache.commons.io.IOUtils.toString(with_stream, "UTF-8")
                finally:
                    with_stream.close()
                found = json.loads(body)
                found.pop("writer")
                out.append(Snapshot(**found))
        return sorted(out, key=lambda s: s.version)

    def preview(self, rows: DataFrame) -> Preview:
        """Count and checksum of the rows as they are now; any order of rows has the same."""
        return Preview(rows.count(), set_checksum(rows), max((s.version for s in self.all()), default=0))

    def freeze(self, rows: DataFrame, preview: Preview) -> Snapshot:
        """A version with these rows.

        If a version has this checksum already, that is returned and nothing
        is kept twice.  Otherwise the rows are written, and what was written
        must have the checksum of the preview: the table may have changed since,
        or while it was written.  Then the version after the previewed one is
        taken.  Conflict if rows have changed or another writer has that number.
        """
        name = uuid.uuid4().hex
        path, fs = f"{self.root}/rows/{name}", self._fs()
        rows.write.mode("error").parquet(path)
        kept = self.spark.read.schema(rows.schema).parquet(path)
        try:
            if set_checksum(kept) != preview.checksum:
                raise Conflict("the rows have changed since the preview")
            same = next((s for s in self.all() if s.checksum == preview.checksum), None)
            if same is None:
                made = Snapshot(preview.after + 1, preview.checksum, preview.rows, path)
                self._publish(made, name)
                return made
        except Conflict:
            fs.delete(self._jvm.Path(path), True)
            raise
        fs.delete(self._jvm.Path(path), True)
        return same

    def _publish(self, made: Snapshot, writer: str) -> None:
        fs, aside, place = self._fs(), self._path(f"aside/{writer}"), self._path(f"manifests/{made.version}")
        fs.mkdirs(self._path("manifests"))
        out = fs.create(aside, False)
        try:
            out.write(bytearray(json.dumps(asdict(made) | {"writer": writer}), "utf-8"))
        finally:
            out.close()
        context = self._jvm.FileContext.getFileContext(aside.toUri() if aside.toUri().getScheme() else fs.getUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(getattr(self._jvm, "Options$Rename"), 0)
        try:
            context.rename(aside, place, none)
        except Py4JJavaError as e:
            fs.delete(aside, False)
            if "FileAlreadyExists" in str(e.java_exception):
                raise Conflict(f"version {made.version} is taken") from None
            raise

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the newest if none is named; LookupError if there is none."""
        found = [s for s in self.all() if version is None or s.version == version]
        if not found:
            raise LookupError(f"no version {version or ''} under {self.root}")
        return self.spark.read.parquet(found[-1].path)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir; on one machine without that setting below a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        import tempfile

        base = "file://" + tempfile.mkdtemp(prefix="lumenspan-")
    return f"{base.rstrip('/')}/lumenspan/{name}-{uuid.uuid4().hex}"
