"""Stored tables under a pointer: versions are built beside the live one, and one rename makes the next one live.

    root/v-<n>-<id>/batch=<k>/…   the rows of a version, in the batches that brought them
    root/_pointer/<n>             which version is live, up to which batch, and its schema; the highest n counts

A pointer's file is put in place by a rename that fails where the file exists, so of two writers one wins and the other
starts anew. A reader keeps the version that it opened; a version is removed no sooner than when another two have
followed. A rebuild that fails leaves nothing but files that no pointer names.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType


class Conflict(RuntimeError):
    """Another writer moved the pointer first."""


@dataclass(frozen=True)
class Pointer:
    number: int
    folder: str
    batch: int
    schema: str


class Snapshots:
    """A stored table at root (any Hadoop file system), its rows in folders by the columns `by`."""

    def __init__(self, spark: SparkSession, root: str, by: list[str] = ()):
        self.spark, self.root, self.by = spark, root.rstrip("/"), list(by)
        self._fs = spark._jvm.org.apache.hadoop.fs
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._files = self._path(self.root).getFileSystem(self._conf)

    def _path(self, path: str):
        return self._fs.Path(path)

    def _names(self, folder: str) -> list[str]:
        path = self._path(folder)
        return sorted(s.getPath().getName() for s in self._files.listStatus(path)) if self._files.exists(path) else []

    def pointer(self) -> Pointer | None:
        """The live version."""
        names = [n for n in self._names(f"{self.root}/_pointer") if n.isdigit()]
        if not names:
            return None
        stream = self._files.open(self._path(f"{self.root}/_pointer/{names[-1]}"))
        try:
            return Pointer(**json.loads(bytes(stream.readAllBytes()).decode()))
        finally:
            stream.close()

    def _move(self, last: Pointer | None, folder: str, batch: int, schema: str) -> Pointer:
        """Makes (folder, batch) live, if `last` still is."""
        new = Pointer(last.number + 1 if last else 1, folder, batch, schema)
        target, fresh = self._path(f"{self.root}/_pointer/{new.number:020d}"), self._path(f"{self.root}/_pointer/.{uuid.uuid4().hex}")
        out = self._files.create(fresh, False)
        out.write(bytearray(json.dumps(asdict(new)).encode()))
        out.close()
        rename = getattr(self._fs, "Options$Rename")
        try:
            self._fs.FileContext.getFileContext(target.toUri(), self._conf).rename(fresh, target, self.spark.sparkContext._gateway.new_array(rename, 0))
        except Py4JJavaError as e:
            self._files.delete(fresh, False)
            if "FileAlreadyExists" in str(e.java_exception):
                raise Conflict(f"pointer {new.number} of {self.root} was moved by another writer") from e
            raise
        return new

    def read(self) -> DataFrame:
        """The rows of the live version; what is written later, or swapped in, doesn't change the frame."""
        p = self.pointer()
        if p is None:
            raise ValueError(f"{self.root} has no version yet")
        schema = StructType.fromJson(json.loads(p.schema))
        rows = self.spark.read.schema(StructType([*schema.fields, StructField("batch", LongType())])).parquet(f"{self.root}/{p.folder}")
        return rows.where(F.col("batch") <= p.batch).select(schema.names)

    def rebuild(self, build: Callable[[], DataFrame]) -> Pointer:
        """Builds a version beside the live one and swaps it in; the live one is read from until then.

        Where batches were appended in the meantime the swap is refused, as the new version may lack them.
        """
        last = self.pointer()
        folder = f"v-{last.number + 1 if last else 1}-{uuid.uuid4().hex}"
        batch = last.batch if last else 0
        try:
            rows = build()
            rows.write.partitionBy(*self.by).parquet(f"{self.root}/{folder}/batch={batch}")
            moved = self._move(last, folder, batch, rows.schema.json())
        except BaseException:
            self._files.delete(self._path(f"{self.root}/{folder}"), True)
            raise
        self.sweep()
        return moved

    def append(self, rows: DataFrame, batch: int) -> Pointer:
        """Adds a batch to the live version. A batch that is live already adds nothing; one that failed is written anew."""
        last = self.pointer()
        if last and batch <= last.batch:
            return last
        folder = last.folder if last else f"v-1-{uuid.uuid4().hex}"
        rows.write.mode("overwrite").partitionBy(*self.by).parquet(f"{self.root}/{folder}/batch={batch}")
        return self._move(last, folder, batch, last.schema if last else rows.schema.json())

    def sweep(self, keep: int = 2) -> None:
        """Removes versions but the live one and the `keep` before it, and pointers but the last 100."""
        names = [n for n in self._names(f"{self.root}/_pointer") if n.isdigit()]
        for n in names[:-100]:
            self._files.delete(self._path(f"{self.root}/_pointer/{n}"), False)
        live = self.pointer()
        older = sorted((v for v in self._names(self.root) if v.startswith("v-") and int(v.split("-")[1]) < int(live.folder.split("-")[1])), key=lambda v: int(v.split("-")[1]))
        for v in older[: max(len(older) - keep, 0)]:
            self._files.delete(self._path(f"{self.root}/{v}"), True)
