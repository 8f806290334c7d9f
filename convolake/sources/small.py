"""Folders of many small files: tasks list and read them, so that neither the driver's index nor the number of tasks grows with the files."""

from __future__ import annotations

import io
from collections.abc import Iterator
from fnmatch import fnmatchcase
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .appended import _open

#: Bytes of text of one batch.
BYTES = 1 << 22


def _hidden(name: str) -> bool:
    """Names that Spark's readers leave out too."""
    return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")


def _listed(store, folder: str) -> list:
    infos = store.get_file_info(pa.fs.FileSelector(folder, allow_not_found=True))
    return sorted((i for i in infos if not _hidden(i.base_name)), key=lambda i: i.path)


def _matching(store, info, parts: list[str]) -> Iterator:
    """Files at or below an entry whose name and further path match the parts; ** stands for any folders, also none."""
    folder = info.type == pa.fs.FileType.Directory
    if parts[0] == "**":
        if not folder:
            return (yield from _matching(store, info, parts[1:]))
        for below in _listed(store, info.path):
            yield from _matching(store, below, parts)
    elif fnmatchcase(info.base_name, parts[0]):
        if len(parts) == 1:
            if not folder:
                yield info
        elif folder:
            for below in _listed(store, info.path):
                yield from _matching(store, below, parts[1:])


def small_files(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(file, modified, line, value) of the files that match path: whole, or line by line; file is as in _metadata.file_path.

    path may have wildcards and, before its last part, **; its last part is a file's name. The folder before the first wildcard is
    listed once and its entries are dealt to tasks, which walk down from there and read file after file as streams.
    """
    base, parts = path.rstrip("/").split("/"), []
    while len(parts) == 0 or any(c in p for p in base for c in "*?["):
        parts.insert(0, base.pop())
    root = "/".join(base)
    store, at = _open(root)
    start = "/".join(root.split("/", 3)[:3]) if "://" in root and not root.startswith("file:") else "file:"
    names = [i.base_name for i in _listed(store, at)]
    tasks = min(len(names), 4 * spark.sparkContext.defaultParallelism) or 1
    dealt = spark.createDataFrame(pa.table({"name": pa.array(names, pa.string())})).repartition(tasks, "name")

    def read(batches):
        store, at = _open(root)
        held, size = [], 0

        def batch():
            return pa.RecordBatch.from_pylist(held, pa.schema([("file", pa.string()), ("modified", pa.timestamp("us", "UTC")), ("line", pa.int64()), ("value", pa.string())]))

        for name in (n for b in batches for n in b.column("name").to_pylist()):
            for info in _matching(store, store.get_file_info(f"{at}/{name}"), parts):
                with store.open_input_stream(info.path) as raw:
                    if lines:
                        found = (x.rstrip("\n") for x in io.TextIOWrapper(raw, encoding="utf-8-sig", errors="replace"))
                    else:
                        found = (raw.read().decode("utf-8", "replace") for _ in range(1))
                    uri = start + quote("/" + info.path.lstrip("/"), safe="/:@!$&'()*+,;=~")
                    for n, value in enumerate(found):
                        held.append({"file": uri, "modified": info.mtime, "line": n, "value": value})
                        size += len(value) + 200
                        if size > BYTES:
                            yield batch()
                            held, size = [], 0
        if held:
            yield batch()

    return dealt.mapInArrow(read, "file string, modified timestamp, line long, value string")
