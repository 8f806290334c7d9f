"""Lines of append-only files as a stream whose offsets are bytes in each file.

A micro-batch reads what was appended since the last one: unchanged files are not opened, grown files are read from
their offset, a line without its end waits for it. A file that shrank, or whose bytes before the offset are others
than they were, is read again from its beginning; its old lines, like those of a file that is gone, are taken back by
a row whose value is null.

    spark.dataSource.register(AppendedLines)
    spark.readStream.format("appended_lines").load(folder)     # file, at (the line's first byte; -1: taken back), value

Files are reached by pyarrow's file systems, so a folder may be local, in HDFS or in an object store. An offset names
every file of the folder, some hundred bytes each: a store of very many files is followed folder by folder.
"""

from __future__ import annotations

import io
import json
import zlib
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery

SCHEMA = "file string, at long, value string"
#: Bytes of a partition, of a read from the end of a file, and before an offset that must be as they were.
SPLIT, TAIL, SEEN = 32 << 20, 1 << 16, 256


def _open(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if "://" in folder or not folder.startswith("file:") else "file://" + folder[5:])


def _checksum(f, at: int) -> int:
    """Checksum of the last bytes before `at`."""
    f.seek(max(at - SEEN, 0))
    return zlib.crc32(f.read(min(at, SEEN)))


def whole_lines(f, size: int) -> int:
    """How many of a file's first `size` bytes are whole lines, found from the end."""
    end = size
    while end > 0:
        begin = max(end - TAIL, 0)
        f.seek(begin)
        found = f.read(end - begin).rfind(b"\n")
        if found >= 0:
            return begin + found + 1
        end = begin
    return 0


@dataclass
class Part(InputPartition):
    """Lines of `file` that begin at `begin` or later and before `end`; all lines end before `stop`. Without `stop` the file's lines are taken back."""

    file: str
    begin: int = 0
    end: int = 0
    stop: int = 0


class AppendedReader(DataSourceStreamReader):
    def __init__(self, options):
        self.folder, self.suffix = options["path"], options.get("suffix", ".jsonl")
        self.known: dict[str, tuple] = {}

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def latestOffset(self) -> dict:
        """Of each file the bytes of its whole lines and a checksum of the last of them; files as known aren't opened."""
        from pyarrow import fs

        store, root = _open(self.folder)
        listed = store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        listed = [i for i in listed if i.is_file and i.path.endswith(self.suffix)]

        def end(info):
            state = (info.size, info.mtime_ns)
            if self.known.get(info.path, (None,))[0] == state:
                return info.path, self.known[info.path]
            with store.open_input_file(info.path) as f:
                at = whole_lines(f, info.size)
                return info.path, (state, [at, _checksum(f, at)])

        with ThreadPoolExecutor(16) as pool:
            self.known = dict(pool.map(end, listed))
        return {"files": json.dumps({p: at for p, (_, at) in sorted(self.known.items())})}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        store, _ = _open(self.folder)
        before, now = json.loads(start["files"]), json.loads(end["files"])
        out = [Part(p) for p in before if p not in now]
        for path, (stop, seen) in now.items():
            begin, was = before.get(path, [0, 0])
            if begin:
                if [stop, seen] == [begin, was]:
                    continue
                same = stop >= begin
                if same:
                    with store.open_input_file(path) as f:
                        same = _checksum(f, begin) == was
                if not same:
                    out.append(Part(path))
                    begin = 0
            out += [Part(path, b, min(b + SPLIT, stop), stop) for b in range(begin, stop, SPLIT)]
        return out

    def read(self, part: Part):
        if not part.stop:
            yield part.file, -1, None
            return
        store, _ = _open(self.folder)
        with io.BufferedReader(store.open_input_file(part.file)) as f:
            at = part.begin
            if at:  # a line belongs to the part that its first byte lies in
                f.seek(at - 1)
                at += len(f.readline()) - 1
            f.seek(at)
            rest = b""
            while at < part.end and (block := f.read(min(1 << 20, part.stop - at - len(rest)))):
                *lines, rest = (rest + block).split(b"\n")
                for line in lines:
                    if at < part.end:
                        yield part.file, at, line.decode(errors="replace")
                    at += len(line) + 1

    def commit(self, end: dict) -> None:
        pass


class AppendedLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "appended_lines"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> AppendedReader:
        return AppendedReader(self.options)


def follow(spark: SparkSession, folder: str, table: str, checkpoint: str, suffix: str = ".jsonl") -> StreamingQuery:
    """Adds what was appended in folder to the table of lines, once: a batch that is replayed writes its own folder again."""
    spark.dataSource.register(AppendedLines)
    lines = spark.readStream.format("appended_lines").option("suffix", suffix).load(folder)

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch={number}")

    return lines.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def lines(spark: SparkSession, table: str) -> DataFrame:
    """file, at, value of the lines that hold: those that came with or after the last time the file's lines were taken back."""
    rows = spark.read.schema(f"{SCHEMA}, batch int").parquet(table)
    gone = rows.where("at < 0").groupBy(F.col("file").alias("_file")).agg(F.max("batch").alias("_since"))
    held = rows.where("at >= 0").join(gone, F.col("file") == F.col("_file"), "left")
    return held.where("_since is null or batch >= _since").select("file", "at", "value")
