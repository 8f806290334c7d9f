"""Logs written from turns: one JSON line a turn, many sessions a file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def canonical_line() -> Column:
    """The JSON line of a turn (session_id, seq, ts, role, text) as the canonical reader takes it."""
    key = F.concat_ws("-", F.col("session_id").cast("string"), F.col("seq").cast("string"))
    message = F.struct("role", F.col("text").alias("content"), key.alias("id"))
    return F.to_json(F.struct(F.col("role").alias("type"), F.col("session_id").cast("string").alias("sessionId"), key.alias("uuid"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), message.alias("message")))


def record_line(fields: dict[str, str], values: dict[str, Column]) -> Column:
    """The JSON line that holds each of values where fields (name -> path, as $.a.b) says."""
    tree: dict = {}
    for name, path in fields.items():
        if name not in values:
            continue
        *above, last = path.removeprefix("$.").split(".")
        node = tree
        for key in above:
            node = node.setdefault(key, {})
        node[last] = values[name]
    struct = lambda t: F.struct(*[(struct(v) if isinstance(v, dict) else v).alias(k) for k, v in t.items()])
    return F.to_json(struct(tree))


def write_files(rows: DataFrame, folder: str, file: Column, order: list[Column], line: Column, half: Column | None = None, suffix: str = ".jsonl") -> int:
    """Writes each file's lines in order, each file (its name may have folders) as a stream by one task; returns the number of lines.

    Lines for which `half` holds are still being written: of the first of a file only its first half is there, without
    an end, and nothing after it. A task that runs again writes the same bytes over its files.
    """
    cut = half if half is not None else F.lit(False)
    dealt = rows.select(file.alias("_file"), line.alias("_line"), cut.alias("_half"), F.struct(*order).alias("_order")).repartition("_file").sortWithinPartitions("_file", "_order").drop("_order")

    def put(batches):
        import pyarrow as pa
        from convolake.sources.appended import _open

        store, root = _open(folder)
        name, out, broken, lines, made = None, None, False, 0, None
        for b in batches:
            for r in b.to_pylist():
                if r["_file"] != name:
                    if out:
                        out.close()
                    name, broken = r["_file"], False
                    place = f"{root}/{name}{suffix}"
                    if (above := place.rsplit("/", 1)[0]) != made:
                        store.create_dir(above, recursive=True)
                        made = above
                    out = store.open_output_stream(place)
                if broken:
                    continue
                raw, broken = r["_line"].encode(), r["_half"]
                out.write(raw[: len(raw) // 2] if broken else raw + b"\n")
                lines += not broken
        if out:
            out.close()
        yield pa.record_batch([pa.array([lines], pa.int64())], names=["lines"])

    return dealt.mapInArrow(put, "lines long").agg(F.coalesce(F.sum("lines"), F.lit(0))).first()[0]
