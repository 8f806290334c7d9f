"""Patch logs: a snapshot, then sets and appends at paths, replayed in order for each file."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _put(root, path: list, value, append: bool):
    if not path:
        return value
    at = root
    for n, key in enumerate(path[:-1]):
        if isinstance(at, list):
            while len(at) <= key:
                at.append({})
            at = at[key]
        else:
            at = at.setdefault(key, [] if isinstance(path[n + 1], int) else {})
    last = path[-1]
    if append:
        held = at[last] if isinstance(at, list) else at.setdefault(last, [])
        held.extend(value if isinstance(value, list) else [value])
    elif isinstance(at, list):
        while len(at) <= last:
            at.append(None)
        at[last] = value
    else:
        at[last] = value
    return root


def replay(lines: list[str]) -> str | None:
    """The state after all patches; lines that are no patch, or patch what isn't there, are skipped."""
    state = None
    for line in lines:
        try:
            p = json.loads(line)
            if p["kind"] == 0:
                state = p["v"]
            elif state is not None:
                state = _put(state, p["k"], p["v"], p["kind"] == 2)
        except (ValueError, KeyError, TypeError, IndexError):
            continue
    return None if state is None else json.dumps(state)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(session_id, state): one row a log file; a file is one ordered fold, so it is read whole."""
    files = spark.read.text(path, wholetext=True).select(F.regexp_extract("_metadata.file_path", r"([^/]+)\.\w+$", 1).alias("session_id"), "value")

    def run(batches):
        for pdf in batches:
            yield pdf.assign(state=[replay(v.splitlines()) for v in pdf.value])[["session_id", "state"]]

    return files.mapInPandas(run, "session_id string, state string").where("state is not null")


def messages(states: DataFrame) -> DataFrame:
    """Requests of a state as user and assistant turns."""
    r = F.from_json(F.get_json_object("state", "$.requests"), "array<struct<requestId:string,timestamp:long,message:struct<text:string>,response:array<struct<value:string>>>>")
    rows = states.select("session_id", F.posexplode(r).alias("n", "r"))
    answer = F.array_join(F.transform("r.response", lambda x: x["value"]), "")
    both = F.array(F.struct(F.lit("user").alias("role"), F.col("r.message.text").alias("content"), (F.col("n") * 2).alias("seq")), F.struct(F.lit("assistant").alias("role"), answer.alias("content"), (F.col("n") * 2 + 1).alias("seq")))
    return rows.select("session_id", F.timestamp_millis("r.timestamp").alias("ts"), F.explode(both).alias("m")).select("session_id", "ts", "m.*")
