"""The usage marker kept as state: which row of a (session, group) counts is decided when the group is first seen.

State: the ids that came, and the groups. A micro-batch asks the state for its own groups and ids only, so its work
doesn't grow with what is stored, and no group is gathered. Rows that come again (sources deliver at least once) add
nothing; rows without a group are messages of their own. A batch that is replayed finds the state as it was and gives
the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from convolake.tables import cut, drop

from .snapshots import Snapshots

#: How state is kept: on the executors' disks, by its changes. Its partitions are fixed once a checkpoint exists; a state that is on
#: disk needs few, and each costs a file a batch.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.shuffle.partitions": "32",
}
GROUP = ["session_id", "_group"]


def fresh(stream: DataFrame) -> DataFrame:
    """A stream of messages (id, session_id, group_key, …) without repetitions, and of its new groups (_new; one row of each)."""
    own = F.coalesce(F.col("group_key"), F.concat(F.lit("\0"), F.col("id").cast("string")))
    rows = stream.withColumn("_group", own)
    groups = rows.select(*GROUP).dropDuplicates(GROUP)
    return rows.dropDuplicates([*GROUP, "id"]).withColumn("_new", F.lit(False)).unionByName(groups.withColumn("_new", F.lit(True)), allowMissingColumns=True)


def marked(batch: DataFrame) -> DataFrame:
    """The messages of a batch of fresh(), with usage_row: true for the lowest id of each new group."""
    first = batch.groupBy(*GROUP).agg(F.min(F.when(~F.col("_new"), F.col("id"))).alias("_first"), F.bool_or("_new").alias("_is_new")).where("_is_new")
    first = first.select(F.col("session_id").alias("_s"), F.col("_group").alias("_g"), "_first")
    same = F.col("session_id").eqNullSafe(F.col("_s")) & (F.col("_group") == F.col("_g"))
    out = batch.where(~F.col("_new")).join(first, same, "left")
    return out.withColumn("usage_row", F.coalesce(F.col("id") == F.col("_first"), F.lit(False))).drop(*[c for c in out.columns if c in ("_group", "_new", "_s", "_g", "_first")])


def mirror(stream: DataFrame, root: str, checkpoint: str) -> StreamingQuery:
    """Adds a stream's messages to the stored table at root, marked, each once."""
    spark = stream.sparkSession

    def add(batch: DataFrame, n: int) -> None:
        held = cut(batch)  # the state is asked once
        Snapshots(batch.sparkSession, root).append(marked(held), n + 1)
        drop(held)

    before = {k: spark.conf.get(k, None) for k in STATE}
    for k, v in STATE.items():
        spark.conf.set(k, v)  # read when the query starts
    try:
        return fresh(stream).writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
