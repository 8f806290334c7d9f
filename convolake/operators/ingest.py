"""Batch ingest as pure functions (archive frames, batch frames) -> archive frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convolake.functions import identity


def new_messages(archive: DataFrame, batch: DataFrame, sessions: DataFrame) -> DataFrame:
    """Rows of the batch to append: first of each (session_id, message_key) that the archive lacks.

    A batch that names an unknown session is rejected whole.
    """
    if not batch.join(sessions.select("session_id"), "session_id", "left_anti").isEmpty():
        raise ValueError("the batch names unknown sessions")
    return batch.dropDuplicates(["session_id", "message_key"]).join(archive.select("session_id", "message_key"), ["session_id", "message_key"], "left_anti")


def upsert(archive: DataFrame, batch: DataFrame, keys: list[str], keep_if_absent: list[str] = (), either: list[str] = (), widest: dict[str, str] | None = None) -> DataFrame:
    """Archive with the batch merged in by keys.

    Columns are last-write, except: keep_if_absent (a null never clobbers), either (flags that only
    rise), widest (column -> "min" or "max", nulls ignored).
    """
    a = archive.select(*[F.col(c).alias(f"old_{c}") for c in archive.columns], F.lit(True).alias("_in_old"))
    b = batch.select(*batch.columns, F.lit(True).alias("_in_new"))
    cond = None
    for k in keys:
        one = F.col(k).eqNullSafe(F.col(f"old_{k}"))
        cond = one if cond is None else cond & one
    both = a.join(b, cond, "full_outer")
    fresh = F.col("_in_new").isNotNull()

    def merged(c: str) -> Column:
        old, new = F.col(f"old_{c}"), F.col(c)
        if c in keys or c in keep_if_absent:
            return F.coalesce(new, old)
        if c in either:
            return F.coalesce(old, F.lit(False)) | F.coalesce(new, F.lit(False))
        if widest and c in widest:
            return (F.least if widest[c] == "min" else F.greatest)(old, new)
        return F.when(fresh, new).otherwise(old)

    return both.select(*[merged(c).alias(c) for c in archive.columns])


def session_deltas(sessions: DataFrame, inserted: DataFrame) -> DataFrame:
    """Sessions with counts and bounds widened by what was inserted."""
    d = inserted.groupBy(F.col("session_id").alias("_s")).agg(F.count("*").alias("n"), F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    both = sessions.join(d, F.col("session_id") == F.col("_s"), "left")
    changed = {"message_count": F.col("message_count") + F.coalesce("n", F.lit(0)), "first_message_time": F.least("first_message_time", "lo"), "last_message_time": F.greatest("last_message_time", "hi")}
    return both.select(*[changed.get(c, F.col(c)).alias(c) for c in sessions.columns])


def project_rollup(sessions: DataFrame) -> DataFrame:
    return sessions.groupBy("project_id").agg(F.count("*").alias("session_count"), F.coalesce(F.sum("message_count"), F.lit(0)).alias("message_count"))


def reconcile(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """Sessions whose stored counts or bounds differ from their messages, with the right values."""
    real = messages.groupBy(F.col("session_id").alias("_s")).agg(F.count("*").alias("n"), F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    both = sessions.join(real, F.col("session_id") == F.col("_s"), "left").withColumn("n", F.coalesce("n", F.lit(0)))
    same = F.col("message_count").eqNullSafe(F.col("n")) & F.col("first_message_time").eqNullSafe(F.col("lo")) & F.col("last_message_time").eqNullSafe(F.col("hi"))
    return both.where(~same).select("session_id", F.col("n").alias("message_count"), F.col("lo").alias("first_message_time"), F.col("hi").alias("last_message_time"))


def retain(ticks: DataFrame, now: str, days: int = 30) -> DataFrame:
    return ticks.where(F.col("tick_at") >= F.lit(now).cast("timestamp") - F.expr(f"interval {int(days)} days"))


def stale_embeddings(entries: DataFrame, embedded: DataFrame) -> DataFrame:
    """Entries whose text has no embedding of its present content."""
    want = entries.withColumn("content_hash", F.sha2(F.col("text").cast("binary"), 256))
    have = embedded.select(F.col("id").alias("_id"), F.col("content_hash").alias("_hash"))
    return want.join(have, (F.col("id") == F.col("_id")) & (F.col("content_hash") == F.col("_hash")), "left_anti")


def chunk_by_bytes(rows: DataFrame, max_rows: int, max_bytes: int) -> DataFrame:
    """Greedy chunks of a session's rows in order; a row over max_bytes ships alone. One streaming pass a session."""

    def run(batches):
        import pandas as pd

        session, chunk, n, size = None, 0, 0, 0
        for pdf in batches:
            out = []
            for s, i, b in zip(pdf.session_id, pdf.id, pdf.bytes):
                if s != session:
                    session, chunk, n, size = s, 0, 0, 0
                elif n + 1 > max_rows or size + b > max_bytes:
                    chunk, n, size = chunk + 1, 0, 0
                n, size = n + 1, size + b
                out.append((s, i, chunk))
            yield pd.DataFrame(out, columns=["session_id", "id", "chunk"])

    return rows.select("session_id", "id", "bytes").repartition("session_id").sortWithinPartitions("session_id", "id").mapInPandas(run, "session_id long, id long, chunk long")


def export_markdown(turns: DataFrame) -> DataFrame:
    """One Markdown text a session, its turns in order."""
    block = F.concat(F.lit("## "), F.initcap("role"), F.lit("\n\n"), "text")
    rows = turns.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("seq", block.alias("b")))).alias("blocks"))
    return rows.select("session_id", F.array_join(F.transform("blocks", lambda x: x["b"]), "\n\n").alias("markdown"))


def export_json(turns: DataFrame) -> DataFrame:
    rows = turns.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("seq", "role", "text"))).alias("turns"))
    return rows.select("session_id", F.to_json("turns").alias("json"))


def heartbeat(machines: DataFrame, batch: DataFrame, now: str, seconds: int = 60) -> DataFrame:
    """machines (machine_id, hostname, os, first_seen, last_seen) after a batch of (machine_id, hostname, os).

    A machine that is as it was and was seen within `seconds` keeps its row untouched; `written` tells which rows changed.
    """
    at = F.lit(now).cast("timestamp")
    new = batch.groupBy(F.col("machine_id").alias("_m")).agg(F.max(F.struct("hostname", "os")).alias("_new"))
    both = machines.join(new, F.col("machine_id") == F.col("_m"), "full_outer")
    known, said = F.col("machine_id").isNotNull(), F.col("_m").isNotNull()
    differs = ~F.col("hostname").eqNullSafe(F.col("_new.hostname")) | ~F.col("os").eqNullSafe(F.col("_new.os"))
    stale = F.coalesce(F.col("last_seen") < at - F.expr(f"interval {int(seconds)} seconds"), F.lit(True))
    written = said & (~known | differs | stale)
    pick = lambda new, old: F.when(written, new).otherwise(F.col(old)).alias(old)
    return both.select(F.coalesce("machine_id", "_m").alias("machine_id"), pick(F.col("_new.hostname"), "hostname"), pick(F.col("_new.os"), "os"), F.coalesce("first_seen", at).alias("first_seen"), pick(at, "last_seen"), written.alias("written"))


def upsert_projects(projects: DataFrame, batch: DataFrame) -> DataFrame:
    """projects with a batch merged in by (machine_id, provider, project_path): facts are validated, an absent fact keeps
    the stored one, and the identity key is that of the facts which hold afterwards."""
    clean = batch.withColumn("git_root_commit", identity.root_commit(F.col("git_root_commit"))).withColumn("git_remote_url", identity.remote_url(F.col("git_remote_url")))
    clean = clean.withColumn("identity_key", F.lit(None).cast("string")).select(projects.columns)
    merged = upsert(projects, clean, ["machine_id", "provider", "project_path"], keep_if_absent=["git_root_commit", "git_remote_url", "git_worktree", "git_main_path"])
    return merged.withColumn("identity_key", identity.identity_key(F.col("git_root_commit"), F.col("git_remote_url")))


def set_aliases(aliases: DataFrame, batch: DataFrame, projects: DataFrame) -> DataFrame:
    """aliases (project_path, identity_key) with a batch merged in, one identity a path. A key that no project carries rejects the batch."""
    unknown = batch.join(projects.select("identity_key").distinct(), "identity_key", "left_anti").select("identity_key").distinct().limit(5).collect()
    if unknown:
        raise ValueError("no project carries " + ", ".join(repr(r.identity_key) for r in unknown))
    return upsert(aliases, batch.dropDuplicates(["project_path"]), ["project_path"])
