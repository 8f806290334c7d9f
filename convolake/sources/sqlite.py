"""SQLite stores as a Spark data source: one partition a database file, read where the task runs.

Files must lie where executors can open them; a store elsewhere is fetched by its binary content.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _selected(content: bytes, query: str):
    """The query's rows from a database. Columns that its tables lack are null: a view with them stands before the table."""
    import re
    import sqlite3

    import pandas as pd

    db = sqlite3.connect(":memory:")
    try:
        db.deserialize(bytes(content))
        names = [r[0] for r in db.execute("SELECT name FROM sqlite_master WHERE type IN ('table', 'view')")]
        read = [n for n in names if re.search(rf"(?i)\b{re.escape(n)}\b", query)]
        extra: dict[str, list[str]] = {n: [] for n in read}
        while True:
            try:
                return pd.read_sql_query(query, db)
            except pd.errors.DatabaseError as e:
                lacks = re.search(r"no such column: (?:\w+\.)?\"?(\w+)", str(e))
                has = {n: {c[1].lower() for c in db.execute(f'PRAGMA main.table_info("{n}")')} for n in read}
                where = [n for n in read if lacks and lacks[1].lower() not in has[n] and lacks[1] not in extra[n]]
                if not where:
                    raise
                table = where[0]
                extra[table].append(lacks[1])
                nulls = "".join(f', NULL AS "{c}"' for c in extra[table])
                db.execute(f'DROP VIEW IF EXISTS temp."{table}"')
                db.execute(f'CREATE TEMP VIEW "{table}" AS SELECT *{nulls} FROM main."{table}"')
    finally:
        db.close()


def tables(spark: SparkSession, path: str, query: str, schema: str, strict: bool = False) -> DataFrame:
    """Rows of `query` over every database that path matches, with the database's path.

    Spark reads the files, so any of its stores will do, and a task opens its copy in memory. Columns that an
    older database lacks come as null. Files that are no database, or lack the tables, have no rows, or fail the
    job where `strict`; `problems` names them.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    names = [f.strip().split(" ")[0].split(":")[0] for f in schema.split(",")]

    def run(batches) -> Iterator:
        import sqlite3

        import pandas as pd

        for pdf in batches:
            for file, content in zip(pdf.path, pdf.content):
                try:
                    got = _selected(content, query)
                except (sqlite3.DatabaseError, pd.errors.DatabaseError) as e:
                    if strict:
                        raise ValueError(f"{file}: {e}") from e
                    continue
                got = got.reindex(columns=names)
                yield got.assign(database=file)[["database", *names]]

    return files.repartition("path").mapInPandas(run, f"database string, {schema}")


def problems(spark: SparkSession, path: str, query: str) -> DataFrame:
    """(database, error) of the files that the query has no rows of because they are no database or lack its tables."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches) -> Iterator:
        import sqlite3

        import pandas as pd

        for pdf in batches:
            found = []
            for file, content in zip(pdf.path, pdf.content):
                try:
                    _selected(content, query)
                except (sqlite3.DatabaseError, pd.errors.DatabaseError) as e:
                    found.append((file, str(e).splitlines()[-1]))
            yield pd.DataFrame(found, columns=["database", "error"])

    return files.repartition("path").mapInPandas(run, "database string, error string")


def _known(c: str):
    """A count that is never below zero; an unknown one stays null."""
    return F.when(F.col(c) < 0, 0.0).otherwise(F.col(c)).alias(c)


def turns_of_responses(spark: SparkSession, path: str) -> DataFrame:
    """A store of one row a prompt with its response: two turns each; prompts without conversation are one."""
    rows = tables(spark, path, "SELECT conversation_id, id, prompt, response, model, datetime_utc, input_tokens, output_tokens FROM responses", "conversation_id string, id string, prompt string, response string, model string, datetime_utc string, input_tokens double, output_tokens double")
    rows = rows.withColumn("ts", F.try_to_timestamp("datetime_utc"))
    none = F.lit(None).cast("double")
    both = F.array(
        F.struct(F.lit("user").alias("role"), F.col("prompt").alias("content"), none.alias("input_tokens"), none.alias("output_tokens")),
        F.struct(F.lit("assistant").alias("role"), F.col("response").alias("content"), _known("input_tokens"), _known("output_tokens")),
    )
    out = rows.select(F.coalesce("conversation_id", F.lit("(none)")).alias("session_id"), "id", "model", "ts", F.explode(both).alias("m")).select("session_id", "id", "model", "ts", "m.*")
    return out.withColumn("input_tokens", F.col("input_tokens").cast("long")).withColumn("output_tokens", F.col("output_tokens").cast("long"))


def key_values(spark: SparkSession, path: str, table: str, prefixes: list[str]) -> DataFrame:
    """The value of the first prefix of keys that a database has; of its keys the highest."""
    rows = tables(spark, path, f'SELECT key, CAST(value AS TEXT) AS value FROM "{table}"', "key string, value string")
    place = F
    for n, p in enumerate(prefixes):
        place = place.when(F.col("key").startswith(p), n)
    rows = rows.withColumn("place", place).where("place is not null")
    return rows.groupBy("database").agg(F.max_by("value", F.struct(-F.col("place"), F.col("key"))).alias("value"))


def blobs(spark: SparkSession, path: str, query: str) -> DataFrame:
    """(database, id, data): JSON from blobs that are stored plain or compressed with zstandard."""
    rows = tables(spark, path, query, "id string, data binary")

    def run(batches):
        import zstandard

        for pdf in batches:
            said = []
            for d in pdf.data:
                raw = bytes(d) if d is not None else b""
                if raw[:4] == b"\x28\xb5\x2f\xfd":
                    raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
                said.append(raw.decode("utf-8", "replace"))
            yield pdf.assign(data=said)

    return rows.mapInPandas(run, "database string, id string, data string")
