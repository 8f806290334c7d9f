"""Sessions as one text for a reader with a budget: the head and the tail of what was said."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convolake.functions import blocks as B

#: Share of a budget that the head has, and what stands for the rest.
HEAD, CUT = 0.6, "\n\n[... transcript truncated ...]\n\n"


def content_text(v: Column) -> Column:
    """What content (a VARIANT) says: text as it is, thoughts, tool uses and results in brackets, cut to some hundred characters."""
    of = lambda b: B.string(b, "$.type")
    field = lambda b, name, default: F.coalesce(B.string(b, f"$.{name}"), F.lit(default))

    def said(b: Column) -> Column:
        result = F.coalesce(B.string(b, "$.content"), F.to_json(B.at(b, "$.content")), F.lit(""))
        return (
            F.when(of(b) == "text", field(b, "text", ""))
            .when(of(b) == "thinking", F.concat(F.lit("[thinking] "), F.substring(field(b, "thinking", ""), 1, 500)))
            .when(of(b) == "tool_use", F.concat(F.lit("[tool_use "), field(b, "name", "?"), F.lit("] "), F.substring(F.coalesce(F.to_json(B.at(b, "$.input")), F.lit("{}")), 1, 300)))
            .when(of(b) == "tool_result", F.concat(F.lit("[tool_result] "), F.substring(result, 1, 500)))
        )

    listed = F.array_join(F.filter(F.transform(B.items(v, "$"), said), lambda t: t.isNotNull() & (t != "")), "\n")
    return F.when(v.isNull() | F.is_variant_null(v), "").when(B.kind(v) == "STRING", B.string(v, "$")).when(B.kind(v) == "ARRAY", listed).otherwise(F.substring(F.to_json(v), 1, 500))


def transcripts(rows: DataFrame, budget: int) -> DataFrame:
    """(session_id, transcript) of rows (session_id, seq, role, text, is_sidechain): lines "role: text", at most `budget` characters and a mark.

    Side chains and blank texts are left out. Only the lines that reach into the head or the tail of the budget are
    gathered, so a session of any length makes a row of about the budget.
    """
    head = int(budget * HEAD)
    tail = budget - head
    line = F.concat(F.coalesce(F.nullif(F.col("role"), F.lit("")), F.lit("?")), F.lit(": "), "text")
    lines = rows.where(~F.coalesce("is_sidechain", F.lit(False)) & F.col("text").rlike(r"\S")).select("session_id", "seq", line.alias("line"))
    order = Window.partitionBy("session_id").orderBy("seq")
    # each but the first with the end of line before it
    joined = F.concat(F.when(F.row_number().over(order) > 1, "\n").otherwise(""), "line")
    sized = lines.withColumn("line", joined).withColumn("n", F.length("line")).withColumn("end", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    whole = sized.groupBy(F.col("session_id").alias("_s")).agg(F.sum("n").alias("whole"))
    sized = sized.join(whole, F.col("session_id").eqNullSafe(F.col("_s"))).withColumn("start", F.col("end") - F.col("n"))
    fits = F.col("whole") <= budget
    first, last = fits | (F.col("start") < head), fits | (F.col("end") > F.col("whole") - tail)
    said = lambda which: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(which, F.struct("seq", "line")))), lambda x: x["line"]), "")
    texts = sized.where(first | last).groupBy("session_id").agg(F.max("whole").alias("whole"), said(first).alias("a"), said(last).alias("b"))
    cut = F.concat(F.substring("a", 1, head), F.lit(CUT), F.right("b", F.lit(tail)))
    return texts.select("session_id", F.when(fits, F.col("a")).otherwise(cut).alias("transcript"))
