"""Tool invocations, outcomes, usage and search text from message JSON, inside the JVM where JSON has a schema."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCKS = "array<struct<type:string,text:string,id:string,name:string,input:string,tool_use_id:string,is_error:boolean,content:string>>"

# Keys that structure a message and say nothing.
STRUCTURAL = {"type", "id", "uuid", "tool_use_id", "parentUuid", "sessionId", "session_id", "timestamp", "signature", "model", "role", "messageId", "requestId", "version", "cwd", "media_type"}


def blocks(content: Column) -> Column:
    return F.from_json(content, BLOCKS)


def message_id(raw: Column) -> Column:
    return F.nullif(F.get_json_object(raw, "$.messageId"), F.lit(""))


def tool_uses(messages: DataFrame) -> DataFrame:
    """(id, session_id, seq, tool_name, tool_use_id, skill_name, subagent_type, is_error): invocations of assistant messages.

    The message's own toolUse counts only where its content has no invocation.
    """
    listed = F.coalesce(F.filter(blocks(F.col("content")), lambda b: b["type"] == "tool_use"), F.array().cast(BLOCKS))
    at = lambda path: F.get_json_object("raw", path)
    none = F.lit(None).cast("string")
    fields = {"type": F.lit("own"), "text": none, "id": at("$.toolUse.id"), "name": at("$.toolUse.name"), "input": none, "tool_use_id": none, "is_error": at("$.toolUseResult.is_error").cast("boolean"), "content": none}
    own = F.when(at("$.toolUse.name").isNotNull(), F.array(F.struct(*[c.alias(k) for k, c in fields.items()])))
    rows = messages.where("type = 'assistant'").select("id", "session_id", "raw", listed.alias("b"))
    rows = rows.select("id", "session_id", F.when(F.size("b") == 0, own).otherwise(F.col("b")).alias("b"))
    # outer: the filter that is inferred for an inner one would parse each message again
    return rows.select("id", "session_id", F.posexplode_outer("b").alias("seq", "b")).where("seq is not null").select(
        "id",
        "session_id",
        "seq",
        F.col("b.name").alias("tool_name"),
        F.col("b.id").alias("tool_use_id"),
        F.when(F.col("b.name") == "Skill", F.get_json_object("b.input", "$.skill")).alias("skill_name"),
        F.when(F.col("b.name").isin("Agent", "Task"), F.get_json_object("b.input", "$.subagent_type")).alias("subagent_type"),
        F.when(F.col("b.type") == "own", F.col("b.is_error")).alias("is_error"),
    )


def tool_results(messages: DataFrame) -> DataFrame:
    """Outcomes of any message that name their invocation; no flag means success."""
    b = F.filter(blocks(F.col("content")), lambda x: (x["type"] == "tool_result") & (F.coalesce(x["tool_use_id"], F.lit("")) != ""))
    rows = messages.select("id", "session_id", F.posexplode(b).alias("seq", "b"))
    return rows.select("id", "session_id", "seq", F.col("b.tool_use_id").alias("tool_use_id"), F.coalesce("b.is_error", F.lit(False)).alias("is_error"))


# Names of the token counts in the logs.
USAGE_KEYS = {"input_tokens": "input_tokens", "output_tokens": "output_tokens", "cache_creation_tokens": "cache_creation_input_tokens", "cache_read_tokens": "cache_read_input_tokens"}


def _let(value: Column, f) -> Column:
    """f of a value that is computed once, however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def usage_struct(raw: Column, counts=tuple(USAGE_KEYS)) -> Column:
    """Token counts of a message as one struct, for which no path is read twice and none that isn't needed.

    A usage object of the message itself counts whole, whatever it leaves out. Else each count is that of the
    tool's result, or of the content; where both input and output are unknown, the tool result's totalTokens is
    the output of an assistant's message and the input of another.
    """
    at = lambda path: F.get_json_object(raw, f"$.{path}")
    count = lambda path: _let(at(path).try_cast("long"), lambda n: F.when(n >= 0, n))
    own = F.when(at("message.usage").startswith("{"), "message").when(at("usage").startswith("{"), "top")
    names = list(dict.fromkeys([*counts, "input_tokens", "output_tokens"]))

    def found(own):
        of = lambda key: F.when(own == "message", count(f"message.usage.{key}")).when(own == "top", count(f"usage.{key}")).otherwise(F.coalesce(count(f"toolUseResult.usage.{key}"), count(f"content.usage.{key}")))
        return F.struct(own.alias("own"), *[of(USAGE_KEYS[n]).alias(n) for n in names])

    def whole(u):
        total = count("toolUseResult.totalTokens")
        assistant = F.coalesce(at("type") == "assistant", F.lit(False))
        rest = {"input_tokens": F.when(~assistant, total), "output_tokens": F.when(assistant, total)}
        rest = {n: F.when(u["own"].isNull() & u["input_tokens"].isNull() & u["output_tokens"].isNull(), x) for n, x in rest.items()}
        return F.struct(*[(F.coalesce(u[n], rest[n]) if n in rest else u[n]).alias(n) for n in counts])

    return _let(_let(own, found), whole)


def usage(raw: Column) -> dict[str, Column]:
    """The four token counts of a message, each as a column; usage_struct() has them together."""
    return {n: usage_struct(raw, (n,))[n] for n in USAGE_KEYS}


def _walk(value, out: list[str]) -> None:
    if isinstance(value, str):
        out.append(value)
    elif isinstance(value, dict):
        for k, v in value.items():
            if k not in STRUCTURAL:
                _walk(v, out)
    elif isinstance(value, list):
        for v in value:
            _walk(v, out)


def search_text(df: DataFrame, json_col: str, out_col: str = "search_text") -> DataFrame:
    """df with the text of a JSON column: all strings but those of structural keys, white space collapsed.

    JSON of any depth has no schema, so this walks it in Python, a batch of rows at a time.
    """

    @F.pandas_udf("string")
    def flat(s):
        def one(x):
            if x is None:
                return None
            try:
                found: list[str] = []
                _walk(json.loads(x), found)
                return " ".join(" ".join(found).split())
            except ValueError:
                return " ".join(x.split())

        return s.map(one)

    return df.withColumn(out_col, flat(F.col(json_col)))
