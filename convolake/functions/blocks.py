"""What messages hold, by the kinds of their blocks: searchable text, tool ids and flags, over VARIANT values.

A message is a VARIANT of JSON with content (a string or blocks), type, level, stopReasonSystem, toolUse, toolUseResult.
Everything stays in built-in functions: blocks have no common schema, a VARIANT needs none.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters of a text, and of a tool's result, that are searched; tools that change files.
TEXT_LIMIT, RESULT_LIMIT = 10_000, 5_000
FILE_TOOLS = ["Write", "Edit", "MultiEdit", "NotebookEdit"]
# Fields of a block, or of its content object, whose strings are searched, by the block's type.
BLOCK_FIELDS = {
    "tool_use": ["name"],
    "tool_result": ["content"],
    "server_tool_use": ["name"],
    "document": ["title", "context"],
    "search_result": ["title", "source"],
    "mcp_tool_use": ["server_name", "tool_name"],
    "web_search_tool_result": ["content.title", "content.url"],
    "web_fetch_tool_result": ["content.url", "content.content.title"],
    "code_execution_tool_result": ["content.stdout", "content.stderr"],
    "bash_code_execution_tool_result": ["content.stdout", "content.stderr"],
    "text_editor_code_execution_tool_result": ["content.path", "content.content"],
}
# Fields of the elements of a block's content array.
ELEMENT_FIELDS = {"web_search_tool_result": ["title", "url"], "search_result": ["text"], "tool_search_tool_result": ["tool_name", "server_name", "description"]}


def at(v: Column, path: str) -> Column:
    """The value at path as a VARIANT."""
    return F.try_variant_get(v, path, "variant")


def kind(v: Column) -> Column:
    """STRING, ARRAY, OBJECT, …; null where there is nothing."""
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def string(v: Column, path: str) -> Column:
    """The string at path; null where there is none or something else."""
    x = at(v, path)
    return F.when(kind(x) == "STRING", F.try_variant_get(x, "$", "string"))


def items(v: Column, path: str) -> Column:
    """The elements of the array at path; none where there is no array."""
    x = at(v, path)
    return F.coalesce(F.when(kind(x) == "ARRAY", F.try_variant_get(x, "$", "array<variant>")), F.array().cast("array<variant>"))


def _strings(fields: list[str]):
    return lambda e: F.array(*[string(e, f"$.{f}") for f in fields])


def _block_text(b: Column) -> Column:
    """Strings of one block that are searched, in order; some null."""
    of = string(b, "$.type")
    only = lambda holds, c: F.when(holds, c)
    out = [only(kind(b) == "STRING", F.try_variant_get(b, "$", "string"))]
    out += [F.substring(string(b, f"$.{f}"), 1, TEXT_LIMIT) for f in ("text", "thinking")]
    out += [only(of == t, string(b, f"$.{f}")) for t, fields in BLOCK_FIELDS.items() for f in fields]
    out.append(only((of == "document") & (string(b, "$.source.type") == "text"), string(b, "$.source.data")))
    out.append(only(of == "mcp_tool_result", F.coalesce(string(b, "$.content"), string(b, "$.content.text"))))
    out.append(only(of == "mcp_tool_result", string(b, "$.content.uri")))
    parts = F.array(*out)
    for t, fields in ELEMENT_FIELDS.items():
        inner = F.flatten(F.transform(items(b, "$.content"), _strings(fields)))
        parts = F.concat(parts, F.when(of == t, inner).otherwise(F.array().cast("array<string>")))
    return F.when(of == "image", F.array().cast("array<string>")).otherwise(parts)


def searchable_text(v: Column) -> Column:
    """The text of a message that a search looks into: its blocks, its tool's name, the beginning of its tool's result; joined by spaces."""
    of = string(v, "$.type")
    speaker = of.isin("user", "assistant")
    content = F.concat(F.array(string(v, "$.content")), F.flatten(F.transform(items(v, "$.content"), _block_text)))
    tool = F.array(F.when(of == "assistant", string(v, "$.toolUse.name")))
    result = F.array(*[F.when(speaker, F.substring(string(v, p), 1, RESULT_LIMIT)) for p in ("$.toolUseResult", "$.toolUseResult.stdout", "$.toolUseResult.stderr", "$.toolUseResult.content")])
    return F.array_join(F.concat(content, tool, result), " ")


def tool_ids(v: Column) -> Column:
    """Ids of the tool uses and results of a message, joined by spaces."""
    block = lambda b: F.coalesce(F.when(string(b, "$.type") == "tool_use", string(b, "$.id")), F.when(string(b, "$.type") == "tool_result", string(b, "$.tool_use_id")))
    own = F.array(F.when(string(v, "$.type") == "assistant", string(v, "$.toolUse.id")))
    return F.array_join(F.concat(F.transform(items(v, "$.content"), block), own), " ")


def _present(v: Column, path: str) -> Column:
    x = at(v, path)
    return x.isNotNull() & ~F.is_variant_null(x)


def has_tool_calls(v: Column) -> Column:
    return F.coalesce(_present(v, "$.toolUse") | _present(v, "$.toolUseResult") | F.exists(items(v, "$.content"), lambda b: F.coalesce(string(b, "$.type").isin("tool_use", "tool_result"), F.lit(False))), F.lit(False))


def strings_contain(v: Column, word: str) -> Column:
    """Whether some string value, at any depth and whatever the case, has the word (of ASCII letters); keys don't count."""
    # without escapes a string ends at the next quote, and a key is a string before a colon
    plain = F.regexp_replace(F.to_json(v), r"\\.", "_")
    return F.contains(F.lower(F.regexp_replace(plain, r'"[^"]*+":', "")), F.lit(word))


def has_errors(v: Column) -> Column:
    """An error by type or level, or the word in the reason it stopped or anywhere in its content."""
    by_mark = (string(v, "$.type") == "error") | (string(v, "$.level") == "error")
    return F.coalesce(by_mark, F.lit(False)) | F.coalesce(F.contains(F.lower(string(v, "$.stopReasonSystem")), F.lit("error")), F.lit(False)) | F.coalesce(strings_contain(at(v, "$.content"), "error"), F.lit(False))


def has_file_changes(v: Column) -> Column:
    """Whether a block uses a tool that changes files."""
    return F.exists(items(v, "$.content"), lambda b: F.coalesce((string(b, "$.type") == "tool_use") & string(b, "$.name").isin(FILE_TOOLS), F.lit(False)))
