"""File edits found in raw messages: what was written or replaced where, with the text after it, and lines added and removed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Tools that write or edit, keys that name the file and hold the new text, marks of files in a patch.
WRITES = ["write", "create_file", "write_to_file"]
EDITS = ["edit", "multiedit", "replace_file_content", "replace", "apply_patch"]
PATHS = ["file_path", "path", "filePath", "TargetFile", "target_file"]
CONTENTS = ["content", "new_string", "newString", "patch"]
FILE_MARKS = r"^(?:\*\*\* (?:Update|Add|Delete) File: |\+\+\+ |--- )(.*)$"

EDIT = "struct<op string, file_path string, content string, original string, lines_added int, lines_removed int>"


def line_count(c: Column) -> Column:
    """Lines of a text; an end of line at its end begins no other one."""
    ends = F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))
    return (ends + F.when((c != "") & ~F.endswith(c, F.lit("\n")), 1).otherwise(0)).cast("int")


def replace_first(text: Column, old: Column, new: Column) -> Column:
    """text with the first `old` replaced; an empty one is found at the beginning."""
    at = F.call_function("position", old, text)
    return F.when(at > 0, F.concat(F.substr(text, F.lit(1), at - 1), new, F.substr(text, at + F.length(old)))).otherwise(text)


def _any(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def _text(v: Column, path: str) -> Column:
    """The string at path; null where there is none or something else."""
    x = _any(v, path)
    return F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string"))


def _filled(v: Column, root: str, keys: list[str]) -> Column:
    """The first of the keys that has a string with something in it."""
    return F.coalesce(*[F.nullif(_text(v, f"{root}.{k}"), F.lit("")) for k in keys])


def _edit(op, path, content, original, added, removed) -> Column:
    """The edit as a struct, of columns or names."""
    null = F.lit(None).cast("string")
    return F.struct(op.alias("op"), path.alias("file_path"), content.alias("content"), (null if original is None else original).alias("original"), added.cast("int").alias("lines_added"), removed.cast("int").alias("lines_removed"))


def of_results(v: Column) -> Column:
    """Edits that a message's own tool result and tool use say (an array)."""
    r = "$.toolUseResult"
    path, original = _text(v, f"{r}.filePath"), _text(v, f"{r}.originalFile")
    content, old, new = _text(v, f"{r}.content"), _text(v, f"{r}.oldString"), _text(v, f"{r}.newString")
    created = F.when((_text(v, f"{r}.type") == "create") & path.isNotNull() & content.isNotNull(), _edit(F.lit("write"), path, content, None, line_count(content), F.lit(0)))
    many = _any(v, f"{r}.edits")
    steps = F.filter(F.coalesce(F.try_variant_get(v, f"{r}.edits", "array<variant>"), F.array().cast("array<variant>")), lambda e: _text(e, "$.old_string").isNotNull() & _text(e, "$.new_string").isNotNull())
    start = F.struct(original.alias("text"), F.lit(0).alias("added"), F.lit(0).alias("removed"))

    def step(s: Column, e: Column) -> Column:
        before, after = _text(e, "$.old_string"), _text(e, "$.new_string")
        return F.struct(replace_first(s["text"], before, after).alias("text"), (s["added"] + line_count(after)).alias("added"), (s["removed"] + line_count(before)).alias("removed"))

    done = F.aggregate(steps, start, step)
    several = F.when(path.isNotNull() & many.isNotNull() & original.isNotNull(), _edit(F.lit("edit"), path, done["text"], original, done["added"], done["removed"]))
    one = F.when(path.isNotNull() & many.isNull() & old.isNotNull() & new.isNotNull() & original.isNotNull(), _edit(F.lit("edit"), path, replace_first(original, old, new), original, line_count(new), line_count(old)))
    target, said = _text(v, "$.toolUse.input.file_path"), _text(v, "$.toolUse.input.content")
    written = F.when((_text(v, "$.toolUse.name") == "Write") & target.isNotNull() & said.isNotNull(), _edit(F.lit("write"), target, said, None, line_count(said), F.lit(0)))
    return F.filter(F.array(created, several, one, written), lambda e: e.isNotNull())


def patch_files(patch: Column) -> Column:
    """Files that a patch names, each once, in order."""
    found = F.regexp_extract_all(patch, F.lit("(?m)" + FILE_MARKS), F.lit(1))
    trimmed = F.transform(found, lambda p: F.regexp_replace(p, r"^\s+|\s+$", ""))
    named = F.filter(trimmed, lambda p: ~p.isin("", "/dev/null"))
    return F.array_distinct(F.transform(named, lambda p: F.regexp_replace(p, "^[ab]/", "")))


def placed(path: Column, cwd: Column) -> Column:
    """A relative path under cwd."""
    return F.when(F.startswith(path, F.lit("/")) | cwd.isNull(), path).otherwise(F.concat(F.regexp_replace(cwd, "/$", ""), F.lit("/"), path))


def of_use(use: Column, cwd: Column) -> Column:
    """Edits that one tool use (name, input) asks for (an array): a patch gives one for each file that it names."""
    name = F.lower(_text(use, "$.name"))
    op = F.when(name.isin(WRITES), "write").when(name.isin(EDITS), "edit")
    patch = _filled(use, "$.input", ["patch"])
    rows = F.split(F.coalesce(patch, F.lit("")), "\n")
    starts = lambda sign: F.size(F.filter(rows, lambda x: F.startswith(x, F.lit(sign)) & ~F.startswith(x, F.lit(sign * 3))))
    patched = F.transform(patch_files(F.coalesce(patch, F.lit(""))), lambda p: _edit(op, placed(p, cwd), patch, None, starts("+"), starts("-")))
    path, content = _filled(use, "$.input", PATHS), F.coalesce(_filled(use, "$.input", CONTENTS), F.to_json(_any(use, "$.input")), F.lit("{}"))
    old = _filled(use, "$.input", ["old_string", "oldString"])
    single = F.when(path.isNotNull(), F.array(_edit(op, placed(path, cwd), content, None, line_count(content), F.coalesce(line_count(old), F.lit(0)))))
    none = F.array().cast(f"array<{EDIT}>")
    return F.when(op.isNull(), none).when(name == "apply_patch", patched).otherwise(F.coalesce(single, none))


def edits(messages: DataFrame, raw: str = "raw", cwd: str | None = None) -> DataFrame:
    """One row an edit: the message's other columns, place among its edits, op, file_path, content, original, lines_added, lines_removed.

    raw: the message as JSON; what is no JSON has no edits. Stores that record no results say edits by tool uses: in
    content, and as the message's own; these are placed under cwd (a column).
    """
    v = F.try_parse_json(raw)
    base = F.col(cwd).cast("string") if cwd else F.lit(None).cast("string")
    if cwd:
        items = F.coalesce(F.try_variant_get("_v", "$.content", "array<variant>"), F.array().cast("array<variant>"))
        uses = F.filter(items, lambda i: _text(i, "$.type") == "tool_use")
        own = F.when(_any(F.col("_v"), "$.toolUse").isNotNull(), of_use(_any(F.col("_v"), "$.toolUse"), base)).otherwise(F.array().cast(f"array<{EDIT}>"))
        found = F.concat(F.flatten(F.transform(uses, lambda u: of_use(u, base))), own)
    else:
        found = of_results(F.col("_v"))
    kept = [c for c in messages.columns if c != raw]
    out = messages.withColumn("_v", v).where("_v is not null").select(*kept, F.posexplode(found).alias("place", "_e"))
    return out.select(*kept, "place", "_e.*")


def recent(found: DataFrame, by: str = "ts", cwd: str | None = None, offset: int = 0, limit: int = 20) -> DataFrame:
    """The latest edit of each file under cwd (of one time the first of its message), newest first, one page; with the numbers of edits and files in all."""
    if cwd is not None:
        found = found.where(F.startswith("file_path", F.lit(cwd)))
    columns = [c for c in found.columns if c != "file_path"]
    latest = found.groupBy("file_path").agg(F.max_by(F.struct(*columns), F.struct(by, -F.col("place"))).alias("_e"), F.count("*").alias("edits"))
    totals = latest.agg(F.coalesce(F.sum("edits"), F.lit(0)).alias("total_edits"), F.count("*").alias("unique_files"))
    # one row
    rows = latest.select("file_path", "edits", "_e.*").crossJoin(F.broadcast(totals))
    return rows.orderBy(F.desc(by), "file_path").offset(offset).limit(limit)
