"""Which messages and sessions are shown: types, roles and kinds of content, brushes, sub-agents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Types of rows that the viewer never shows, and subtypes of system rows that it doesn't.
EXCLUDED_TYPES = ["progress", "queue-operation", "file-history-snapshot", "last-prompt", "pr-link", "agent-name"]
HIDDEN_SUBTYPES = ["stop_hook_summary", "turn_duration"]


def _yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def visible(kind: Column, subtype: Column) -> Column:
    """Rows that the viewer shows: no excluded type, and of system rows those with a subtype that isn't hidden."""
    return ~_yes(kind.isin(EXCLUDED_TYPES)) & (~_yes(kind == "system") | _yes(~subtype.isin(HIDDEN_SUBTYPES)))


def counted(kind: Column, is_meta: Column, is_sidechain: Column, sidechains: bool = False) -> Column:
    """Rows that count as messages of a session: typed, no summary, no excluded type, not meta, and no side chain unless these are wanted."""
    out = kind.isNotNull() & ~_yes(kind == "summary") & ~_yes(kind.isin(EXCLUDED_TYPES)) & ~_yes(is_meta)
    return out if sidechains else out & ~_yes(is_sidechain)


def synthetic_prompt(provider: Column, kind: Column, has_usage: Column, maker: str = "antigravity") -> Column:
    """User rows without usage that this provider's log makes up."""
    return _yes(provider == maker) & _yes(kind == "user") & ~_yes(has_usage)


def chosen(role: Column, has_text: Column, has_thinking: Column, has_tools: Column, is_command: Column, roles: dict[str, bool], kinds: dict[str, bool]) -> Column:
    """Messages of roles and kinds of content that are switched on; a kind or role that isn't named is on.

    A message stays where some kind of content that it has is on; commands count as their own kind only.
    """
    on = lambda name: F.lit(kinds.get(name, True))
    speaks = F.lit(True)
    for name in ("user", "assistant"):
        speaks &= F.lit(roles.get(name, True)) | ~_yes(role == name)
    shown = (_yes(has_text) & on("text")) | (_yes(has_thinking) & on("thinking")) | (_yes(has_tools) & on("tool_calls"))
    return speaks & F.when(_yes(is_command), on("commands")).otherwise(shown)


def brush(kind: str, value: str, card: dict[str, Column]) -> Column:
    """Whether a card matches a brush of a kind (model, tool, status, file, hook, command, mcp) and value.

    card: model, variant, edited_files, shell_commands, mcp_servers (arrays), is_file_edit, is_git, is_error, is_cancelled,
    is_commit, has_hook. A model holds the value; a file is it or ends with it; a command is it. Documents are also cards
    that edited Markdown, code also other file edits, git also git commands.
    """
    variant = _yes(card["variant"] == value) if kind == "tool" else None
    if kind == "model":
        return _yes(F.contains(card["model"], F.lit(value)))
    if kind == "tool" and value == "document":
        return variant | _yes(F.exists(card["edited_files"], lambda f: F.lower(f).rlike(r"\.(md|markdown)\z")))
    if kind == "tool":
        return variant | _yes({"code": card["is_file_edit"], "git": card["is_git"]}.get(value, F.lit(False)))
    if kind == "status":
        return _yes({"error": card["is_error"], "cancelled": card["is_cancelled"], "commit": card["is_commit"]}.get(value, F.lit(False)))
    if kind == "file":
        return _yes(F.exists(card["edited_files"], lambda f: F.endswith(f, F.lit(value))))
    if kind == "hook":
        return _yes(card["has_hook"])
    if kind == "command":
        return _yes(F.array_contains(card["shell_commands"], value))
    if kind == "mcp":
        return _yes(F.size(card["mcp_servers"]) > 0 if value == "all" else F.array_contains(card["mcp_servers"], value))
    return F.lit(False)


def is_sub_agent(file_path: Column) -> Column:
    """Sessions whose file lies below a folder called subagents."""
    return _yes(file_path.rlike(r"[/\\]subagents[/\\]"))
