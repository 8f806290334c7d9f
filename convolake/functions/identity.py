"""What names a project or a message: remote addresses, root commits, identity keys, message keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import ascii_lower

# Schemes of remotes that name a host.
SCHEMES = ["http", "https", "ssh", "git"]


def _trim(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def _before(c: Column, mark: str) -> Column:
    """What stands before the first mark; all of it where there is none."""
    return F.substring_index(c, mark, 1)


def _after(c: Column, mark: str) -> Column:
    """What stands after the first mark; nothing where there is none."""
    at = F.instr(c, mark)
    return F.when(at > 0, F.substr(c, at + len(mark))).otherwise("")


def remote_url(raw: Column) -> Column:
    """A git remote as host/path, whatever form it is given in; null where it names no host.

    Forms: a URL of a known scheme, user@host:path, host:path, and what this function gives (so it may be applied again).
    The user is dropped, the host in lower case and with its port; its name needs a dot and no empty label. The path loses
    slashes around it and .git at its end.
    """
    s = _trim(raw)
    schemed = F.contains(s, F.lit("://"))
    known = ascii_lower(_before(s, "://")).isin(SCHEMES)
    rest = _after(s, "://")
    colon, slash = F.instr(s, ":"), F.instr(s, "/")
    early = (colon > 0) & ((slash == 0) | (colon < slash))
    front, back = _before(s, ":"), _after(s, ":")
    port = _before(back, "/")
    ported = ~F.contains(front, F.lit("@")) & port.rlike(r"^[0-9]+\z")
    host = F.when(schemed, F.when(known, _before(rest, "/"))).when(early & ported, F.when(F.contains(back, F.lit("/")), F.concat(front, F.lit(":"), port))).when(early, front).when(slash > 0, _before(s, "/"))
    path = F.when(schemed, _after(rest, "/")).when(early & ported, _after(back, "/")).when(early, back).otherwise(_after(s, "/"))
    host = ascii_lower(F.regexp_replace(host, r"(?s)^.*@", ""))
    named = _before(host, ":").rlike(r"(?s)^[^.]+(?:\.[^.]+)+\z")
    path = F.regexp_replace(path, r"^/+|/+\z", "")
    path = F.regexp_replace(F.regexp_replace(path, r"\.git\z", ""), r"/+\z", "")
    return F.when(named & (path != ""), F.concat(host, F.lit("/"), path))


def root_commit(raw: Column) -> Column:
    """A full hash of 40 hexadecimal digits in lower case, else null."""
    s = _trim(raw)
    return F.when(s.rlike(r"^[0-9A-Fa-f]{40}\z"), ascii_lower(s))


def identity_key(root: Column, remote: Column) -> Column:
    """g:root|remote, g:root or r:remote, of what is valid; null of neither."""
    r, m = root_commit(root), remote_url(remote)
    return F.when(r.isNotNull() & m.isNotNull(), F.concat(F.lit("g:"), r, F.lit("|"), m)).when(r.isNotNull(), F.concat(F.lit("g:"), r)).when(m.isNotNull(), F.concat(F.lit("r:"), m))


def is_blob_id(c: Column) -> Column:
    return c.rlike(r"^[0-9a-f]{40}\z")


def message_key(provider: Column, session_id: Column, ts: Column, kind: Column, seq: Column, content: Column, tool_use: Column, tool_result: Column) -> Column:
    """SHA-256 that tells a message at a place of its session: four texts each before a NUL, the place as four bytes (the
    lowest first), then content, tool use and tool result as compact JSON each before 1, 2 and 3, where there is one."""
    nul = lambda c: F.concat(F.encode(F.coalesce(c, F.lit("")), "UTF-8"), F.unhex(F.lit("00")))
    part = lambda c, n: F.when(c.isNotNull(), F.concat(F.encode(c, "UTF-8"), F.unhex(F.lit(f"0{n}")))).otherwise(F.unhex(F.lit("")))
    digits = F.lpad(F.hex(seq.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")
    place = F.unhex(F.concat(*[F.substring(digits, i, 2) for i in (7, 5, 3, 1)]))
    return F.sha2(F.concat(*[nul(c) for c in (provider, session_id, ts, kind)], place, part(content, 1), part(tool_use, 2), part(tool_result, 3)), 256)
