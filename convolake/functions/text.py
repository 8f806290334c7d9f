"""Text functions inside the JVM: tokens, queries, identities, formats."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, _UPPER, _LOWER)


def contains_ascii_ci(c: Column, query: str) -> Column:
    """Substring, where case counts only outside A-Z."""
    return F.contains(ascii_lower(c), F.lit(query.translate(str.maketrans(_UPPER, _LOWER))))


def tokens(c: Column) -> Column:
    """Lower-case words: runs of letters, digits and underscores."""
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}_]+"), lambda t: t != "")


@dataclass
class Query:
    """A search as a disjunction of conjunctions of words, phrases and their negations."""

    groups: list[list[tuple[bool, str]]] = field(default_factory=list)
    prefix: list[str] | None = None

    def words(self) -> list[str]:
        out = [w for g in self.groups for yes, p in g if yes for w in p.split()]
        return sorted(set(out) | set(self.prefix or []))


def parse_query(text: str) -> Query:
    """Words are joined by AND; OR, -word and "phrases" as in a web search.

    Without quotes, OR or a minus the words also match as prefixes, all of them. A blank query is an error.
    """
    if not text.strip():
        raise ValueError("empty query")
    groups, current = [], []
    for minus, phrase, word in re.findall(r'(-?)(?:"([^"]*)"|(\S+))', text):
        if word == "OR" and not minus:
            groups.append(current)
            current = []
            continue
        said = " ".join(re.findall(r"[^\W]+", (phrase or word).lower()))
        if said:
            current.append((not minus, said))
    groups = [g for g in [*groups, current] if g]
    plain = not re.search(r'"|\bOR\b|(^|\s)-', text)
    return Query(groups, re.findall(r"\w+", text.lower()) if plain else None)


def matches(toks: Column, q: Query) -> Column:
    """Whether a token list satisfies the query, exactly or by prefixes."""
    said = F.concat(F.lit(" "), F.array_join(toks, " "), F.lit(" "))
    out = F.lit(False)
    for g in q.groups:
        one = F.lit(True)
        for yes, phrase in g:
            has = F.contains(said, F.lit(f" {phrase} "))
            one = one & (has if yes else ~has)
        out = out | one
    if q.prefix:
        all_ = F.lit(True)
        for w in q.prefix:
            all_ = all_ & F.contains(said, F.lit(f" {w}"))
        out = out | all_
    return out


def rank(toks: Column, q: Query) -> Column:
    """Occurrences of the query's words over 1 + ln(1 + length)."""
    hits = F.size(F.filter(toks, lambda t: t.isin(q.words()) if q.words() else F.lit(False)))
    return F.round(hits / (1 + F.log(1.0 + F.size(toks))), 6)


def occurrences(text: Column, query: str) -> Column:
    """Non-overlapping occurrences, whatever the case."""
    low = F.lower(text)
    q = query.lower()
    return ((F.length(low) - F.length(F.replace(low, F.lit(q), F.lit("")))) / len(q)).cast("int")


def snippet(text: Column, query: str, around: int = 40) -> Column:
    """The text around the first occurrence."""
    at = F.instr(F.lower(text), query.lower())
    return F.when(at > 0, F.substr(text, F.greatest(at - around, F.lit(1)), F.lit(2 * around + len(query))))


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]+)[/\\]*$", 1)


def glob_regex(pattern: str) -> str | None:
    """* and ? as a whole-string pattern; None if over 256 characters or 10 wildcards: it matches nothing."""
    if len(pattern) > 256 or sum(c in "*?" for c in pattern) > 10:
        return None
    return "^" + "".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in pattern) + "$"


def clamp_bytes(c: Column, limit: int = 65_536) -> Column:
    """At most `limit` bytes of UTF-8, cut between characters."""
    raw = F.encode(c, "UTF-8")
    # step back over continuation bytes (10xxxxxx) at the cut: at most three
    cut = F.lit(limit)
    for back in range(3, -1, -1):
        byte = F.conv(F.hex(F.substring(raw, limit + 1 - back, 1)), 16, 10).cast("int")
        cut = F.when(byte.bitwiseAND(F.lit(0xC0)) != 0x80, F.lit(limit - back)).otherwise(cut) if back < 3 else F.lit(limit - 3)
    return F.when(F.octet_length(c) <= limit, c).otherwise(F.decode(F.substr(raw, F.lit(1), cut), "UTF-8"))


def replace_nul(c: Column) -> Column:
    """U+0000 as U+FFFD, also where JSON escapes it, in keys and values of any depth."""
    plain = F.replace(c, F.lit("\0"), F.lit("�"))
    return F.regexp_replace(plain, r"(?<!\\)((?:\\\\)*+)\\u0000", "$1�")


def like_path(path: Column) -> Column:
    """Home directories as ~."""
    return F.regexp_replace(path, r"^/(?:home|Users)/[^/]+", "~")


# Raw entry points and their kinds.
ENTRYPOINTS = {"cli": "cli", "copilot-cli": "cli", "claude-vscode": "vscode", "copilot-vscode": "vscode", "claude-desktop": "desktop", "copilot-desktop": "desktop"}


def entrypoint_kind(c: Column) -> Column:
    """Kind of a raw entry point, as it is written; others are null."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in ENTRYPOINTS.items() for x in pair]), c)


def entrypoint_matches(c: Column, wanted: str) -> Column:
    """Whether a raw entry point passes the filter: all, or one kind."""
    return F.lit(True) if wanted == "all" else F.coalesce(entrypoint_kind(c) == wanted, F.lit(False))
