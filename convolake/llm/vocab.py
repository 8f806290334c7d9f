"""Byte-level BPE vocabulary files and the pre-split that comes before merges."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import regex

#: The pattern that splits text into pre-tokens.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: The same split for texts of ASCII and Latin letters alone, where the standard library's classes agree.
_LATIN = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+").findall
_NOT_LATIN = re.compile("[\x1c-\x1f\x80-\xbf\u0250-\U0010ffff]").search

#: Kinds of the bytes of such texts: letters (all bytes of Latin letters too), digits, white space, the rest.
_LETTER, _DIGIT, _WHITE = 1, 2, 3
_KIND = np.zeros(256, dtype=np.uint8)
_KIND[[b for b in range(128) if chr(b).isalpha()] + list(range(128, 256))] = _LETTER
_KIND[list(b"0123456789")] = _DIGIT
_KIND[list(b" \t\n\r\f\v")] = _WHITE
#: Bytes that only other texts have; U+0250 to U+027F begin with a byte of Latin letters (0xC9) and are looked for apart.
_OTHER = np.zeros(256, dtype=bool)
_OTHER[[*range(0x1C, 0x20), 0xC2, *range(0xCA, 0x100)]] = True

#: Words, and characters of words, that a worker remembers; beyond either the memory is emptied, so it stays bounded.
REMEMBERED, REMEMBERED_CHARS = 500_000, 1 << 23


class Memory(dict):
    """Words a worker has met, with a bound on their number and on their characters."""

    chars = 0

    def keep(self, pairs) -> None:
        for word, value in pairs:
            self[word] = value
            self.chars += len(word)

    def make_room(self, needed=()) -> None:
        """Empty the memory if it is over its bound, but for the words needed next."""
        if len(self) > REMEMBERED or self.chars > REMEMBERED_CHARS:
            kept = [(w, self[w]) for w in needed if w in self]
            self.clear()
            self.chars = 0
            self.keep(kept)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@dataclass(frozen=True)
class Vocabulary:
    byte_ids: tuple  # id of each single byte
    merges: tuple  # (left id, right id, merged id), by rank
    labels: dict  # id -> bytes, special tokens too
    special: dict  # string -> id


@lru_cache(maxsize=4)
def load(path: str) -> Vocabulary:
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    # printable Latin-1 characters stand for themselves, the other bytes for U+0100 onwards
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    to_byte = {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}
    vocab = spec["model"]["vocab"]
    as_bytes = {s: bytes(to_byte[c] for c in s) for s in vocab}
    single = {as_bytes[s]: i for s, i in vocab.items() if len(s) == 1}
    pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
    merges = tuple((vocab[a], vocab[b], vocab[a + b]) for a, b in pairs)
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", []) if t.get("special")}
    labels = {i: as_bytes[s] for s, i in vocab.items()} | {i: s.encode() for s, i in special.items()}
    return Vocabulary(tuple(single[bytes([b])] for b in range(256)), merges, labels, special)


def splitter(special: dict):
    """A function from text to pre-tokens; special strings come out whole, as the library takes them."""
    any_text = regex.compile(PATTERN).findall

    def find(text: str) -> list[str]:
        return any_text(text) if _NOT_LATIN(text) else _LATIN(text)

    if not special:
        return find
    marks = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True)) + ")")
    quick = min(special, key=len)[:2]

    def split(text: str) -> list[str]:
        if quick not in text or not marks.search(text):
            return find(text)
        out = []
        for n, part in enumerate(marks.split(text)):
            out += [part] if n % 2 else find(part)
        return out

    return split


def not_latin(data: np.ndarray) -> np.ndarray:
    """Positions, ascending, in UTF-8 bytes of which none is in a text of ASCII and Latin letters alone."""
    other = _OTHER[data]
    high = np.flatnonzero(data[:-1] == 0xC9)
    other[high[data[high + 1] >= 0x90]] = True
    return np.flatnonzero(other)


def word_starts(data: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Where the pre-tokens begin that splitter() finds in texts of ASCII and Latin letters alone, without special strings.

    data holds the texts' UTF-8 bytes one after another, texts where each begins and, last, the end of data.
    """
    n = len(data)
    kind = _KIND[data]
    signs = np.flatnonzero(data[:-1] == 0xC3)
    signs = signs[np.isin(data[signs + 1], (0x97, 0xB7))]  # of multiplication and division
    kind[signs] = kind[signs + 1] = 0
    begins = np.zeros(n, dtype=bool)
    begins[texts[texts < n]] = True
    first = begins.copy()
    first[1:] |= kind[1:] != kind[:-1]
    # the last of a run of white space goes with what follows if it is a space, and is a word of its own if not
    after = np.flatnonzero(first & ~begins & (kind != _WHITE))
    after = after[kind[after - 1] == _WHITE]
    first[after - 1] = True
    first[after[data[after - 1] == 0x20]] = False
    # 's 't 'm 'd 're 've 'll
    mark = np.flatnonzero((data == 0x27) & first)
    if len(mark):
        left = texts[np.searchsorted(texts, mark, side="right")] - mark
        one, two = data[np.minimum(mark + 1, n - 1)], data[np.minimum(mark + 2, n - 1)]
        short = (left > 1) & np.isin(one, list(b"stmd"))
        long = (left > 2) & (((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l")))
        first[mark[short | long] + 1] = False
        ends = np.concatenate((mark[short] + 2, mark[long] + 3))
        first[ends[ends < n]] = True
    return np.flatnonzero(first)


def chunks_of(texts: list, size: int = 1 << 20):
    """Runs of texts of about size characters together."""
    part, n = [], 0
    for t in texts:
        part.append(t or "")
        n += len(part[-1])
        if n >= size:
            yield part
            part, n = [], 0
    if part:
        yield part
