"""Whole texts as chunks between white space, the unit that token caches hold.

Neither public vocabulary's pre-tokenizer lets a token span a boundary between a word and the white space after it, so a
text's tokens are those of its chunks in turn. A cache belongs to a task and goes with it; it is bounded in bytes, a full
one starts anew, and chunks longer than LONG characters pass it by.

A settled text goes to the tokenizers' words directly: its pre-tokens are found by one pattern over the whole text.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import regex

#: Bytes of chunks and what belongs to them that a task holds at once, and characters of a chunk that is held.
CACHE_BYTES, LONG = 40 << 20, 256
#: Bytes of an entry besides its characters: two objects and their place in the table, about.
ENTRY = 200

#: The pre-tokenizer that byte-level files name by a flag only.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters that str.split() takes for white space and the tokenizers' \s does not.
_ODD = "\x1c\x1d\x1e\x1f"
_SPACE = re.compile("[\\t\\n\\v\\f\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+")
_RUN = re.compile(r"\s\s")
_SPACED = re.compile(r"\s*\S+|\s+\Z")
#: Beyond this block Python's Unicode tables may be of another version than the tokenizer's: composed forms, cases, classes.
_NEWER = re.compile("[^\x00-\u012f]")


def settled(text: str) -> bool:
    """Whether all characters are of blocks (up to Latin letters with marks) that every version of Unicode treats alike."""
    return text.isascii() or not _NEWER.search(text)


def settled_pattern(pattern: str) -> re.Pattern:
    """A pre-tokenizer's pattern for settled text, with its classes written out, so that it doesn't hang on Python's tables."""
    every = [chr(c) for c in range(0x130)]
    for name in ("L", "N"):
        pattern = pattern.replace(rf"\p{{{name}}}", "".join(map(re.escape, regex.findall(rf"\p{{{name}}}", "".join(every)))))
    return re.compile(pattern.replace(r"\s", r"\t\n\v\f\r \x85\xa0"))


def lowered(text: str) -> list[str]:
    """A text that isn't settled cut at white space, for the lower-case vocabulary: settled chunks in lower case, others as
    they are, for the tokenizer's own normalizer."""
    found = [x for x in _SPACE.split(text) if x] if any(c in text for c in _ODD) else text.split()
    return [c.lower() if settled(c) else c for c in found]


def spaced(text: str) -> list[str] | None:
    """Chunks with their white space in front, which join to the text; None if the text must be encoded whole."""
    if any(c in text for c in _ODD):
        return None
    if _RUN.search(text):
        return _SPACED.findall(text)
    parts = text.replace("\n", " \n").split(" ")
    out = [p if p[:1] == "\n" else f" {p}" for p in parts]
    out[0] = parts[0]
    if not out[0]:
        del out[0]
    return out


def words_of(path: str) -> Callable[[str], list[str] | None]:
    """For a tokenizer's file, a function from a text to pieces that can be encoded one by one; None: encode it whole.

    A settled text, or chunk, of a lower-case vocabulary gives its pre-tokens, in lower case.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    if not spec["normalizer"]:
        return spaced
    find = settled_pattern(split_pattern(spec)).findall
    return lambda text: find(text.lower()) if settled(text) else [w for c in lowered(text) for w in (find(c) if settled(c) else (c,))]


def split_pattern(spec: dict) -> str:
    """The pattern by which the file's pre-tokenizer cuts; byte-level files name it by a flag only."""
    pre = spec["pre_tokenizer"]
    steps = pre["pretokenizers"] if pre["type"] == "Sequence" else [pre]
    return next((s["pattern"]["Regex"] for s in steps if s["type"] == "Split"), BYTE_LEVEL)


class Cache:
    """Chunk to whatever encode makes of it; misses of a batch are encoded together."""

    def __init__(self, encode: Callable[[list[str]], list], limit: int = CACHE_BYTES, weigh: Callable[[object], int] = len):
        self.encode, self.limit, self.weigh = encode, limit, weigh
        self.held: dict = {}
        self.bytes = 0

    def load(self, wanted: set[str]) -> Callable[[str], object]:
        """A function that gives what belongs to each of wanted."""
        missing = list(wanted.difference(self.held))
        if not missing:
            return self.held.__getitem__
        made = dict(zip(missing, self.encode(missing), strict=True))
        short = {c: v for c, v in made.items() if len(c) <= LONG} if max(map(len, missing)) > LONG else made
        size = ENTRY * len(short) + sum(map(len, short)) + sum(map(self.weigh, short.values()))
        full = self.bytes + size > self.limit
        if full or len(short) < len(made):
            made |= {c: self.held[c] for c in wanted.difference(made)}  # all of this batch, apart from what is held
        if full:
            self.held, self.bytes = {}, 0
        if size <= self.limit:
            self.held.update(short)
            self.bytes += size
        return (made if full or len(short) < len(made) else self.held).__getitem__
