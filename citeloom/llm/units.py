"""Cutting texts into units that a byte-level tokenizer treats separately.

A unit is a run of non-space characters with the one space before it, or a run
of white space. The public pattern never matches across units, so the ids of a
text are those of its units in order, and units that come back are looked up.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import regex

UNIT = regex.compile(r" ?\S+|\s+(?!\S)|\s+")
_ODD = re.compile(r" \s|[^\S ] ")
_MARKS = frozenset(".,;:!?")


def units(text: str) -> list[str]:
    """Units of a text: a bare word stands for itself after one space; after a tab the unit is as written."""
    if not text:
        return []
    if _ODD.search(text):
        return ["\t" + u for u in UNIT.findall(text)]
    found = text.split(" ")
    if found[0]:
        found[0] = "\t" + found[0]
        return found
    return found[1:]


def pieces(unit: str, split: regex.Pattern) -> list[str]:
    """The pieces that the public pattern cuts a unit in; plain words need no search."""
    if unit[0] == " ":
        word = unit[1:]
        if word.isalpha():
            return [unit]
        if word[:-1].isalpha() and word[-1] in _MARKS:
            return [unit[:-1], word[-1]]
    return split.findall(unit)


class UnitCache:
    """Little-endian unsigned 32-bit ids of units; ``encode`` is asked for new ones in batches.

    At ``limit`` units the cache starts again empty, which bounds its memory.
    """

    def __init__(self, encode: Callable[[list[str]], list[bytes]], limit: int = 400_000) -> None:
        self.encode, self.limit, self.known = encode, limit, {}

    def texts(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > self.limit:
            self.known = {}
        cut = [units(t) for t in texts]
        fresh = list(set().union(*cut).difference(self.known))
        if fresh:
            written = [u[1:] if u[:1] == "\t" else " " + u for u in fresh]
            self.known.update(zip(fresh, self.encode(written)))
        get = self.known.__getitem__
        return [b"".join(map(get, c)) for c in cut]
