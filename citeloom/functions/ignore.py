"""Ordered ignore patterns as column expressions.

Patterns follow the rules of ignore files: the last pattern that matches decides,
``!`` takes back, a slash at the end means folders only, a slash elsewhere ties
the pattern to its folder, ``**`` crosses folders, and nothing below an ignored
folder can be taken back. Upper and lower case are alike.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _translated(glob: str) -> str:
    """A glob as a regular expression of one path."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("/**/", i):
            out, i = out + "/(?:[^/]+/)*", i + 4
        elif glob.startswith("**/", i) and i == 0:
            out, i = out + "(?:[^/]+/)*", i + 3
        elif glob[i:] == "/**":
            return out + "/.+"
        elif c == "*":
            begins = i == 0 or glob[i - 1] == "/"
            while i < len(glob) and glob[i] == "*":
                i += 1
            out += "[^/]+" if begins and (i == len(glob) or glob[i] == "/") else "[^/]*"
        elif c == "[" and (m := re.match(r"\[([!^]?)((?:\\.|[^\]\\/])(?:\\.|[^\]\\/])*)\]", glob[i:])):
            inner = re.sub(r"([\[&])", r"\\\1", m[2])
            out, i = out + f"[{'^/' if m[1] else ''}{inner}]", i + m.end()
        else:
            i += c == "\\" and i + 1 < len(glob)
            out, i = out + ("[^/]" if c == "?" else re.sub(r"([^A-Za-z0-9_/\s-])", r"\\\1", glob[i])), i + 1
    return out


def rule(line: str, folder: str = "") -> tuple[str, bool] | None:
    """(regular expression, whether it ignores) of a line of the ignore file in ``folder``; None if it says nothing."""
    line = re.sub(r"(?<!\\)\s+$", "", line.rstrip("\r\n"))
    if not line or line.startswith("#"):
        return None
    ignores = not line.startswith("!")
    glob = line if ignores else line[1:]
    folders_only = glob.endswith("/")
    glob = glob.rstrip("/") if folders_only else glob
    tied = "/" in glob
    glob = glob.lstrip("/")
    if not glob:
        return None
    base = re.sub(r"([^A-Za-z0-9_/-])", r"\\\1", folder.strip("/") + "/") if folder.strip("/") else ""
    anywhere = "" if tied else "(?:[^/]+/)*"
    return f"(?i)^{base}{anywhere}{_translated(glob)}{'/' if folders_only else '/?'}$", ignores


def rules(text: str | Iterable[str], folder: str = "") -> list[tuple[str, bool]]:
    """Rules of an ignore file, in order."""
    lines = text.split("\n") if isinstance(text, str) else text
    return [r for line in lines if (r := rule(line, folder))]


def is_ignored(path: Column, ordered: list[tuple[str, bool]]) -> Column:
    """Whether a file, or a folder that it is in, is ignored by the last rule that matches it."""
    parts = F.split(path, "/")
    upto = lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")
    entries = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.concat(upto(n), F.when(n < F.size(parts), "/").otherwise("")))

    def decided(entry: Column) -> Column:
        if not ordered:
            return F.lit(False)
        chain = None
        for pattern, ignores in reversed(ordered):
            hit = entry.rlike(pattern)
            chain = F.when(hit, ignores) if chain is None else chain.when(hit, ignores)
        return chain.otherwise(False)

    return F.exists(entries, decided)
