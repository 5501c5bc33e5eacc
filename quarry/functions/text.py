"""Small column helpers: glob patterns, dict-in-a-string lookup, list literals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


_META = set(".^$*+?()[]{}|\\")


def glob_to_regex(pattern: str) -> str:
    """Shell-style glob (``*``, ``?``, ``[seq]``, ``[!seq]``) as an anchored
    regex in the subset Java and RE2 share. Case-sensitive, like POSIX fnmatch."""
    out, i, n = [], 0, len(pattern)
    while i < n:
        c = pattern[i]
        i += 1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[":
            j = i
            if j < n and pattern[j] == "!":
                j += 1
            if j < n and pattern[j] == "]":
                j += 1
            while j < n and pattern[j] != "]":
                j += 1
            if j >= n:
                out.append(r"\[")
            else:
                body = pattern[i:j].replace("\\", r"\\")
                if body.startswith("!"):
                    body = "^" + body[1:]
                elif body.startswith("^"):
                    body = "\\" + body
                out.append(f"[{body}]")
                i = j + 1
        else:
            out.append("\\" + c if c in _META else c)
    return "^(?:" + "".join(out) + ")$"


def globs_regex(patterns: Sequence[str] | None) -> str | None:
    """One regex matching any of the globs (None when there are none)."""
    if not patterns:
        return None
    return "|".join(f"(?:{glob_to_regex(p)})" for p in patterns)


def matches_any_glob(c: Column, patterns: Sequence[str] | None) -> Column:
    rx = globs_regex(patterns)
    return F.lit(False) if rx is None else F.coalesce(c.rlike(rx), F.lit(False))


def dict_lookup(text: Column, key: Column) -> Column:
    """Parse a dict held in a string and return the entry named by ``key``;
    NULL text, text that is not a dict, malformed text or a missing key give
    NULL. Values come back as text."""
    return F.try_element_at(F.from_json(text, "map<string,string>"), key)


def list_literal(text: Column) -> Column:
    """``'["a", "b"]'`` -> ``["a", "b"]``; any other value -> ``[value]``
    (also text that looks like a list but does not parse)."""
    parsed = F.from_json(text, "array<string>")
    return F.when(text.isNull(), F.lit(None).cast("array<string>")).when(
        text.startswith("[") & text.endswith("]") & parsed.isNotNull(), parsed
    ).otherwise(F.array(text))
