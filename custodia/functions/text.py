"""String predicates built from driver-side patterns."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_to_regex(pattern: str) -> str:
    """Anchored Java regex for a shell-style glob (``*`` and ``?``; a star also spans dots)."""
    body = "".join(".*" if ch == "*" else "." if ch == "?" else re.escape(ch) for ch in pattern)
    return f"(?s)^{body}$"


def contains_any(c: Column, words: Iterable[str]) -> Column:
    """True when any word occurs in ``c`` (plain substring, no regex)."""
    out = F.lit(False)
    for word in words:
        out = out | c.contains(word)
    return out


def first_match(c: Column, ladder: Iterable[tuple[Iterable[str], str]], default: str | None) -> Column:
    """Value of the first rung whose words occur in ``c``."""
    out = None
    for words, value in ladder:
        cond = contains_any(c, words)
        out = F.when(cond, F.lit(value)) if out is None else out.when(cond, F.lit(value))
    return out.otherwise(F.lit(default))


def tags(*pairs: tuple[Column, str]) -> Column:
    """Array of the labels whose condition holds, in the order given."""
    return F.array_compact(F.array(*[F.when(cond, F.lit(label)) for cond, label in pairs]))


def lit_array(values: Iterable[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def lit_map(mapping: dict[str, object]) -> Column:
    parts: list[Column] = []
    for key, value in mapping.items():
        parts += [F.lit(key), lit_array(value) if isinstance(value, (list, tuple)) else F.lit(value)]
    return F.create_map(*parts)
