"""Text rules of the source database."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_parameter(column: Column) -> Column:
    """Request text without surrounding white space of any kind; blank counts as absent."""
    return F.nullif(F.regexp_replace(column, r"(?U)^\s+|\s+$", ""), F.lit(""))


def joined(values: Column, separator: str = "\n") -> Column:
    """Ascending joined list, null when there is nothing to join."""
    return F.when(F.size(values) > 0, F.array_join(F.sort_array(values), separator))


def contains_like(column: Column, search: str, case_sensitive: bool = True) -> Column:
    """``column LIKE '%' + search + '%'`` with the database's wildcards: ``%``, ``_`` and ``[...]`` sets."""
    if not re.search(r"[%_\[]", search):
        if case_sensitive:
            return F.contains(column, F.lit(search))
        return F.contains(F.lower(column), F.lit(search.lower()))
    return column.rlike(("(?s)" if case_sensitive else "(?isu)") + _like_regex(search))


def _like_regex(pattern: str) -> str:
    out, rest = [], pattern
    while rest:
        bracket = re.match(r"\[(\^?)([^\]]+)\]", rest)
        if bracket:
            members = re.sub(r"([\\\[&^])", r"\\\1", bracket.group(2))
            out.append(f"[{bracket.group(1)}{members}]")
            rest = rest[bracket.end():]
            continue
        out.append({"%": ".*", "_": "."}.get(rest[0]) or re.sub(r"(\W)", r"\\\1", rest[0]))
        rest = rest[1:]
    return "".join(out)
