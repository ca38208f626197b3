"""Hierarchical paths: ``top.unit.bus[7:0]``."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def parent(path: Column) -> Column:
    """Empty for a path without a dot."""
    return F.when(F.instr(path, ".") > 0, F.regexp_replace(path, r"\.[^.]*$", "")).otherwise(F.lit(""))


def leaf(path: Column) -> Column:
    return F.substring_index(path, ".", -1)


def without_top(path: Column) -> Column:
    return F.regexp_replace(path, r"^TOP\.", "")


def base(path: Column) -> Column:
    """Up to the first bracket."""
    return F.substring_index(path, "[", 1)


def ancestors(path: Column) -> Column:
    """All proper prefixes at dots and the path itself."""
    parts = F.split(path, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "."))


def contains_any_case(name: Column, part: str) -> Column:
    return F.contains(F.lower(name), F.lit(part.lower()))


def equals_any_case(name: Column, other: str) -> Column:
    return F.lower(name) == other.lower()


def lines(text: Column) -> Column:
    """Items of a list that is stored with a line for each; none in an empty or null text."""
    return F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(text, "\n"))


def glob(pattern: str) -> str:
    """Regular expression of a pattern with * and ?, for the whole path."""
    return "^" + "".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in pattern) + "$"


def span(bit_map: Column) -> tuple[Column, Column]:
    """High and low bit of ``[hi:lo]`` or ``[n]``, in either direction; nulls where there is none."""
    first = F.regexp_extract(bit_map, r"\[(\d+)", 1)
    last = F.regexp_extract(bit_map, r"\[\d+:(\d+)\]", 1)
    x = F.when(first != "", first.cast("int"))
    y = F.when(last != "", last.cast("int")).otherwise(x)
    return F.greatest(x, y), F.least(x, y)


def show_span(hi: Column, lo: Column) -> Column:
    return F.when(hi == lo, F.concat(F.lit("["), hi.cast("string"), F.lit("]"))).otherwise(F.concat(F.lit("["), hi.cast("string"), F.lit(":"), lo.cast("string"), F.lit("]")))


def split_select(signal: str) -> tuple[str, tuple[int, int] | None]:
    """``a.b[7:4]`` to its path and (high, low)."""
    m = re.fullmatch(r"(.*)\[(\d+)(?::(\d+))?\]", signal)
    if not m:
        return signal, None
    a = int(m[2])
    b = int(m[3]) if m[3] is not None else a
    return m[1], (max(a, b), min(a, b))


#: left side of an assignment's text
ASSIGNED = r"^\s*(?:assign\s+)?(.*?)\s*(?:<=|(?<![<>=!])=(?!=))"


def assigned(text: Column, scope: Column) -> Column:
    """Path that an assignment writes: a name with dots as it is, else a sibling within the scope."""
    name = F.regexp_replace(F.regexp_extract(text, ASSIGNED, 1), r"\[.*$", "")
    return F.when(name == "", F.lit(None)).when(F.instr(name, ".") > 0, name).when(scope == "", name).otherwise(F.concat(scope, F.lit("."), name))
