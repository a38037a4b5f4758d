"""Text helpers with Python's semantics: Unicode white space, no empty tokens, whole strip."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

BREAKS = r"\r\n|[\n\r\x0B\f\x1C-\x1E\x85  ]"
SUPERS, DIGITS = "⁰¹²³⁴⁵⁶⁷⁸⁹", "0123456789"


def bound(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x), x computed once however often f names it."""
    return F.element_at(F.transform(F.array(x), f), 1)


def words(x: Column) -> Column:
    """str.split()."""
    return F.filter(F.split(x, r"(?U)\s+"), lambda t: t != "")


def word_count(x: Column) -> Column:
    return F.size(words(x))


def strip(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def rstrip(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)\s+$", "")


def collapse(x: Column) -> Column:
    """Runs of white space to one space, none at the ends."""
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def alias_key(x: Column) -> Column:
    return F.upper(collapse(x))


def lines(x: Column) -> Column:
    """str.splitlines(): no last line after a final break."""
    parts = F.split(x, BREAKS)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def superscript_digits(x: Column) -> Column:
    return F.translate(x, SUPERS, DIGITS)


def ratio(a: Column, b: Column) -> Column:
    """max / min, null where the smaller is 0 or either is null."""
    return F.when(a.isNotNull() & b.isNotNull(), F.try_divide(F.greatest(a, b).cast("double"), F.least(a, b).cast("double")))


def tokens(x: Column, marks: str) -> Column:
    """Lower-cased words without marks at their ends, empty ones dropped."""
    inside = "".join("\\" + m for m in marks)
    bare = F.transform(words(F.lower(x)), lambda t: F.regexp_replace(t, f"^[{inside}]+|[{inside}]+$", ""))
    return F.filter(bare, lambda t: t != "")


def ends_with_any(t: Column, suffixes: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [t.endswith(s) for s in suffixes])


def sentinel_split(x: Column, pattern: str, keep: str) -> Column:
    """re.split() with a kept group: an array of 'marker U+0002 text', its first item the text before any marker."""
    return F.split(F.regexp_replace(x, pattern, "\u0001" + keep + "\u0002"), "\u0001")
