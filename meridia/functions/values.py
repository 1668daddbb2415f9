"""What counts as blank, and safe parsing."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spellings of "no value" by policy; ``exact`` policies compare as written, others in lower case without outer space.
BLANK = {
    "sql": ("exact", ("",)),
    "queue": ("exact", ("", "UNAVAILABLE")),
    "invoice": ("exact", ("", "UNAVAILABLE", "UNAPPLICABLE")),
    "batch": ("loose", ("", "unavailable", "nan", "null", "n/a", "na", "unapplicable")),
}


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once a row, however often it is named."""
    return F.element_at(F.transform(F.array(value), use), 1)


def strip(c: Column) -> Column:
    """Without outer white space of any kind."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def text(c: Column) -> Column:
    """Stripped; '' for null."""
    return strip(F.coalesce(c, F.lit("")))


def is_blank(c: Column, policy: str = "sql") -> Column:
    mode, values = BLANK[policy]
    return F.coalesce(c if mode == "exact" else F.lower(strip(c)), F.lit("")).isin(*values)


def status_or_draft(c: Column) -> Column:
    return F.when(is_blank(c), F.lit("Draft")).otherwise(c)


def number(c: Column) -> Column:
    """A finite number written in digits, else null."""
    return F.when(strip(c).rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), strip(c).try_cast("double"))


def any_of(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns)


def compact(*columns: Column) -> Column:
    """The non-null ones as an array."""
    return F.array_compact(F.array(*columns))


def guid_of(whole: Column) -> Column:
    """An id in braces, in the form of a GUID, that follows from a text."""
    digits = F.upper(F.substring(F.sha2(whole, 256), 1, 32))
    return F.concat(F.lit("{"), F.regexp_replace(digits, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit("}"))
