"""Text helpers as column expressions. Blank means null, empty or white space only, of any Unicode kind."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: All white space, as Java matches it with the Unicode flag.
SPACE = r"(?U)\s+"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def squeeze(c: Column) -> Column:
    """Stripped, with every run of white space as one space."""
    return F.trim(F.regexp_replace(c, SPACE, " "))


def is_blank(c: Column) -> Column:
    return F.coalesce(~c.rlike(r"(?U)\S"), F.lit(True))


def blank_to_null(c: Column) -> Column:
    return F.when(~is_blank(c), c)


def fold(c: Column) -> Column:
    """For comparison regardless of case and spacing; null counts as blank."""
    return F.lower(squeeze(F.coalesce(c, F.lit(""))))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once, however often use names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def strip_of(c: Column, characters: str) -> Column:
    """Without any of these characters at both ends."""
    return F.btrim(c, F.lit(characters))
