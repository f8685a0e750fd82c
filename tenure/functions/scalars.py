"""Scalar functions of the adapters as column expressions: identifiers, lenient casts, dates, flags."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tenure.functions.text import blank_to_null, strip


def zero_pad(c: Column, width: int) -> Column:
    """Left-padded with zeros; longer input stays whole (lpad would cut it)."""
    return F.when(F.length(c) >= width, c).otherwise(F.lpad(c, width, "0"))


def to_double(c: Column) -> Column:
    """The number a text holds, null if it holds none; a type suffix or surrounding text is no number."""
    s = strip(c)
    return F.when(s.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), s.try_cast("double"))


def to_whole(c: Column) -> Column:
    """The whole number a text holds, through its double: "12.7" is 12."""
    return to_double(c).try_cast("bigint")


def to_date(c: Column, formats: Sequence[str] = ("yyyy-MM-dd", "MM/dd/yyyy", "yyyyMMdd"), first_year: int = 1800) -> Column:
    """The date of the first format that fits, of the text before any time; null before first_year."""
    day = F.regexp_replace(strip(c), r"[T ].*$", "")
    shapes = {f: "^" + f.replace("yyyy", r"\d{4}").replace("MM", r"\d{2}").replace("dd", r"\d{2}") + "$" for f in formats}
    parsed = F.coalesce(*[F.when(day.rlike(shapes[f]), F.try_to_date(day, f)) for f in formats])
    return F.when(F.year(parsed) >= first_year, parsed)


def date_of_parts(year: Column, month: Column) -> Column:
    """First day of the month, null unless both parts make one."""
    y, m = to_whole(year), to_whole(month)
    return F.when(y.between(1800, 9999) & m.between(1, 12), F.make_date(y.cast("int"), m.cast("int"), F.lit(1)))


#: Texts that mean yes.
YES = ["true", "t", "1", "yes"]


def truthy(c: Column) -> Column:
    return F.coalesce(F.lower(strip(c)).isin(*YES), F.lit(False))


def lookup(c: Column, table: Mapping[str, object]) -> Column:
    """The table's value, null on a miss. The table is a plan literal: for lists, not for data."""
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), c)


#: Numbers written as words.
WORD_NUMBERS = {"one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10}


def count_of(c: Column) -> Column:
    """A positive count written as a word or number, else null."""
    n = F.coalesce(lookup(F.lower(strip(c)), WORD_NUMBERS).cast("bigint"), to_whole(c))
    return F.when(n > 0, n)


def join_parts(*parts: Column, separator: str = ", ") -> Column:
    """The parts that are not blank, stripped and joined; null if none is left."""
    return blank_to_null(F.concat_ws(separator, *[blank_to_null(strip(p)) for p in parts]))


def first_token(c: Column) -> Column:
    """The first word, upper case, commas counting as space; "" for blank."""
    s = F.upper(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)[,\s]+", " "))
    return F.element_at(F.split(F.trim(s), " "), 1)


def ratio(part: Column, whole: Column) -> Column:
    """part / whole as a double, null if the whole is zero or null."""
    return F.try_divide(part.cast("double"), whole.cast("double"))
