"""Owner names and mailing addresses: normal form, key, parts, class by an ordered list of rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from tenure.functions.text import blank_to_null, strip

# Phrases written one way, in this order.
NAME_PHRASES = [
    (r"\bLIMITED LIABILITY COMPANY\b", "LLC"), (r"\bLIMITED LIABILITY CO\b", "LLC"), (r"\bLTD LIABILITY COMPANY\b", "LLC"), (r"\bLTD LIABILITY CO\b", "LLC"), (r"\bL\s*L\s*C\b", "LLC"),
    (r"\bTRUSTEES\b", "TRUSTEE"), (r"\bTTEE\b", "TRUSTEE"), (r"\bTRST\b", "TRUST"), (r"\bTR UST\b", "TRUST"), (r"\bLIVING TRUST\b", "TRUST"),
    (r"\bINCORPORATED\b", "INC"), (r"\bCORPORATION\b", "CORP"), (r"\bP\s*C\b", "PC"),
]
# Later parts of a name that make it an estate's.
ESTATE_PARTS = ["LWT", "DEF", "EST", "ESTATE", "EST OF", "ESTATE OF"]
# Marks of a care-of line.
CARE_OF = r"^(C/O|C O|CARE OF)\b"
# end of fixed values

#: Rules for examples and tests, (rule, class, pattern): the first that matches decides. Users bring their own.
RULES = [
    ("blank", "unknown", r"^$"), ("trust", "trust", r"\bTRUST(EE)?\b|\bTR$"), ("estate", "estate", r"^ESTATE\b|\bESTATE OF\b"), ("llc", "llc", r"\bLLC\b"),
    ("partnership", "partnership", r"\bL ?L?P\b|\bPARTNERSHIP\b"), ("corp", "corp", r"\b(CORP|INC|LTD|CO|COMPANY)\b"), ("person", "individual", r"^[A-Z]+( [A-Z]+){1,4}$"),
]


def clean_name(c: Column) -> Column:
    """Upper case letters, digits, &, /, - and single spaces, with the phrases above written one way; "" for null.

    Every other character is a space: O'BRIEN is two words.
    """
    s = F.regexp_replace(F.upper(F.coalesce(c, F.lit(""))), r"[^A-Z0-9&/ -]+", " ")
    s = F.trim(F.regexp_replace(s, r"\s+", " "))
    for pattern, written in NAME_PHRASES:
        s = F.regexp_replace(s, pattern, written)
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def name_parts(clean: Column) -> Column:
    """The co-owners of a normal name, split at slashes, without blanks."""
    return F.filter(F.transform(F.split(clean, r"\s*/\s*"), lambda x: F.trim(x)), lambda x: x != "")


def primary_name(clean: Column) -> Column:
    return F.coalesce(F.try_element_at(name_parts(clean), F.lit(1)), F.lit(""))


def is_estate(clean: Column) -> Column:
    """Whether a part after the first marks an estate."""
    parts = name_parts(clean)
    return F.coalesce(F.arrays_overlap(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), F.array(*[F.lit(x) for x in ESTATE_PARTS])), F.lit(False))


def owner_key(clean: Column) -> Column:
    """Sixteen hex digits of the name; of the empty name too (see blank_owner_key)."""
    return F.left(F.sha2(clean, 256), F.lit(16))


def blank_owner_key(clean: Column) -> Column:
    """As owner_key, but "" for the empty name, so that blank names do not form one owner."""
    return F.when(clean == "", "").otherwise(owner_key(clean))


def _stripped(parts: Sequence[Column]) -> Column:
    """The parts that are not blank, stripped, with a space between, in upper case."""
    return F.upper(F.concat_ws(" ", *[blank_to_null(strip(p)) for p in parts]))


def clean_address(*parts: Column) -> Column:
    """The parts joined, upper case, without punctuation but / and -, and without a leading care-of mark."""
    s = F.trim(F.regexp_replace(F.regexp_replace(_stripped(parts), r"[^A-Z0-9/ -]+", " "), r"\s+", " "))
    return F.trim(F.regexp_replace(s, CARE_OF, ""))


def is_care_of(*parts: Column) -> Column:
    """Whether the joined parts begin with a care-of mark; dots count as spaces."""
    return F.replace(_stripped(parts), F.lit("."), F.lit(" ")).rlike(CARE_OF)


def address_key(clean: Column) -> Column:
    return F.when(clean == "", "").otherwise(owner_key(clean))


def classify(clean: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """struct(rule_id, owner_class) of the first rule whose pattern the primary name matches: one CASE, no UDF."""
    name = primary_name(clean)
    answer = lambda rule, cls: F.struct(F.lit(rule).alias("rule_id"), F.lit(cls).alias("owner_class"))
    chain = F.when(is_estate(clean), answer("estate_part", "estate"))
    for rule, cls, pattern in rules:
        chain = chain.when(name.rlike(pattern), answer(rule, cls))
    return chain.otherwise(answer("none", "unknown"))


def register(spark: SparkSession) -> None:
    """clean_name and owner_key as SQL functions of the session, written as the columns above."""
    spaces = r"regexp_replace({}, r'\s+', ' ')"
    clean = "trim(" + spaces.format("regexp_replace(upper(coalesce(n, '')), r'[^A-Z0-9&/ -]+', ' ')") + ")"
    for pattern, written in NAME_PHRASES:
        clean = f"regexp_replace({clean}, r'{pattern}', '{written}')"
    spark.sql(f"create or replace temporary function clean_name(n string) returns string return trim({spaces.format(clean)})")
    spark.sql("create or replace temporary function owner_key(n string) returns string return left(sha2(clean_name(n), 256), 16)")
