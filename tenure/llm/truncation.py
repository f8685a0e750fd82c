"""Texts cut off by field limits or broken transfers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenure.functions.text import is_blank
from tenure.session import checkpoint

#: A last line up to this length may be a closing line or a list entry; longer ones are running text.
SHORT_LINE = 80
#: A form of line counts as whole if surely this share of all texts show it; an ending of a closing form if surely this share of the form's lines end so.
FORM_SHARE, ENDING_SHARE = 0.0005, 0.001
#: Standard deviations by which a count must exceed what it is held against: for forms and endings, for limits.
SURE, SURE_LIMIT = 1.64, 3.0
#: Widths, in characters, in which lengths near a limit and before it are counted.
NEAR, BEFORE = 20, 100

SPACES = " \t\n\x0b\f\r\u0085\u00a0\u2007\u2028\u2029\u202f\u3000\ufeff"
_TERMINAL = r"[.!?。！？؟।][\"'”’»)\]]*$|[”»]$"
_ELLIPSIS = r"(…|\.\.\.|�)$"


def encoded_lengths(text: Column) -> dict[str, Column]:
    """Length of the text as different stores count it; in order of preference among equals."""
    entities = F.length(text) + 4 * _count(text, "&") + 3 * _count(text, "<") + 3 * _count(text, ">") + 5 * _count(text, '"')
    wide = F.octet_length(text) - F.length(text)
    escaped = F.length(F.to_json(F.struct(text.alias("t")))) - 8
    return {
        "characters": F.length(text),
        "utf8_bytes": F.octet_length(text),
        "windows_newlines": F.length(text) + _count(text, "\n"),
        "utf8_windows_newlines": F.octet_length(text) + _count(text, "\n"),
        "entities": entities,
        "utf8_entities": entities + wide,
        "json_escaped": escaped,
        "json_ascii": escaped + 5 * (F.length(text) - F.length(F.regexp_replace(text, r"[^\x00-\x7F]", ""))),
    }


def _count(text: Column, part: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))


def _surely(count: Column, sigmas: float = SURE) -> Column:
    """The least that a count stands for, given that it is one draw: holds at any size of the corpus."""
    return count - sigmas * F.sqrt(count)


def _measured(docs: DataFrame, doc: str, source: str, text: str) -> DataFrame:
    """(doc, source, lengths, open, broken, form, token) of every text that is not blank: all that is needed of it, from one read."""
    t = F.col("text")
    named = docs.where(~is_blank(F.col(text))).select(F.col(doc).alias("doc"), F.col(source).alias("source"), F.col(text).alias("text"))
    body = F.rtrim(F.replace(t, F.lit("\r"), F.lit("\n")), F.lit(SPACES))
    base = named.select("doc", "source", F.array(*encoded_lengths(t).values()).alias("lengths"), body.alias("body"))
    # only the end is searched: a pattern that is tied to the end would be tried from every place of the text
    end = F.right("body", F.lit(12))
    ends = base.select("doc", "source", "lengths", F.trim(F.substring_index("body", "\n", -1)).alias("line"), end.rlike(_TERMINAL).alias("terminal"), end.rlike(_ELLIPSIS).alias("broken"))
    candidate = ~F.col("broken") & ~F.col("terminal") & (F.length("line") <= SHORT_LINE)
    return ends.select("doc", "source", "lengths", (F.col("broken") | ~F.col("terminal")).alias("open"), F.when(candidate, _form(F.col("line"))).alias("form"), F.when(candidate, _last_token(F.col("line"))).alias("token"))


def storage_limits(docs: DataFrame, source: str, text: str) -> DataFrame:
    """(source, encoding, length_limit, n_near): hidden limits, one per source that has one.

    Lengths are counted per source and encoding over all texts. A limit is the most frequent length if the
    texts just below it (cuts may fall back to a word's end) crowd at least threefold against those before,
    more of them than chance would put there, and hardly any is longer. Of several encodings the one with the
    highest pile tells how the store counts.
    """
    named = docs.where(~is_blank(F.col(text))).select(F.col(source).alias("source"), F.array(*encoded_lengths(F.col(text)).values()).alias("lengths"))
    return _limits(named)


def _limits(measured: DataFrame) -> DataFrame:
    names = F.array(*[F.lit(n) for n in encoded_lengths(F.lit(""))])
    counted = measured.select("source", F.posexplode("lengths").alias("order", "n")).groupBy("source", "order", "n").agg(F.count(F.lit(1)).alias("times"))
    mode = counted.groupBy("source", "order").agg(F.max(F.struct("times", "n")).alias("m"))
    joined = counted.join(mode.select(F.col("source").alias("s"), F.col("order").alias("r"), F.col("m.n").alias("top"), F.col("m.times").alias("pile")), F.col("source").eqNullSafe(F.col("s")) & (F.col("order") == F.col("r")))
    below = F.col("top") - F.col("n")
    around = joined.groupBy("source", "order", "top", "pile").agg(
        F.sum(F.when(below.between(0, NEAR - 1), F.col("times")).otherwise(0)).alias("n_near"),
        (F.sum(F.when(below.between(NEAR, NEAR + BEFORE - 1), F.col("times")).otherwise(0)) * (NEAR / BEFORE)).alias("usual"),
        F.sum(F.when(below < 0, F.col("times")).otherwise(0)).alias("n_above"),
    )
    limits = around.where((_surely(F.col("n_near"), SURE_LIMIT) > 0) & (F.col("n_near") >= 3 * F.col("usual")) & (F.col("n_above") <= 0.1 * F.col("n_near")))
    best = Window.partitionBy("source").orderBy(F.desc("pile"), "order")
    top = limits.withColumn("__n", F.row_number().over(best)).where("__n = 1")
    return top.select("source", F.element_at(names, F.col("order") + 1).alias("encoding"), F.col("top").alias("length_limit"), "n_near")


def _form(line: Column) -> Column:
    """A line with its label kept and words, names, capitals and digits replaced by signs of their kind."""
    label = F.regexp_extract(line, r"^([^:\d]{1,30}:)\s", 1)
    rest = F.substring(line, F.length(label) + 1, F.lit(SHORT_LINE))
    signs = rest
    for pattern, sign in ((r"(?<!\p{L})\p{Lu}{2,}(?!\p{L})", "§"), (r"\p{Lu}[\p{L}'’-]*", "¤"), (r"\p{Ll}[\p{L}'’-]*", "¢"), (r"\d", "9")):
        signs = F.regexp_replace(signs, pattern, sign)
    return F.concat(label, signs)


def _last_token(line: Column) -> Column:
    """The last word; of a name only its last three letters, of a number only that it is one."""
    token = F.regexp_extract(line, r"([\p{L}\p{N}'’-]+)[^\p{L}\p{N}]*$", 1)
    return F.when(token.rlike(r"\d$"), "#").when(token.rlike(r"^\p{Lu}[\p{L}'’-]*\p{Ll}"), F.concat(F.lit("~"), F.lower(F.right(token, F.lit(3))))).otherwise(token)


def find_truncated(docs: DataFrame, doc: str, source: str, text: str, limits: DataFrame | None = None) -> DataFrame:
    """(doc, source, at_limit, truncated) for every text that is not null or blank.

    A text is whole if it ends on a sentence's end or closing quote, or if its last line is a closing line or
    list entry: a short line of a form that many texts show and that ends on a word, number pattern or kind of
    name with which such lines end elsewhere. A trailing ellipsis or broken character is a cut. The forms
    are counted over the whole corpus: list entries ("label: value") wherever they stand before the end,
    other closings where they end texts below their source's length limit, for at the limit they may be cut.
    An ending is known if a list entry before the end of a text has it, which cannot be cut, or if a share of
    the form's closings have it that cuts do not reach: so cuts do not vouch for each other in a larger corpus.
    A text that stops at a limit but right after a whole sentence or entry is no case.

    Every text is read twice, once for its measures and end and once for its list entries; nothing but
    those is kept. Repeated ids give a row each. Trailing white space makes no difference. A null source is a source.
    """
    measured = checkpoint(_measured(docs, doc, source, text))
    limits = checkpoint(_limits(measured)) if limits is None else limits
    # a row per source that has a limit
    near = measured.join(limits.select(F.col("source").alias("__s"), "encoding", "length_limit"), F.col("source").eqNullSafe(F.col("__s")), "left")
    length = F.coalesce(*[F.when(F.col("encoding") == n, F.col("lengths")[i]) for i, n in enumerate(encoded_lengths(F.lit("")))])
    ends = near.select("doc", "source", F.coalesce(length > F.col("length_limit") - NEAR, F.lit(False)).alias("at_limit"), "open", "form", "token")

    # list entries before the end of a text, and open last lines of texts below the limit
    lines = F.split(F.rtrim(F.replace(F.col(text), F.lit("\r"), F.lit("\n")), F.lit(SPACES)), "\n")
    entries = docs.where(F.col(text).contains(":") & F.col(text).rlike("[\r\n]")).select(lines.alias("lines")).select(F.explode(F.slice("lines", 1, F.greatest(F.lit(0), F.size("lines") - 1))).alias("line"))
    entries = entries.select(F.trim("line").alias("line")).where((F.length("line") <= SHORT_LINE) & F.col("line").rlike(r"^[^:\d]{1,30}:\s") & ~F.right("line", F.lit(12)).rlike(_TERMINAL))
    before = entries.select(_form(F.col("line")).alias("form"), _last_token(F.col("line")).alias("token"), F.lit(1).alias("n_before"), F.lit(0).alias("n_closing"))
    closings = ends.where(F.col("form").isNotNull() & ~F.col("at_limit")).select("form", "token", F.lit(0).alias("n_before"), F.lit(1).alias("n_closing"))
    seen = checkpoint(before.unionByName(closings).groupBy("form", "token").agg(F.sum("n_before").alias("n_before"), F.sum("n_closing").alias("n_closing")))
    least = FORM_SHARE * measured.count()
    forms = seen.groupBy("form").agg(F.sum(F.col("n_before") + F.col("n_closing")).alias("times"), F.sum("n_closing").alias("closings")).where(_surely(F.col("times")) >= least)
    sure = seen.join(forms, "form").where((F.col("n_before") > 0) | (_surely(F.col("n_closing")) >= ENDING_SHARE * F.col("closings")))
    tokens = sure.select("token").distinct()
    verdict = ["doc", "source", "at_limit", "truncated"]
    short = ends.where(F.col("form").isNotNull()).join(forms.select("form", F.lit(True).alias("known_form")), "form", "left").join(tokens.withColumn("known_token", F.lit(True)), "token", "left")
    # below the limit a strange name is a name; only at the limit may it be half of one
    name = F.col("token").startswith("~") & ~F.col("at_limit")
    short = short.withColumn("truncated", F.col("known_form").isNull() | (F.col("known_token").isNull() & ~name))
    rest = ends.where(F.col("form").isNull()).withColumn("truncated", F.col("open"))
    return short.select(*verdict).unionByName(rest.select(*verdict)).withColumnsRenamed({"doc": doc, "source": source})


def truncation_rates(verdicts: DataFrame, source: str, limits: DataFrame) -> DataFrame:
    """Per source: texts, truncated ones, their rate, and the limit with the encoding in which it counts."""
    rates = verdicts.groupBy(F.col(source).alias("source")).agg(F.count(F.lit(1)).alias("n_texts"), F.count_if("truncated").alias("n_truncated"))
    found = limits.select(F.col("source").alias("__s"), "encoding", "length_limit")
    return rates.join(found, F.col("source").eqNullSafe(F.col("__s")), "left").select("source", "n_texts", "n_truncated", F.round(F.col("n_truncated") / F.col("n_texts"), 6).alias("rate"), "encoding", "length_limit")
