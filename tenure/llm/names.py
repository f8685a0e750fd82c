"""Variant spellings of names typed by people: which rows name the same person or organisation."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenure.functions.text import is_blank
from tenure.llm.components import components
from tenure.operators.joins import hot_key_lookup
from tenure.session import checkpoint

#: The least length of a suffix in the index, the size from which a suffix is common and refined, and the length from which a word may be mistyped.
LEAST_SUFFIX, BLOCK, LEAST_WORD = 3, 64, 4
#: Words up to this length are indexed by all their suffixes.
ALL_SUFFIXES = 64
#: The share of a word's names that must occur with the other spelling for it to be a slip of it.
SLIP_SHARE = 0.5

# Everyday short forms of given names.
NICKNAMES = {
    "AL": "ALEXANDER", "ALEX": "ALEXANDER", "ANDY": "ANDREW", "TONY": "ANTHONY", "BEN": "BENJAMIN", "BENNY": "BENJAMIN", "CATHY": "CATHERINE", "CHARLIE": "CHARLES", "CHUCK": "CHARLES",
    "CHRIS": "CHRISTOPHER", "DAN": "DANIEL", "DANNY": "DANIEL", "DAVE": "DAVID", "DEB": "DEBORAH", "DEBBIE": "DEBORAH", "DON": "DONALD", "DOT": "DOROTHY", "DOTTIE": "DOROTHY", "ED": "EDWARD", "EDDIE": "EDWARD",
    "BETH": "ELIZABETH", "BETSY": "ELIZABETH", "BETTY": "ELIZABETH", "LIZ": "ELIZABETH", "LIZZIE": "ELIZABETH", "PACO": "FRANCISCO", "PANCHO": "FRANCISCO", "FRAN": "FRANCES", "GREG": "GREGORY", "JIM": "JAMES", "JIMMY": "JAMES",
    "JEFF": "JEFFREY", "JEN": "JENNIFER", "JENNY": "JENNIFER", "JACK": "JOHN", "JOHNNY": "JOHN", "JOE": "JOSEPH", "JOEY": "JOSEPH", "PEPE": "JOSE", "KATE": "KATHERINE", "KATHY": "KATHERINE", "KATIE": "KATHERINE", "KEN": "KENNETH",
    "LARRY": "LAWRENCE", "LORI": "LORRAINE", "LUCHO": "LUIS", "MAGGIE": "MARGARET", "MEG": "MARGARET", "PEGGY": "MARGARET", "MATT": "MATTHEW", "MIKE": "MICHAEL", "MICKEY": "MICHAEL", "NICK": "NICHOLAS", "PAT": "PATRICIA", "PATTY": "PATRICIA", "TRISH": "PATRICIA",
    "BECKY": "REBECCA", "RICK": "RICHARD", "RICH": "RICHARD", "DICK": "RICHARD", "BOB": "ROBERT", "BOBBY": "ROBERT", "ROB": "ROBERT", "SAM": "SAMUEL", "STEVE": "STEPHEN", "SUE": "SUSAN", "SUSIE": "SUSAN",
    "TED": "THEODORE", "THEO": "THEODORE", "TOM": "THOMAS", "TOMMY": "THOMAS", "VICKY": "VICTORIA", "VICKI": "VICTORIA", "WALT": "WALTER", "BILL": "WILLIAM", "BILLY": "WILLIAM", "WILL": "WILLIAM",
}
# Words of company and trust names, in singular, and how they are shortened.
BUSINESS = {
    "ASSOCIATE": ("ASSOC", "ASSOCS", "ASSN"), "APARTMENT": ("APT", "APTS"), "DEVELOPMENT": ("DEV", "DEVEL", "DEVT"), "ENTERPRISE": ("ENT", "ENTS", "ENTPR"), "EQUITY": ("EQ", "EQUIT"), "HOLDING": ("HLDG", "HLDGS", "HOLD"), "HOUSING": ("HSG", "HOUS"),
    "INVESTMENT": ("INV", "INVS", "INVEST", "INVT"), "MANAGEMENT": ("MGT", "MGMT", "MGMNT"), "PARTNER": ("PTNR", "PTNRS", "PRTNRS"), "PROPERTY": ("PROP", "PROPS", "PPTY"), "REALTY": ("RLTY", "REALT"), "RENTAL": ("RENT", "RNTL", "RNTLS"), "VENTURE": ("VENT",), "GROUP": ("GRP",), "CAPITAL": ("CAP",),
    "STREET": ("ST", "STR"), "AVENUE": ("AVE", "AV"), "ROAD": ("RD",), "DRIVE": ("DR", "DRV"), "LANE": ("LN",), "COURT": ("CT",), "BOULEVARD": ("BLVD",), "PLACE": ("PL",), "TERRACE": ("TER", "TERR"), "PARKWAY": ("PKWY",),
}
FAMILY = {"FAM": "FAMILY"}
LEGAL = {"LLC": "LLC", "INC": "INC", "CORP": "CORP", "LP": "LP", "LLP": "LLP", "LLLP": "LLLP", "LTD": "LTD", "LIMITED": "LTD", "PC": "PC", "PLC": "PLC", "CO": "CO", "COMPANY": "CO"}
TRUST = {"TRUST", "TR", "TRST"}
TRUSTEE = {"TRUSTEE", "TRUSTEES", "TTEE"}
NUMERALS = {"II", "III", "IV", "VI", "VII", "VIII", "IX"}
GENERATIONS = {"JR", "SR"}
FILLERS = {"THE", "OF"}
# short forms of business words that are also titles or parts of people's names
TITLES = {"DR", "ST", "CT", "PL", "AV", "CAP"}
# end of fixed values

_SHORT = {short: word for word, shorts in BUSINESS.items() for short in shorts}
_GIVEN = sorted(set(NICKNAMES.values()))
_WRITTEN = {form: word for word in BUSINESS if len(word) > 5 for form in (word, word[:-1] + "IES" if word.endswith("Y") else word + "S")}


def _less_one(word: str) -> list[str]:
    """The word without any one letter."""
    return [word[:i] + word[i + 1 :] for i in range(len(word))]


_NEAR = {rest: word for form, word in _WRITTEN.items() for rest in (*_less_one(form), form)}
_SEPARATOR, _GLUED = re.compile(r"[/.,-]"), re.compile(r"\b(\d+)(?=[A-Z]{3,})")
_LONGEST = max(map(len, _WRITTEN)) + 1
PARSED = "cls string, fixed string, legal string, words array<string>, initials array<string>"


def _singular(word: str) -> str:
    if word in _SHORT:
        return _SHORT[word]
    if word.endswith("IES") and word[:-3] + "Y" in BUSINESS:
        return word[:-3] + "Y"
    if word[:-1] in BUSINESS and word.endswith("S"):
        return word[:-1]
    # a business word mistyped in one place
    if 5 < len(word) <= _LONGEST and word not in BUSINESS:
        return next((_NEAR[rest] for rest in (word, *_less_one(word)) if rest in _NEAR), word)
    return word


def parse(name: str) -> tuple[str, str, str, list[str], list[str]]:
    """(class, parts that must be equal, legal form, words in order, single letters) of a name.

    Classes are trust, company, couple and person. Numbers, numerals and generations must be equal between
    rows of one owner. Fillers are dropped, short forms written out, plurals of business words made singular.
    """
    # a number run into the next word is two parts
    tokens = _GLUED.sub(r"\1 ", _SEPARATOR.sub(" ", name.upper()).replace("&", " & ")).split()
    held = set(tokens)
    legal = ""
    singular = [_singular(t) for t in tokens]
    if held & TRUST:
        cls = "trust"
    elif held & LEGAL.keys() or any(t.isdigit() for t in tokens) or any(s in BUSINESS and t not in TITLES for t, s in zip(tokens, singular)):
        cls = "company"
    elif "&" in held or "AND" in held:
        cls = "couple"
    else:
        cls = "person"
    fixed, words, initials = [], [], []
    for token, single in zip(tokens, singular):
        if token in FILLERS or token in ("&", "AND") or (cls == "trust" and (token in TRUST or token in TRUSTEE)):
            continue
        if cls in ("company", "trust") and token in LEGAL:
            legal = LEGAL[token]
        elif token in NUMERALS or token in GENERATIONS or any(ch.isdigit() for ch in token):
            fixed.append(token)
        elif len(token) == 1:
            initials.append(token)
        elif cls in ("company", "trust"):
            words.append(FAMILY.get(token, single))
        else:
            words.append(NICKNAMES.get(token, token))
    return cls, " ".join(sorted(fixed)), legal, words, sorted(initials)


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence."""
    if a == b:
        return len(a)
    start = 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    end = 0
    while end < min(len(a), len(b)) - start and a[-1 - end] == b[-1 - end]:
        end += 1
    x, y = a[start : len(a) - end], b[start : len(b) - end]
    row = [0] * (len(y) + 1)
    for ch in x:
        before = 0
        for j, other in enumerate(y, 1):
            above = row[j]
            row[j] = before + 1 if ch == other else max(above, row[j - 1])
            before = above
    return start + end + row[-1]


def suffixes(word: Column, least: Column, most: Column) -> Column:
    """Array of (side, suffix, rest): the ends of a word of these lengths, and as side 1 its beginnings, which are the ends of its mirror image."""
    lengths = F.when(least <= most, F.sequence(least, most)).otherwise(F.array().cast("array<int>"))
    n = F.length(word)
    ends = F.transform(lengths, lambda k: F.struct(F.lit(0).alias("side"), F.right(word, k).alias("s"), F.left(word, n - k).alias("rest")))
    return F.concat(ends, F.transform(lengths, lambda k: F.struct(F.lit(1).alias("side"), F.left(word, k).alias("s"), F.right(word, n - k).alias("rest"))))


def without_one(text: Column) -> Column:
    """Array of the text and of all that is left of it without one letter."""
    shorter = F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.concat(F.left(text, i - 1), F.substring(text, i + 1, F.length(text))))
    return F.array_distinct(F.concat(F.array(text), F.when(F.length(text) > 0, shorter).otherwise(F.array().cast("array<string>"))))


def similar_words(asking: DataFrame, known: DataFrame) -> DataFrame:
    """(a, b, ratio): words of asking with the other words of known that are one slip away. Both: (w), distinct.

    The index holds every suffix of a known word and of its mirror image from ``LEAST_SUFFIX`` letters on, or a
    little under half of the word if that is more. One letter added, lost, changed or two neighbors swapped leave
    half of a word's other letters on one of its sides: so a word asks with its two halves. A common suffix is
    refined by what is left of the rest of the word without any one letter, which parts no such pair. Words that
    are too short for a half of the least length meet by what is left of the whole word without any one letter.
    Pairs are compared by the longest common subsequence: all letters but one of the longer word.
    """
    n = F.length("w")
    asking, known = asking.where(n >= LEAST_WORD - 1), known.where(n >= LEAST_WORD - 1)
    half = F.floor((n - 2) / 2).cast("int")
    least = F.greatest(F.lit(LEAST_SUFFIX), F.floor((n - 3) / 2).cast("int"))
    # of a very long word only those suffixes that a word of about its length looks up
    index = known.select("w", F.explode(suffixes(F.col("w"), least, F.when(n <= ALL_SUFFIXES, n).otherwise(least + 2))).alias("x")).select("w", "x.*")
    index = checkpoint(index.select("w", F.xxhash64("side", "s").alias("k"), "rest"))
    common = index.groupBy("k").agg(F.count(F.lit(1)).alias("n_words")).where(F.col("n_words") > BLOCK).select("k")
    probes = asking.where(half >= LEAST_SUFFIX).select("w", F.explode(suffixes(F.col("w"), half, half)).alias("x")).select("w", F.xxhash64("x.side", "x.s").alias("k"), "x.rest")

    def refined(rows: DataFrame) -> DataFrame:
        return rows.join(common, "k", "left_semi").select("w", F.explode(without_one(F.col("rest"))).alias("r"), "k").select("w", F.xxhash64("k", "r").alias("k"))

    def short(rows: DataFrame) -> DataFrame:
        return rows.where(half <= LEAST_SUFFIX).select("w", F.explode(without_one(F.col("w"))).alias("r")).select("w", F.xxhash64(F.lit("whole"), "r").alias("k"))

    asks = probes.join(common, "k", "left_anti").select("w", "k").unionByName(refined(probes)).unionByName(short(asking))
    asked = index.join(common, "k", "left_anti").select("w", "k").unionByName(refined(index)).unionByName(short(known))
    met = asks.withColumnRenamed("w", "a").join(asked.withColumnRenamed("w", "b"), "k").where("a <> b")
    # a swap counts two here: nothing that one slip makes is lost
    met = met.where((F.greatest(F.length("a"), F.length("b")) >= LEAST_WORD) & (F.abs(F.length("a") - F.length("b")) <= 1) & (F.levenshtein("a", "b", 2) >= 0)).select("a", "b").distinct()

    @F.pandas_udf("double")
    def ratio(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in batches:
            yield pd.Series([slip_ratio(x, y) for x, y in zip(a, b)], dtype="float64")

    return met.select("a", "b", ratio("a", "b").alias("ratio")).where("ratio > 0")


def slip_ratio(a: str, b: str) -> float:
    """Twice the longest common subsequence over both lengths, 0 if more than one letter of the longer word is not in it."""
    longest = max(len(a), len(b))
    common = common_length(a, b) if longest >= LEAST_WORD and abs(len(a) - len(b)) <= 1 else 0
    share = 2 * common / (len(a) + len(b)) if common >= longest - 1 else 0.0
    return share if share >= 0.75 else 0.0


def variant_groups(names: DataFrame, key: str, name: str) -> DataFrame:
    """(key, group_id) for every row with a key and a name that is not blank; equal keys must not repeat.

    Names of one canonical form (order, short forms, nicknames, fillers) collapse first. Their distinct words
    are linked by suffix blocking and the longest common subsequence (``similar_words``). A word is taken for a
    slip of a more frequent one if most names with it also occur with the other: a share, so it holds at
    any size. A name then stands under its own words, under its words with one or two slips put right (one at
    least stays as typed, unless it is the only one), and with two words run together where such a word
    exists; names that stand under the same words, legal form and initials are one. All this is equality of
    keys: no pairs within a block are made, and no block is dropped.

    A name that lacks a part (middle initial, legal form, given name but for its initial) joins the one group
    that has it, or none if several do; repeated until nothing moves. Null and blank names are in no group; a
    name of punctuation only, or without words, groups with the same form only.
    """

    @F.pandas_udf(PARSED)
    def parsed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([parse(n) for n in batch], columns=["cls", "fixed", "legal", "words", "initials"])

    rows = names.where(F.col(key).isNotNull() & ~is_blank(F.col(name))).select(F.col(key).alias("key"), F.col(name).alias("name"))
    forms = rows.select("key", "name", parsed("name").alias("p"))
    shape = F.concat_ws("|", "p.cls", "p.fixed", "p.legal", F.array_join(F.array_sort("p.words"), " "), F.array_join("p.initials", " "))
    empty = (F.size("p.words") == 0) & (F.size("p.initials") == 0) & (F.col("p.fixed") == "")
    forms = checkpoint(forms.select("key", F.sha2(F.when(empty, F.col("name")).otherwise(shape), 256).alias("form"), "p"))
    # short numbers for the forms: fixed once checkpointed, and all that the joins below move
    reps = checkpoint(forms.groupBy("form").agg(F.min("p").alias("p")).withColumn("id", F.monotonically_increasing_id()))
    named = reps.where(F.size("p.words") > 0).select("id", "p.*")

    placed = checkpoint(_places(named))
    lead = placed.groupBy("node").agg(F.min("id").alias("lead"))
    roots = components(placed.join(lead, "node").select("id", "lead"), "id", "lead")
    groups = checkpoint(reps.select("id", "form").join(roots.withColumnRenamed("node", "id"), "id", "left").select("form", "id", F.coalesce("root", "id").alias("group")))
    at = lead.join(groups.select(F.col("id").alias("lead"), "group"), "lead").select("node", "group")
    nodes = placed.groupBy("node").agg(F.first(F.struct("cls", "fixed", "words", "legal", "initials")).alias("n")).select("node", "n.*").join(at, "node")
    lacking = _lacking(nodes)
    asked = at.select("node", F.col("group").alias("x"))
    links = checkpoint(lacking.join(asked, "node").where("x <> y").select("x", "y", "strength").distinct())
    for moves in _attached(links):
        groups = groups.join(moves.withColumnRenamed("node", "group"), "group", "left").select("form", "id", F.coalesce("root", "group").alias("group"))
    return forms.select("key", "form").join(groups.select("form", "group"), "form").select(F.col("key").alias(key), F.col("group").alias("group_id"))


def _bag(words: Column) -> Column:
    return F.xxhash64("cls", "fixed", F.array_sort(words))


def _node(bag: Column, legal: Column, initials: Column) -> Column:
    """The key of a place: names meet where class, fixed parts, words, legal form and initials are equal."""
    return F.xxhash64(bag, legal, F.array_join(initials, " "))


def _places(named: DataFrame) -> DataFrame:
    """(id, node, cls, fixed, words, legal, initials): where each form stands: as typed, with slips put right, with words run together."""
    words = named.select("id", F.posexplode("words").alias("at", "word"))
    counts = checkpoint(words.select("id", "word").distinct().groupBy("word").agg(F.count(F.lit(1)).alias("df")))
    pair = F.flatten(F.transform("words", lambda a, i: F.transform(F.filter(F.transform("words", lambda b, j: F.struct(b.alias("b"), j.alias("j"))), lambda y: (y.j > i) & (F.length(a) + F.length(y.b) >= 6)), lambda y: F.struct(i.alias("i"), y.j.alias("j"), F.concat(a, y.b).alias("w")))))
    joined = named.select("id", F.explode(pair).alias("o")).select("id", "o.*")
    glued = joined.select("w").distinct().join(counts.select(F.col("word").alias("w")), "w", "left_anti")
    typed = counts.select(F.col("word").alias("w"))
    similar = checkpoint(similar_words(typed, typed.unionByName(glued)))

    # what a rarer word may stand for
    a, b = counts.select(F.col("word").alias("a"), F.col("df").alias("df_a")), counts.select(F.col("word").alias("b"), F.col("df").alias("df_b"))
    known = lambda words_: F.col("a").isin(words_) & F.col("b").isin(words_)
    fixes = similar.join(a, "a").join(b, "b", "left").where((F.col("df_b").isNull() | (F.col("df_a") <= F.col("df_b"))) & ~known(_GIVEN) & ~known(sorted(BUSINESS)))
    fixes = checkpoint(fixes.select("a", "b", "ratio", "df_a", "df_b"))
    options = fixes.groupBy("a").agg(F.array_sort(F.collect_list(F.struct("b", "ratio"))).alias("options"))
    found = hot_key_lookup(words, "word", options, "a", ["options"]).where("options is not null").select("id", "at", "word", F.explode("options").alias("o")).select("id", F.struct("at", "word", "o").alias("f"))
    per_name = named.join(found.groupBy("id").agg(F.collect_list("f").alias("fs")), "id")

    def put_right(*chosen: Column) -> Column:
        def word(x: Column, i: Column) -> Column:
            for f in chosen:
                x = F.when(f["at"] == i, f["o"]["b"]).otherwise(x)
            return x

        ratio = sum((f["o"]["ratio"] for f in chosen[1:]), chosen[0]["o"]["ratio"])
        return F.struct(F.transform("words", word).alias("words"), F.array(*[F.struct(f["word"].alias("a"), f["o"]["b"].alias("b")) for f in chosen]).alias("fixes"), F.array(*[f["at"] for f in chosen]).alias("ats"), ratio.alias("ratio"))

    singles = F.transform("fs", lambda f: put_right(f))
    doubles = F.when(F.size("words") >= 3, F.flatten(F.transform("fs", lambda f: F.transform(F.filter("fs", lambda g: g["at"] > f["at"]), lambda g: put_right(f, g))))).otherwise(F.slice(singles, 1, 0))
    base = ["id", "cls", "fixed", "legal", "initials"]
    right = per_name.select(*base, F.explode(F.concat(singles, doubles)).alias("c")).select(*base, "c.*")
    # run together: only where such a word was typed, or is what one may stand for
    of_use = counts.select(F.col("word").alias("w")).unionByName(fixes.where("a is not null").select(F.col("b").alias("w"))).distinct()
    together = joined.join(of_use, "w").join(named, "id")
    rest = F.filter("words", lambda x, k: (k != F.col("i")) & (k != F.col("j")))
    together = together.select(*base, F.concat(F.array("w"), rest).alias("words"))
    none = [F.lit(None).cast("array<struct<a:string,b:string>>").alias("fixes"), F.lit(None).cast("array<int>").alias("ats"), F.lit(0.0).alias("ratio")]
    places = named.select(*base, "words", *none).unionByName(together.select(*base, "words", *none)).unionByName(right)
    places = checkpoint(places.withColumn("words", F.array_sort("words")).withColumn("bag", _bag(F.col("words"))))

    # a slip put right counts if another name stands there, and if that holds for most names with the word
    met = places.groupBy("bag").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("bag")
    slips = checkpoint(places.where("fixes is not null").join(met, "bag", "left_semi"))
    sure = slips.select("id", F.explode("fixes").alias("f")).groupBy("f.a", "f.b").agg(F.count_distinct("id").alias("n")).join(fixes, ["a", "b"]).where(F.col("n") >= SLIP_SHARE * F.col("df_a"))
    sure = checkpoint(sure.select("a", "b", "df_a", "df_b"))
    # a word that is a slip itself is a worse reading than one that is none
    slipped = sure.where("df_a < df_b").select(F.col("a").alias("b")).distinct().withColumn("slip", F.lit(True))
    judged = slips.select("id", "bag", "ats", F.explode("fixes").alias("f")).select("id", "bag", "ats", "f.*").join(sure, ["a", "b"], "left").join(slipped, "b", "left")
    judged = judged.groupBy("id", "bag", "ats").agg(F.bool_and(F.col("df_a").isNotNull()).alias("sure"), F.count_if("slip").alias("n_slips"), F.min(F.coalesce("df_b", F.lit(0))).alias("df"))
    # of several words that a slip may stand for: one that is no slip, the closest, the most frequent
    rank = F.struct(-F.col("n_slips"), "ratio", "df", "bag")
    best = slips.join(judged.where("sure"), ["id", "bag", "ats"]).groupBy("id", "ats").agg(F.max_by(F.struct(*base[1:], "words", "bag"), rank).alias("b")).select("id", "b.*")
    kept = places.where("fixes is null").select(*base, "words", "bag").unionByName(best.select(*base, "words", "bag"))
    return kept.select("id", _node(F.col("bag"), F.col("legal"), F.col("initials")).alias("node"), "cls", "fixed", "words", "legal", "initials")


def _lacking(nodes: DataFrame) -> DataFrame:
    """(node, y, strength): the places that lack a part of group y's: legal form or initials (2), a given name but for its initial (3)."""
    option = lambda legal, initials: F.struct(legal.alias("legal"), initials.alias("initials"))
    blank, nothing = F.lit(""), F.array().cast("array<string>")
    legal, initials = F.col("legal"), F.col("initials")
    less = F.array_except(F.array(option(legal, nothing), option(blank, initials), option(blank, nothing)), F.array(option(legal, initials)))
    parts = nodes.select(F.col("group").alias("y"), "cls", "fixed", "words", F.explode(less).alias("o")).select(_node(_bag(F.col("words")), F.col("o.legal"), F.col("o.initials")).alias("node"), "y", F.lit(2).alias("strength"))
    people = nodes.where(F.col("cls").isin("person", "couple") & (F.size("words") >= 2)).select(F.col("group").alias("y"), "cls", "fixed", "legal", "initials", F.posexplode("words").alias("at", "word"), "words")
    letter = F.array(F.left("word", F.lit(1)))
    people = people.withColumns({"words": F.filter("words", lambda x, k: k != F.col("at")), "initials": F.explode(F.array_distinct(F.array(F.array_sort(F.concat("initials", letter)), letter)))})
    return parts.unionByName(people.select(_node(_bag(F.col("words")), F.col("legal"), F.col("initials")).alias("node"), "y", F.lit(3).alias("strength")))


def _attached(links: DataFrame) -> Iterator[DataFrame]:
    """(node, root) per pass: each group that lacks a part joins the only group that has it, until none does; first by legal form and initials."""
    while True:
        for strength in (2, 3):
            some = links.where(F.col("strength") == strength).groupBy("x").agg(F.min("y").alias("y"), F.max("y").alias("last")).where("y = last").select("x", "y")
            moves = components(some, "x", "y")
            if not moves.isEmpty():
                break
        else:
            return
        yield moves
        at_x = links.join(moves.select(F.col("node").alias("x"), F.col("root").alias("rx")), "x", "left").select(F.coalesce("rx", "x").alias("x"), "y", "strength")
        at_y = at_x.join(moves.select(F.col("node").alias("y"), F.col("root").alias("ry")), "y", "left").select("x", F.coalesce("ry", "y").alias("y"), "strength")
        links = checkpoint(at_y.where("x <> y").distinct())


def pairs_of_groups(groups: DataFrame, key: str, group: str) -> DataFrame:
    """(key_a, key_b), a < b: all pairs within a group."""
    a, b = F.col("a"), F.col("b")
    left, right = groups.select(F.col(group).alias("g"), F.col(key).alias("a")), groups.select(F.col(group).alias("g"), F.col(key).alias("b"))
    return left.join(right, "g").where(a < b).select(a.alias(f"{key}_a"), b.alias(f"{key}_b"))


