"""The same postal address written differently: which entries denote one location."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenure.functions.text import is_blank, squeeze
from tenure.llm.components import components
from tenure.llm.names import common_length, similar_words
from tenure.operators.joins import hot_key_lookup
from tenure.session import checkpoint

#: Words of a city's name at most; share of a name's uses up to which a name one letter away is a slip of it.
CITY_LENGTH, SLIP_SHARE = 5, 0.2
#: Size from which a block is refined.
BLOCK = 64

# Postal words and their short forms.
DIRECTIONS = {"N": "N", "NO": "N", "NORTH": "N", "S": "S", "SO": "S", "SOUTH": "S", "E": "E", "EAST": "E", "W": "W", "WEST": "W", "NE": "NE", "NW": "NW", "SE": "SE", "SW": "SW", "NORTHEAST": "NE", "NORTHWEST": "NW", "SOUTHEAST": "SE", "SOUTHWEST": "SW"}
TYPES = {
    "STREET": ("ST", "STR", "STRT"), "AVENUE": ("AVE", "AV", "AVEN"), "ROAD": ("RD",), "DRIVE": ("DR", "DRV"), "LANE": ("LN",), "COURT": ("CT", "CRT"), "BOULEVARD": ("BLVD", "BOUL", "BLV"), "PLACE": ("PL",), "TERRACE": ("TER", "TERR"),
    "PARKWAY": ("PKWY", "PKY", "PWY"), "HIGHWAY": ("HWY",), "CIRCLE": ("CIR", "CRCL"), "SQUARE": ("SQ",), "TRAIL": ("TRL",), "WAY": ("WY",), "ALLEY": ("ALY",), "PLAZA": ("PLZ",), "EXPRESSWAY": ("EXPY",), "TURNPIKE": ("TPKE",), "LOOP": (), "PATH": (), "ROW": (), "WALK": (),
}
CITY_WORDS = {"N": "NORTH NEW", "NO": "NORTH", "S": "SOUTH", "SO": "SOUTH", "E": "EAST", "W": "WEST", "UPR": "UPPER", "LWR": "LOWER", "LK": "LAKE", "PT": "PORT", "FT": "FORT", "MT": "MOUNT", "ST": "SAINT", "STE": "SAINTE", "SPGS": "SPRINGS", "HTS": "HEIGHTS", "VLG": "VILLAGE", "BCH": "BEACH", "JCT": "JUNCTION", "GDNS": "GARDENS"}
STATES = set("AL AK AZ AR CA CO CT DE DC FL GA HI ID IL IN IA KS KY LA ME MD MA MI MN MS MO MT NE NV NH NJ NM NY NC ND OH OK OR PA PR RI SC SD TN TX UT VT VA WA WV WI WY".split())
# end of fixed values

_TYPE = {short: word for word, shorts in TYPES.items() for short in (word, *shorts)}
# a name before the mark is no part of the location either
_CARE = re.compile(r"^[^\d#]*?(?:\bC/O\b|\bC O\b|\bC\.O\.|\bCARE OF\b|\bATTN:?)\s*(?:[^,\d]*,|[^\d#]*?(?=\s(?:\d|P\.?\s?O|POB)))\s*|(?:\bC/O\b|\bC O\b|\bCARE OF\b|\bATTN:?)\s*(?:[^,\d]*,|[^\d#]*?(?=\s(?:\d|P\.?\s?O|POB)))\s*")
_LEADING = re.compile(r"^(\d{5})(?:-\d{4})?\s+([^\d,#]+?)\s+([A-Z]{2})(?:\s*,\s*|\s+-\s+|\s+)(?=\d|#|P\.?\s?O|BOX|APT|UNIT|STE|SUITE)(.*)$")
_TRAILING = re.compile(r"^(.*?)[\s,-]+([A-Z]{2})[.,]?(?:\s+(\d{5})(?:-?\d{4})?)?$")
_ONLY_ZIP = re.compile(r"^(.*\D)[\s,-]+(\d{5})(?:-\d{4})?$")
_UNIT = re.compile(r"(?:\b(?:APARTMENT|APT|UNIT|STE|SUITE|ROOM|RM)\b\.?\s*#?\s*|#\s*)([0-9A-Z]+)\b")
_BOX = re.compile(r"\b(?:P\s*\.?\s*O\s*\.?\s*BOX|P\.?\s?O\.?\s?B|BOX)\b\.?\s*#?\s*(\d\w*)")
_NUMBER = re.compile(r"\s*(\d+[A-Z]?\s?-\s?\d+[A-Z]?|\d\w*)(?=[\s,.]|$)")
FIELDS = ("num", "dir", "street", "kind", "unit", "box", "city", "state", "zip")
SCHEMA = ", ".join(f"{f} string" for f in FIELDS)


def city_names(text: str) -> list[str]:
    """The plausible names of a city as written, with a short first word written out; none for no letters."""
    words = re.sub(r"[^A-Z ]", " ", text.upper()).split()
    first = CITY_WORDS.get(words[0], words[0]).split() if len(words) > 1 else words[:1]
    return [" ".join([w, *words[1:]]) for w in first]


def one_letter(a: str, b: str) -> bool:
    """Equal but for one letter added, lost, changed or two neighbors swapped."""
    longest = max(len(a), len(b))
    return a == b or (longest >= 5 and abs(len(a) - len(b)) <= 1 and common_length(a, b) >= longest - 1)


def _words(text: str) -> list[str]:
    return re.sub(r"[^A-Z0-9 ]", " ", text).split()


def _cleaned(address: str | None) -> str:
    text = re.sub(r"\s+", " ", (address or "").upper()).strip(" ,-")
    return _CARE.sub("", text, count=1).strip(" ,-")


def _place_cuts(text: str) -> list[tuple[str, str, str]]:
    """(text before, state, postcode) in the plausible ways to cut a place off the end, the likeliest first."""
    if (m := _TRAILING.match(text)) and m[2] in STATES:
        cut = (m[1].strip(" ,-"), m[2], m[3] or "")
        return [cut, (text, "", "")] if m[2] in _TYPE and not m[3] else [cut]
    if (m := _ONLY_ZIP.match(text)) and len(text.split()) > 2:
        return [(m[1].strip(" ,-"), "", m[2])]
    return [(text, "", "")]


def city_candidates(address: str | None, city: str | None, state: str | None, zip_: str | None) -> list[tuple[str, bool]]:
    """(words, named) that may be the city of an address: its column, what stands before a state behind a separator (named), the last words."""
    if city is not None or state is not None or zip_ is not None:
        return [(" ".join(_words((city or "").upper())), True)] if (city or "").strip() else []
    text = _cleaned(address)
    if (m := _LEADING.match(text)) and m[3] in STATES:
        return [(" ".join(_words(m[2])), True)]
    found: dict[str, bool] = {}
    for before, st, _ in _place_cuts(text):
        _, sep, tail = _split_last(before)
        if st and sep and tail and not re.search(r"[\d#]", tail) and len(_words(tail)) <= CITY_LENGTH:
            found[" ".join(_words(tail))] = True
        words = _words(before)
        for k in range(1, min(CITY_LENGTH, len(words) - 1) + 1):
            if not words[-k].isalpha():
                break
            found.setdefault(" ".join(words[-k:]), False)
    return list(found.items())


def _known_city(text: str, known: dict[str, str]) -> str:
    """The known city written so, else the text as a name."""
    return known.get(" ".join(_words(text)), "") or next(iter(city_names(text)), "")


def readings(address: str | None, city: str | None, state: str | None, zip_: str | None, known: dict[str, str]) -> list[dict[str, str]]:
    """All plausible normalised forms of a written address, the likeliest first: parts, "" where missing.

    A last CT is a state or the street's type; last words are the longest known city, the one behind the
    separator, or the street's; a number with a hyphen is one or written together; what follows the type is
    a unit or the street's; N, S, E and W are directions or names; a leading ST is a saint.
    """
    text = _cleaned(address)
    bodies: list[tuple[str, dict[str, str]]] = []
    if city is not None or state is not None or zip_ is not None:
        bodies.append((text, {"city": _known_city((city or "").upper(), known), "state": (state or "").strip().upper(), "zip": (zip_ or "").strip()[:5]}))
    elif (m := _LEADING.match(text)) and m[3] in STATES:
        bodies.append((m[4], {"city": _known_city(m[2], known), "state": m[3], "zip": m[1]}))
    else:
        for before, st, zp in _place_cuts(text):
            place = {"city": "", "state": st, "zip": zp}
            words = _words(before)
            k = next((k for k in range(min(CITY_LENGTH, len(words) - 1), 0, -1) if " ".join(words[-k:]) in known), 0)
            cut_off = bool(st or zp)
            if st in _TYPE and not zp and not k:
                bodies.append((text, {"city": "", "state": "", "zip": ""}))
            head, sep, tail = _split_last(before)
            if cut_off and sep and tail and not re.search(r"[\d#]", tail) and not k:
                bodies.append((head, place | {"city": _known_city(tail, known)}))
                continue
            if k and (cut_off or k > 1):
                bodies.append((_without_last(before, k), place | {"city": known[" ".join(words[-k:])]}))
            bodies.append((before, place))
    out: list[dict[str, str]] = []
    for body, place in bodies:
        for reading in _street_readings(body, place):
            if reading not in out:
                out.append(reading)
    return out


def _without_last(text: str, k: int) -> str:
    return text[: [m.start() for m in re.finditer(r"[A-Z0-9]+", text)][-k]]


def _street_readings(text: str, place: dict[str, str]) -> list[dict[str, str]]:
    out = dict.fromkeys(FIELDS, "") | place
    if m := _BOX.search(text):
        out["box"] = m[1].lstrip("0")
        text = text[: m.start()] + " " + text[m.end() :]
        text = _UNIT.sub(" ", text) if not re.search(r"\d", text) else text
    if m := _UNIT.search(text):
        out["unit"] = m[1].lstrip("0")
        text = text[: m.start()] + " " + text[m.end() :]
    numbers = [""]
    if m := _NUMBER.match(text):
        numbers = [re.sub(r"\s", "", m[1])]
        numbers += [numbers[0].replace("-", "")] if "-" in numbers[0] else []
        rest = _words(text[m.end() :])
    else:
        rest = _words(text)
        if rest and rest[0][:1].isdigit():
            numbers = [rest.pop(0)]
    if out["box"] and not any(w.isdigit() for w in rest) and numbers == [""]:
        return [out]
    return [out | {"num": n} | street for n in numbers for street in _streets(rest, out)]


def _streets(words: list[str], out: dict[str, str]) -> list[dict[str, str]]:
    """The plausible (dir, street, kind, unit, city) of the words behind the number."""
    found: list[dict[str, str]] = []

    def add(words_: list[str], **parts: str) -> None:
        words_, parts = list(words_), {"dir": "", "kind": "", "unit": out["unit"], "city": out["city"]} | parts
        if len(words_) > 1 and words_[0] in DIRECTIONS and not (len(words_) == 2 and words_[1] in _TYPE):
            parts["dir"] = DIRECTIONS[words_.pop(0)]
        if len(words_) > 1 and words_[-1] in DIRECTIONS and not parts["dir"]:
            parts["dir"] = DIRECTIONS[words_.pop()]
        if len(words_) > 1 and words_[-1] in _TYPE:
            parts["kind"] = _TYPE[words_.pop()]
        elif not parts["city"] and not parts["kind"] and (at := next((i for i in range(len(words_) - 1, 0, -1) if words_[i] in _TYPE), None)) is not None:
            # an unknown city may follow the street's type
            rest = words_[at + 1 :]
            parts["kind"], words_ = _TYPE[words_[at]], words_[:at]
            if rest and rest[0] in DIRECTIONS and not parts["dir"]:
                parts["dir"] = DIRECTIONS[rest.pop(0)]
            parts["city"] = next(iter(city_names(" ".join(rest))), "")
        if len(words_) > 1 and words_[0] == "ST":
            found.append(parts | {"street": " ".join(["SAINT", *words_[1:]])})
        found.append(parts | {"street": " ".join(words_)})

    # a last word with a digit, or a single letter, behind the type is a unit without its mark
    if not out["unit"] and len(words) > 2 and (any(ch.isdigit() for ch in words[-1]) or (len(words[-1]) == 1 and words[-1] not in DIRECTIONS)) and any(w in _TYPE for w in words[1:-1]):
        add(words[:-1], unit=words[-1].lstrip("0"))
    add(words)
    return found


def _split_last(text: str) -> tuple[str, str, str]:
    best = max(text.rfind(","), text.rfind(" - "))
    if best < 0:
        return text, "", ""
    return text[:best].strip(" ,-"), text[best], text[best:].strip(" ,-")


_PRIME, _BASE = (1 << 61) - 1, 1_000_003


def _hashes(word: str) -> set[int]:
    """Hashes of a word and of all that is left of it without one letter; short words have only their own.

    Two words are equal but for one letter added, lost, changed or moved if and only if they share such a rest.
    """
    tails = [(0, 1)]
    for ch in reversed(word):
        value, power = tails[-1]
        tails.append(((ord(ch) * power + value) % _PRIME, power * _BASE % _PRIME))
    found, before = {tails[-1][0]}, 0
    if len(word) >= 4:
        for i, ch in enumerate(word):
            value, power = tails[len(word) - 1 - i]
            found.add((before * power + value) % _PRIME)
            before = (before * _BASE + ord(ch)) % _PRIME
    return found


def keys(p: dict) -> list[str]:
    """Combinations of parts by which addresses meet; none for an address without number and box.

    All hold the house and box number, beside the street without any one letter, which two streets that differ
    by a letter share, or the postcode, which stands in for the street. No pair that compares is parted.
    """
    if not p["num"] and not p["box"]:
        return []
    base = f"{p['num']}|{p['box']}|"
    return [f"S{base}{h}" for h in sorted(_hashes(p["street"]))] + ([f"Z{base}{p['zip']}"] if p["zip"] and len(p["street"]) >= 7 else [])


#: Parts that must be equal where both have them; of a postcode its digits in order, as two may be swapped.
_FIRM = ("unit", "state", "digits")


def _refined(keyed: DataFrame) -> DataFrame:
    """(k, mine, other, id): common blocks by the firm parts that both sides of a pair have.

    In a common block every form stands once for each set of parts that its partner may have: the key holds the
    values of the parts that both have, mine is the set of the form, other that of its partner. A form without
    a part so meets all that have one.
    """
    common = keyed.groupBy("k").agg(F.count(F.lit(1)).alias("n_rows")).where(F.col("n_rows") > BLOCK).select("k", F.lit(True).alias("common"))
    marked = checkpoint(keyed.join(common, "k", "left"))
    rest = marked.where("common is null").select("k", F.lit(0).alias("mine"), F.lit(0).alias("other"), "form")
    mine = sum((F.when(F.col(c) != "", 1 << i).otherwise(0) for i, c in enumerate(_FIRM)), F.lit(0))
    sides = marked.where("common").select("k", "form", *_FIRM, mine.alias("mine"), F.explode(F.array(*[F.lit(i) for i in range(1 << len(_FIRM))])).alias("other"))
    both = F.col("mine").bitwiseAND(F.col("other"))
    held = [F.when(both.bitwiseAND(F.lit(1 << i)) != 0, F.col(c)).otherwise("") for i, c in enumerate(_FIRM)]
    return rest.unionByName(sides.select(F.xxhash64("k", *held).alias("k"), "mine", "other", "form"))


def _close(a: str, b: str) -> bool:
    """Two letters wrong in a long name."""
    longest = max(len(a), len(b))
    return longest >= 9 and abs(len(a) - len(b)) <= 2 and common_length(a, b) >= longest - 2


#: Parts that an address may lack.
_OPTIONAL = ("dir", "kind", "unit", "city", "state", "zip")
#: Parts without which an address may be whole, and the share of a location's entries that may have lost one.
_OWN, LOST_SHARE = ("dir", "unit"), 0.35


def compare(a: dict, b: dict) -> str:
    """"equal", "less" (a lacks parts of b), "more", "cross" (both lack some) or "" for two locations.

    Each has n, the entries behind it: where more than a share of several entries that forms lose it at write no
    direction or unit, they are a location of their own and do not lack the part.
    """
    if a["num"] != b["num"] or a["box"] != b["box"]:
        return ""
    place = a["city"] != "" and one_letter(a["city"], b["city"])
    if not (one_letter(a["street"], b["street"]) or (a["zip"] != "" and a["zip"] == b["zip"] and _close(a["street"], b["street"]))):
        return ""
    for part in _OWN:
        lacking, other = (b, a) if a[part] else (a, b)
        if other[part] and not lacking[part] and lacking["n"] > 1 and lacking["n"] > LOST_SHARE * (lacking["n"] + other["n"]):
            return ""
    less = more = False
    for part in _OPTIONAL:
        x, y = a[part], b[part]
        if x == y:
            continue
        if not x:
            less = True
        elif not y:
            more = True
        elif not (part == "city" and place) and not (part == "zip" and (place or (a["street"] == b["street"] and a["state"] == b["state"])) and sorted(x) == sorted(y) and one_letter(x, y)):
            return ""
    return "cross" if less and more else "less" if less else "more" if more else "equal"


def _gazetteer(candidates: DataFrame) -> DataFrame:
    """(c, city): what each candidate stands for, if it is a known city or one slip away from one.

    candidates: (c, options, n_named, n). Known are the names that were written as a city, short forms counted for
    the one of their readings that is in use. A name one letter from a much more frequent one is a slip of it.
    """
    named = checkpoint(candidates.where("n_named > 0").select("c", "options", "n_named"))
    plain = named.where(F.size("options") == 1).select(F.col("options")[0].alias("name"), "n_named").groupBy("name").agg(F.sum("n_named").alias("n"))
    read = named.select("c", "n_named", F.posexplode("options").alias("pos", "name")).join(plain.select("name", F.lit(0).alias("used")), "name", "left")
    chosen = read.groupBy("c", "n_named").agg(F.min_by("name", F.struct(F.coalesce("used", F.lit(1)), "pos")).alias("name"))
    totals = checkpoint(chosen.groupBy("name").agg(F.sum("n_named").alias("n")).where(~F.col("name").rlike(r"\b(BOX|APT|UNIT|STE|SUITE)\b")))
    # candidates in all their readings, exactly or by a slip
    options = checkpoint(candidates.select("c", F.posexplode("options").alias("pos", "name")))
    near = similar_words(options.select(F.col("name").alias("w")).distinct().where(F.length("w") >= 5), totals.select(F.col("name").alias("w")))
    a, b = totals.select(F.col("name").alias("a"), F.col("n").alias("n_a")), totals.select(F.col("name").alias("b"), F.col("n").alias("n_b"))
    near = near.join(b, "b").join(a, "a", "left").where(F.col("n_a").isNull() | (F.col("n_a") <= SLIP_SHARE * F.col("n_b")))
    slips = checkpoint(near.groupBy("a").agg(F.max_by("b", F.struct("ratio", "n_b", "b")).alias("city")))
    exact = totals.join(slips.select(F.col("a").alias("name")), "name", "left_anti").select("name", F.col("name").alias("city"), F.lit(0).alias("how"))
    meaning = exact.unionByName(slips.select(F.col("a").alias("name"), "city", F.lit(1).alias("how")))
    return options.join(meaning, "name").groupBy("c").agg(F.min_by("city", F.struct("how", "pos", "city")).alias("city"))


def read_addresses(rows: DataFrame) -> DataFrame:
    """(raw, p, times): for each distinct (a, c, s, z) the reading of the address that others share, else the likeliest.

    Every plausible reading is exploded with hashes of two combinations of its parts, all of them and all but
    the postcode. Of a form with several readings, the one counts whose hashes other forms' likeliest readings share.
    """

    @F.pandas_udf("array<struct<c string, options array<string>, named boolean>>")
    def candidates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([[{"c": c, "options": city_names(c), "named": named} for c, named in city_candidates(*row)] for row in _rows(batch)], dtype=object)

    @F.pandas_udf(f"array<struct<{SCHEMA}>>")
    def read(batches: Iterator[tuple[pd.DataFrame, pd.Series]]) -> Iterator[pd.Series]:
        for batch, known in batches:
            yield pd.Series([readings(*row, {x["c"]: x["city"] for x in (k if k is not None else ())}) for row, k in zip(_rows(batch), known)], dtype=object)

    fields = F.struct("a", "c", "s", "z")
    distinct = rows.groupBy("raw", "a", "c", "s", "z").agg(F.count(F.lit(1)).alias("times"))
    distinct = checkpoint(distinct.withColumn("cs", candidates(fields)))
    options = checkpoint(distinct.select("raw", "times", F.explode("cs").alias("o")).select("raw", "times", "o.*"))
    seen = options.where(F.size("options") > 0).groupBy("c").agg(F.first("options").alias("options"), F.sum(F.when(F.col("named"), F.col("times")).otherwise(0)).alias("n_named"))
    cities = checkpoint(_gazetteer(seen))
    known = hot_key_lookup(options.select("raw", "c"), "c", cities.withColumnRenamed("c", "name"), "name", ["city"]).where("city is not null").groupBy("raw").agg(F.collect_list(F.struct("c", "city")).alias("known"))
    forms = checkpoint(distinct.join(known, "raw", "left").select("raw", "a", "times", read(fields, F.col("known")).alias("ps")))

    full = F.xxhash64(*[f"p.{f}" for f in FIELDS])
    core = F.xxhash64(F.lit("core"), *[f"p.{f}" for f in FIELDS if f != "zip"])
    first = forms.select("raw", F.col("ps")[0].alias("p")).select("raw", F.explode(F.array(full, core)).alias("h"))
    shared = first.groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    several = forms.where(F.size("ps") > 1).select("raw", F.posexplode("ps").alias("pos", "p"))
    hashes = several.select("raw", "pos", F.posexplode(F.array(full, core)).alias("which", "h")).join(shared, "h")
    others = hashes.where(F.col("n") > F.when(F.col("pos") == 0, 1).otherwise(0)).groupBy("raw", "pos").agg(F.max(F.when(F.col("which") == 0, 2).otherwise(1)).alias("met"))
    best = others.groupBy("raw").agg(F.max_by("pos", F.struct("met", -F.col("pos"))).alias("best"))
    return forms.join(best, "raw", "left").select("raw", "a", "times", F.element_at("ps", F.coalesce("best", F.lit(0)) + 1).alias("p"))


def _rows(batch: pd.DataFrame) -> Iterator[tuple]:
    return zip(*[batch[c].astype(object).where(batch[c].notna(), None) for c in ("a", "c", "s", "z")])


def locations(register: DataFrame, entry: str, address: str, city: str, state: str, zip_: str) -> DataFrame:
    """(entry, location_id) for every entry with an address that is not blank.

    Addresses are expanded into their plausible readings (``read_addresses``), and equal forms collapse. Hashes of
    combinations of parts are exploded and joined, common ones by the parts that both sides have; candidates
    whose house or box numbers, units, types, directions or places conflict are rejected. Forms that differ by a
    letter of street or city, or two swapped digits of the postcode, are one. A form that lacks parts joins a
    location if it is the only one that has the rest: decided on whole groups, in rounds until none moves, so that
    what a group has learned from one member counts for all. Null and blank addresses are in no group; those
    without number and box group with the same text only. Entries should be unique.
    """
    rows = register.where(F.col(entry).isNotNull() & ~is_blank(F.col(address)))
    rows = rows.select(F.col(entry).alias("entry"), F.col(address).alias("a"), F.col(city).alias("c"), F.col(state).alias("s"), F.col(zip_).alias("z"))
    rows = rows.withColumn("raw", F.sha2(F.to_json(F.struct("a", "c", "s", "z")), 256))
    read = read_addresses(rows.select("raw", "a", "c", "s", "z"))
    lost = (F.col("p.num") == "") & (F.col("p.box") == "")
    form = F.sha2(F.when(lost, F.concat_ws("|", F.lit("?"), F.lower(squeeze(F.col("a"))), "p.zip", "p.city")).otherwise(F.concat_ws("|", *[f"p.{f}" for f in FIELDS])), 256)
    raws = checkpoint(read.select("raw", "times", form.alias("hash"), "p"))
    # short numbers for the forms: fixed once checkpointed, and all that the joins below move
    forms = checkpoint(raws.groupBy("hash").agg(F.min("p").alias("p"), F.sum("times").alias("times")).withColumn("form", F.monotonically_increasing_id()))

    @F.pandas_udf("array<string>")
    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([keys(p) for p in batch.to_dict("records")])

    digits = F.array_join(F.array_sort(F.split("p.zip", "")), "")
    keyed = checkpoint(forms.select("form", "p.unit", "p.state", digits.alias("digits"), F.explode(hashed("p")).alias("k")).withColumn("k", F.xxhash64("k")))
    blocks = _refined(keyed)
    partners = blocks.select("k", F.col("other").alias("mine"), F.col("mine").alias("other"), F.col("form").alias("form_b"))
    met = blocks.join(partners, ["k", "mine", "other"]).where("form < form_b").select("form", "form_b").distinct()
    # parts that conflict need no comparing
    firm = forms.select("form", F.struct("p.dir", "p.kind", "p.unit", "p.state").alias("f"))
    met = met.join(firm, "form").join(firm.select(F.col("form").alias("form_b"), F.col("f").alias("g")), "form_b")
    for part in ("dir", "kind", "unit", "state"):
        met = met.where((F.col(f"f.{part}") == F.col(f"g.{part}")) | (F.col(f"f.{part}") == "") | (F.col(f"g.{part}") == ""))

    @F.pandas_udf("string")
    def compared(batches: Iterator[tuple[pd.DataFrame, pd.DataFrame]]) -> Iterator[pd.Series]:
        for left, right in batches:
            yield pd.Series([compare(a, b) for a, b in zip(left.to_dict("records"), right.to_dict("records"))])

    def related(ends: DataFrame, parts: DataFrame) -> DataFrame:
        """(x, y, how) for the pairs (x, y) of groups that do not conflict."""
        wide = ends.join(parts.select(F.col("group").alias("x"), F.col("p").alias("px")), "x").join(parts.select(F.col("group").alias("y"), F.col("p").alias("py")), "y")
        return wide.select("x", "y", compared("px", "py").alias("how")).where("how <> ''")

    first = checkpoint(related(met.select(F.col("form").alias("x"), F.col("form_b").alias("y")), forms.select(F.col("form").alias("group"), F.struct("p.*", F.lit(0).cast("bigint").alias("n")).alias("p"))))
    # only forms without a conflict of their own can ever be in one group
    candidates = first.select(F.col("x").alias("form"), F.col("y").alias("form_b"))
    moves = components(first.where("how = 'equal'"), "x", "y")
    groups = forms.select("form", "p", "times", F.col("form").alias("group"))
    parts = groups.select("group", F.struct("p.*", F.col("times").alias("n")).alias("p"))
    links = checkpoint(related(first.select("x", "y"), parts))
    moves = _moves(links) if moves.isEmpty() else moves
    while not moves.isEmpty():
        groups = checkpoint(groups.join(moves.withColumnRenamed("node", "group"), "group", "left").select("form", "p", "times", F.coalesce("root", "group").alias("group")))
        # all that moved is read anew, the rest stands
        moved, roots = moves.select(F.col("node").alias("group")), moves.select(F.col("root").alias("group")).distinct()
        parts = checkpoint(parts.join(moved, "group", "left_anti").unionByName(_known_parts(groups.join(roots, "group", "left_semi"))))
        at = groups.select("form", "group")
        ends = candidates.join(at.withColumnRenamed("group", "x"), "form").join(at.select(F.col("form").alias("form_b"), F.col("group").alias("y")), "form_b").where("x <> y")
        touched = roots.withColumn("hit", F.lit(True))
        ends = ends.join(touched.withColumnRenamed("group", "x").withColumnRenamed("hit", "hit_x"), "x", "left").join(touched.withColumnRenamed("group", "y").withColumnRenamed("hit", "hit_y"), "y", "left")
        ends = ends.where("hit_x or hit_y").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
        kept = links.join(moved.withColumnRenamed("group", "x"), "x", "left_anti").join(moved.withColumnRenamed("group", "y"), "y", "left_anti")
        links = checkpoint(kept.unionByName(related(ends, parts)))
        moves = _moves(links)
    found = rows.select("entry", "raw").join(raws.select("raw", "hash"), "raw").join(forms.select("hash", "form"), "hash")
    return found.join(groups.select("form", "group"), "form").select(F.col("entry").alias(entry), F.col("group").alias("location_id"))


def _known_parts(groups: DataFrame) -> DataFrame:
    """(group, p): what a group knows, of each part the value written most often, and its number of entries."""
    long = groups.select("group", "times", F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f"p.{f}").alias("v")) for f in FIELDS])).alias("o")).where("o.v <> ''")
    written = long.groupBy("group", "o.f", "o.v").agg(F.sum("times").alias("n")).groupBy("group", "f").agg(F.max_by("v", F.struct("n", "v")).alias("v"))
    known = written.groupBy("group").agg(F.map_from_entries(F.collect_list(F.struct("f", "v"))).alias("m"))
    sizes = groups.groupBy("group").agg(F.sum("times").alias("n"))
    return sizes.join(known, "group", "left").select("group", F.struct(*[F.coalesce(F.try_element_at("m", F.lit(f)), F.lit("")).alias(f) for f in FIELDS], F.col("n")).alias("p"))


def _moves(links: DataFrame) -> DataFrame:
    """(node, root): groups that join another, given how they relate; all that join along a chain share a root.

    A group may join if a single one has the rest of it; two that each lack something must be each other's only.
    """
    there = links.select(F.col("x").alias("g"), F.col("y").alias("h"), "how")
    back = links.select(F.col("y").alias("g"), F.col("x").alias("h"), F.when(F.col("how") == "less", "more").when(F.col("how") == "more", "less").otherwise(F.col("how")).alias("how"))
    rest = there.unionByName(back).where("how <> 'more'")
    # who has all of the rest goes before who has only some of it
    rank = F.when(F.col("how") == "cross", 1).otherwise(0)
    first = rest.groupBy("g").agg(F.min(rank).alias("rank"))
    rest = rest.join(first, "g").where(F.col("rank") == rank)
    only = rest.groupBy("g").agg(F.min("h").alias("h"), F.max("h").alias("last"), F.min("how").alias("how")).where("h = last").select("g", "h", "how")
    mutual = only.select(F.col("g").alias("h"), F.col("h").alias("g"), F.lit(True).alias("mutual"))
    fit = only.join(mutual, ["g", "h"], "left").where((F.col("how") != "cross") | F.col("mutual")).select("g", "h")
    return components(fit, "g", "h")
