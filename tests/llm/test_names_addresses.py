"""Linking of names and addresses on hand-made cases, by the operators and by comparing all pairs."""

from __future__ import annotations

import random
from itertools import combinations

import pytest

from tenure.llm import addresses, names

SAME = [
    ["ROBERT SMITHSON", "SMITHSON ROBERT", "BOB SMITHSON", "ROBERT SMITHSNO", "RBOERT SMITHSON"],
    ["ANNE LUKASEKEM"],
    ["SUSAN LUKASEKEM", "SUE LUKASEKEM"],
    ["DANIEL GROPLUBROVOM"],
    ["DANIELA GROPLUBROVOM"],
    ["ANNA H ZAFIBROSTI", "ANNA ZAFIBROSTI"],
    ["ANNA H ZAFIBROSTI JR"],
    ["REBECCA T KOLOGEKUR"],
    ["REBECCA K KOLOGEKUR"],
    ["REBECCA KOLOGEKUR"],
    ["KATHERINE TEDODOSTEL", "K TEDODOSTEL"],
    ["ROBERT & KATHERINE FALIPLAHAT", "KATE AND BOB FALIPLAHAT"],
    ["ROBERT FALIPLAHAT"],
    ["RABRONUFAL CANYON ASSOCIATES INC", "RABRONUFAL CANYON ASSOC", "RABRONUFALCANYON ASSOCIATES INC", "ASSOCIATES OF RABRONUFAL CANYON INC", "THE RABRONUFAL CANYON ASSOCIATTES INC"],
    ["RABRONUFAL CANYON ASSOCIATES II INC"],
    ["RABRONUFAL RIDGE ASSOCIATES INC"],
    ["67 ZITRITUSAT STREET LLC", "67ZITRITUSAT ST LLC"],
    ["69 ZITRITUSAT STREET LLC"],
    ["GATIKAKUR FAMILY TRUST", "THE GATIKAKUR FAM TR", "TRUSTEE OF THE GATIKAKUR FAMILY TRUST", "FAMILY TRUST OF GATIKAKUR"],
]


def groups(frame, key, group):
    found = {}
    for r in frame.collect():
        found.setdefault(r[group], set()).add(r[key])
    return sorted(sorted(g) for g in found.values())


#: Families by which both given names are seen to be in use.
OTHERS = [f"DANIEL {s}" for s in ("MUTREDREN", "BASTIKUR", "ZOPLUGEK", "HENALIDRE")] + [f"DANIELA {s}" for s in ("KESTOVAR", "LUPRIDAM", "TOBEGRAN", "PORIMEK")]


def test_names(spark):
    rows = [(n, n, i) for i, g in enumerate(SAME) for n in g] + [("null", None, 0), ("blank", "  ", 0), (None, "X", 0), ("dots", "...", 0), ("long", "X" * 20000 + " Y", 0)] + [(n, n, 0) for n in OTHERS]
    frame = spark.createDataFrame(rows, "id string, name string, form int")
    got = [g for g in groups(names.variant_groups(frame, "id", "name"), "id", "group_id") if not set(g) <= set(OTHERS)]
    assert got == sorted([*(sorted(g) for g in SAME), ["dots"], ["long"]])


LINKED = [
    ["GREENWOOD LLC", "GREENWODO LLC"], ["BELVEDERE LLC", "BELVEDEER LLC"], ["WALNUT GROVE LLC", "WALNUTGROVE LLC", "WALNUT GROEV LLC"], ["PARK PARK SMITH", "PARKPARK SMITH"], ["ACME HOLDINGS", "ACME HOLDINGS LLC", "S ACME HOLDINGS LLC"],
    ["JOHN QUAVERLY", "JHON QUAVERLY", "JOHN QUAVERLYY", "J QUAVERLY"], ["MARINA LAGO NORTE INC", "MARIAN LAGO NROTE INC"],
]


def test_links_that_blocks_once_lost(spark):
    rows = [(n, n) for g in LINKED for n in g]
    assert groups(names.variant_groups(spark.createDataFrame(rows, "id string, name string"), "id", "name"), "id", "group_id") == sorted(sorted(g) for g in LINKED)


@pytest.mark.parametrize("block", [1, 64])
def test_suffix_blocks_lose_no_pair(spark, monkeypatch, block):
    """Every two words with one letter added, lost, changed or swapped with its neighbor meet, in common blocks too."""
    monkeypatch.setattr(names, "BLOCK", block)
    rng = random.Random(3)
    words = {"".join(rng.choices("ABC", k=rng.randrange(4, 14))) for _ in range(150)} | {"X" * 500 + "STEL"}
    for w in list(words):
        i = rng.randrange(len(w) - 1)
        words |= {w[:i] + w[i + 1 :], w[:i] + "D" + w[i:], w[:i] + "E" + w[i + 1 :], w[:i] + w[i + 1] + w[i] + w[i + 2 :]}
    frame = spark.createDataFrame([(w,) for w in words], "w string")
    got = {(r["a"], r["b"]) for r in names.similar_words(frame, frame).collect()}

    def edits(w):
        return {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in "ABCDE"} | {w[:i] + w[i + 1] + w[i] + w[i + 2 :] for i in range(len(w) - 1)}

    want = {(a, b) for w in words for x in edits(w) if x in words and x != w for a, b in ((w, x), (x, w)) if names.slip_ratio(a, b) > 0}
    assert want <= got and all(names.slip_ratio(a, b) > 0 for a, b in got)


GIVEN = "ROBERT WILLIAM SUSAN ERIC ERICA LUIS LUISA PAUL PAULA ANNA ANNE OMAR FATIMA IVAN VERA CELIA FELIX MEI JOHN JOAN".split()
SHORT = {"ROBERT": "BOB", "WILLIAM": "BILL", "SUSAN": "SUE"}


def labelled(families: int, seed: int):
    """(id, name, owner) of people and companies as typed: reordered, mistyped, shortened."""
    rng = random.Random(seed)
    part = lambda n: "".join(rng.choice("BDFGKLMNPRSTVZ") + rng.choice("AEIOU") for _ in range(n))

    def slip(word):
        i = rng.randrange(1, len(word) - 1)
        return rng.choice([word[:i] + word[i + 1 :], word[:i] + word[i] + word[i:], word[:i] + word[i + 1] + word[i] + word[i + 2 :]])

    rows, owner = [], 0
    for _ in range(families):
        surname = part(5)
        for given in rng.sample(GIVEN, 2):
            kinds = [f"{given} {surname}", f"{surname} {given}", f"{SHORT.get(given, given)} {surname}", f"{given} {slip(surname)}"]
            rows += [(n, owner) for n in rng.sample(kinds, 3)]
            owner += 1
        name, kind = part(4), rng.choice(["HOLDINGS", "REALTY", "MANAGEMENT"])
        for number in ("", " II"):
            kinds = [f"{name} {kind}{number} LLC", f"THE {name} {kind}{number} LLC", f"{slip(name)} {kind}{number} LLC", f"{name} {slip(kind)}{number} LLC"]
            rows += [(n, owner) for n in rng.sample(kinds, 3)]
            owner += 1
    seen = {}
    return [(i, n, o) for i, (n, o) in enumerate(rows) if seen.setdefault(n, i) == i]


@pytest.mark.parametrize("families", [60, 600])
def test_recall_and_precision(spark, families):
    rows = labelled(families, families)
    found = names.variant_groups(spark.createDataFrame(rows, "id int, name string, owner int"), "id", "name").collect()
    truth, by_group = {i: o for i, _, o in rows}, {}
    for r in found:
        by_group.setdefault(r["group_id"], []).append(r["id"])
    by_owner = {}
    for i, o in truth.items():
        by_owner.setdefault(o, []).append(i)
    got = {p for g in by_group.values() for p in combinations(sorted(g), 2)}
    want = {p for g in by_owner.values() for p in combinations(sorted(g), 2)}
    assert len(got & want) >= 0.98 * len(want) and len(got & want) >= 0.98 * len(got), (len(got), len(want), len(got & want))


def test_no_names(spark):
    empty = names.variant_groups(spark.createDataFrame([], "id string, name string"), "id", "name")
    assert empty.count() == 0 and names.pairs_of_groups(empty, "id", "group_id").count() == 0


@pytest.mark.parametrize(("a", "b", "n"), [("ABCD", "ABDC", 3), ("RENTALS", "RENTTALS", 7), ("", "A", 0), ("SAME", "SAME", 4), ("KITTEN", "SITTING", 4)])
def test_common_length(a, b, n):
    assert names.common_length(a, b) == n


PLACES = [
    ["1243 SOUTH DRODATROTRIS PARKWAY, NORTH KESTEN IL 93897", "1243 Drodatrotris Pkwy S - N Kesten IL 93897-1111", "93897 NORTH KESTEN IL - 1243 So. DRODATROTRIS", "C/O OWNER, 1243 S DRODATROTRSI PKY NORTH KESTEN IL 93897"],
    ["1243 NORTH DRODATROTRIS PARKWAY, NORTH KESTEN IL 93897"],
    ["1245 SOUTH DRODATROTRIS PARKWAY, NORTH KESTEN IL 93897"],
    ["57 BEBRESADOR STREET APT 8C, NORTH KESTEN IL 41304", "57 BEBRESADOR ST #8C IL 41304", "UNIT 8C, 57 Bebresador St."],
    ["57 BEBRESADOR STREET APT 9, NORTH KESTEN IL 41304"],
    ["57 BEBRESADOR COURT, NORTH KESTEN IL 41304", "57 BEBRESADOR CT NORTH KESTEN IL 41304"],
    ["PO BOX 611, SAINT ORREN PA 93960", "P.O. Box 611 St Orren PA 93960-1409", "POB 611,SAINT OREN PA 93960"],
    ["PO BOX 612, SAINT ORREN PA 93960"],
    ["711 BUFABRE STREET, SAINT ORREN PA 12345", "711 BUFABRE ST ORREN PA 12345"],
    ["20 ZADRE LANE, NORTH KESTEN IL 11111"],
    ["20 ZADRE LANE, SAINT ORREN PA 22222"],
    ["20 ZADRE LANE"],
]


def test_addresses(spark):
    rows = [(a, a, None, None, None) for g in PLACES for a in g]
    rows += [("c1", "1243 SO DRODATROTRIS PKWY", "N KESTEN", "IL", ""), ("c2", "PO BOX 612", "", "PA", "93960-0001"), ("null", None, "X", "PA", ""), ("blank", " ", None, None, None), ("text", "UNKNOWN", None, None, None), ("long", "9" * 5000, None, None, None)]
    frame = spark.createDataFrame([(*r, "clash") for r in rows], "id string, a string, city string, state string, zip string, form string")
    want = [sorted([*g, *(["c1"] if "1243 SOUTH" in g[0] else []), *(["c2"] if "BOX 612" in g[0] else [])]) for g in PLACES]
    got = groups(addresses.locations(frame, "id", "a", "city", "state", "zip"), "id", "location_id")
    assert got == sorted([*want, ["text"], ["long"]])


def test_common_address_blocks_lose_no_pair(spark):
    """In a tower of over 64 units, forms without postcode or unit's place still meet the one with it; so does a street's slip."""
    tower = [[f"1 BRANDOVER ST STE {n}, NORTH KESTEN IL 93897"] for n in range(500, 580)]
    tower[0] += ["1 BRANDOVER STREET STE 500", "1 BRANDOVER STREET STE 500, NORTH KESTEN", "1 BRANDVOER ST STE 500, NORTH KESTEN IL"]
    boxes = [[f"PO BOX 7, PL{chr(65 + n // 9) * 2}{'BCDFGHKLM'[n % 9] * 2}OT IL {60001 + 37 * n if n else 99999}"] for n in range(90)]
    boxes[0] += ["POB 7 IL 99999"]
    places = [*tower, *boxes]
    frame = spark.createDataFrame([(a, a, None, None, None) for g in places for a in g], "id string, a string, city string, state string, zip string")
    got = groups(addresses.locations(frame, "id", "a", "city", "state", "zip"), "id", "location_id")
    assert sorted(tower[0]) in got and sorted(boxes[0]) in got


def read(text, known=()):
    return addresses.readings(text, None, None, None, {c: c for c in known})


def test_linked_addresses_share_a_key():
    streets = ["BRANDOVER", "BRANDVOER", "RBANDOVER", "BRNDOVER", "BRANDOVERR", "XRANDOVEY", "MAIN", "MAINS", "AMIN"]
    parsed = [addresses.readings(f"1 {s} ST", "NORTH KESTEN", "IL", z, {})[0] | {"n": 1} for s in streets for z in ("", "93897")]
    for a, b in combinations(parsed, 2):
        assert not addresses.compare(a, b) or set(addresses.keys(a)) & set(addresses.keys(b)), (a, b)


def test_readings():
    forms = lambda text, *known: [{k: v for k, v in r.items() if v} for r in read(text, known)]
    unit = {"num": "100", "street": "MAIN", "kind": "STREET", "unit": "4B", "city": "BROOKLYN", "state": "NY", "zip": "11201"}
    assert forms("100 MAIN ST 4B, BROOKLYN, NY 11201", "BROOKLYN")[0] == unit == forms("100 Main St. Apt 4B Brooklyn NY 11201", "BROOKLYN")[0]
    assert forms("JOHN DOE C/O ACME CORP, 55 OAK AVE, BROOKLYN NY 11201", "BROOKLYN") == [{"num": "55", "street": "OAK", "kind": "AVENUE", "city": "BROOKLYN", "state": "NY", "zip": "11201"}]
    assert forms("100-12 QUEENS BLVD") == [{"num": n, "street": "QUEENS", "kind": "BOULEVARD"} for n in ("100-12", "10012")]
    assert forms("20 NORTH ST") == [{"num": "20", "street": "NORTH", "kind": "STREET"}]
    assert {"num": "57", "street": "BEBRES", "state": "CT"} in forms("57 BEBRES CT") and forms("57 BEBRES CT")[0]["kind"] == "COURT"
    assert {r["street"] for r in forms("12 ST JAMES PL")} == {"SAINT JAMES", "ST JAMES"}
    assert read("", ()) and read(None, ()) and len(read("A " * 3000, ())) >= 1


def test_other_forms_decide_between_readings(spark):
    """A number written together joins the one with a hyphen; a unit without mark the one with it; a name before the care-of mark is none."""
    same = [["100-12 QUEENS BLVD, NORTH KESTEN IL 93897", "10012 QUEENS BLVD, NORTH KESTEN IL 93897"], ["100 MAIN ST 4B, NORTH KESTEN IL 93897", "100 MAIN STREET APT 4B, NORTH KESTEN IL 93897"], ["100 MAIN ST 4C, NORTH KESTEN IL 93897"],
            ["JOHN DOE C/O ACME CORP, 55 OAK AVE, NORTH KESTEN IL 93897", "55 OAK AVENUE, NORTH KESTEN IL 93897"]]
    frame = spark.createDataFrame([(a, a, None, None, None) for g in same for a in g], "id string, a string, city string, state string, zip string")
    assert groups(addresses.locations(frame, "id", "a", "city", "state", "zip"), "id", "location_id") == sorted(sorted(g) for g in same)


def test_without_direction_by_most(spark):
    """One form that lost its direction joins; a street that most write without is another than its namesake with one."""
    lost = ["7 N BRANDOVER ST, NORTH KESTEN IL 93897", "7 NORTH BRANDOVER STREET, NORTH KESTEN IL 93897-1111", "7 NORTH BRANDOVER ST, NORTH KESTEN IL", "7 BRANDOVER ST, NORTH KESTEN IL 93897"]
    most = ["9 BRANDOVER ST, NORTH KESTEN IL 93897", "9 BRANDOVER STREET, NORTH KESTEN IL 93897-1111", "9 BRANDVOER ST, NORTH KESTEN IL 93897"]
    same = [lost, most, ["9 WEST BRANDOVER ST, NORTH KESTEN IL 93897"]]
    frame = spark.createDataFrame([(a, a, None, None, None) for g in same for a in g], "id string, a string, city string, state string, zip string")
    assert groups(addresses.locations(frame, "id", "a", "city", "state", "zip"), "id", "location_id") == sorted(sorted(g) for g in same)


def labelled_addresses(places: int, seed: int):
    """(id, address, city, state, zip, place) as typed: shortened, reordered, mistyped, without parts."""
    rng = random.Random(seed)
    part = lambda n: "".join(rng.choice("BDFGKLMNPRSTVZ") + rng.choice("AEIOU") for _ in range(n))
    cities = [(f"{side} {part(3)}", st, str(rng.randrange(10000, 99999))) for side in ("NORTH", "LAKE", "PORT") for st in ("IL", "PA", "CT") for _ in range(2)]
    streets = [(part(4), kind, short) for kind, short in (("STREET", "ST"), ("AVENUE", "AVE"), ("COURT", "CT"), ("LANE", "LN")) for _ in range(max(6, places // 20))]
    rows, seen = [], set()
    for place in range(places):
        number, (street, kind, short), (city, st, zp), unit = rng.randrange(1, 2000), rng.choice(streets), rng.choice(cities), rng.choice(["", "", "4B", "12"])
        if (number, street) in seen:
            continue
        seen.add((number, street))
        i = rng.randrange(1, len(street) - 2)
        slip = street[:i] + street[i + 1] + street[i] + street[i + 2 :]
        apt, hash_, bare = (f" APT {unit}", f" #{unit}", f" {unit}") if unit else ("", "", "")
        texts = [f"{number} {street} {kind}{apt}, {city} {st} {zp}", f"{number} {street.title()} {short}{hash_} {city} {st} {zp}-1234", f"{number} {street} {short}{bare}, {city}, {st} {zp}", f"C/O OWNER, {number} {slip} {short}{apt}, {city} {st} {zp}", f"{number} {street} {kind}{apt}, {city} {st}"]
        rows += [(t, None, None, None, place) for t in rng.sample(texts, 3)] + [(f"{number} {street} {short}{apt}", city, st, zp, place)]
    return [(i, *r) for i, r in enumerate(rows)]


@pytest.mark.parametrize("places", [60, 600])
def test_address_recall_and_precision(spark, places):
    rows = labelled_addresses(places, places)
    frame = spark.createDataFrame(rows, "id int, a string, city string, state string, zip string, place int")
    found, place = {}, {r[0]: r[5] for r in rows}
    for r in addresses.locations(frame, "id", "a", "city", "state", "zip").collect():
        found.setdefault(r["location_id"], []).append(r["id"])
    true = {}
    for i, p in place.items():
        true.setdefault(p, []).append(i)
    got = {p for g in found.values() for p in combinations(sorted(g), 2)}
    want = {p for g in true.values() for p in combinations(sorted(g), 2)}
    assert len(got & want) >= 0.98 * len(want) and len(got & want) >= 0.98 * len(got), (len(got), len(want), len(got & want))


def test_no_addresses(spark):
    frame = spark.createDataFrame([], "id string, a string, city string, state string, zip string")
    assert addresses.locations(frame, "id", "a", "city", "state", "zip").count() == 0
