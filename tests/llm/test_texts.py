"""Leak search, mixing and truncation against brute force and hand-made cases."""

from __future__ import annotations

import os
import random

import numpy as np
import pytest

from tenure.llm import contamination, mixing, truncation

RNG = random.Random(11)
VOCABULARY = [f"w{i}" for i in range(30)]


def test_long_inline_tags_leave_no_words():
    href = "https://example.org/" + "x" * 300
    assert contamination.words(f'the <a href="{href}" class="a b c">old</a> mill') == ["the", "old", "mill"]


def test_words():
    assert contamination.words("The <b>old</b> mill-\nrace, near A&amp;B;<br>l'acte N° 5_6") == ["the", "old", "millrace", "near", "a", "b", "l", "acte", "n", "5", "6"]
    assert contamination.words("forty-\nsix par-\n tition", {"forty": 0, "six": 1, "partition": 2}) == ["forty", "six", "partition"]
    assert contamination.words(None) == [] and contamination.words("--") == []


def test_suffix_array():
    tokens = np.array([RNG.randrange(3) for _ in range(300)])
    order = contamination.suffix_array(tokens, 40)
    keys = [tuple(tokens[i : i + 40]) for i in order]
    assert keys == sorted(keys) and sorted(order) == list(range(300))
    assert len(contamination.suffix_array(np.array([], dtype=np.int64), 5)) == 0


def longest(a: list[str], b: list[str], least: int) -> int:
    best, row = 0, [0] * (len(b) + 1)
    for x in a:
        row = [0] + [row[j] + 1 if x == y else 0 for j, y in enumerate(b)]
        best = max(best, *row)
    return best if best >= least else 0


@pytest.mark.parametrize("shard", [50, 10**6])
def test_leaks_equal_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(contamination, "SHARD_WORDS", shard)
    rng = random.Random(11)
    items = [(i, " ".join(rng.choices(VOCABULARY, k=rng.randrange(3, 40)))) for i in range(12)] + [(12, None), (13, "")]
    docs = []
    for d in range(60):
        text = rng.choices([*VOCABULARY, "zz"], k=rng.randrange(0, 60))
        if d % 3 == 0:
            source = items[rng.randrange(12)][1].split()
            start = rng.randrange(len(source))
            text[10:10] = source[start : start + rng.randrange(2, 20)]
        docs.append((d, " ".join(text)))
    docs += [(100, None), (101, ""), (102, docs[0][1]), (0, docs[0][1]), (103, "w1 " * 5000)]
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, item int")
    it = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["longest"] for r in contamination.find_leaks(d, "doc_id", "text", it, "item_id", "text", 6).collect()}
    want = {(a, b): n for a, t in docs for b, u in items if (n := longest(contamination.words(t), contamination.words(u), 6))}
    assert got == want and len(want) > 5


def test_leak_blocks_and_empty(spark, monkeypatch):
    monkeypatch.setattr(contamination, "BLOCK_CHARS", 40)
    text = "one two three four five six seven eight nine ten eleven twelve thirteen"
    d = spark.createDataFrame([("a", f"x <i>{text.upper()}</i> y"), ("b", text[:40])], "doc_id string, text string")
    it = spark.createDataFrame([(1, text), (2, text + "?"), (3, "other words")], "item_id int, text string")
    leaks = contamination.find_leaks(d, "doc_id", "text", it, "item_id", "text")
    assert {tuple(r) for r in leaks.collect()} == {("a", 1, 13, 1, 0), ("a", 2, 13, 1, 0)}
    assert [r["doc_id"] for r in contamination.without_leaks(d, "doc_id", leaks).collect()] == ["b"]
    assert contamination.find_leaks(d.limit(0), "doc_id", "text", it, "item_id", "text").count() == 0
    assert contamination.find_leaks(d, "doc_id", "text", it.limit(0), "item_id", "text").count() == 0


def test_long_items_and_tags(spark):
    """An item of 50,000 words, a tag of 5,000 characters within a passage, and many copies of one text."""
    rng = random.Random(5)
    story = [f"{rng.choice(VOCABULARY)}x{rng.randrange(40)}" for _ in range(50_000)]
    passage = [f"p{i}" for i in range(16)]
    tag = '<span title="' + "no words here " * 360 + '">'
    docs = [("whole", "zz " + " ".join(story) + " zz"), ("part", " ".join(story[30_000:30_040])), ("tag", " ".join(passage[:8]) + tag + " " + " ".join(passage[8:]) + "</span>"), ("none", " ".join(story[7:18]))]
    docs += [(f"copy{i}", "q " + " ".join(story[100:140])) for i in range(300)]
    d, it = spark.createDataFrame(docs, "doc_id string, text string"), spark.createDataFrame([(1, " ".join(story)), (2, " ".join(passage))], "item_id int, text string")
    got = {(r["doc_id"], r["item_id"]): (r["longest"], r["doc_word"], r["item_word"]) for r in contamination.find_leaks(d, "doc_id", "text", it, "item_id", "text").collect()}
    assert got == {("whole", 1): (50_000, 1, 0), ("part", 1): (40, 0, 30_000), ("tag", 2): (16, 0, 0), **{(f"copy{i}", 1): (40, 1, 100) for i in range(300)}}


def mixture(spark, docs, weights):
    counted = spark.createDataFrame([(*d, "c") for d in docs], "doc_id long, source string, n_tokens long, rank string")
    plan = mixing.plan_mixture(counted, "source", spark.createDataFrame(weights, "source string, target_share double, max_repeats int"))
    drawn = mixing.draw(counted, "doc_id", "source", plan).cache()
    return drawn, {r["source"]: r for r in mixing.reached(drawn, "source", plan).collect()}


def test_mixture_meets_shares_and_caps(spark):
    docs = [(i, "big" if i % 3 else "small" if i % 2 else "mid", RNG.randrange(1, 200)) for i in range(3000)] + [(9000, "big", 0), (9001, "stranger", 50), (9002, None, 5)]
    drawn, shares = mixture(spark, docs, [("big", 0.3, 1), ("small", 0.4, 4), ("mid", 0.2, 2), ("none", 0.1, 3)])
    for name, target in (("big", 1 / 3), ("small", 4 / 9), ("mid", 2 / 9)):
        assert abs(shares[name]["reached_share"] - target) < 0.002 and shares[name]["most_copies"] <= shares[name]["max_repeats"]
    assert shares["none"]["reached_share"] == 0 and drawn.where("doc_id in (9000, 9001, 9002)").count() == 0
    total, whole = sum(s["drawn_tokens"] for s in shares.values()), sum(n for _, _, n in docs)
    assert abs(total - whole) < 0.01 * whole
    assert drawn.groupBy("doc_id", "copy_no").count().where("count > 1").count() == 0


def test_mixture_total_gives_way(spark):
    _, shares = mixture(spark, [(i, "a" if i < 10 else "b", 10) for i in range(100)], [("a", 0.5, 1), ("b", 0.5, 1)])
    assert shares["a"]["drawn_tokens"] == 100 and abs(shares["b"]["drawn_tokens"] - 100) <= 10 and shares["a"]["most_copies"] == 1


def test_mixture_of_nothing(spark):
    drawn, shares = mixture(spark, [], [("a", 1.0, 2)])
    assert drawn.count() == 0 and shares["a"]["reached_share"] == 0


def test_token_counts(spark):
    other = "/opt/tokenizers/byte_bpe_50k.json"
    if not (os.path.exists(mixing.TOKENIZER) and os.path.exists(other)):
        pytest.skip("no tokenizer here")
    from tokenizers import Tokenizer

    texts = ["The quick brown fox", "", None, "né à l'été <|endoftext|>", "x" * 50000, "  two  spaces\n\nand lines "]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    # the same vocabulary in the form of another library
    model = Tokenizer.from_file(other)
    model.encode_special_tokens = True
    assert {r["doc_id"]: r["n_tokens"] for r in mixing.token_counts(df, "text").collect()} == {i: len(model.encode(t or "", add_special_tokens=False)) for i, t in enumerate(texts)}


SENTENCE = "The clerk returned the lease rider before the second reading. "


def verdicts(spark, rows):
    df = spark.createDataFrame([(*r, True) for r in rows], "doc_id long, source string, text string, token boolean")
    return {r["doc_id"]: r["truncated"] for r in truncation.find_truncated(df, "doc_id", "source", "text").collect()}, df


def test_truncation(spark):
    fill = [(1000 + i, "s", " ".join(RNG.choices(VOCABULARY, k=RNG.randrange(5, 200))) + ". " + SENTENCE + ("\n" + ["Signed: Ann Hollow", "Filed 2020-01-02", "END OF RECORD", "Heat: old\nRoof: new slate\nFront: 24 ft"][i // 2 % 4] if i % 2 else "")) for i in range(200)]
    fill += [(2000 + i, "list", "Roof: new slate\nHeat: old boiler\nFront: 30 ft\nRoof: old slate") for i in range(20)]
    cases = {
        1: (SENTENCE, False), 2: (SENTENCE[:40], True), 3: (SENTENCE + "\nFiled 2021-05-06", False), 4: (SENTENCE + "\nFiled 2021-05", True), 5: (SENTENCE + "\nEND OF RE", True),
        6: ("Heat: old boiler\nRoof: new sla", True), 7: ("Heat: old boiler\nFront: 30", True), 8: ("Heat: old boiler\nFront: 31 ft", False), 9: (SENTENCE + "The cl…", True), 10: (SENTENCE + "He said “no.”  \n", False),
        11: (SENTENCE + "\nSigned: Bob Tidmarsh", False), 12: (SENTENCE + "It cost �", True), 13: ("¿Dónde? " + SENTENCE * 500, False), 14: (SENTENCE + "The board noted that the", True),
    }
    got, _ = verdicts(spark, [*fill, *((k, "s", t) for k, (t, _) in cases.items()), (50, "s", None), (51, "s", "  \n"), (52, None, "It ends mid")])
    assert {k: got[k] for k in cases} == {k: v for k, (_, v) in cases.items()}
    assert 50 not in got and 51 not in got and got[52]


def test_limits_and_rates(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choices("abcdefgé ", k=rng.randrange(40, 400))) for _ in range(600)]
    rows = [(i, "chars", t[:200] if len(t) > 200 else t + ".") for i, t in enumerate(texts)]
    rows += [(1000 + i, "bytes", t.encode()[:200].decode(errors="ignore")) for i, t in enumerate(texts)]
    rows += [(2000 + i, "free", t + ".") for i, t in enumerate(texts)]
    got, df = verdicts(spark, rows)
    limits = truncation.storage_limits(df, "source", "text")
    assert {r["source"]: (r["encoding"], r["length_limit"]) for r in limits.collect()} == {"chars": ("characters", 200), "bytes": ("utf8_bytes", 200)}
    rates = {r["source"]: r for r in truncation.truncation_rates(truncation.find_truncated(df, "doc_id", "source", "text", limits), "source", limits).collect()}
    assert rates["free"]["n_truncated"] == 0 and rates["chars"]["rate"] > 0.3


def test_no_texts(spark):
    got, _ = verdicts(spark, [])
    assert got == {}
