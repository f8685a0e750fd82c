"""Components against union-find on random graphs, chains and hubs."""

from __future__ import annotations

import random

import pytest

from tenure.llm.components import cluster_ids


def union_find(nodes, pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        if a and b and a.strip() and b.strip():
            ra, rb = find(a), find(b)
            parent[max(ra, rb)] = min(ra, rb)
    return {n: find(n) for n in nodes}


def clusters(spark, nodes, pairs):
    n = spark.createDataFrame([(x, "t") for x in nodes], "k string, root string")
    p = spark.createDataFrame([(a, b, 1) for a, b in pairs], "a string, b string, node int")
    return {r["k"]: r["cluster_id"] for r in cluster_ids(n, "k", p, "a", "b").collect()}


CHAIN = [f"n{i:03}" for i in range(60)]
RNG = random.Random(5)
GRAPHS = {
    "chain": (CHAIN, list(zip(CHAIN, CHAIN[1:]))),
    "shuffled chain": (CHAIN, [tuple(RNG.sample(p, 2)) for p in RNG.sample(list(zip(CHAIN, CHAIN[7:] + CHAIN[:7])), 60)]),
    "hub": (CHAIN, [(CHAIN[30], x) for x in CHAIN]),
    "random": ([f"r{i}" for i in range(200)], [(f"r{RNG.randrange(200)}", f"r{RNG.randrange(200)}") for _ in range(120)]),
}


@pytest.mark.parametrize("name", GRAPHS)
def test_equals_union_find(spark, name):
    nodes, pairs = GRAPHS[name]
    assert clusters(spark, nodes, pairs) == union_find(nodes, pairs)


def test_nulls_blanks_self_and_repeats(spark):
    nodes = ["a", "b", "c", "d", "a", None, ""]
    pairs = [("a", "b"), ("b", "a"), ("a", "b"), ("c", "c"), (None, "c"), ("c", " "), ("", "d"), (None, None)]
    assert clusters(spark, nodes, pairs) == {"a": "a", "b": "a", "c": "c", "d": "d", "": ""}


def test_unknown_key_still_links(spark):
    assert clusters(spark, ["b", "c"], [("b", "x"), ("x", "c")]) == {"b": "b", "c": "b"}


def test_empty(spark):
    assert clusters(spark, [], []) == {} and clusters(spark, ["a"], []) == {"a": "a"}
