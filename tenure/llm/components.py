"""Consolidating pairwise matches into groups: connected components of billions of pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenure.functions.text import is_blank
from tenure.operators.joins import hot_key_lookup
from tenure.session import checkpoint


def clean_edges(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b), a < b, distinct; pairs with a null or blank end or of a key with itself are left out."""
    known = [~is_blank(F.col(c)) if kind == "string" else F.col(c).isNotNull() for c, kind in pairs.select(a, b).dtypes]
    ends = pairs.where(known[0] & known[1] & (F.col(a) != F.col(b)))
    return ends.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()


def components(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node of a clean pair; root is the smallest node of its component.

    Each round hooks every node to the smallest label among itself and its neighbors, flattens these pointers
    by jumping until none changes, and relabels the edges; edges inside a component vanish. Rounds end when no
    edge is left. The nodes that remain at least halve in a round, the depth of the pointers halves in a jump.
    Every round is checkpointed. Minima combine before the shuffle and pointers of hot nodes are broadcast
    (bounded), so a hub is no long task. Empty input: no rows.
    """
    edges = checkpoint(clean_edges(pairs, a, b))
    rounds: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.select(F.col("a").alias("node"), F.col("a").alias("label")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("label")))
        parents = flatten(checkpoint(both.groupBy("node").agg(F.min("label").alias("root"))))
        rounds.append(parents)
        at_a = hot_key_lookup(edges, "a", parents.withColumnRenamed("root", "root_a"), "node", ["root_a"])
        at_b = hot_key_lookup(checkpoint(at_a), "b", parents.withColumnRenamed("root", "root_b"), "node", ["root_b"])
        edges = checkpoint(clean_edges(at_b.select("root_a", "root_b"), "root_a", "root_b"))
    if not rounds:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    # from the last, smallest round back to the first
    result = rounds[-1]
    for parents in reversed(rounds[:-1]):
        above = result.withColumnRenamed("root", "above")
        result = checkpoint(hot_key_lookup(parents, "root", above, "node", ["above"]).select("node", F.coalesce("above", "root").alias("root")))
    return result


def flatten(parents: DataFrame) -> DataFrame:
    """Pointer jumping: every node points to the root of its tree. parents: (node, root), root <= node."""
    while True:
        jumped = hot_key_lookup(parents, "root", parents.withColumnRenamed("root", "above"), "node", ["above"])
        jumped = checkpoint(jumped.select("node", F.coalesce("above", "root").alias("root"), (F.coalesce("above", "root") != F.col("root")).alias("moved")))
        parents = jumped.select("node", "root")
        if jumped.where("moved").isEmpty():
            return parents


def cluster_ids(nodes: DataFrame, key: str, pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(key, cluster_id) for every distinct key of nodes: the smallest key it is linked with, itself if unlinked.

    Null keys are left out, repeated ones come once. Keys that occur only in pairs still link others.
    """
    roots = components(pairs, a, b)
    keys = nodes.where(F.col(key).isNotNull()).select(F.col(key).alias("node")).distinct()
    return keys.join(roots, "node", "left").select(F.col("node").alias(key), F.coalesce("root", "node").alias("cluster_id"))
