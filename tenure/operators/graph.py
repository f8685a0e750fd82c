"""Links between owners that share something, and their components by alternating stars."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenure.functions.text import is_blank
from tenure.operators.joins import hot_key_lookup
from tenure.session import checkpoint


def star_links(df: DataFrame, member: str, shared: str) -> DataFrame:
    """(a, b): every member of a group with the group's least member, k - 1 links for k members, not all pairs."""
    rows = checkpoint(df.where(~is_blank(F.col(member)) & ~is_blank(F.col(shared))).select(F.col(member).alias("m"), F.col(shared).alias("s")).distinct())
    least = rows.groupBy("s").agg(F.min("m").alias("a"))
    return hot_key_lookup(rows, "s", least, "s", ["a"]).where("m <> a").select("a", F.col("m").alias("b")).distinct()


def denylist(df: DataFrame, member: str, shared: str, least_degree: int, seeds: DataFrame | None = None) -> DataFrame:
    """(shared, degree, reason): values that link too many members, are blank or stand in the seed list."""
    degrees = df.groupBy(F.coalesce(F.col(shared), F.lit("")).alias("shared")).agg(F.count_distinct(member).alias("degree"))
    if seeds is not None:
        degrees = degrees.join(seeds.select(F.col(seeds.columns[0]).alias("shared")).distinct().withColumn("seed", F.lit(True)), "shared", "left")
    else:
        degrees = degrees.withColumn("seed", F.lit(None).cast("boolean"))
    reason = F.when(F.col("degree") >= least_degree, "high_degree").when(F.col("seed"), "seed_agent").when(is_blank(F.col("shared")), "blank")
    return degrees.withColumn("reason", reason).where("reason is not null").select("shared", "degree", "reason")


def key_pairs(df: DataFrame, a: str, b: str) -> DataFrame:
    """Distinct ordered pairs of differing keys that are not blank."""
    rows = df.where(~is_blank(F.col(a)) & ~is_blank(F.col(b)) & (F.col(a) != F.col(b)))
    return rows.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()


def entity_nodes(owners: DataFrame, key: str, name: str, owner_class: str, entities: Sequence[str]) -> DataFrame:
    """(owner_key, name, owner_class) of the entities, each once; blank keys are no nodes."""
    rows = owners.where(F.col(owner_class).isin(*entities) & ~is_blank(F.col(key)))
    return rows.select(F.col(key).alias("owner_key"), F.col(name).alias("name"), F.col(owner_class).alias("owner_class")).distinct()


def typed_links(df: DataFrame, member: str, shared: str, link_type: str, evidence: str) -> DataFrame:
    """(a, b, link_type, evidence): star links with what is shared; of several shared values the least stands as evidence."""
    rows = checkpoint(df.where(~is_blank(F.col(member)) & ~is_blank(F.col(shared))).groupBy(F.col(member).alias("m"), F.col(shared).alias("s")).agg(F.min(evidence).alias("e")))
    least = rows.groupBy("s").agg(F.min("m").alias("a"), F.min("e").alias("evidence"))
    stars = hot_key_lookup(rows.select("m", "s"), "s", least, "s", ["a", "evidence"]).where("m <> a")
    return stars.groupBy("a", F.col("m").alias("b")).agg(F.min("evidence").alias("evidence")).select("a", "b", F.lit(link_type).alias("link_type"), "evidence")


def address_links(df: DataFrame, member: str, shared: str, link_type: str, least_degree: int, agent: str | None = None, agents: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(links, denied): star links over shared values that do not link too many members, and (shared, degree, reason) of those that do.

    A value is denied, and links nobody, if ``least_degree`` members or more share it (high_degree) or a row of it names one
    of the agents (seed_agent). Blank values and members take no part.
    """
    rows = checkpoint(df.where(~is_blank(F.col(member)) & ~is_blank(F.col(shared))).select(F.col(member).alias("m"), F.col(shared).alias("s"), *([F.col(agent).alias("agent")] if agent else [])))
    degrees = rows.select("m", "s").distinct().groupBy("s").agg(F.count(F.lit(1)).alias("degree"))
    if agent and agents is not None:
        named = rows.join(agents.select(F.col(agents.columns[0]).alias("agent")).distinct(), "agent", "left_semi").select("s").distinct().withColumn("seed", F.lit(True))
        degrees = degrees.join(named, "s", "left")
    else:
        degrees = degrees.withColumn("seed", F.lit(None).cast("boolean"))
    reason = F.when(F.col("degree") >= least_degree, "high_degree").when(F.col("seed"), "seed_agent")
    denied = checkpoint(degrees.withColumn("reason", reason).where("reason is not null").select(F.col("s").alias("shared"), "degree", "reason"))
    allowed = rows.join(denied.select(F.col("shared").alias("s")), "s", "left_anti")
    return typed_links(allowed, "m", "s", link_type, "s"), denied


def concat_links(*frames: DataFrame) -> DataFrame:
    """(a, b, link_type, evidence): every pair once per type, with the least evidence."""
    rows = reduce(lambda x, y: x.unionByName(y), frames)
    return rows.where(F.col("a") != F.col("b")).groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "link_type").agg(F.min("evidence").alias("evidence"))


def link_graph(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(owner_key, cluster, members): every node with its component (itself if unlinked) and the number of nodes in it.

    Ends of links that are no nodes still connect but are not counted.
    """
    roots = star_components(links.select("a", "b"))
    member = checkpoint(nodes.select("owner_key").distinct().join(roots.withColumnRenamed("node", "owner_key"), "owner_key", "left").select("owner_key", F.coalesce("root", "owner_key").alias("cluster")))
    sizes = member.groupBy("cluster").agg(F.count(F.lit(1)).alias("members"))
    return hot_key_lookup(member, "cluster", sizes, "cluster", ["members"])


def owner_evidence(nodes: DataFrame, contacts: DataFrame, denied: DataFrame) -> DataFrame:
    """Per node what its contacts show: addresses, denied ones, whether only denied or none, roles, persons.

    contacts: (owner_key, address, role, person). Nodes without contacts have zero addresses and count as agent only.
    """
    marked = contacts.join(denied.select(F.col("shared").alias("address"), F.lit(1).alias("denied")), "address", "left").where(~is_blank(F.col("owner_key")))
    there = ~is_blank(F.col("address"))
    per_owner = marked.groupBy("owner_key").agg(
        F.count_if(there).alias("addresses"), F.count_if(there & F.col("denied").isNotNull()).alias("denied_addresses"), F.bool_or(~is_blank(F.col("person"))).alias("has_person"), F.array_join(F.array_sort(F.collect_set(F.when(~is_blank(F.col("role")), F.col("role")))), "|").alias("roles")
    )
    zero = F.lit(0).cast("bigint")
    rows = nodes.select("owner_key").distinct().join(per_owner, "owner_key", "left")
    counts = rows.select("owner_key", F.coalesce("addresses", zero).alias("addresses"), F.coalesce("denied_addresses", zero).alias("denied_addresses"), F.coalesce("has_person", F.lit(False)).alias("has_person"), F.coalesce("roles", F.lit("")).alias("roles"))
    return counts.withColumn("agent_only", F.col("addresses") == F.col("denied_addresses"))


def star_components(edges: DataFrame) -> DataFrame:
    """(node, root) from pairs (a, b) by alternating large and small stars, until the edges are stars themselves.

    Every node hands its larger neighbors, then its smaller ones, to the least of its neighborhood; the rounds
    grow with the logarithm of the longest path. Minima combine before the shuffle; each round is checkpointed.
    """
    edges = checkpoint(key_pairs(edges, "a", "b"))
    while True:
        ways = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = ways.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        # moved: whether a link came to another end than it had; a round without is the last
        large = hot_key_lookup(ways, "u", low, "u", ["m"]).where("v > u").groupBy(F.col("v").alias("u"), F.col("m").alias("v")).agg(F.max(F.col("m") != F.col("u")).alias("moved"))
        down = checkpoint(large.where("u <> v"))
        floor = down.groupBy("u").agg(F.min("v").alias("m"))
        ends = F.array(F.struct(F.col("v").alias("x"), (F.col("moved") | (F.col("v") != F.col("m"))).alias("moved")), F.struct(F.col("u").alias("x"), F.col("moved").alias("moved")))
        small = hot_key_lookup(down, "u", floor, "u", ["m"]).select(F.explode(ends).alias("e"), "m").where("e.x <> m")
        edges = checkpoint(small.groupBy(F.col("m").alias("a"), F.col("e.x").alias("b")).agg(F.max("e.moved").alias("moved")))
        if edges.where("moved").isEmpty():
            stars = edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
            return stars.unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("root"))).distinct()


def component_sizes(membership: DataFrame, keep: DataFrame | None = None) -> DataFrame:
    """Members per root, of those in keep if given."""
    rows = membership if keep is None else membership.join(keep.select(F.col(keep.columns[0]).alias("node")).distinct(), "node", "left_semi")
    return rows.groupBy("root").agg(F.count(F.lit(1)).alias("members"))
