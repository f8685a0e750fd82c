"""Shares of a stock by any breakdown, with small cells suppressed, and what compares two places."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenure.functions.scalars import ratio

#: Cells with fewer units than this are not published.
MIN_UNITS = 10
ENTITY = ("llc", "corp", "partnership")
EXCLUDED = ("public", "nonprofit_religious")


def is_entity(owner_class: Column, with_trusts: bool = False) -> Column:
    return F.coalesce(owner_class.isin(*ENTITY, *(["trust"] if with_trusts else [])), F.lit(False))


def private_stock(parcels: DataFrame, owner_class: str = "owner_class") -> DataFrame:
    """Rows of private owners; a null class is dropped as well."""
    return parcels.where(~F.col(owner_class).isin(*EXCLUDED))


def share_table(parcels: DataFrame, groups: Sequence[str], member: str, units: str) -> DataFrame:
    """Per group and member: its parcels and units, those of the group, and the shares.

    Rows with a null group are left out; shares of no units are null. One aggregation by group and member,
    the totals are a second one over its few rows.
    """
    cells = parcels.dropna(subset=list(groups)).groupBy(*groups, member).agg(F.count(F.lit(1)).alias("class_parcels"), F.coalesce(F.sum(units), F.lit(0)).cast("bigint").alias("class_units"))
    totals = cells.groupBy(*groups).agg(F.sum("class_parcels").alias("parcels"), F.sum("class_units").alias("units")) if groups else cells.agg(F.sum("class_parcels").alias("parcels"), F.sum("class_units").alias("units"))
    both = cells.join(totals, list(groups)) if groups else cells.join(F.broadcast(totals))
    return both.select(*groups, member, "class_parcels", "class_units", "parcels", "units", ratio(F.col("class_parcels"), F.col("parcels")).alias("parcel_share"), ratio(F.col("class_units"), F.col("units")).alias("unit_share"))


def all_breakdowns(parcels: DataFrame, dimensions: Sequence[str], units: str) -> DataFrame:
    """Parcels and units by every single dimension and in total, from one scan with grouping sets."""
    sets = [[d] for d in dimensions] + [[]]
    grouped = parcels.groupingSets([[F.col(c) for c in s] for s in sets], *dimensions).agg(F.grouping_id().alias("breakdown"), F.count(F.lit(1)).alias("parcels"), F.coalesce(F.sum(units), F.lit(0)).cast("bigint").alias("units"))
    return grouped.select("breakdown", *dimensions, "parcels", "units")


def suppressed(table: DataFrame, shares: Sequence[str], units: str = "units") -> DataFrame:
    """Shares of cells under MIN_UNITS as null, and the flag; the rows stay."""
    small = F.coalesce(F.col(units) < MIN_UNITS, F.lit(True))
    return table.withColumns({s: F.when(~small, F.col(s)) for s in shares} | {"suppressed": small})


def headline_shares(parcels: DataFrame, informative: Column, units: str, owner_class: str = "owner_class") -> DataFrame:
    """Four rows (all or informative parcels, without and with trusts): counts and shares; zero where there is nothing."""
    u = F.coalesce(F.col(units), F.lit(0))
    blocks = [(s, t) for s in ("all", "informative") for t in (False, True)]
    aggregates = []
    for s, t in blocks:
        there = F.lit(True) if s == "all" else informative
        entity = there & is_entity(F.col(owner_class), t)
        for name, value in (("parcels", F.count_if(there)), ("units", F.sum(F.when(there, u))), ("entity_parcels", F.count_if(entity)), ("entity_units", F.sum(F.when(entity, u)))):
            aggregates.append(F.coalesce(value, F.lit(0)).cast("bigint").alias(f"{s}_{t}_{name}"))
    rows = []
    for s, t in blocks:
        c = {n: F.col(f"{s}_{t}_{n}") for n in ("parcels", "units", "entity_parcels", "entity_units")}
        share = lambda a, b: F.coalesce(ratio(a, b), F.lit(0.0))
        rows.append(F.struct(F.lit(s).alias("series"), F.lit(t).alias("with_trusts"), *[v.alias(n) for n, v in c.items()], share(c["entity_parcels"], c["parcels"]).alias("parcel_share"), share(c["entity_units"], c["units"]).alias("unit_share")))
    return parcels.agg(*aggregates).select(F.inline(F.array(*rows)))


def type_rates(parcels: DataFrame, kind: str, units: str | None, owner_class: str = "owner_class") -> DataFrame:
    """Per type: its rate of entity units and its weight among all units; zero where there are none. Without ``units`` every row weighs one."""
    u = F.coalesce(F.col(units), F.lit(0)) if units else F.lit(1).cast("bigint")
    rates = parcels.groupBy(kind).agg(F.sum(u).alias("units"), F.coalesce(F.sum(F.when(is_entity(F.col(owner_class)), u)), F.lit(0)).alias("entity_units"))
    whole = rates.agg(F.sum("units").alias("__all"))
    return rates.join(F.broadcast(whole)).select(kind, "units", "entity_units", F.coalesce(ratio(F.col("entity_units"), F.col("units")), F.lit(0.0)).alias("rate"), F.coalesce(ratio(F.col("units"), F.col("__all")), F.lit(0.0)).alias("weight"))


def sensitivity_cube(headlines: DataFrame, sensitivity: float, specificity: float, labelled: int) -> DataFrame:
    """The headline rows by parcel and by unit weight: raw share, share corrected for the classifier's errors, labels behind it."""
    sides = F.array(*[F.struct(F.lit(w).alias("weight"), F.col(f"{w}_share").alias("raw")) for w in ("parcel", "unit")])
    rows = headlines.select("series", F.col("with_trusts").alias("include_trust"), "parcels", "units", "entity_parcels", "entity_units", F.inline(sides))
    # the errors were measured for entities without trusts
    corrected = F.when(~F.col("include_trust"), corrected_share(F.col("raw"), F.lit(sensitivity), F.lit(specificity)))
    return rows.withColumns({"corrected": corrected, "n_labeled": F.when(corrected.isNotNull(), F.lit(labelled))})


def claim(cube: DataFrame, series: str, weight: str, include_trust: bool) -> dict:
    """The one row of the cube that backs a claim; KeyError if there is none, ValueError for a weight that does not exist."""
    if weight not in ("parcel", "unit"):
        raise ValueError(f"no weight {weight!r}")
    rows = cube.where((F.col("series") == series) & (F.col("weight") == weight) & (F.col("include_trust") == include_trust)).limit(1).collect()
    if not rows:
        raise KeyError(f"no claim for {series}, {weight}, {include_trust}")
    return rows[0].asDict()


def mix_adjusted(reference: DataFrame, other: DataFrame, kind: str) -> DataFrame:
    """Direct standardisation of two places over their common types: one row.

    gap_common = rate_effect + mix_effect, the part of the gap of the two rates that the types' own rates
    and that the mix of types explain. The larger one is dominant, mix on a tie. Types of only one side count in n_only.
    """
    a, b = reference.select(kind, F.col("rate").alias("ra"), F.col("units").alias("ua")), other.select(kind, F.col("rate").alias("rb"), F.col("units").alias("ub"))
    both = a.join(b, kind, "full_outer")
    common = F.col("ra").isNotNull() & F.col("rb").isNotNull()
    pick = lambda x: F.sum(F.when(common, x).cast("double"))
    sums = both.agg(
        F.count_if(common).alias("n_common"), F.count_if(~common).alias("n_only"), pick(F.col("ua")).alias("wa"), pick(F.col("ub")).alias("wb"),
        pick(F.col("ua") * F.col("ra")).alias("aa"), pick(F.col("ub") * F.col("rb")).alias("bb"), pick(F.col("ua") * F.col("rb")).alias("ab"),
    )
    ref, oth, std = ratio(F.col("aa"), F.col("wa")), ratio(F.col("bb"), F.col("wb")), ratio(F.col("ab"), F.col("wa"))
    out = sums.select("n_common", "n_only", ref.alias("reference_rate"), oth.alias("other_rate"), std.alias("other_on_reference_mix"), (ref - oth).alias("gap_common"), (ref - std).alias("rate_effect"), (std - oth).alias("mix_effect"))
    return out.withColumn("dominant", F.when(F.abs("mix_effect") >= F.abs("rate_effect"), "mix").otherwise("rate"))


def corrected_share(observed: Column, sensitivity: Column, specificity: Column) -> Column:
    """Rogan-Gladen: the prevalence behind an observed share; null if the test tells nothing, not clamped."""
    gain = sensitivity + specificity - F.lit(1.0)
    return F.when(F.abs(gain) >= 1e-12, (observed + specificity - F.lit(1.0)) / gain)


def ranked_bars(table: DataFrame, label: str, value: str, limit: int = 12) -> DataFrame:
    """A top-k report: the largest values that are not suppressed, with their width against the largest."""
    top = table.where(~F.col("suppressed") & F.col(value).isNotNull()).orderBy(F.desc(value), label).limit(limit)
    whole = top.agg(F.max(value).alias("__max"))
    return top.join(F.broadcast(whole)).select(label, value, F.coalesce(ratio(F.col(value), F.col("__max")), F.lit(0.0)).alias("width"))
