"""How well a classifier did, samples for labelling, and gates before publication."""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenure.functions.scalars import ratio
from tenure.operators.ranges import Scan, ranged_scan


def confusion(df: DataFrame, truth: str, guess: str, labels: Sequence[str]) -> DataFrame:
    """(truth, guess, n) for every pair of labels, zeros too; rows with another or no label are skipped."""
    spark = df.sparkSession
    grid = spark.createDataFrame([(t, g) for t in labels for g in labels], "truth string, guess string")
    counts = df.where(F.col(truth).isin(*labels) & F.col(guess).isin(*labels)).groupBy(F.col(truth).alias("truth"), F.col(guess).alias("guess")).agg(F.count(F.lit(1)).alias("n"))
    return grid.join(counts, ["truth", "guess"], "left").select("truth", "guess", F.coalesce("n", F.lit(0)).alias("n"))


def class_scores(matrix: DataFrame) -> DataFrame:
    """Precision, recall and F1 of each label, 0 where undefined."""
    sides = matrix.select(F.explode(F.array(F.struct(F.col("truth").alias("label"), F.col("n").alias("in_truth"), F.lit(0).cast("bigint").alias("in_guess"), F.when(F.col("truth") == F.col("guess"), F.col("n")).otherwise(0).alias("hit")), F.struct(F.col("guess").alias("label"), F.lit(0).cast("bigint").alias("in_truth"), F.col("n").alias("in_guess"), F.lit(0).cast("bigint").alias("hit")))).alias("x")).select("x.*")
    t = sides.groupBy("label").agg(*[F.sum(c).alias(c) for c in ("in_truth", "in_guess", "hit")])
    zero = F.lit(0.0)
    return t.select("label", F.col("in_truth").alias("support"), F.coalesce(ratio(F.col("hit"), F.col("in_guess")), zero).alias("precision"), F.coalesce(ratio(F.col("hit"), F.col("in_truth")), zero).alias("recall"), F.coalesce(ratio(2 * F.col("hit"), F.col("in_truth") + F.col("in_guess")), zero).alias("f1"))


def macro_f1(scores: DataFrame) -> DataFrame:
    """The mean F1 over labels that occur in the truth."""
    return scores.agg(F.coalesce(F.avg(F.when(F.col("support") > 0, F.col("f1"))), F.lit(0.0)).alias("macro_f1"))


def sens_spec(df: DataFrame, truth: Column, guess: Column) -> DataFrame:
    """Sensitivity and specificity of a yes-or-no guess, 0 where undefined, with the four counts."""
    cells = df.agg(F.count_if(truth & guess).alias("tp"), F.count_if(truth & ~guess).alias("fn"), F.count_if(~truth & ~guess).alias("tn"), F.count_if(~truth & guess).alias("fp"))
    return cells.select("*", F.coalesce(ratio(F.col("tp"), F.col("tp") + F.col("fn")), F.lit(0.0)).alias("sensitivity"), F.coalesce(ratio(F.col("tn"), F.col("tn") + F.col("fp")), F.lit(0.0)).alias("specificity"))


def bootstrap_corrected(cells: tuple[int, int, int, int], observed: float, resamples: int = 1000, seed: int = 20260916) -> tuple[float, float]:
    """95 % interval of the corrected share when the labelled rows are drawn again: from the four counts alone.

    Rows of a cell are alike, so drawing rows is drawing counts: a multinomial, no matter how many labels.
    """
    tp, fn, tn, fp = cells
    n = tp + fn + tn + fp
    if n == 0:
        return (float("nan"), float("nan"))
    draws = np.random.default_rng(seed).multinomial(n, np.array([tp, fn, tn, fp]) / n, size=resamples)
    with np.errstate(all="ignore"):
        sens, spec = draws[:, 0] / (draws[:, 0] + draws[:, 1]), draws[:, 2] / (draws[:, 2] + draws[:, 3])
        share = (observed + spec - 1) / (sens + spec - 1)
    share = np.sort(share[np.isfinite(share)])
    if not len(share):
        return (float("nan"), float("nan"))
    low, high = interval_places(len(share))
    return float(share[low]), float(share[high])


def interval_places(n: int, alpha: float = 0.05) -> tuple[int, int]:
    """Where the ends of a percentile interval stand among n sorted values, from 0."""
    return math.floor(alpha / 2 * n), min(n - 1, math.ceil((1 - alpha / 2) * n) - 1)


def stratified_sample(df: DataFrame, strata: Sequence[str], key: str, total: int, seed: str = "s") -> DataFrame:
    """A sampling operator: about total rows, each stratum its proportional share and at least one.

    Rows are ordered by a hash of seed and key, so the sample is the same at every run and partitioning.
    """
    sizes = df.groupBy(*strata).agg(F.count(F.lit(1)).alias("__size"))
    whole = max(1, df.count())
    quotas = sizes.select(*[F.col(c).alias(f"__s{i}") for i, c in enumerate(strata)], F.greatest(F.lit(1), F.floor(F.col("__size") * F.lit(float(total)) / F.lit(float(whole)) + F.lit(0.5))).alias("__quota"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__s{i}")) for i, c in enumerate(strata)])
    return _ranked(df, strata, key, seed).join(quotas, same).where("__turn <= __quota").select(*df.columns)


def halves(df: DataFrame, stratum: str, key: str, seed: str = "s") -> DataFrame:
    """df with split: dev or test, half of each stratum each, by hash order; of an odd number the larger half is dev."""
    sizes = df.groupBy(F.col(stratum).alias("__s")).agg(F.ceil(F.count(F.lit(1)) / 2).alias("__half"))
    ranked = _ranked(df, [stratum], key, seed).join(sizes, F.col(stratum).eqNullSafe(F.col("__s")))
    return ranked.select(*df.columns, F.when(F.col("__turn") <= F.col("__half"), "dev").otherwise("test").alias("split"))


def _ranked(df: DataFrame, strata: Sequence[str], key: str, seed: str) -> DataFrame:
    """df with __turn, the place of a row in the hash order of its stratum: worked in ranges, a large stratum is no long task."""
    hashed = df.withColumn("__order", F.sha2(F.concat(F.lit(seed), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256))
    return ranged_scan(hashed, strata, ["__order", key], {"__turn": Scan("sum", F.lit(1))})


def merged_labels(df: DataFrame, key: str, owner_class: str, labels: DataFrame, allowed: Sequence[str], least_confidence: float, open_class: str = "unknown") -> DataFrame:
    """df with the class of a labeller where the rules left it open, and class_source rules or model.

    labels: (key, label, confidence) from any model, a key possibly several times: the most confident allowed label counts
    (ties: the greatest label). Labels below the confidence, null ones and others than the allowed are no labels.
    """
    known = labels.where(F.col("label").isin(*allowed) & (F.col("confidence") >= least_confidence)).groupBy(F.col(key).alias("__k")).agg(F.max(F.struct("confidence", "label")).alias("__l"))
    joined = df.join(known, F.col(key) == F.col("__k"), "left")
    taken = (F.coalesce(F.col(owner_class), F.lit(open_class)) == open_class) & F.col("__l").isNotNull()
    columns = [F.when(taken, F.col("__l.label")).otherwise(F.col(c)).alias(c) if c == owner_class else F.col(c) for c in df.columns if c != "class_source"]
    return joined.select(*columns, F.when(taken, "model").otherwise("rules").alias("class_source"))


def leaked_columns(df: DataFrame, forbidden: Iterable[str]) -> list[str]:
    """Columns, nested fields too, that must not be published. Looks at the schema alone."""

    def names(kind: object, prefix: str = "") -> Iterable[str]:
        for f in getattr(kind, "fields", []):
            yield f.name
            yield from names(f.dataType)
        if hasattr(kind, "elementType"):
            yield from names(kind.elementType)

    banned = {x.lower() for x in forbidden}
    return sorted({n for n in names(df.schema) if n.lower() in banned})


def is_stable(before: int, now: int, most: float = 0.2) -> bool:
    """Whether a count moved no more than the given share."""
    return before == 0 or abs(now - before) <= most * before
