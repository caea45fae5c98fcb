"""From counts to rates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bases import collapse_mutation, collapse_triplet, is_acgt, is_mutation, reverse_complement

TARGET = 10_000


def scaled(value, keys: list[str], target: int = TARGET):
    """Counts scaled to a total, rounded half to even; 0 where there is nothing."""
    total = F.sum(value).over(Window.partitionBy(*keys))
    return F.when(total > 0, F.bround(value / total * target, 0)).otherwise(0.0).cast("long")


def collapse_spectrum(counts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, mutation, n over 96 labels; other labels go."""
    return counts.where(is_mutation("mutation")).groupBy(*keys, collapse_mutation("mutation").alias("mutation")).agg(F.sum("n").alias("n"))


def collapse_opportunities(counts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, triplet, n over 32 contexts."""
    return counts.where((F.length("triplet") == 3) & is_acgt("triplet")).groupBy(*keys, collapse_triplet("triplet").alias("triplet")).agg(F.sum("n").alias("n"))


def normalize(mutations: DataFrame, triplets: DataFrame, keys: list[str], on: list[str] | None = None, target: int = TARGET) -> DataFrame:
    """keys, mutation, n, opportunity, rate, scaled and scaled_raw. ``on``: the keys that the triplets have too; none
    for one denominator that all branches share."""
    on = keys if on is None else on
    m = collapse_spectrum(mutations, keys).withColumn("triplet", F.concat(F.substring("mutation", 1, 1), F.substring("mutation", 3, 1), F.substring("mutation", 7, 1)))
    t = collapse_opportunities(triplets, on).withColumnRenamed("n", "opportunity")
    out = m.join(t, [*on, "triplet"], "left").withColumn("opportunity", F.coalesce("opportunity", F.lit(0)))
    out = out.withColumn("rate", F.when(F.col("opportunity") > 0, F.col("n") / F.col("opportunity")).otherwise(0.0))
    return out.withColumn("scaled", scaled(F.col("rate"), keys, target)).withColumn("scaled_raw", scaled(F.col("n"), keys, target)).drop("triplet")


def normalize_pair(mutations: DataFrame, triplets: DataFrame, target: int = TARGET) -> DataFrame:
    """mutation, n, opportunity, rate, normalized (unrounded). A class's opportunity adds up the different contexts
    among its two alleles' and their reverse complements."""
    left, right = F.substring("mutation", 1, 1), F.substring("mutation", 7, 1)
    a, b = F.concat(left, F.substring("mutation", 3, 1), right), F.concat(left, F.substring("mutation", 5, 1), right)
    keys = F.array_distinct(F.array(a, b, reverse_complement(a), reverse_complement(b)))
    parts = mutations.select("mutation", F.explode(keys).alias("triplet")).join(triplets.withColumnRenamed("n", "o"), "triplet", "left")
    parts = parts.groupBy("mutation").agg(F.coalesce(F.sum("o"), F.lit(0.0)).alias("opportunity"))
    out = mutations.join(parts, "mutation").withColumn("rate", F.when(F.col("opportunity") > 0, F.col("n") / F.col("opportunity")).otherwise(0.0))
    total = F.sum("rate").over(Window.partitionBy())  # 52 rows
    return out.withColumn("normalized", F.when(total > 0, F.col("rate") / total * target).otherwise(0.0))


def mutations_per_triplet(mutations: DataFrame, triplets: DataFrame, keys: list[str], divergence_my: float | None = None) -> DataFrame:
    """keys, mutations, triplets, ratio and, for a divergence time in million years, a yearly rate."""
    m = mutations.groupBy(*keys).agg(F.sum("n").alias("mutations"))
    t = triplets.groupBy(*keys).agg(F.sum("n").alias("triplets"))
    out = m.join(t, keys, "left").withColumn("ratio", F.when(F.col("triplets") > 0, F.col("mutations") / F.col("triplets")).otherwise(0.0))
    return out if divergence_my is None else out.withColumn("per_year", F.col("ratio") / (divergence_my * 1e6))


def wide_table(counts: DataFrame, label: str, branch: str, value: str, branches: list) -> DataFrame:
    """A column for each branch; null where a branch lacks a label."""
    return counts.groupBy(label).pivot(branch, branches).agg(F.first(value))
