"""Scores of clusterings against gold labels, from counts of (verb_type, cluster, label).

A count table has one row per combination with its number (or weight) `n`; everything here is one or two
aggregations over it, so the instances themselves are never read twice.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verbloom.functions.dist import harmonic, shrunk

c = F.col


def label_counts(clusters: DataFrame, gold: DataFrame, on: list[str], weight: str | None = None) -> DataFrame:
    """(verb_type, cluster, label, n): members of each cluster by gold label; members without a label don't count."""
    n = F.sum(weight) if weight else F.count(F.lit(1)).cast("double")
    return clusters.join(gold, on).groupBy("verb_type", "cluster", "label").agg(n.alias("n"))


def purity_collocation(counts: DataFrame, by: list[str]) -> DataFrame:
    """Share of members with the main label of their cluster, and in the main cluster of their label, per `by`."""
    def best(side: str) -> DataFrame:
        top = counts.groupBy(*dict.fromkeys(["verb_type", side, *by])).agg(F.max("n").alias("m"), F.sum("n").alias("n"))
        return top.groupBy(*by).agg(F.sum("m").alias("m"), F.sum("n").alias("n"))

    p, r = best("cluster"), best("label").select(*by, c("m").alias("m2"))
    both = p.join(r, by) if by else p.withColumn("_1", F.lit(1)).join(r.withColumn("_1", F.lit(1)), "_1").drop("_1")
    scored = both.select(*by, (c("m") / c("n")).alias("purity"), (c("m2") / c("n")).alias("collocation"), c("n").alias("weight"))
    return scored.withColumn("f1", harmonic(c("purity"), c("collocation")))


def b3_cells(counts: DataFrame) -> DataFrame:
    """Counts with the B-cubed precision `p` (n over the cluster) and recall `r` (n over the label within the verb type)."""
    size = lambda side: F.sum("n").over(Window.partitionBy("verb_type", side))
    return counts.withColumns({"p": c("n") / size("cluster"), "r": c("n") / size("label")})


def micro(cells: DataFrame, by: list[str]) -> DataFrame:
    """Precision and recall weighted by n, their harmonic mean and the weight, per `by` (none: over all)."""
    agg = cells.groupBy(*by).agg((F.sum(c("n") * c("p")) / F.sum("n")).alias("precision"), (F.sum(c("n") * c("r")) / F.sum("n")).alias("recall"), F.sum("n").alias("weight"))
    return agg.withColumn("f1", harmonic(c("precision"), c("recall")))


def macro(scored: DataFrame, by: list[str]) -> DataFrame:
    """Unweighted means of precision and recall over the rows of `scored`, per `by`."""
    agg = scored.groupBy(*by).agg(F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.count(F.lit(1)).cast("double").alias("weight"))
    return agg.withColumn("f1", harmonic(c("precision"), c("recall")))


def b3_by_label(counts: DataFrame) -> DataFrame:
    return micro(b3_cells(counts), ["verb_type", "label"])


def with_main_label(counts: DataFrame) -> DataFrame:
    """Cells with `main`: is the label its verb type's most frequent one (ties: the smallest label)?"""
    whole = counts.groupBy("verb_type", "label").agg(F.sum("n").alias("_n"))
    first = Window.partitionBy("verb_type").orderBy(c("_n").desc(), "label")
    main = whole.withColumn("_r", F.row_number().over(first)).select("verb_type", "label", (c("_r") == 1).alias("main"))
    return b3_cells(counts).join(main, ["verb_type", "label"])


def groupings(cells: DataFrame) -> DataFrame:
    """Scores by verb type, label, verb type and label, label group, verb type and label group, in one pass over the
    cells by grouping sets; keys that don't apply are 'All'."""
    sets = [["verb_type"], ["label"], ["verb_type", "label"], ["label_group"], ["verb_type", "label_group"]]
    keys = ["verb_type", "label", "label_group"]
    agg = cells.groupingSets([[c(k) for k in s] for s in sets], *keys).agg(
        F.grouping_id().alias("_g"), (F.sum(c("n") * c("p")) / F.sum("n")).alias("precision"), (F.sum(c("n") * c("r")) / F.sum("n")).alias("recall"), F.sum("n").alias("weight")
    )
    named = agg.select(*(F.coalesce(k, F.lit("All")).alias(k) for k in keys), "precision", "recall", "weight")
    return named.withColumn("f1", harmonic(c("precision"), c("recall")))


def smoothed(scored: DataFrame, by: list[str], smoothings: list[int]) -> DataFrame:
    """Scores drawn towards the mean over the rows of each `by`, precision and recall apart, with their F1."""
    w = Window.partitionBy(*by)
    means = scored.withColumns({"_p": F.avg("precision").over(w), "_r": F.avg("recall").over(w)})
    at = lambda s: harmonic(shrunk(c("precision"), c("weight"), c("_p"), s), shrunk(c("recall"), c("weight"), c("_r"), s))
    return means.withColumns({f"f1_s{s}": at(s) for s in smoothings}).drop("_p", "_r")


def with_error_share(scored: DataFrame, by: list[str]) -> DataFrame:
    """(1 - F1) * weight of each row over the sum of it."""
    err = (F.lit(1.0) - c("f1")) * c("weight")
    return scored.withColumn("error_share", err / F.nullif(F.sum(err).over(Window.partitionBy(*by)), F.lit(0.0)))


def compared(a: DataFrame, b: DataFrame, on: list[str], columns: list[str]) -> DataFrame:
    """Differences b - a of `columns` for the keys that both have."""
    right = b.select(*on, *(c(x).alias(f"_{x}") for x in columns))
    joined = a.join(right, on)
    return reduce(lambda d, x: d.withColumn(f"delta_{x}", c(f"_{x}") - c(x)).drop(f"_{x}"), columns, joined)
