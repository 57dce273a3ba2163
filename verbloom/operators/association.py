"""Normalised pointwise mutual information between labels, or between two distributions of the same instances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

c = F.col


def _npmi(joint: Column, independent: Column) -> Column:
    """-1 where the joint probability is 0; 0 where it is 1."""
    value = F.log(joint / independent) / -F.log(joint)
    return F.when((joint <= 0) | joint.isNull(), F.lit(-1.0)).when(joint >= 1, F.lit(0.0)).otherwise(value)


def symmetric(counts: DataFrame, within_verb: bool = False) -> DataFrame:
    """Unordered label pairs (x <= y): the chance that two draws in turn, with replacement, from the same cluster have the
    labels x and y in this order, against the product of the labels' shares; with `within_verb`, against shares within the verb type.

    Pairs come from an equi-join of the label counts on the cluster, and for the shares on the verb type, or as the pairs
    of all labels, which are the result's own rows; pairs that never meet in a cluster are reported with -1.
    """
    side = ["verb_type", "cluster"]
    whole = counts.agg(F.sum("n")).scalar()
    sized = counts.withColumn("size", F.sum("n").over(Window.partitionBy(*side)))
    left, right = sized.select(*side, "size", c("label").alias("x"), c("n").alias("nx")), counts.select(*side, c("label").alias("y"), c("n").alias("ny"))
    cell = left.join(right, side).filter("x <= y").withColumn("v", c("nx") * c("ny") / c("size"))
    joint = cell.groupBy("x", "y").agg((F.sum("v") / whole).alias("joint"))
    by = ["verb_type"] if within_verb else []
    m = counts.groupBy(*by, "label").agg(F.sum("n").alias("m"))
    m = m.withColumn("t", F.sum("m").over(Window.partitionBy("verb_type")) if within_verb else whole)
    a, b = m.select(*by, "t", c("label").alias("x"), c("m").alias("mx")), m.select(*by, c("label").alias("y"), c("m").alias("my"))
    pair = (a.join(b, "verb_type").filter("x <= y") if within_verb else a.join(b, c("x") <= c("y"))).withColumn("v", c("mx") * c("my") / c("t"))
    independent = pair.groupBy("x", "y").agg((F.sum("v") / whole).alias("independent"))
    out = independent.join(joint, ["x", "y"], "left").withColumn("joint", F.coalesce("joint", F.lit(0.0)))
    return out.withColumn("npmi", _npmi(c("joint"), c("independent")))


def with_sources(dist: DataFrame, source: list[str], never: bool = True) -> DataFrame:
    """Pairs of items (x <= y) of the same instance, with what share of the joint mass each source adds.

    `dist` has source columns, `instance`, `item`, `value`; each instance counts with its total weight. The correlation is
    the covariance over both spreads; the spread of an item is sqrt(joint(item, item) - share^2). Pairs that never meet
    have no source (null), joint 0 and NPMI -1. They make the result as long as the square of the items; without `never`
    they are left out.
    """
    key = [*source, "instance"]
    d = dist.withColumn("t", F.sum("value").over(Window.partitionBy(*key)))
    whole = dist.agg(F.sum("value")).scalar()
    a, b = d.select(*key, "t", c("item").alias("x"), c("value").alias("vx")), dist.select(*key, c("item").alias("y"), c("value").alias("vy"))
    cell = a.join(b, key).filter("x <= y").withColumn("v", c("vx") * c("vy") / c("t"))
    by_source = cell.groupBy("x", "y", *source).agg((F.sum("v") / whole).alias("source_joint"))
    every = Window.partitionBy("x", "y")
    joined = by_source.withColumn("joint", F.sum("source_joint").over(every)).withColumn("source_share", c("source_joint") / c("joint"))
    share = dist.groupBy("item").agg((F.sum("value") / whole).alias("p"))
    same = joined.filter("x = y").select(c("x").alias("item"), "joint").distinct()
    item = share.join(same, "item").select("item", "p", F.sqrt(F.greatest(c("joint") - c("p") * c("p"), F.lit(0.0))).alias("spread"))
    side = lambda n: item.select(c("item").alias(n), c("p").alias(f"p{n}"), c("spread").alias(f"s{n}"))
    if never:
        pairs = side("x").join(side("y"), c("x") <= c("y"))  # as many rows as the result has
        out = pairs.join(joined, ["x", "y"], "left").withColumn("joint", F.coalesce("joint", F.lit(0.0)))
    else:
        out = joined.join(side("x"), "x").join(side("y"), "y")
    out = out.withColumn("independent", c("px") * c("py"))
    covariance = c("joint") - c("independent")
    return out.withColumns({"npmi": _npmi(c("joint"), c("independent")), "covariance": covariance, "correlation": covariance / F.nullif(c("sx") * c("sy"), F.lit(0.0))}).drop("sx", "sy")


def heterogeneous(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """NPMI of items of two distributions of the same instances: (x, y, joint, independent, npmi).

    Both sides are normalised per instance; every instance that has both weighs 1. Only pairs that occur are listed.
    """
    share = lambda d, out, v: d.withColumn(v, c("value") / F.sum("value").over(Window.partitionBy(*key))).select(*key, c("item").alias(out), v)
    cell = share(left, "x", "vx").join(share(right, "y", "vy"), key).withColumn("v", c("vx") * c("vy"))
    joint = cell.groupBy("x", "y").agg(F.sum("v").alias("v"))
    mx, my = joint.groupBy("x").agg(F.sum("v").alias("mx")), joint.groupBy("y").agg(F.sum("v").alias("my"))
    n = joint.agg(F.sum("v")).scalar()
    out = joint.join(mx, "x").join(my, "y").withColumns({"joint": c("v") / n, "independent": c("mx") * c("my") / (n * n)})
    return out.withColumn("npmi", _npmi(c("joint"), c("independent"))).select("x", "y", "joint", "independent", "npmi")
