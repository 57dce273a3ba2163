"""Algebra of weighted distributions kept as long rows: one row per (keys..., item) with a weight column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

c = F.col


def total(df: DataFrame, keys: list[str], item: str = "item", value: str = "value") -> DataFrame:
    """Sum of distributions: weights of equal (keys, item) add up."""
    return df.groupBy(*keys, item).agg(F.sum(value).alias(value))


def normalized(df: DataFrame, keys: list[str], value: str = "value", out: str | None = None) -> DataFrame:
    """Weights over the sum of their distribution; the empty key list means one distribution. Sums of 0 give null."""
    if keys:
        whole = F.sum(value).over(Window.partitionBy(*keys))
        return df.withColumn(out or value, c(value) / F.nullif(whole, F.lit(0.0)))
    whole = df.agg(F.sum(value)).scalar()
    return df.withColumn(out or value, c(value) / F.nullif(whole, F.lit(0.0)))


def truncated(df: DataFrame, keys: list[str], head: float, item: str = "item", value: str = "value") -> DataFrame:
    """Items by falling weight (ties by item) until the sum reaches head * total, with the item that crosses it; all
    items if it is never reached."""
    order = Window.partitionBy(*keys).orderBy(c(value).desc(), item)
    before = F.coalesce(F.sum(value).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    whole = F.sum(value).over(Window.partitionBy(*keys))
    return df.withColumns({"_b": before, "_t": whole}).filter(c("_b") < F.lit(head) * c("_t")).drop("_b", "_t")


def truncated_dense(df: DataFrame, keys: list[str], head: float, index: str = "idx", value: str = "value") -> DataFrame:
    """Dense form: the threshold is the first value after the head is reached, in falling order; values at or below it
    become 0, so ties of the threshold inside the head go too. No threshold (all needed): nothing changes."""
    order = Window.partitionBy(*keys).orderBy(c(value).desc(), index)
    before = F.coalesce(F.sum(value).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    every = Window.partitionBy(*keys)
    marked = df.withColumns({"_b": before, "_t": F.sum(value).over(every)})
    cutoff = F.max(F.when(c("_b") >= F.lit(head) * c("_t"), c(value))).over(every)
    kept = F.when(cutoff.isNull() | (c(value) > cutoff), c(value)).otherwise(F.lit(0.0))
    return marked.withColumn("_v", kept).drop("_b", "_t", value).withColumnRenamed("_v", value)


def rebalanced(df: DataFrame, prior: DataFrame, keys: list[str], item: str = "item", value: str = "value") -> DataFrame:
    """Weights divided by the prior weight of their item, then normalised; items that the prior lacks are left out."""
    divided = df.join(prior.select(item, c(value).alias("_p")), item).withColumn(value, c(value) / F.nullif(c("_p"), F.lit(0.0))).drop("_p")
    return normalized(divided, keys, value)


def smoothed_prior(df: DataFrame, add: float, item: str = "item", value: str = "value") -> DataFrame:
    """The normalised sum of all distributions with `add` on every item, normalised again."""
    p = normalized(total(df, [], item, value), [], value)
    return normalized(p.withColumn(value, c(value) + F.lit(add)), [], value)


def distinctive_transform(df: DataFrame, keys: list[str], head: float, prior_head: float, add: float, item: str = "item", value: str = "value") -> DataFrame:
    """Truncation to the head, divided by a smoothed prior of the distributions truncated to the larger prior head."""
    if prior_head < head:
        raise ValueError("the prior head has to be at least the head")
    prior = smoothed_prior(truncated(df, keys, prior_head, item, value), add, item, value)
    return rebalanced(truncated(df, keys, head, item, value), prior, keys, item, value)


def dirichlet(count: Column, whole: Column, size: Column, alpha: float) -> Column:
    """Posterior mean under a symmetric prior of total mass `alpha` over `size` items."""
    return (count + F.lit(alpha) / size) / (whole + F.lit(alpha))


def dirichlet_sparse(df: DataFrame, vocabulary: DataFrame, keys: list[str], over: list[str], alpha: float, item: str = "item", value: str = "value") -> DataFrame:
    """Dirichlet posterior of each distribution over the vocabulary (over..., item) of its group, absent items included.

    `over` is the part of the keys that the vocabulary depends on, so absent items come from an equi-join on it.
    """
    size = vocabulary.withColumn("_k", F.count(F.lit(1)).over(Window.partitionBy(*over)))
    grid = df.select(*keys).distinct().join(size, over)
    full = grid.join(df, [*keys, item], "left").withColumn(value, F.coalesce(value, F.lit(0.0)))
    whole = F.sum(value).over(Window.partitionBy(*keys))
    return full.withColumn(value, dirichlet(c(value), whole, c("_k"), alpha)).drop("_k")


def log_sum_exp(x: Column, over: Window) -> Column:
    """Logarithm of the sum of exponentials over a window, shifted by the maximum."""
    top = F.max(x).over(over)
    return top + F.log(F.sum(F.exp(x - top)).over(over))


def inverted_odds(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Normalised inverse weights."""
    return normalized(df.withColumn(value, F.lit(1.0) / F.nullif(c(value), F.lit(0.0))), keys, value)


def top_items(df: DataFrame, keys: list[str], n: int, item: str = "item", value: str = "value") -> DataFrame:
    """The n items of the largest weight, ties by item, with `rank`."""
    w = Window.partitionBy(*keys).orderBy(c(value).desc(), item)
    return df.withColumn("rank", F.row_number().over(w).cast("bigint")).filter(c("rank") <= n)


def sampled(df: DataFrame, keys: list[str], seed: int, item: str = "item", value: str = "value") -> DataFrame:
    """One item of each distribution, drawn by inverting the cumulative weights with a seeded number per key."""
    order = Window.partitionBy(*keys).orderBy(item)
    u = (F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(1 << 52)) / F.lit(float(1 << 52))) * F.sum(value).over(Window.partitionBy(*keys))
    run = df.withColumns({"_u": u, "_c": F.sum(value).over(order.rowsBetween(Window.unboundedPreceding, 0))})
    return run.filter(c("_c") > c("_u")).groupBy(*keys).agg(F.min(item).alias(item))


def harmonic(p: Column, r: Column, beta: float = 1.0) -> Column:
    """Weighted harmonic mean; 0 where both are 0."""
    b = beta * beta
    below = F.lit(b) * p + r
    return F.when(below > 0, F.lit(1 + b) * p * r / below).otherwise(F.lit(0.0))


def shrunk(value: Column, weight: Column, mean: Column, smoothing: float) -> Column:
    """A value drawn towards the mean as if `smoothing` more observations had it."""
    return (value * weight + mean * F.lit(float(smoothing))) / (weight + F.lit(float(smoothing)))


def fixed_width(x: Column, width: int, digits: int) -> Column:
    """A number with so many digits, filled with blanks on the left to a width."""
    return F.format_string(f"%{width}.{digits}f", x.cast("double"))


def to_pairs(m: Column) -> Column:
    """A map as a JSON list of [key, value] pairs, for keys that JSON can't have."""
    return F.to_json(F.transform(F.map_entries(m), lambda e: F.array(F.to_json(F.struct(e["key"].alias("k"))), e["value"].cast("string"))))


def from_pairs(text: Column, key: str) -> Column:
    """The map of keys of a type to doubles that `to_pairs` wrote."""
    pairs = F.from_json(text, "array<array<string>>")
    return F.map_from_entries(F.transform(pairs, lambda p: F.struct(F.from_json(p[0], f"k {key}")["k"], p[1].cast("double"))))
