"""Joins and ordered scans with the guarantees that map lookups have: no row lost or doubled unnoticed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

c = F.col


def unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """`df`, whose keys have to be unique: a repeated key fails the query when its rows are read."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    ok = F.when(n > 1, F.raise_error(F.concat(F.lit("repeated key: "), F.concat_ws("/", *[c(k).cast("string") for k in keys]))).cast("boolean")).otherwise(True)
    return df.withColumn("_ok", ok).filter("_ok").drop("_ok")


def looked_up(df: DataFrame, features: DataFrame, on: list[str], mark: str) -> DataFrame:
    """Inner join that fails the query on a key without feature; `mark` is a never-null column of `features`."""
    joined = df.join(unique(features, on), on, "left")
    missing = F.raise_error(F.concat(F.lit("no feature for "), F.concat_ws("/", *[c(k).cast("string") for k in on]))).cast("boolean")
    return joined.withColumn("_ok", F.when(c(mark).isNull(), missing).otherwise(True)).filter("_ok").drop("_ok")


def first_of(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_r = 1").drop("_r")


def containing(points: DataFrame, spans: DataFrame, on: list[str], point: str, begin: str, end: str, bucket: int = 32) -> DataFrame:
    """Pairs of a point and a span of the same keys with begin <= point < end.

    Spans are put into every bucket of positions that they touch, so the join is an equi-join on (keys, bucket) and a
    key with very many spans is split by position.
    """
    at = points.withColumn("_bucket", F.floor(c(point) / bucket))
    touched = spans.filter(c(begin) < c(end)).withColumn("_bucket", F.explode(F.sequence(F.floor(c(begin) / bucket), F.floor((c(end) - 1) / bucket))))
    return at.join(touched, [*on, "_bucket"]).filter((c(begin) <= c(point)) & (c(point) < c(end))).drop("_bucket")


def offsets(df: DataFrame, keys: list[str], order: str, size: Column) -> DataFrame:
    """`offset`: the summed size of all rows before a row."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("offset", F.coalesce(F.sum(size).over(w), F.lit(0)).cast("bigint"))


def without_gaps(df: DataFrame, keys: list[str], order: str, empty: Column) -> DataFrame:
    """`rank`: the position of a row among those that aren't empty, for each row that isn't."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    gaps = F.coalesce(F.sum(empty.cast("int")).over(w), F.lit(0))
    return df.withColumns({"rank": (c(order) - gaps).cast("bigint"), "_e": empty}).filter("NOT _e").drop("_e")


def wrapped_neighbours(df: DataFrame, keys: list[str], order: list[Column], value: str) -> DataFrame:
    """`next` and `previous` value in order within the keys, the first following the last."""
    w = Window.partitionBy(*keys).orderBy(*order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return df.withColumns({
        "next": F.coalesce(F.lead(value).over(w), F.first(value).over(whole)),
        "previous": F.coalesce(F.lag(value).over(w), F.last(value).over(whole)),
    })


def while_true(df: DataFrame, keys: list[str], order: list[Column], condition: Column) -> DataFrame:
    """The leading rows of each key up to the first that doesn't meet the condition."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("_ok", F.min(F.coalesce(condition, F.lit(False)).cast("int")).over(w)).filter("_ok = 1").drop("_ok")


def aligned(left: DataFrame, right: DataFrame, left_key: str, right_key: str, text: str = "text") -> DataFrame:
    """(left_key, right_key): rows whose texts are equal without blanks and case, the smallest right key of several. A left
    row without partner fails the query when its row is read."""
    norm = lambda df: df.withColumn("_t", F.regexp_replace(F.lower(c(text)), r"\s+", ""))
    first = norm(right).groupBy("_t").agg(F.min(right_key).alias(right_key))
    missing = F.raise_error(F.concat(F.lit("no text for "), c(left_key).cast("string")))
    joined = norm(left).join(first, "_t", "left")
    return joined.select(left_key, F.when(c(right_key).isNull(), missing).otherwise(c(right_key)).alias(right_key))


def merged(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of either side by keys, with `side`: both, left or right; columns of the missing side are null."""
    both = left.withColumn("_l", F.lit(True)).join(right.withColumn("_r", F.lit(True)), keys, "full")
    return both.withColumn("side", F.when(c("_l") & c("_r"), "both").when(c("_l"), "left").otherwise("right")).drop("_l", "_r")


def union_unique(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """All rows of tables with the same columns; a key that two rows have fails the query when it is read."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    clash = F.raise_error(F.concat_ws(" ", F.lit("repeated:"), *[c(k).cast("string") for k in keys]))
    first = keys[0]
    return out.withColumn(first, F.when(n > 1, clash.cast(out.schema[first].dataType)).otherwise(c(first)))
