"""Instances, distributions, gold and predicted labels made of the order tables, for queries that need all of them.

verb type = p_type, instance = l_suppkey, item = p_brand weighted by the summed l_quantity, gold label = region of the
supplier's nation, predicted cluster = the instance's heaviest item.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verbloom.functions.dist import top_items
from verbloom.operators.metrics import label_counts
from verbloom.session import cut, table

c = F.col


def dist(spark: SparkSession, d: str) -> DataFrame:
    """(verb_type, instance, item, value)"""
    line = table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_quantity")
    part = table(spark, d, "part").select(c("p_partkey").alias("l_partkey"), c("p_type").alias("verb_type"), c("p_brand").alias("item"))
    return line.join(part, "l_partkey").groupBy("verb_type", c("l_suppkey").alias("instance"), "item").agg(F.sum("l_quantity").alias("value"))


def gold(spark: SparkSession, d: str) -> DataFrame:
    """(instance, label)"""
    nation = table(spark, d, "nation").select(c("n_nationkey").alias("s_nationkey"), "n_regionkey")
    return table(spark, d, "supplier").join(nation, "s_nationkey").select(c("s_suppkey").alias("instance"), F.concat(F.lit("R"), c("n_regionkey").cast("string")).alias("label"))


def predicted(spark: SparkSession, d: str) -> DataFrame:
    """(verb_type, instance, cluster)"""
    return top_items(dist(spark, d), ["verb_type", "instance"], 1).select("verb_type", "instance", c("item").alias("cluster"))


def predicted_light(spark: SparkSession, d: str) -> DataFrame:
    """A second model: the cluster is the instance's lightest item."""
    light = dist(spark, d).withColumn("value", -c("value"))
    return top_items(light, ["verb_type", "instance"], 1).select("verb_type", "instance", c("item").alias("cluster"))


def counts(spark: SparkSession, d: str) -> DataFrame:
    """(verb_type, cluster, label, n); written once, as scores read it several times and it is small."""
    return cut(label_counts(predicted(spark, d), gold(spark, d), ["instance"]))


DIST = """dist AS (SELECT p_type AS verb_type, l_suppkey AS instance, p_brand AS item, sum(l_quantity) AS value FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)"""
GOLD = """gold AS (SELECT s_suppkey AS instance, 'R' || n_regionkey AS label FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""
PREDICTED = """predicted AS (SELECT verb_type, instance, item AS cluster FROM (SELECT *, row_number() OVER (PARTITION BY verb_type, instance ORDER BY value DESC, item) AS r FROM dist) WHERE r = 1)"""
LIGHT = """light AS (SELECT verb_type, instance, item AS cluster FROM (SELECT *, row_number() OVER (PARTITION BY verb_type, instance ORDER BY value, item) AS r FROM dist) WHERE r = 1)"""
COUNTS = """counts AS (SELECT verb_type, cluster, label, count(*)::DOUBLE AS n FROM predicted JOIN gold USING (instance) GROUP BY ALL)"""
BASE = f"{DIST}, {GOLD}, {PREDICTED}, {COUNTS}"
CELLS = """cells AS (SELECT *, n / sum(n) OVER (PARTITION BY verb_type, cluster) AS p, n / sum(n) OVER (PARTITION BY verb_type, label) AS r FROM counts)"""


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, without negative zeros, as results are compared."""
    return df.withColumns({n: F.round(n, digits) + F.lit(0.0) for n, t in df.dtypes if t == "double"})
