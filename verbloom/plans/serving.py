"""Point lookups and summaries over stored clusterings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verbloom.functions import dist as a
from verbloom.operators import metrics as m
from verbloom.plans import surrogate as s

c = F.col


def get_verbs(spark: SparkSession, d: str) -> DataFrame:
    """Verb types with their number of instances and their share of all."""
    n = s.predicted(spark, d).groupBy("verb_type").agg(F.count(F.lit(1)).alias("n"))
    return s.rounded(n.withColumn("share", c("n") / F.sum("n").over(Window.partitionBy())))


def get_model(spark: SparkSession, d: str, verb_type: str = "PROMO") -> DataFrame:
    """Clusters of one verb type: sizes and members' range."""
    return s.predicted(spark, d).filter(c("verb_type") == verb_type).groupBy("cluster").agg(F.count(F.lit(1)).alias("size"), F.min("instance").alias("first"), F.max("instance").alias("last"))


def role_lookup(spark: SparkSession, d: str) -> DataFrame:
    """For each instance the number of its cluster by falling size, or the name `other` for clusters of one."""
    p = s.predicted(spark, d)
    n = p.groupBy("verb_type", "cluster").agg(F.count(F.lit(1)).alias("size"))
    place = n.filter("size > 1").withColumn("place", F.row_number().over(Window.partitionBy("verb_type").orderBy(c("size").desc(), "cluster")))
    return p.join(place.select("verb_type", "cluster", c("place").cast("string").alias("role")), ["verb_type", "cluster"], "left").select("verb_type", "instance", F.coalesce("role", F.lit("other")).alias("role"))


def role_summary(spark: SparkSession, d: str) -> DataFrame:
    """Per cluster: members, and the share of its three heaviest items summed over them."""
    p = s.predicted(spark, d)
    items = a.total(s.dist(spark, d).join(p, ["verb_type", "instance"]), ["verb_type", "cluster"])
    top = a.top_items(a.normalized(items, ["verb_type", "cluster"]), ["verb_type", "cluster"], 3)
    size = p.groupBy("verb_type", "cluster").agg(F.count(F.lit(1)).alias("size"))
    return s.rounded(top.join(size, ["verb_type", "cluster"]))


def gold_summary(spark: SparkSession, d: str) -> DataFrame:
    """Gold labels of each cluster's members with their share."""
    counts = s.counts(spark, d)
    return s.rounded(counts.withColumn("share", c("n") / F.sum("n").over(Window.partitionBy("verb_type", "cluster"))))


def error_table(spark: SparkSession, d: str) -> DataFrame:
    """B-cubed F1 of each label with its contribution to a verb type's error."""
    return s.rounded(m.with_error_share(m.b3_by_label(s.counts(spark, d)), ["verb_type"]).select("verb_type", "label", "f1", "error_share"))


QUERIES = {f.__name__: f for f in (get_verbs, get_model, role_lookup, role_summary, gold_summary, error_table)}
SQL = {
    "get_verbs": f"WITH {s.DIST}, {s.PREDICTED}, n AS (SELECT verb_type, count(*) AS n FROM predicted GROUP BY ALL) SELECT verb_type, n, round(n / sum(n) OVER (), 6) AS share FROM n",
    "get_model": f"WITH {s.DIST}, {s.PREDICTED} SELECT cluster, count(*) AS size, min(instance) AS first, max(instance) AS last FROM predicted WHERE verb_type = 'PROMO' GROUP BY cluster",
    "role_lookup": f"WITH {s.DIST}, {s.PREDICTED}, n AS (SELECT verb_type, cluster, count(*) AS size FROM predicted GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY verb_type ORDER BY size DESC, cluster) AS k FROM n WHERE size > 1) SELECT verb_type, instance, coalesce(k::VARCHAR, 'other') AS role FROM predicted LEFT JOIN k USING (verb_type, cluster)",
    "role_summary": f"WITH {s.DIST}, {s.PREDICTED}, t AS (SELECT verb_type, cluster, item, sum(value) AS v FROM dist JOIN predicted USING (verb_type, instance) GROUP BY ALL), sh AS (SELECT verb_type, cluster, item, v / sum(v) OVER (PARTITION BY verb_type, cluster) AS v FROM t), r AS (SELECT *, row_number() OVER (PARTITION BY verb_type, cluster ORDER BY v DESC, item) AS rank FROM sh), n AS (SELECT verb_type, cluster, count(*) AS size FROM predicted GROUP BY ALL) SELECT verb_type, cluster, item, round(v, 6) AS value, rank, size FROM r JOIN n USING (verb_type, cluster) WHERE rank <= 3",
    "gold_summary": f"WITH {s.BASE} SELECT verb_type, cluster, label, n, round(n / sum(n) OVER (PARTITION BY verb_type, cluster), 6) AS share FROM counts",
    "error_table": f"WITH {s.BASE}, {s.CELLS}, b AS (SELECT verb_type, label, sum(n * p) / sum(n) AS precision, sum(n * r) / sum(n) AS recall, sum(n) AS w FROM cells GROUP BY ALL), f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f FROM b) SELECT verb_type, label, round(f, 6) AS f1, round((1 - f) * w / sum((1 - f) * w) OVER (PARTITION BY verb_type), 6) AS error_share FROM f",
}
