"""Mutual information between labels, items and brands of the surrogate instances."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verbloom.operators import association as a
from verbloom.plans import surrogate as s

c = F.col


def npmi_symmetric(spark: SparkSession, d: str) -> DataFrame:
    return s.rounded(a.symmetric(s.counts(spark, d)))


def npmi_aggregate(spark: SparkSession, d: str) -> DataFrame:
    return s.rounded(a.symmetric(s.counts(spark, d), within_verb=True))


def npmi_with_sources(spark: SparkSession, d: str) -> DataFrame:
    out = a.with_sources(s.dist(spark, d), ["verb_type"])
    return s.rounded(out.select("x", "y", "verb_type", "joint", "independent", "source_share", "npmi", "covariance", "correlation"))


def npmi_heterogeneous(spark: SparkSession, d: str) -> DataFrame:
    """Brands of an instance against its gold label."""
    dist = s.dist(spark, d)
    label = dist.select("verb_type", "instance").distinct().join(s.gold(spark, d), "instance").select("verb_type", "instance", c("label").alias("item"), F.lit(1.0).alias("value"))
    return s.rounded(a.heterogeneous(dist, label, ["verb_type", "instance"]))


def npmi_heatmap(spark: SparkSession, d: str) -> DataFrame:
    """npmi_symmetric as a matrix: a row per label, a column per label."""
    pairs = a.symmetric(s.counts(spark, d)).select("x", "y", "npmi")
    both = pairs.unionByName(pairs.filter("x < y").select(c("y").alias("x"), c("x").alias("y"), "npmi"))
    labels = [f"R{i}" for i in range(5)]
    return s.rounded(both.groupBy(c("y").alias("label")).pivot("x", labels).agg(F.first("npmi")))


QUERIES = {f.__name__: f for f in (npmi_symmetric, npmi_aggregate, npmi_with_sources, npmi_heterogeneous, npmi_heatmap)}

_NPMI = "CASE WHEN joint IS NULL OR joint <= 0 THEN -1 WHEN joint >= 1 THEN 0 ELSE ln(joint / independent) / -ln(joint) END"
_SYMMETRIC = f"""
    total AS (SELECT sum(n) AS t FROM counts),
    sized AS (SELECT *, sum(n) OVER (PARTITION BY verb_type, cluster) AS size FROM counts),
    joint AS (SELECT a.label AS x, b.label AS y, sum(a.n * b.n / a.size) / any_value(t) AS joint FROM sized a JOIN counts b USING (verb_type, cluster), total WHERE a.label <= b.label GROUP BY ALL),
    m AS (SELECT {{v}} AS v, label, sum(n) AS m FROM counts GROUP BY ALL),
    mt AS (SELECT *, sum(m) OVER (PARTITION BY v) AS vt FROM m),
    independent AS (SELECT a.label AS x, b.label AS y, sum(a.m * b.m / a.vt) / any_value(t) AS independent FROM mt a JOIN mt b USING (v), total WHERE a.label <= b.label GROUP BY ALL),
    out AS (SELECT x, y, coalesce(joint, 0) AS joint, independent FROM independent LEFT JOIN joint USING (x, y)),
    scored AS (SELECT x, y, joint, independent, {_NPMI} AS npmi FROM out)"""
_ROUND = "SELECT x, y, round(joint, 6) AS joint, round(independent, 6) AS independent, round(npmi, 6) + 0.0::DOUBLE AS npmi FROM scored"
SQL = {
    "npmi_symmetric": f"WITH {s.BASE}, {_SYMMETRIC.format(v='1')} {_ROUND}",
    "npmi_aggregate": f"WITH {s.BASE}, {_SYMMETRIC.format(v='verb_type')} {_ROUND}",
    "npmi_with_sources": f"""WITH {s.DIST}, d AS (SELECT *, sum(value) OVER (PARTITION BY verb_type, instance) AS t FROM dist), w AS (SELECT sum(value) AS w FROM dist),
    src AS (SELECT a.item AS x, b.item AS y, verb_type, sum(a.value * b.value / a.t) / any_value(w) AS sj FROM d a JOIN dist b USING (verb_type, instance), w WHERE a.item <= b.item GROUP BY ALL),
    tot AS (SELECT x, y, sum(sj) AS joint FROM src GROUP BY ALL),
    p AS (SELECT item, sum(value) / any_value(w) AS p FROM dist, w GROUP BY item),
    sd AS (SELECT item, p, sqrt(greatest(joint - p * p, 0)) AS sd FROM p JOIN tot ON x = item AND y = item),
    j AS (SELECT a.item AS x, b.item AS y, coalesce(joint, 0) AS joint, a.p * b.p AS independent, a.sd * b.sd AS spread FROM sd a JOIN sd b ON a.item <= b.item LEFT JOIN tot ON x = a.item AND y = b.item),
    scored AS (SELECT j.*, verb_type, sj FROM j LEFT JOIN src USING (x, y))
    SELECT x, y, verb_type, round(joint, 6) AS joint, round(independent, 6) AS independent, round(sj / joint, 6) AS source_share, round({_NPMI}, 6) + 0.0::DOUBLE AS npmi,
           round(joint - independent, 6) + 0.0::DOUBLE AS covariance, round((joint - independent) / nullif(spread, 0), 6) + 0.0::DOUBLE AS correlation FROM scored""",
    "npmi_heterogeneous": f"""WITH {s.DIST}, {s.GOLD}, l AS (SELECT verb_type, instance, item, value / sum(value) OVER (PARTITION BY verb_type, instance) AS v FROM dist),
    cell AS (SELECT item AS x, label AS y, sum(v) AS v FROM l JOIN gold USING (instance) GROUP BY ALL), t AS (SELECT sum(v) AS t FROM cell),
    scored AS (SELECT x, y, v / t AS joint, sum(v) OVER (PARTITION BY x) * sum(v) OVER (PARTITION BY y) / (t * t) AS independent FROM cell, t)
    SELECT x, y, round(joint, 6) AS joint, round(independent, 6) AS independent, round({_NPMI}, 6) + 0.0::DOUBLE AS npmi FROM scored""",
    "npmi_heatmap": f"""WITH {s.BASE}, {_SYMMETRIC.format(v='1')}, both_ways AS (SELECT x, y, npmi FROM scored UNION SELECT y, x, npmi FROM scored)
    SELECT y AS label, {", ".join(f"round(max(CASE WHEN x = 'R{i}' THEN npmi END), 6) + 0.0::DOUBLE AS R{i}" for i in range(5))} FROM both_ways GROUP BY y""",
}
