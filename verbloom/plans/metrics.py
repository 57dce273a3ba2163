"""Scores of the surrogate clustering against its gold labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verbloom.operators import metrics as m
from verbloom.plans import surrogate as s

c = F.col
_MICRO = "sum(n * p) / sum(n) AS precision, sum(n * r) / sum(n) AS recall, sum(n) AS weight"
_OUT = "round(precision, 6) AS precision, round(recall, 6) AS recall, round(weight, 6) AS weight, round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END, 6) AS f1"


def label_counts(spark: SparkSession, d: str) -> DataFrame:
    return s.counts(spark, d)


def purity_collocation(spark: SparkSession, d: str) -> DataFrame:
    """Per verb type, with a row All over everything."""
    counts = s.counts(spark, d)
    each = m.purity_collocation(counts, ["verb_type"])
    every = m.purity_collocation(counts.withColumn("g", F.lit("All")), ["g"]).withColumnRenamed("g", "verb_type")
    return s.rounded(each.unionByName(every))


def pur_coll_verb(spark: SparkSession, d: str) -> DataFrame:
    each = m.purity_collocation(s.counts(spark, d), ["verb_type"])
    return s.rounded(each.agg(F.avg("purity").alias("purity"), F.avg("collocation").alias("collocation"), F.count(F.lit(1)).alias("n_verbs")))


def b3_by_label(spark: SparkSession, d: str) -> DataFrame:
    return s.rounded(m.b3_by_label(s.counts(spark, d)))


def b3_instance(spark: SparkSession, d: str) -> DataFrame:
    cells = m.b3_cells(s.counts(spark, d))
    every = m.micro(cells.withColumn("g", F.lit("All")), ["g"]).withColumnRenamed("g", "verb_type")
    return s.rounded(m.micro(cells, ["verb_type"]).unionByName(every))


def b3_mfs(spark: SparkSession, d: str) -> DataFrame:
    return s.rounded(m.micro(m.with_main_label(s.counts(spark, d)).filter("main"), ["verb_type"]))


def b3_lfs(spark: SparkSession, d: str) -> DataFrame:
    return s.rounded(m.micro(m.with_main_label(s.counts(spark, d)).filter("NOT main"), ["verb_type"]))


def b3_macro_label(spark: SparkSession, d: str) -> DataFrame:
    return s.rounded(m.macro(m.b3_by_label(s.counts(spark, d)), ["verb_type"]))


def b3_macro_verb(spark: SparkSession, d: str) -> DataFrame:
    return s.rounded(m.macro(m.micro(m.b3_cells(s.counts(spark, d)), ["verb_type"]), []))


def _grouped(spark: SparkSession, d: str) -> DataFrame:
    group = F.when(c("label").isin("R0", "R1"), "Arg").when(c("label") == "R2", "Mod").when(c("label") == "R3", "Lex").otherwise("Other")
    return m.groupings(m.b3_cells(s.counts(spark, d)).withColumn("label_group", group))


def prf_groupings(spark: SparkSession, d: str) -> DataFrame:
    return s.rounded(_grouped(spark, d))


def prf_report(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the per verb and label report: scores, smoothed scores and each row's share of the error."""
    rows = m.smoothed(m.b3_by_label(s.counts(spark, d)), ["label"], [10, 50, 100])
    return s.rounded(m.with_error_share(rows, ["label"]))


def compare_models(spark: SparkSession, d: str) -> DataFrame:
    """Difference of two models' scores by verb type and label."""
    gold = s.gold(spark, d)
    score = lambda clusters: m.smoothed(m.b3_by_label(m.label_counts(clusters, gold, ["instance"])), ["label"], [10, 100])
    both = m.compared(score(s.predicted(spark, d)), score(s.predicted_light(spark, d)), ["verb_type", "label"], ["f1", "f1_s10", "f1_s100"])
    return s.rounded(both.select("verb_type", "label", "weight", "delta_f1", "delta_f1_s10", "delta_f1_s100"))


def scatter_points(spark: SparkSession, d: str) -> DataFrame:
    """Points of the verb-wise plot: precision and recall to two digits, weights of equal points added."""
    two = lambda k: F.floor(c(k) * 100 + 0.5 + 1e-9) / 100  # halves go up, whatever the last bits of the sums
    at = m.micro(m.b3_cells(s.counts(spark, d)), ["verb_type", "label"]).select(two("precision").alias("x"), two("recall").alias("y"), "weight")
    return at.groupBy("x", "y").agg(F.sum("weight").alias("weight"))


QUERIES = {f.__name__: f for f in (label_counts, purity_collocation, pur_coll_verb, b3_by_label, b3_instance, b3_mfs, b3_lfs, b3_macro_label, b3_macro_verb, prf_groupings, prf_report, compare_models, scatter_points)}

_PC = """
    a AS (SELECT {g} AS verb_type, sum(m) AS m, sum(n) AS n FROM (SELECT verb_type, cluster, max(n) AS m, sum(n) AS n FROM counts GROUP BY ALL) GROUP BY 1),
    b AS (SELECT {g} AS verb_type, sum(m) AS m FROM (SELECT verb_type, label, max(n) AS m FROM counts GROUP BY ALL) GROUP BY 1),
    pc AS (SELECT verb_type, a.m / n AS precision, b.m / n AS recall, n AS weight FROM a JOIN b USING (verb_type))"""
_PC_OUT = "SELECT verb_type, round(precision, 6) AS purity, round(recall, 6) AS collocation, weight, round(2 * precision * recall / (precision + recall), 6) AS f1 FROM pc"
_MAIN = "main AS (SELECT verb_type, label FROM (SELECT verb_type, label, row_number() OVER (PARTITION BY verb_type ORDER BY m DESC, label) AS k FROM (SELECT verb_type, label, sum(n) AS m FROM counts GROUP BY ALL)) WHERE k = 1)"
_BY_LABEL = f"b3 AS (SELECT verb_type, label, {_MICRO} FROM cells GROUP BY ALL)"
_F1 = "CASE WHEN {p} + {r} > 0 THEN 2 * ({p}) * ({r}) / (({p}) + ({r})) ELSE 0 END"


def _smooth(k: int) -> str:
    return _F1.format(p=f"(precision * weight + mp * {k}) / (weight + {k})", r=f"(recall * weight + mr * {k}) / (weight + {k})")


def _model(name: str, clusters: str) -> str:
    return f"""
    {name}_counts AS (SELECT verb_type, cluster, label, count(*)::DOUBLE AS n FROM {clusters} JOIN gold USING (instance) GROUP BY ALL),
    {name}_cells AS (SELECT *, n / sum(n) OVER (PARTITION BY verb_type, cluster) AS p, n / sum(n) OVER (PARTITION BY verb_type, label) AS r FROM {name}_counts),
    {name}_b AS (SELECT verb_type, label, {_MICRO} FROM {name}_cells GROUP BY ALL),
    {name}_m AS (SELECT *, avg(precision) OVER (PARTITION BY label) AS mp, avg(recall) OVER (PARTITION BY label) AS mr FROM {name}_b),
    {name} AS (SELECT verb_type, label, weight, {_F1.format(p='precision', r='recall')} AS f, {_smooth(10)} AS f10, {_smooth(100)} AS f100 FROM {name}_m)"""


_W = f"WITH {s.BASE}, {s.CELLS}"
SQL = {
    "label_counts": f"WITH {s.BASE} SELECT * FROM counts",
    "purity_collocation": f"WITH {s.BASE}, {_PC.format(g='verb_type')} {_PC_OUT} UNION ALL (WITH {s.BASE}, {_PC.format(g=chr(39) + 'All' + chr(39))} {_PC_OUT})",
    "pur_coll_verb": f"WITH {s.BASE}, {_PC.format(g='verb_type')} SELECT round(avg(precision), 6) AS purity, round(avg(recall), 6) AS collocation, count(*) AS n_verbs FROM pc",
    "b3_by_label": f"{_W}, {_BY_LABEL} SELECT verb_type, label, {_OUT} FROM b3",
    "b3_instance": f"{_W}, b AS (SELECT verb_type, {_MICRO} FROM cells GROUP BY ALL UNION ALL SELECT 'All', {_MICRO} FROM cells) SELECT verb_type, {_OUT} FROM b",
    "b3_mfs": f"{_W}, {_MAIN}, b AS (SELECT verb_type, {_MICRO} FROM cells SEMI JOIN main USING (verb_type, label) GROUP BY ALL) SELECT verb_type, {_OUT} FROM b",
    "b3_lfs": f"{_W}, {_MAIN}, b AS (SELECT verb_type, {_MICRO} FROM cells ANTI JOIN main USING (verb_type, label) GROUP BY ALL) SELECT verb_type, {_OUT} FROM b",
    "b3_macro_label": f"{_W}, {_BY_LABEL}, b AS (SELECT verb_type, avg(precision) AS precision, avg(recall) AS recall, count(*)::DOUBLE AS weight FROM b3 GROUP BY ALL) SELECT verb_type, {_OUT} FROM b",
    "b3_macro_verb": f"{_W}, v AS (SELECT verb_type, {_MICRO} FROM cells GROUP BY ALL), b AS (SELECT avg(precision) AS precision, avg(recall) AS recall, count(*)::DOUBLE AS weight FROM v) SELECT {_OUT} FROM b",
    "prf_groupings": f"""{_W}, grouped AS (SELECT *, CASE WHEN label IN ('R0', 'R1') THEN 'Arg' WHEN label = 'R2' THEN 'Mod' WHEN label = 'R3' THEN 'Lex' ELSE 'Other' END AS label_group FROM cells),
    b AS (SELECT coalesce(verb_type, 'All') AS verb_type, coalesce(label, 'All') AS label, coalesce(label_group, 'All') AS label_group, {_MICRO} FROM grouped
          GROUP BY GROUPING SETS ((verb_type), (label), (verb_type, label), (label_group), (verb_type, label_group)))
    SELECT verb_type, label, label_group, {_OUT} FROM b""",
    "prf_report": f"""{_W}, {_BY_LABEL}, m AS (SELECT *, avg(precision) OVER (PARTITION BY label) AS mp, avg(recall) OVER (PARTITION BY label) AS mr, {_F1.format(p='precision', r='recall')} AS f FROM b3)
    SELECT verb_type, label, {_OUT}, round({_smooth(10)}, 6) AS f1_s10, round({_smooth(50)}, 6) AS f1_s50, round({_smooth(100)}, 6) AS f1_s100,
           round((1 - f) * weight / sum((1 - f) * weight) OVER (PARTITION BY label), 6) AS error_share FROM m""",
    "compare_models": f"WITH {s.BASE}, {s.LIGHT}, {_model('x', 'predicted')}, {_model('y', 'light')} SELECT verb_type, label, x.weight, round(y.f - x.f, 6) + 0.0::DOUBLE AS delta_f1, round(y.f10 - x.f10, 6) + 0.0::DOUBLE AS delta_f1_s10, round(y.f100 - x.f100, 6) + 0.0::DOUBLE AS delta_f1_s100 FROM x JOIN y USING (verb_type, label)",
    "scatter_points": f"{_W}, {_BY_LABEL} SELECT floor(precision * 100 + 0.5::DOUBLE + 1e-9::DOUBLE) / 100 AS x, floor(recall * 100 + 0.5::DOUBLE + 1e-9::DOUBLE) / 100 AS y, sum(weight) AS weight FROM b3 GROUP BY ALL",
}
