"""Top N items of every group, however large the groups are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verbloom.llm.common import PAGE, good_span, valid_pages
from verbloom.session import table


def top_n(df: DataFrame, groups: list[str], n: int, order: list[Column]) -> DataFrame:
    """The first `n` rows of each group in `order`, with their `rank`; `order` has to settle every tie.

    A row_number window under a rank filter: the optimiser's group limit keeps at most `n` rows of a group in each
    task before the shuffle, and `n` again after it, so a group of any size costs the network n rows a task.
    Null group keys form a group of their own, as in GROUP BY; groups with fewer rows keep all; no rows, no result.
    """
    w = Window.partitionBy(*groups).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def best_spans(spark: SparkSession, sf_dir: str, n: int = 3) -> DataFrame:
    """Per verb the `n` spans of its whole beam with the highest probability, ties by begin, then end.

    A span given several times has its highest probability; entries whose probability is null, NaN or outside 0..1,
    or whose span isn't [begin, end) with begin < end, aren't ranked.
    """
    prob = lambda e: F.coalesce((e["span_prob"] >= 0) & (e["span_prob"] <= 1), F.lit(False))
    usable = F.filter(F.coalesce(F.col("beam"), F.array()), lambda e: good_span(e["span"]) & prob(e))
    narrow = F.transform(usable, lambda e: F.struct(e["span"][0].alias("b"), e["span"][1].alias("e"), e["span_prob"].alias("p")))
    pages = valid_pages(table(spark, sf_dir, "verb_prediction", [*PAGE, "beam.span", "beam.span_prob"]), narrow)
    spans = pages.select("sentence_id", "verb_index", F.explode("payload").alias("s")).groupBy("sentence_id", "verb_index", F.col("s.b").alias("span_begin"), F.col("s.e").alias("span_end")).agg(F.max("s.p").alias("span_prob"))
    return top_n(spans, ["sentence_id", "verb_index"], n, [F.col("span_prob").desc(), F.col("span_begin"), F.col("span_end")])


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_spans(spark, sf_dir).select("sentence_id", "verb_index", "span_begin", "span_end")


def p7_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_spans(spark, sf_dir).select("sentence_id", "verb_index", F.col("rank").cast("bigint").alias("rank"), "span_begin", "span_end", "span_prob")


QUERIES = {"p7_found": p7_found, "p7_ranked": p7_ranked}

NORM_ID = "lower(trim({c}, chr(32) || chr(9) || chr(10) || chr(13) || chr(11) || chr(12) || chr(160)))"
_VALID = f"""
    valid AS (
      SELECT * EXCLUDE (n) FROM (
        SELECT *, row_number() OVER (PARTITION BY sid, verb_index, beam_page ORDER BY produced_at DESC NULLS LAST) AS n
        FROM (SELECT {NORM_ID.format(c='sentence_id')} AS sid, verb_index, beam_page, produced_at, beam FROM verb_prediction)
        WHERE sid IS NOT NULL AND verb_index IS NOT NULL) WHERE n = 1),
    entry AS (
      SELECT sid, verb_index, x.span[1] AS b, x.span[2] AS e, x.span_prob AS p, x.questions AS q
      FROM (SELECT sid, verb_index, unnest(beam) AS x FROM valid) WHERE len(x.span) = 2 AND x.span[1] < x.span[2])"""
VALID_SPANS = _VALID
_RANKED = f"""
    WITH {_VALID},
    best AS (SELECT sid, verb_index, b, e, max(p) AS p FROM entry WHERE p >= 0 AND p <= 1 GROUP BY ALL),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY sid, verb_index ORDER BY p DESC, b, e) AS r FROM best)
    SELECT sid AS sentence_id, verb_index, {{cols}} b AS span_begin, e AS span_end {{more}} FROM ranked WHERE r <= 3"""
SQL = {"p7_found": _RANKED.format(cols="", more=""), "p7_ranked": _RANKED.format(cols="r AS rank,", more=", p AS span_prob")}
