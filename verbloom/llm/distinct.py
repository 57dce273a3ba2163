"""How characteristic each term of a record is of that record.

Method: hypergeometric enrichment. The counts of a record are draws from the counts of the collection; the exact
upper-tail probability of a term's count comes from log-gamma sums in vectorised code, gets adjusted for false
discovery within the record, and its negative logarithm is the enrichment. Beside it stands the product of share and
log inverse record frequency, which is the score that p6_found is defined by.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verbloom.functions.clean import norm_question
from verbloom.llm.common import dictionary, dist_entries, valid_args
from verbloom.llm.cooccur import NORM_Q
from verbloom.llm.termfreq import VALID_ARGS
from verbloom.session import cut, table

#: The weights of a record are rounded to about so many draws.
DRAWS = 100
#: Coefficients of the Lanczos approximation (g = 7, n = 9) of the gamma function.
_LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function for x >= 1, elementwise."""
    x = np.asarray(x, dtype=np.float64) - 1.0
    series = np.full_like(x, _LANCZOS[0])
    for i, c in enumerate(_LANCZOS[1:], 1):
        series += c / (x + i)
    t = x + 7.5
    return 0.5 * np.log(2 * np.pi) + (x + 0.5) * np.log(t) - t + np.log(series)


def _log_choose(n: np.ndarray, k: np.ndarray) -> np.ndarray:
    return log_gamma(n + 1.0) - log_gamma(k + 1.0) - log_gamma(n - k + 1.0)


def log_upper_tail(k: np.ndarray, total: float, marked: np.ndarray, drawn: np.ndarray) -> np.ndarray:
    """log P(X >= k) for `drawn` draws without replacement from `total` things of which `marked` are of the kind."""
    k, marked, drawn = (np.asarray(x, dtype=np.float64) for x in (k, marked, drawn))
    low = np.maximum(0.0, drawn + marked - total)
    k = np.maximum(k, low)
    top = np.minimum(drawn, marked)
    first = _log_choose(marked, k) + _log_choose(total - marked, drawn - k) - _log_choose(np.float64(total), drawn)
    term = np.ones_like(k)
    series, i = term.copy(), k.copy()
    while True:  # ratios of neighbouring terms; ends at the top of the range or when nothing is added any more
        ratio = (marked - i) * (drawn - i) / ((i + 1) * (total - marked - drawn + i + 1))
        term = np.where(i < top, term * ratio, 0.0)
        if not (term > 1e-17 * series).any():
            break
        series += term
        i += 1
    return np.where(k <= low, 0.0, np.minimum(first + np.log(series), 0.0))


def _tails(total: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                count, marked, drawn = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("count", "marked", "drawn"))
                tail = pa.array(log_upper_tail(count, float(total), marked, drawn))
                yield pa.RecordBatch.from_arrays([*b.columns, tail], [*b.schema.names, "log_p"])

    return run


def _entries(records: DataFrame) -> tuple[DataFrame, int]:
    """(id, k, share, n_holding) of every term of every record, and the number of records with a term."""
    entry = records.select("id", F.explode("terms").alias("t")).groupBy("id", F.col("t.k").alias("k")).agg(F.sum("t.w").alias("w"))
    entry = cut(entry.select("id", "k", (F.col("w") / F.sum("w").over(Window.partitionBy("id"))).alias("share")))
    n = entry.agg(F.countDistinct("id")).first()[0]
    held = entry.groupBy("k").agg(F.count(F.lit(1)).alias("n_holding"))
    return entry.join(held, "k").select("id", "k", "share", "n_holding"), n


def scored(records: DataFrame) -> DataFrame:
    """(id, k, share, n_records, n_holding, score) of every term hash k of every record.

    `records` has `id` and `terms`, an array of (k, w) with w > 0; weights of equal terms add up. Records that are null
    or empty count for nothing. score = share * ln(n_records / n_holding) rounded to 6 digits; a term that all hold has
    score 0. Ids have to be unique.
    """
    entry, n = _entries(records)
    return entry.withColumns({"n_records": F.lit(n), "score": F.round(F.col("share") * F.log(F.lit(float(n)) / F.col("n_holding")), 6)})


def distinctive(records: DataFrame) -> DataFrame:
    """`scored` with `enrichment`: -log10 of the hypergeometric upper tail of the term's count (share * DRAWS, rounded, at
    least 1), adjusted within the record by Benjamini and Hochberg, rounded to 4 digits."""
    own = Window.partitionBy("id")
    both = scored(records).withColumn("count", F.greatest(F.round(F.round(F.col("share") * DRAWS, 6)), F.lit(1)).cast("bigint"))
    both = cut(both.withColumns({"drawn": F.sum("count").over(own)}))
    total = both.agg(F.sum("count")).first()[0] or 0
    marked = both.groupBy("k").agg(F.sum("count").alias("marked"))
    shape = "id bigint, k bigint, share double, n_holding bigint, n_records bigint, score double, count bigint, drawn bigint, marked bigint"
    rows = both.join(marked, "k").selectExpr(*[f"CAST({c.split()[0]} AS {c.split()[1]}) AS {c.split()[0]}" for c in shape.split(", ")])
    tails = rows.mapInArrow(_tails(total), f"{shape}, log_p double")
    by_p = own.orderBy("log_p", "k")
    ranked = tails.withColumn("i", F.row_number().over(by_p)).withColumn("adjusted", F.col("log_p") + F.log(F.count(F.lit(1)).over(own) / F.col("i")))
    lowest = F.least(F.min("adjusted").over(by_p.rowsBetween(0, Window.unboundedFollowing)), F.lit(0.0))
    return ranked.select("id", "k", "share", "n_records", "n_holding", "score", (F.round(-lowest / F.lit(float(np.log(10))), 4) + F.lit(0.0)).alias("enrichment"))


def _questions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Records of the questions of valid arguments, and the question strings."""
    raw = table(spark, sf_dir, "arg_feature")
    records = valid_args(raw, dist_entries("question_dist", "question", norm_question).alias("terms")).select(F.col("arg_id").alias("id"), "terms")
    terms = raw.select(F.explode("question_dist.question").alias("q")).distinct().select(norm_question("q").alias("term"))
    return records, terms


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most characteristic question of each argument, of those that two arguments or more have."""
    records, terms = _questions(spark, sf_dir)
    w = Window.partitionBy("id")
    best = scored(records).filter("n_holding >= 2").select("id", "k", "score").withColumn("r", F.rank().over(w.orderBy(F.col("score").desc()))).filter("r = 1")
    named = best.join(dictionary(terms).withColumnRenamed("h", "k"), "k")
    first = named.groupBy("id").agg(F.min("term").alias("question"))
    return first.select(F.col("id").alias("arg_id"), "question")


def p6_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions of arguments with both scores."""
    records, terms = _questions(spark, sf_dir)
    scored = distinctive(records).join(dictionary(terms).withColumnRenamed("h", "k"), "k")
    return scored.select(F.col("id").alias("arg_id"), F.col("term").alias("question"), F.round(F.round("share", 9), 6).alias("share"), "n_records", "n_holding", (F.col("score") + F.lit(0.0)).alias("score"), "enrichment")


QUERIES = {"p6_found": p6_found, "p6_enriched": p6_enriched}
SQL = {
    "p6_found": f"""
    WITH {VALID_ARGS},
    entry AS (
      SELECT arg_id, {NORM_Q.format(c='u.question')} AS q, sum(u.weight) AS w FROM (SELECT arg_id, unnest(question_dist) AS u FROM arg)
      WHERE u.question IS NOT NULL AND u.weight > 0 AND isfinite(u.weight) GROUP BY ALL),
    d AS (SELECT q, count(*) AS d FROM entry GROUP BY q),
    s AS (
      SELECT arg_id, q, d, round(w / sum(w) OVER (PARTITION BY arg_id) * ln((SELECT count(DISTINCT arg_id) FROM entry)::DOUBLE / d), 6) AS score FROM entry JOIN d USING (q))
    SELECT arg_id, q AS question FROM (SELECT *, row_number() OVER (PARTITION BY arg_id ORDER BY score DESC, q) AS r FROM s WHERE d >= 2) WHERE r = 1""",
    "p6_enriched": f"""
    WITH {VALID_ARGS},
    e AS (
      SELECT arg_id, {NORM_Q.format(c='u.question')} AS q, sum(u.weight) AS w FROM (SELECT arg_id, unnest(question_dist) AS u FROM arg)
      WHERE u.question IS NOT NULL AND u.weight > 0 AND isfinite(u.weight) GROUP BY ALL),
    sh AS (SELECT arg_id, q, w / sum(w) OVER (PARTITION BY arg_id) AS share FROM e),
    c AS (SELECT *, greatest(round(round(share * {DRAWS}, 6)), 1)::BIGINT AS k FROM sh),
    d AS (SELECT *, sum(k) OVER (PARTITION BY arg_id)::BIGINT AS drawn, sum(k) OVER (PARTITION BY q)::BIGINT AS marked, count(*) OVER (PARTITION BY q) AS n_holding, sum(k) OVER ()::BIGINT AS total FROM c),
    lc AS (SELECT *, list_transform(range(k, least(drawn, marked) + 1), lambda i: lgamma(marked + 1.0) - lgamma(i + 1.0) - lgamma(marked - i + 1.0) + lgamma(total - marked + 1.0) - lgamma(drawn - i + 1.0) - lgamma(total - marked - drawn + i + 1.0)
        - lgamma(total + 1.0) + lgamma(drawn + 1.0) + lgamma(total - drawn + 1.0)) AS l FROM d),
    p AS (SELECT *, CASE WHEN k <= greatest(0, drawn + marked - total) THEN 0 ELSE least(l[1] + ln(list_sum(list_transform(l, lambda x: exp(x - l[1])))), 0) END AS log_p FROM lc),
    r AS (SELECT *, rank() OVER (PARTITION BY arg_id ORDER BY round(log_p, 9)) + count(*) OVER (PARTITION BY arg_id, round(log_p, 9)) - 1 AS i, count(*) OVER (PARTITION BY arg_id) AS m FROM p),
    f AS (SELECT *, least(min(log_p + ln(m::DOUBLE / i)) OVER (PARTITION BY arg_id ORDER BY log_p DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS low FROM r),
    n AS (SELECT count(DISTINCT arg_id) AS n FROM e)
    SELECT arg_id, q AS question, round(round(share, 9), 6) AS share, n AS n_records, n_holding, round(share * ln(n::DOUBLE / n_holding), 6) AS score, round(-low / ln(10), 4) + 0.0::DOUBLE AS enrichment FROM f, n""",
}
