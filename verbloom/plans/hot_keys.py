"""p4: complete per-key results of tables in which a few keys hold most rows, and those keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verbloom.functions.clean import norm_id
from verbloom.operators.skew import balanced_by_key, hot_keys
from verbloom.session import table


def per_sentence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balanced_by_key(table(spark, sf_dir, "verb_prediction"), norm_id("sentence_id"), F.col("produced_at"))


def per_lemma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balanced_by_key(table(spark, sf_dir, "mlm_feature"), norm_id("verb_lemma"), F.col("produced_at"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys on at least 1/50 of the rows that have one, rows as they are."""

    def hot(field: str, name: str, per_key: DataFrame) -> DataFrame:
        counted = table(spark, sf_dir, name).filter(F.col(field).isNotNull())
        return hot_keys(per_key, counted).select(F.lit(field).alias("field"), F.col("key").alias("hot_key"))

    sentences = hot("sentence_id", "verb_prediction", per_sentence(spark, sf_dir))
    return sentences.unionByName(hot("verb_lemma", "mlm_feature", per_lemma(spark, sf_dir)))


def p4_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return per_sentence(spark, sf_dir).drop("n_parts")


def p4_lemmas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return per_lemma(spark, sf_dir).drop("n_parts")


QUERIES = {"p4_found": p4_found, "p4_sentences": p4_sentences, "p4_lemmas": p4_lemmas}

_NORM = "lower(trim({c}, chr(32) || chr(9) || chr(10) || chr(13) || chr(11) || chr(12) || chr(160)))"


def _per_key(t: str, c: str) -> str:
    return f"""
    SELECT key, count(*) AS n_rows, min(produced_at) AS first_at, max(produced_at) AS last_at,
           max(date_diff('microsecond', prev, produced_at)) AS max_gap_us
    FROM (SELECT key, produced_at, lag(produced_at) OVER (PARTITION BY key ORDER BY produced_at NULLS FIRST) AS prev
          FROM (SELECT {_NORM.format(c=c)} AS key, produced_at FROM {t}) WHERE key IS NOT NULL)
    GROUP BY key"""


def _hot(t: str, c: str) -> str:
    return f"""
    SELECT '{c}' AS field, key AS hot_key FROM (SELECT {_NORM.format(c=c)} AS key FROM {t}) WHERE key IS NOT NULL
    GROUP BY key HAVING count(*) * 50 >= (SELECT count(*) FROM {t} WHERE {c} IS NOT NULL)"""


SQL = {
    "p4_found": _hot("verb_prediction", "sentence_id") + " UNION ALL " + _hot("mlm_feature", "verb_lemma"),
    "p4_sentences": _per_key("verb_prediction", "sentence_id"),
    "p4_lemmas": _per_key("mlm_feature", "verb_lemma"),
}
