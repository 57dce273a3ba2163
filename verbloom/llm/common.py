"""Rows that count and the records made of them, shared by the operators of this package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verbloom.functions.clean import latest, norm_id, norm_question, usable
from verbloom.session import cut, table


#: What names a page and its version.
PAGE = ["sentence_id", "verb_index", "beam_page", "produced_at"]


def term_hash(c: Column) -> Column:
    """64 bits that stand for a term in shuffles; dictionaries check that no two terms share them."""
    return F.xxhash64(c)


def good_span(s: Column) -> Column:
    """True for a span of two numbers with begin < end."""
    return F.coalesce((F.size(s) == 2) & (F.get(s, F.lit(0)) < F.get(s, F.lit(1))), F.lit(False))


def valid_pages(df: DataFrame, payload: Column) -> DataFrame:
    """verb_prediction rows that count, with `payload` computed before the shuffle so that only it moves."""
    rows = df.select(norm_id("sentence_id").alias("sentence_id"), "verb_index", "beam_page", "produced_at", payload.alias("payload"))
    return latest(rows.filter("sentence_id IS NOT NULL AND verb_index IS NOT NULL"), ["sentence_id", "verb_index", "beam_page"])


def span_question_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per span prediction with at least one question: `items`, the hashes of its questions, repeated as given.

    Question strings are normalised and hashed in the scan, so the two shuffles (newest page of a verb; entries of a
    span) carry numbers. A span may be given on many pages; a verb may have any number of pages.
    """
    hashes = lambda qs: F.filter(F.transform(qs, lambda q: norm_question(q["question_string"])), lambda x: x.isNotNull() & (x != ""))
    spans = F.transform(
        F.filter(F.coalesce(F.col("beam"), F.array()), lambda e: good_span(e["span"])),
        lambda e: F.struct(e["span"][0].alias("b"), e["span"][1].alias("e"), F.transform(hashes(F.coalesce(e["questions"], F.array())), term_hash).alias("q")),
    )
    pages = valid_pages(table(spark, sf_dir, "verb_prediction", [*PAGE, "beam.span", "beam.questions.question_string"]), spans)
    entry = pages.select("sentence_id", "verb_index", F.explode("payload").alias("s")).select("sentence_id", "verb_index", "s.b", "s.e", "s.q").filter(F.size("q") > 0)
    return entry.groupBy("sentence_id", "verb_index", "b", "e").agg(F.flatten(F.collect_list("q")).alias("items")).select("items")


def question_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every question of verb_prediction, normalised: `term`. Distinct spellings are found before normalising."""
    t = table(spark, sf_dir, "verb_prediction", ["beam.questions.question_string"])
    q = t.select(F.explode("beam.questions").alias("qs")).select(F.explode("qs.question_string").alias("q"))
    return q.distinct().select(norm_question("q").alias("term"))


def valid_args(df: DataFrame, *payload: Column) -> DataFrame:
    """arg_feature rows that count: arg_id, verb_lemma and the payload columns, computed before the shuffle."""
    rows = df.filter("arg_id IS NOT NULL").select("arg_id", "produced_at", norm_id("verb_lemma").alias("verb_lemma"), *payload)
    return latest(rows, ["arg_id"]).drop("produced_at")


def dist_entries(dist: str, key: str, norm) -> Column:
    """Usable entries of a distribution as array<struct<k: 64-bit hash, w: double>>; keys may repeat."""
    entries = F.filter(F.coalesce(F.col(dist), F.array()), lambda x: usable(x["weight"]) & x[key].isNotNull())
    return F.transform(entries, lambda x: F.struct(term_hash(norm(x[key])).alias("k"), x["weight"].alias("w")))


def checked(terms: DataFrame) -> None:
    """Fails if two of the strings in the column `term` share a hash."""
    clash = terms.groupBy(term_hash(F.col("term")).alias("h")).agg(F.min("term").alias("a"), F.max("term").alias("b")).filter("a <> b").first()
    if clash:
        raise ValueError(f"two terms share a hash: {clash.a} / {clash.b}")


#: Rows that are broadcast to find copies, at most (some 32 MB).
BROADCAST_ROWS = 1_000_000


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """`df`, a table that was written, marked for a broadcast if it has BROADCAST_ROWS rows or fewer."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def copies(df: DataFrame, values: list[str]) -> DataFrame:
    """(id, rep) of every row of `df` whose `values` another row has too; rep is the smallest id of those that are equal.
    Rows are told apart by 128 bits; two different ones with the same bits make the query fail."""
    coded = df.withColumns({"_h": F.xxhash64(*values), "_g": F.xxhash64(F.lit(1), *values)})
    same = cut(coded.groupBy("_h", "_g").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n"))
    rows = coded.join(broadcast_if_small(same), ["_h", "_g"])
    differ = [F.min(v) != F.max(v) for v in values]
    if not rows.groupBy("_h", "_g").agg(F.greatest(*[d.cast("int") for d in differ], F.lit(0)).alias("d")).filter("d > 0").isEmpty():
        raise ValueError("two different rows share a hash")
    return cut(rows.select("id", "rep"))


def dictionary(terms: DataFrame) -> DataFrame:
    """(h, term) of every distinct term but null and empty ones. Two terms with one hash make the query fail instead of
    mixing them. Null terms are left out here, after the grouping: a filter before it would be pushed below the
    distinct of the callers and make them normalise every occurrence."""
    pairs = terms.select(term_hash(F.col("term")).alias("h"), "term").groupBy("h").agg(F.min("term").alias("term"), F.max("term").alias("_other"))
    clash = F.raise_error(F.concat(F.lit("two terms share a hash: "), F.col("term"), F.lit(" / "), F.col("_other")))
    return pairs.filter("term <> ''").select("h", F.when(F.col("term") == F.col("_other"), F.col("term")).otherwise(clash).alias("term"))
