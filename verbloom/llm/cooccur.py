"""Pairs of items that occur together more often than their single frequencies allow.

Method: external sort of packed 64-bit pair codes. Items that can be in no result get pruned exactly, the others
get dense 32-bit ids; a task packs the pairs of its records into 64-bit codes, sorts them in numpy and hands on
run-length counted runs; Spark's external sort (sorted runs spilled to disk, merged many ways) brings equal codes
together, and a second streaming pass sums the runs. Odds ratios with continuity correction come last.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verbloom.functions.clean import norm_id, norm_label
from verbloom.llm.common import dictionary, question_strings, span_question_records, term_hash
from verbloom.llm.topn import NORM_ID, VALID_SPANS
from verbloom.session import cut, parallelism, table

#: Pair codes that a task sorts at once (16 MB), and the most dictionary entries that are broadcast (32 MB).
RUN_CODES, BROADCAST_TERMS = 2_000_000, 2_000_000
#: Records with more items are cut into blocks of so many, which meet in pairs in tasks of their own.
LONG, PART = 4_096, 1_024
_RUN = pa.schema([("code", pa.int64()), ("n", pa.int64())])


def _pairs(ids: np.ndarray, lengths: np.ndarray) -> Iterator[np.ndarray]:
    """Codes of all pairs within records; ids are sorted within each record. In pieces of about RUN_CODES."""
    starts = np.r_[0, np.cumsum(lengths)[:-1]]
    for n in np.unique(lengths[lengths > 1]).tolist():
        rows = starts[lengths == n]
        step = max(1, RUN_CODES // (n * (n - 1) // 2))
        for at in range(0, len(rows), step):
            block = ids[rows[at : at + step, None] + np.arange(n)]
            for k in range(1, n):  # by distance, so that a very long record never makes n * n numbers at once
                yield ((block[:, :-k] << 32) | block[:, k:]).ravel()


def _runs(codes: list[np.ndarray]) -> pa.RecordBatch:
    code, n = np.unique(np.concatenate(codes), return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(code), pa.array(n)], schema=_RUN)


def _ids(col) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column and the lengths of its rows; null counts as empty."""
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.int64), pa.compute.list_value_length(col).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def _sorted_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted, run-length counted runs of pair codes: of the distinct ids in the first list of each row with each other, or,
    where the row has a second list that isn't empty, whose ids are all larger, with those."""
    held: list[np.ndarray] = []
    size = 0

    def codes(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        second = _ids(batch.column(1))[1] > 0 if batch.num_columns > 1 else np.zeros(batch.num_rows, bool)
        if not second.all():
            ids, lengths = _ids(batch.column(0).filter(pa.array(~second)) if second.any() else batch.column(0))
            yield from _pairs(ids[np.lexsort((ids, np.repeat(np.arange(len(lengths)), lengths)))], lengths)
        for r in np.flatnonzero(second).tolist():
            a, b = (_ids(batch.column(x).slice(r, 1))[0] for x in (0, 1))
            yield ((a[:, None] << 32) | b[None, :]).ravel()

    for batch in batches:
        for got in codes(batch):
            held.append(got)
            size += len(got)
            if size >= RUN_CODES:
                yield _runs(held)
                held, size = [], 0
    if size:
        yield _runs(held)


def _mapped(terms: np.ndarray):
    """Maps the item hashes of both lists to dense ids (positions in sorted `terms`), dropping all others, before
    _sorted_runs."""

    def column(col) -> pa.ListArray:
        items, lengths = _ids(col)
        at = np.searchsorted(terms, items)
        keep = terms[np.minimum(at, len(terms) - 1)] == items if len(terms) else np.zeros(len(items), bool)
        rec = np.repeat(np.arange(len(lengths)), lengths)[keep]
        offsets = np.r_[0, np.cumsum(np.bincount(rec, minlength=len(lengths)))].astype(np.int32)
        return pa.ListArray.from_arrays(offsets, pa.array(at[keep].astype(np.int64)))

    def mapped(b: pa.RecordBatch) -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([column(c) for c in b.columns], ["ids", "more"][: b.num_columns])
        if b.num_columns == 1:
            return out
        lost = (_ids(b.column(1))[1] > 0) & (_ids(out.column(1))[1] == 0)  # a second list of which nothing is left: no pairs
        return out.filter(pa.array(~lost)) if lost.any() else out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _sorted_runs(map(mapped, batches))

    return run


def _in_parts(lists: DataFrame, column: str, longest: int) -> DataFrame:
    """(column, more): records as they are, with an empty second list; those longer than LONG as all pairs of their sorted
    parts, spread over tasks, so that no task lists the pairs of a whole long record. No second column if none is long."""
    none = F.array().cast("array<bigint>")
    if longest <= LONG:
        return lists.select(column)
    short = lists.filter(F.size(column) <= LONG).select(column, none.alias("more"))
    long = lists.filter(F.size(column) > LONG).select(F.sort_array(column).alias("all")).withColumn("n", F.ceil(F.size("all") / PART).cast("int"))
    first = long.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    pair = first.withColumn("j", F.explode(F.sequence(F.col("i"), F.col("n") - 1)))
    part = lambda k: F.slice("all", F.col(k) * PART + 1, F.lit(PART))
    rows = pair.select(part("i").alias(column), F.when(F.col("j") > F.col("i"), part("j")).otherwise(none).alias("more"), F.xxhash64("i", "j").alias("_at"))
    return short.unionByName(rows.repartition(parallelism(lists.sparkSession), "_at", F.xxhash64(F.get(column, F.lit(0)))).drop("_at"))


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums the counts of equal neighbouring codes of one sorted partition."""
    code_held, n_held = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        code, n = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        at = np.r_[0, np.flatnonzero(np.diff(code)) + 1]
        sums, codes = np.add.reduceat(n, at), code[at]
        if code_held is not None:
            if codes[0] == code_held:
                sums[0] += n_held
            else:
                codes, sums = np.r_[code_held, codes], np.r_[n_held, sums]
        code_held, n_held = codes[-1], sums[-1]
        if len(codes) > 1:
            yield pa.RecordBatch.from_arrays([pa.array(codes[:-1]), pa.array(sums[:-1])], schema=_RUN)
    if code_held is not None:
        yield pa.RecordBatch.from_arrays([pa.array([code_held]), pa.array([n_held])], schema=_RUN)


def together(records: DataFrame, min_count: int = 1, min_share: int = 0) -> DataFrame:
    """(h_a, h_b, n_ab, n_a, n_b, n, odds_ratio, lift) of every pair of items that at least `min_count` records and,
    if `min_share` > 0, at least 1/`min_share` of all records hold together; h_a < h_b are item hashes.

    `records` has one row per record with `items`, an array of 64-bit item hashes. Repeated items of a record count
    once; null or empty records count for nothing, so do null items. Pruning is exact: an item held by fewer records
    than a pair needs can be in no such pair.
    """
    spark = records.sparkSession
    rec = cut(records.select(F.array_compact(F.array_distinct("items")).alias("items")).filter(F.size("items") > 0))
    n, longest = rec.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("items")), F.lit(0))).first()
    least = max(min_count, 1, -(-n // min_share) if min_share else 1)
    single = cut(rec.select(F.explode("items").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n_item")).filter(F.col("n_item") >= least))
    if single.count() <= BROADCAST_TERMS:
        terms = np.sort(single.select("h").toArrow().column(0).to_numpy())  # BROADCAST_TERMS numbers at most
        runs = _in_parts(rec, "items", longest).mapInArrow(_mapped(terms), "code bigint, n bigint")
        ids = spark.createDataFrame(pa.table({"id": np.arange(len(terms)), "h": terms})) if len(terms) else spark.createDataFrame([], "id bigint, h bigint")
    else:  # too many for a broadcast: ids by a range sort, records mapped by a join
        part = single.repartitionByRange(parallelism(spark), "h").sortWithinPartitions("h").withColumn("p", F.spark_partition_id()).withColumn("k", F.monotonically_increasing_id() - F.shiftleft(F.col("p").cast("bigint"), 33))
        part = cut(part)
        sizes = part.groupBy("p").count()
        base = sizes.withColumn("base", F.sum("count").over(Window.orderBy("p")) - F.col("count")).select("p", "base")
        ids = cut(part.join(F.broadcast(base), "p").select((F.col("base") + F.col("k")).alias("id"), "h"))
        entry = rec.withColumn("r", F.monotonically_increasing_id()).select("r", F.explode("items").alias("h")).join(ids, "h")
        runs = _in_parts(entry.groupBy("r").agg(F.collect_list("id").alias("ids")).select("ids"), "ids", longest).mapInArrow(_sorted_runs, "code bigint, n bigint")
    merged = runs.repartition(parallelism(spark), "code").sortWithinPartitions("code").mapInArrow(_merged, "code bigint, n bigint")
    pairs = merged.filter(F.col("n") >= least).select(F.shiftright("code", 32).alias("id_a"), F.col("code").bitwiseAND(0xFFFFFFFF).alias("id_b"), F.col("n").alias("n_ab"))
    side = lambda x: ids.join(single, "h").select(F.col("id").alias(f"id_{x}"), F.col("h").alias(f"h_{x}"), F.col("n_item").alias(f"n_{x}"))
    both = pairs.join(side("a"), "id_a").join(side("b"), "id_b").withColumn("n", F.lit(n).cast("bigint"))
    return both.withColumns({"odds_ratio": odds_ratio(), "lift": F.col("n_ab") * F.col("n") / (F.col("n_a") * F.col("n_b"))}).drop("id_a", "id_b")


def odds_ratio() -> Column:
    """Odds ratio of the two-by-two table of a pair, with 1/2 added to each cell."""
    c = F.col
    cell = lambda x: x + 0.5
    return cell(c("n_ab")) * cell(c("n") - c("n_a") - c("n_b") + c("n_ab")) / (cell(c("n_a") - c("n_ab")) * cell(c("n_b") - c("n_ab")))


def role_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (sentence_id, verb_index) of prop_bank_role with at least one label: `items`, hashes of its labels."""
    rows = table(spark, sf_dir, "prop_bank_role").select(norm_id("sentence_id").alias("s"), "verb_index", norm_label("role_label").alias("l"))
    rows = rows.filter("s IS NOT NULL AND verb_index IS NOT NULL AND l IS NOT NULL AND l <> ''")
    return rows.groupBy("s", "verb_index").agg(F.collect_set(term_hash(F.col("l"))).alias("items")).select("items")


def role_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every role label, normalised: `term`."""
    return table(spark, sf_dir, "prop_bank_role").select("role_label").distinct().select(norm_label("role_label").alias("term"))


def _named(pairs: DataFrame, terms: DataFrame, kind: str) -> DataFrame:
    """Strings for hashes; the first of a pair is the smaller string."""
    d = dictionary(terms)
    both = pairs.join(d.select(F.col("h").alias("h_a"), F.col("term").alias("a")), "h_a").join(d.select(F.col("h").alias("h_b"), F.col("term").alias("b")), "h_b")
    turn = F.col("a") > F.col("b")
    pick = lambda x, y: F.when(turn, F.col(y)).otherwise(F.col(x))
    return both.select(F.lit(kind).alias("kind"), F.least("a", "b").alias("item_a"), F.greatest("a", "b").alias("item_b"), "n_ab", pick("n_a", "n_b").alias("n_a"), pick("n_b", "n_a").alias("n_b"), "n", F.round("odds_ratio", 4).alias("odds_ratio"))


def p2_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of questions and of roles that count, with their frequencies and corrected odds ratio."""
    counts = F.col("n_ab") * F.col("n") >= 4 * F.col("n_a") * F.col("n_b")
    q = together(span_question_records(spark, sf_dir), 5, 1000).filter(counts)
    r = together(role_records(spark, sf_dir), 5, 1000).filter(counts)
    return _named(q, question_strings(spark, sf_dir), "question").unionByName(_named(r, role_strings(spark, sf_dir), "role"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_pairs(spark, sf_dir).select("kind", "item_a", "item_b")


QUERIES = {"p2_found": p2_found, "p2_pairs": p2_pairs}

NORM_Q = "ltrim(rtrim(regexp_replace(lower({c}), '[\\s' || chr(160) || ']+', ' ', 'g'), '? '))"
_NORM_L = "upper(trim({c}, chr(32) || chr(9) || chr(10) || chr(13) || chr(11) || chr(12) || chr(160)))"
_PAIRS = f"""
    WITH {VALID_SPANS},
    item AS (
      SELECT DISTINCT 'question' AS kind, sid || '|' || verb_index || '|' || b || '|' || e AS rec, t FROM (
        SELECT sid, verb_index, b, e, {NORM_Q.format(c='u.question_string')} AS t FROM (SELECT *, unnest(q) AS u FROM entry)) WHERE t <> ''
      UNION ALL
      SELECT DISTINCT 'role', sid || '|' || verb_index, t FROM (
        SELECT {NORM_ID.format(c='sentence_id')} AS sid, verb_index, {_NORM_L.format(c='role_label')} AS t FROM prop_bank_role) WHERE t <> '' AND sid IS NOT NULL AND verb_index IS NOT NULL),
    size AS (SELECT kind, count(DISTINCT rec) AS n FROM item GROUP BY kind),
    single AS (SELECT kind, t, count(*) AS k FROM item GROUP BY kind, t),
    pair AS (SELECT x.kind, x.t AS item_a, y.t AS item_b, count(*) AS n_ab FROM item x JOIN item y ON x.kind = y.kind AND x.rec = y.rec AND x.t < y.t GROUP BY ALL)
    SELECT pair.kind, item_a, item_b {{cols}} FROM pair JOIN size USING (kind)
    JOIN single a ON a.kind = pair.kind AND a.t = item_a JOIN single b ON b.kind = pair.kind AND b.t = item_b
    WHERE n_ab >= 5 AND 1000 * n_ab >= n AND n_ab * n >= 4 * a.k * b.k"""
SQL = {
    "p2_found": _PAIRS.format(cols=""),
    "p2_pairs": _PAIRS.format(cols=", n_ab, a.k AS n_a, b.k AS n_b, n, round((n_ab + 0.5::DOUBLE) * (n - a.k - b.k + n_ab + 0.5::DOUBLE) / ((a.k - n_ab + 0.5::DOUBLE) * (b.k - n_ab + 0.5::DOUBLE)), 4) AS odds_ratio"),
}
