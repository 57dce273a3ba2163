"""Frequency of every distinct term, and marks for those too rare or too common.

Method: recursive radix spilling. Each task combines its own occurrences, the partial counts are spilled to the
shared folder in partitions by the leading bits of the term's hash, partitions above the row limit are split again
by further bits until all are small, and DuckDB aggregates each leaf with bounded memory, out of core where it has to.
"""

from __future__ import annotations

import shutil
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verbloom.functions.clean import norm_id
from verbloom.llm.common import dictionary, dist_entries, question_strings, span_question_records, valid_args
from verbloom.llm.cooccur import NORM_Q
from verbloom.llm.topn import NORM_ID, VALID_SPANS
from verbloom.session import cut, dropped, parallelism, table, written

#: Bits of the hash that split a partition at each level, rows that a leaf may hold, and distinct terms a task combines at once.
RADIX_BITS, LEAF_ROWS, COMBINE_TERMS = 5, 2_000_000, 1_000_000
_PARTIAL = "h bigint, occurrences bigint, records bigint"


def _combine(held: list[tuple]) -> list[tuple]:
    h, occ, rec = (np.concatenate(c) for c in zip(*held))
    order = np.argsort(h, kind="stable")
    h, occ, rec = h[order], occ[order], rec[order]
    at = np.r_[0, np.flatnonzero(np.diff(h)) + 1]
    return [(h[at], np.add.reduceat(occ, at), np.add.reduceat(rec, at))]


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and holding records of the terms of a task's records (lists of hashes, with repeats)."""
    held: list[tuple] = []
    size = 0

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c) for c in held[0]], ["h", "occurrences", "records"])

    for batch in batches:
        col = batch.column(0)
        h = col.flatten().to_numpy(zero_copy_only=False)
        if not len(h):
            continue
        rec = np.repeat(np.arange(len(col)), pa.compute.list_value_length(col).fill_null(0).to_numpy(zero_copy_only=False))
        order = np.lexsort((h, rec))
        h, rec = h[order], rec[order]
        at = np.r_[0, np.flatnonzero((np.diff(h) != 0) | (np.diff(rec) != 0)) + 1]
        held.append((h[at], np.diff(np.r_[at, len(h)]), np.ones(len(at), np.int64)))
        size += len(at)
        if size > COMBINE_TERMS:
            held = _combine(held)
            size = len(held[0][0])
            if size > COMBINE_TERMS // 2:
                yield flush()
                held, size = [], 0
    if size:
        held = _combine(held)
        yield flush()


def _aggregate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """DuckDB's sums over the leaves of one Spark partition, a leaf at a time. What doesn't fit in its memory goes to
    Spark's own scratch space of this executor, for as long as the task runs."""
    import duckdb

    scratch = tempfile.mkdtemp(prefix="leaf-", dir=SparkFiles.getRootDirectory())
    con = duckdb.connect(config={"memory_limit": "384MB", "threads": 1, "temp_directory": scratch})
    leaf, held = None, []

    def done() -> pa.Table:
        con.register("leaf_rows", pa.Table.from_batches(held))
        got = con.sql("SELECT h, sum(occurrences)::BIGINT AS occurrences, sum(records)::BIGINT AS records FROM leaf_rows GROUP BY h").arrow()
        return got.read_all() if hasattr(got, "read_all") else got

    try:
        for batch in batches:
            leaves = batch.column(0).to_numpy(zero_copy_only=False)
            cuts = np.r_[0, np.flatnonzero(np.diff(leaves)) + 1, len(leaves)]
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if b == a:
                    continue
                if leaf is not None and leaves[a] != leaf:
                    yield from done().to_batches()
                    held = []
                leaf = leaves[a]
                held.append(batch.slice(a, b - a).select(["h", "occurrences", "records"]))
        if held:
            yield from done().to_batches()
    finally:
        con.close()
        shutil.rmtree(scratch, ignore_errors=True)


def _bits(level: int):
    """The hash bits of a level, from the top."""
    return F.shiftrightunsigned("h", 64 - RADIX_BITS * (level + 1)).bitwiseAND(2**RADIX_BITS - 1).cast("int")


def _spilled(rows: DataFrame, *by: str) -> tuple[DataFrame, str]:
    """Partial counts as a table partitioned `by` hash bits. They are brought together before, spread by further bits, so
    that a level writes about as many files as there are tasks."""
    n = parallelism(rows.sparkSession)
    return written(rows.repartition(n, *by, F.pmod("h", F.lit(max(1, n >> RADIX_BITS)))), *by)


def frequencies(records: DataFrame, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """(h, occurrences, records) of every term hash in the arrays `items` of `records`.

    Repeats within a record are occurrences, the record counts once. Null records, empty records and null items count
    for nothing; empty input gives an empty result. Other columns of `records` are ignored. The spilled tables are
    removed once the result is written.
    """
    lists = records.select(F.array_compact("items").alias("items"))
    spilled, path = _spilled(lists.mapInArrow(_partial, _PARTIAL).withColumn("b0", _bits(0)), "b0")
    leaves, paths, level, pending = [], [path], 0, spilled.withColumn("leaf", F.col("b0").cast("bigint"))
    while True:  # ends: a level splits by 5 of 64 bits, and rows of one hash are at most one or two a task
        sizes = {r.leaf: r["count"] for r in pending.groupBy("leaf").count().collect()}  # 2^5 rows for each split partition
        big = [k for k, n in sizes.items() if n > leaf_rows] if RADIX_BITS * (level + 2) <= 60 else []
        leaves.append(pending.filter(~F.col("leaf").isin(big)) if big else pending)
        if not big:
            break
        level += 1
        split = pending.filter(F.col("leaf").isin(big)).select("h", "occurrences", "records", F.col("leaf").alias("up"), _bits(level).alias(f"b{level}"))
        part, path = _spilled(split, "up", f"b{level}")
        paths.append(path)
        pending = part.withColumn("leaf", (F.col("up") * 2**RADIX_BITS + F.col(f"b{level}")).cast("bigint"))
    columns = ["leaf", "h", "occurrences", "records"]
    rows = None
    for at, x in enumerate(leaves):
        own = x.select((F.col("leaf") * 16 + at).cast("bigint").alias("leaf"), *columns[1:])
        rows = own if rows is None else rows.unionByName(own)
    out = cut(rows.repartition("leaf").sortWithinPartitions("leaf").mapInArrow(_aggregate, _PARTIAL))
    for path in paths:
        dropped(records.sparkSession, path)
    return out


def marked(freq: DataFrame, n_records: int, rare_under: int = 3, common_over: int = 10) -> DataFrame:
    """`freq` with `mark`: rare below `rare_under` records, common in more than 1/`common_over` of all records, else null."""
    return freq.withColumn("mark", F.when(F.col("records") < rare_under, "rare").when(F.col("records") * common_over > n_records, "common"))


def item_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per valid argument: `items`, hashes of the items of arg_mlm_dist that have a usable weight."""
    args = valid_args(table(spark, sf_dir, "arg_feature"), F.transform(dist_entries("arg_mlm_dist", "item", norm_id), lambda x: x["k"]).alias("items"))
    return args.select("items").filter(F.size("items") > 0)


def item_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item of arg_mlm_dist, normalised: `term`."""
    return table(spark, sf_dir, "arg_feature").select(F.explode("arg_mlm_dist.item").alias("i")).distinct().select(norm_id("i").alias("term"))


def _field(name: str, records: DataFrame, terms: DataFrame) -> DataFrame:
    records = cut(records)
    freq = marked(frequencies(records), records.count())
    return freq.join(dictionary(terms), "h").select(F.lit(name).alias("field"), "term", "occurrences", "records", "mark")


def p3_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every question and item with occurrences, holding records and mark."""
    q = _field("questions", span_question_records(spark, sf_dir), question_strings(spark, sf_dir))
    return q.unionByName(_field("arg_mlm_dist", item_records(spark, sf_dir), item_strings(spark, sf_dir)))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_terms(spark, sf_dir).filter("mark IS NOT NULL").select("field", "term", "mark")


QUERIES = {"p3_found": p3_found, "p3_terms": p3_terms}

VALID_ARGS = """
    arg AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY arg_id ORDER BY produced_at DESC NULLS LAST) AS _n FROM arg_feature WHERE arg_id IS NOT NULL) WHERE _n = 1)"""
_TERMS = f"""
    WITH {VALID_SPANS}, {VALID_ARGS},
    item AS (
      SELECT 'questions' AS field, sid || '|' || verb_index || '|' || b || '|' || e AS rec, t AS term FROM (
        SELECT sid, verb_index, b, e, {NORM_Q.format(c='u.question_string')} AS t FROM (SELECT *, unnest(q) AS u FROM entry)) WHERE t <> ''
      UNION ALL
      SELECT 'arg_mlm_dist', arg_id::VARCHAR, {NORM_ID.format(c='u.item')} FROM (SELECT arg_id, unnest(arg_mlm_dist) AS u FROM arg)
      WHERE u.item IS NOT NULL AND u.weight > 0 AND isfinite(u.weight)),
    size AS (SELECT field, count(DISTINCT rec) AS n FROM item GROUP BY field),
    freq AS (SELECT field, term, count(*) AS occurrences, count(DISTINCT rec) AS records FROM item GROUP BY field, term)
    SELECT field, term, occurrences, records, CASE WHEN records < 3 THEN 'rare' WHEN records * 10 > n THEN 'common' END AS mark FROM freq JOIN size USING (field)"""
SQL = {"p3_terms": _TERMS, "p3_found": f"SELECT field, term, mark FROM ({_TERMS}) WHERE mark IS NOT NULL"}
