"""Per-key results when a few keys hold most rows.

Rows are range partitioned by (key, order, row number) with quantiles that Spark samples, so a heavy key is cut
at its own quantiles and spread over as many partitions as its rows fill. Each partition, sorted, is folded to one
partial state per key, and the states of a key that crosses partition borders are stitched in partition order.
No task ever holds more than its share of rows, whatever the keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verbloom.session import parallelism

_STATE = "key string, part int, n bigint, first_us bigint, last_us bigint, gap_us bigint"


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial states of the runs of equal keys of one sorted partition; a run may cross batches."""
    part = TaskContext.get().partitionId()
    held: list | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys, us = batch.column(0), batch.column(1)
        t = us.fill_null(-(2**62)).to_numpy(zero_copy_only=False)
        codes = keys.dictionary_encode()
        ids = codes.indices.to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(np.diff(ids)) + 1
        starts, ends = np.r_[0, cuts], np.r_[cuts, len(ids)]
        known = t > -(2**62)
        gaps = np.where(known[1:] & known[:-1], np.diff(t), -1)
        out = []
        for a, b in zip(starts.tolist(), ends.tolist()):
            times = t[a:b][known[a:b]]
            first, last = (int(times[0]), int(times[-1])) if len(times) else (None, None)
            gap = int(gaps[a : b - 1].max()) if b - a > 1 else -1
            state = [codes.dictionary[int(ids[a])].as_py(), part, b - a, first, last, gap if gap >= 0 else None]
            if held is not None and held[0] == state[0]:
                held = _join(held, state)
            else:
                if held is not None:
                    out.append(held)
                held = state
        if out:
            yield _batch(out)
    if held is not None:
        yield _batch([held])


def _join(a: list, b: list) -> list:
    """Two neighbouring states of one key."""
    gaps = [x for x in (a[5], b[5], b[3] - a[4] if a[4] is not None and b[3] is not None else None) if x is not None]
    return [a[0], a[1], a[2] + b[2], b[3] if a[3] is None else a[3], a[4] if b[4] is None else b[4], max(gaps, default=None)]


def _batch(states: list[list]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
    names = ("key", "part", "n", "first_us", "last_us", "gap_us")
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*states), kinds)], list(names))


def balanced_by_key(df: DataFrame, key: Column, order: Column, parts: int | None = None) -> DataFrame:
    """Per key: rows, first and last `order` (a timestamp), the longest gap between neighbours in that order, and
    the number of partitions over which the key was spread.

    Rows with a null key have no result; a null order counts as a row and is in no gap. Repeated rows count as often
    as they occur, ties in order are cut anywhere. An empty input gives an empty result.
    """
    n = parts or parallelism(df.sparkSession)
    rows = df.select(key.alias("key"), F.unix_micros(order.cast("timestamp")).alias("us")).filter(F.col("key").isNotNull()).withColumn("_row", F.monotonically_increasing_id())
    states = rows.repartitionByRange(n, "key", "us", "_row").sortWithinPartitions("key", "us", "_row").select("key", "us").mapInArrow(_fold, _STATE)
    ordered = F.sort_array(F.collect_list(F.struct("part", "n", "first_us", "last_us", "gap_us")))
    s = states.groupBy("key").agg(ordered.alias("s"))
    between = F.zip_with(F.slice("s", 2, F.greatest(F.size("s") - 1, F.lit(0))), F.slice("s", 1, F.greatest(F.size("s") - 1, F.lit(0))), lambda b, a: b.first_us - a.last_us)
    gap = F.greatest(F.array_max(F.transform("s", lambda x: x.gap_us)), F.array_max(between))
    return s.select(
        "key",
        F.aggregate("s", F.lit(0).cast("bigint"), lambda acc, x: acc + x.n).alias("n_rows"),
        F.timestamp_micros(F.array_min(F.transform("s", lambda x: x.first_us))).cast("timestamp_ntz").alias("first_at"),
        F.timestamp_micros(F.array_max(F.transform("s", lambda x: x.last_us))).cast("timestamp_ntz").alias("last_at"),
        gap.alias("max_gap_us"),
        F.size("s").cast("bigint").alias("n_parts"),
    )


def hot_keys(per_key: DataFrame, counted: DataFrame, share: int = 50) -> DataFrame:
    """The keys of a per-key result that hold at least 1/`share` of the rows of `counted` (those with a key)."""
    total = counted.agg(F.count(F.lit(1))).scalar()
    return per_key.filter(F.col("n_rows") * share >= total).select("key", "n_rows")
