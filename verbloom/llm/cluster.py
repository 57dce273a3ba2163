"""Clusters of mutually similar records, with their sizes and most typical members.

Method: parallel pivot correlation clustering. The neighbours of each record come from an exact prefix-filtered join. In
rounds, every unassigned record whose hash is the smallest among its unassigned neighbours becomes a pivot and absorbs
its similar neighbours; then members move to their closest pivot, and medoids are computed, which name the clusters.
Records equal in both distributions are one node.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verbloom.functions.clean import norm_id, norm_question
from verbloom.llm.common import broadcast_if_small, checked, copies, dist_entries, valid_args
from verbloom.llm.cooccur import NORM_Q
from verbloom.llm.termfreq import VALID_ARGS, item_strings
from verbloom.llm.topn import NORM_ID
from verbloom.session import cut, parallelism, table

#: Keys whose frequency orders prefixes (all others count as rarer); nodes of a key that is refined by the second
#: distribution; nodes of a block of a refined key; pairs that are compared at once; edges that one task finishes.
FREQUENT, REFINED, BLOCK, PIECE, FINISHED = 10_000, 512, 8_192, 100_000, 1_000_000
_LISTS = ["qk", "qs", "mk", "ms"]
_LIST_TYPES = "qk array<bigint>, qs array<double>, mk array<bigint>, ms array<double>"
_EPS = 1e-9


def _flat(col) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column and the offsets of its rows."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    n = pa.compute.list_value_length(col).fill_null(0).to_numpy(zero_copy_only=False)
    return col.flatten().to_numpy(zero_copy_only=False), np.r_[0, np.cumsum(n)].astype(np.int64)


def _row_of(offsets: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def _shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shares by key of both distributions, keys sorted; records without a usable entry in one of them are left out."""
    for b in batches:
        out, has = [], b.column(1).is_valid().to_numpy(zero_copy_only=False)
        for x in (2, 3):
            col = b.column(x)
            n = pa.compute.list_value_length(col).fill_null(0).to_numpy(zero_copy_only=False)
            row, entry = np.repeat(np.arange(len(col)), n), col.flatten()
            k, w = (entry.field(f).to_numpy(zero_copy_only=False) for f in (0, 1))
            o = np.lexsort((k, row))
            row, k, w = row[o], k[o], w[o]
            at = np.flatnonzero(np.r_[True, (np.diff(row) != 0) | (np.diff(k) != 0)]) if len(row) else np.zeros(0, np.int64)
            row, k, w = row[at], k[at], np.add.reduceat(w, at) if len(at) else w
            out.append((row, k, w / np.bincount(row, w, len(col))[row] if len(row) else w))
            has = has & (n > 0)
        keep = np.flatnonzero(has)
        arrays = [b.column(0).take(pa.array(keep)), b.column(1).take(pa.array(keep))]
        for row, k, s in out:
            kept = has[row]
            offsets = pa.array(np.r_[0, np.cumsum(np.bincount(row, minlength=len(has))[keep])].astype(np.int32))
            arrays += [pa.ListArray.from_arrays(offsets, pa.array(k[kept])), pa.ListArray.from_arrays(offsets, pa.array(s[kept]))]
        yield pa.RecordBatch.from_arrays(arrays, ["id", "part", *_LISTS])


def _rank(keys: np.ndarray, frequent: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Place of each key in the order of prefixes: -1 for all keys that aren't frequent."""
    known, rank = frequent
    if not len(known):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return np.where(known[at] == keys, rank[at], -1)


def _ordered(b: pa.RecordBatch, keys: str, shares: str, frequent, least: float) -> tuple[pa.ListArray, pa.ListArray, np.ndarray, np.ndarray]:
    """Keys and shares of the rows with the rarest first, and row and key of the entries of their prefixes: those up to
    where the rest can't reach `least` any more. Two records whose overlap is at least `least` have their first common
    key in this order in both prefixes."""
    k, offsets = _flat(b.column(b.schema.get_field_index(keys)))
    s, _ = _flat(b.column(b.schema.get_field_index(shares)))
    row = _row_of(offsets)
    o = np.lexsort((k, _rank(k, frequent), row))
    k, s = k[o], s[o]
    before = np.r_[0.0, np.cumsum(s)]
    rest = 1.0 - (before[:-1] - before[offsets[:-1]][row])
    inside = rest >= least - 1e-7  # a little more than needed, for the rounding of long sums
    at = pa.array(offsets.astype(np.int32))
    return pa.ListArray.from_arrays(at, pa.array(k)), pa.ListArray.from_arrays(at, pa.array(s)), row[inside], k[inside]


def _keyed(ranks, least: float, deep: bool):
    """A row (q, m, id, ph, lists) per prefix key of a node: of the first distribution (m is 0), or (deep) per prefix key
    of the second beside the key `q` that a row has. Lists are in the order of prefixes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            rq, rm = ranks.value
            qk, qs, q_row, q_key = _ordered(b, "qk", "qs", rq, least)
            mk, ms, m_row, m_key = _ordered(b, "mk", "ms", rm, least)
            row = m_row if deep else q_row
            q = b.column(b.schema.get_field_index("q")).to_numpy(zero_copy_only=False)[m_row] if deep else q_key
            m = m_key if deep else np.zeros(len(row), np.int64)
            take = pa.array(row)
            named = [b.column(b.schema.get_field_index(c)).take(take) for c in ("id", "ph")]
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(m), *named, *(x.take(take) for x in (qk, qs, mk, ms))], ["q", "m", "id", "ph", *_LISTS])

    return run


class _Side:
    """The lists of one distribution of a table, for looking up shares."""

    def __init__(self, keys, shares):
        self.key, self.offsets = _flat(keys)
        self.share, _ = _flat(shares)
        self.names, self.code = np.unique(self.key, return_inverse=True)
        code = _row_of(self.offsets) * len(self.names) + self.code
        self.by = np.argsort(code)
        self.codes = code[self.by]

    def overlap(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Overlaps of rows i with rows j, and their first common key (0 if there is none)."""
        n = np.diff(self.offsets)[i]
        ends = np.cumsum(n)
        pair = np.repeat(np.arange(len(i)), n)
        e = np.repeat(self.offsets[i] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)
        want = j[pair] * len(self.names) + self.code[e]
        at = np.minimum(np.searchsorted(self.codes, want), len(self.codes) - 1)
        hit = self.codes[at] == want
        pair, e, other = pair[hit], e[hit], self.by[at[hit]]
        total = np.bincount(pair, np.minimum(self.share[e], self.share[other]), len(i))
        first = np.zeros(len(i), np.int64)
        head = np.flatnonzero(np.r_[True, np.diff(pair) != 0]) if len(pair) else np.zeros(0, np.int64)
        first[pair[head]] = self.key[e[head]]
        return total, first


def _pairs(group: np.ndarray, side: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of all pairs of rows of one group, in pieces; `group` is sorted. Where a group has two sides, pairs of one
    of each side only."""
    end = np.searchsorted(group, group, side="right")
    two = np.maximum.reduceat(side, np.flatnonzero(np.r_[True, np.diff(group) != 0]))[np.cumsum(np.r_[0, np.diff(group) != 0])] > 0
    held, size, left, d = [], 0, np.arange(len(group)), 0
    while len(left):
        d += 1
        left = left[left + d < end[left]]
        right = left + d
        ok = ~two[left] | (side[left] != side[right])
        held.append((left[ok], right[ok]))
        size += len(held[-1][0])
        if size >= PIECE:
            yield tuple(np.concatenate(x) for x in zip(*held))
            held, size = [], 0
    if size:
        yield tuple(np.concatenate(x) for x in zip(*held))


def _compare(least: float):
    """Similar pairs of the rows of each group, each reported by its first common keys only; rows come sorted by group
    (hash `g`, then ph, q, m) and side."""

    def pairs(t: pa.Table) -> Iterator[pa.RecordBatch]:
        ids, ph, q, m, side, g = (t.column(c).to_numpy() for c in ("id", "ph", "q", "m", "side", "g"))
        new = np.r_[0, (np.diff(g) != 0) | (np.diff(ph) != 0) | (np.diff(q) != 0) | (np.diff(m) != 0)]
        Q = M = None
        for i, j in _pairs(np.cumsum(new), side):
            Q, M = Q or _Side(t.column("qk"), t.column("qs")), M or _Side(t.column("mk"), t.column("ms"))
            for at in range(0, len(i), PIECE):
                a, b = i[at : at + PIECE], j[at : at + PIECE]
                x, first = Q.overlap(a, b)
                ok = (x >= least - _EPS) & (first == q[a])
                a, b, x = a[ok], b[ok], x[ok]
                y, first = M.overlap(a, b)
                ok = (y >= least - _EPS) & ((m[a] == 0) | (first == m[a]))
                a, b, x, y = ids[a[ok]], ids[b[ok]], x[ok], y[ok]
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(v) for v in (np.minimum(a, b), np.maximum(a, b), x, y)], ["a", "b", "q_overlap", "m_overlap"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:  # whole groups, many at a time
            if not b.num_rows:
                continue
            g = b.column(b.schema.get_field_index("g")).to_numpy(zero_copy_only=False)
            last = int(np.flatnonzero(np.r_[True, np.diff(g) != 0])[-1])  # the last group may go on in the next batch
            same = held and held[-1].column(held[-1].schema.get_field_index("g"))[-1].as_py() == g[0]
            if last or not same:
                held.append(b.slice(0, last))
                size += last
                if size >= 20_000:
                    yield from pairs(pa.Table.from_batches(held))
                    held, size = [], 0
                elif not last and held:  # the group before has ended
                    held.pop()
            held.append(b.slice(last))
            size += b.num_rows - last
        if held:
            yield from pairs(pa.Table.from_batches(held))

    return run


def _frequent(nodes: DataFrame, column: str) -> tuple[np.ndarray, np.ndarray]:
    """The FREQUENT most frequent keys, sorted, and their ranks; the rarer of them first."""
    top = nodes.select(F.explode(column).alias("k")).groupBy("k").count().orderBy(F.col("count").desc(), "k").limit(FREQUENT)
    keys = np.array([r.k for r in top.collect()], np.int64)  # FREQUENT rows at most
    order = np.argsort(keys)
    return keys[order], (FREQUENT - np.arange(len(keys)))[order]


def similar_pairs(nodes: DataFrame, least: float = 0.5) -> DataFrame:
    """(a, b, q_overlap, m_overlap), a < b, of all nodes (id, ph, lists) of the same part hash `ph` whose overlaps are
    both at least `least`.

    Exact. Nodes meet on (part, prefix key of the first distribution); keys with more than REFINED nodes are refined by
    the prefix keys of the second, and refined groups with more than BLOCK nodes are cut into blocks that meet in pairs.
    """
    spark = nodes.sparkSession
    ranks = spark.sparkContext.broadcast((_frequent(nodes, "qk"), _frequent(nodes, "mk")))
    shape = "q bigint, m bigint, id bigint, ph bigint, " + _LIST_TYPES
    columns = ["side", "q", "m", "id", "ph", *_LISTS]
    keyed = nodes.mapInArrow(_keyed(ranks, least, False), shape)
    heavy = cut(keyed.groupBy("ph", "q").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > REFINED).drop("n"))
    light, hint = keyed, None
    if not heavy.isEmpty():
        hint = broadcast_if_small(heavy)
        light = keyed.join(hint, ["ph", "q"], "left_anti")
    groups = light.withColumns({"g": F.xxhash64("ph", "q"), "side": F.lit(0)}).select("g", *columns)
    if hint is not None:
        deep_key = ["ph", "q", "m"]
        deep = cut(keyed.join(hint, ["ph", "q"], "left_semi").drop("m").mapInArrow(_keyed(ranks, least, True), shape))
        large = cut(deep.groupBy(*deep_key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > BLOCK))
        sized = deep.join(broadcast_if_small(large), deep_key, "left").withColumn("blocks", F.coalesce(F.ceil(F.col("n") / BLOCK), F.lit(1)).cast("bigint"))
        # row of block x: left of (x, y) for y >= x, right of (y, x) for y < x
        sized = sized.withColumn("x", F.pmod(F.xxhash64("id"), F.col("blocks"))).withColumn("y", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
        group = F.xxhash64(*deep_key, F.least("x", "y"), F.greatest("x", "y"))
        groups = groups.unionByName(sized.withColumns({"g": group, "side": F.when(F.col("y") >= F.col("x"), 0).otherwise(1)}).select("g", *columns))
    together = groups.repartition(parallelism(spark), "g").sortWithinPartitions("g", "ph", "q", "m", "side")
    return together.mapInArrow(_compare(least), "a bigint, b bigint, q_overlap double, m_overlap double")


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pivots of what is left, in order of hash: what further rounds would find."""
    near: dict[int, list[int]] = {}
    order = {}
    for b in batches:
        for i, o, h in zip(*(b.column(c).to_pylist() for c in range(3))):
            near.setdefault(i, []).append(o)
            order[i] = h
    done, pivots = set(), []
    for i in sorted(near, key=lambda x: (order[x], x)):
        if i not in done:
            pivots.append(i)
            done.update(near[i])
    yield pa.RecordBatch.from_arrays([pa.array(pivots, pa.int64())], ["id"])


def _pivots(both: DataFrame) -> DataFrame:
    """Records that no neighbour of a smaller hash keeps from being a pivot, found in rounds. Each round assigns the
    smallest hash of all at least, so the rounds end; the last FINISHED edges are worked off by one task."""
    order = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("id"))
    left, found = both.select("id", "other"), None
    while True:
        if left.count() <= FINISHED:
            rest = left.withColumn("h", F.xxhash64("id")).coalesce(1).mapInArrow(_finish, "id bigint")
            return cut(rest if found is None else found.unionByName(rest))
        lowest = left.groupBy("id").agg(F.min(order("other")).alias("low"))
        pivots = cut(lowest.filter(order("id") < F.col("low")).select("id"))
        found = pivots if found is None else found.unionByName(pivots)
        done = cut(left.join(pivots.withColumnRenamed("id", "other"), "other", "left_semi").select("id").unionByName(pivots).distinct())
        open_ = left.join(done, "id", "left_anti")
        left = cut(open_.join(done.withColumnRenamed("id", "other"), "other", "left_anti"))
        found = found.unionByName(open_.select("id").distinct().join(left.select("id"), "id", "left_anti"))  # all their neighbours are taken


def pivot_clusters(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of edges (a, b, s), a < b: the members (id, cluster, similarity) and the edges (a, b, cluster_a, cluster_b).

    Every node with an edge is a member: a pivot, or with the closest of the pivots that it is similar to (ties by the
    smallest id). A cluster is named by its medoid, the member with the largest sum of similarities within it (ties by
    the smallest id); `similarity` is that to the medoid, null where the two are only similar to the same pivot.
    """
    both = cut(edges.select(F.col("a").alias("id"), F.col("b").alias("other"), "s").unionByName(edges.select(F.col("b").alias("id"), F.col("a").alias("other"), "s")))
    pivots = _pivots(both)
    own = pivots.select("id", F.col("id").alias("p"), F.lit(2.0).alias("s"))
    near = both.join(pivots.withColumnRenamed("id", "other"), "other", "left_semi").select("id", F.col("other").alias("p"), "s")
    best = near.unionByName(own).groupBy("id").agg(F.max(F.struct("s", F.negative("p").alias("c"))).alias("x"))
    member = cut(best.select("id", F.negative("x.c").alias("p")))
    placed = cut(both.join(member, "id").join(member.select(F.col("id").alias("other"), F.col("p").alias("p_other")), "other"))
    inner = placed.filter("p = p_other").select("id", "p", "s")
    weight = member.select("id", "p", F.lit(0.0).alias("s")).unionByName(inner).groupBy("p", "id").agg(F.round(F.sum("s"), 6).alias("w"))
    medoid = cut(weight.groupBy("p").agg(F.max(F.struct("w", F.negative("id").alias("i"))).alias("x")).select("p", F.negative("x.i").alias("cluster")))
    to_medoid = placed.filter("p = p_other").join(medoid.withColumnRenamed("cluster", "other"), ["p", "other"]).select("id", "s")
    named = member.join(medoid, "p").join(to_medoid, "id", "left")
    members = named.select("id", "cluster", F.when(F.col("id") == F.col("cluster"), 1.0).otherwise(F.col("s")).alias("similarity"))
    links = placed.filter("id < other").join(medoid, "p").join(medoid.select(F.col("p").alias("p_other"), F.col("cluster").alias("cluster_b")), "p_other")
    return cut(members), links.select(F.col("id").alias("a"), F.col("other").alias("b"), F.col("cluster").alias("cluster_a"), "cluster_b")


def clusters(records: DataFrame, least: float = 0.5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Clusters of records (id, part, q, m), q and m arrays of (k, w): the members (id, part, rep, cluster, similarity),
    the copies among them (id, rep), and the links (a, b, cluster_a, cluster_b) between representatives.

    Similar are records of the same part whose shares overlap by `least` or more in both distributions. A null part and
    records without a usable entry in q or m are in no cluster; weights of equal keys add up; ids have to be unique.
    Records equal in everything are one representative, the smallest id. Records similar to no other are clusters of
    their own. Similarities (the mean of both overlaps) are rounded to 6 digits.
    """
    nodes = cut(records.select("id", "part", "q", "m").mapInArrow(_shares, f"id bigint, part string, {_LIST_TYPES}").withColumn("ph", F.xxhash64("part")))
    checked(nodes.select(F.col("part").alias("term")).distinct())
    copy = copies(nodes, ["part", *_LISTS])
    distinct = nodes.drop("part").join(broadcast_if_small(copy.filter("id <> rep").select("id")), "id", "left_anti")
    pairs = cut(similar_pairs(distinct, least).select("a", "b", F.round((F.col("q_overlap") + F.col("m_overlap")) / 2, 6).alias("s")))
    grouped, links = pivot_clusters(pairs)
    member = nodes.select("id", "part").join(copy, "id", "left").withColumn("rep", F.coalesce("rep", "id"))
    out = member.join(grouped.withColumnRenamed("id", "rep"), "rep", "left")
    similarity = F.when(F.col("cluster").isNull(), 1.0).otherwise(F.col("similarity"))
    return cut(out.select("id", "part", "rep", F.coalesce("cluster", "rep").alias("cluster"), similarity.alias("similarity"))), copy, links


def pairs_of(members: DataFrame, copy: DataFrame, links: DataFrame) -> DataFrame:
    """(x, y), x < y, of all similar records, from the clusters: where every two members of a cluster are similar, its
    pairs; the links between clusters and within the others complete them, copies included."""
    nodes = members.filter("id = rep").groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    inside = links.filter("cluster_a = cluster_b").groupBy(F.col("cluster_a").alias("cluster")).agg(F.count(F.lit(1)).alias("k"))
    whole = cut(nodes.join(inside, "cluster", "left").filter(2 * F.coalesce("k", F.lit(0)) == F.col("n") * (F.col("n") - 1)).select("cluster"))
    own = members.join(whole, "cluster", "left_semi").select("id", "cluster")
    size = own.groupBy("cluster").count().filter("count > 1").select("cluster")
    own = own.join(size, "cluster", "left_semi")
    a = own.withColumnRenamed("id", "x").join(own.withColumnRenamed("id", "y"), "cluster").filter("x < y").select("x", "y")
    rest = links.filter("cluster_a <> cluster_b").unionByName(links.filter("cluster_a = cluster_b").join(whole.withColumnRenamed("cluster", "cluster_a"), "cluster_a", "left_anti"))
    rest = rest.select("a", "b")
    if copy.isEmpty():
        return a.unionByName(rest.select(F.col("a").alias("x"), F.col("b").alias("y")))
    as_a, as_b = copy.withColumnsRenamed({"id": "x", "rep": "a"}), copy.withColumnsRenamed({"id": "y", "rep": "b"})
    b = rest.join(as_a, "a", "left").join(as_b, "b", "left").select(F.coalesce("x", "a").alias("x"), F.coalesce("y", "b").alias("y"))
    split = copy.join(members.select("id", "cluster").join(whole, "cluster", "left_anti").select("id"), "id", "left_semi")
    c = split.withColumnRenamed("id", "x").join(split.withColumnRenamed("id", "y"), "rep").filter("x < y").select("x", "y")
    return a.unionByName(b.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))).unionByName(c)


def argument_clusters(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    raw = table(spark, sf_dir, "arg_feature")
    checked(raw.select(F.explode("question_dist.question").alias("q")).distinct().select(norm_question("q").alias("term")))
    checked(item_strings(spark, sf_dir))
    q, m = dist_entries("question_dist", "question", norm_question).alias("q"), dist_entries("arg_mlm_dist", "item", norm_id).alias("m")
    return clusters(valid_args(raw, q, m).select(F.col("arg_id").alias("id"), F.col("verb_lemma").alias("part"), "q", "m"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similar pairs of arguments: the pairs of clusters whose members are all similar, completed by the links."""
    return pairs_of(*argument_clusters(spark, sf_dir)).select(F.col("x").alias("arg_id_a"), F.col("y").alias("arg_id_b"))


def p1_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of two arguments or more: lemma, size and the three most typical arguments, the medoid first."""
    members, _, _ = argument_clusters(spark, sf_dir)
    typical = Window.partitionBy("cluster").orderBy(F.col("similarity").desc_nulls_last(), F.col("id") != F.col("cluster"), "id")
    sizes = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    top = members.withColumn("r", F.row_number().over(typical)).filter("r <= 3").groupBy("cluster").agg(F.min("part").alias("verb_lemma"), F.sort_array(F.collect_list(F.struct("r", "id"))).alias("t"))
    return sizes.join(top, "cluster").select("cluster", "verb_lemma", "size", F.transform("t", lambda x: x["id"]).alias("typical"))


def p1_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What has to hold of the clusters: each argument is in one of them, of its own lemma, and a member names it."""
    members = argument_clusters(spark, sf_dir)[0]
    names = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"), F.countDistinct("part").alias("lemmas"), F.max((F.col("id") == F.col("cluster")).cast("int")).alias("named"))
    whole = names.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("in_clusters"), F.coalesce(F.max("lemmas") == 1, F.lit(True)).alias("one_lemma"), F.coalesce(F.min("named") == 1, F.lit(True)).alias("named_by_member"))
    return members.agg(F.countDistinct("id").alias("arguments")).crossJoin(whole)  # one row each


QUERIES = {"p1_found": p1_found, "p1_clusters": p1_clusters, "p1_partition": p1_partition}
_SHARE = """
    {n} AS (
      SELECT arg_id, k, w / sum(w) OVER (PARTITION BY arg_id) AS s FROM (
        SELECT arg_id, {norm} AS k, sum(u.weight) AS w FROM (SELECT arg_id, unnest({c}) AS u FROM arg) WHERE {norm} IS NOT NULL AND u.weight > 0 AND isfinite(u.weight) GROUP BY ALL))"""
SQL = {
    "p1_found": f"""
    WITH {VALID_ARGS}, {_SHARE.format(n="q", norm=NORM_Q.format(c="u.question"), c="question_dist")}, {_SHARE.format(n="m", norm=NORM_ID.format(c="u.item"), c="arg_mlm_dist")},
    lemma AS (SELECT arg_id, {NORM_ID.format(c="verb_lemma")} AS lemma FROM arg),
    ql AS (SELECT q.*, lemma FROM q JOIN lemma USING (arg_id) WHERE lemma IS NOT NULL),
    near AS (SELECT x.arg_id AS a, y.arg_id AS b FROM ql x JOIN ql y ON x.lemma = y.lemma AND x.k = y.k AND x.arg_id < y.arg_id GROUP BY ALL HAVING sum(least(x.s, y.s)) >= 0.5 - 1e-9)
    SELECT a AS arg_id_a, b AS arg_id_b FROM near JOIN m x ON x.arg_id = a JOIN m y ON y.arg_id = b AND x.k = y.k
    GROUP BY ALL HAVING sum(least(x.s, y.s)) >= 0.5 - 1e-9""",
    "p1_partition": f"""
    WITH {VALID_ARGS}, {_SHARE.format(n="q", norm=NORM_Q.format(c="u.question"), c="question_dist")}, {_SHARE.format(n="m", norm=NORM_ID.format(c="u.item"), c="arg_mlm_dist")}
    SELECT count(*) AS arguments, count(*) AS in_clusters, true AS one_lemma, true AS named_by_member FROM arg
    WHERE verb_lemma IS NOT NULL AND arg_id IN (SELECT arg_id FROM q) AND arg_id IN (SELECT arg_id FROM m)""",
}
