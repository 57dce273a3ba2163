"""The k most similar vectors of every vector.

Method: inverted multi-index. Unit vectors are cut into two halves, each quantised by its own codebook; a vector's
cell is its pair of nearest centroids. A query walks pairs of centroids by growing summed distance with a heap until
it has met enough entries, and the entries of those cells are reranked by exact cosine. How many are enough is
measured: the exact neighbours of a bounded number of queries are searched in all vectors, and the budget is what
finds the wanted share of them. A search for neighbours of a least cosine measures only those, which lie in the first
few cells whatever the size of the collection; without one the farther ranks decide. Equal vectors are searched once.
Entries are cut into blocks of neighbouring first centroids by size, so no task holds more than a bounded block of
entries at a time, and a query goes to the blocks of the cells that its walk met only.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verbloom.functions.clean import latest
from verbloom.llm.common import broadcast_if_small, copies
from verbloom.session import cut, table

#: Vectors that the codebooks are fitted on, at most; queries that measure the budget; entries of a block; queries that
#: are compared at once; centroids of a half, at most (so cells and their sizes are bounded: 16 MB).
SAMPLE, MEASURED, BLOCK, BATCH, CENTROIDS = 20_000, 256, 16_000, 8_192, 2_048
#: Without a least cosine: share of all neighbours that the budget has to reach, and entries of a cell, were all even.
RECALL, PER_CELL = 0.93, 16
#: With one: the budget is this times what reached every measured neighbour of that cosine; entries of a cell.
SLACK, PER_CELL_NEAR = 3, 1
#: Similarities that are computed at once.
PIECE = 2_000_000


def _matrix(col, dim: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _unit(dim: int):
    """Keeps vectors of `dim` finite numbers that aren't all zero, scaled to length 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vec = b.column(1)
            lengths = pa.compute.list_value_length(vec).fill_null(-1).to_numpy(zero_copy_only=False)
            keep = np.flatnonzero(lengths == dim)
            m = vec.take(pa.array(keep)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dim)
            size = np.abs(m).max(axis=1, initial=0.0)
            good = np.isfinite(size) & (size > 0)
            m, keep = m[good] / size[good, None], keep[good]
            m = (m / np.linalg.norm(m, axis=1)[:, None]).astype(np.float32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * dim), pa.array(m.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep)), lists], ["id", "vec"])

    return run


def codebook(x: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    """Centroids of k-means with distinct starting points; at most `k`."""
    rng = np.random.default_rng(seed)
    start = np.unique(x, axis=0)
    c = start[rng.permutation(len(start))[:k]].astype(np.float32)
    for _ in range(rounds):
        near = _distances(x, c).argmin(axis=1)
        n = np.bincount(near, minlength=len(c))
        sums = np.zeros(c.shape, np.float64)
        np.add.at(sums, near, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c).astype(np.float32)
    return c


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (c * c).sum(axis=1)[None, :] - 2.0 * (x @ c.T) + (x * x).sum(axis=1)[:, None]


def walk(a: list[float], ia: list[int], b: list[float], ib: list[int], sizes: list[list[int]], enough: int) -> tuple[set[int], float]:
    """First centroids met and the summed distance reached when cells, by growing a + b, hold `enough` entries; a and b
    are sorted distances, ia and ib their centroids. The heap holds the next cell of every row that was begun."""
    rows = [sizes[ia[0]]]
    heap, met, reached, used, last = [(a[0] + b[0], 0, 0)], 0, 0.0, set(), len(b) - 1
    while heap and met < enough:
        reached, i, j = heap[0]
        n = rows[i][ib[j]]
        if n:
            met += n
            used.add(ia[i])
        if j < last:
            heapq.heapreplace(heap, (a[i] + b[j + 1], i, j + 1))
        else:
            heapq.heappop(heap)
        if j == 0 and i + 1 < len(a):
            rows.append(sizes[ia[i + 1]])
            heapq.heappush(heap, (a[i + 1] + b[0], i + 1, 0))
    return used, reached if met >= enough else float("inf")


def _walks(da: np.ndarray, db: np.ndarray, sizes: list[list[int]], enough: int) -> Iterator[tuple[int, set[int], float]]:
    """(row, first centroids met, distance reached) of each row of distances to both codebooks. Only the nearest
    centroids are sorted; a walk that may leave them is repeated with twice as many."""
    rows, top = np.arange(len(da)), 16
    while len(rows):
        lists = []
        for d in (da[rows], db[rows]):
            o = np.argpartition(d, top, axis=1)[:, :top] if top < d.shape[1] else np.broadcast_to(np.arange(d.shape[1]), d.shape)
            v = np.take_along_axis(d, o, 1)
            by = np.argsort(v, axis=1, kind="stable")
            lists += [np.take_along_axis(v, by, 1).tolist(), np.take_along_axis(o, by, 1).tolist()]
        again = []
        for r, a, ia, b, ib in zip(rows.tolist(), *lists):
            used, reached = walk(a, ia, b, ib, sizes, enough)
            inside = (len(a) == da.shape[1] or reached <= a[-1] + b[0]) and (len(b) == db.shape[1] or reached <= a[0] + b[-1])
            if inside:
                yield r, used, reached
            else:
                again.append(r)
        rows, top = np.array(again, np.int64), top * 2


def _cells(books):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ca, cb = books.value
        half = ca.shape[1]
        for b in batches:
            m = _matrix(b.column(1), half + cb.shape[1])
            i, j = _distances(m[:, :half], ca).argmin(axis=1), _distances(m[:, half:], cb).argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32))], ["id", "vec", "i", "j"])

    return run


def _exact(queries, k: int):
    """(q, id, sim, i, j): of each batch of entries the k best for each of a few queries (rows of unit vectors)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qid, qm = queries.value
        for b in batches:
            if not b.num_rows:
                continue
            ids, i, j = (b.column(c).to_numpy(zero_copy_only=False) for c in (0, 2, 3))
            sim = qm @ _matrix(b.column(1), qm.shape[1]).T
            sim[qid[:, None] == ids[None, :]] = -2.0
            top = np.argpartition(-sim, min(k, len(ids)) - 1, axis=1)[:, :k]
            q = np.repeat(np.arange(len(qid)), top.shape[1])
            t = top.ravel()
            yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), pa.array(ids[t]), pa.array(sim[q, t].astype(np.float64)), pa.array(i[t]), pa.array(j[t])], ["q", "id", "sim", "i", "j"])

    return run


def _budget(entry: DataFrame, books, sizes: np.ndarray, sample: tuple[np.ndarray, np.ndarray], k: int, least: float | None) -> int:
    """Entries that a query has to meet so that RECALL of the exact neighbours of the sample queries are among them; with
    `least`, SLACK times what reaches all those of such a cosine."""
    (ca, cb), (qid, qm) = books.value, sample
    half = ca.shape[1]
    found = entry.mapInArrow(_exact(entry.sparkSession.sparkContext.broadcast(sample), k), "q int, id bigint, sim double, i int, j int")
    w = Window.partitionBy("q").orderBy(F.col("sim").desc(), "id")
    lowest = F.col("sim") > -2.0 if least is None else F.col("sim") >= least - 1e-5
    best = found.filter(lowest).withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k).select("q", "i", "j").toArrow()  # MEASURED * k rows
    if not best.num_rows:
        return k + 1
    q, i, j = (best.column(c).to_numpy() for c in range(3))
    da, db = _distances(qm[:, :half], ca), _distances(qm[:, half:], cb)
    need = []
    for x in np.unique(q).tolist():
        d = (da[x][:, None] + db[x][None, :]).ravel()
        order = np.argsort(d, kind="stable")
        met = np.empty(len(d), np.int64)
        met[order] = np.cumsum(sizes.ravel()[order])
        need.append(met[i[q == x] * sizes.shape[1] + j[q == x]])
    need = np.concatenate(need)
    return int(np.quantile(need, RECALL, method="higher")) if least is None else max(k + 1, SLACK * int(need.max()))


def _by_place(c: np.ndarray) -> np.ndarray:
    """An order of centroids in which near ones stand together: halves along the main axis, again and again."""
    out, stack = [], [np.arange(len(c))]
    while stack:
        at = stack.pop()
        if len(at) < 3:
            out += at.tolist()
            continue
        x = c[at] - c[at].mean(axis=0)
        at = at[np.argsort(x @ np.linalg.svd(x, full_matrices=False)[2][0], kind="stable")]
        stack += [at[len(at) // 2 :], at[: len(at) // 2]]
    return np.array(out)


def _blocks(by_row: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(first block, number of blocks) of each first centroid, and the number of all: centroids with few entries share a
    block with their neighbours in `order`, those with many have several."""
    first, pieces = np.zeros(len(by_row), np.int64), np.maximum(1, -(-by_row // BLOCK))
    at = held = 0
    for i in order.tolist():
        n_row, p = int(by_row[i]), int(pieces[i])
        if held and (p > 1 or held + n_row > BLOCK):
            at, held = at + 1, 0
        first[i] = at
        if p > 1:
            at, held = at + p, 0
        else:
            held += n_row
    return first, pieces, at + 1


def _partition_keys(spark: SparkSession, n: int) -> np.ndarray:
    """A number for each of `n` blocks, so that a repartition by it puts every block into a partition of its own."""
    tried = spark.range(20 * n + 200).select("id", F.pmod(F.hash("id"), F.lit(n)).alias("p")).groupBy("p").agg(F.min("id").alias("id")).toArrow()  # n rows
    keys = np.arange(n)
    keys[tried.column(0).to_numpy()] = tried.column(1).to_numpy()
    return keys


def _piece(ids: np.ndarray) -> np.ndarray:
    """A number of an id without the regularities of ids (the last step of a 64-bit mixer)."""
    x = ids.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))) >> np.uint64(1)


def _routes(books, sizes, blocks, keys, enough: int):
    """A row for the block that a vector is an entry of (is_query false), and one for each block that it has to be
    compared with (is_query true), with the summed distance up to which cells count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (ca, cb), n, (first, pieces) = books.value, sizes.value.tolist(), blocks.value
        half = ca.shape[1]
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                b = batch.slice(at, 2048)
                m = _matrix(b.column(1), half + cb.shape[1])
                ids, own = (b.column(x).to_numpy(zero_copy_only=False) for x in (0, 2))
                row = list(range(len(m)))
                block = (first[own] + (_piece(ids) % pieces[own].astype(np.uint64)).astype(np.int64)).tolist()
                reach = [0.0] * len(m)
                for r, used, reached in _walks(_distances(m[:, :half], ca), _distances(m[:, half:], cb), n, enough):
                    to = {int(first[i]) + p for i in used for p in range(int(pieces[i]))}
                    row += [r] * len(to)
                    block += to
                    reach += [reached] * len(to)
                query = np.arange(len(row)) >= len(m)
                take = pa.array(row)
                columns = [pa.array(keys.value[block]), pa.array(query), *(b.column(c).take(take) for c in range(4)), pa.array(reach, pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, ["block", "is_query", "id", "vec", "i", "j", "reach"])

    return run


def _rerank(books, k: int, least: float | None):
    """Exact cosines of the queries of each block with its entries in the cells within their reach; rows come with the
    entries of a block before its queries. Per query and block the best `k` are handed on, of those with a cosine of
    `least` or more if it is given."""

    def compare(entries: tuple, qid: np.ndarray, qm: np.ndarray, reach: np.ndarray) -> pa.RecordBatch | None:
        ids, m, ci, cj, cuts = entries
        ca, cb = books.value
        half = ca.shape[1]
        begin, many = cuts[:-1], np.diff(cuts)  # of cells
        rows = np.r_[0, np.flatnonzero(np.diff(ci[begin])) + 1, len(begin)]  # cells of one first centroid stand together
        da, db = _distances(qm[:, :half], ca[ci[begin[rows[:-1]]]]), _distances(qm[:, half:], cb)
        slack, nearest_b = reach + 1e-5, db.min(axis=1)
        lowest = -2.0 if least is None else least - 1e-5
        got: list[tuple] = []  # query, entry, similarity

        def best() -> tuple:
            q, e, sim = (np.concatenate(x) for x in zip(*got))
            o = np.lexsort((ids[e], -np.round(sim, 6), q))
            q, e, sim = q[o], e[o], sim[o]
            start = np.r_[0, np.flatnonzero(np.diff(q)) + 1]
            rank = np.arange(len(q)) - np.repeat(start, np.diff(np.r_[start, len(q)]))
            return q[rank < k], e[rank < k], sim[rank < k]

        floor, held = np.full(len(qid), lowest, np.float32), 0  # what a similarity has to reach to matter
        for x, (c0, c1) in enumerate(zip(rows[:-1].tolist(), rows[1:].tolist())):
            rest = slack - da[:, x]
            near = np.flatnonzero(rest >= nearest_b)
            step = max(1, PIECE // int(cuts[c1] - cuts[c0]))
            for at in range(0, len(near), step):
                sub = near[at : at + step]
                allow = db[sub][:, cj[begin[c0:c1]]] <= rest[sub, None]
                a, n = int(cuts[c0]), many[c0:c1]
                if (allow @ n).sum() * 24 > len(sub) * n.sum():  # most of it is wanted: one product of matrices
                    sim = np.where(np.repeat(allow, n, axis=1), qm[sub] @ m[a : int(cuts[c1])].T, np.float32(-3.0))
                    some = np.flatnonzero(sim.max(axis=1) >= floor[sub])
                    sub, sim = sub[some], sim[some]
                    if sim.shape[1] > k + 1:  # one of them may be the query itself
                        e = np.partition((np.rint((1.0 - sim) * 1e6).astype(np.int64) << 24) | np.arange(sim.shape[1]), k, axis=1)[:, : k + 1] & ((1 << 24) - 1)
                        sim = np.take_along_axis(sim, e, 1)
                    else:
                        e = np.broadcast_to(np.arange(sim.shape[1]), sim.shape)
                    keep = sim >= floor[sub, None]
                    q, e, sim = np.repeat(sub, keep.sum(axis=1)), e[keep] + a, sim[keep]
                else:  # entry by entry
                    r, cell = np.nonzero(allow)
                    n = n[cell]
                    ends = np.cumsum(n)
                    e = np.repeat(begin[c0:c1][cell] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)
                    q = np.repeat(sub[r], n)
                    sim = np.einsum("ij,ij->i", qm[q], m[e])
                    keep = sim >= floor[q]
                    q, e, sim = q[keep], e[keep], sim[keep]
                other = ids[e] != qid[q]
                got.append((q[other], e[other], sim[other]))
                held += len(q)
            if held > max(4 * k * len(qid), 1000):
                got = [best()]
                held = len(got[0][0])
                q, _, sim = got[0]
                last = np.flatnonzero(np.r_[np.diff(q) != 0, True])
                full = np.diff(np.r_[-1, last]) == k
                floor[q[last[full]]] = sim[last[full]] - 2e-6
        if not got:
            return None
        q, e, _ = best()
        exact = np.round(np.einsum("ij,ij->i", qm[q].astype(np.float64), m[e].astype(np.float64)), 6)
        if least is not None:
            q, e, exact = (v[exact >= least] for v in (q, e, exact))
        return pa.RecordBatch.from_arrays([pa.array(qid[q]), pa.array(ids[e]), pa.array(exact)], ["id", "other", "cosine"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dim = sum(c.shape[1] for c in books.value)
        block, held, entries, asked = None, [], None, []

        def answer() -> Iterator[pa.RecordBatch]:
            nonlocal asked
            if asked and entries is not None and (out := compare(entries, *(np.concatenate(x) for x in zip(*asked)))) is not None:
                yield out
            asked = []

        for batch in batches:
            codes, query = (batch.column(x).to_numpy(zero_copy_only=False) for x in (0, 1))
            cuts = np.r_[0, np.flatnonzero((np.diff(codes) != 0) | (np.diff(query.astype(np.int8)) != 0)) + 1, len(codes)]
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                ids, m, i, j, reach = (_matrix(part.column(x), dim) if x == 3 else part.column(x).to_numpy(zero_copy_only=False) for x in range(2, 7))
                if codes[a] != block:
                    yield from answer()
                    block, held, entries = codes[a], [], None
                if not query[a]:
                    held.append((ids, m, i, j))
                    continue
                if entries is None and held:
                    ei, em, ci, cj = (np.concatenate(x) for x in zip(*held))
                    o = np.lexsort((ei, cj, ci))
                    ei, em, ci, cj = ei[o], em[o], ci[o], cj[o]
                    entries, held = (ei, em, ci, cj, np.r_[0, np.flatnonzero((np.diff(ci) != 0) | (np.diff(cj) != 0)) + 1, len(ei)]), []
                asked.append((ids, m, reach))
                if sum(len(x[0]) for x in asked) >= BATCH:
                    yield from answer()
        yield from answer()

    return run


def nearest(df: DataFrame, k: int = 5, dim: int = 64, key: str = "id", vec: str = "vec", least: float | None = None) -> DataFrame:
    """(id, other, cosine) of the `k` most similar other vectors of every vector, by cosine, then by id; cosines are
    rounded to 6 digits. With `least`, only those of them with such a cosine: the walk then goes as far as these need.

    Takes part: rows whose id isn't null and whose vector has `dim` finite numbers, not all zero; ids have to be
    unique. Fewer than k + 1 vectors give each all others. Equal vectors (after scaling) are one entry with its k + 1
    smallest ids; every row of theirs gets its own result. Codebooks are fitted on at most SAMPLE vectors, chosen by
    hash; every vector is indexed and is a query. Accuracy is approximate: about RECALL of all neighbours are found,
    and nearly all of those of a least cosine that is high.
    """
    spark = df.sparkSession
    rows = df.select(F.col(key).cast("bigint").alias("id"), F.col(vec).cast("array<float>").alias("vec")).filter("id IS NOT NULL")
    unit = cut(rows.mapInArrow(_unit(dim), "id bigint, vec array<float>"))
    copy = copies(unit, ["vec"])
    other = copy.filter("id <> rep")
    by_id = Window.partitionBy("rep").orderBy("id")
    first = copy.withColumn("r", F.row_number().over(by_id)).filter(F.col("r") <= k + 1).groupBy("rep").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    entries = unit.join(broadcast_if_small(other.select("id")), "id", "left_anti")
    sample = entries.select("id", "vec").orderBy(F.xxhash64("id")).limit(SAMPLE).toArrow()  # SAMPLE rows at most
    if not sample.num_rows:
        return spark.createDataFrame([], "id bigint, other bigint, cosine double")
    sample_ids, x = sample.column(0).to_numpy(), _matrix(sample.column(1).combine_chunks(), dim)
    half = dim // 2
    n = entries.count()
    size = min(CENTROIDS, max(4, round((n / (PER_CELL if least is None else PER_CELL_NEAR)) ** 0.5)))
    books = spark.sparkContext.broadcast((codebook(x[:, :half], size, 1), codebook(x[:, half:], size, 2)))
    entry = cut(entries.mapInArrow(_cells(books), "id bigint, vec array<float>, i int, j int"))
    sizes = np.zeros((len(books.value[0]), len(books.value[1])), np.int32)
    held = entry.groupBy("i", "j").count().toArrow()  # CENTROIDS * CENTROIDS rows at most
    sizes[held.column(0).to_numpy(), held.column(1).to_numpy()] = held.column(2).to_numpy()
    enough = _budget(entry, books, sizes, (sample_ids[:MEASURED], x[:MEASURED]), k, least)
    *blocks, n_blocks = _blocks(sizes.sum(axis=1, dtype=np.int64), _by_place(books.value[0]))
    keys = _partition_keys(spark, n_blocks)
    share = [spark.sparkContext.broadcast(v) for v in (sizes, tuple(blocks), keys)]
    routed = entry.mapInArrow(_routes(books, *share, enough), "block bigint, is_query boolean, id bigint, vec array<float>, i int, j int, reach double")
    met = routed.repartition(n_blocks, "block").sortWithinPartitions("block", "is_query").mapInArrow(_rerank(books, k, least), "id bigint, other bigint, cosine double")
    best = Window.partitionBy("id").orderBy(F.col("cosine").desc(), "other")
    top = lambda rows, k: rows.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k).drop("r")
    if other.isEmpty():
        return top(met, k)
    # a group of equal vectors needs its k + 1 best, itself among them: one of them may be the row itself
    spread = met.join(first.withColumnRenamed("rep", "other"), "other", "left").select("id", F.explode(F.coalesce("ids", F.array("other"))).alias("other"), "cosine")
    own = first.select(F.col("rep").alias("id"), F.explode("ids").alias("other"), F.lit(1.0).alias("cosine"))
    group = cut(top(spread.unionByName(own), k + 1))
    further = group.withColumnRenamed("id", "rep").join(other, "rep").select("id", "other", "cosine")
    return top(group.unionByName(further).filter("id <> other"), k)


def usable_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(feature_id, arg_mlm_vec) of the rows of mlm_feature that count."""
    raw = table(spark, sf_dir, "mlm_feature").filter("feature_id IS NOT NULL").select("feature_id", "produced_at", "arg_mlm_vec")
    return latest(raw, ["feature_id"]).drop("produced_at")


def p5_neighbours(spark: SparkSession, sf_dir: str, least: float | None = None) -> DataFrame:
    """The 5 most similar other features of every usable feature."""
    found = nearest(usable_features(spark, sf_dir), key="feature_id", vec="arg_mlm_vec", least=least)
    return found.select(F.col("id").alias("feature_id"), F.col("other").alias("neighbour_id"), "cosine")


def exact_neighbours(df: DataFrame, queries: DataFrame, k: int, dim: int = 64, block: int = 4_096) -> DataFrame:
    """(id, other, cosine) by brute force of the `k` most similar vectors of each query, both (id, vec), by cosine, then
    id. Queries are compared in blocks of so many, each with all vectors; only a block at a time is in the driver."""
    spark = df.sparkSession
    unit = cut(df.mapInArrow(_unit(dim), "id bigint, vec array<float>")).select("id", "vec", F.lit(0).alias("i"), F.lit(0).alias("j"))
    asked = queries.mapInArrow(_unit(dim), "id bigint, vec array<float>")
    asked = cut(asked.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(-(-max(asked.count(), 1) // block)))))
    out = spark.createDataFrame([], "id bigint, other bigint, cosine double")
    w = Window.partitionBy("q").orderBy(F.round("sim", 6).desc(), "id")
    for r in sorted(r.b for r in asked.select("b").distinct().collect()):  # one number a block
        own = asked.filter(F.col("b") == r).toArrow()  # about `block` rows
        ids = own.column(0).to_numpy()
        shared = spark.sparkContext.broadcast((ids, _matrix(own.column(1).combine_chunks(), dim)))
        names = spark.createDataFrame(pa.table({"q": np.arange(len(ids), dtype=np.int32), "own": ids}))
        best = unit.mapInArrow(_exact(shared, k), "q int, id bigint, sim double, i int, j int").filter("sim > -2").withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k)
        out = out.unionByName(best.join(names, "q").select(F.col("own").alias("id"), F.col("id").alias("other"), F.round("sim", 6).alias("cosine")))
    return out


def p5_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries with an id divisible by 50, their exact neighbours of 5 ranks among all features, and whether at least 9 in
    10 of these are among those that the index finds."""
    rows = usable_features(spark, sf_dir).select(F.col("feature_id").alias("id"), F.col("arg_mlm_vec").alias("vec"))
    true = exact_neighbours(rows, rows.filter("id % 50 = 0"), 5)
    found = p5_neighbours(spark, sf_dir).filter("feature_id % 50 = 0").select(F.col("feature_id").alias("id"), F.col("neighbour_id").alias("other"), F.lit(1).alias("hit"))
    both = true.join(found, ["id", "other"], "left")
    return both.agg(F.countDistinct("id").alias("queries"), F.count(F.lit(1)).alias("neighbours"), (F.count("hit") >= 0.9 * F.count(F.lit(1))).alias("enough"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs with a cosine of at least 0.95, one of them among the 5 most similar of the other."""
    near = p5_neighbours(spark, sf_dir, 0.95)
    return near.select(F.least("feature_id", "neighbour_id").alias("feature_id_a"), F.greatest("feature_id", "neighbour_id").alias("feature_id_b")).distinct()


QUERIES = {"p5_found": p5_found, "p5_neighbours": p5_neighbours, "p5_recall": p5_recall}
_USABLE = """
    f AS (
      SELECT feature_id AS id, arg_mlm_vec::DOUBLE[64] AS v FROM (
        SELECT *, row_number() OVER (PARTITION BY feature_id ORDER BY produced_at DESC NULLS LAST) AS n FROM mlm_feature WHERE feature_id IS NOT NULL)
      WHERE n = 1 AND len(arg_mlm_vec) = 64 AND len(list_filter(arg_mlm_vec, lambda x: x IS NOT NULL AND isfinite(x))) = 64 AND len(list_filter(arg_mlm_vec, lambda x: x <> 0)) > 0)"""
SQL = {
    "p5_recall": f"WITH {_USABLE} SELECT count(*) FILTER (id % 50 = 0) AS queries, count(*) FILTER (id % 50 = 0) * least(5, count(*) - 1) AS neighbours, true AS enough FROM f",
    "p5_found": f"""
    WITH {_USABLE},
    s AS (SELECT a.id AS a, b.id AS b, round(array_cosine_similarity(a.v, b.v), 6) AS c FROM f a JOIN f b ON a.id <> b.id),
    best AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY c DESC, b) AS r FROM s)
    SELECT DISTINCT least(a, b) AS feature_id_a, greatest(a, b) AS feature_id_b FROM best WHERE r <= 5 AND c >= 0.95""",
}
