"""Merge trees as tables: nodes with leaf intervals, lives of nodes during splitting, and cuts.

`leaf_lo..leaf_hi` is the interval of leaf positions below a node, so "members of a node" is a range condition, and
a node is part of the cut at step t exactly if born <= t < died.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from verbloom.operators.agglom import DIRECT_LIMIT, FLAT_CLUSTERS, MAX_DEPTH, Rows, Term, Tree, agglomerate, capped, flat_sets, max_prior, min_entropy, no_loss, random_tree, repeated_keys
from verbloom.session import cut, parallelism

c = F.col
NODE_SCHEMA = "verb_type string, node int, parent int, left int, right int, loss double, size bigint, depth int, leaf_lo int, leaf_hi int, born int, died int"
LEAF_SCHEMA = "verb_type string, leaf int, instance bigint"


def keys(tree: Tree, sizes: list[float], by: str) -> list[float]:
    """What decides which node is split next: the loss per count (or per item), the merge delta, or the loss delta."""
    count = tree.fold(lambda i: sizes[i], lambda _, a, b: a + b)
    leaves = tree.fold(lambda i: 1, lambda _, a, b: a + b)
    out = []
    for x in range(tree.n + len(tree.merges)):
        kids = tree.children(x)
        delta = tree.loss(x) - sum(map(tree.loss, kids)) if kids else 0.0
        out.append({"per_count": tree.loss(x) / max(count[x], 1e-300), "per_item": tree.loss(x) / leaves[x], "delta": delta, "loss_delta": delta}[by])
    return out


def lives(tree: Tree, key: list[float]) -> tuple[list[int], list[int]]:
    """Steps at which each node enters and leaves the cut; in a step every splittable node whose key is the largest is
    split, ties together, and children with a larger key come next. Nodes that are never split live on."""
    end = 2**31 - 1
    total = tree.n + len(tree.merges)
    born, died = [end] * total, [end] * total
    heap: list[tuple[float, int]] = []

    def enter(x: int, step: int) -> None:
        born[x] = step
        if tree.children(x):
            heapq.heappush(heap, (-key[x], x))

    for r in tree.roots():
        enter(r, 0)
    step = 0
    while heap:
        step += 1
        best = heap[0][0]
        out = []
        while heap and heap[0][0] <= best + 1e-12:
            out.append(heapq.heappop(heap)[1])
        for x in out:
            died[x] = step
            for child in tree.children(x):
                enter(child, step)
    return born, died


def frame(verb_type: str, tree: Tree, sizes: list[float], by: str = "per_count") -> pd.DataFrame:
    """The node table of one tree."""
    total = tree.n + len(tree.merges)
    parent, depth = [-1] * total, [0] * total
    for k in range(len(tree.merges) - 1, -1, -1):
        for child in tree.merges[k][:2]:
            parent[child], depth[child] = tree.n + k, depth[tree.n + k] + 1
    lo, hi, at, stack = [0] * total, [0] * total, 0, [(r, False) for r in reversed(tree.roots())]
    while stack:
        x, done = stack.pop()
        kids = tree.children(x)
        if kids is None:
            lo[x] = hi[x] = at
            at += 1
        elif done:
            lo[x], hi[x] = lo[kids[0]], hi[kids[1]]
        else:
            stack += [(x, True), (kids[1], False), (kids[0], False)]
    born, died = lives(tree, keys(tree, sizes, by))
    size = tree.fold(lambda i: sizes[i], lambda _, a, b: a + b)
    kids = [tree.children(x) or (-1, -1) for x in range(total)]
    return pd.DataFrame({
        "verb_type": verb_type, "node": range(total), "parent": parent, "left": [k[0] for k in kids], "right": [k[1] for k in kids], "loss": [tree.loss(x) for x in range(total)],
        "size": [int(size[x]) for x in range(total)], "depth": depth, "leaf_lo": lo, "leaf_hi": hi, "born": born, "died": died,
    })


#: What a model's terms cost: the entropy of summed distributions, or pairs of members with a key in common.
KINDS = {"entropy": min_entropy, "pairs": repeated_keys}
#: (kind, weight) of the terms 0, 1, ... of a distribution.
Terms = tuple[tuple[str, float], ...]
ENTROPY: Terms = (("entropy", 1.0),)


def flat_items(dist: DataFrame, terms: Terms) -> DataFrame:
    """(verb_type, instance, item, value) that flat clusters are made by: the items of the entropy terms, told apart by
    term, times its weight."""
    weight = F.coalesce(*[F.when(c("term") == k, F.lit(float(w))) for k, (kind, w) in enumerate(terms) if kind == "entropy"], F.lit(None).cast("double"))
    rows = dist.withColumn("_w", weight).filter("_w IS NOT NULL")
    return rows.select("verb_type", "instance", F.concat_ws(":", c("term").cast("string"), c("item").cast("string")).alias("item"), (c("value") * c("_w")).alias("value"))


def with_term(dist: DataFrame, terms: Terms) -> DataFrame:
    """`dist` with the column `term` (0 where it has none). Instances without an entry in an entropy term get the item
    <none> in the first term, so that every one has a place among the flat clusters."""
    rows = dist if "term" in dist.columns else dist.withColumn("term", F.lit(0))
    kinds = [k for k, (kind, _) in enumerate(terms) if kind == "entropy"]
    if len(kinds) == len(terms):
        return rows
    has = rows.filter(c("term").isin(kinds)) if kinds else rows.limit(0)
    bare = rows.select("verb_type", "instance").distinct().join(has.select("verb_type", "instance").distinct(), ["verb_type", "instance"], "left_anti")
    return rows.unionByName(bare.withColumns({"item": F.lit("<none>"), "value": F.lit(1.0), "term": F.lit(kinds[0] if kinds else len(terms))}), allowMissingColumns=True)


@dataclass
class _Group:
    """The rows of one verb type by instance: those of ids[i] are start[i]..start[i + 1]; items are places in `names`."""

    ids: np.ndarray
    start: np.ndarray
    names: list[str]
    items: np.ndarray
    values: np.ndarray
    terms: np.ndarray
    members: np.ndarray

    def rows(self, weights: dict[int, float]) -> Rows:
        """The entries of some terms, times their weight; the items of different terms are told apart."""
        kept = np.isin(self.terms, list(weights))
        scale = np.array([weights.get(k, 0.0) for k in range(max([*weights, -1]) + 1)])
        if len(weights) == 1 and kept.all():
            return Rows(self.start, self.items, self.values * scale[-1], len(self.names))
        at, terms = np.repeat(np.arange(len(self.ids)), np.diff(self.start))[kept], self.terms[kept]
        used, items = np.unique(terms.astype(np.int64) * len(self.names) + self.items[kept], return_inverse=True)
        return Rows(np.searchsorted(at, np.arange(len(self.ids) + 1)), items, self.values[kept] * scale[terms], max(len(used), 1))


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str | None, _Group]]:
    """The verb types of sorted (verb_type, instance, item, value, term, members) rows, one at a time. What is kept of a
    row is its numbers, each item's text once."""

    def whole(parts: list[tuple[np.ndarray, ...]], names: dict[str, int]) -> _Group:
        instance = np.concatenate([p[0] for p in parts])
        order = np.argsort(instance, kind="stable")
        instance = instance[order]
        start = np.flatnonzero(np.r_[True, instance[1:] != instance[:-1]])
        ids = instance[start]
        del instance
        place = np.empty(len(names), np.int32)
        place[sorted(range(len(names)), key=list(names).__getitem__)] = np.arange(len(names), dtype=np.int32)
        joined = lambda k: np.concatenate([p[k] for p in parts])[order]
        members = np.maximum.reduceat(joined(4), start)
        return _Group(ids, np.r_[start, len(order)], sorted(names), place[joined(1)], joined(2), joined(3), members)

    parts, names, last = [], {}, None
    for batch in batches:
        if not batch.num_rows:
            continue
        kinds, item, instance, value, term, members = (batch.column(k) for k in ("verb_type", "item", "instance", "value", "term", "members"))
        place = kinds.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero(np.diff(place)) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(edges, edges[1:]):
            own = kinds[lo].as_py()
            if parts and own != last:
                yield last, whole(parts, names)
                parts, names = [], {}
            last, coded = own, item.slice(lo, hi - lo).dictionary_encode()
            code = np.array([names.setdefault(x, len(names)) for x in coded.dictionary.to_pylist()], np.int32)
            number = lambda x, kind: np.array(x.slice(lo, hi - lo).to_numpy(zero_copy_only=False), kind)  # noqa: B023, E731
            parts.append((number(instance, np.int64), code[coded.indices.to_numpy()], number(value, float), number(term, np.int16), number(members, np.int32)))
    if parts:
        yield last, whole(parts, names)


def clustered(dist: DataFrame, alpha: float = 0.01, prior_weight: float = 0.0, limit: int = DIRECT_LIMIT, seed: int = 0, flat_clusters: int = FLAT_CLUSTERS, terms: Terms = ENTROPY) -> tuple[DataFrame, DataFrame]:
    """(nodes, leaves) of the hybrid clustering of each verb type, from (verb_type, instance, item, value), with `term`
    where there are several `terms`; merges go by the sum of their losses, each times its weight.

    A task reads its verb types one after the other and holds the rows of one as numbers, and flat clusters by items.
    Larger ones get flat clusters first, which are then the instances here, with a column `members` that counts theirs
    (see models.hybrid_model).
    """
    dist = with_term(dist, terms)
    members = F.coalesce(c("members"), F.lit(1)) if "members" in dist.columns else F.lit(1)
    rows = dist.select(c("verb_type").cast("string"), c("instance").cast("bigint"), c("item").cast("string"), c("value").cast("double"), c("term").cast("int"), members.cast("int").alias("members"))
    flat_weights = {k: w for k, (kind, w) in enumerate(terms) if kind == "entropy"} or {len(terms): 1.0}

    def tree_of(name: str | None, g: _Group) -> pd.DataFrame:
        at = np.arange(len(g.ids))
        if len(g.ids) > limit:
            at = flat_sets(g.rows(flat_weights), flat_clusters, alpha, seed)
        sets = int(at.max()) + 1
        costs = [KINDS[kind](g.rows({k: 1.0}).sums(at, sets), weight=w) for k, (kind, w) in enumerate(terms) if kind in KINDS]
        costs += [max_prior(np.bincount(at, g.members), g.members.sum(), prior_weight)] if prior_weight else []
        tree, at = capped(agglomerate(costs or [no_loss(sets)], check=False), at, MAX_DEPTH)
        return _tables(frame(name, tree, np.bincount(at, g.members, minlength=tree.n).tolist()), at, g.ids)

    schema = to_arrow_schema(_parse_datatype_string(_BOTH))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, group in _groups(batches):
            yield from pa.Table.from_pandas(tree_of(name, group), schema, preserve_index=False).to_batches()

    rows = rows.filter("instance IS NOT NULL AND item IS NOT NULL").repartition(2 * parallelism(dist.sparkSession), "verb_type").sortWithinPartitions("verb_type")
    return _split(rows.mapInArrow(build, _BOTH))


_BOTH = f"{NODE_SCHEMA}, {LEAF_SCHEMA.split(', ', 1)[1]}"


def _tables(nodes: pd.DataFrame, at: np.ndarray, ids: np.ndarray) -> pd.DataFrame:
    """Node rows and leaf rows of one tree as one frame; `at` is the leaf of each id."""
    leaves = pd.DataFrame({"verb_type": nodes["verb_type"].iloc[0], "leaf": nodes["leaf_lo"].to_numpy()[at], "instance": ids})
    whole = {"leaf": "Int32", "instance": "Int64", "size": "Int64"} | {k: "Int32" for k in ("node", "parent", "left", "right", "depth", "leaf_lo", "leaf_hi", "born", "died")}
    return pd.concat([nodes, leaves], ignore_index=True).astype(whole)


def _split(both: DataFrame) -> tuple[DataFrame, DataFrame]:
    both = cut(both)  # one pass for both tables
    names = [f.split()[0] for f in NODE_SCHEMA.split(", ")]
    return both.filter("node IS NOT NULL").select(*names), both.filter("leaf IS NOT NULL").select("verb_type", "leaf", "instance")


def random_trees(instances: DataFrame, seed: int, by_size: bool = False) -> tuple[DataFrame, DataFrame]:
    """(nodes, leaves) of a random tree over the instances of each verb type, at no loss; cut at MAX_DEPTH. One task per
    verb type, which holds its ids."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = np.sort(pdf["instance"].to_numpy())
        name = pdf["verb_type"].iloc[0]
        rng = np.random.default_rng([seed, *name.encode()])
        tree, at = capped(random_tree(len(ids), rng, by_size), np.arange(len(ids)), MAX_DEPTH)
        return _tables(frame(name, tree, np.bincount(at, minlength=tree.n).tolist()), at, ids)

    return _split(instances.select(c("verb_type").cast("string"), c("instance").cast("bigint")).distinct().groupBy("verb_type").applyInPandas(build, _BOTH))


def cut_at(nodes: DataFrame, leaves: DataFrame, step) -> DataFrame:
    """(verb_type, instance, cluster): members of the nodes alive at a step (a number or a column of `nodes`)."""
    s = F.lit(step) if isinstance(step, int) else step
    alive = nodes.filter((c("born") <= s) & (s < c("died"))).select("verb_type", c("node").alias("cluster"), "leaf_lo", "leaf_hi")
    at = alive.withColumn("leaf", F.explode(F.sequence("leaf_lo", "leaf_hi"))).select("verb_type", "cluster", "leaf")
    return leaves.join(at, ["verb_type", "leaf"]).select("verb_type", "instance", "cluster")


def steps(nodes: DataFrame, limit: int) -> DataFrame:
    """(verb_type, step, n_clusters, loss, xlogx, size, top_loss, wlogw, weight_sum) of the first `limit` cuts: xlogx is
    the sum of s * ln(s) over the cut's clusters, wlogw the same of their weights (the column `weight` of the nodes, see
    `weighted`; sizes without one), top_loss the largest loss per item of a cluster.

    A node counts at its birth and against at its death, so a running sum over the steps gives what all cuts hold without
    listing their members. The largest loss per item is that of the nodes split next, where those of the largest are
    (lives by `per_count`), or of a leaf.
    """
    never = 2**31 - 1
    w = c("weight").cast("double") if "weight" in nodes.columns else c("size").cast("double")
    rows = nodes.withColumns({"_w": w, "per_item": c("loss") / c("size")})
    kept = ["verb_type", "step", "s", "loss", "size", "_w"]
    into = rows.filter(c("born") < limit).withColumns({"step": c("born"), "s": F.lit(1)}).select(*kept, F.when(c("left") < 0, c("per_item")).alias("leaf"))
    out = rows.filter((c("died") < limit) & (c("died") < never)).withColumns({"step": c("died"), "s": F.lit(-1)}).select(*kept, F.lit(None).cast("double").alias("leaf"))
    signed = lambda x: F.sum(c("s") * x)
    xlogx = lambda x: F.when(x > 0, x * F.log(x)).otherwise(0.0)
    size = c("size").cast("double")
    change = into.unionByName(out).groupBy("verb_type", "step").agg(
        F.sum("s").alias("n"), signed(c("loss")).alias("loss"), signed(xlogx(size)).alias("xlogx"), signed(c("size")).alias("size"), signed(xlogx(c("_w"))).alias("wlogw"), signed(c("_w")).alias("w"), F.max("leaf").alias("leaf")
    )
    split = rows.filter((c("died") <= limit) & (c("died") < never)).groupBy("verb_type", (c("died") - 1).alias("step")).agg(F.max("per_item").alias("next"))
    run = Window.partitionBy("verb_type").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    top = F.greatest(F.max("leaf").over(run), c("next"))
    sums = [F.sum(k).over(run).alias(v) for k, v in (("n", "n_clusters"), ("loss", "loss"), ("xlogx", "xlogx"), ("size", "size"), ("wlogw", "wlogw"), ("w", "weight_sum"))]
    return change.join(split, ["verb_type", "step"], "left").select("verb_type", "step", *sums, top.alias("top_loss"))


def weighted(nodes: DataFrame, leaves: DataFrame, weights: DataFrame) -> DataFrame:
    """The nodes with `weight`, the summed weights (verb_type, instance, weight) of their members; instances without one
    weigh nothing. Leaf positions of a node are an interval, so running sums over positions give all nodes."""
    at = leaves.join(weights, ["verb_type", "instance"], "left").groupBy("verb_type", "leaf").agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("w"))
    run = Window.partitionBy("verb_type").orderBy("leaf")
    sums = at.select("verb_type", "leaf", F.sum("w").over(run).alias("upto"), "w")
    lo = sums.select("verb_type", c("leaf").alias("leaf_lo"), (c("upto") - c("w")).alias("_before"))
    hi = sums.select("verb_type", c("leaf").alias("leaf_hi"), "upto")
    return nodes.join(lo, ["verb_type", "leaf_lo"]).join(hi, ["verb_type", "leaf_hi"]).withColumn("weight", F.round(c("upto") - c("_before"), 9)).drop("upto", "_before")


def number_cut(nodes: DataFrame, k: int) -> DataFrame:
    """(verb_type, step): the first cut with at least k clusters, else the last (the leaves)."""
    s = steps(nodes, 2**31 - 2)
    return s.groupBy("verb_type").agg(F.coalesce(F.min(F.when(c("n_clusters") >= k, c("step"))), F.max("step")).alias("step"))


def entropy_cut(nodes: DataFrame, weight: float, limit: int = 100) -> DataFrame:
    """(verb_type, step): of the first `limit` cuts the one of the smallest loss + weight * sum(-s * ln(s / N)), the
    earliest of equal ones."""
    s = steps(nodes, limit)
    score = c("loss") + F.lit(float(weight)) * (c("size") * F.log(c("size").cast("double")) - c("xlogx"))
    return s.groupBy("verb_type").agg(F.min_by("step", F.struct(F.round(score, 9), "step")).alias("step"))


def at_most_cut(nodes: DataFrame, k: int) -> DataFrame:
    """(verb_type, step): the last cut with no more than k clusters, else the first."""
    s = steps(nodes, 2**31 - 2)
    return s.groupBy("verb_type").agg(F.coalesce(F.max(F.when(c("n_clusters") <= k, c("step"))), F.min("step")).alias("step"))


def leaf_fold(nodes: DataFrame, leaves: DataFrame, value, name: str = "value") -> DataFrame:
    """An aggregate over the members of every node, from (verb_type, leaf, instance, ...) rows and the leaf intervals."""
    at = nodes.select("verb_type", "node", F.explode(F.sequence("leaf_lo", "leaf_hi")).alias("leaf"))
    return at.join(leaves, ["verb_type", "leaf"]).groupBy("verb_type", "node").agg(value.alias(name))


def depth_limited(nodes: DataFrame, depth: int) -> DataFrame:
    """The tree down to `depth`; nodes at that depth become leaves that keep their loss, size and leaf interval."""
    return nodes.filter(c("depth") <= depth).withColumns({k: F.when(c("depth") == depth, -1).otherwise(c(k)) for k in ("left", "right")})


def path_to(nodes: DataFrame, leaf: int) -> DataFrame:
    """Nodes from the root to a leaf position."""
    return nodes.filter((c("leaf_lo") <= leaf) & (F.lit(leaf) <= c("leaf_hi"))).orderBy("verb_type", "depth")


def restricted(tree: Tree, keep: set[int]) -> Tree:
    """The tree of the kept leaves; merges with one side left vanish, the others keep their losses."""
    kept = [i for i in range(tree.n) if i in keep]
    new = {x: i for i, x in enumerate(kept)}
    out = Tree(len(kept), [tree.leaf_loss[i] for i in kept])
    for k, (a, b, loss) in enumerate(tree.merges):
        node = tree.n + k
        if a in new and b in new:
            new[node] = out.n + len(out.merges)
            out.merges.append((new[a], new[b], loss))
        elif a in new or b in new:
            new[node] = new[a] if a in new else new[b]
    return out


def re_merged(tree: Tree, keep: set[int], terms: list[Term]) -> Tree:
    """The tree of the kept leaves with all losses computed anew from the statistics of their members."""
    out = restricted(tree, keep)
    rows = [t.rows[sorted(keep)] for t in terms]
    loss = lambda parts: float(sum(t.weight * t.loss(p[None, :])[0] for t, p in zip(terms, parts)))
    state = {i: [r[i] for r in rows] for i in range(out.n)}
    fresh = Tree(out.n, [loss(state[i]) for i in range(out.n)])
    for k, (a, b, _) in enumerate(out.merges):
        state[out.n + k] = [x + y for x, y in zip(state[a], state[b])]
        fresh.merges.append((a, b, loss(state[out.n + k])))
    return fresh


def to_json(tree: Tree, value=lambda i: i) -> str:
    """Nested form: {"loss", "value"} for leaves, {"loss", "left", "right"} for merges, built without recursion."""
    import json

    out = tree.fold(lambda i: json.dumps({"loss": tree.leaf_loss[i], "value": value(i)}), lambda x, a, b: f'{{"loss": {json.dumps(tree.loss(x))}, "left": {a}, "right": {b}}}')
    return out[tree.n + len(tree.merges) - 1] if tree.merges else out[0]


def from_json(text: str) -> tuple[Tree, list]:
    """The tree and its leaf values."""
    import json

    root = json.loads(text)
    order, stack = [], [root]
    while stack:
        x = stack.pop()
        order.append(x)
        if "left" in x:
            stack += [x["left"], x["right"]]
    leaves = [x for x in order if "left" not in x]
    leaves.reverse()
    tree, number = Tree(len(leaves), [x["loss"] for x in leaves]), {id(x): i for i, x in enumerate(leaves)}
    for x in reversed(order):
        if "left" in x:
            number[id(x)] = tree.n + len(tree.merges)
            tree.merges.append((number[id(x["left"])], number[id(x["right"])], x["loss"]))
    return tree, [x["value"] for x in leaves]
