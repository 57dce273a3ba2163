"""Mixture clustering of sparse distributions and dense vectors as DataFrame steps.

Long rows: `dist` (verb_type, instance, item, value), `assign` (verb_type, instance, cluster, p), `theta`
(verb_type, cluster, item, theta). A step is one or two equi-joins and aggregations, so a verb type of any size is
spread over the cluster; only loops that need many steps write their small state between steps.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verbloom.functions.dist import dirichlet, log_sum_exp
from verbloom.operators.agglom import MAX_STEPS, Rows, hard_em
from verbloom.session import cut, parallelism

c = F.col
INSTANCE = ["verb_type", "instance"]


def estimate(dist: DataFrame, assign: DataFrame, alpha: float) -> DataFrame:
    """Weighted Dirichlet estimates of each cluster over the items of its verb type; `assign` has a weight p per
    (instance, cluster), 1 for hard clusters. A cluster named with weight 0 only is uniform."""
    vocabulary = dist.select("verb_type", "item").distinct()
    size = vocabulary.withColumn("k", F.count(F.lit(1)).over(Window.partitionBy("verb_type")))
    n = dist.join(assign, INSTANCE).groupBy("verb_type", "cluster", "item").agg(F.sum(c("p") * c("value")).alias("n"))
    grid = assign.select("verb_type", "cluster").distinct().join(size, "verb_type")
    full = grid.join(n, ["verb_type", "cluster", "item"], "left").withColumn("n", F.coalesce("n", F.lit(0.0)))
    whole = F.sum("n").over(Window.partitionBy("verb_type", "cluster"))
    return full.select("verb_type", "cluster", "item", dirichlet(c("n"), whole, c("k"), alpha).alias("theta"))


def losses(dist: DataFrame, theta: DataFrame) -> DataFrame:
    """(verb_type, instance, cluster, loss): negative log-likelihood of each instance under each cluster."""
    return dist.filter("value > 0").join(theta, ["verb_type", "item"]).groupBy(*INSTANCE, "cluster").agg((-F.sum(c("value") * F.log("theta"))).alias("loss"))


def weighted(parts: list[tuple[DataFrame, float]]) -> DataFrame:
    """Sum of loss tables of the same instances and clusters, each times its weight."""
    rows = None
    for part, weight in parts:
        own = part.withColumn("loss", c("loss") * F.lit(float(weight)))
        rows = own if rows is None else rows.unionByName(own)
    return rows.groupBy(*INSTANCE, "cluster").agg(F.sum("loss").alias("loss"))


def with_prior(loss: DataFrame, prior: DataFrame | None) -> DataFrame:
    """Losses less the log prior (verb_type, cluster, prior) of their cluster; without one, the uniform prior."""
    if prior is None:
        n = F.count(F.lit(1)).over(Window.partitionBy(*INSTANCE))
        return loss.withColumn("loss", c("loss") + F.log(n.cast("double")))
    return loss.join(prior, ["verb_type", "cluster"]).withColumn("loss", c("loss") - F.log("prior")).drop("prior")


def hard_step(loss: DataFrame) -> DataFrame:
    """The cluster of the smallest loss of each instance; losses equal to 9 digits go to the smaller cluster."""
    w = Window.partitionBy(*INSTANCE).orderBy(F.round("loss", 9), "cluster")
    return loss.withColumn("r", F.row_number().over(w)).filter("r = 1").drop("r").withColumn("p", F.lit(1.0))


def soft_step(loss: DataFrame, temperature: float = 1.0) -> DataFrame:
    """Probabilities softmax(-loss / T) of each instance's clusters, and the expected loss of the instance."""
    w = Window.partitionBy(*INSTANCE)
    scaled = loss.withColumn("s", -c("loss") / F.lit(temperature))
    p = scaled.withColumn("p", F.exp(c("s") - log_sum_exp(c("s"), w))).drop("s")
    return p.withColumn("expected", F.sum(c("p") * c("loss")).over(w))


def starting(dist: DataFrame, k: int) -> DataFrame:
    """A first assignment by a hash of the instance, the same on every run."""
    return dist.select(*INSTANCE).distinct().select(*INSTANCE, F.pmod(F.xxhash64("instance"), F.lit(k)).cast("string").alias("cluster"), F.lit(1.0).alias("p"))


def farthest_first(loss: DataFrame, centre: DataFrame) -> DataFrame:
    """The instance of each verb type that is farthest from its closest centre, ties by instance: a deterministic next
    starting point. `loss` is of all instances under the clusters of `centre`."""
    near = loss.join(centre, ["verb_type", "cluster"], "left_semi").groupBy(*INSTANCE).agg(F.round(F.min("loss"), 9).alias("loss"))
    return near.groupBy("verb_type").agg(F.max_by("instance", F.struct("loss", F.negative("instance"))).alias("instance"))


def run(dist: DataFrame, assign: DataFrame, alpha: float, soft: bool = False, delta: float | None = None, max_steps: int = MAX_STEPS) -> DataFrame:
    """Expectation maximisation of each verb type until its mean loss improves by no more than `delta` (hard 1e-5, soft
    1e-8); it then stays as it is while others go on. More than `max_steps` are an error."""
    delta = (1e-8 if soft else 1e-5) if delta is None else delta
    dist = cut(dist)
    before: dict[str, float] = {}
    done, going = None, dist
    for _ in range(max_steps):
        loss = with_prior(losses(going, estimate(going, assign, alpha)), None)
        assign = cut((soft_step(loss) if soft else hard_step(loss)).withColumn("_mean", c("expected" if soft else "loss")))
        means = {r[0]: r[1] for r in assign.groupBy("verb_type").agg(F.avg("_mean")).collect()}  # a row per verb type
        assign = assign.select(*INSTANCE, "cluster", "p", "loss")
        stable = [v for v, m in means.items() if before.get(v, float("inf")) - m <= delta]
        before = means
        if len(stable) == len(means):
            return assign if done is None else done.unionByName(assign)
        if stable:
            over = c("verb_type").isin(stable)
            out = assign.filter(over)
            done = out if done is None else done.unionByName(out)
            assign, going = assign.filter(~over), going.filter(~over)
    raise RuntimeError(f"{len(before)} verb types aren't stable after {max_steps} steps")


def _packed(theta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple]:
    """Parameters without the items that a cluster doesn't have, all of the row's smallest value."""
    base = theta.min(axis=-1, keepdims=True)
    at = np.flatnonzero(theta > base)
    return base, at, theta.ravel()[at], theta.shape


def _unpacked(base: np.ndarray, at: np.ndarray, values: np.ndarray, shape: tuple) -> np.ndarray:
    theta = np.broadcast_to(base, shape).copy()
    theta.ravel()[at] = values
    return theta


class Blocks:
    """The rows of one verb type as a table of blocks of instances, for agglom.hard_em: each thing it asks for is a job.
    The driver holds the clusters' parameters, and one loss per instance and trial while starting rows are drawn."""

    SIZE = 2000

    def __init__(self, dist: DataFrame):
        x = dist.groupBy(c("instance").cast("bigint").alias("instance"), c("item").cast("string").alias("item")).agg(F.sum(c("value").cast("double")).alias("value"))
        x = cut(x.filter("instance IS NOT NULL AND item IS NOT NULL"))
        number = lambda name: F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(name)) - 1
        self.ids = cut(x.select("instance").distinct().withColumn("i", number("instance")))
        names = cut(x.select("item").distinct().withColumn("j", number("item")))
        self.n, self.width = self.ids.count(), names.count()
        rows = x.join(self.ids, "instance").join(names, "item").groupBy(F.floor(c("i") / self.SIZE).alias("block"))
        rows = rows.agg(F.sort_array(F.collect_list(F.struct("i", "j", "value"))).alias("x")).select("block", "x.i", "x.j", "x.value")
        self.blocks = cut(rows.repartition(parallelism(dist.sparkSession), "block"))

    def _mapped(self, f: Callable[[Iterator[tuple[int, Rows]]], Iterator[pd.DataFrame]], schema: str, blocks: DataFrame | None = None) -> DataFrame:
        width = self.width

        def parts(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[int, Rows]]:
            for pdf in frames:
                for block, i, j, value in pdf.itertuples(index=False):
                    i = np.asarray(i)
                    yield int(i[0]), Rows(np.searchsorted(i, np.arange(i[0], i[-1] + 2)), np.asarray(j), np.asarray(value, float), width)

        return (self.blocks if blocks is None else blocks).mapInPandas(lambda frames: f(parts(frames)), schema)

    def rows(self, at: list[int]) -> list[np.ndarray]:
        def f(parts):
            for lo, x in parts:
                for i in sorted(set(at)):
                    if lo <= i < lo + x.n:
                        part = slice(x.start[i - lo], x.start[i - lo + 1])
                        yield pd.DataFrame({"i": [i], "items": [x.items[part].tolist()], "values": [x.values[part].tolist()]})

        got = self._mapped(f, "i bigint, items array<bigint>, values array<double>", self.blocks.filter(c("block").isin([i // self.SIZE for i in at]))).collect()
        found = {r[0]: np.bincount(r[1], r[2], minlength=self.width) for r in got}
        return [found[i] for i in at]

    def under(self, thetas: list[np.ndarray]) -> list[np.ndarray]:
        sent = _packed(np.array(thetas))

        def f(parts):
            for lo, x in parts:
                yield pd.DataFrame({"i": [lo], "loss": [x.losses(_unpacked(*sent)).T.tobytes()]})

        got = sorted(self._mapped(f, "i bigint, loss binary").collect())
        return list(np.concatenate([np.frombuffer(r[1]).reshape(len(thetas), -1) for r in got], axis=1))

    def step(self, thetas: list[np.ndarray]) -> list[tuple[float, np.ndarray]]:
        sent = [_packed(t) for t in thetas]

        def f(parts):
            whole = [_unpacked(*s) for s in sent]
            loss, sums = np.zeros(len(whole)), [np.zeros(t.size) for t in whole]
            lo = None
            for lo, x in parts:
                for k, (one, rows) in enumerate(x.step(whole)):
                    loss[k] += one
                    sums[k] += rows.ravel()
            if lo is not None:
                for k, s in enumerate(sums):
                    at = np.flatnonzero(s)
                    yield pd.DataFrame({"first": [lo], "trial": [k], "loss": [loss[k]], "at": [at.tobytes()], "sums": [s[at].tobytes()]})

        out = [[0.0, np.zeros(t.shape)] for t in thetas]
        for _, k, loss, at, sums in sorted(self._mapped(f, "first bigint, trial int, loss double, at binary, sums binary").collect()):
            out[k][0] += loss
            out[k][1].ravel()[np.frombuffer(at, np.int64)] += np.frombuffer(sums)
        return [tuple(x) for x in out]

    def sets(self, k: int, alpha: float, seed: int) -> DataFrame:
        """(instance, set): the flat clusters that agglom.flat_sets gives the same rows."""
        if self.n <= k:
            return self.ids.select("instance", c("i").cast("bigint").alias("set"))
        sent = _packed(hard_em(self, k, alpha, np.random.default_rng(seed)))

        def f(parts):
            for lo, x in parts:
                yield pd.DataFrame({"i": np.arange(lo, lo + x.n), "set": x.closest(_unpacked(*sent))[0]})

        return self._mapped(f, "i bigint, set bigint").join(self.ids, "i").select("instance", "set")


def size_prior(assign: DataFrame) -> DataFrame:
    """(verb_type, cluster, prior): share of the instances."""
    n = assign.groupBy("verb_type", "cluster").agg(F.sum("p").alias("n"))
    return n.select("verb_type", "cluster", (c("n") / F.sum("n").over(Window.partitionBy("verb_type"))).alias("prior"))


def mixture_step(dist: DataFrame, theta: DataFrame, prior: DataFrame, per_document: bool = False) -> DataFrame:
    """E-step of the mixture of unigrams: (item probability of a cluster) ~ exp(count * (log prior + log theta)) summed
    over items, where, as a deliberate quirk, the log prior counts once per item count. With `per_document` the prior
    has an instance column and clusters are assigned to each item of an instance instead (topics)."""
    if per_document:
        x = dist.join(theta, ["verb_type", "item"]).join(prior, [*INSTANCE, "cluster"])
        x = x.withColumn("s", c("value") * (F.log("prior") + F.log("theta")))
        w = Window.partitionBy(*INSTANCE, "item")
        return x.select(*INSTANCE, "item", "cluster", "value", F.exp(c("s") - log_sum_exp(c("s"), w)).alias("p"))
    x = dist.join(theta, ["verb_type", "item"]).join(prior, ["verb_type", "cluster"])
    s = x.groupBy(*INSTANCE, "cluster").agg(F.sum(c("value") * (F.log("prior") + F.log("theta"))).alias("s"))
    return s.select(*INSTANCE, "cluster", F.exp(c("s") - log_sum_exp(c("s"), Window.partitionBy(*INSTANCE))).alias("p"))


def run_mixture(dist: DataFrame, assign: DataFrame, alpha: float, steps: int, per_document: bool = False) -> DataFrame:
    """A number of soft steps of the mixture of unigrams, or of topics whose priors belong to each document: there the
    prior of a document is its add-one averaged item assignment, smoothed like a cluster's parameters."""
    dist = cut(dist)
    if not per_document:
        for _ in range(steps):
            assign = cut(mixture_step(dist, estimate(dist, assign, alpha), size_prior(assign)))
        return assign
    names = assign.select("verb_type", "cluster").distinct()
    k = F.count(F.lit(1)).over(Window.partitionBy(*INSTANCE))
    prior = cut(dist.select(*INSTANCE).distinct().join(names, "verb_type").withColumn("prior", 1.0 / k))
    theta, out = estimate(dist, assign, alpha), None
    for _ in range(steps):
        out = cut(mixture_step(dist, theta, prior, per_document=True))
        n = out.groupBy(*INSTANCE, "cluster").agg(F.sum(c("p") * c("value")).alias("n"))
        full = prior.drop("prior").join(n, [*INSTANCE, "cluster"], "left").withColumn("n", F.coalesce("n", F.lit(0.0)) + 1)
        share = c("n") / F.sum("n").over(Window.partitionBy(*INSTANCE))
        prior = cut(full.withColumn("s", share).select(*INSTANCE, "cluster", dirichlet(c("s"), F.lit(1.0), k.cast("double"), alpha).alias("prior")))
        per_item = out.groupBy("verb_type", "cluster", "item").agg(F.sum(c("p") * c("value")).alias("n"))
        size = dist.select("verb_type", "item").distinct().withColumn("k", F.count(F.lit(1)).over(Window.partitionBy("verb_type")))
        grid = names.join(size, "verb_type").join(per_item, ["verb_type", "cluster", "item"], "left").withColumn("n", F.coalesce("n", F.lit(0.0)))
        whole = F.sum("n").over(Window.partitionBy("verb_type", "cluster"))
        theta = cut(grid.select("verb_type", "cluster", "item", dirichlet(c("n"), whole, c("k"), alpha).alias("theta")))
    return out


# --- other kinds of parameters


def entropy_loss(counts: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """loss = total * ln(total) - sum(c * ln(c)) of each summed distribution, over its positive weights."""
    n = counts.filter(c(value) > 0)
    return n.groupBy(*keys).agg((F.sum(value) * F.log(F.sum(value)) - F.sum(c(value) * F.log(value))).alias("loss"))


def merge_losses(clusters: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, a, b, loss, delta), a < b: entropy losses of all pairs of clusters of a group, and what the merge costs.

    `clusters` has (keys, cluster, item, value); meant for the few clusters of a flat stage, not for instances.
    """
    single = entropy_loss(clusters, [*keys, "cluster"])
    name = clusters.select(*keys, "cluster").distinct()
    pair = name.withColumnRenamed("cluster", "a").join(name.withColumnRenamed("cluster", "b"), keys).filter("a < b")
    rows = pair.withColumn("cluster", F.explode(F.array("a", "b"))).join(clusters, [*keys, "cluster"])
    summed = rows.groupBy(*keys, "a", "b", "item").agg(F.sum("value").alias("value"))
    both = entropy_loss(summed, [*keys, "a", "b"])
    own = lambda x: single.select(*keys, c("cluster").alias(x), c("loss").alias(f"loss_{x}"))
    out = both.join(own("a"), [*keys, "a"]).join(own("b"), [*keys, "b"])
    return out.select(*keys, "a", "b", "loss", (c("loss") - c("loss_a") - c("loss_b")).alias("delta"))


def vector_means(vectors: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, idx, mean) of `vec` columns of equal length."""
    return vectors.select(*keys, F.posexplode("vec").alias("idx", "v")).groupBy(*keys, "idx").agg(F.avg(c("v").cast("double")).alias("mean"))


def nearest_mean(vectors: DataFrame, means: DataFrame, key: str, scale: float = 175.0) -> DataFrame:
    """(id, cluster, loss): the mean with the smallest squared distance over `scale`, ties by cluster."""
    flat = vectors.select(key, F.posexplode("vec").alias("idx", "v"))
    d = flat.join(means, "idx").groupBy(key, "cluster").agg((F.sum(F.pow(c("v").cast("double") - c("mean"), 2)) / scale).alias("loss"))
    w = Window.partitionBy(key).orderBy(F.round("loss", 9), "cluster")
    return d.withColumn("r", F.row_number().over(w)).filter("r = 1").drop("r")


def repeated_key_loss(members: DataFrame, keys: list[str], key: str) -> DataFrame:
    """Sum over keys of c * (c - 1) / 2: pairs of members of a cluster with the same key."""
    n = members.groupBy(*keys, key).agg(F.count(F.lit(1)).cast("double").alias("n"))
    return n.groupBy(*keys).agg(F.sum(c("n") * (c("n") - 1) / 2).alias("loss"))


def size_loss(members: DataFrame, keys: list[str]) -> DataFrame:
    """size * ln(size / N) of each cluster, N over its first key; single instances cost ln(1 / N)."""
    n = members.groupBy(*keys).agg(F.count(F.lit(1)).cast("double").alias("n"))
    whole = F.sum("n").over(Window.partitionBy(keys[0]))
    return n.select(*keys, "n", (c("n") * F.log(c("n") / whole)).alias("loss"))


def state_losses(members: DataFrame, observed: DataFrame) -> DataFrame:
    """Mixture of states: the loss of an instance (nll by state) under a cluster is the mean nll over the cluster's
    states. `members` (verb_type, cluster, state, n), `observed` (verb_type, instance, state, nll)."""
    share = members.withColumn("w", c("n") / F.sum("n").over(Window.partitionBy("verb_type", "cluster")))
    return observed.join(share, ["verb_type", "state"]).groupBy(*INSTANCE, "cluster").agg(F.sum(c("w") * c("nll")).alias("loss"))
