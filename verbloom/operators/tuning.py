"""Curves of precision and recall along the cuts of a tree, and the choice of a cut by a tuned criterion.

Points: (verb_type, step, n_clusters, loss, xlogx, size, top_loss, wlogw, weight_sum, precision, recall, weight), one per
cut; see tree.steps. A criterion orders the points of a verb type for a threshold, the first is chosen, and choices are
averaged over verb types by weight.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verbloom.functions.dist import harmonic
from verbloom.operators import tree as trees

c = F.col


def grid(first: float, last: float, step: float) -> list[float]:
    """first, first + step, ... up to last."""
    return [round(first + i * step, 10) for i in range(int(round((last - first) / step)) + 1)]


#: Thresholds that each criterion is tried with.
GRIDS = {
    "num-clusters": grid(1, 35, 1), "oracle": [1.2**i for i in range(-10, 11)], "entropy": grid(-0.5, 5, 0.05), "wentropy": grid(-0.5, 5, 0.05), "max-entropy": grid(-0.5, 5, 0.05),
    "log-penalty": grid(0.01, 1, 0.01), "linear-penalty": grid(0, 0.1, 0.001), "sq-nclusters": grid(0, 25, 0.5), "cut-delta": grid(0, 10, 0.1), "loss": grid(0, 4, 0.1), "max-loss": grid(0, 1, 0.01),
}


def _xlogx(x: Column) -> Column:
    return F.when(x > 0, x * F.log(x.cast("double"))).otherwise(0.0)


def _mixing() -> Column:
    """sum(-s * ln(s / N)) over the clusters."""
    return _xlogx(c("size")) - c("xlogx")


def _per_item() -> Column:
    return F.round(F.try_divide("loss", "size"), 9)


def _smallest(score: Column) -> list[Column]:
    """The smallest score, the earliest of equal ones."""
    return [F.round(score, 9), c("step")]


def _last_above(x: Column) -> list[Column]:
    """Points by falling x: the last one above the threshold, or the first of all."""
    above = x > c("t")
    return [above.desc(), F.when(above, x).otherwise(-x), F.when(above, -c("step")).otherwise(c("step"))]


def _before_jump() -> list[Column]:
    """Points by growing loss: how far neighbours differ by less than t times the number of items; the last point but one
    of that stretch, or the first of all."""
    group = Window.partitionBy("verb_type", "t")
    passes = F.coalesce(F.round(c("next_loss") - c("loss"), 9) < F.round(c("t") * c("size"), 9), F.lit(False))
    end = F.min(F.when(~passes, c("by_loss"))).over(group)
    return [F.abs(c("by_loss") - F.greatest(end - 1, F.lit(0)))]


#: The order of points for the threshold in column t; the first is chosen.
ORDERS: dict[str, Callable[[], list[Column]]] = {
    "num-clusters": lambda: [(c("n_clusters") >= c("t")).desc(), F.when(c("n_clusters") >= c("t"), c("n_clusters")).otherwise(-c("n_clusters")), c("step")],
    "oracle": lambda: _smallest(-((1 + c("t") * c("t")) * c("precision") * c("recall") / F.greatest(c("t") * c("t") * c("precision") + c("recall"), F.lit(1e-300)))),
    "entropy": lambda: _smallest(c("loss") + c("t") * _mixing()),
    "wentropy": lambda: _smallest(c("loss") + c("t") * (_xlogx(c("weight_sum")) - c("wlogw"))),
    "max-entropy": lambda: _smallest(c("top_loss") + c("t") * F.try_divide(_mixing(), c("size"))),
    "log-penalty": lambda: _smallest(c("loss") + c("t") * F.log(c("n_clusters").cast("double")) * c("size")),
    "linear-penalty": lambda: _smallest(c("loss") + c("t") * c("n_clusters") * c("size")),
    "sq-nclusters": lambda: _smallest(c("loss") + c("t") * c("n_clusters") * c("n_clusters")),
    "cut-delta": _before_jump,
    "loss": lambda: _last_above(_per_item()),
    "max-loss": lambda: _last_above(F.round(c("top_loss"), 9)),
}


def parse(spec: str) -> tuple[str, list[float]]:
    """`name` or `name=t1,t2`: a criterion and its thresholds."""
    name, _, given = spec.partition("=")
    if name not in ORDERS:
        raise ValueError(f"no criterion {name!r}")
    return name, [float(t) for t in given.split(",")] if given else GRIDS[name]


def chosen(points: DataFrame, spec: str) -> DataFrame:
    """The point of each verb type that each threshold `t` of a criterion chooses."""
    name, thresholds = parse(spec)
    growing = Window.partitionBy("verb_type").orderBy(F.round("loss", 9), "step")
    at = points.withColumns({"by_loss": F.row_number().over(growing) - 1, "next_loss": F.lead("loss").over(growing)}) if name == "cut-delta" else points
    tried = at.withColumn("t", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    order = ORDERS[name]()
    if name == "cut-delta":  # its order is itself over a window
        tried, order = tried.withColumn("_o", order[0]), [c("_o")]
    best = Window.partitionBy("verb_type", "t").orderBy(*order)
    return tried.withColumn("_r", F.row_number().over(best)).filter("_r = 1").select("t", *points.columns)


def tuned(points: DataFrame, spec: str, by: tuple[str, ...] = ()) -> DataFrame:
    """(criterion, t, precision, recall, f1, weight) for each threshold: the chosen points of all verb types, averaged,
    apart for the columns `by` of the points."""
    w = c("weight")
    mean = chosen(points, spec).groupBy(*by, "t").agg((F.sum(c("precision") * w) / F.sum(w)).alias("precision"), (F.sum(c("recall") * w) / F.sum(w)).alias("recall"), F.sum(w).alias("weight"))
    return mean.select(F.lit(parse(spec)[0]).alias("criterion"), *by, "t", "precision", "recall", harmonic(c("precision"), c("recall")).alias("f1"), "weight")


def tuned_all(points: DataFrame, specs: list[str]) -> DataFrame:
    """`tuned` for several criteria."""
    out = None
    for spec in specs:
        own = tuned(points, spec)
        out = own if out is None else out.unionByName(own)
    return out


def best_setting(results: DataFrame) -> DataFrame:
    """The one row of the best criterion but `oracle`, at its best threshold: by F1 (to 9 digits), then by name."""
    return best_threshold(results.filter("criterion <> 'oracle'"), ["criterion"]).orderBy(F.round("f1", 9).desc(), "criterion").limit(1)


def split_by(nodes: DataFrame, leaves: DataFrame, points: DataFrame, criterion: str, t: float) -> DataFrame:
    """(verb_type, instance, cluster): trees cut as a criterion and threshold choose. The number of clusters and the
    entropy criteria have cuts of their own; the others take the point they chose."""
    if criterion == "num-clusters":
        step = trees.number_cut(nodes, int(t))
    elif criterion in ("entropy", "wentropy"):
        step = trees.entropy_cut(nodes, t)
    else:
        step = chosen(points, f"{criterion}={t!r}").select("verb_type", "step")
    return trees.cut_at(nodes.join(step, "verb_type"), leaves, c("step"))


def best_threshold(results: DataFrame, by: list[str]) -> DataFrame:
    """Per `by` the row with the largest F1 (to 9 digits). Of several: the smallest threshold if the largest of all
    thresholds is among them, else the largest if the smallest is, else the smallest of them."""
    group = Window.partitionBy(*by)
    x = results.withColumns({"_f": F.round("f1", 9), "_lo": F.min("t").over(group), "_hi": F.max("t").over(group)}).withColumn("_top", F.max("_f").over(group)).filter("_f = _top")
    x = x.withColumns({"_has_hi": F.max("t").over(group) == c("_hi"), "_has_lo": F.min("t").over(group) == c("_lo")})
    want = F.when(~c("_has_hi") & c("_has_lo"), F.max("t").over(group)).otherwise(F.min("t").over(group))
    return x.withColumn("_want", want).filter(c("t") == c("_want")).drop("_want", "_f", "_lo", "_hi", "_top", "_has_hi", "_has_lo")


def calibration(points: DataFrame, spec: str) -> DataFrame:
    """`tuned`, apart for verb types by their number of items: (n_items, n_verbs, log_items) beside the scores."""
    sized = points.withColumn("n_items", F.max("size").over(Window.partitionBy("verb_type")).cast("bigint"))
    n = sized.groupBy("n_items").agg(F.countDistinct("verb_type").alias("n_verbs"))
    return tuned(sized, spec, ("n_items",)).join(n, "n_items").withColumn("log_items", F.log(c("n_items").cast("double")))


def calibration_by_verb(points: DataFrame, spec: str) -> DataFrame:
    """(verb_type, n_items, t, f1): the best threshold of each verb type by its own F1, with the chosen point's."""
    f1 = chosen(points, spec).select("verb_type", c("size").cast("bigint").alias("n_items"), "t", harmonic(c("precision"), c("recall")).alias("f1"))
    return best_threshold(f1, ["verb_type"])


def leaf_points(counts: DataFrame) -> DataFrame:
    """(verb_type, n_clusters, precision, recall, weight): the one point where every cluster of (verb_type, cluster,
    label, n) stands for itself, as for models that come from gold labels."""
    n = c("n")
    cell = counts.withColumns({"s": F.sum("n").over(Window.partitionBy("verb_type", "cluster")), "g": F.sum("n").over(Window.partitionBy("verb_type", "label"))})
    return cell.groupBy("verb_type").agg(F.countDistinct("cluster").alias("n_clusters"), (F.sum(n * n / c("s")) / F.sum(n)).alias("precision"), (F.sum(n * n / c("g")) / F.sum(n)).alias("recall"), F.sum(n).alias("weight"))


def curve(nodes: DataFrame, leaves: DataFrame, gold: DataFrame, limit: int = 1000, extra: DataFrame | None = None) -> DataFrame:
    """B-cubed points of the first `limit` cuts of trees against (instance, label); `extra` clusters (verb_type,
    instance, cluster) are part of every cut.

    A node adds the same to a cut's scores for as long as it lives, so each node is scored once, from its label counts,
    and running sums over births and deaths give all points.
    """
    never = 2**31 - 1
    held = leaves.join(gold, "instance").groupBy("verb_type", "leaf", "label").agg(F.count(F.lit(1)).cast("double").alias("n"))  # first by leaf, as each is below many nodes
    at = nodes.filter(c("born") < limit).select("verb_type", "node", F.explode(F.sequence("leaf_lo", "leaf_hi")).alias("leaf"))
    counts = at.join(held, ["verb_type", "leaf"]).groupBy("verb_type", "node", "label").agg(F.sum("n").alias("n"))
    out = leaves.select("verb_type", "instance")
    if extra is not None:
        out = out.unionByName(extra.select("verb_type", "instance"))
    whole = out.join(gold, "instance").groupBy("verb_type", "label").agg(F.count(F.lit(1)).cast("double").alias("g"))
    size = F.sum("n").over(Window.partitionBy("verb_type", "node"))
    cells = counts.withColumn("size", size).join(whole, ["verb_type", "label"])
    score = lambda df, keys: df.groupBy(*keys).agg(F.sum(c("n") * c("n") / c("size")).alias("p"), F.sum(c("n") * c("n") / c("g")).alias("r"), F.sum("n").alias("w"))
    node = score(cells, ["verb_type", "node"]).join(nodes.select("verb_type", "node", "born", "died"), ["verb_type", "node"])
    event = node.select("verb_type", c("born").alias("step"), "p", "r", "w").unionByName(node.filter((c("died") < limit) & (c("died") < never)).select("verb_type", c("died").alias("step"), -c("p"), -c("r"), -c("w")).toDF("verb_type", "step", "p", "r", "w"))
    if extra is not None:
        fixed = extra.join(gold, "instance").groupBy("verb_type", "cluster", "label").agg(F.count(F.lit(1)).cast("double").alias("n"))
        fixed = fixed.withColumn("size", F.sum("n").over(Window.partitionBy("verb_type", "cluster"))).join(whole, ["verb_type", "label"])
        event = event.unionByName(score(fixed, ["verb_type"]).select("verb_type", F.lit(0).alias("step"), "p", "r", "w"))
    summed = event.groupBy("verb_type", "step").agg(F.sum("p").alias("p"), F.sum("r").alias("r"), F.sum("w").alias("w"))
    run = Window.partitionBy("verb_type").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    points = summed.select("verb_type", "step", F.sum("p").over(run).alias("p"), F.sum("r").over(run).alias("r"), F.sum("w").over(run).alias("weight"))
    return trees.steps(nodes, limit).join(points, ["verb_type", "step"]).select("verb_type", "step", "n_clusters", "loss", "xlogx", "size", "top_loss", "wlogw", "weight_sum", (c("p") / c("weight")).alias("precision"), (c("r") / c("weight")).alias("recall"), "weight")


def model_points(nodes: DataFrame, leaves: DataFrame, gold: DataFrame, side: DataFrame | None, limit: int = 1000) -> DataFrame:
    """`curve` of a model; verb types without a tree have one point, of their side clusters alone."""
    points = curve(nodes, leaves, gold, limit, side)
    if side is None:
        return points
    bare = side.join(nodes.select("verb_type").distinct(), "verb_type", "left_anti").join(gold, "instance")
    n = bare.groupBy("verb_type", "cluster", "label").agg(F.count(F.lit(1)).cast("double").alias("n"))
    one = leaf_points(n).select("verb_type", "precision", "recall", "weight")
    empty = {"step": F.lit(0), "n_clusters": F.lit(0)} | {k: F.lit(0.0) for k in ("loss", "xlogx", "top_loss", "wlogw", "weight_sum")} | {"size": F.lit(0).cast("bigint")}
    return points.unionByName(one.withColumns(empty))


def linear_curve(counts: DataFrame, entropy: bool = False) -> DataFrame:
    """Points of the linear tree that joins clusters from the smallest up: at step t the t largest clusters stand alone
    and the rest are one. From (verb_type, cluster, label, n); a verb type has as many steps as clusters. Losses are 0, as
    in trees of labels, or with `entropy` those of the labels in each cluster.

    A cluster adds the same at every step from its rank on, and a label's count in the rest changes at the clusters that
    hold it, so running sums give all points without a row per step and cluster.
    """
    n = c("n").cast("double")
    xlogx = lambda x: F.when(x > 0, x * F.log(x)).otherwise(0.0)
    size = counts.groupBy("verb_type", "cluster").agg(F.sum("n").cast("double").alias("s"))
    order = Window.partitionBy("verb_type").orderBy(c("s").desc(), "cluster")
    ranked = size.withColumn("rank", F.row_number().over(order))
    label = Window.partitionBy("verb_type", "label")
    below = label.orderBy(c("rank").desc()).rowsBetween(Window.unboundedPreceding, 0)
    cell = counts.join(ranked, ["verb_type", "cluster"]).withColumns({"g": F.sum(n).over(label), "with": F.sum(n).over(below)}).withColumn("left", c("with") - n)
    gone = lambda f: f(c("left")) - f(c("with"))  # what the rest loses of a label at this rank
    square = lambda x: x * x
    at = cell.groupBy("verb_type", "rank").agg(
        F.max("s").alias("s"), F.sum(n * n / c("s")).alias("p"), F.sum(n * n / c("g")).alias("r"), F.sum(xlogx(n)).alias("e"),
        F.sum(gone(square)).alias("rest_p"), F.sum(gone(square) / c("g")).alias("rest_r"), F.sum(gone(xlogx)).alias("rest_e"),
    )
    whole = cell.select("verb_type", "label", "g").distinct().groupBy("verb_type").agg(F.sum("g").alias("s"), F.sum(square(c("g"))).alias("rest_p"), F.sum("g").alias("rest_r"), F.sum(xlogx(c("g"))).alias("rest_e"))
    start = whole.select("verb_type", F.lit(0).alias("rank"), F.lit(0.0).alias("s"), F.lit(0.0).alias("p"), F.lit(0.0).alias("r"), F.lit(0.0).alias("e"), "rest_p", "rest_r", "rest_e")
    events = start.unionByName(at).join(whole.select("verb_type", c("s").alias("total")), "verb_type")
    run = Window.partitionBy("verb_type").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    own = F.when(c("s") > 0, (xlogx(c("s")) - c("e")) / c("s"))
    sums = events.select(
        "verb_type", c("rank").alias("step"), "total", (c("total") - F.sum("s").over(run)).alias("rest"), F.sum("p").over(run).alias("p"), F.sum("r").over(run).alias("r"), F.sum(xlogx(c("s"))).over(run).alias("xlogx"),
        F.sum("e").over(run).alias("e"), F.sum("rest_p").over(run).alias("rest_p"), F.sum("rest_r").over(run).alias("rest_r"), F.sum("rest_e").over(run).alias("rest_e"), F.max(own).over(run).alias("top"),
    ).filter("rest > 0")  # at the last rank nothing is left: that is the step before
    points = sums.withColumns({"xlogx": c("xlogx") + xlogx(c("rest")), "rest_loss": xlogx(c("rest")) - c("rest_e")})
    loss = c("xlogx") - c("e") - c("rest_e") if entropy else F.lit(0.0)
    top = F.greatest(c("top"), c("rest_loss") / c("rest")) if entropy else F.lit(0.0)
    w = c("total")
    return points.select(
        "verb_type", c("step").cast("bigint").alias("step"), (c("step") + 1).cast("bigint").alias("n_clusters"), loss.alias("loss"), "xlogx", w.alias("size"), top.alias("top_loss"), c("xlogx").alias("wlogw"), w.alias("weight_sum"),
        ((c("p") + c("rest_p") / c("rest")) / w).alias("precision"), ((c("r") + c("rest_r")) / w).alias("recall"), w.alias("weight"),
    )
