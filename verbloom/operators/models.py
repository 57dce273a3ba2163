"""Model strings, the terms they name, baselines, and the clustering of remaining arguments."""

from __future__ import annotations

import re
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verbloom.functions import lexicon
from verbloom.operators import flat
from verbloom.operators import tree as trees
from verbloom.session import cut, dropped, written

c = F.col

_MODES = ("masked", "repeated", "symm_both", "symm_left", "symm_right")
#: Names of terms, baselines, side flags and presets as they stand in model strings.
ARG_TERMS = ("noop", "qent", "qent_active", "qent_argadj", "qent_nohow", "qent_argadj_nohow", "qent_nadv", "pent", "syntf", "syntf2", "syntc", "syntc2", "prep", "dv") + tuple(f"{k}_mlm_{m}" for k in ("head", "prep", "span") for m in _MODES)
VERB_TERMS = ("noop",) + tuple(f"mlm_{m}" for m in _MODES)
ARG_BASELINES = ("syntf", "syntf2", "gold_nosense", "gold_wsense", "gold_nosense+noise", "gold_wsense+noise", "random", "random_linear", "random_weighted")
VERB_BASELINES = ("gold", "gold+uniform_noise", "gold+weighted_noise", "random", "random_linear", "random_weighted")
SIDE_FLAGS = {"m": "modal", "n": "negation", "a": "adjunct", "d": "discourse", "s": "syntf", "c": "syntf2", "g": "gold_nosense", "r": "gold_wsense"}


@dataclass(frozen=True)
class Model:
    """A parsed model; `kind` is part of its key, so a baseline and a full model of the same name stay apart."""

    index: str  # arg, verb or joint
    kind: str  # baseline or full
    terms: dict[str, float] = field(default_factory=dict)
    side: frozenset[str] = frozenset()

    @property
    def key(self) -> str:
        terms = "+".join(f"{t}*{w:g}" if len(self.terms) > 1 else t for t, w in sorted(self.terms.items()))
        side = "".join(k for k, v in SIDE_FLAGS.items() if v in self.side)
        return f"{self.index}/{self.kind}/{side + '->' if side else ''}{terms}"


def side_flags(text: str) -> frozenset[str]:
    """The rules named by flag letters; of s and c only s holds, of g and r only g. Unknown letters name nothing."""
    flags = set(text) & set(SIDE_FLAGS)
    if "s" in flags:
        flags.discard("c")
    if "g" in flags:
        flags.discard("r")
    return frozenset(SIDE_FLAGS[f] for f in flags)


def weighted_terms(text: str, known: tuple[str, ...]) -> dict[str, float]:
    """`term*w+term`: weights over their sum, to 2 digits; a term without weight has 1."""
    terms: dict[str, float] = {}
    for part in filter(None, text.split("+")):
        m = re.fullmatch(r"([a-z0-9_]+)(?:\*([0-9.]+))?", part)
        if not m or m[1] not in known:
            raise ValueError(f"no term {part!r}")
        terms[m[1]] = terms.get(m[1], 0.0) + float(m[2] or 1)
    total = sum(terms.values())
    if not total:
        raise ValueError("a model needs a term")
    return {t: round(w / total, 2) for t, w in terms.items()}


def parse(text: str) -> Model:
    """arg/..., verb/... or joint/..., with side flags and -> in front of argument terms. Baselines are tried first; a
    trailing + makes a baseline's name a full model."""
    index, _, rest = text.partition("/")
    if index not in ("arg", "verb", "joint"):
        raise ValueError(f"no model {text!r}")
    flags, arrow, spec = rest.partition("->") if "->" in rest else ("", "", rest)
    side = side_flags(flags)
    if index == "arg" and spec in ARG_BASELINES:
        return Model("arg", "baseline", {spec: 1.0}, side)
    if index == "verb" and spec in VERB_BASELINES:
        return Model("verb", "baseline", {spec: 1.0}, side)
    known = VERB_TERMS if index == "verb" else ARG_TERMS if index == "arg" else ARG_TERMS + VERB_TERMS
    return Model(index, "full", weighted_terms(spec, known), side)


#: The default cut of the browser: one verb cluster, entropy weight for arguments.
DEFAULT_CUT = {"verb_clusters": 1, "arg_entropy": 0.35}


#: Model strings offered by name in the browser.
PRESETS = {
    "SyntF": "arg/s->noop", "SyntF + lex": "arg/mnds->noop", "SyntF + pass->act": "arg/c->noop", "SyntF + all rules": "arg/mndc->noop",
    "HUM-QQ": "arg/qent+dv", "HUM-QQ + lex": "arg/mnd->qent+dv", "Gold": "arg/g->noop", "Gold + sense": "arg/r->noop",
}

_ADVERBIAL = r"^(how much|how long|how|when|where|why) "


def term_distribution(term: str, features: dict[str, DataFrame]) -> DataFrame:
    """The distribution (verb_type, instance, item, value) that a term clusters by, from named features of that shape:
    questions, active_questions, adjuncts (instance, is_adjunct), constituents, functions, converted functions,
    prepositions, and mlm vectors in long form by `<kind>_mlm_<mode>`."""
    q = lambda name: features[name]
    how = lambda d: d.withColumn("value", F.when(c("item").startswith("how "), c("value") / 100).otherwise(c("value")))

    def adjunct(d: DataFrame) -> DataFrame:
        mark = q("adjuncts").select("verb_type", "instance", F.when(c("is_adjunct"), "adj:").otherwise("arg:").alias("_m"))
        return d.join(mark, ["verb_type", "instance"]).withColumn("item", F.concat("_m", "item")).drop("_m")

    named = {
        "qent": lambda: q("questions"), "qent_active": lambda: q("active_questions"), "qent_argadj": lambda: adjunct(q("questions")), "qent_nohow": lambda: how(q("questions")),
        "qent_argadj_nohow": lambda: adjunct(how(q("questions"))), "pent": lambda: q("constituents"), "syntf": lambda: q("functions"), "syntf2": lambda: q("converted_functions"),
        "syntc": lambda: q("constituents"), "syntc2": lambda: q("converted_constituents"), "prep": lambda: q("prepositions"),
        "qent_nadv": lambda: q("questions").withColumn("item", F.regexp_replace("item", _ADVERBIAL, "how ")).groupBy("verb_type", "instance", "item").agg(F.sum("value").alias("value")),
    }
    if term in named:
        return named[term]()
    if "mlm_" in term:  # vectors of arguments, or of verbs (mlm_<mode>)
        return q(term)
    raise ValueError(f"{term} has no distribution")  # noop and dv: see costs


def costs(model: Model, features: dict[str, DataFrame]) -> tuple[DataFrame | None, trees.Terms]:
    """The terms of a model: their rows (verb_type, instance, item, value, term), and what each costs. `noop` has no rows
    and costs nothing; `dv` has the verb of each instance (`verbs`: verb_type, instance, verb) and costs a pair of
    arguments of one verb; all others have a distribution and cost its entropy."""
    rows, kinds = None, []
    for k, (term, weight) in enumerate(model.terms.items()):
        if term == "noop":
            kinds.append(("none", weight))
            continue
        if term == "dv":
            own = features["verbs"].select("verb_type", "instance", c("verb").cast("string").alias("item"), F.lit(1.0).alias("value"))
        else:
            own = term_distribution(term, features).select("verb_type", "instance", c("item").cast("string").alias("item"), c("value").cast("double").alias("value"))
        kinds.append(("pairs" if term == "dv" else "entropy", weight))
        own = own.withColumn("term", F.lit(k))
        rows = own if rows is None else rows.unionByName(own)
    return rows, tuple(kinds)


def argument_model(model: Model, features: dict[str, DataFrame], side: DataFrame | None = None, **options) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(nodes, leaves, side clusters): side clusters (verb_type, instance, cluster) come out first, the remaining
    `instances` (verb_type, instance) are clustered by the model's terms. Without `instances` those of the terms count."""
    rows, kinds = costs(model, features)
    if "instances" in features:
        every = features["instances"].select("verb_type", "instance").distinct()
        plain = every.select("verb_type", "instance", F.lit("<none>").alias("item"), F.lit(1.0).alias("value"), F.lit(len(kinds)).alias("term"))
        rows = plain if rows is None else rows.join(every, ["verb_type", "instance"], "left_semi").unionByName(plain.join(rows.select("verb_type", "instance").distinct(), ["verb_type", "instance"], "left_anti"))
        if not any(kind == "entropy" for kind, _ in kinds):  # flat clusters need an item of each instance
            rows = rows.filter(c("term") < len(kinds)).unionByName(plain)
    if side is not None:
        rows = rows.join(side.select("verb_type", "instance").distinct(), ["verb_type", "instance"], "left_anti")
    return *hybrid_model(rows, terms=kinds, **options), side


def run(text: str, features: dict[str, DataFrame], seed: int = 0) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """The model of a string over its features: (nodes, leaves, side clusters). `features` has what the terms need (see
    term_distribution and costs), `instances`, and for side rules and baselines `sides` (verb_type, instance, text,
    function, converted, role, sense). Models of verbs have the verbs as instances and their senses in `sides`."""
    model, side = parse(text), None
    if model.index == "joint":
        raise ValueError("joint models are clustered by agglom.joint")
    named = lambda label: features["sides"].select("verb_type", "instance", label.alias("cluster")).filter("cluster IS NOT NULL")
    if model.side:
        side = cut(named(side_label(model.side, *(c(k) for k in ("text", "function", "converted", "role", "sense")))))
    if model.kind == "full":
        return argument_model(model, features, side, seed=seed)
    setting = next(iter(model.terms))
    rest = features["instances"] if side is None else features["instances"].join(side, ["verb_type", "instance"], "left_anti")
    if setting in ("random", "random_weighted"):
        return *trees.random_trees(rest, seed, setting == "random_weighted"), side
    if model.index == "verb":
        own = named(c("sense")) if setting.startswith("gold") else named(c("instance").cast("string"))
        own = own.join(rest.select("verb_type", "instance"), ["verb_type", "instance"], "left_semi")
        if setting.endswith("_noise"):
            own = noisy(own.withColumnRenamed("cluster", "label"), 0.1, seed, setting == "gold+uniform_noise").withColumnRenamed("label", "cluster")
        return *label_trees(own), side
    labels = {"syntf": c("function"), "syntf2": c("converted"), "gold_nosense": c("role"), "gold_wsense": F.concat_ws(".", "sense", "role"), "random_linear": c("instance").cast("string")}
    own = named(labels[setting.removesuffix("+noise")]).join(rest.select("verb_type", "instance"), ["verb_type", "instance"], "left_semi")
    if setting.endswith("+noise"):
        own = noisy(own.withColumnRenamed("cluster", "label"), 0.1, seed).withColumnRenamed("label", "cluster")
    return *label_trees(own), side


def label_trees(clusters: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, leaves) of linear trees at no loss whose leaves are the labels of (verb_type, instance, cluster), joined in
    the order of label_tree; step k of their lives splits off the k-th label from the end."""
    order = label_tree(clusters.withColumnRenamed("cluster", "label")).withColumn("k", F.max("step").over(Window.partitionBy("verb_type")))
    last = 2**31 - 1
    whole = lambda **x: [v.cast("int").alias(k) for k, v in x.items()]
    # leaves are nodes 0..k-1 in order; the merge of the labels up to step j (from 2) is node k + j - 2
    leaf = order.select(
        "verb_type", *whole(node=c("step") - 1, parent=F.when(c("k") == 1, -1).otherwise(c("k") + F.greatest(c("step"), F.lit(2)) - 2), left=F.lit(-1), right=F.lit(-1)), F.lit(0.0).alias("loss"), c("n").alias("size"),
        *whole(depth=F.when(c("k") == 1, 0).otherwise(c("k") - F.greatest(c("step"), F.lit(2)) + 1), leaf_lo=c("step") - 1, leaf_hi=c("step") - 1, born=F.when(c("k") == 1, 0).otherwise(c("k") - F.greatest(c("step"), F.lit(2)) + 1), died=F.lit(last)),
    )
    merge = order.filter("step >= 2").select(
        "verb_type", *whole(node=c("k") + c("step") - 2, parent=F.when(c("step") == c("k"), -1).otherwise(c("k") + c("step") - 1), left=F.when(c("step") == 2, 0).otherwise(c("k") + c("step") - 3), right=c("step") - 1), F.lit(0.0).alias("loss"), c("n_below").alias("size"),
        *whole(depth=c("k") - c("step"), leaf_lo=F.lit(0), leaf_hi=c("step") - 1, born=c("k") - c("step"), died=c("k") - c("step") + 1),
    )
    leaves = clusters.join(order.select("verb_type", c("label").alias("cluster"), (c("step") - 1).cast("int").alias("leaf")), ["verb_type", "cluster"]).select("verb_type", "leaf", "instance")
    return cut(leaf.unionByName(merge)), cut(leaves)


def side_label(side: frozenset[str], text: Column, function: Column, converted: Column, role: Column, sense: Column) -> Column:
    """The side cluster of an argument, null for none: of the rules in `side` the first that fits, in the order modal,
    negation, discourse, adjunct, syntactic function, converted function, role, role with sense. The first three look at
    the `text` of an argument with one span (null otherwise), in lower case; adjuncts are told by their `function`."""
    rules = {
        "modal": F.when(text.isin(*lexicon.MODALS), "MODAL"), "negation": F.when(text.isin(*lexicon.NEGATIONS), "NEG"), "discourse": F.when(text.isin(*lexicon.DISCOURSE), "DIS"),
        "adjunct": F.when(function.isin(*lexicon.ADJUNCT_FUNCTIONS), function), "syntf": function, "syntf2": converted, "gold_nosense": role, "gold_wsense": F.concat_ws(".", sense, role),
    }
    return F.coalesce(*[rule for name, rule in rules.items() if name in side], F.lit(None).cast("string"))


def frames(verb_clusters: DataFrame, arg_clusters: DataFrame, verb_of: DataFrame) -> DataFrame:
    """Roles within frames: (verb_type, frame, role, instance), from clusters of verbs, clusters of arguments and the verb
    of each argument. A role is an argument cluster seen from one verb cluster."""
    v = verb_clusters.select("verb_type", c("instance").alias("verb"), c("cluster").alias("frame"))
    return arg_clusters.join(verb_of, "instance").join(v, ["verb_type", "verb"]).select("verb_type", "frame", c("cluster").alias("role"), "instance")


# --- baselines


def label_tree(labels: DataFrame) -> DataFrame:
    """Linear trees over labels: (verb_type, step, label, n, n_below): leaf `step` is the label of that place when labels
    are sorted by growing count over all verb types (ties by label); its merge holds all n_below members up to it."""
    whole = labels.groupBy("label").agg(F.count(F.lit(1)).alias("all"))
    n = labels.groupBy("verb_type", "label").agg(F.count(F.lit(1)).alias("n")).join(whole, "label")
    w = Window.partitionBy("verb_type").orderBy("all", "label")
    return n.select("verb_type", F.row_number().over(w).cast("bigint").alias("step"), "label", "n", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("n_below"))


def balanced_tree(items: DataFrame, key: str, order: str) -> DataFrame:
    """(key, level, place, lo, hi): nodes of binary trees of equal parts over items in order; level 0 are the leaves."""
    w = Window.partitionBy(key).orderBy(order)
    at = items.select(key, (F.row_number().over(w) - 1).alias("i")).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(key)))
    top = F.ceil(F.log2(c("n").cast("double"))).cast("int")
    rows = at.withColumn("level", F.explode(F.sequence(F.lit(0), top))).withColumn("place", F.floor(c("i") / F.pow(F.lit(2.0), "level")))
    return rows.groupBy(key, "level", "place").agg(F.min("i").cast("bigint").alias("lo"), F.max("i").cast("bigint").alias("hi"))


def noisy(labels: DataFrame, share: float, seed: int, uniform: bool = False) -> DataFrame:
    """Labels with a `share` of them replaced by one drawn from the labels' distribution, or any label alike."""
    unit = lambda salt: F.pmod(F.xxhash64("verb_type", "instance", F.lit(seed), F.lit(salt)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    n = labels.groupBy("label").agg(F.count(F.lit(1)).alias("n")).withColumn("n", F.lit(1) if uniform else c("n"))
    w = Window.orderBy("label")  # a row per label
    hi = F.sum("n").over(w) / F.sum("n").over(Window.partitionBy())
    edges = n.select(c("label").alias("drawn"), hi.alias("hi")).withColumn("lo", F.coalesce(F.lag("hi").over(Window.orderBy("drawn")), F.lit(0.0)))
    # labels and draws meet in buckets of the unit interval: an edge is in each bucket that it touches
    size = 256
    touched = edges.withColumn("bucket", F.explode(F.sequence(F.floor(c("lo") * size), F.floor(c("hi") * size))))
    rows = labels.withColumns({"u": unit(1), "v": unit(2)}).withColumn("bucket", F.floor(c("v") * size))
    again = rows.filter(c("u") > 1 - share).join(touched, "bucket").filter((c("lo") <= c("v")) & (c("v") < c("hi")))
    return rows.filter(c("u") <= 1 - share).select(*labels.columns).unionByName(again.withColumn("label", c("drawn")).select(*labels.columns))


def random_clusters(instances: DataFrame, k: int, seed: int) -> DataFrame:
    """(verb_type, instance, cluster): one of k clusters by a seeded hash."""
    return instances.select("verb_type", "instance", F.pmod(F.xxhash64("verb_type", "instance", F.lit(seed)), F.lit(k)).cast("string").alias("cluster"))


# --- full models


def hybrid_model(dist: DataFrame, alpha: float = 0.01, task_limit: int = 500_000, task_entries: int = 8_000_000, flat_clusters: int = 100, seed: int = 0, terms: trees.Terms = trees.ENTROPY) -> tuple[DataFrame, DataFrame]:
    """(nodes, leaves) of the hybrid clustering of verb types of any size: those up to `task_limit` instances and
    `task_entries` rows within a task each (some 40 bytes a row); larger ones get the same flat clusters by jobs, of
    several verb types at a time, which are then agglomerated as sets of their members. `dist` may have a column `term`
    for several `terms`."""
    dist, path = written(trees.with_term(dist, terms))
    size = dist.groupBy("verb_type").agg(F.countDistinct("instance").alias("n"), F.count(F.lit(1)).alias("entries"))
    size = size.filter((c("n") > task_limit) | (c("n") > flat_clusters) & (c("entries") > task_entries))
    large = [r[0] for r in size.select("verb_type").collect()]  # few: each has more than task_limit instances or task_entries rows
    small = dist.filter(~F.coalesce(c("verb_type").isin(large), F.lit(False))) if large else dist
    nodes, leaves = trees.clustered(small, alpha, seed=seed, flat_clusters=flat_clusters, terms=terms)
    if not large:
        dropped(dist.sparkSession, path)
        return nodes, leaves
    plain = terms if any(kind == "entropy" for kind, _ in terms) else (*terms, ("entropy", 1.0))

    def sets_of(name: object) -> DataFrame:
        own = flat.Blocks(trees.flat_items(dist.filter(c("verb_type") == F.lit(name)), plain)).sets(flat_clusters, alpha, seed)
        return cut(own.select(F.lit(name).alias("verb_type"), "instance", "set"))

    with ThreadPoolExecutor(4) as pool:  # jobs are short, so several verb types share the executors
        at = reduce(DataFrame.unionByName, pool.map(sets_of, large))
    n = at.groupBy("verb_type", "set").agg(F.count(F.lit(1)).alias("members"))
    sets = dist.join(at, ["verb_type", "instance"]).groupBy("verb_type", "set", "term", "item").agg(F.sum("value").alias("value")).join(n, ["verb_type", "set"])
    top, inner = trees.clustered(sets.withColumnRenamed("set", "instance"), alpha, seed=seed, limit=flat_clusters, terms=terms)
    dropped(dist.sparkSession, path)  # all trees are written
    members = inner.withColumnRenamed("instance", "set").join(at, ["verb_type", "set"]).select("verb_type", "leaf", "instance")
    return nodes.unionByName(top), leaves.unionByName(members)
