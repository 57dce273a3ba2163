"""Syntactic features, tree operators and agglomeration kernels over stand-in parses and trees that SQL can build too.

The tables hold no parses: a sentence's tokens form a heap (the head of token i is (i + 1) div 2 - 1), labels follow from
positions and tags from the tokens. Trees are balanced ones over the suppliers of a nation, with the squared number of
leaves as loss, so that nodes are split by falling size.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verbloom.operators import agglom, models, relate, syntax, tuning
from verbloom.operators import tree as trees
from verbloom.plans import features as f
from verbloom.plans import surrogate as s
from verbloom.session import cut, table

c = F.col
_LABELS = ("SBJ", "OBJ", "LGS", "PMOD", "IM", "VC")


def parsed(spark: SparkSession, d: str) -> DataFrame:
    """(sentence_id, idx, token, lemma, pos, dep_head, dep_label) of every sentence."""
    t = f.sentences(spark, d).select("sentence_id", F.posexplode("sentence_tokens").alias("idx", "token")).withColumn("token", F.coalesce("token", F.lit("")))
    word = F.lower("token")
    pos = F.when(word == "to", "TO").when(word.isin("in", "on", "at", "by", "for", "from", "with", "of"), "IN").when(word.endswith("ed"), "VBN").when(word.endswith("ly"), "RB").otherwise("NN")
    lemma = F.when(word.isin("is", "was", "were", "are", "been"), "be").otherwise(word)
    label = F.element_at(F.array(*map(F.lit, _LABELS)), (c("idx") % len(_LABELS) + 1).cast("int"))
    return t.select("sentence_id", "idx", "token", lemma.alias("lemma"), pos.alias("pos"), (F.floor((c("idx") + 1) / 2) - 1).cast("int").alias("dep_head"), label.alias("dep_label"))


def _arguments(spark: SparkSession, d: str) -> DataFrame:
    """Labelled arguments by their first token: (sentence_id, verb_index, idx)."""
    return f.roles(spark, d).select("sentence_id", "verb_index", c("b").alias("idx")).distinct()


def syntax_passives(spark: SparkSession, d: str) -> DataFrame:
    return syntax.passives(parsed(spark, d)).groupBy("sentence_id").agg(F.count(F.lit(1)).alias("n"), F.sum("idx").alias("places"))


def syntax_functions(spark: SparkSession, d: str) -> DataFrame:
    """Functions of arguments as they are, and in the active voice."""
    t = cut(parsed(spark, d))
    plain = syntax.functions(_arguments(spark, d), t)
    active = syntax.functions(_arguments(spark, d), t, active=True).withColumnRenamed("function", "active")
    return plain.join(active, ["sentence_id", "verb_index", "idx"])


def syntax_heads(spark: SparkSession, d: str) -> DataFrame:
    """Semantic heads and prepositions of arguments."""
    t = cut(parsed(spark, d))
    out = syntax.prepositions(syntax.heads(_arguments(spark, d), t), t)
    return out.select("sentence_id", "verb_index", "idx", "head_idx", "prep")


def syntax_ancestors(spark: SparkSession, d: str) -> DataFrame:
    """How many tokens are above each token, and how far the highest is."""
    paths = syntax.closures(parsed(spark, d))
    return paths.groupBy("sentence_id", "idx").agg(F.count(F.lit(1)).alias("n"), F.max("distance").cast("bigint").alias("depth"))


def syntax_spans(spark: SparkSession, d: str) -> DataFrame:
    """The interval of every token and all below it."""
    return syntax.spans(syntax.closures(parsed(spark, d)))


def syntax_paths(spark: SparkSession, d: str) -> DataFrame:
    """Lowest common ancestor of each argument and its verb, and the steps between them."""
    pairs = _arguments(spark, d).select("sentence_id", c("verb_index").alias("a"), c("idx").alias("b")).distinct()
    out = syntax.lowest_common(syntax.closures(parsed(spark, d)), pairs)
    return out.select("sentence_id", "a", "b", "ancestor", c("steps").cast("bigint").alias("steps"))


def aligned_sentences(spark: SparkSession, d: str) -> DataFrame:
    """Sentences matched to the first one of the same text without blanks and case, by the rendered tokens."""
    t = f.sentences(spark, d).filter(F.size("sentence_tokens") > 0)
    left = t.select("sentence_id", F.array_join("sentence_tokens", "  ").alias("text"))
    right = t.select(c("sentence_id").alias("other_id"), F.upper(F.array_join("sentence_tokens", " ")).alias("text"))
    return relate.aligned(left, right, "sentence_id", "other_id")


def leading_words(spark: SparkSession, d: str) -> DataFrame:
    """The lower-case words that a sentence begins with, up to the first other token."""
    t = parsed(spark, d)
    return relate.while_true(t, ["sentence_id"], [c("idx")], c("token").rlike("^[a-z]+$") | (c("idx") == 0)).groupBy("sentence_id").agg(F.count(F.lit(1)).alias("n"))


# --- trees


def _balanced(n: int) -> agglom.Tree:
    """Neighbours joined level by level; the loss of a node is the square of its leaves."""
    tree, level, size = agglom.Tree(n, [1.0] * n), list(range(n)), [1] * n
    while len(level) > 1:
        up, counts = [], []
        for k in range(0, len(level) - 1, 2):
            tree.merges.append((level[k], level[k + 1], float((size[k] + size[k + 1]) ** 2)))
            up.append(n + len(tree.merges) - 1)
            counts.append(size[k] + size[k + 1])
        level, size = up + level[len(level) - len(level) % 2 :], counts + size[len(size) - len(size) % 2 :]
    return tree


def heap_trees(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, leaves): a tree per nation over its suppliers in order."""
    rows = table(spark, d, "supplier").select(c("s_nationkey").cast("string").alias("verb_type"), c("s_suppkey").cast("bigint").alias("instance"))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = np.sort(pdf["instance"].to_numpy())
        return trees._tables(trees.frame(pdf["verb_type"].iloc[0], _balanced(len(ids)), [1.0] * len(ids)), np.arange(len(ids)), ids)

    return trees._split(rows.groupBy("verb_type").applyInPandas(build, trees._BOTH))


def tree_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Intervals, sizes, depths and lives of all nodes."""
    nodes, _ = heap_trees(spark, d)
    return nodes.select("verb_type", "leaf_lo", "leaf_hi", "size", "loss", "depth", "born", "died")


def tree_steps(spark: SparkSession, d: str) -> DataFrame:
    """What each cut of the trees holds."""
    return s.rounded(trees.steps(heap_trees(spark, d)[0], 1000).select("verb_type", "step", "n_clusters", "loss", "xlogx", "size", "top_loss"))


def tree_cut_number(spark: SparkSession, d: str) -> DataFrame:
    nodes, leaves = heap_trees(spark, d)
    at = trees.cut_at(nodes.join(trees.number_cut(nodes, 3), "verb_type"), leaves, c("step"))
    return at.groupBy("verb_type", "cluster").agg(F.count(F.lit(1)).alias("n"), F.min("instance").alias("first")).drop("cluster")


def tree_cut_at_most(spark: SparkSession, d: str) -> DataFrame:
    nodes, leaves = heap_trees(spark, d)
    at = trees.cut_at(nodes.join(trees.at_most_cut(nodes, 3), "verb_type"), leaves, c("step"))
    return at.groupBy("verb_type", "cluster").agg(F.count(F.lit(1)).alias("n"), F.min("instance").alias("first")).drop("cluster")


def tree_cut_entropy(spark: SparkSession, d: str) -> DataFrame:
    """The step of the smallest loss with a weight of 4 on the mixing entropy."""
    return trees.entropy_cut(heap_trees(spark, d)[0], 4.0)


def tree_top(spark: SparkSession, d: str) -> DataFrame:
    """The trees down to depth 2: which nodes are leaves of it."""
    nodes = trees.depth_limited(heap_trees(spark, d)[0], 2)
    return nodes.select("verb_type", "leaf_lo", "leaf_hi", "depth", (c("left") < 0).alias("is_leaf"))


def tree_path(spark: SparkSession, d: str) -> DataFrame:
    """The nodes above the third leaf of each tree."""
    return trees.path_to(heap_trees(spark, d)[0], 2).select("verb_type", "depth", "leaf_lo", "leaf_hi")


def tree_sums(spark: SparkSession, d: str) -> DataFrame:
    """Balances (in cents) summed over the members of every node."""
    nodes, leaves = heap_trees(spark, d)
    cents = table(spark, d, "supplier").select(c("s_suppkey").cast("bigint").alias("instance"), F.round(c("s_acctbal").cast("double") * 100).cast("bigint").alias("cents"))
    sums = trees.leaf_fold(nodes, leaves.join(cents, "instance"), F.sum("cents"), "cents")
    return sums.join(nodes, ["verb_type", "node"]).select("verb_type", "leaf_lo", "leaf_hi", "cents")


def tree_weights(spark: SparkSession, d: str) -> DataFrame:
    """Weights of all nodes from weights of members."""
    nodes, leaves = heap_trees(spark, d)
    weights = leaves.select("verb_type", "instance", (c("instance") % 7).cast("double").alias("weight"))
    return trees.weighted(nodes, leaves, weights).select("verb_type", "leaf_lo", "leaf_hi", "weight")


def tree_filtered(spark: SparkSession, d: str) -> DataFrame:
    """Trees cut down to members with an odd number, with losses computed anew as the entropy of their residues modulo
    3: number of nodes and the loss of the root."""
    rows = table(spark, d, "supplier").select(c("s_nationkey").cast("string").alias("verb_type"), c("s_suppkey").cast("bigint").alias("instance"))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = np.sort(pdf["instance"].to_numpy())
        keep = {i for i, x in enumerate(ids.tolist()) if x % 2}
        if not keep:
            return pd.DataFrame(columns=["verb_type", "n_nodes", "loss"])
        counts = np.zeros((len(ids), 3))
        counts[np.arange(len(ids)), ids % 3] = 1
        out = trees.re_merged(_balanced(len(ids)), keep, [agglom.min_entropy(counts)])
        back, values = trees.from_json(trees.to_json(out))
        assert sorted(values) == list(range(out.n)) and len(back.merges) == len(out.merges)
        root = out.roots()[0]
        return pd.DataFrame({"verb_type": [pdf["verb_type"].iloc[0]], "n_nodes": [out.n + len(out.merges)], "loss": [out.loss(root)]})

    return s.rounded(rows.groupBy("verb_type").applyInPandas(build, "verb_type string, n_nodes bigint, loss double"))


# --- kernels


def kernel_roots(spark: SparkSession, d: str) -> DataFrame:
    """The losses of whole nations' suppliers at the roots of the agglomerations: complete linkage of balances, squared
    distance to the mean, repeated residues modulo 4, and all of them weighted."""
    rows = table(spark, d, "supplier").select(c("s_nationkey").cast("bigint").alias("nation"), c("s_suppkey").cast("bigint").alias("instance"), c("s_acctbal").cast("double").alias("x"))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("instance")
        x = pdf["x"].to_numpy() / 1000
        keys = np.zeros((len(x), 4))
        keys[np.arange(len(x)), pdf["instance"].to_numpy() % 4] = 1
        linkage = agglom.complete_linkage(np.abs(x[:, None] - x[None, :]))
        single = [agglom.agglomerate([t]) for t in (agglom.vector_mean(x[:, None]), agglom.repeated_keys(keys))]
        both = agglom.agglomerate([agglom.vector_mean(x[:, None], weight=0.25), agglom.repeated_keys(keys, weight=0.75)])
        root = lambda t: t.loss(t.roots()[0])
        assert all(len(t.merges) == len(x) - 1 for t in (linkage, *single, both))
        return pd.DataFrame({"nation": [pdf["nation"].iloc[0]], "n": [len(x)], "linkage": [root(linkage)], "spread": [root(single[0])], "repeated": [root(single[1])], "weighted": [root(both)]})

    return s.rounded(rows.groupBy("nation").applyInPandas(build, "nation bigint, n bigint, linkage double, spread double, repeated double, weighted double"))


def entropy_tree_roots(spark: SparkSession, d: str) -> DataFrame:
    """What has to hold of the entropy trees: the root has all instances and the loss of the summed distribution, merges
    don't lower losses, and the leaves cover every instance once."""
    nodes, leaves = (cut(x) for x in models.hybrid_model(s.dist(spark, d)))
    kids = nodes.filter("parent >= 0").groupBy("verb_type", c("parent").alias("node")).agg(F.sum("loss").alias("below"))
    ok = nodes.join(kids, ["verb_type", "node"], "left").groupBy("verb_type").agg(F.min((c("loss") >= F.coalesce("below", F.lit(0.0)) - 1e-4).cast("int")).alias("grows"))
    held = leaves.groupBy("verb_type").agg(F.countDistinct("instance").alias("instances"), F.count(F.lit(1)).alias("rows"))
    root = nodes.filter("parent < 0").select("verb_type", "size", "loss")
    out = root.join(ok, "verb_type").join(held, "verb_type")
    return out.select("verb_type", "size", F.round("loss", 3).alias("loss"), (c("grows") == 1).alias("grows"), "instances", (c("rows") == c("instances")).alias("once"))


def entropy_curve_start(spark: SparkSession, d: str) -> DataFrame:
    """The first point of the entropy trees' curves: everything in one cluster."""
    nodes, leaves = (cut(x) for x in models.hybrid_model(s.dist(spark, d)))
    points = tuning.curve(nodes, leaves, s.gold(spark, d)).filter("step = 0")
    return points.select("verb_type", "n_clusters", "size", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), F.round("top_loss", 4).alias("top_loss"))


_NAMES = (syntax_passives, syntax_functions, syntax_heads, syntax_ancestors, syntax_spans, syntax_paths, aligned_sentences, leading_words, tree_nodes, tree_steps, tree_cut_number, tree_cut_at_most, tree_cut_entropy, tree_top, tree_path, tree_sums, tree_weights, tree_filtered, kernel_roots, entropy_tree_roots, entropy_curve_start)
QUERIES = {g.__name__: g for g in _NAMES}

_PARSED = f"""{f.SENTENCES}, tok AS (SELECT sentence_id, generate_subscripts(sentence_tokens, 1) - 1 AS idx, coalesce(unnest(sentence_tokens), '') AS token FROM sentences),
    parse AS (SELECT sentence_id, idx::INTEGER AS idx, token, CASE WHEN lower(token) IN ('is', 'was', 'were', 'are', 'been') THEN 'be' ELSE lower(token) END AS lemma,
        CASE WHEN lower(token) = 'to' THEN 'TO' WHEN lower(token) IN ('in', 'on', 'at', 'by', 'for', 'from', 'with', 'of') THEN 'IN' WHEN lower(token) LIKE '%ed' THEN 'VBN' WHEN lower(token) LIKE '%ly' THEN 'RB' ELSE 'NN' END AS pos,
        ((idx + 1) // 2 - 1)::INTEGER AS head, ['SBJ', 'OBJ', 'LGS', 'PMOD', 'IM', 'VC'][(idx % 6 + 1)::INTEGER] AS label FROM tok),
    arg AS (SELECT DISTINCT sentence_id, verb_index, b AS idx FROM roles),
    passive AS (SELECT sentence_id, head AS idx FROM parse WHERE label = 'LGS' AND head >= 0
        UNION SELECT k.sentence_id, k.idx FROM parse k JOIN parse h ON h.sentence_id = k.sentence_id AND h.idx = k.head WHERE k.pos = 'VBN' AND k.label = 'VC' AND h.lemma = 'be')"""
_UP = "up AS (SELECT sentence_id, idx, idx AS anc, 0 AS dist FROM parse UNION ALL SELECT sentence_id, idx, (anc + 1) // 2 - 1, dist + 1 FROM up WHERE anc > 0)"
_P = f"WITH RECURSIVE {f.ROLES}, {_PARSED}"
_NODES = """leaf AS (SELECT s_nationkey::VARCHAR AS vt, s_suppkey AS instance, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS i, count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier),
    rng AS (SELECT DISTINCT vt, (i // (1 << l)) * (1 << l) AS lo, least(n, (i // (1 << l) + 1) * (1 << l)) - 1 AS hi FROM leaf, unnest(range(0, 20)) AS t(l)),
    sz AS (SELECT vt, lo, hi, hi - lo + 1 AS size FROM rng),
    die AS (SELECT *, CASE WHEN size > 1 THEN dense_rank() OVER (PARTITION BY vt ORDER BY CASE WHEN size > 1 THEN size END DESC NULLS LAST) ELSE 2147483647 END AS died FROM sz),
    anc AS (SELECT x.vt, x.lo, x.hi, min_by(p.died, p.size) AS born, count(p.lo) AS depth FROM sz x LEFT JOIN die p ON p.vt = x.vt AND p.lo <= x.lo AND p.hi >= x.hi AND p.size > x.size GROUP BY ALL),
    node AS (SELECT die.*, coalesce(born, 0) AS born, depth FROM die JOIN anc USING (vt, lo, hi)),
    step AS (SELECT DISTINCT vt, born AS t FROM node),
    cuts AS (SELECT vt, t, count(*) AS k, sum(size * size) AS loss, sum(size * ln(size)) AS xlogx, sum(size) AS size, max(size) AS top FROM step JOIN node USING (vt) WHERE born <= t AND t < died GROUP BY ALL)"""


def _cut_rows(step: str) -> str:
    return f"WITH {_NODES}, sel AS (SELECT vt, {step} AS t FROM cuts GROUP BY vt) SELECT node.vt AS verb_type, node.size AS n, leaf.instance AS first FROM node JOIN sel USING (vt) JOIN leaf ON leaf.vt = node.vt AND leaf.i = node.lo WHERE born <= t AND t < died"


SQL = {
    "syntax_passives": f"{_P} SELECT sentence_id, count(*) AS n, sum(idx)::BIGINT AS places FROM passive GROUP BY ALL",
    "syntax_functions": f"{_P} SELECT a.sentence_id, verb_index, a.idx, label AS function, CASE WHEN label = 'LGS' THEN 'SBJ' WHEN label = 'SBJ' AND p.idx IS NOT NULL THEN 'OBJ' ELSE label END AS active FROM arg a LEFT JOIN parse k ON k.sentence_id = a.sentence_id AND k.idx = a.idx LEFT JOIN passive p ON p.sentence_id = a.sentence_id AND p.idx = verb_index",
    "syntax_heads": f"""{_P}, kid AS (SELECT sentence_id, head AS idx, min(idx) FILTER (label = 'PMOD') AS pmod, min(idx) FILTER (label = 'IM') AS im FROM parse WHERE head >= 0 GROUP BY ALL)
    SELECT a.sentence_id, verb_index, a.idx, coalesce(CASE WHEN pos IN ('IN', 'TO', 'RB') THEN pmod END, CASE WHEN pos = 'TO' THEN im END, a.idx) AS head_idx, CASE WHEN pos IN ('IN', 'TO') THEN lower(token) ELSE '<none>' END AS prep
    FROM arg a LEFT JOIN parse k ON k.sentence_id = a.sentence_id AND k.idx = a.idx LEFT JOIN kid ON kid.sentence_id = a.sentence_id AND kid.idx = a.idx""",
    "syntax_ancestors": f"{_P}, {_UP} SELECT sentence_id, idx, count(*) AS n, max(dist)::BIGINT AS depth FROM up GROUP BY ALL",
    "syntax_spans": f"{_P}, {_UP} SELECT sentence_id, anc::INTEGER AS idx, min(idx) AS b, max(idx) + 1 AS e FROM up GROUP BY ALL",
    "syntax_paths": f"{_P}, {_UP}, pr AS (SELECT DISTINCT sentence_id, verb_index AS a, idx AS b FROM arg) SELECT pr.sentence_id, a, b, min_by(x.anc, x.dist + y.dist)::INTEGER AS ancestor, min(x.dist + y.dist)::BIGINT AS steps FROM pr JOIN up x ON x.sentence_id = pr.sentence_id AND x.idx = a JOIN up y ON y.sentence_id = pr.sentence_id AND y.idx = b AND y.anc = x.anc GROUP BY ALL",
    "aligned_sentences": f"WITH {f.SENTENCES}, t AS (SELECT sentence_id, lower(regexp_replace(array_to_string(sentence_tokens, ''), '\\s+', '', 'g')) AS k FROM sentences WHERE len(sentence_tokens) > 0) SELECT sentence_id, min(sentence_id) OVER (PARTITION BY k) AS other_id FROM t",
    "leading_words": f"{_P}, b AS (SELECT *, min((regexp_full_match(token, '[a-z]+') OR idx = 0)::INTEGER) OVER (PARTITION BY sentence_id ORDER BY idx) AS ok FROM parse) SELECT sentence_id, count(*) AS n FROM b WHERE ok = 1 GROUP BY ALL",
    "tree_nodes": f"WITH {_NODES} SELECT vt AS verb_type, lo::INTEGER AS leaf_lo, hi::INTEGER AS leaf_hi, size, (size * size)::DOUBLE AS loss, depth::INTEGER AS depth, born::INTEGER AS born, died::INTEGER AS died FROM node",
    "tree_steps": f"WITH {_NODES} SELECT vt AS verb_type, t::INTEGER AS step, k AS n_clusters, loss::DOUBLE AS loss, round(xlogx, 6) AS xlogx, size::BIGINT AS size, top::DOUBLE AS top_loss FROM cuts",
    "tree_cut_number": _cut_rows("coalesce(min(t) FILTER (k >= 3), max(t))"),
    "tree_cut_at_most": _cut_rows("coalesce(max(t) FILTER (k <= 3), min(t))"),
    "tree_cut_entropy": f"WITH {_NODES} SELECT vt AS verb_type, first(t ORDER BY round(loss + 4 * (size * ln(size) - xlogx), 9), t)::INTEGER AS step FROM cuts WHERE t < 100 GROUP BY vt",
    "tree_top": f"WITH {_NODES} SELECT vt AS verb_type, lo::INTEGER AS leaf_lo, hi::INTEGER AS leaf_hi, depth::INTEGER AS depth, size = 1 OR depth = 2 AS is_leaf FROM node WHERE depth <= 2",
    "tree_path": f"WITH {_NODES} SELECT vt AS verb_type, depth::INTEGER AS depth, lo::INTEGER AS leaf_lo, hi::INTEGER AS leaf_hi FROM node WHERE lo <= 2 AND 2 <= hi",
    "tree_sums": f"WITH {_NODES} SELECT node.vt AS verb_type, lo::INTEGER AS leaf_lo, hi::INTEGER AS leaf_hi, sum(round(s_acctbal::DOUBLE * 100)::BIGINT)::BIGINT AS cents FROM node JOIN leaf ON leaf.vt = node.vt AND i BETWEEN lo AND hi JOIN supplier ON s_suppkey = instance GROUP BY ALL",
    "tree_weights": f"WITH {_NODES} SELECT node.vt AS verb_type, lo::INTEGER AS leaf_lo, hi::INTEGER AS leaf_hi, sum(instance % 7)::DOUBLE AS weight FROM node JOIN leaf ON leaf.vt = node.vt AND i BETWEEN lo AND hi GROUP BY ALL",
    "tree_filtered": "WITH o AS (SELECT s_nationkey::VARCHAR AS vt, s_suppkey % 3 AS m, count(*)::DOUBLE AS k FROM supplier WHERE s_suppkey % 2 = 1 GROUP BY ALL) SELECT vt AS verb_type, (2 * sum(k) - 1)::BIGINT AS n_nodes, round(sum(k) * ln(sum(k)) - sum(k * ln(k)), 6) + 0.0::DOUBLE AS loss FROM o GROUP BY vt",
    "kernel_roots": """WITH r AS (SELECT s_nationkey, count(*) AS c FROM supplier GROUP BY s_nationkey, s_suppkey % 4), k AS (SELECT s_nationkey, sum(c * (c - 1) / 2)::DOUBLE AS rep FROM r GROUP BY ALL),
    x AS (SELECT s_nationkey, count(*) AS n, (max(s_acctbal::DOUBLE) - min(s_acctbal::DOUBLE)) / 1000 AS linkage, var_pop(s_acctbal::DOUBLE / 1000) * count(*) / 175 AS spread FROM supplier GROUP BY ALL)
    SELECT s_nationkey::BIGINT AS nation, n, round(linkage, 6) + 0.0::DOUBLE AS linkage, round(spread, 6) + 0.0::DOUBLE AS spread, round(rep, 6) AS repeated, round(0.25::DOUBLE * spread + 0.75::DOUBLE * rep, 6) + 0.0::DOUBLE AS weighted FROM x JOIN k USING (s_nationkey)""",
    "entropy_tree_roots": f"WITH {s.DIST}, n AS (SELECT verb_type, count(DISTINCT instance) AS n FROM dist GROUP BY ALL), t AS (SELECT verb_type, item, sum(value)::DOUBLE AS v FROM dist GROUP BY ALL) SELECT verb_type, n AS size, round(sum(v) * ln(sum(v)) - sum(v * ln(v)), 3) AS loss, true AS grows, n AS instances, true AS once FROM t JOIN n USING (verb_type) GROUP BY verb_type, n",
    "entropy_curve_start": f"WITH {s.DIST}, {s.GOLD}, m AS (SELECT DISTINCT verb_type, instance FROM dist), l AS (SELECT verb_type, label, count(*)::DOUBLE AS k FROM m JOIN gold USING (instance) GROUP BY ALL), n AS (SELECT verb_type, sum(k) AS n, sum(k * k) / sum(k) / sum(k) AS p FROM l GROUP BY ALL), t AS (SELECT verb_type, item, sum(value)::DOUBLE AS v FROM dist GROUP BY ALL), e AS (SELECT verb_type, sum(v) * ln(sum(v)) - sum(v * ln(v)) AS loss FROM t GROUP BY ALL) SELECT verb_type, 1::BIGINT AS n_clusters, n::BIGINT AS size, round(p, 6) AS precision, 1::DOUBLE AS recall, round(loss / n, 4) AS top_loss FROM n JOIN e USING (verb_type)",
}
