"""Clustering steps, trees, curves and tuning over the surrogate instances."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verbloom.operators import flat, models, tuning
from verbloom.operators import tree as trees
from verbloom.plans import surrogate as s
from verbloom.session import cut, table

c = F.col
ALPHA = 0.01


def _assigned(spark: SparkSession, d: str) -> DataFrame:
    return s.predicted(spark, d).withColumn("p", F.lit(1.0))


def _losses(spark: SparkSession, d: str) -> DataFrame:
    dist = cut(s.dist(spark, d))
    return flat.with_prior(flat.losses(dist, flat.estimate(dist, _assigned(spark, d), ALPHA)), None)


def m_step(spark: SparkSession, d: str) -> DataFrame:
    return s.rounded(flat.estimate(cut(s.dist(spark, d)), _assigned(spark, d), ALPHA))


def hard_e_step(spark: SparkSession, d: str) -> DataFrame:
    return s.rounded(flat.hard_step(_losses(spark, d)), 4).drop("p")


def soft_e_step(spark: SparkSession, d: str, temperature: float = 10.0) -> DataFrame:
    return s.rounded(flat.soft_step(_losses(spark, d), temperature).select("verb_type", "instance", "cluster", "p", "expected"), 4)


def em_two_steps(spark: SparkSession, d: str) -> DataFrame:
    """Two hard steps from clusters by the instance modulo 5."""
    dist = cut(s.dist(spark, d))
    assign = dist.select("verb_type", "instance").distinct().select("verb_type", "instance", (c("instance") % 5).cast("string").alias("cluster"), F.lit(1.0).alias("p"))
    for _ in range(2):
        assign = cut(flat.hard_step(flat.losses(dist, flat.estimate(dist, assign, ALPHA))))
    return assign.select("verb_type", "instance", "cluster")


def em_until_stable(spark: SparkSession, d: str) -> DataFrame:
    dist = s.dist(spark, d)
    return s.rounded(flat.run(dist, flat.starting(dist, 8), ALPHA).groupBy("verb_type", "cluster").agg(F.count(F.lit(1)).alias("n"), F.avg("loss").alias("loss")), 4)


def weighted_loss(spark: SparkSession, d: str) -> DataFrame:
    """0.7 times the entropy term and 0.3 times the size prior, per predicted cluster."""
    clusters = s.dist(spark, d).join(s.predicted(spark, d), ["verb_type", "instance"]).groupBy("verb_type", "cluster", "item").agg(F.sum("value").alias("value"))
    entropy = flat.entropy_loss(clusters, ["verb_type", "cluster"])
    size = flat.size_loss(s.predicted(spark, d), ["verb_type", "cluster"])
    both = entropy.withColumn("instance", F.lit(0)).select("verb_type", "instance", "cluster", "loss"), size.withColumn("instance", F.lit(0)).select("verb_type", "instance", "cluster", "loss")
    return s.rounded(flat.weighted([(both[0], 0.7), (both[1], 0.3)]).drop("instance"), 4)


def _cluster_dist(spark: SparkSession, d: str) -> DataFrame:
    return cut(s.dist(spark, d).join(s.predicted(spark, d), ["verb_type", "instance"]).groupBy("verb_type", "cluster", "item").agg(F.sum("value").alias("value")))


def merge_loss_pairs(spark: SparkSession, d: str) -> DataFrame:
    return s.rounded(flat.merge_losses(_cluster_dist(spark, d), ["verb_type"]), 4)


def best_first_merge(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("verb_type").orderBy(F.round("delta", 6), "a", "b")
    first = flat.merge_losses(_cluster_dist(spark, d), ["verb_type"]).withColumn("r", F.row_number().over(w)).filter("r = 1").drop("r")
    return s.rounded(first, 4)


def size_prior_loss(spark: SparkSession, d: str) -> DataFrame:
    return s.rounded(flat.size_loss(s.predicted(spark, d), ["verb_type", "cluster"]))


def repeated_key_loss(spark: SparkSession, d: str) -> DataFrame:
    nation = table(spark, d, "supplier").select(c("s_suppkey").alias("instance"), "s_nationkey")
    return s.rounded(flat.repeated_key_loss(s.predicted(spark, d).join(nation, "instance"), ["verb_type", "cluster"], "s_nationkey"))


def state_loss(spark: SparkSession, d: str) -> DataFrame:
    """Clusters as mixtures of the five regions; an instance's nll grows with the distance to its own region."""
    gold = s.gold(spark, d)
    members = s.counts(spark, d).select("verb_type", "cluster", c("label").alias("state"), "n")
    region = s.predicted(spark, d).join(gold, "instance").select("verb_type", "instance", F.substring("label", 2, 1).cast("int").alias("own"))
    observed = region.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(4)))).select("verb_type", "instance", F.concat(F.lit("R"), c("k").cast("string")).alias("state"), (1.0 + F.abs(c("k") - c("own"))).alias("nll"))
    return s.rounded(flat.state_losses(members, observed))


def vector_mean_step(spark: SparkSession, d: str) -> DataFrame:
    """Means of the embeddings of each label, and the nearest mean of each embedding."""
    v = table(spark, d, "embeddings").select("vec_id", c("label").alias("cluster"), c("embedding").alias("vec"))
    return s.rounded(flat.nearest_mean(v.drop("cluster"), cut(flat.vector_means(v, ["cluster"])), "vec_id"))


def unigram_e_step(spark: SparkSession, d: str) -> DataFrame:
    dist, assign = cut(s.dist(spark, d)), _assigned(spark, d)
    out = flat.mixture_step(dist.withColumn("value", c("value") / 1000), flat.estimate(dist, assign, ALPHA), flat.size_prior(assign))
    return s.rounded(out, 4)


def topic_e_step(spark: SparkSession, d: str) -> DataFrame:
    """Clusters of each item of an instance, under uniform priors of the instance's clusters."""
    dist, assign = cut(s.dist(spark, d)), _assigned(spark, d)
    theta = flat.estimate(dist, assign, ALPHA)
    names = theta.select("verb_type", "cluster").distinct().withColumn("prior", 1.0 / F.count(F.lit(1)).over(Window.partitionBy("verb_type")))
    prior = dist.select("verb_type", "instance").distinct().join(names, "verb_type")
    out = flat.mixture_step(dist.withColumn("value", c("value") / 1000), theta, prior, per_document=True)
    best = Window.partitionBy("verb_type", "instance", "item").orderBy(F.round("p", 9).desc(), "cluster")
    return s.rounded(out.withColumn("r", F.row_number().over(best)).filter("r = 1").drop("r", "value"), 4)


# --- trees


def _labels(spark: SparkSession, d: str) -> DataFrame:
    return s.predicted(spark, d).select("verb_type", "instance", c("cluster").alias("label"))


def label_baseline(spark: SparkSession, d: str) -> DataFrame:
    return models.label_tree(_labels(spark, d))


def balanced_tree(spark: SparkSession, d: str) -> DataFrame:
    return models.balanced_tree(table(spark, d, "nation"), "n_regionkey", "n_nationkey")


def tree_ancestors(spark: SparkSession, d: str) -> DataFrame:
    """Paths to the root in the tree of nations whose parent is (k - 1) div 2: each node's ancestors and distances."""
    table(spark, d, "nation").createOrReplaceTempView("verbloom_nation")
    return spark.sql("""
        WITH RECURSIVE up(node, ancestor, distance) AS (
          SELECT cast(n_nationkey AS bigint), cast(n_nationkey AS bigint), cast(0 AS bigint) FROM verbloom_nation
          UNION ALL SELECT node, cast((ancestor - 1) div 2 AS bigint), distance + cast(1 AS bigint) FROM up WHERE ancestor > 0)
        SELECT node, ancestor, distance FROM up""")


def entropy_tree(spark: SparkSession, d: str) -> DataFrame:
    """Nodes of the hybrid entropy clustering of each verb type."""
    nodes, _ = models.hybrid_model(s.dist(spark, d))
    return s.rounded(nodes, 4)


def cut_number(spark: SparkSession, d: str) -> DataFrame:
    nodes, leaves = (cut(x) for x in models.hybrid_model(s.dist(spark, d)))
    step = trees.number_cut(nodes, 5)
    return trees.cut_at(nodes.join(step, "verb_type"), leaves, c("step"))


def cut_entropy(spark: SparkSession, d: str) -> DataFrame:
    nodes, leaves = (cut(x) for x in models.hybrid_model(s.dist(spark, d)))
    step = trees.entropy_cut(nodes, models.DEFAULT_CUT["arg_entropy"])
    return trees.cut_at(nodes.join(step, "verb_type"), leaves, c("step"))


def tree_limited(spark: SparkSession, d: str) -> DataFrame:
    nodes, _ = models.hybrid_model(s.dist(spark, d))
    return s.rounded(trees.depth_limited(nodes, 4), 4)


def entropy_curve(spark: SparkSession, d: str) -> DataFrame:
    nodes, leaves = (cut(x) for x in models.hybrid_model(s.dist(spark, d)))
    return s.rounded(tuning.curve(nodes, leaves, s.gold(spark, d)))


def entropy_tuned(spark: SparkSession, d: str) -> DataFrame:
    """The best threshold of each criterion over the trees of the entropy clustering."""
    nodes, leaves = (cut(x) for x in models.hybrid_model(s.dist(spark, d)))
    points = cut(tuning.curve(nodes, leaves, s.gold(spark, d)))
    return s.rounded(tuning.best_threshold(tuning.tuned_all(points, list(tuning.GRIDS)), ["criterion"]))


def noisy_baseline(spark: SparkSession, d: str) -> DataFrame:
    return models.label_tree(models.noisy(_labels(spark, d), 0.1, seed=3))


# --- curves and tuning over the linear trees


def linear_curve(spark: SparkSession, d: str) -> DataFrame:
    return s.rounded(tuning.linear_curve(s.counts(spark, d)).drop("loss", "top_loss", "wlogw", "weight_sum"))


def tuning_num_clusters(spark: SparkSession, d: str) -> DataFrame:
    return s.rounded(tuning.tuned(tuning.linear_curve(s.counts(spark, d)), "num-clusters"))


def tuning_oracle(spark: SparkSession, d: str) -> DataFrame:
    return s.rounded(tuning.tuned(tuning.linear_curve(s.counts(spark, d)), "oracle"))


def tuning_best(spark: SparkSession, d: str) -> DataFrame:
    """The best threshold of the number of clusters."""
    return s.rounded(tuning.best_threshold(tuning.tuned(cut(tuning.linear_curve(s.counts(spark, d))), "num-clusters"), ["criterion"]))


def _label_points(spark: SparkSession, d: str) -> DataFrame:
    """Points of the linear trees with the label entropies of the clusters as losses."""
    return cut(tuning.linear_curve(s.counts(spark, d), entropy=True))


def label_entropy_curve(spark: SparkSession, d: str) -> DataFrame:
    return s.rounded(_label_points(spark, d).drop("wlogw", "weight_sum"))


def _tuning(name: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        return s.rounded(tuning.tuned(_label_points(spark, d), name))

    query.__name__ = "tuning_" + name.replace("-", "_")
    query.__doc__ = f"Scores of every threshold of the criterion {name} over the label entropies."
    return query


_CRITERIA = ("entropy", "wentropy", "max-entropy", "log-penalty", "linear-penalty", "sq-nclusters", "cut-delta", "loss", "max-loss")


def tuning_setting(spark: SparkSession, d: str) -> DataFrame:
    """The best criterion, its threshold and its scores."""
    return s.rounded(tuning.best_setting(tuning.tuned_all(_label_points(spark, d), list(tuning.GRIDS))))


def tuning_calibration(spark: SparkSession, d: str) -> DataFrame:
    """Scores of thresholds apart for verb types by their number of items."""
    return s.rounded(tuning.calibration(cut(tuning.linear_curve(s.counts(spark, d))), "num-clusters=1,5,10"))


def tuning_by_verb(spark: SparkSession, d: str) -> DataFrame:
    """The best number of clusters of each verb type."""
    return s.rounded(tuning.calibration_by_verb(cut(tuning.linear_curve(s.counts(spark, d))), "num-clusters"))


def leaf_points(spark: SparkSession, d: str) -> DataFrame:
    """The points where every predicted cluster stands for itself."""
    return s.rounded(tuning.leaf_points(s.counts(spark, d)))


_NAMES = (m_step, hard_e_step, soft_e_step, em_two_steps, em_until_stable, weighted_loss, merge_loss_pairs, best_first_merge, size_prior_loss, repeated_key_loss, state_loss, vector_mean_step, unigram_e_step, topic_e_step, label_baseline, balanced_tree, tree_ancestors, entropy_tree, cut_number, cut_entropy, tree_limited, entropy_curve, entropy_tuned, noisy_baseline, linear_curve, tuning_num_clusters, tuning_oracle, tuning_best, label_entropy_curve, *map(_tuning, _CRITERIA), tuning_setting, tuning_calibration, tuning_by_verb, leaf_points)
QUERIES = {f.__name__: f for f in _NAMES}

_THETA = f"""k AS (SELECT verb_type, count(DISTINCT item) AS k FROM dist GROUP BY verb_type),
    voc AS (SELECT DISTINCT verb_type, item FROM dist),
    n AS (SELECT d.verb_type, cluster, item, sum(value) AS n FROM dist d JOIN {{assign}} USING (verb_type, instance) GROUP BY ALL),
    theta AS (SELECT verb_type, cluster, item, (coalesce(n, 0) + {ALPHA}::DOUBLE / k) / (sum(coalesce(n, 0)) OVER (PARTITION BY verb_type, cluster) + {ALPHA}::DOUBLE) AS theta
        FROM (SELECT DISTINCT verb_type, cluster FROM {{assign}}) JOIN voc USING (verb_type) JOIN k USING (verb_type) LEFT JOIN n USING (verb_type, cluster, item))"""
_STEP = f"WITH {s.DIST}, {s.PREDICTED}, {_THETA.format(assign='predicted')}"
_LOSS = "raw AS (SELECT d.verb_type, instance, cluster, -sum(value * ln(theta)) AS loss FROM dist d JOIN theta USING (verb_type, item) GROUP BY ALL), loss AS (SELECT verb_type, instance, cluster, loss + ln(count(*) OVER (PARTITION BY verb_type, instance)) AS loss FROM raw)"
_SIZE = "size AS (SELECT verb_type, cluster, count(*)::DOUBLE AS n FROM predicted GROUP BY ALL), sl AS (SELECT verb_type, cluster, n, n * ln(n / sum(n) OVER (PARTITION BY verb_type)) AS loss FROM size)"
_CD = "cd AS (SELECT d.verb_type, cluster, item, sum(value) AS value FROM dist d JOIN predicted USING (verb_type, instance) GROUP BY ALL), ent AS (SELECT verb_type, cluster, sum(value) * ln(sum(value)) - sum(value * ln(value)) AS loss FROM cd GROUP BY ALL)"
_PAIRS = """names AS (SELECT DISTINCT verb_type, cluster FROM cd), pr AS (SELECT x.verb_type, x.cluster AS a, y.cluster AS b FROM names x JOIN names y ON x.verb_type = y.verb_type AND x.cluster < y.cluster),
    sm AS (SELECT pr.verb_type, a, b, item, sum(value) AS value FROM pr JOIN cd ON cd.verb_type = pr.verb_type AND cd.cluster IN (a, b) GROUP BY ALL),
    pl AS (SELECT verb_type, a, b, sum(value) * ln(sum(value)) - sum(value * ln(value)) AS loss FROM sm GROUP BY ALL),
    delta AS (SELECT pl.verb_type, a, b, pl.loss, pl.loss - ea.loss - eb.loss AS delta FROM pl JOIN ent ea ON ea.verb_type = pl.verb_type AND ea.cluster = a JOIN ent eb ON eb.verb_type = pl.verb_type AND eb.cluster = b)"""
_CURVE = f"""{s.BASE}, sz AS (SELECT verb_type, cluster, sum(n) AS s FROM counts GROUP BY ALL),
    rk AS (SELECT *, row_number() OVER (PARTITION BY verb_type ORDER BY s DESC, cluster) AS rk, count(*) OVER (PARTITION BY verb_type) AS k FROM sz),
    cutx AS (SELECT verb_type, step, CASE WHEN rk <= step THEN rk ELSE -1 END AS cl, label, sum(n) AS n FROM counts JOIN rk USING (verb_type, cluster), unnest(range(0, k)) AS t(step) GROUP BY ALL),
    ce AS (SELECT *, sum(n) OVER (PARTITION BY verb_type, step, cl) AS s, sum(n) OVER (PARTITION BY verb_type, step, label) AS g FROM cutx),
    points AS (SELECT verb_type, step, step + 1 AS n_clusters, sum(n * ln(s)) AS xlogx, sum(n) AS size, sum(n * n / s) / sum(n) AS precision, sum(n * n / g) / sum(n) AS recall, sum(n) AS weight FROM ce GROUP BY ALL)"""
_F1 = "round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END, 6) AS f1"


def _tuned(name: str, thresholds: str, score: str, by: str = "") -> str:
    return f"""tried AS (SELECT *, {score} AS score FROM points, (SELECT unnest({thresholds})::DOUBLE AS t)),
    chosen AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY verb_type, t ORDER BY round(score, 9), step) AS r FROM tried) WHERE r = 1),
    mean AS (SELECT t, {by} sum(precision * weight) / sum(weight) AS precision, sum(recall * weight) / sum(weight) AS recall, sum(weight) AS weight FROM chosen GROUP BY ALL)"""


_FIRST = "CASE WHEN n_clusters >= t THEN step ELSE 1e9::DOUBLE - step END"
_MEAN_OUT = "t, round(precision, 6) AS precision, round(recall, 6) AS recall, " + _F1 + ", weight"
SQL = {
    "m_step": f"{_STEP} SELECT verb_type, cluster, item, round(theta, 6) AS theta FROM theta",
    "hard_e_step": f"{_STEP}, {_LOSS} SELECT verb_type, instance, cluster, round(loss, 4) AS loss FROM (SELECT *, row_number() OVER (PARTITION BY verb_type, instance ORDER BY round(loss, 9), cluster) AS r FROM loss) WHERE r = 1",
    "soft_e_step": f"{_STEP}, {_LOSS}, m AS (SELECT *, min(loss) OVER w AS m FROM loss WINDOW w AS (PARTITION BY verb_type, instance)), p AS (SELECT *, exp(-(loss - m) / 10) / sum(exp(-(loss - m) / 10)) OVER (PARTITION BY verb_type, instance) AS p FROM m) SELECT verb_type, instance, cluster, round(p, 4) + 0.0::DOUBLE AS p, round(sum(p * loss) OVER (PARTITION BY verb_type, instance), 4) AS expected FROM p",
    "em_two_steps": f"""WITH {s.DIST}, a0 AS (SELECT DISTINCT verb_type, instance, (instance % 5)::VARCHAR AS cluster FROM dist), a1 AS (WITH {_THETA.format(assign='a0')}, {_LOSS.replace('loss + ln(count(*) OVER (PARTITION BY verb_type, instance)) AS loss', 'loss')}
        SELECT verb_type, instance, cluster FROM (SELECT *, row_number() OVER (PARTITION BY verb_type, instance ORDER BY round(loss, 9), cluster) AS r FROM loss) WHERE r = 1),
    a2 AS (WITH {_THETA.format(assign='a1')}, {_LOSS.replace('loss + ln(count(*) OVER (PARTITION BY verb_type, instance)) AS loss', 'loss')}
        SELECT verb_type, instance, cluster FROM (SELECT *, row_number() OVER (PARTITION BY verb_type, instance ORDER BY round(loss, 9), cluster) AS r FROM loss) WHERE r = 1)
    SELECT * FROM a2""",
    "weighted_loss": f"WITH {s.DIST}, {s.PREDICTED}, {_CD}, {_SIZE} SELECT verb_type, cluster, round(0.7::DOUBLE * ent.loss + 0.3::DOUBLE * sl.loss, 4) AS loss FROM ent JOIN sl USING (verb_type, cluster)",
    "merge_loss_pairs": f"WITH {s.DIST}, {s.PREDICTED}, {_CD}, {_PAIRS} SELECT verb_type, a, b, round(loss, 4) AS loss, round(delta, 4) AS delta FROM delta",
    "best_first_merge": f"WITH {s.DIST}, {s.PREDICTED}, {_CD}, {_PAIRS} SELECT verb_type, a, b, round(loss, 4) AS loss, round(delta, 4) AS delta FROM (SELECT *, row_number() OVER (PARTITION BY verb_type ORDER BY round(delta, 6), a, b) AS r FROM delta) WHERE r = 1",
    "size_prior_loss": f"WITH {s.DIST}, {s.PREDICTED}, {_SIZE} SELECT verb_type, cluster, n, round(loss, 6) AS loss FROM sl",
    "repeated_key_loss": f"WITH {s.DIST}, {s.PREDICTED}, k AS (SELECT verb_type, cluster, s_nationkey, count(*)::DOUBLE AS n FROM predicted JOIN supplier ON instance = s_suppkey GROUP BY ALL) SELECT verb_type, cluster, sum(n * (n - 1) / 2) AS loss FROM k GROUP BY ALL",
    "state_loss": f"WITH {s.BASE}, sh AS (SELECT verb_type, cluster, label AS state, n / sum(n) OVER (PARTITION BY verb_type, cluster) AS w FROM counts), ob AS (SELECT verb_type, instance, 'R' || k AS state, 1 + abs(k - n_regionkey)::DOUBLE AS nll FROM predicted JOIN supplier ON instance = s_suppkey JOIN nation ON s_nationkey = n_nationkey, unnest(range(0, 5)) AS t(k)) SELECT ob.verb_type, instance, cluster, round(sum(w * nll), 6) AS loss FROM ob JOIN sh USING (verb_type, state) GROUP BY ALL",
    "vector_mean_step": "WITH f AS (SELECT vec_id, label AS cluster, generate_subscripts(embedding, 1) AS idx, unnest(embedding)::DOUBLE AS v FROM embeddings), m AS (SELECT cluster, idx, avg(v) AS mean FROM f GROUP BY ALL), d AS (SELECT vec_id, m.cluster, sum((v - mean) ** 2) / 175 AS loss FROM f JOIN m USING (idx) GROUP BY ALL) SELECT vec_id, cluster, round(loss, 6) AS loss FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(loss, 9), cluster) AS r FROM d) WHERE r = 1",
    "unigram_e_step": f"{_STEP}, pz AS (SELECT verb_type, cluster, n / sum(n) OVER (PARTITION BY verb_type) AS prior FROM (SELECT verb_type, cluster, count(*)::DOUBLE AS n FROM predicted GROUP BY ALL)), sc AS (SELECT d.verb_type, instance, cluster, sum(value / 1000 * (ln(prior) + ln(theta))) AS s FROM dist d JOIN theta USING (verb_type, item) JOIN pz USING (verb_type, cluster) GROUP BY ALL), m AS (SELECT *, max(s) OVER (PARTITION BY verb_type, instance) AS m FROM sc) SELECT verb_type, instance, cluster, round(exp(s - m) / sum(exp(s - m)) OVER (PARTITION BY verb_type, instance), 4) + 0.0::DOUBLE AS p FROM m",
    "topic_e_step": f"{_STEP}, nc AS (SELECT verb_type, count(DISTINCT cluster) AS c FROM theta GROUP BY ALL), sc AS (SELECT d.verb_type, instance, d.item, cluster, value / 1000 * (ln(1::DOUBLE / c) + ln(theta)) AS s FROM dist d JOIN theta USING (verb_type, item) JOIN nc USING (verb_type)), m AS (SELECT *, max(s) OVER w AS m FROM sc WINDOW w AS (PARTITION BY verb_type, instance, item)), p AS (SELECT *, exp(s - m) / sum(exp(s - m)) OVER (PARTITION BY verb_type, instance, item) AS p FROM m) SELECT verb_type, instance, item, cluster, round(p, 4) + 0.0::DOUBLE AS p FROM (SELECT *, row_number() OVER (PARTITION BY verb_type, instance, item ORDER BY round(p, 9) DESC, cluster) AS r FROM p) WHERE r = 1",
    "label_baseline": f"WITH {s.DIST}, {s.PREDICTED}, w AS (SELECT cluster, count(*) AS a FROM predicted GROUP BY ALL), n AS (SELECT verb_type, cluster AS label, count(*) AS n FROM predicted GROUP BY ALL) SELECT verb_type, row_number() OVER o AS step, label, n, (sum(n) OVER o)::BIGINT AS n_below FROM n JOIN w ON cluster = label WINDOW o AS (PARTITION BY verb_type ORDER BY a, label)",
    "balanced_tree": "WITH i AS (SELECT n_regionkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS i, count(*) OVER (PARTITION BY n_regionkey) AS n FROM nation), r AS (SELECT n_regionkey, level::INTEGER AS level, (i // (1 << level))::BIGINT AS place, i FROM i, unnest(range(0, ceil(log2(n))::BIGINT + 1)) AS t(level)) SELECT n_regionkey, level, place, min(i) AS lo, max(i) AS hi FROM r GROUP BY ALL",
    "tree_ancestors": "WITH RECURSIVE up AS (SELECT n_nationkey::BIGINT AS node, n_nationkey::BIGINT AS ancestor, 0::BIGINT AS distance FROM nation UNION ALL SELECT node, (ancestor - 1) // 2, distance + 1 FROM up WHERE ancestor > 0) SELECT * FROM up",
    "linear_curve": f"WITH {_CURVE} SELECT verb_type, step, n_clusters, round(xlogx, 6) AS xlogx, size, round(precision, 6) AS precision, round(recall, 6) AS recall, weight FROM points",
    "tuning_num_clusters": f"WITH {_CURVE}, {_tuned('', 'range(1, 36)', _FIRST)} SELECT 'num-clusters' AS criterion, {_MEAN_OUT} FROM mean",
    "tuning_oracle": f"WITH {_CURVE}, {_tuned('', 'list_transform(range(-10, 11), lambda i: 1.2::DOUBLE ** i)', '-((1 + t * t) * precision * recall / greatest(t * t * precision + recall, 1e-300::DOUBLE))')} SELECT 'oracle' AS criterion, round(t, 6) AS t, {_MEAN_OUT[3:]} FROM mean",
    "tuning_best": f"""WITH {_CURVE}, {_tuned('', 'range(1, 36)', _FIRST)}, x AS (SELECT *, round(2 * precision * recall / (precision + recall), 9) AS f FROM mean), best AS (SELECT * FROM x WHERE f = (SELECT max(f) FROM x)),
    want AS (SELECT CASE WHEN max(t) = 35 THEN min(t) WHEN min(t) = 1 THEN max(t) ELSE min(t) END AS w FROM best) SELECT 'num-clusters' AS criterion, {_MEAN_OUT} FROM best, want WHERE t = w""",
    "tuning_calibration": f"WITH {_CURVE}, {_tuned('', '[1, 5, 10]', _FIRST, by='n_items,').replace('FROM points', 'FROM (SELECT *, size::BIGINT AS n_items FROM points)')}, nv AS (SELECT size::BIGINT AS n_items, count(DISTINCT verb_type) AS n_verbs FROM points GROUP BY 1) SELECT 'num-clusters' AS criterion, n_items, {_MEAN_OUT}, n_verbs, round(ln(n_items), 6) AS log_items FROM mean JOIN nv USING (n_items)",
    "tuning_by_verb": f"WITH {_CURVE}, {_tuned('', 'range(1, 36)', _FIRST)}, x AS (SELECT verb_type, size::BIGINT AS n_items, t, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM chosen), b AS (SELECT * FROM x QUALIFY round(f1, 9) = max(round(f1, 9)) OVER (PARTITION BY verb_type)), w AS (SELECT verb_type, CASE WHEN max(t) = 35 THEN min(t) WHEN min(t) = 1 THEN max(t) ELSE min(t) END AS t FROM b GROUP BY verb_type) SELECT verb_type, n_items, t, round(f1, 6) AS f1 FROM b JOIN w USING (verb_type, t)",
    "leaf_points": f"WITH {s.BASE}, {s.CELLS} SELECT verb_type, count(DISTINCT cluster) AS n_clusters, round(sum(n * p) / sum(n), 6) AS precision, round(sum(n * r) / sum(n), 6) AS recall, sum(n) AS weight FROM cells GROUP BY verb_type",
}

# Rules of the criteria, each said anew: a score whose smallest value wins, or the place of the chosen point in an order.
_EPOINTS = f"""{_CURVE.replace("points AS (", "points0 AS (")},
    cl AS (SELECT verb_type, step, cl, any_value(s) AS s, any_value(s) * ln(any_value(s)) - sum(n * ln(n)) AS loss FROM ce GROUP BY verb_type, step, cl),
    lp AS (SELECT verb_type, step, sum(loss) AS loss, max(loss / s) AS top_loss FROM cl GROUP BY ALL),
    points AS (SELECT p.*, loss, top_loss FROM points0 p JOIN lp USING (verb_type, step))"""
_MIX = "(size * ln(size) - xlogx)"
_SCORED = {
    "num-clusters": ("range(1, 36)", _FIRST), "oracle": ("list_transform(range(-10, 11), lambda i: 1.2::DOUBLE ** i)", "-((1 + t * t) * precision * recall / greatest(t * t * precision + recall, 1e-300::DOUBLE))"),
    "entropy": ("list_transform(range(-10, 101), lambda i: i / 20)", f"loss + t * {_MIX}"), "wentropy": ("list_transform(range(-10, 101), lambda i: i / 20)", f"loss + t * {_MIX}"),
    "max-entropy": ("list_transform(range(-10, 101), lambda i: i / 20)", f"top_loss + t * {_MIX} / size"), "log-penalty": ("list_transform(range(1, 101), lambda i: i / 100)", "loss + t * ln(n_clusters) * size"),
    "linear-penalty": ("list_transform(range(0, 101), lambda i: i / 1000)", "loss + t * n_clusters * size"), "sq-nclusters": ("list_transform(range(0, 51), lambda i: i / 2)", "loss + t * n_clusters ** 2"),
}
_PLACED = {
    "cut-delta": ("list_transform(range(0, 101), lambda i: i / 10)", "round(loss, 9), step", "greatest(min(k) FILTER (NOT coalesce(round(nxt - loss, 9) < round(t * size, 9), false)) - 1, 1)"),
    "loss": ("list_transform(range(0, 41), lambda i: i / 10)", "round(loss / size, 9) DESC, step", "coalesce(max(k) FILTER (round(loss / size, 9) > t), 1)"),
    "max-loss": ("list_transform(range(0, 101), lambda i: i / 100)", "round(top_loss, 9) DESC, step", "coalesce(max(k) FILTER (round(top_loss, 9) > t), 1)"),
}


def _criterion(name: str) -> str:
    """CTEs up to `mean` for a criterion over `points`."""
    if name in _SCORED:
        return _tuned("", *_SCORED[name])
    grid, order, place = _PLACED[name]
    return f"""o AS (SELECT *, row_number() OVER w AS k, lead(loss) OVER w AS nxt FROM points WINDOW w AS (PARTITION BY verb_type ORDER BY {order})),
    q AS (SELECT verb_type, t, {place} AS k FROM o, (SELECT unnest({grid})::DOUBLE AS t) GROUP BY verb_type, t), chosen AS (SELECT o.*, t FROM q JOIN o USING (verb_type, k)),
    mean AS (SELECT t, sum(precision * weight) / sum(weight) AS precision, sum(recall * weight) / sum(weight) AS recall, sum(weight) AS weight FROM chosen GROUP BY ALL)"""


SQL["label_entropy_curve"] = f"WITH {_EPOINTS} SELECT verb_type, step, n_clusters, round(loss, 6) + 0.0::DOUBLE AS loss, round(xlogx, 6) AS xlogx, size, round(top_loss, 6) + 0.0::DOUBLE AS top_loss, round(precision, 6) AS precision, round(recall, 6) AS recall, weight FROM points"
for _c in _CRITERIA:
    SQL["tuning_" + _c.replace("-", "_")] = f"WITH {_EPOINTS}, {_criterion(_c)} SELECT '{_c}' AS criterion, {_MEAN_OUT} FROM mean"
_EVERY = " UNION ALL ".join(f"(WITH {_criterion(k)} SELECT '{k}' AS criterion, t, precision, recall, weight FROM mean)" for k in (*_SCORED, *_PLACED) if k != "oracle")
SQL["tuning_setting"] = f"""WITH {_EPOINTS}, every AS ({_EVERY}), x AS (SELECT *, round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END, 9) AS f, max(t) OVER c AS hi, min(t) OVER c AS lo FROM every WINDOW c AS (PARTITION BY criterion)),
    b AS (SELECT * FROM x QUALIFY f = max(f) OVER (PARTITION BY criterion)), w AS (SELECT criterion, CASE WHEN max(t) = any_value(hi) THEN min(t) WHEN min(t) = any_value(lo) THEN max(t) ELSE min(t) END AS t FROM b GROUP BY criterion)
    SELECT criterion, round(t, 6) AS t, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f, 6) AS f1, weight FROM b JOIN w USING (criterion, t) ORDER BY f DESC, criterion LIMIT 1"""
