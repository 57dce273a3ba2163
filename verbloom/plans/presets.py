"""Models run from their strings over the arguments of the tables, and their scores against gold roles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verbloom.functions import lexicon as x
from verbloom.functions.clean import latest, norm_id
from verbloom.operators import models, tuning
from verbloom.plans import features as f
from verbloom.plans import surrogate as s
from verbloom.plans.distributions import ARG_Q, NORM_ID, arg_questions
from verbloom.session import cut, table

c = F.col


def arguments(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """The features of the arguments that have a gold role: the newest row of each, and the first of several roles."""
    t = table(spark, d, "arg_feature").filter("arg_id IS NOT NULL").select("arg_id", norm_id("verb_lemma").alias("verb_type"), norm_id("sentence_id").alias("sentence_id"), "verb_index", "arg_span", "produced_at")
    t = latest(t, ["arg_id"], ties=("sentence_id", "verb_index", "verb_type")).filter("size(arg_span) = 2 AND verb_type IS NOT NULL")
    place = t.select("verb_type", c("arg_id").alias("instance"), "sentence_id", "verb_index", c("arg_span")[0].alias("b"), c("arg_span")[1].alias("e"))
    role = f.roles(spark, d).groupBy("sentence_id", "verb_index", "b", "e").agg(F.min(F.struct("role", "frameset")).alias("r")).select("sentence_id", "verb_index", "b", "e", "r.role", c("r.frameset").alias("sense"))
    args = cut(place.join(role, ["sentence_id", "verb_index", "b", "e"]))
    text = args.join(f.sentences(spark, d).select("sentence_id", "sentence_tokens"), "sentence_id", "left").withColumn("text", x.span_text(c("sentence_tokens"), c("b"), c("e")))
    function = F.regexp_replace("role", "^ARGM-", "")
    converted = F.when(c("verb_index") % 2 == 1, F.translate(function, "01", "10")).otherwise(function)  # no parses: odd verbs are passive
    q = arg_questions(spark, d).select(c("arg_id").alias("instance"), c("question").alias("item"), c("weight").alias("value"))
    return {
        "instances": args.select("verb_type", "instance"), "sides": cut(text.select("verb_type", "instance", "text", function.alias("function"), converted.alias("converted"), "role", "sense")),
        "verbs": args.select("verb_type", "instance", F.concat_ws(":", "sentence_id", "verb_index").alias("verb")), "questions": cut(args.select("verb_type", "instance").join(q, "instance").select("verb_type", "instance", "item", "value")),
        "gold": args.select("instance", c("role").alias("label")),
    }


def _mean(points: DataFrame, name: str) -> DataFrame:
    """One row: the points' scores averaged by weight."""
    w = c("weight")
    mean = points.agg((F.sum(c("precision") * w) / F.sum(w)).alias("precision"), (F.sum(c("recall") * w) / F.sum(w)).alias("recall"), F.sum(w).alias("weight")).filter("weight IS NOT NULL")
    return mean.select(F.lit(name).alias("model"), "precision", "recall", tuning.harmonic(c("precision"), c("recall")).alias("f1"), "weight")


def _every(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def rule_scores(spark: SparkSession, d: str) -> DataFrame:
    """The presets whose clusters come from rules alone."""
    have = arguments(spark, d)
    names = [n for n, text in models.PRESETS.items() if text.endswith("noop")]
    return s.rounded(_every([_mean(tuning.chosen(tuning.model_points(*_run(n, have)), "num-clusters=1"), n) for n in names]))


def _run(preset: str, have: dict[str, DataFrame]):
    nodes, leaves, side = models.run(models.PRESETS[preset], have)
    return nodes, leaves, have["gold"], side


def preset_scores(spark: SparkSession, d: str) -> DataFrame:
    """The best criterion, threshold and scores of every preset."""
    have, out = arguments(spark, d), []
    for name in models.PRESETS:
        points = cut(tuning.model_points(*_run(name, have)))
        out.append(tuning.best_setting(tuning.tuned_all(points, list(tuning.GRIDS))).withColumn("model", F.lit(name)))
    return s.rounded(_every(out))


def preset_roles(spark: SparkSession, d: str) -> DataFrame:
    """The question model with rules, cut by entropy: roles of each lemma from rules and from clusters, and arguments."""
    nodes, leaves, side = models.run(models.PRESETS["HUM-QQ + lex"], arguments(spark, d))
    at = models.trees.cut_at(nodes.join(models.trees.entropy_cut(nodes, models.DEFAULT_CUT["arg_entropy"]), "verb_type"), leaves, c("step"))
    both = at.withColumn("cluster", F.concat(F.lit("c"), c("cluster").cast("string"))).unionByName(side.select(*at.columns))
    return both.groupBy("verb_type").agg(F.countDistinct("cluster").alias("n_roles"), F.count(F.lit(1)).alias("n_args"))


def preset_arguments(spark: SparkSession, d: str) -> DataFrame:
    """How many arguments of each lemma the question model with rules places: all, each once."""
    return preset_roles(spark, d).select("verb_type", "n_args")


def baseline_scores(spark: SparkSession, d: str) -> DataFrame:
    """Baselines by labels, every label a cluster; and random ones, all in one cluster."""
    have, out = arguments(spark, d), []
    for name in ("arg/syntf", "arg/syntf2", "arg/gold_nosense", "arg/gold_wsense", "arg/random_linear"):
        nodes, leaves, side = models.run(name, have)
        out.append(_mean(tuning.chosen(tuning.model_points(nodes, leaves, have["gold"], side, 2**31 - 2), "num-clusters=1000000"), name))
    for name in ("arg/random", "arg/random_weighted"):
        out.append(_mean(tuning.chosen(tuning.model_points(*models.run(name, have)[:2], have["gold"], None), "num-clusters=1"), name))
    return s.rounded(_every(out))


def verbs(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """The features of verbs: the usable vectors of mlm_feature as distributions over components, one per feature, and
    the frameset of a verb whose argument has the feature's span as its label."""
    t = table(spark, d, "mlm_feature").filter("feature_id IS NOT NULL").select("feature_id", norm_id("verb_lemma").alias("verb_type"), norm_id("sentence_id").alias("sentence_id"), "span", "arg_mlm_vec", "produced_at")
    v = latest(t, ["feature_id"], ties=("verb_type", "sentence_id")).filter("verb_type IS NOT NULL AND size(arg_mlm_vec) = 64")
    v = cut(v.select("verb_type", c("feature_id").alias("instance"), "arg_mlm_vec").filter(F.exists("arg_mlm_vec", lambda x: F.coalesce((x > 0) & ~F.isnan(x), F.lit(False)))))
    rows = v.select("verb_type", "instance", F.posexplode("arg_mlm_vec").alias("i", "x")).filter("x > 0 AND NOT isnan(x)").select("verb_type", "instance", c("i").cast("string").alias("item"), c("x").cast("double").alias("value"))
    every = v.select("verb_type", "instance")  # one row per feature
    label = F.concat_ws(".", "verb_type", F.lpad((c("instance") % 3).cast("string"), 2, "0"))  # a stand-in sense
    return {"instances": every, "mlm_masked": rows, "sides": every.withColumn("sense", label), "gold": every.select("instance", label.alias("label"))}


def verb_models(spark: SparkSession, d: str) -> DataFrame:
    """What has to hold of the verb model of masked vectors: each verb is in one tree, whose root holds them all."""
    nodes, leaves, _ = models.run("verb/mlm_masked", {"mlm_masked": verbs(spark, d)["mlm_masked"]})  # every verb has rows of its own
    root = nodes.filter("parent < 0").select("verb_type", c("size").alias("n_verbs"), F.round("loss", 3).alias("loss"))
    return root.join(leaves.groupBy("verb_type").agg(F.countDistinct("instance").alias("placed")), "verb_type")


def verb_baselines(spark: SparkSession, d: str) -> DataFrame:
    """Scores of the verb baselines that SQL can tell: gold senses, and everything together."""
    have, out = verbs(spark, d), []
    for name, k in (("verb/gold", "1000000"), ("verb/random", "1"), ("verb/noop", "1")):
        nodes, leaves, side = models.run(name, have)
        limit = 1 if k == "1" else 2**31 - 2  # no cut has fewer clusters than the first
        out.append(_mean(tuning.chosen(tuning.model_points(nodes, leaves, have["gold"], side, limit), f"num-clusters={k}"), name))
    return s.rounded(_every(out))


QUERIES = {g.__name__: g for g in (rule_scores, preset_scores, preset_roles, preset_arguments, baseline_scores, verb_models, verb_baselines)}

_ARGS = f"""{f.ROLES}, {f.SENTENCES},
    af AS (SELECT * FROM (SELECT arg_id, {NORM_ID.format(c='verb_lemma')} AS vt, {NORM_ID.format(c='sentence_id')} AS sid, verb_index AS vi, arg_span, row_number() OVER (PARTITION BY arg_id ORDER BY produced_at DESC NULLS LAST, {NORM_ID.format(c='sentence_id')} DESC NULLS LAST, verb_index DESC NULLS LAST, {NORM_ID.format(c='verb_lemma')} DESC NULLS LAST) AS n FROM arg_feature WHERE arg_id IS NOT NULL) WHERE n = 1 AND len(arg_span) = 2 AND vt IS NOT NULL),
    rl AS (SELECT sentence_id, verb_index, b, e, min({{'role': role, 'frameset': frameset}}) AS r FROM roles GROUP BY ALL),
    a AS (SELECT arg_id, vt, vi, r.role AS role, r.frameset AS sense, regexp_replace(r.role, '^ARGM-', '') AS fn, b, e, sid FROM af JOIN rl ON sid = sentence_id AND vi = verb_index AND arg_span[1] = b AND arg_span[2] = e),
    w AS (SELECT a.*, {f._TEXT} AS w, CASE WHEN vi % 2 = 1 THEN translate(fn, '01', '10') ELSE fn END AS conv FROM a LEFT JOIN sentences ON sentence_id = sid)"""
_LEX = f"CASE WHEN w IN {f._MODAL} THEN 'MODAL' WHEN w IN {f._NEG} THEN 'NEG' WHEN w IN {f._DIS} THEN 'DIS' ELSE {{0}} END"


def _scores(models_: list[tuple[str, str]]) -> str:
    rows = " UNION ALL ".join(f"SELECT '{n}' AS model, vt, arg_id, ({k})::VARCHAR AS cl, role FROM w" for n, k in models_)
    return f"""WITH {_ARGS}, m AS ({rows}), n AS (SELECT model, vt, cl, role, count(*)::DOUBLE AS n FROM m GROUP BY ALL), ce AS (SELECT *, sum(n) OVER (PARTITION BY model, vt, cl) AS s, sum(n) OVER (PARTITION BY model, vt, role) AS g FROM n),
    sc AS (SELECT model, sum(n * n / s) / sum(n) AS precision, sum(n * n / g) / sum(n) AS recall, sum(n) AS weight FROM ce GROUP BY model)
    SELECT model, round(precision, 6) AS precision, round(recall, 6) AS recall, round(2 * precision * recall / (precision + recall), 6) AS f1, weight FROM sc"""


SQL = {
    "rule_scores": _scores([("SyntF", "fn"), ("SyntF + lex", _LEX.format("fn")), ("SyntF + pass->act", "conv"), ("SyntF + all rules", _LEX.format("conv")), ("Gold", "role"), ("Gold + sense", "sense || '.' || role")]),
    "baseline_scores": _scores([("arg/syntf", "fn"), ("arg/syntf2", "conv"), ("arg/gold_nosense", "role"), ("arg/gold_wsense", "sense || '.' || role"), ("arg/random_linear", "arg_id"), ("arg/random", "1"), ("arg/random_weighted", "1")]),
    "preset_arguments": f"WITH {_ARGS} SELECT vt AS verb_type, count(*) AS n_args FROM a GROUP BY vt",
    "verb_models": """WITH v AS (SELECT * FROM (SELECT feature_id, {N} AS vt, arg_mlm_vec, row_number() OVER (PARTITION BY feature_id ORDER BY produced_at DESC NULLS LAST, {N} DESC NULLS LAST) AS n FROM mlm_feature WHERE feature_id IS NOT NULL) WHERE n = 1 AND vt IS NOT NULL AND len(arg_mlm_vec) = 64),
    x AS (SELECT vt, feature_id, generate_subscripts(arg_mlm_vec, 1) AS i, unnest(arg_mlm_vec)::DOUBLE AS x FROM v), ok AS (SELECT * FROM x WHERE x > 0 AND NOT isnan(x)), n AS (SELECT vt, count(DISTINCT feature_id) AS n FROM ok GROUP BY vt), t AS (SELECT vt, i, sum(x) AS v FROM ok GROUP BY ALL)
    SELECT vt AS verb_type, n AS n_verbs, round(sum(v) * ln(sum(v)) - sum(v * ln(v)), 3) AS loss, n AS placed FROM t JOIN n USING (vt) GROUP BY vt, n""".replace("{N}", NORM_ID.format(c="verb_lemma")),
    "verb_baselines": """WITH v AS (SELECT * FROM (SELECT feature_id, {N} AS vt, arg_mlm_vec, row_number() OVER (PARTITION BY feature_id ORDER BY produced_at DESC NULLS LAST, {N} DESC NULLS LAST) AS n FROM mlm_feature WHERE feature_id IS NOT NULL) WHERE n = 1 AND vt IS NOT NULL AND len(arg_mlm_vec) = 64 AND len(list_filter(arg_mlm_vec, lambda x: x > 0 AND NOT isnan(x))) > 0),
    m AS (SELECT vt, feature_id % 3 AS role, unnest(['verb/gold', 'verb/random', 'verb/noop']) AS model FROM v), c AS (SELECT model, vt, role, CASE WHEN model = 'verb/gold' THEN role ELSE 0 END AS cl, count(*)::DOUBLE AS n FROM m GROUP BY ALL),
    ce AS (SELECT *, sum(n) OVER (PARTITION BY model, vt, cl) AS s, sum(n) OVER (PARTITION BY model, vt, role) AS g FROM c), sc AS (SELECT model, sum(n * n / s) / sum(n) AS precision, sum(n * n / g) / sum(n) AS recall, sum(n) AS weight FROM ce GROUP BY model)
    SELECT model, round(precision, 6) AS precision, round(recall, 6) AS recall, round(2 * precision * recall / (precision + recall), 6) AS f1, weight FROM sc""".replace("{N}", NORM_ID.format(c="verb_lemma")),
}
