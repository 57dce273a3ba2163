"""Further features, model summaries and loops."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verbloom.functions import dist as a
from verbloom.functions import lexicon as x
from verbloom.functions.clean import latest, norm_id, norm_question
from verbloom.operators import association, flat, metrics, models, relate, tuning
from verbloom.operators import tree as trees
from verbloom.plans import features as f
from verbloom.plans import surrogate as s
from verbloom.plans.clustering import _CURVE, _FIRST, _MEAN_OUT, _tuned
from verbloom.plans.distributions import NORM_ID, NORM_Q
from verbloom.session import cut, table

c = F.col


def span_answer_weights(spark: SparkSession, d: str) -> DataFrame:
    """Weights of a verb's spans: every page of its beam is an answer list that gives 1 over its length to each entry."""
    t = table(spark, d, "verb_prediction").select(norm_id("sentence_id").alias("sentence_id"), "verb_index", "beam_page", "produced_at", "beam.span")
    v = latest(t.filter("sentence_id IS NOT NULL AND verb_index IS NOT NULL"), ["sentence_id", "verb_index", "beam_page"])
    e = v.filter(F.size("span") > 0).select("sentence_id", "verb_index", F.size("span").alias("n"), F.explode("span").alias("s"))
    ok = e.filter((F.size("s") == 2) & (F.get("s", F.lit(0)) < F.get("s", F.lit(1))))
    return s.rounded(ok.groupBy("sentence_id", "verb_index", c("s")[0].alias("b"), c("s")[1].alias("e")).agg(F.sum(1.0 / c("n")).alias("weight")))


def qa_distribution(spark: SparkSession, d: str) -> DataFrame:
    """Question weights of a verb from its entries: span probability over its sum for the question, over the number of
    the verb's questions."""
    e = f.spans(spark, d).filter("p > 0").select("sentence_id", "verb_index", "b", "e", "p", F.explode("questions.question_string").alias("q"))
    q = e.select("sentence_id", "verb_index", norm_question("q").alias("question"), "p").filter("question <> ''").groupBy("sentence_id", "verb_index", "question").agg(F.sum("p").alias("p"), F.count(F.lit(1)).alias("n"))
    lists = F.count(F.lit(1)).over(Window.partitionBy("sentence_id", "verb_index"))
    mass = F.sum("p").over(Window.partitionBy("sentence_id", "verb_index"))
    return s.rounded(q.select("sentence_id", "verb_index", "question", "n", (c("p") / mass).alias("share"), (c("p") / (mass * lists)).alias("weight")), 9)


def culled_sentences(spark: SparkSession, d: str) -> DataFrame:
    """Verbs and sentences that keep a span entry with at least two questions with usable probabilities."""
    good = F.filter("questions", lambda q: F.coalesce((q["question_prob"] > 0) & (q["question_prob"] <= 1), F.lit(False)))
    kept = f.spans(spark, d).filter(F.size(good) >= 2)
    return kept.groupBy("sentence_id").agg(F.countDistinct("verb_index").alias("n_verbs"), F.count(F.lit(1)).alias("n_entries"))


def remaining_arguments(spark: SparkSession, d: str) -> DataFrame:
    """Labelled arguments that no side rule takes, by lemma."""
    arg = f.argument_sides(spark, d, "mnad")
    return arg.filter("side IS NULL").groupBy("lemma").agg(F.count(F.lit(1)).alias("n"))


def mlm_probabilities(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of mlm_feature as items of their lemma's vocabulary, ranked by probability."""
    rows = table(spark, d, "mlm_feature").filter("feature_id IS NOT NULL").select("feature_id", norm_id("verb_lemma").alias("verb_lemma"), "arg_mlm_vec", "produced_at")
    v = latest(rows, ["feature_id"], ties=("verb_lemma",)).filter("size(arg_mlm_vec) = 64 AND verb_lemma IS NOT NULL")
    flat_v = v.select("feature_id", "verb_lemma", F.posexplode("arg_mlm_vec").alias("idx", "v")).filter("v > 0 AND NOT isnan(v)").select("feature_id", "verb_lemma", "idx", c("v").cast("double").alias("value"))
    vocab = table(spark, d, "mlm_vocab").select(norm_id("verb_lemma").alias("verb_lemma"), F.posexplode("items").alias("idx", "item"))
    rank = F.row_number().over(Window.partitionBy("feature_id").orderBy(c("value").desc(), "item", "idx"))
    return s.rounded(flat_v.join(vocab, ["verb_lemma", "idx"]).select("feature_id", "value", "item", rank.alias("rank")))


def lemma_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Weighted sums of vectors: per lemma and component the number, sum (in units of 0.00001) and maximum over its features."""
    rows = table(spark, d, "mlm_feature").filter("feature_id IS NOT NULL").select("feature_id", norm_id("verb_lemma").alias("verb_lemma"), "arg_mlm_vec", "produced_at")
    v = latest(rows, ["feature_id"], ties=("verb_lemma",)).filter("size(arg_mlm_vec) = 64 AND verb_lemma IS NOT NULL")
    flat_v = v.select("verb_lemma", F.posexplode("arg_mlm_vec").alias("idx", "v")).filter("v >= 0 AND NOT isnan(v)")
    return flat_v.groupBy("verb_lemma", "idx").agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(c("v").cast("double") * 100000).cast("bigint")).alias("sum_e5"), F.round(F.max(c("v").cast("double")), 5).alias("top"))


def lemma_collapse(spark: SparkSession, d: str) -> DataFrame:
    """Weights of sentence tokens by lemma: inflected forms are joined to their stem, others stay; shares per sentence."""
    t = f.sentences(spark, d).select("sentence_id", F.explode("sentence_tokens").alias("token")).filter("token IS NOT NULL").select("sentence_id", F.lower("token").alias("form"))
    forms = table(spark, d, "verb_inflection").select(F.lower("stem").alias("lemma"), F.explode(F.array(*[F.lower(x0) for x0 in ("stem", "present_singular3rd", "present_participle", "past_form", "past_participle")])).alias("form"))
    one = forms.filter("form IS NOT NULL AND lemma IS NOT NULL").groupBy("form").agg(F.min("lemma").alias("lemma"))
    n = t.join(one, "form", "left").groupBy("sentence_id", F.coalesce("lemma", "form").alias("item")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    return s.rounded(a.normalized(n, ["sentence_id"]))


def single_parameters(spark: SparkSession, d: str) -> DataFrame:
    """Dirichlet parameters of clusters of one: the likelihood loss of each instance under its own."""
    dist = cut(s.dist(spark, d))
    own = dist.select("verb_type", "instance").distinct().withColumns({"cluster": c("instance").cast("string"), "p": F.lit(1.0)})
    theta = flat.estimate(dist, own, 0.01).withColumn("instance", c("cluster").cast("bigint"))
    loss = dist.join(theta, ["verb_type", "instance", "item"]).groupBy("verb_type", "instance").agg((-F.sum(c("value") * F.log("theta"))).alias("loss"))
    return s.rounded(loss, 4)


def model_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Unordered pairs of sources and the languages that both have."""
    t = table(spark, d, "documents").filter("source IS NOT NULL AND lang IS NOT NULL").select("source", F.lower("lang").alias("lang")).distinct()
    pair = t.withColumnRenamed("source", "a").join(t.withColumnRenamed("source", "b"), "lang").filter("a < b")
    return pair.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_shared"))


def model_summary(spark: SparkSession, d: str) -> DataFrame:
    """The best number of clusters of each of two models."""
    gold, out = s.gold(spark, d), None
    for name, clusters in (("heaviest", s.predicted(spark, d)), ("lightest", s.predicted_light(spark, d))):
        points = cut(tuning.linear_curve(metrics.label_counts(clusters, gold, ["instance"])))
        own = tuning.best_threshold(tuning.tuned(points, "num-clusters"), ["criterion"]).select(F.lit(name).alias("model"), "t", "precision", "recall", "f1")
        out = own if out is None else out.unionByName(own)
    return s.rounded(out)


def npmi_frequent(spark: SparkSession, d: str) -> DataFrame:
    """NPMI between labels with at least five members."""
    counts = s.counts(spark, d)
    often = counts.groupBy("label").agg(F.sum("n").alias("_n")).filter("_n >= 5").select("label")
    return s.rounded(association.symmetric(counts.join(often, "label")))


def guarded_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Gold labels of predicted instances by a lookup that fails on missing and repeated keys."""
    return relate.looked_up(s.predicted(spark, d), s.gold(spark, d), ["instance"], "label").groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def unigram_mixture(spark: SparkSession, d: str) -> DataFrame:
    dist = s.dist(spark, d).withColumn("value", c("value") / 1000)
    out = flat.run_mixture(dist, flat.starting(dist, 4), 0.01, 3)
    return s.rounded(out.groupBy("verb_type", "cluster").agg(F.sum("p").alias("mass")), 4)


def topic_mixture(spark: SparkSession, d: str) -> DataFrame:
    dist = s.dist(spark, d).withColumn("value", c("value") / 1000)
    out = flat.run_mixture(dist, flat.starting(dist, 4), 0.01, 2, per_document=True)
    return s.rounded(out.groupBy("verb_type", "cluster").agg(F.sum(c("p") * c("value")).alias("mass")), 4)


def question_frames(spark: SparkSession, d: str) -> DataFrame:
    """A full argument model of question entropy over valid arguments of all lemmas, cut by entropy: the number of
    roles and arguments of each lemma."""
    from verbloom.plans.distributions import arg_questions

    q = arg_questions(spark, d).filter("verb_lemma IS NOT NULL").select(c("verb_lemma").alias("verb_type"), c("arg_id").alias("instance"), c("question").alias("item"), c("weight").alias("value"))
    nodes, leaves, _ = models.argument_model(models.parse("arg/qent"), {"questions": q})
    nodes, leaves = cut(nodes), cut(leaves)
    step = trees.entropy_cut(nodes, models.DEFAULT_CUT["arg_entropy"])
    roles = trees.cut_at(nodes.join(step, "verb_type"), leaves, c("step"))
    return roles.groupBy("verb_type").agg(F.countDistinct("cluster").alias("n_roles"), F.count(F.lit(1)).alias("n_args"))


_NAMES = (span_answer_weights, qa_distribution, culled_sentences, remaining_arguments, mlm_probabilities, lemma_vectors, lemma_collapse, single_parameters, model_pairs, model_summary, npmi_frequent, guarded_lookup, unigram_mixture, topic_mixture, question_frames)
QUERIES = {g.__name__: g for g in _NAMES}

_FEATURE = f"feat AS (SELECT * FROM (SELECT feature_id, {NORM_ID.format(c='verb_lemma')} AS verb_lemma, arg_mlm_vec, row_number() OVER (PARTITION BY feature_id ORDER BY produced_at DESC NULLS LAST, {NORM_ID.format(c='verb_lemma')} DESC NULLS LAST) AS n FROM mlm_feature WHERE feature_id IS NOT NULL) WHERE n = 1 AND len(arg_mlm_vec) = 64 AND verb_lemma IS NOT NULL), comp AS (SELECT feature_id, verb_lemma, (generate_subscripts(arg_mlm_vec, 1) - 1)::INTEGER AS idx, unnest(arg_mlm_vec)::DOUBLE AS v FROM feat)"
SQL = {
    "span_answer_weights": f"WITH {f.SPANS}, l AS (SELECT sid AS sentence_id, verb_index, len(beam) AS n, unnest(beam) AS u FROM pages WHERE len(beam) > 0) SELECT sentence_id, verb_index, u.span[1] AS b, u.span[2] AS e, round(sum(1::DOUBLE / n), 6) AS weight FROM l WHERE len(u.span) = 2 AND u.span[1] < u.span[2] GROUP BY ALL",
    "qa_distribution": f"WITH {f.SPANS}, x AS (SELECT sentence_id, verb_index, p, {NORM_Q.format(c='u.question_string')} AS question FROM (SELECT sentence_id, verb_index, p, unnest(questions) AS u FROM spans WHERE p > 0)), q AS (SELECT sentence_id, verb_index, question, sum(p) AS p, count(*) AS n FROM x WHERE question <> '' GROUP BY ALL) SELECT sentence_id, verb_index, question, n, round(p / sum(p) OVER w, 9) AS share, round(p / (sum(p) OVER w * count(*) OVER w), 9) AS weight FROM q WINDOW w AS (PARTITION BY sentence_id, verb_index)",
    "culled_sentences": f"WITH {f.SPANS} SELECT sentence_id, count(DISTINCT verb_index) AS n_verbs, count(*) AS n_entries FROM spans WHERE len(list_filter(questions, lambda q: coalesce(q.question_prob > 0 AND q.question_prob <= 1, false))) >= 2 GROUP BY ALL",
    "remaining_arguments": f"WITH {f.ROLES}, {f.SENTENCES} SELECT lemma, count(*) AS n FROM (SELECT lemma, role, {f._TEXT} AS w FROM roles LEFT JOIN sentences USING (sentence_id)) WHERE NOT coalesce(w IN {f._MODAL} OR w IN {f._NEG} OR w IN {f._DIS}, false) AND role NOT IN ('ARGM-TMP', 'ARGM-MNR', 'ARGM-LOC', 'ARGM-DIR') GROUP BY lemma",
    "mlm_probabilities": f"WITH {_FEATURE}, voc AS (SELECT {NORM_ID.format(c='verb_lemma')} AS verb_lemma, generate_subscripts(items, 1) - 1 AS idx, unnest(items) AS item FROM mlm_vocab) SELECT feature_id, round(v, 6) AS value, item, rank FROM (SELECT feature_id, v, item, row_number() OVER (PARTITION BY feature_id ORDER BY v DESC, item, idx) AS rank FROM comp JOIN voc USING (verb_lemma, idx) WHERE v > 0 AND NOT isnan(v))",
    "lemma_vectors": f"WITH {_FEATURE} SELECT verb_lemma, idx, count(*) AS n, sum(round(v * 100000)::BIGINT)::BIGINT AS sum_e5, round(max(v), 5) AS top FROM comp WHERE v >= 0 AND NOT isnan(v) GROUP BY ALL",
    "lemma_collapse": f"WITH {f.SENTENCES}, forms AS (SELECT lower(unnest([stem, present_singular3rd, present_participle, past_form, past_participle])) AS form, lower(stem) AS lemma FROM verb_inflection), one AS (SELECT form, min(lemma) AS lemma FROM forms WHERE form IS NOT NULL AND lemma IS NOT NULL GROUP BY form), t AS (SELECT sentence_id, lower(unnest(sentence_tokens)) AS form FROM sentences), n AS (SELECT sentence_id, coalesce(lemma, form) AS item, count(*)::DOUBLE AS v FROM t LEFT JOIN one USING (form) WHERE form IS NOT NULL GROUP BY ALL), sh AS (SELECT sentence_id, item, v / sum(v) OVER (PARTITION BY sentence_id) AS v FROM n) SELECT sentence_id, item, round(v, 6) AS value FROM sh",
    "single_parameters": f"WITH {s.DIST}, k AS (SELECT verb_type, count(DISTINCT item) AS k FROM dist GROUP BY verb_type), t AS (SELECT verb_type, instance, value, (value + 0.01::DOUBLE / k) / (sum(value) OVER (PARTITION BY verb_type, instance) + 0.01::DOUBLE) AS theta FROM dist JOIN k USING (verb_type)) SELECT verb_type, instance, round(-sum(value * ln(theta)), 4) AS loss FROM t GROUP BY ALL",
    "model_pairs": "WITH t AS (SELECT DISTINCT source, lower(lang) AS lang FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL) SELECT x.source AS a, y.source AS b, count(*) AS n_shared FROM t x JOIN t y ON x.lang = y.lang AND x.source < y.source GROUP BY ALL",
    "npmi_frequent": None,
    "guarded_lookup": f"WITH {s.DIST}, {s.GOLD}, {s.PREDICTED} SELECT label, count(*) AS n FROM predicted JOIN gold USING (instance) GROUP BY label",
}
from verbloom.plans.association import _ROUND, _SYMMETRIC  # noqa: E402

SQL["npmi_frequent"] = f"WITH {s.BASE.replace('counts AS', 'counts0 AS')}, counts AS (SELECT * FROM counts0 WHERE label IN (SELECT label FROM counts0 GROUP BY label HAVING sum(n) >= 5)), {_SYMMETRIC.format(v='1')} {_ROUND}"


def _summary(name: str, clusters: str) -> str:
    curve = _CURVE.replace("counts AS (SELECT verb_type, cluster, label, count(*)::DOUBLE AS n FROM predicted", f"{s.LIGHT}, counts AS (SELECT verb_type, cluster, label, count(*)::DOUBLE AS n FROM {clusters}")
    return f"""(WITH {curve}, {_tuned('', 'range(1, 36)', _FIRST)}, x AS (SELECT *, round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END, 9) AS f FROM mean), best AS (SELECT * FROM x WHERE f = (SELECT max(f) FROM x)),
    want AS (SELECT CASE WHEN max(t) = 35 THEN min(t) WHEN min(t) = 1 THEN max(t) ELSE min(t) END AS w FROM best) SELECT '{name}' AS model, {_MEAN_OUT.replace(', weight', '')} FROM best, want WHERE t = w)"""


SQL["model_summary"] = _summary("heaviest", "predicted") + " UNION ALL " + _summary("lightest", "light")
