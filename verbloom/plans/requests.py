"""What a browser asks for one verb: thirteen point lookups by lemma, and joins over models, splits and settings.

Every lookup filters by the lemma before anything is shuffled. The tables hold no parses, so heads, functions and
constituent labels are those of the stand-in parses of `structure`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verbloom.functions import dist as a
from verbloom.functions import lexicon as x
from verbloom.functions.clean import latest, norm_id, usable
from verbloom.operators import metrics, relate, syntax, tuning
from verbloom.plans import features as f
from verbloom.plans import structure
from verbloom.plans import surrogate as s
from verbloom.plans.distributions import ARG_Q, NORM_ID, VALID_ARG, arg_questions
from verbloom.session import cut, table

c = F.col
LEMMA = "give"


def _args(spark: SparkSession, d: str, lemma: str, *payload: str) -> DataFrame:
    """The newest rows of a lemma's arguments: arg_id, sentence_id, verb_index, b, e and the payload."""
    t = table(spark, d, "arg_feature").filter("arg_id IS NOT NULL").select("arg_id", norm_id("verb_lemma").alias("lemma"), norm_id("sentence_id").alias("sentence_id"), "verb_index", "arg_span", "produced_at", *payload)
    v = latest(t, ["arg_id"], ties=("lemma", "sentence_id", "verb_index")).filter((c("lemma") == lemma) & (F.size("arg_span") == 2))
    return v.select("arg_id", "sentence_id", "verb_index", c("arg_span")[0].alias("b"), c("arg_span")[1].alias("e"), *payload)


def _roles(spark: SparkSession, d: str, lemma: str) -> DataFrame:
    return f.roles(spark, d).filter(c("lemma") == lemma)


def _parsed_of(spark: SparkSession, d: str, lemma: str) -> tuple[DataFrame, DataFrame]:
    """(arguments of a lemma by their first token, parsed tokens of its sentences)."""
    own = cut(_roles(spark, d, lemma).select("sentence_id", "verb_index", c("b").alias("idx")).distinct())
    tokens = structure.parsed(spark, d).join(own.select("sentence_id").distinct(), "sentence_id", "left_semi")
    return own, cut(tokens)


def request_inflections(spark: SparkSession, d: str, lemma: str = LEMMA) -> DataFrame:
    return table(spark, d, "verb_inflection").filter(F.lower("stem") == lemma).distinct()


def request_sentences(spark: SparkSession, d: str, lemma: str = LEMMA) -> DataFrame:
    return _roles(spark, d, lemma).select("sentence_id").distinct()


def request_sentence(spark: SparkSession, d: str, sentence_id: str | None = None) -> DataFrame:
    """Tokens of a sentence (by default of the first one) with its verbs' roles that begin there."""
    t = f.sentences(spark, d)
    wanted = F.lit(sentence_id) if sentence_id else t.agg(F.min("sentence_id")).scalar()
    tokens = t.filter(c("sentence_id") == wanted).select("sentence_id", F.posexplode("sentence_tokens").alias("idx", "token"))
    role = f.roles(spark, d).groupBy("sentence_id", c("b").alias("idx")).agg(F.array_join(F.array_sort(F.collect_set("role")), " ").alias("roles"))
    return tokens.join(role, ["sentence_id", "idx"], "left")


def request_gold_labels(spark: SparkSession, d: str, lemma: str = LEMMA) -> DataFrame:
    return _roles(spark, d, lemma).select("sentence_id", "verb_index", "frameset", "role", "b", "e")


def request_question_dists(spark: SparkSession, d: str, lemma: str = LEMMA) -> DataFrame:
    return s.rounded(arg_questions(spark, d).filter(c("verb_lemma") == lemma).select("arg_id", "question", "weight"))


def request_arg_spans(spark: SparkSession, d: str, lemma: str = LEMMA) -> DataFrame:
    """Spans of each argument with their weight: 1 for the one that the row has."""
    return _args(spark, d, lemma).select("arg_id", "b", "e", F.lit(1.0).alias("weight"))


def request_arg_prepositions(spark: SparkSession, d: str, lemma: str = LEMMA) -> DataFrame:
    own, tokens = _parsed_of(spark, d, lemma)
    return syntax.prepositions(own, tokens)


def request_arg_constituents(spark: SparkSession, d: str, lemma: str = LEMMA) -> DataFrame:
    """Constituent labels with and without their function tag."""
    own, tokens = _parsed_of(spark, d, lemma)
    label = own.join(tokens.select("sentence_id", "idx", F.concat_ws("-", "pos", "dep_label").alias("label")), ["sentence_id", "idx"])
    return label.withColumn("stripped", x.without_function_tag(c("label")))


def request_arg_indices(spark: SparkSession, d: str, lemma: str = LEMMA) -> DataFrame:
    own, tokens = _parsed_of(spark, d, lemma)
    return syntax.heads(own, tokens)


def request_arg_functions(spark: SparkSession, d: str, lemma: str = LEMMA) -> DataFrame:
    own, tokens = _parsed_of(spark, d, lemma)
    return syntax.functions(own, tokens)


def _items(spark: SparkSession, d: str, lemma: str) -> DataFrame:
    """(arg_id, sentence_id, b, e, item, share) of the arguments' own distributions."""
    e = _args(spark, d, lemma, "arg_mlm_dist").select("arg_id", "sentence_id", "b", "e", F.explode("arg_mlm_dist").alias("x")).filter(usable(c("x.weight")) & c("x.item").isNotNull())
    keys = ["arg_id", "sentence_id", "b", "e"]
    return a.normalized(e.groupBy(*keys, norm_id("x.item").alias("item")).agg(F.sum("x.weight").alias("value")), keys)


def request_arg_mlm(spark: SparkSession, d: str, lemma: str = LEMMA) -> DataFrame:
    return s.rounded(_items(spark, d, lemma).select("arg_id", "item", "value"))


def request_prep_mlm(spark: SparkSession, d: str, lemma: str = LEMMA) -> DataFrame:
    """Mixtures by preposition: for each leading word of a lemma's arguments the mean of their distributions."""
    words = f.sentences(spark, d).select("sentence_id", "sentence_tokens")
    own = cut(_items(spark, d, lemma).join(words, "sentence_id", "left"))
    first = F.lower(F.get("sentence_tokens", c("b")))
    prep = F.when(first.isin(*x.PREPOSITIONS) & (c("e") - c("b") > 1), first).otherwise("<none>")
    rows = own.select("arg_id", prep.alias("prep"), "item", "value")
    n = rows.groupBy("prep").agg(F.countDistinct("arg_id").alias("n"))
    return s.rounded(rows.groupBy("prep", "item").agg(F.sum("value").alias("value")).join(n, "prep").select("prep", "item", (c("value") / c("n")).alias("value")))


def request_verb_mlm(spark: SparkSession, d: str, lemma: str = LEMMA) -> DataFrame:
    """The lemma's vectors as items of its vocabulary."""
    t = table(spark, d, "mlm_feature").filter("feature_id IS NOT NULL").select("feature_id", norm_id("verb_lemma").alias("lemma"), "arg_mlm_vec", "produced_at")
    v = latest(t, ["feature_id"], ties=("lemma",)).filter((c("lemma") == lemma) & (F.size("arg_mlm_vec") == 64))
    entry = v.select("feature_id", F.posexplode("arg_mlm_vec").alias("idx", "v")).filter("v > 0 AND NOT isnan(v)").select("feature_id", "idx", c("v").cast("double").alias("value"))
    vocab = table(spark, d, "mlm_vocab").filter(norm_id("verb_lemma") == lemma).select(F.posexplode("items").alias("idx", "item"))
    return s.rounded(entry.join(vocab, "idx").select("feature_id", "item", "value"))


# --- joins over models, splits and settings


def split_features(spark: SparkSession, d: str) -> DataFrame:
    """Sentences and labelled arguments of each split, joined by the split."""
    t = f.sentences(spark, d).withColumn("data_split", F.coalesce("data_split", F.lit("none")))
    n = t.groupBy("data_split").agg(F.count(F.lit(1)).alias("n_sentences"))
    role = f.roles(spark, d).join(t.select("sentence_id", "data_split"), "sentence_id").groupBy("data_split").agg(F.count(F.lit(1)).alias("n_arguments"), F.countDistinct("lemma").alias("n_lemmas"))
    return n.join(role, "data_split")


def models_merged(spark: SparkSession, d: str) -> DataFrame:
    """Clusters of two models by name: their sizes, and which of the two has them."""
    size = lambda clusters, n: clusters.groupBy("verb_type", "cluster").agg(F.count(F.lit(1)).alias(n))
    return relate.merged(size(s.predicted(spark, d), "n_heaviest"), size(s.predicted_light(spark, d), "n_lightest"), ["verb_type", "cluster"])


def models_loaded(spark: SparkSession, d: str) -> DataFrame:
    """All models' trees by verb type; each model has a verb type once. Models of arguments alone get one verb leaf."""
    part = lambda name, clusters: clusters.groupBy("verb_type").agg(F.countDistinct("cluster").alias("n_leaves"), F.count(F.lit(1)).alias("n_members")).withColumn("model", F.lit(name))
    out = relate.union_unique([part("heaviest", s.predicted(spark, d)), part("lightest", s.predicted_light(spark, d))], ["model", "verb_type"])
    return out.select("model", "verb_type", "n_leaves", "n_members", F.lit(1).cast("bigint").alias("n_verb_leaves"))


def models_with_settings(spark: SparkSession, d: str) -> DataFrame:
    """Models that have a tuned setting, with the scores that it gives."""
    specs = spark.createDataFrame([("heaviest", "num-clusters", 3.0), ("nowhere", "num-clusters", 5.0)], "model string, criterion string, threshold double")
    gold, out = s.gold(spark, d), None
    for name, clusters in (("heaviest", s.predicted(spark, d)), ("lightest", s.predicted_light(spark, d))):
        own = tuning.tuned(cut(tuning.linear_curve(metrics.label_counts(clusters, gold, ["instance"]))), "num-clusters=3,5").withColumn("model", F.lit(name))
        out = own if out is None else out.unionByName(own)
    return s.rounded(out.join(specs, ["model", "criterion"]).filter("t = threshold").select("model", "criterion", "t", "precision", "recall", "f1"))


def active_metrics(spark: SparkSession, d: str) -> DataFrame:
    """The scores of the metrics that evaluations run: B-cubed by instance, purity and collocation."""
    counts = s.counts(spark, d).withColumn("g", F.lit("All"))
    b3 = metrics.micro(metrics.b3_cells(s.counts(spark, d)).withColumn("g", F.lit("All")), ["g"]).select(F.lit("b3-instance").alias("metric"), "precision", "recall", "f1")
    pc = metrics.purity_collocation(counts, ["g"]).select(F.lit("pur-coll").alias("metric"), c("purity").alias("precision"), c("collocation").alias("recall"), "f1")
    return s.rounded(b3.unionByName(pc))


def pair_lists(spark: SparkSession, d: str) -> DataFrame:
    """Label counts of clusters written as JSON lists of pairs and read again, with their sum in fixed width."""
    m = s.counts(spark, d).groupBy("verb_type", "cluster").agg(F.map_from_entries(F.collect_list(F.struct("label", "n"))).alias("m"))
    back = m.select("verb_type", "cluster", F.map_values(a.from_pairs(a.to_pairs(c("m")), "string")).alias("v"))
    total = F.aggregate("v", F.lit(0.0), lambda acc, v: acc + v)
    return back.select("verb_type", "cluster", F.size("v").alias("n_labels"), a.fixed_width(total, 9, 2).alias("total"))


_NAMES = (request_inflections, request_sentences, request_sentence, request_gold_labels, request_question_dists, request_arg_spans, request_arg_prepositions, request_arg_constituents, request_arg_indices, request_arg_functions, request_arg_mlm, request_prep_mlm, request_verb_mlm, split_features, models_merged, models_loaded, models_with_settings, active_metrics, pair_lists)
QUERIES = {g.__name__: g for g in _NAMES}

_P = f"WITH RECURSIVE {f.ROLES}, {structure._PARSED}, own AS (SELECT DISTINCT sentence_id, verb_index, b AS idx FROM roles WHERE lemma = '{LEMMA}')"
_OF = "FROM own a LEFT JOIN parse k ON k.sentence_id = a.sentence_id AND k.idx = a.idx"
_ARGS = f"""af AS (SELECT * FROM (SELECT arg_id, {NORM_ID.format(c='verb_lemma')} AS lemma, {NORM_ID.format(c='sentence_id')} AS sid, verb_index, arg_span, arg_mlm_dist, row_number() OVER (PARTITION BY arg_id ORDER BY produced_at DESC NULLS LAST, {NORM_ID.format(c='verb_lemma')} DESC NULLS LAST, {NORM_ID.format(c='sentence_id')} DESC NULLS LAST, verb_index DESC NULLS LAST) AS n FROM arg_feature WHERE arg_id IS NOT NULL) WHERE n = 1 AND lemma = '{LEMMA}' AND len(arg_span) = 2),
    it AS (SELECT arg_id, sid, arg_span[1] AS b, arg_span[2] AS e, {NORM_ID.format(c='u.item')} AS item, sum(u.weight) AS w FROM (SELECT *, unnest(arg_mlm_dist) AS u FROM af) WHERE u.item IS NOT NULL AND u.weight > 0 AND isfinite(u.weight) GROUP BY ALL),
    sh AS (SELECT *, w / sum(w) OVER (PARTITION BY arg_id) AS v FROM it)"""
_PREPS = f._IN("about above across after against along around at before behind between by for from in inside into near of on outside over through to toward under with without".split())
_LIGHT_N = "SELECT verb_type, cluster, count(*) AS n FROM {0} GROUP BY ALL"
SQL = {
    "request_inflections": f"SELECT DISTINCT stem, present_singular3rd, present_participle, past_form, past_participle FROM verb_inflection WHERE lower(stem) = '{LEMMA}'",
    "request_sentences": f"WITH {f.ROLES} SELECT DISTINCT sentence_id FROM roles WHERE lemma = '{LEMMA}'",
    "request_sentence": f"WITH {f.ROLES}, {f.SENTENCES}, t AS (SELECT sentence_id, (generate_subscripts(sentence_tokens, 1) - 1)::INTEGER AS idx, unnest(sentence_tokens) AS token FROM sentences WHERE sentence_id = (SELECT min(sentence_id) FROM sentences)), r AS (SELECT sentence_id, b AS idx, string_agg(DISTINCT role, ' ' ORDER BY role) AS roles FROM roles GROUP BY ALL) SELECT t.*, roles FROM t LEFT JOIN r USING (sentence_id, idx)",
    "request_gold_labels": f"WITH {f.ROLES} SELECT sentence_id, verb_index, frameset, role, b, e FROM roles WHERE lemma = '{LEMMA}'",
    "request_question_dists": f"WITH {ARG_Q} SELECT arg_id, question, round(weight, 6) AS weight FROM arg_q WHERE verb_lemma = '{LEMMA}'",
    "request_arg_spans": f"WITH {_ARGS} SELECT arg_id, arg_span[1] AS b, arg_span[2] AS e, 1::DOUBLE AS weight FROM af",
    "request_arg_prepositions": f"{_P} SELECT a.sentence_id, verb_index, a.idx, CASE WHEN pos IN ('IN', 'TO') THEN lower(token) ELSE '<none>' END AS prep {_OF}",
    "request_arg_constituents": f"{_P} SELECT a.sentence_id, verb_index, a.idx, pos || '-' || label AS label, pos AS stripped {_OF.replace('LEFT JOIN', 'JOIN')}",
    "request_arg_indices": f"{_P}, kid AS (SELECT sentence_id, head AS idx, min(idx) FILTER (label = 'PMOD') AS pmod, min(idx) FILTER (label = 'IM') AS im FROM parse WHERE head >= 0 GROUP BY ALL) SELECT a.sentence_id, verb_index, a.idx, coalesce(CASE WHEN pos IN ('IN', 'TO', 'RB') THEN pmod END, CASE WHEN pos = 'TO' THEN im END, a.idx) AS head_idx {_OF} LEFT JOIN kid ON kid.sentence_id = a.sentence_id AND kid.idx = a.idx",
    "request_arg_functions": f"{_P} SELECT a.sentence_id, verb_index, a.idx, label AS function {_OF}",
    "request_arg_mlm": f"WITH {_ARGS} SELECT arg_id, item, round(v, 6) AS value FROM sh",
    "request_prep_mlm": f"WITH {f.SENTENCES}, {_ARGS}, p AS (SELECT arg_id, item, v, CASE WHEN lower(sentence_tokens[b + 1]) IN {_PREPS} AND e - b > 1 THEN lower(sentence_tokens[b + 1]) ELSE '<none>' END AS prep FROM sh LEFT JOIN sentences ON sentence_id = sid), n AS (SELECT prep, count(DISTINCT arg_id) AS n FROM p GROUP BY prep) SELECT prep, item, round(sum(v) / any_value(n), 6) AS value FROM p JOIN n USING (prep) GROUP BY prep, item",
    "request_verb_mlm": f"WITH v AS (SELECT * FROM (SELECT feature_id, {NORM_ID.format(c='verb_lemma')} AS vt, arg_mlm_vec, row_number() OVER (PARTITION BY feature_id ORDER BY produced_at DESC NULLS LAST, {NORM_ID.format(c='verb_lemma')} DESC NULLS LAST) AS n FROM mlm_feature WHERE feature_id IS NOT NULL) WHERE n = 1 AND vt = '{LEMMA}' AND len(arg_mlm_vec) = 64), e AS (SELECT feature_id, generate_subscripts(arg_mlm_vec, 1) AS i, unnest(arg_mlm_vec)::DOUBLE AS x FROM v), voc AS (SELECT generate_subscripts(items, 1) AS i, unnest(items) AS item FROM mlm_vocab WHERE {NORM_ID.format(c='verb_lemma')} = '{LEMMA}') SELECT feature_id, item, round(x, 6) AS value FROM e JOIN voc USING (i) WHERE x > 0 AND NOT isnan(x)",
    "split_features": f"WITH {f.ROLES}, s AS (SELECT sentence_id, coalesce(split, 'none') AS data_split FROM (SELECT sentence_id, {NORM_ID.format(c='data_split')} AS split, row_number() OVER (PARTITION BY sentence_id ORDER BY ingested_at NULLS FIRST, {NORM_ID.format(c='data_split')} NULLS FIRST) AS n FROM sentence WHERE sentence_id IS NOT NULL) WHERE n = 1), n AS (SELECT data_split, count(*) AS n_sentences FROM s GROUP BY 1), r AS (SELECT data_split, count(*) AS n_arguments, count(DISTINCT lemma) AS n_lemmas FROM roles JOIN s USING (sentence_id) GROUP BY 1) SELECT * FROM n JOIN r USING (data_split)",
    "models_merged": f"WITH {s.DIST}, {s.PREDICTED}, {s.LIGHT}, x AS ({_LIGHT_N.format('predicted')}), y AS ({_LIGHT_N.format('light')}) SELECT verb_type, cluster, x.n AS n_heaviest, y.n AS n_lightest, CASE WHEN x.n IS NULL THEN 'right' WHEN y.n IS NULL THEN 'left' ELSE 'both' END AS side FROM x FULL JOIN y USING (verb_type, cluster)",
    "models_loaded": f"WITH {s.DIST}, {s.PREDICTED}, {s.LIGHT}, m AS (SELECT 'heaviest' AS model, * FROM predicted UNION ALL SELECT 'lightest', * FROM light) SELECT model, verb_type, count(DISTINCT cluster) AS n_leaves, count(*) AS n_members, 1::BIGINT AS n_verb_leaves FROM m GROUP BY ALL",
    "active_metrics": f"WITH {s.BASE}, {s.CELLS}, b AS (SELECT 'b3-instance' AS metric, sum(n * p) / sum(n) AS precision, sum(n * r) / sum(n) AS recall FROM cells), pu AS (SELECT sum(m) / sum(n) AS p FROM (SELECT max(n) AS m, sum(n) AS n FROM counts GROUP BY verb_type, cluster)), co AS (SELECT sum(m) / sum(n) AS r FROM (SELECT max(n) AS m, sum(n) AS n FROM counts GROUP BY verb_type, label)), u AS (SELECT * FROM b UNION ALL SELECT 'pur-coll', p, r FROM pu, co) SELECT metric, round(precision, 6) AS precision, round(recall, 6) AS recall, round(2 * precision * recall / (precision + recall), 6) AS f1 FROM u",
    "pair_lists": f"WITH {s.BASE} SELECT verb_type, cluster, count(*)::INTEGER AS n_labels, printf('%9.2f', sum(n)) AS total FROM counts GROUP BY ALL",
}
from verbloom.plans.clustering import _CURVE, _FIRST, _tuned  # noqa: E402

SQL["models_with_settings"] = f"WITH {_CURVE}, {_tuned('', '[3]', _FIRST)} SELECT 'heaviest' AS model, 'num-clusters' AS criterion, t, round(precision, 6) AS precision, round(recall, 6) AS recall, round(2 * precision * recall / (precision + recall), 6) AS f1 FROM mean"
