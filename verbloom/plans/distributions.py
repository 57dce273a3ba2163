"""Distribution algebra over the surrogate instances and the question distributions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verbloom.functions import dist as a
from verbloom.functions.clean import latest, norm_id, norm_question, usable
from verbloom.plans import surrogate as s
from verbloom.session import cut, table

c = F.col
KEYS = ["verb_type", "instance"]
HEAD, PRIOR_HEAD, ADD, ALPHA = 0.5, 0.8, 0.001, 0.01


def arg_questions(spark: SparkSession, d: str) -> DataFrame:
    """(arg_id, verb_lemma, question, weight) of valid arguments; equal questions add up."""
    rows = table(spark, d, "arg_feature").filter("arg_id IS NOT NULL").select("arg_id", "verb_lemma", "question_dist", "produced_at")
    x = latest(rows, ["arg_id"]).select("arg_id", norm_id("verb_lemma").alias("verb_lemma"), F.explode("question_dist").alias("x"))
    clean = x.filter(usable(c("x.weight"))).select("arg_id", "verb_lemma", norm_question("x.question").alias("question"), c("x.weight").alias("weight"))
    return clean.filter("question IS NOT NULL").groupBy("arg_id", "verb_lemma", "question").agg(F.sum("weight").alias("weight"))


def dist_sum(spark: SparkSession, d: str) -> DataFrame:
    return s.rounded(a.total(s.dist(spark, d), ["verb_type"]))


def global_prior(spark: SparkSession, d: str) -> DataFrame:
    """The share of each question in the sum of all arguments' weights."""
    q = cut(a.total(arg_questions(spark, d), [], "question", "weight"))
    return s.rounded(a.normalized(q, [], "weight", "share").select("question", "share"))


def rewritten_questions(spark: SparkSession, d: str) -> DataFrame:
    """Distributions after a rewrite of their keys (without the adverbial question words' variants), summed again."""
    q = arg_questions(spark, d)
    active = F.regexp_replace("question", "^(how much|how long|how) ", "how ")
    return s.rounded(a.total(q.withColumn("question", active), ["arg_id"], "question", "weight"))


def wh_marginal(spark: SparkSession, d: str) -> DataFrame:
    """Each argument's weight by question word."""
    wh = F.regexp_extract("question", "^(how much|how long|[a-z]+)", 1)
    return s.rounded(arg_questions(spark, d).withColumn("wh", wh).groupBy("arg_id", "wh").agg(F.sum("weight").alias("weight")))


def uniform_weights(spark: SparkSession, d: str) -> DataFrame:
    """1 over the number of an argument's questions, for each of them."""
    q = arg_questions(spark, d)
    return s.rounded(q.withColumn("weight", 1.0 / F.count(F.lit(1)).over(Window.partitionBy("arg_id"))).select("arg_id", "question", "weight"))


def tfidf_truncate(spark: SparkSession, d: str) -> DataFrame:
    return a.truncated(s.dist(spark, d), KEYS, HEAD)


def tfidf_dense_truncate(spark: SparkSession, d: str) -> DataFrame:
    """Valid vectors of mlm_feature in long form, cut to half their mass."""
    v = latest(table(spark, d, "mlm_feature").filter("feature_id IS NOT NULL").select("feature_id", "arg_mlm_vec", "produced_at"), ["feature_id"])
    flat = v.filter(F.size("arg_mlm_vec") == 64).select("feature_id", F.posexplode("arg_mlm_vec").alias("idx", "v")).select("feature_id", "idx", F.round(c("v").cast("double"), 5).alias("value"))
    whole = flat.withColumn("ok", F.min(F.coalesce(~F.isnan("value") & (c("value") >= 0), F.lit(False)).cast("int")).over(Window.partitionBy("feature_id"))).filter("ok = 1").drop("ok")
    exact = whole.withColumn("value", F.round(c("value") * 100000).cast("bigint"))
    return a.truncated_dense(exact.withColumn("value", c("value").cast("double")), ["feature_id"], HEAD).filter("value > 0")


def tfidf_rebalance(spark: SparkSession, d: str) -> DataFrame:
    dist = cut(s.dist(spark, d))
    return s.rounded(a.rebalanced(dist, a.smoothed_prior(dist, ADD), KEYS))


def tfidf_transform(spark: SparkSession, d: str) -> DataFrame:
    return s.rounded(a.distinctive_transform(cut(s.dist(spark, d)), KEYS, HEAD, PRIOR_HEAD, ADD))


def dirichlet_sparse(spark: SparkSession, d: str) -> DataFrame:
    dist = cut(s.dist(spark, d))
    return s.rounded(a.dirichlet_sparse(dist, dist.select("verb_type", "item").distinct(), KEYS, ["verb_type"], ALPHA))


def dirichlet_dense(spark: SparkSession, d: str) -> DataFrame:
    """Posterior of label counts in each cluster over the five labels."""
    n = s.counts(spark, d).groupBy("verb_type", "cluster").pivot("label", [f"R{i}" for i in range(5)]).agg(F.sum("n"))
    whole = sum((F.coalesce(f"R{i}", F.lit(0.0)) for i in range(1, 5)), F.coalesce("R0", F.lit(0.0)))
    return s.rounded(n.select("verb_type", "cluster", *(a.dirichlet(F.coalesce(f"R{i}", F.lit(0.0)), whole, F.lit(5.0), 1.0).alias(f"R{i}") for i in range(5))))


def log_sum_exp(spark: SparkSession, d: str) -> DataFrame:
    """log of the sum of exp(-value) per instance."""
    x = s.dist(spark, d).withColumn("lse", a.log_sum_exp(-c("value"), Window.partitionBy(*KEYS)))
    return s.rounded(x.select(*KEYS, "lse").distinct())


def inverted_odds(spark: SparkSession, d: str) -> DataFrame:
    return s.rounded(a.inverted_odds(s.dist(spark, d), KEYS))


def top_items(spark: SparkSession, d: str) -> DataFrame:
    """The 20 items with the largest share of each instance."""
    return s.rounded(a.top_items(a.normalized(s.dist(spark, d), KEYS), KEYS, 20))


def likely_items(spark: SparkSession, d: str) -> DataFrame:
    """Items with a share of at least 0.05."""
    return s.rounded(a.normalized(s.dist(spark, d), KEYS).filter("value >= 0.05"))


def top_sources(spark: SparkSession, d: str) -> DataFrame:
    """The 20 verb types with the largest share of each item, as one text with shares as log2."""
    share = a.normalized(a.total(s.dist(spark, d), ["verb_type"]), ["item"])
    top = a.top_items(share, ["item"], 20, "verb_type")
    text = F.concat(c("verb_type"), F.lit(" ("), F.round(F.log2("value"), 2).cast("string"), F.lit(")"))
    return top.groupBy("item").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", text.alias("t")))), lambda x: x["t"]), "; ").alias("sources"))


def vocab_top(spark: SparkSession, d: str) -> DataFrame:
    """Per lemma the 1023 items with the largest share in any argument, with sum, count and maximum of the shares."""
    rows = table(spark, d, "arg_feature").filter("arg_id IS NOT NULL").select("arg_id", "verb_lemma", "arg_mlm_dist", "produced_at")
    x = latest(rows, ["arg_id"]).select("arg_id", norm_id("verb_lemma").alias("verb_lemma"), F.explode("arg_mlm_dist").alias("x"))
    clean = x.filter(usable(c("x.weight")) & c("verb_lemma").isNotNull()).select("arg_id", "verb_lemma", norm_id("x.item").alias("item"), c("x.weight").alias("value")).filter("item IS NOT NULL")
    share = a.normalized(clean.groupBy("arg_id", "verb_lemma", "item").agg(F.sum("value").alias("value")), ["arg_id"])
    seen = share.groupBy("verb_lemma", "item").agg(F.round(F.max("value"), 9).alias("top"), F.round(F.sum("value"), 9).alias("total"), F.count(F.lit(1)).alias("n_args"))
    return a.top_items(seen, ["verb_lemma"], 1023, "item", "top")


def sampled_items(spark: SparkSession, d: str) -> DataFrame:
    return a.sampled(s.dist(spark, d), KEYS, seed=7)


QUERIES = {f.__name__: f for f in (dist_sum, global_prior, rewritten_questions, wh_marginal, uniform_weights, tfidf_truncate, tfidf_dense_truncate, tfidf_rebalance, tfidf_transform, dirichlet_sparse, dirichlet_dense, log_sum_exp, inverted_odds, top_items, likely_items, top_sources, vocab_top, sampled_items)}

NORM_ID = "lower(trim({c}, chr(32) || chr(9) || chr(10) || chr(13) || chr(11) || chr(12) || chr(160)))"
NORM_Q = "ltrim(rtrim(regexp_replace(lower({c}), '[\\s' || chr(160) || ']+', ' ', 'g'), '? '))"
VALID_ARG = "valid_arg AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY arg_id ORDER BY produced_at DESC NULLS LAST) AS _n FROM arg_feature WHERE arg_id IS NOT NULL) WHERE _n = 1)"
ARG_Q = f"""{VALID_ARG}, arg_q AS (SELECT arg_id, {NORM_ID.format(c='verb_lemma')} AS verb_lemma, {NORM_Q.format(c='u.question')} AS question, sum(u.weight) AS weight
    FROM (SELECT arg_id, verb_lemma, unnest(question_dist) AS u FROM valid_arg) WHERE u.question IS NOT NULL AND u.weight > 0 AND isfinite(u.weight) GROUP BY ALL)"""


def _trunc(name: str, head: float) -> str:
    return f"""{name} AS (SELECT verb_type, instance, item, value FROM (SELECT *, coalesce(sum(value) OVER (PARTITION BY verb_type, instance ORDER BY value DESC, item ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b,
        sum(value) OVER (PARTITION BY verb_type, instance) AS t FROM dist) WHERE b < {head}::DOUBLE * t)"""


_OVER = "OVER (PARTITION BY verb_type, instance)"
_SHARED = f"shared AS (SELECT verb_type, instance, item, value / sum(value) {_OVER} AS value FROM dist)"


def _prior(of: str) -> str:
    return f"""p0 AS (SELECT item, sum(value) / (SELECT sum(value) FROM {of}) + {ADD}::DOUBLE AS v FROM {of} GROUP BY item), prior AS (SELECT item, v / (SELECT sum(v) FROM p0) AS v FROM p0)"""


SQL = {
    "dist_sum": f"WITH {s.DIST} SELECT verb_type, item, sum(value) AS value FROM dist GROUP BY ALL",
    "global_prior": f"WITH {ARG_Q} SELECT question, round(sum(weight) / (SELECT sum(weight) FROM arg_q), 6) AS share FROM arg_q GROUP BY question",
    "rewritten_questions": f"WITH {ARG_Q} SELECT arg_id, regexp_replace(question, '^(how much|how long|how) ', 'how ') AS question, round(sum(weight), 6) AS weight FROM arg_q GROUP BY ALL",
    "wh_marginal": f"WITH {ARG_Q} SELECT arg_id, regexp_extract(question, '^(how much|how long|[a-z]+)', 1) AS wh, round(sum(weight), 6) AS weight FROM arg_q GROUP BY ALL",
    "uniform_weights": f"WITH {ARG_Q} SELECT arg_id, question, round(1::DOUBLE / count(*) OVER (PARTITION BY arg_id), 6) AS weight FROM arg_q",
    "tfidf_truncate": f"WITH {s.DIST}, {_trunc('cut', HEAD)} SELECT * FROM cut",
    "tfidf_dense_truncate": f"""WITH v AS (SELECT feature_id, arg_mlm_vec FROM (SELECT *, row_number() OVER (PARTITION BY feature_id ORDER BY produced_at DESC NULLS LAST) AS n FROM mlm_feature WHERE feature_id IS NOT NULL) WHERE n = 1 AND len(arg_mlm_vec) = 64),
    flat AS (SELECT feature_id, generate_subscripts(arg_mlm_vec, 1) - 1 AS idx, unnest(arg_mlm_vec)::DOUBLE AS value FROM v),
    ok AS (SELECT feature_id FROM flat GROUP BY feature_id HAVING bool_and(value IS NOT NULL AND NOT isnan(value) AND value >= 0)),
    x AS (SELECT feature_id, idx, round(round(value, 5) * 100000) AS value FROM flat SEMI JOIN ok USING (feature_id)),
    b AS (SELECT *, coalesce(sum(value) OVER (PARTITION BY feature_id ORDER BY value DESC, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, sum(value) OVER (PARTITION BY feature_id) AS t FROM x),
    k AS (SELECT *, max(CASE WHEN b >= {HEAD}::DOUBLE * t THEN value END) OVER (PARTITION BY feature_id) AS cutoff FROM b)
    SELECT feature_id, idx::INTEGER AS idx, value FROM k WHERE (cutoff IS NULL OR value > cutoff) AND value > 0""",
    "tfidf_rebalance": f"WITH {s.DIST}, {_prior('dist')}, q AS (SELECT verb_type, instance, item, value / v AS value FROM dist JOIN prior USING (item)) SELECT verb_type, instance, item, round(value / sum(value) {_OVER}, 6) AS value FROM q",
    "tfidf_transform": f"WITH {s.DIST}, {_trunc('cut', HEAD)}, {_trunc('wide', PRIOR_HEAD)}, {_prior('wide')}, q AS (SELECT verb_type, instance, item, value / v AS value FROM cut JOIN prior USING (item)) SELECT verb_type, instance, item, round(value / sum(value) {_OVER}, 6) AS value FROM q",
    "dirichlet_sparse": f"""WITH {s.DIST}, voc AS (SELECT verb_type, item, count(*) OVER (PARTITION BY verb_type) AS k FROM (SELECT DISTINCT verb_type, item FROM dist)),
    g AS (SELECT verb_type, instance, item, k, coalesce(value, 0) AS value FROM (SELECT DISTINCT verb_type, instance FROM dist) JOIN voc USING (verb_type) LEFT JOIN dist USING (verb_type, instance, item))
    SELECT verb_type, instance, item, round((value + {ALPHA}::DOUBLE / k) / (sum(value) {_OVER} + {ALPHA}::DOUBLE), 6) AS value FROM g""",
    "dirichlet_dense": f"WITH {s.BASE} SELECT verb_type, cluster, {', '.join(f'''round((sum(CASE WHEN label = 'R{i}' THEN n ELSE 0 END) + 0.2::DOUBLE) / (sum(n) + 1), 6) AS R{i}''' for i in range(5))} FROM counts GROUP BY ALL",
    "log_sum_exp": f"WITH {s.DIST}, m AS (SELECT *, max(-value) {_OVER} AS m FROM dist) SELECT verb_type, instance, round(any_value(m) + ln(sum(exp(-value - m))), 6) AS lse FROM m GROUP BY ALL",
    "inverted_odds": f"WITH {s.DIST} SELECT verb_type, instance, item, round((1 / value) / sum(1 / value) {_OVER}, 6) AS value FROM dist",
    "top_items": f"WITH {s.DIST}, {_SHARED} SELECT verb_type, instance, item, round(value, 6) AS value, rank FROM (SELECT *, row_number() OVER (PARTITION BY verb_type, instance ORDER BY value DESC, item) AS rank FROM shared) WHERE rank <= 20",
    "likely_items": f"WITH {s.DIST}, {_SHARED} SELECT verb_type, instance, item, round(value, 6) AS value FROM shared WHERE value >= 0.05::DOUBLE",
    "top_sources": f"""WITH {s.DIST}, t AS (SELECT verb_type, item, sum(value) AS v FROM dist GROUP BY ALL), sh AS (SELECT verb_type, item, v / sum(v) OVER (PARTITION BY item) AS v FROM t),
    r AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY v DESC, verb_type) AS k FROM sh) SELECT item, string_agg(verb_type || ' (' || round(log2(v), 2) || ')', '; ' ORDER BY k) AS sources FROM r WHERE k <= 20 GROUP BY item""",
    "vocab_top": f"""WITH {VALID_ARG}, e AS (SELECT arg_id, {NORM_ID.format(c='verb_lemma')} AS verb_lemma, {NORM_ID.format(c='u.item')} AS item, sum(u.weight) AS w FROM (SELECT arg_id, verb_lemma, unnest(arg_mlm_dist) AS u FROM valid_arg)
        WHERE u.item IS NOT NULL AND verb_lemma IS NOT NULL AND u.weight > 0 AND isfinite(u.weight) GROUP BY ALL),
    sh AS (SELECT *, w / sum(w) OVER (PARTITION BY arg_id) AS v FROM e), g AS (SELECT verb_lemma, item, round(max(v), 9) AS top, round(sum(v), 9) AS total, count(*) AS n_args FROM sh GROUP BY ALL)
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY verb_lemma ORDER BY top DESC, item) AS rank FROM g) WHERE rank <= 1023""",
}
