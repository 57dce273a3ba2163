"""Features of verbs and arguments from the prediction, role and sentence tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verbloom.functions import dist as a
from verbloom.functions import lexicon as x
from verbloom.functions.clean import latest, norm_id, norm_label, norm_question
from verbloom.operators import association, models
from verbloom.operators import relate as r
from verbloom.plans.distributions import ARG_Q, NORM_ID, NORM_Q, arg_questions
from verbloom.plans.surrogate import rounded
from verbloom.session import cut, table

c = F.col


def roles(spark: SparkSession, d: str) -> DataFrame:
    """Distinct labelled arguments of prop_bank_role: sentence_id, verb_index, frameset, lemma, role, b, e."""
    t = table(spark, d, "prop_bank_role").filter((F.size("arg_span") == 2) & (F.get("arg_span", F.lit(0)) < F.get("arg_span", F.lit(1))))
    t = t.select(norm_id("sentence_id").alias("sentence_id"), "verb_index", norm_id("frameset_id").alias("frameset"), norm_label("role_label").alias("role"), c("arg_span")[0].alias("b"), c("arg_span")[1].alias("e"))
    whole = t.filter("sentence_id IS NOT NULL AND verb_index IS NOT NULL AND role IS NOT NULL AND frameset IS NOT NULL").distinct()
    return whole.withColumn("lemma", x.lemma_of(c("frameset")))


def sentences(spark: SparkSession, d: str) -> DataFrame:
    """One row per sentence id: the first of repeated ones."""
    t = table(spark, d, "sentence").filter("sentence_id IS NOT NULL").select("sentence_id", "sentence_tokens", norm_id("data_split").alias("data_split"), "ingested_at")
    return r.first_of(t, ["sentence_id"], [c("ingested_at"), c("data_split")]).drop("ingested_at")


def spans(spark: SparkSession, d: str) -> DataFrame:
    """Entries of valid beams: sentence_id, verb_index, b, e, p (usable or null), questions."""
    t = table(spark, d, "verb_prediction").select(norm_id("sentence_id").alias("sentence_id"), "verb_index", "beam_page", "produced_at", "beam")
    v = latest(t.filter("sentence_id IS NOT NULL AND verb_index IS NOT NULL"), ["sentence_id", "verb_index", "beam_page"])
    e = v.select("sentence_id", "verb_index", F.explode("beam").alias("x")).filter((F.size("x.span") == 2) & (F.get("x.span", F.lit(0)) < F.get("x.span", F.lit(1))))
    p = F.when((c("x.span_prob") >= 0) & (c("x.span_prob") <= 1), c("x.span_prob"))
    return e.select("sentence_id", "verb_index", c("x.span")[0].alias("b"), c("x.span")[1].alias("e"), p.alias("p"), c("x.questions").alias("questions"))


# --- filters and projections


def roles_relevant(spark: SparkSession, d: str) -> DataFrame:
    return roles(spark, d).filter(x.is_relevant(c("role"), c("lemma"), c("b"), c("e"), c("verb_index"))).select("sentence_id", "verb_index", "role", "b", "e")


def roles_plain(spark: SparkSession, d: str) -> DataFrame:
    """Counts of roles that neither refer to nor continue another."""
    return roles(spark, d).filter(~x.continues_other(c("role"))).groupBy("role").agg(F.count(F.lit(1)).alias("n"))


def role_groups(spark: SparkSession, d: str) -> DataFrame:
    return roles(spark, d).groupBy(x.role_group(c("role")).alias("role_group")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("role").alias("n_roles"))


def role_order(spark: SparkSession, d: str) -> DataFrame:
    """Roles with their place: listed ones first, then by name."""
    w = Window.orderBy(x.role_rank(c("role")), "role")  # one row per role: a handful
    return roles(spark, d).select("role").distinct().select("role", F.row_number().over(w).cast("bigint").alias("place"))


def verb_types(spark: SparkSession, d: str) -> DataFrame:
    """Verb types with sense, their lemma, and how many verbs have each."""
    return roles(spark, d).groupBy(c("frameset").alias("verb_type"), x.lemma_of(c("frameset")).alias("lemma")).agg(F.countDistinct("sentence_id", "verb_index").alias("n_verbs"))


def verbal_forms(spark: SparkSession, d: str) -> DataFrame:
    """Inflected forms with their tags, verbal ones only (the stem as noun is not)."""
    t = table(spark, d, "verb_inflection")
    tags = {"stem": "NN", "present_singular3rd": "VBZ", "present_participle": "VBG", "past_form": "VBD", "past_participle": "VBN"}
    long = t.select(F.lower("stem").alias("lemma"), F.explode(F.array(*[F.struct(F.lit(tag).alias("pos"), F.lower(col).alias("form")) for col, tag in tags.items()])).alias("f"))
    return long.select("lemma", "f.pos", "f.form").filter(x.is_verbal(c("pos")) & c("form").isNotNull() & c("lemma").isNotNull()).distinct()


def questions_valid(spark: SparkSession, d: str) -> DataFrame:
    """Span entries with at least 2 questions of which at most 1 has no usable probability."""
    bad = lambda q: F.coalesce(q["question_prob"].isNull() | F.isnan(q["question_prob"]) | (q["question_prob"] <= 0), F.lit(True))
    e = spans(spark, d).filter((F.size("questions") >= 2) & (F.size(F.filter("questions", bad)) <= 1))
    return e.groupBy("sentence_id").agg(F.count(F.lit(1)).alias("n_entries"))


def documents_by_round(spark: SparkSession, d: str) -> DataFrame:
    """Documents of sources that begin with annotation- or end with -archive."""
    s = c("source")
    return table(spark, d, "documents").filter(s.startswith("annotation-") | s.endswith("-archive")).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


# --- joins


def exact_span_questions(spark: SparkSession, d: str) -> DataFrame:
    """Question weights of labelled arguments: of the first predicted entry with exactly the argument's span, each
    question's probability times the span's."""
    first = r.first_of(spans(spark, d).filter("p IS NOT NULL AND questions IS NOT NULL"), ["sentence_id", "verb_index", "b", "e"], [c("p").desc(), F.to_json("questions")])
    q = first.select("sentence_id", "verb_index", "b", "e", "p", F.explode("questions").alias("q"))
    good = q.filter((c("q.question_prob") > 0) & (c("q.question_prob") <= 1)).withColumn("question", norm_question("q.question_string"))
    weighed = good.groupBy("sentence_id", "verb_index", "b", "e", "question").agg(F.sum(c("p") * c("q.question_prob")).alias("weight"))
    arg = roles(spark, d).select("sentence_id", "verb_index", "b", "e").distinct()
    return rounded(weighed.join(arg, ["sentence_id", "verb_index", "b", "e"]), 9)


def questions_or_default(spark: SparkSession, d: str) -> DataFrame:
    """Like exact_span_questions; arguments without an exact span get their role as the question, weight 1."""
    arg = roles(spark, d).groupBy("sentence_id", "verb_index", "b", "e").agg(F.min("role").alias("role"))
    joined = arg.join(exact_span_questions(spark, d), ["sentence_id", "verb_index", "b", "e"], "left")
    return joined.select("sentence_id", "verb_index", "b", "e", F.coalesce("question", F.lower("role")).alias("question"), F.coalesce("weight", F.lit(1.0)).alias("weight"))


def span_containment(spark: SparkSession, d: str) -> DataFrame:
    """Per labelled argument, how many distinct predicted spans of the same verb contain its first token."""
    arg = roles(spark, d).select("sentence_id", "verb_index", c("b").alias("token"), "role").distinct()
    predicted = spans(spark, d).select("sentence_id", "verb_index", "b", "e").distinct()
    hit = r.containing(arg, predicted, ["sentence_id", "verb_index"], "token", "b", "e")
    return hit.groupBy("sentence_id", "verb_index", "token", "role").agg(F.count(F.lit(1)).alias("n_spans"))


def verbs_predicted(spark: SparkSession, d: str) -> DataFrame:
    """Verbs with labels that also have predictions (left semi)."""
    v = roles(spark, d).select("sentence_id", "verb_index").distinct()
    return v.join(spans(spark, d), ["sentence_id", "verb_index"], "left_semi")


def verbs_unpredicted(spark: SparkSession, d: str) -> DataFrame:
    """Verbs with labels that have none (left anti)."""
    v = roles(spark, d).select("sentence_id", "verb_index").distinct()
    return v.join(spans(spark, d), ["sentence_id", "verb_index"], "left_anti")


def span_union(spark: SparkSession, d: str) -> DataFrame:
    """Labelled and predicted spans of verbs together, each once."""
    cols = ["sentence_id", "verb_index", "b", "e"]
    return roles(spark, d).select(*cols).union(spans(spark, d).select(*cols)).distinct().groupBy("sentence_id").agg(F.count(F.lit(1)).alias("n_spans"))


def sentence_verbs(spark: SparkSession, d: str) -> DataFrame:
    """Sentences with the verbs that have labels, nested: verb index and number of arguments, as text."""
    v = roles(spark, d).groupBy("sentence_id", "verb_index").agg(F.count(F.lit(1)).alias("n"))
    nested = v.groupBy("sentence_id").agg(F.sort_array(F.collect_list(F.struct("verb_index", "n"))).alias("v"))
    text = F.array_join(F.transform("v", lambda y: F.concat_ws(":", y["verb_index"].cast("string"), y["n"].cast("string"))), " ")
    return sentences(spark, d).join(nested, "sentence_id").select("sentence_id", F.size("sentence_tokens").cast("bigint").alias("n_tokens"), text.alias("verbs"))


def relabelled(spark: SparkSession, d: str) -> DataFrame:
    """Documents' language with a second source (the majority of their source), the original kept where there is none."""
    lang = table(spark, d, "documents").select("doc_id", "source", F.lower(F.substring_index("lang", "-", 1)).alias("lang"))
    known = lang.filter("lang IS NOT NULL AND source IS NOT NULL").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))
    major = r.first_of(known, ["source"], [c("n").desc(), c("lang")]).select("source", c("lang").alias("major"))
    return lang.join(major, "source", "left").select("doc_id", F.coalesce("lang", "major").alias("lang"))


# --- tokens


def token_offsets(spark: SparkSession, d: str) -> DataFrame:
    """Character offset of each token when tokens are joined by single blanks; per sentence the last and its length."""
    t = sentences(spark, d).select("sentence_id", F.posexplode("sentence_tokens").alias("idx", "token")).withColumn("token", F.coalesce("token", F.lit("")))
    o = r.offsets(t, ["sentence_id"], "idx", F.length("token") + 1)
    return o.groupBy("sentence_id").agg(F.max("offset").alias("last_offset"), F.sum("offset").alias("sum_offsets"))


def token_gap_ranks(spark: SparkSession, d: str) -> DataFrame:
    """Positions of tokens that aren't punctuation among themselves, summed per sentence."""
    t = sentences(spark, d).select("sentence_id", F.posexplode("sentence_tokens").alias("idx", "token")).withColumn("token", F.coalesce("token", F.lit("")))
    g = r.without_gaps(t, ["sentence_id"], "idx", ~c("token").rlike("[A-Za-z0-9]"))
    return g.groupBy("sentence_id").agg(F.count(F.lit(1)).alias("n_words"), F.max("rank").alias("last_rank"))


def leading_prepositions(spark: SparkSession, d: str) -> DataFrame:
    """Preposition that leads each labelled argument of more than one token (<none> if there is none), by role."""
    arg = roles(spark, d).join(sentences(spark, d).select("sentence_id", "sentence_tokens"), "sentence_id").filter(c("e") <= F.size("sentence_tokens"))
    first = F.lower(F.get("sentence_tokens", c("b")))
    prep = F.when(first.isin(*x.PREPOSITIONS) & (c("e") - c("b") > 1), first).otherwise("<none>")
    return arg.groupBy("role", prep.alias("prep")).agg(F.count(F.lit(1)).alias("n"))


def span_texts(spark: SparkSession, d: str) -> DataFrame:
    """Most frequent text of the arguments of each role."""
    arg = roles(spark, d).join(sentences(spark, d).select("sentence_id", "sentence_tokens"), "sentence_id").filter(c("e") <= F.size("sentence_tokens"))
    n = arg.groupBy("role", x.span_text(c("sentence_tokens"), c("b"), c("e")).alias("text")).agg(F.count(F.lit(1)).alias("n"))
    return r.first_of(n, ["role"], [c("n").desc(), c("text")])


def argument_sides(spark: SparkSession, d: str, side: str = "mnag") -> DataFrame:
    """Labelled arguments with `side`, null for those that no rule takes. The tables have no parses, so the function of an
    argument is that of its role's name (TMP of ARGM-TMP)."""
    arg = roles(spark, d).join(sentences(spark, d).select("sentence_id", "sentence_tokens"), "sentence_id", "left")
    text = x.span_text(c("sentence_tokens"), c("b"), c("e"))
    function = F.regexp_replace("role", "^ARGM-", "")
    label = models.side_label(models.side_flags(side), text, function, function, c("role"), c("frameset"))
    return arg.select("sentence_id", "verb_index", "frameset", "lemma", "role", "b", "e", label.alias("side"))


def side_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Arguments taken out before clustering by texts and adjunct functions: the number of each kind, and of the rest."""
    return argument_sides(spark, d, "mnad").groupBy(F.coalesce("side", F.lit("remaining")).alias("side")).agg(F.count(F.lit(1)).alias("n"))


def side_gold(spark: SparkSession, d: str) -> DataFrame:
    """The same with roles and senses for the rest, as in gold models: by lemma and kind."""
    return argument_sides(spark, d, "mndr").groupBy("lemma", "side").agg(F.count(F.lit(1)).alias("n"))


def rule_lexica(spark: SparkSession, d: str) -> DataFrame:
    """The texts of each rule that takes arguments out, and how many arguments have each."""
    arg = roles(spark, d).join(sentences(spark, d).select("sentence_id", "sentence_tokens"), "sentence_id")
    n = arg.groupBy(x.span_text(c("sentence_tokens"), c("b"), c("e")).alias("text")).agg(F.count(F.lit(1)).alias("n"))
    words = spark.createDataFrame([(name, w) for name, ws in x.LEXICA.items() for w in ws], "lexicon string, text string")
    return words.join(n, "text", "left").select("lexicon", "text", F.coalesce("n", F.lit(0)).alias("n"))


# --- analyses and views


def sense_counts(spark: SparkSession, d: str) -> DataFrame:
    return roles(spark, d).groupBy("lemma").agg(F.countDistinct("frameset").alias("n_senses"), F.countDistinct("sentence_id", "verb_index").alias("n_verbs"))


def role_questions(spark: SparkSession, d: str) -> DataFrame:
    """Questions of each role by share, those above 0.005."""
    q = questions_or_default(spark, d).join(roles(spark, d).select("sentence_id", "verb_index", "b", "e", "role").distinct(), ["sentence_id", "verb_index", "b", "e"])
    share = a.normalized(a.total(q, ["role"], "question", "weight"), ["role"], "weight")
    return rounded(share.filter("weight > 0.005"))


def wh_roles(spark: SparkSession, d: str) -> DataFrame:
    """Question words against roles: NPMI over arguments with an exact span."""
    q = exact_span_questions(spark, d).withColumn("item", x.wh_word(c("question"))).groupBy("sentence_id", "verb_index", "b", "e", "item").agg(F.sum("weight").alias("value"))
    role = roles(spark, d).filter(~c("role").isin(*x.NO_WH_ROLES)).select("sentence_id", "verb_index", "b", "e", c("role").alias("item")).distinct().withColumn("value", F.lit(1.0))
    return rounded(association.heterogeneous(q, role, ["sentence_id", "verb_index", "b", "e"]))


def question_slots(spark: SparkSession, d: str) -> DataFrame:
    """(question, stem): each question of the predictions without its preposition and second object, told by its slots;
    of several readings the shortest stem."""
    t = table(spark, d, "verb_prediction", ["beam.questions.question_string", "beam.questions.question_slots"])
    q = t.select(F.explode("beam.questions").alias("qs")).select(F.explode("qs").alias("q")).distinct()
    slots = q.select(norm_question("q.question_string").alias("question"), *(F.lower(F.trim(F.coalesce(f"q.question_slots.{k}", F.lit("")))).alias(k) for k in ("prep", "obj2")))
    end = F.trim(F.concat_ws(" ", F.nullif("prep", F.lit("")), F.nullif("obj2", F.lit(""))))
    stem = F.when((end != "") & F.endswith("question", F.concat(F.lit(" "), end)), F.expr("substr(question, 1, length(question) - length(_end) - 1)")).otherwise(c("question"))
    return slots.filter("question <> ''").withColumn("_end", end).select("question", stem.alias("stem")).groupBy("question").agg(F.min_by("stem", F.struct(F.length("stem"), "stem")).alias("stem"))


def question_relatedness(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of `what` questions of weight above 5, one of them above 15, of the same argument: joint weight, NPMI, and
    whether they only differ in preposition and second object."""
    q = arg_questions(spark, d)
    often = cut(a.total(q, [], "question", "weight").filter((c("weight") > 5.0) & c("question").startswith("what ")).join(question_slots(spark, d), "question", "left"))
    kept = q.join(often.select("question"), "question").select(F.lit("all").alias("source"), c("arg_id").alias("instance"), c("question").alias("item"), c("weight").alias("value"))
    pairs = association.with_sources(cut(kept), ["source"]).filter("x <> y")
    side = lambda n: often.select(c("question").alias(n), c("weight").alias(f"w{n}"), F.coalesce("stem", "question").alias(f"stem_{n}"))
    both = pairs.join(side("x"), "x").join(side("y"), "y").filter(F.greatest("wx", "wy") > 15.0)
    return rounded(both.select("x", "y", "joint", "npmi", "covariance", "correlation", (c("stem_x") == c("stem_y")).alias("boring")))


def verb_list(spark: SparkSession, d: str) -> DataFrame:
    """Lemmas by falling number of verbs, then by name, with their share of all verbs."""
    n = roles(spark, d).groupBy("lemma").agg(F.countDistinct("sentence_id", "verb_index").alias("n"))
    w = Window.orderBy(c("n").desc(), "lemma")  # one row per lemma
    return rounded(n.select("lemma", "n", F.row_number().over(w).cast("bigint").alias("place"), (c("n") / F.sum("n").over(Window.partitionBy())).alias("share")))


def sentence_navigation(spark: SparkSession, d: str) -> DataFrame:
    """Next and previous sentence of each lemma's sentences, in the order of their ids, wrapping around."""
    s = roles(spark, d).select("lemma", "sentence_id").distinct()
    return r.wrapped_neighbours(s, ["lemma"], [*x.sentence_order(c("sentence_id")), c("sentence_id")], "sentence_id")


def feature_lookup(spark: SparkSession, d: str, lemma: str = "give") -> DataFrame:
    """All features of one verb's arguments at once: role and number of questions, by point lookup on the lemma."""
    arg = arg_questions(spark, d).filter(c("verb_lemma") == lemma)
    return rounded(arg.groupBy("arg_id").agg(F.count(F.lit(1)).alias("n_questions"), F.max("weight").alias("top_weight")))


def mlm_inputs(spark: SparkSession, d: str) -> DataFrame:
    """Per sentence and lemma: verb indices and argument spans, as sorted text."""
    g = roles(spark, d).groupBy("sentence_id", "lemma").agg(F.sort_array(F.collect_set("verb_index")).alias("v"), F.sort_array(F.collect_set(F.struct("b", "e"))).alias("s"))
    text = F.array_join(F.transform("s", lambda y: F.concat_ws("-", y["b"].cast("string"), y["e"].cast("string"))), " ")
    return g.select("sentence_id", "lemma", F.array_join(F.transform("v", lambda y: y.cast("string")), " ").alias("verb_indices"), text.alias("arg_spans"))


def qg_inputs(spark: SparkSession, d: str) -> DataFrame:
    """Per sentence and verb: its set of argument spans, as sorted text."""
    g = roles(spark, d).filter(~x.is_irrelevant_role(c("role"))).groupBy("sentence_id", "verb_index").agg(F.sort_array(F.collect_set(F.struct("b", "e"))).alias("s"))
    return g.select("sentence_id", "verb_index", F.array_join(F.transform("s", lambda y: F.concat_ws("-", y["b"].cast("string"), y["e"].cast("string"))), " ").alias("arg_spans"))


_NAMES = (roles_relevant, roles_plain, role_groups, role_order, verb_types, verbal_forms, questions_valid, documents_by_round, exact_span_questions, questions_or_default, span_containment, verbs_predicted, verbs_unpredicted, span_union, sentence_verbs, relabelled, token_offsets, token_gap_ranks, leading_prepositions, span_texts, side_clusters, side_gold, rule_lexica, sense_counts, role_questions, wh_roles, question_slots, question_relatedness, verb_list, sentence_navigation, feature_lookup, mlm_inputs, qg_inputs)
QUERIES = {f.__name__: f for f in _NAMES}

_LABEL = NORM_ID.replace("lower", "upper")
ROLES = f"""roles AS (SELECT DISTINCT {NORM_ID.format(c='sentence_id')} AS sentence_id, verb_index, {NORM_ID.format(c='frameset_id')} AS frameset, {_LABEL.format(c='role_label')} AS role, arg_span[1] AS b, arg_span[2] AS e,
    split_part({NORM_ID.format(c='frameset_id')}, '.', 1) AS lemma FROM prop_bank_role
    WHERE len(arg_span) = 2 AND arg_span[1] < arg_span[2] AND sentence_id IS NOT NULL AND verb_index IS NOT NULL AND role_label IS NOT NULL AND frameset_id IS NOT NULL)"""
SPANS = f"""pages AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sid, verb_index, beam_page ORDER BY produced_at DESC NULLS LAST) AS n
        FROM (SELECT {NORM_ID.format(c='sentence_id')} AS sid, verb_index, beam_page, produced_at, beam FROM verb_prediction) WHERE sid IS NOT NULL AND verb_index IS NOT NULL) WHERE n = 1),
    spans AS (SELECT sid AS sentence_id, verb_index, u.span[1] AS b, u.span[2] AS e, CASE WHEN u.span_prob >= 0 AND u.span_prob <= 1 THEN u.span_prob END AS p, u.questions
        FROM (SELECT sid, verb_index, unnest(beam) AS u FROM pages) WHERE len(u.span) = 2 AND u.span[1] < u.span[2])"""
SENTENCES = f"""sentences AS (SELECT sentence_id, sentence_tokens FROM (SELECT *, row_number() OVER (PARTITION BY sentence_id ORDER BY ingested_at NULLS FIRST, {NORM_ID.format(c='data_split')} NULLS FIRST) AS n FROM sentence WHERE sentence_id IS NOT NULL) WHERE n = 1)"""
TOKENS = f"{SENTENCES}, tokens AS (SELECT sentence_id, generate_subscripts(sentence_tokens, 1) - 1 AS idx, coalesce(unnest(sentence_tokens), '') AS token FROM sentences)"
_IN = lambda ws: "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in ws) + ")"
# Literals of their own, so that the word lists of the library are checked.
_AUX = _IN("do does doing did done be being been am 'm is 's ai are 're was were will 'll wo have having 've has had 'd can ca could may might must shall should ought would".split())
_MODAL = _IN("can ca could may might must shall should ought would 'd will 'll wo won't can't have going used gonna gon 've able".split())
_NEG = _IN(["no", "not", "n't", "never", "no longer"])
_DIS = _IN(
    "also|however|too|as well|but|and|as we've seen before|instead|on the other hand|for instance|or|though|hence|furthermore|moreover|thus|so|nonetheless|regardless|rather|ironically|indeed|certainly|frankly|similarly|thereby|therefore|specifically|particularly|in particular|in turn|and so|as a result|after all|in addition|in contrast|in other words|for example|for one thing|for one|in this case|in that case|in any case|in any event|in fact|of course|oh my god|ah|damn|uh|um|gosh|oh my gosh|oh gosh".split("|")
)
_NO_WH = _IN("ARG4 ARG5 ARGA ARGM-NEG ARGM-MOD ARGM-DIS ARGM-PRD ARGM-EXT".split())
_ROLES_IN_ORDER = "ARG0 ARG1 ARG2 ARG3 ARG4 ARGM-LOC ARGM-MNR ARGM-ADV ARGM-PNC ARGM-CAU ARGM-TMP ARGM-DIS ARGM-DIR ARGM-EXT ARGM-MOD ARGM-NEG ARGM-PRD ARG5 ARGA".split()
_TEXT = "lower(array_to_string(list_transform(sentence_tokens[b + 1 : e], lambda w: w), ' '))"
_IRRELEVANT = "(role IN ('V', 'REL') OR regexp_matches(role, 'DIS|NEG|MOD|C-|R-'))"
_EXACT = f"""{SPANS}, first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sentence_id, verb_index, b, e ORDER BY p DESC, k) AS n FROM (
        SELECT *, (SELECT string_agg(y::VARCHAR) FROM (SELECT unnest(questions) AS y)) AS k FROM spans WHERE p IS NOT NULL AND questions IS NOT NULL)) WHERE n = 1),
    q AS (SELECT sentence_id, verb_index, b, e, p, unnest(questions) AS u FROM first),
    exact AS (SELECT sentence_id, verb_index, b, e, {NORM_Q.format(c='u.question_string')} AS question, round(sum(p * u.question_prob), 9) AS weight FROM q WHERE u.question_prob > 0 AND u.question_prob <= 1
        AND (sentence_id, verb_index, b, e) IN (SELECT (sentence_id, verb_index, b, e) FROM roles) GROUP BY ALL)"""
_DEFAULT = f"{ROLES}, {_EXACT}, filled AS (SELECT sentence_id, verb_index, b, e, coalesce(question, lower(role)) AS question, coalesce(weight, 1) AS weight FROM (SELECT sentence_id, verb_index, b, e, min(role) AS role FROM roles GROUP BY ALL) LEFT JOIN exact USING (sentence_id, verb_index, b, e))"
_NPMI = "CASE WHEN joint <= 0 THEN -1 WHEN joint >= 1 THEN 0 ELSE ln(joint / independent) / -ln(joint) END"
_ORDER = "regexp_replace(sentence_id, ':[^:]*$', ''), coalesce(try_cast(nullif(regexp_extract(sentence_id, ':([0-9]+)$', 1), '') AS INTEGER), -1), sentence_id"

SQL = {
    "roles_relevant": f"WITH {ROLES} SELECT sentence_id, verb_index, role, b, e FROM roles WHERE NOT {_IRRELEVANT} AND lemma NOT IN {_AUX} AND NOT (b <= verb_index AND verb_index < e)",
    "roles_plain": f"WITH {ROLES} SELECT role, count(*) AS n FROM roles WHERE NOT regexp_matches(role, '^[RC]-') GROUP BY role",
    "role_groups": f"WITH {ROLES} SELECT CASE WHEN regexp_matches(role, '^ARG[0-5]$') THEN 'Arg' WHEN role IN ('ARGM-MOD', 'ARGM-NEG', 'ARGM-DIS') THEN 'Lex' WHEN role IN ('ARGM-TMP', 'ARGM-ADV', 'ARGM-MNR', 'ARGM-LOC', 'ARGM-PNC', 'ARGM-CAU', 'ARGM-DIR') THEN 'Mod' ELSE 'Other' END AS role_group, count(*) AS n, count(DISTINCT role) AS n_roles FROM roles GROUP BY 1",
    "role_order": f"WITH {ROLES}, o AS (SELECT * FROM (VALUES {', '.join(f'''('{r0}', {i})''' for i, r0 in enumerate(_ROLES_IN_ORDER))}) AS t(role, i)) SELECT role, row_number() OVER (ORDER BY coalesce(i, 100), role) AS place FROM (SELECT DISTINCT role FROM roles) LEFT JOIN o USING (role)",
    "verb_types": f"WITH {ROLES} SELECT frameset AS verb_type, lemma, count(DISTINCT (sentence_id, verb_index)) AS n_verbs FROM roles GROUP BY ALL",
    "verbal_forms": "SELECT lower(stem) AS lemma, pos, lower(form) AS form FROM (SELECT stem, 'VBZ' AS pos, present_singular3rd AS form FROM verb_inflection UNION SELECT stem, 'VBG', present_participle FROM verb_inflection UNION SELECT stem, 'VBD', past_form FROM verb_inflection UNION SELECT stem, 'VBN', past_participle FROM verb_inflection) WHERE form IS NOT NULL AND stem IS NOT NULL GROUP BY ALL",
    "questions_valid": f"WITH {SPANS} SELECT sentence_id, count(*) AS n_entries FROM spans WHERE len(questions) >= 2 AND len(list_filter(questions, lambda q: coalesce(q.question_prob IS NULL OR isnan(q.question_prob) OR q.question_prob <= 0, true))) <= 1 GROUP BY ALL",
    "documents_by_round": "SELECT source, count(*) AS n FROM documents WHERE source LIKE 'annotation-%' OR source LIKE '%-archive' GROUP BY source",
    "span_containment": f"WITH {ROLES}, {SPANS} SELECT a.sentence_id, a.verb_index, token, role, count(*) AS n_spans FROM (SELECT DISTINCT sentence_id, verb_index, b AS token, role FROM roles) a JOIN (SELECT DISTINCT sentence_id, verb_index, b, e FROM spans) s ON a.sentence_id = s.sentence_id AND a.verb_index = s.verb_index AND b <= token AND token < e GROUP BY ALL",
    "verbs_predicted": f"WITH {ROLES}, {SPANS} SELECT DISTINCT sentence_id, verb_index FROM roles SEMI JOIN spans USING (sentence_id, verb_index)",
    "verbs_unpredicted": f"WITH {ROLES}, {SPANS} SELECT DISTINCT sentence_id, verb_index FROM roles ANTI JOIN spans USING (sentence_id, verb_index)",
    "span_union": f"WITH {ROLES}, {SPANS} SELECT sentence_id, count(*) AS n_spans FROM (SELECT sentence_id, verb_index, b, e FROM roles UNION SELECT sentence_id, verb_index, b, e FROM spans) GROUP BY ALL",
    "sentence_verbs": f"WITH {ROLES}, {SENTENCES}, v AS (SELECT sentence_id, verb_index, count(*) AS n FROM roles GROUP BY ALL) SELECT sentence_id, any_value(len(sentence_tokens)) AS n_tokens, string_agg(verb_index || ':' || n, ' ' ORDER BY verb_index) AS verbs FROM sentences JOIN v USING (sentence_id) GROUP BY sentence_id",
    "relabelled": "WITH l AS (SELECT doc_id, source, lower(split_part(lang, '-', 1)) AS lang FROM documents), m AS (SELECT source, lang AS major FROM (SELECT source, lang, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, lang) AS k FROM l WHERE lang IS NOT NULL AND source IS NOT NULL GROUP BY source, lang) WHERE k = 1) SELECT doc_id, coalesce(lang, major) AS lang FROM l LEFT JOIN m USING (source)",
    "token_offsets": f"WITH {TOKENS}, o AS (SELECT sentence_id, coalesce(sum(length(token) + 1) OVER (PARTITION BY sentence_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS o FROM tokens) SELECT sentence_id, max(o) AS last_offset, sum(o)::BIGINT AS sum_offsets FROM o GROUP BY ALL",
    "token_gap_ranks": f"WITH {TOKENS}, o AS (SELECT sentence_id, token, idx - coalesce(sum((NOT regexp_matches(token, '[A-Za-z0-9]'))::INT) OVER (PARTITION BY sentence_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM tokens) SELECT sentence_id, count(*) AS n_words, max(k)::BIGINT AS last_rank FROM o WHERE regexp_matches(token, '[A-Za-z0-9]') GROUP BY ALL",
    "leading_prepositions": f"WITH {ROLES}, {SENTENCES}, t AS (SELECT role, CASE WHEN e - b > 1 AND lower(sentence_tokens[b + 1]) IN {_IN(x.PREPOSITIONS)} THEN lower(sentence_tokens[b + 1]) ELSE '<none>' END AS prep FROM roles JOIN sentences USING (sentence_id) WHERE e <= len(sentence_tokens)) SELECT role, prep, count(*) AS n FROM t GROUP BY ALL",
    "span_texts": f"WITH {ROLES}, {SENTENCES}, t AS (SELECT role, lower(array_to_string(sentence_tokens[b + 1 : e], ' ')) AS text FROM roles JOIN sentences USING (sentence_id) WHERE e <= len(sentence_tokens)), n AS (SELECT role, text, count(*) AS n FROM t GROUP BY ALL) SELECT role, text, n FROM (SELECT *, row_number() OVER (PARTITION BY role ORDER BY n DESC, text) AS k FROM n) WHERE k = 1",
    "side_clusters": f"WITH {ROLES}, {SENTENCES}, w AS (SELECT role, {_TEXT} AS w FROM roles LEFT JOIN sentences USING (sentence_id)) SELECT CASE WHEN w IN {_MODAL} THEN 'MODAL' WHEN w IN {_NEG} THEN 'NEG' WHEN w IN {_DIS} THEN 'DIS' WHEN role IN ('ARGM-TMP', 'ARGM-MNR', 'ARGM-LOC', 'ARGM-DIR') THEN role[6:] ELSE 'remaining' END AS side, count(*) AS n FROM w GROUP BY 1",
    "side_gold": f"WITH {ROLES}, {SENTENCES}, w AS (SELECT lemma, frameset, role, {_TEXT} AS w FROM roles LEFT JOIN sentences USING (sentence_id)) SELECT lemma, CASE WHEN w IN {_MODAL} THEN 'MODAL' WHEN w IN {_NEG} THEN 'NEG' WHEN w IN {_DIS} THEN 'DIS' ELSE frameset || '.' || role END AS side, count(*) AS n FROM w GROUP BY ALL",
    "rule_lexica": f"WITH {ROLES}, {SENTENCES}, n AS (SELECT {_TEXT} AS text, count(*) AS n FROM roles JOIN sentences USING (sentence_id) GROUP BY 1), l AS ({' UNION ALL '.join(f"SELECT '{k}' AS lexicon, unnest([{v[1:-1]}]) AS text" for k, v in (('negation', _NEG), ('modals', _MODAL), ('discourse', _DIS)))}) SELECT lexicon, text, coalesce(n, 0) AS n FROM l LEFT JOIN n USING (text)",
    "sense_counts": f"WITH {ROLES} SELECT lemma, count(DISTINCT frameset) AS n_senses, count(DISTINCT (sentence_id, verb_index)) AS n_verbs FROM roles GROUP BY lemma",
    "exact_span_questions": f"WITH {ROLES}, {_EXACT} SELECT * FROM exact",
    "questions_or_default": f"WITH {_DEFAULT} SELECT * FROM filled",
    "role_questions": f"WITH {_DEFAULT}, t AS (SELECT role, question, sum(weight) AS w FROM filled JOIN (SELECT DISTINCT sentence_id, verb_index, b, e, role FROM roles) USING (sentence_id, verb_index, b, e) GROUP BY ALL), sh AS (SELECT role, question, w / sum(w) OVER (PARTITION BY role) AS w FROM t) SELECT role, question, round(w, 6) AS weight FROM sh WHERE w > 0.005::DOUBLE",
    "wh_roles": f"""WITH {ROLES}, {_EXACT}, l AS (SELECT sentence_id, verb_index, b, e, regexp_extract(question, '^(how much|how long|[a-z]+)', 1) AS x, sum(weight) AS v FROM exact GROUP BY ALL),
    ln1 AS (SELECT *, v / sum(v) OVER (PARTITION BY sentence_id, verb_index, b, e) AS vx FROM l),
    g AS (SELECT DISTINCT sentence_id, verb_index, b, e, role AS y FROM roles WHERE role NOT IN {_NO_WH}), gn AS (SELECT *, 1::DOUBLE / count(*) OVER (PARTITION BY sentence_id, verb_index, b, e) AS vy FROM g),
    cell AS (SELECT x, y, sum(vx * vy) AS v FROM ln1 JOIN gn USING (sentence_id, verb_index, b, e) GROUP BY ALL), t AS (SELECT sum(v) AS t FROM cell),
    scored AS (SELECT x, y, v / t AS joint, sum(v) OVER (PARTITION BY x) * sum(v) OVER (PARTITION BY y) / (t * t) AS independent FROM cell, t)
    SELECT x, y, round(joint, 6) AS joint, round(independent, 6) AS independent, round({_NPMI}, 6) + 0.0::DOUBLE AS npmi FROM scored""",
    "question_slots": f"""WITH sl AS (SELECT DISTINCT {NORM_Q.format(c='u.question_string')} AS question, trim(lower(trim(coalesce(u.question_slots.prep, ''))) || ' ' || lower(trim(coalesce(u.question_slots.obj2, '')))) AS tail FROM (SELECT unnest(b.questions) AS u FROM (SELECT unnest(beam) AS b FROM verb_prediction))),
    st AS (SELECT question, CASE WHEN tail <> '' AND ends_with(question, ' ' || tail) THEN question[: length(question) - length(tail) - 1] ELSE question END AS stem FROM sl WHERE question <> ''),
    stems AS (SELECT question, first(stem ORDER BY length(stem), stem) AS stem FROM st GROUP BY question) SELECT * FROM stems""",
    "question_relatedness": f"""WITH {ARG_Q}, sl AS (SELECT DISTINCT {NORM_Q.format(c='u.question_string')} AS question, trim(lower(trim(coalesce(u.question_slots.prep, ''))) || ' ' || lower(trim(coalesce(u.question_slots.obj2, '')))) AS tail FROM (SELECT unnest(b.questions) AS u FROM (SELECT unnest(beam) AS b FROM verb_prediction))),
    st AS (SELECT question, CASE WHEN tail <> '' AND ends_with(question, ' ' || tail) THEN question[: length(question) - length(tail) - 1] ELSE question END AS stem FROM sl WHERE question <> ''),
    stems AS (SELECT question, first(stem ORDER BY length(stem), stem) AS stem FROM st GROUP BY question),
    f AS (SELECT question, sum(weight) AS fw FROM arg_q WHERE question LIKE 'what %' GROUP BY question HAVING sum(weight) > 5), k AS (SELECT arg_id, question AS item, weight AS value FROM arg_q JOIN f USING (question)),
    d AS (SELECT *, sum(value) OVER (PARTITION BY arg_id) AS t FROM k), w AS (SELECT sum(value) AS w FROM k), p AS (SELECT item, sum(value) / any_value(w) AS p FROM k, w GROUP BY item),
    j AS (SELECT a.item AS x, b.item AS y, sum(a.value * b.value / a.t) / any_value(w) AS joint FROM d a JOIN k b USING (arg_id), w WHERE a.item <= b.item GROUP BY ALL),
    sd AS (SELECT p.item, p, sqrt(greatest(joint - p * p, 0)) AS sd, fw, coalesce(stem, p.item) AS stem FROM p JOIN j ON x = item AND y = item JOIN f ON f.question = item LEFT JOIN stems ON stems.question = item),
    scored AS (SELECT a.item AS x, b.item AS y, coalesce(joint, 0) AS joint, a.p * b.p AS independent, a.sd * b.sd AS spread, a.stem = b.stem AS boring FROM sd a JOIN sd b ON a.item < b.item AND greatest(a.fw, b.fw) > 15 LEFT JOIN j ON j.x = a.item AND j.y = b.item)
    SELECT x, y, round(joint, 6) AS joint, round({_NPMI}, 6) + 0.0::DOUBLE AS npmi, round(joint - independent, 6) + 0.0::DOUBLE AS covariance, round((joint - independent) / nullif(spread, 0), 6) + 0.0::DOUBLE AS correlation, boring FROM scored""",
    "verb_list": f"WITH {ROLES}, n AS (SELECT lemma, count(DISTINCT (sentence_id, verb_index)) AS n FROM roles GROUP BY lemma) SELECT lemma, n, row_number() OVER (ORDER BY n DESC, lemma) AS place, round(n / sum(n) OVER (), 6) AS share FROM n",
    "sentence_navigation": f"WITH {ROLES}, s AS (SELECT DISTINCT lemma, sentence_id FROM roles) SELECT lemma, sentence_id, coalesce(lead(sentence_id) OVER w, first_value(sentence_id) OVER v) AS next, coalesce(lag(sentence_id) OVER w, last_value(sentence_id) OVER v) AS previous FROM s WINDOW w AS (PARTITION BY lemma ORDER BY {_ORDER}), v AS (PARTITION BY lemma ORDER BY {_ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)",
    "feature_lookup": f"WITH {ARG_Q} SELECT arg_id, count(*) AS n_questions, round(max(weight), 6) AS top_weight FROM arg_q WHERE verb_lemma = 'give' GROUP BY arg_id",
    "mlm_inputs": f"WITH {ROLES}, v AS (SELECT sentence_id, lemma, string_agg(verb_index::VARCHAR, ' ' ORDER BY verb_index) AS verb_indices FROM (SELECT DISTINCT sentence_id, lemma, verb_index FROM roles) GROUP BY ALL), s AS (SELECT sentence_id, lemma, string_agg(b || '-' || e, ' ' ORDER BY b, e) AS arg_spans FROM (SELECT DISTINCT sentence_id, lemma, b, e FROM roles) GROUP BY ALL) SELECT * FROM v JOIN s USING (sentence_id, lemma)",
    "qg_inputs": f"WITH {ROLES} SELECT sentence_id, verb_index, string_agg(b || '-' || e, ' ' ORDER BY b, e) AS arg_spans FROM (SELECT DISTINCT sentence_id, verb_index, b, e FROM roles WHERE NOT {_IRRELEVANT}) GROUP BY ALL",
}
