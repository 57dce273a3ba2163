"""Re-merging, frames, aligned texts, term registry, settings, lexicon."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from verbloom.functions import clean, lexicon
from verbloom.operators import agglom, models, relate, tree
from verbloom.sources import readers

c = F.col


def test_re_merged_losses_come_from_the_kept_members():
    rows = np.array([[4.0, 0.0], [3.0, 1.0], [0.0, 4.0]])
    terms = [agglom.min_entropy(rows)]
    t = agglom.agglomerate(terms)
    out = tree.re_merged(t, {0, 2}, terms)
    assert out.n == 2 and out.merges[0][2] == pytest.approx(8 * np.log(8) - 8 * np.log(4))


def test_cuts_from_both_sides(spark):
    t = agglom.Tree(4, [0.0] * 4, [(0, 1, 1.0), (2, 3, 1.0), (4, 5, 9.0)])
    nodes = spark.createDataFrame(tree.frame("v", t, [1.0] * 4), tree.NODE_SCHEMA)
    s = {r.step: r.n_clusters for r in tree.steps(nodes, 100).collect()}
    assert s == {0: 1, 1: 2, 2: 4}  # the two lower merges tie and split together
    assert tree.number_cut(nodes, 3).first().step == 2 and tree.at_most_cut(nodes, 3).first().step == 1 and tree.number_cut(nodes, 9).first().step == 2
    leaves = spark.createDataFrame([("v", i, i * 10) for i in range(4)], "verb_type string, leaf int, instance bigint")
    assert {r.node: r.value for r in tree.leaf_fold(nodes, leaves, F.sum("instance")).collect()}[6] == 60


def test_aligned_texts(spark):
    a = spark.createDataFrame([(1, "A b c")], "i int, text string")
    b = spark.createDataFrame([(9, "a bc"), (8, "ab C")], "j int, text string")
    assert tuple(relate.aligned(a, b, "i", "j").first()) == (1, 8)
    with pytest.raises(Exception, match="no text"):
        relate.aligned(a, b.limit(0), "i", "j").collect()


def test_term_registry_and_presets(spark):
    q = spark.createDataFrame([("v", 1, "how did it go", 1.0), ("v", 1, "who went", 2.0)], "verb_type string, instance bigint, item string, value double")
    adj = spark.createDataFrame([("v", 1, True)], "verb_type string, instance bigint, is_adjunct boolean")
    f = {"questions": q, "adjuncts": adj, "span_mlm_masked": q}
    assert {r.item: r.value for r in models.term_distribution("qent_nohow", f).collect()} == {"how did it go": 0.01, "who went": 2.0}
    assert {r.item for r in models.term_distribution("qent_argadj", f).collect()} == {"adj:how did it go", "adj:who went"}
    assert models.term_distribution("span_mlm_masked", f).count() == 2
    with pytest.raises(ValueError):
        models.term_distribution("dv", f)
    assert all(models.parse(p).index == "arg" for p in models.PRESETS.values())
    nodes, leaves, side = models.argument_model(models.parse("arg/qent+span_mlm_masked"), f, spark.createDataFrame([("v", 2, "x")], "verb_type string, instance bigint, cluster string"))
    assert nodes.count() == 1 and leaves.count() == 1 and side.count() == 1


def test_frames(spark):
    v = spark.createDataFrame([("t", 1, 0), ("t", 2, 1)], "verb_type string, instance bigint, cluster bigint")
    a = spark.createDataFrame([("t", 10, 5), ("t", 20, 5)], "verb_type string, instance bigint, cluster bigint")
    of = spark.createDataFrame([(10, 1), (20, 2)], "instance bigint, verb bigint")
    assert {(r.frame, r.role, r.instance) for r in models.frames(v, a, of).collect()} == {(0, 5, 10), (1, 5, 20)}


def test_settings(tmp_path):
    p = tmp_path / "m" / "dev" / "b3"
    p.mkdir(parents=True)
    (p / "best-setting.txt").write_text("entropy=0.5\n")
    assert readers.tuned_settings(str(tmp_path), "b3") == [("m", "entropy", 0.5)] and readers.tuned_settings(str(tmp_path), "b3", test=False) == [("m", "entropy", None)]


def test_canonical_forms(spark):
    df = spark.createDataFrame([("\t A:1 ", "Who  did\tit ? ?"), (None, None)], "i string, q string")
    assert [tuple(r) for r in df.select(clean.norm_id("i"), clean.norm_question("q"), clean.norm_label("i")).collect()] == [("a:1", "who did it", "A:1"), (None, None, None)]
    w = spark.createDataFrame([(1.0,), (0.0,), (-1.0,), (float("nan"),), (float("inf"),), (None,)], "w double")
    assert [r[0] for r in w.select(clean.usable(c("w"))).collect()] == [True] + [False] * 5


def test_newest_rows(spark):
    rows = [(1, 5, "a"), (1, 7, None), (1, 7, "b"), (2, None, "c"), (2, 1, "d"), (3, None, "e")]
    got = clean.latest(spark.createDataFrame(rows, "k int, produced_at int, v string"), ["k"], ties=("v",))
    assert {r.k: r.v for r in got.collect()} == {1: "b", 2: "d", 3: "e"}


def test_lexicon(spark):
    r = spark.createDataFrame([("ARG1", "give", 0, 2, 5), ("ARGM-NEG", "give", 0, 1, 5), ("ARG0", "be", 0, 1, 5), ("ARG0", "give", 4, 6, 5)], "role string, lemma string, b int, e int, v int")
    assert [x[0] for x in r.select(lexicon.is_relevant(c("role"), c("lemma"), c("b"), c("e"), c("v"))).collect()] == [True, False, False, False]
    ids = spark.createDataFrame([("a:10",), ("a:9",), ("b",), ("a",)], "i string")
    assert [x.i for x in ids.orderBy(*lexicon.sentence_order(c("i"))).collect()] == ["a", "a:9", "a:10", "b"]
    assert spark.createDataFrame([("NP-SBJ-1",)], "l string").select(lexicon.without_function_tag(c("l"))).first()[0] == "NP"


def test_question_frames_of_all_lemmas(spark, data):
    from verbloom.plans import distributions, more

    q = distributions.arg_questions(spark, data).filter("verb_lemma IS NOT NULL").groupBy("verb_lemma").agg(F.countDistinct("arg_id").alias("n"))
    want = {r.verb_lemma: r.n for r in q.collect()}
    assert len(want) > 5 and {r.verb_type: r.n_args for r in more.question_frames(spark, data).collect()} == want
