"""Hand-checked numbers of the scores (two clusters over labels A and B)."""

import pytest

from verbloom.operators import association, metrics

ROWS = [("v", "c1", "A", 3.0), ("v", "c1", "B", 1.0), ("v", "c2", "A", 1.0), ("v", "c2", "B", 2.0)]


@pytest.fixture(scope="module")
def counts(spark):
    return spark.createDataFrame(ROWS, "verb_type string, cluster string, label string, n double")


def test_purity_and_collocation(counts):
    r = metrics.purity_collocation(counts, ["verb_type"]).first()
    assert r.purity == pytest.approx(5 / 7) and r.collocation == pytest.approx(5 / 7) and r.f1 == pytest.approx(5 / 7)


def test_b3(counts):
    r = metrics.micro(metrics.b3_cells(counts), ["verb_type"]).first()
    assert r.precision == pytest.approx(0.595238, abs=1e-6) and r.recall == pytest.approx(0.595238, abs=1e-6)
    by = {x.label: x for x in metrics.b3_by_label(counts).collect()}
    assert by["A"].precision == pytest.approx(0.645833, abs=1e-6) and by["A"].recall == pytest.approx(0.625)
    assert by["B"].precision == pytest.approx(0.527778, abs=1e-6) and by["B"].recall == pytest.approx(0.555556, abs=1e-6)


def test_main_label_tie_goes_to_the_smaller_name(spark):
    tie = spark.createDataFrame([("v", "c", "B", 2.0), ("v", "c", "A", 2.0)], "verb_type string, cluster string, label string, n double")
    assert [r.label for r in metrics.with_main_label(tie).filter("main").collect()] == ["A"]


def test_npmi_symmetric(counts):
    by = {(r.x, r.y): r for r in association.symmetric(counts).collect()}
    assert by["A", "A"].joint == pytest.approx(0.369048, abs=1e-6) and by["A", "A"].npmi == pytest.approx(0.122791, abs=1e-6)
    assert by["A", "B"].npmi == pytest.approx(-0.119360, abs=1e-5)
    assert by["B", "B"].joint == pytest.approx(0.226190, abs=1e-6) and by["B", "B"].npmi == pytest.approx(0.140084, abs=1e-5)


def test_npmi_within_verb(spark):
    two = spark.createDataFrame([*ROWS, ("w", "c3", "A", 2.0)], "verb_type string, cluster string, label string, n double")
    by = {(r.x, r.y): r for r in association.symmetric(two, within_verb=True).collect()}
    assert by["A", "A"].joint == pytest.approx(0.509259, abs=1e-6) and by["A", "A"].npmi == pytest.approx(0.099495, abs=1e-5)
    assert by["A", "B"].independent == pytest.approx(0.190476, abs=1e-6) and by["A", "B"].npmi == pytest.approx(-0.103136, abs=1e-5)


def test_empty_counts(spark):
    none = spark.createDataFrame([], "verb_type string, cluster string, label string, n double")
    assert metrics.purity_collocation(none, ["verb_type"]).count() == 0
    assert metrics.micro(metrics.b3_cells(none), ["verb_type"]).count() == 0


def test_label_never_together_has_minus_one(spark):
    apart = spark.createDataFrame([("v", "c1", "A", 1.0), ("v", "c2", "B", 1.0)], "verb_type string, cluster string, label string, n double")
    by = {(r.x, r.y): r.npmi for r in association.symmetric(apart).collect()}
    assert by["A", "B"] == -1.0


def test_smoothing_and_groups(spark):
    from pyspark.sql import functions as F

    from verbloom.functions import lexicon
    from verbloom.functions.dist import shrunk

    assert spark.range(1).select(shrunk(F.lit(0.5), F.lit(2.0), F.lit(0.8), 10)).first()[0] == pytest.approx(0.75)
    roles = spark.createDataFrame([("ARG1",), ("ARGM-NEG",), ("ARGM-TMP",), ("V",), ("ARGA",), ("ARGM-EXT",), ("ARGM-PNC",)], "r string")
    assert [x[0] for x in roles.select(lexicon.role_group(F.col("r"))).collect()] == ["Arg", "Lex", "Mod", "Other", "Other", "Other", "Mod"]
