"""Distribution algebra on hand-checked rows."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from verbloom.functions import dist


@pytest.fixture(scope="module")
def d(spark):
    return spark.createDataFrame([("x", "a", 5.0), ("x", "b", 3.0), ("x", "c", 2.0)], "k string, item string, value double")


def values(df, key="item"):
    return {r[key]: round(r.value, 6) for r in df.collect()}


def test_truncation(spark, d):
    assert values(dist.truncated(d, ["k"], 0.7)) == {"a": 5.0, "b": 3.0}
    assert values(dist.truncated(d, ["k"], 2.0)) == {"a": 5.0, "b": 3.0, "c": 2.0}
    dense = spark.createDataFrame([("x", i, v) for i, v in enumerate((5.0, 3.0, 2.0))], "k string, idx int, value double")
    assert values(dist.truncated_dense(dense, ["k"], 0.7), "idx") == {0: 5.0, 1: 3.0, 2: 0.0}
    ties = spark.createDataFrame([("x", i, 1.0) for i in range(4)], "k string, idx int, value double")
    assert values(dist.truncated_dense(ties, ["k"], 0.5), "idx") == dict.fromkeys(range(4), 0.0)


def test_dirichlet(spark):
    got = spark.range(1).select(dist.dirichlet(F.lit(3.0), F.lit(3.0), F.lit(2.0), 1.0), dist.dirichlet(F.lit(0.0), F.lit(3.0), F.lit(2.0), 1.0)).first()
    assert tuple(got) == (0.875, 0.125)
    v = spark.createDataFrame([("t", "a"), ("t", "b")], "t string, item string")
    one = spark.createDataFrame([("t", 1, "a", 3.0)], "t string, i int, item string, value double")
    assert values(dist.dirichlet_sparse(one, v, ["t", "i"], ["t"], 1.0)) == {"a": 0.875, "b": 0.125}


def test_transform_needs_a_larger_prior_head(d):
    with pytest.raises(ValueError):
        dist.distinctive_transform(d, ["k"], 0.9, 0.5, 0.1)
    assert sum(values(dist.distinctive_transform(d, ["k"], 0.5, 0.9, 0.1)).values()) == pytest.approx(1.0)


def test_normalise_zero_sum_is_null(spark):
    z = spark.createDataFrame([("x", "a", 0.0)], "k string, item string, value double")
    assert dist.normalized(z, ["k"]).first().value is None
    assert dist.normalized(z.limit(0), []).count() == 0


def test_log_sum_exp_is_stable(spark):
    x = spark.createDataFrame([(1000.0,), (1000.0,)], "x double")
    assert x.select(dist.log_sum_exp(F.col("x"), Window.partitionBy())).first()[0] == pytest.approx(1000.693147, abs=1e-6)


def test_sampling_follows_the_weights(spark):
    rows = [(i, item, w) for i in range(2000) for item, w in (("a", 3.0), ("b", 1.0))]
    got = dist.sampled(spark.createDataFrame(rows, "k int, item string, value double"), ["k"], 5).groupBy("item").count().collect()
    n = {r.item: r["count"] for r in got}
    assert sum(n.values()) == 2000 and 1350 < n["a"] < 1650


def test_harmonic_and_inverted_odds(spark, d):
    r = spark.range(1).select(dist.harmonic(F.lit(0.0), F.lit(0.0)), dist.harmonic(F.lit(0.5), F.lit(1.0))).first()
    assert r[0] == 0.0 and r[1] == pytest.approx(2 / 3)
    assert sum(values(dist.inverted_odds(d, ["k"])).values()) == pytest.approx(1.0)
