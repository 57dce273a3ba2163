"""Joins with guarantees, ordered scans, skew-proof per-key results, syntax."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from verbloom.operators import relate, skew, syntax

c = F.col


def test_lookup_fails_on_missing_or_repeated_keys(spark):
    a = spark.createDataFrame([(1,), (2,)], "k int")
    f = spark.createDataFrame([(1, "x"), (2, "y")], "k int, f string")
    assert relate.looked_up(a, f, ["k"], "f").count() == 2
    for bad in (f.filter("k = 1"), f.union(f)):
        with pytest.raises(Exception, match="no feature|repeated key"):
            relate.looked_up(a, bad, ["k"], "f").collect()


def test_containment_equals_brute_force(spark):
    rng = random.Random(3)
    pts = [(s, rng.randrange(300)) for s in "ab" for _ in range(80)]
    sp = [(s, b, b + rng.randrange(0, 90)) for s in "ab" for b in (rng.randrange(300) for _ in range(60))]
    got = relate.containing(spark.createDataFrame(pts, "s string, p int"), spark.createDataFrame(sp, "s string, b int, e int"), ["s"], "p", "b", "e")
    assert sorted(map(tuple, got.select("s", "p", "b", "e").collect())) == sorted((s, p, b, e) for s, p in pts for t, b, e in sp if s == t and b <= p < e)


def test_scans(spark):
    t = spark.createDataFrame([("s", 0, "ab"), ("s", 1, ""), ("s", 2, "c")], "k string, idx int, t string")
    assert [r.offset for r in relate.offsets(t, ["k"], "idx", F.length("t")).orderBy("idx").collect()] == [0, 2, 2]
    assert [r["rank"] for r in relate.without_gaps(t, ["k"], "idx", c("t") == "").orderBy("idx").collect()] == [0, 1]
    n = relate.wrapped_neighbours(t, ["k"], [c("idx")], "idx").orderBy("idx").collect()
    assert [(r.next, r.previous) for r in n] == [(1, 2), (2, 0), (0, 1)]
    assert relate.while_true(t, ["k"], [c("idx")], c("t") != "").count() == 1


def _ts(rows):
    return [(k, None if s is None else datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s), "x") for k, s in rows]


def test_balanced_equals_plain_grouping(spark):
    rng = random.Random(1)
    rows = [(None if rng.random() < 0.02 else "hot" if rng.random() < 0.6 else f"k{rng.randrange(30)}", None if rng.random() < 0.05 else rng.randrange(5000)) for _ in range(6000)]
    df = spark.createDataFrame(_ts(rows), "k string, t timestamp_ntz, key string")
    got = {r["key"]: r for r in skew.balanced_by_key(df, c("k"), c("t"), parts=7).collect()}
    assert got["hot"].n_parts > 2
    for k in {k for k, _ in rows if k is not None}:
        own = sorted(s for x, s in rows if x == k and s is not None)
        assert got[k].n_rows == sum(x == k for x, _ in rows)
        assert got[k].first_at == datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=own[0])
        assert got[k].max_gap_us == (max((b - a for a, b in zip(own, own[1:])), default=None) or 0) * 1_000_000 if len(own) > 1 else True
    assert None not in got and len(got) == len({k for k, _ in rows if k is not None})


def test_balanced_edge_cases(spark):
    shape = "k string, t timestamp_ntz, key string"
    assert skew.balanced_by_key(spark.createDataFrame([], shape), c("k"), c("t")).count() == 0
    nulls = skew.balanced_by_key(spark.createDataFrame(_ts([("a", None), ("a", None)]), shape), c("k"), c("t")).first()
    assert nulls.n_rows == 2 and nulls.first_at is None and nulls.max_gap_us is None
    same = spark.createDataFrame(_ts([("a", 5)] * 50), shape)
    per = skew.balanced_by_key(same, c("k"), c("t"), parts=4)
    r = per.first()
    assert r.n_rows == 50 and r.max_gap_us == 0 and r.n_parts > 1
    assert [x["key"] for x in skew.hot_keys(per, same).collect()] == ["a"]


def test_syntax(spark):
    rows = [("s", 0, "He", "he", "PRP", 1, "SBJ"), ("s", 1, "was", "be", "VBD", -1, "ROOT"), ("s", 2, "seen", "see", "VBN", 1, "VC"), ("s", 3, "by", "by", "IN", 2, "LGS"), ("s", 4, "them", "they", "PRP", 3, "PMOD")]
    t = spark.createDataFrame(rows, "sentence_id string, idx int, token string, lemma string, pos string, dep_head int, dep_label string")
    assert {r.idx for r in syntax.passives(t).collect()} == {2}
    args = spark.createDataFrame([("s", 2, 0), ("s", 2, 3)], "sentence_id string, verb_index int, idx int")
    assert {r.idx: r.function for r in syntax.functions(args, t, active=True).collect()} == {0: "OBJ", 3: "SBJ"}
    assert {r.idx: r.head_idx for r in syntax.heads(args, t).collect()} == {0: 0, 3: 4}
    assert {r.idx: r.prep for r in syntax.prepositions(args, t).collect()} == {0: "<none>", 3: "by"}
    paths = syntax.closures(t).cache()
    assert {(r.ancestor, r.distance) for r in paths.filter("idx = 4").collect()} == {(4, 0), (3, 1), (2, 2), (1, 3)}
    lca = syntax.lowest_common(paths, spark.createDataFrame([("s", 0, 4)], "sentence_id string, a int, b int")).first()
    assert (lca.ancestor, lca.steps) == (1, 4)
    assert {(r.idx, r.b, r.e) for r in syntax.spans(paths).collect()} >= {(1, 0, 5), (3, 3, 5)}


def test_closures_of_deep_trees_and_cycles(spark):
    t = spark.createDataFrame([("s", i, i - 1) for i in range(150)], "sentence_id string, idx int, dep_head int")
    got = syntax.closures(t)
    assert got.count() == 150 * 151 // 2 and got.agg({"distance": "max"}).first()[0] == 149
    with pytest.raises(ValueError, match="above itself"):
        syntax.closures(spark.createDataFrame([("s", 0, 1), ("s", 1, 0)], t.schema))


def test_heads_and_prepositions_take_three_joins(spark, data):
    from verbloom.plans import structure

    plan = structure.syntax_heads(spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 3
