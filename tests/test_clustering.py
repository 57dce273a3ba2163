"""Kernels and trees: hand-checked merges, invariants, recovery of planted clusters."""

import itertools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from verbloom.operators import agglom, flat, models, tree, tuning

POINTS = np.array([[4, 0], [3, 1], [0, 4], [0, 2]], float)
POINTS = np.c_[POINTS, [0, 0, 0, 2]]


def test_min_entropy_merges():
    t = agglom.agglomerate([agglom.min_entropy(POINTS)])
    assert t.leaf_loss == pytest.approx([0, 2.249341, 0, 2.772589], abs=1e-6)
    assert [m[:2] for m in t.merges] == [(0, 1), (2, 3), (4, 5)]
    assert [m[2] for m in t.merges] == pytest.approx([3.014161, 4.498681, 15.732383], abs=1e-5)


def test_size_prior_and_repeated_keys():
    t = agglom.max_prior(np.ones(2), 4)
    one, both = t.loss(t.rows), t.loss(t.rows.sum(axis=0, keepdims=True))[0]
    assert one[0] == pytest.approx(-1.386294, abs=1e-6) and both == pytest.approx(-1.386294, abs=1e-6)
    k = agglom.repeated_keys(np.array([[2.0, 1.0]]))
    assert k.loss(k.rows)[0] == 1.0


def test_vector_mean_loss_is_the_squared_distance():
    v = np.array([[0.0, 0.0], [2.0, 0.0]])
    t = agglom.vector_mean(v)
    assert t.loss(t.rows.sum(axis=0, keepdims=True))[0] == pytest.approx(2.0 / 175)


def test_complete_linkage():
    x = np.array([0.0, 1.0, 5.0, 7.0])
    t = agglom.complete_linkage(np.abs(x[:, None] - x[None, :]))
    assert [(a, b, loss) for a, b, loss in t.merges] == [(0, 1, 1.0), (2, 3, 2.0), (4, 5, 7.0)]


def test_a_lowered_loss_is_an_error():
    with pytest.raises(ValueError):
        agglom.agglomerate([agglom.Term(np.ones((3, 1)), lambda m: -(m[..., 0] ** 2))])


def test_stop_and_roots():
    t = agglom.agglomerate([agglom.min_entropy(POINTS)], stop=lambda n, a, b, loss: n <= 2)
    assert len(t.merges) == 2 and sorted(t.roots()) == [4, 5]


def test_hybrid_recovers_planted_clusters():
    rng = np.random.default_rng(1)
    rows = np.vstack([rng.multinomial(200, p, 60) for p in ([0.9, 0.05, 0.05], [0.05, 0.9, 0.05], [0.05, 0.05, 0.9])]).astype(float)
    t, at = agglom.hybrid([agglom.min_entropy(rows)], rows)
    frame = tree.frame("v", t, np.bincount(at, minlength=t.n).tolist())
    cut = frame[(frame.born <= 2) & (frame.died > 2)]
    position = frame.set_index("node").leaf_lo
    cluster = [int(cut[(cut.leaf_lo <= position[a]) & (cut.leaf_hi >= position[a])].node.iloc[0]) for a in at]
    assert len(cut) == 3 and all(len(set(cluster[i : i + 60])) == 1 for i in (0, 60, 120)) and len(set(cluster)) == 3
    assert max(frame.depth) <= agglom.MAX_DEPTH


def test_sparse_rows_equal_dense_ones():
    rng = np.random.default_rng(2)
    dense = rng.poisson(0.6, (700, 9)) + np.eye(9)[rng.integers(9, size=700)]
    i, j = np.nonzero(dense)
    rows = agglom.Rows(np.searchsorted(i, np.arange(701)), j, dense[i, j], 9)
    theta = rng.dirichlet(np.ones(9), 4)
    assert rows.losses(theta) == pytest.approx(-dense @ np.log(theta).T) and (rows.row(5) == dense[5]).all()
    at = rng.integers(4, size=700)
    assert rows.sums(at, 4) == pytest.approx(np.array([dense[at == k].sum(axis=0) for k in range(4)]))
    assert (agglom.flat_sets(rows, 20, 0.01, 3) == agglom.flat_sets(agglom.Rows.of(dense), 20, 0.01, 3)).all()


def test_depth_cap_keeps_losses_and_members():
    t = agglom.Tree(6, [0.0] * 6, [(0, 1, 1.0), (6, 2, 2.0), (7, 3, 3.0), (8, 4, 4.0), (9, 5, 5.0)])
    out, at = agglom.capped(t, np.arange(6), 2)
    assert out.n == 3 and sorted(np.bincount(at).tolist()) == [1, 1, 4] and out.merges[-1][2] == 5.0
    assert out.leaf_loss[at[0]] == 3.0


@st.composite
def trees(draw):
    n = draw(st.integers(1, 12))
    alive, merges = list(range(n)), []
    for k in range(n - 1):
        i, j = draw(st.sampled_from([(a, b) for a, b in itertools.combinations(range(len(alive)), 2)]))
        a, b = alive[i], alive[j]
        merges.append((a, b, float(draw(st.integers(0, 5)))))
        alive = [x for x in alive if x not in (a, b)] + [n + k]
    return agglom.Tree(n, [float(draw(st.integers(0, 2))) for _ in range(n)], merges)


@settings(max_examples=60, deadline=None)
@given(trees())
def test_lives_are_the_literal_frontiers(t):
    key = tree.keys(t, [1.0] * t.n, "per_count")
    born, died = tree.lives(t, key)
    front, step = set(t.roots()), 0
    while True:
        assert {x for x in range(len(born)) if born[x] <= step < died[x]} == front
        split = [x for x in front if t.children(x)]
        if not split:
            break
        best = max(key[x] for x in split)
        for x in split:
            if key[x] >= best - 1e-12:
                front = (front - {x}) | set(t.children(x))
        step += 1


@settings(max_examples=40, deadline=None)
@given(trees())
def test_json_and_leaf_intervals(t):
    again, values = tree.from_json(tree.to_json(t))
    assert len(again.merges) == len(t.merges) and sorted(values) == list(range(t.n))
    f = tree.frame("v", t, [1.0] * t.n)
    assert sorted(f[f.left < 0].leaf_lo) == list(range(t.n))
    assert all(f["size"] == f.leaf_hi - f.leaf_lo + 1) and len(f) == 2 * t.n - 1


def test_restricted_tree():
    t = agglom.Tree(3, [0.0] * 3, [(0, 1, 1.0), (3, 2, 2.0)])
    out = tree.restricted(t, {0, 2})
    assert out.n == 2 and out.merges == [(0, 1, 2.0)]


def test_joint_clustering_keeps_all_weight():
    outer = [[np.array([4.0, 0.0]), np.array([0.0, 3.0])], [np.array([3.0, 0.0])], [np.array([0.0, 5.0])]]
    t, inner = agglom.joint(outer, 0.1)
    assert len(t.merges) == 2 and sum(r.sum() for r, _ in inner[max(inner)]) == 15.0


# --- DataFrame steps


def _dist(spark, rows=((0, 4, 0), (1, 3, 1), (2, 0, 4), (3, 0, 2))):
    out = [("v", i, "a", float(a)) for i, a, b in rows] + [("v", i, "b", float(b)) for i, a, b in rows] + [("v", 3, "c", 2.0)]
    return spark.createDataFrame([r for r in out if r[3] > 0], "verb_type string, instance bigint, item string, value double")


def test_hard_step_losses(spark):
    assign = spark.createDataFrame([("v", 0, "0", 1.0), ("v", 1, "0", 1.0), ("v", 2, "1", 1.0), ("v", 3, "1", 1.0)], "verb_type string, instance bigint, cluster string, p double")
    loss = flat.losses(_dist(spark), flat.estimate(_dist(spark), assign, 0.01))
    got = {(r.instance, r.cluster): r.loss for r in loss.collect()}
    want = {(0, "0"): 0.537218, (0, "1"): 31.137893, (1, "0"): 2.480277, (1, "1"): 23.641796, (2, "0"): 8.309452, (3, "0"): 19.723672, (2, "1"): 1.153504, (3, "1"): 3.348508}
    for k, v in want.items():
        assert got[k] == pytest.approx(v, abs=1e-4), k
    assert {r.instance: r.cluster for r in flat.hard_step(loss).collect()} == {0: "0", 1: "0", 2: "1", 3: "1"}


def test_soft_step(spark):
    loss = spark.createDataFrame([("v", 0, "a", 1.0), ("v", 0, "b", 2.0)], "verb_type string, instance bigint, cluster string, loss double")
    got = {r.cluster: r for r in flat.soft_step(flat.with_prior(loss, None)).collect()}
    assert got["a"].p == pytest.approx(0.731059, abs=1e-6) and got["a"].expected == pytest.approx(1.962089, abs=1e-6)


def test_hard_em_recovers(spark):
    rows = [("v", i, "xyz"[i % 3] if k < 9 else "w", 5.0 + k % 2) for i in range(30) for k in range(10)]
    d = spark.createDataFrame(rows, "verb_type string, instance bigint, item string, value double").groupBy("verb_type", "instance", "item").sum("value").withColumnRenamed("sum(value)", "value")
    start = spark.createDataFrame([("v", i, str(i % 3 if i < 24 else 0), 1.0) for i in range(30)], "verb_type string, instance bigint, cluster string, p double")
    got = {r.instance: r.cluster for r in flat.run(d, start, 0.01, max_steps=6).collect()}
    assert all(got[i] == got[i % 3] for i in range(30)) and len(set(got.values())) == 3


def test_em_goes_on_until_every_verb_type_is_stable(spark, monkeypatch):
    from pathlib import Path

    from verbloom.plans import clustering

    if not Path("/root/testdata/sf0.01").exists():
        pytest.skip("no test data here")
    seen, run = {}, flat.run

    def kept(dist, *args, **options):
        seen["dist"], seen["out"] = dist, run(dist, *args, **options)
        return seen["out"]

    monkeypatch.setattr(flat, "run", kept)
    clustering.em_until_stable(spark, "/root/testdata/sf0.01")
    dist, out = seen["dist"], seen["out"]
    again = flat.hard_step(flat.with_prior(flat.losses(dist, flat.estimate(dist, out, 0.01)), None))
    mean = lambda d: {r[0]: r[1] for r in d.groupBy("verb_type").agg({"loss": "avg"}).collect()}
    old, new = mean(out), mean(again)
    assert out.count() == dist.select("verb_type", "instance").distinct().count() and all(old[v] - new[v] <= 1e-5 for v in old)
    with pytest.raises(RuntimeError, match="stable"):
        run(dist, flat.starting(dist, 8), 0.01, max_steps=2)


def test_farthest_first_and_empty_cluster(spark):
    loss = spark.createDataFrame([("v", 0, "a", 1.0), ("v", 1, "a", 5.0), ("v", 2, "a", 5.0)], "verb_type string, instance bigint, cluster string, loss double")
    centre = loss.select("verb_type", "cluster").distinct()
    assert flat.farthest_first(loss, centre).first().instance == 1
    assign = spark.createDataFrame([("v", 0, "x", 0.0)], "verb_type string, instance bigint, cluster string, p double")
    theta = [r.theta for r in flat.estimate(_dist(spark), assign, 1.0).collect()]
    assert theta == pytest.approx([1 / 3] * 3)


def test_large_groups_go_through_the_flat_stage(spark):
    rows = [("v", i, "ab"[i % 2] + str(k), 3.0) for i in range(40) for k in range(3)]
    d = spark.createDataFrame(rows, "verb_type string, instance bigint, item string, value double")
    nodes, leaves = models.hybrid_model(d, task_limit=10, flat_clusters=4)
    assert sorted(r.instance for r in leaves.collect()) == list(range(40)) and nodes.filter("parent = -1").first()["size"] >= 1


def test_large_groups_get_the_trees_of_small_ones(spark, monkeypatch):
    monkeypatch.setattr(flat.Blocks, "SIZE", 40)
    rng = np.random.default_rng(4)
    counts = np.vstack([rng.multinomial(30, p, 50) for p in rng.dirichlet(np.full(8, 0.3), 3)])
    rows = [("v", 10 * i, f"w{j}", float(x)) for i, r in enumerate(counts) for j, x in enumerate(r) if x]
    d = spark.createDataFrame(rows, "verb_type string, instance bigint, item string, value double")
    one, many = models.hybrid_model(d, flat_clusters=6), models.hybrid_model(d, task_limit=100, flat_clusters=6)
    a, b = (x[0].orderBy("node").toPandas() for x in (one, many))
    assert a.drop(columns="loss").equals(b.drop(columns="loss")) and a.loss.tolist() == pytest.approx(b.loss.tolist())
    assert b["size"].max() == 150 and b[b.left < 0]["size"].sum() == 150
    assert sorted(map(tuple, one[1].collect())) == sorted(map(tuple, many[1].collect()))


def test_a_type_of_many_instances_is_clustered_within_a_task(spark, monkeypatch):
    monkeypatch.setattr(flat, "Blocks", None)  # a job per drawn row
    d = spark.range(25_000).selectExpr("'v' AS verb_type", "id AS instance", "explode(array('a', concat('i', id % 7))) AS item", "cast(1 + id % 5 AS double) AS value")
    nodes, leaves = models.hybrid_model(d, flat_clusters=3)
    assert leaves.agg({"instance": "sum"}).first()[0] == 25_000 * 24_999 // 2 and nodes.filter("parent < 0").first()["size"] == 25_000


def test_common_items_are_multiplied_and_rare_ones_looked_up():
    rng = np.random.default_rng(2)
    dense = np.zeros((700, 300))
    for i in range(700):
        np.add.at(dense[i], np.minimum(rng.zipf(1.5, 6) - 1, 299), 1 + rng.integers(3, size=6) / 4)
    i, j = np.nonzero(dense)
    rows = agglom.Rows(np.searchsorted(i, np.arange(701)), j, dense[i, j], 300)
    theta = rng.dirichlet(np.full(300, 0.5), 12)
    theta[7] = theta[3]  # equal clusters: the first counts
    assert 0 < rows._layout()[1] < 300
    want = -dense @ np.log(theta).T
    assert np.allclose(rows.losses(theta), want)
    at, loss = rows.closest(theta)
    assert (at == np.round(want + np.log(12), 9).argmin(axis=1)).all() and np.allclose(loss, want.min(axis=1) + np.log(12)) and 7 not in at
    assert np.allclose(rows.sums(at, 12), [dense[at == k].sum(axis=0) for k in range(12)])


def test_verbs_have_one_row_each_without_listing_components(spark, data):
    from verbloom.plans import presets

    have = presets.verbs(spark, data)
    plan = have["instances"]._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Aggregate" not in plan
    assert sorted(map(tuple, have["instances"].collect())) == sorted(map(tuple, have["mlm_masked"].select("verb_type", "instance").distinct().collect()))


def test_baselines_in_one_cluster_score_the_first_cut_only(spark, monkeypatch):
    from verbloom.operators import agglom
    from verbloom.plans import presets

    nodes = spark.createDataFrame(tree.frame("v", agglom.Tree(3, [0.0] * 3, [(0, 1, 0.0), (2, 3, 0.0)]), [2, 2, 2]))
    leaves = spark.range(6).selectExpr("'v' AS verb_type", "cast(id % 3 AS int) AS leaf", "id AS instance")
    gold = spark.range(6).selectExpr("id AS instance", "concat('L', id % 3) AS label")
    limits, points = [], tuning.model_points
    monkeypatch.setattr(presets, "verbs", lambda spark, d: {"gold": gold})
    monkeypatch.setattr(presets.models, "run", lambda name, have: (nodes, leaves, None))
    monkeypatch.setattr(presets.tuning, "model_points", lambda *args: limits.append(args[4]) or points(*args))
    got = {r.model: (round(r.precision, 6), r.recall) for r in presets.verb_baselines(spark, "").collect()}
    assert got == {"verb/gold": (1.0, 1.0), "verb/random": (0.333333, 1.0), "verb/noop": (0.333333, 1.0)} and limits == [2**31 - 2, 1, 1]


def test_curve_counts_labels_by_leaf_before_nodes(spark):
    from verbloom.operators import agglom

    t = agglom.Tree(2, [1.0, 1.0], [(0, 1, 8.0)])
    nodes = spark.createDataFrame(tree.frame("v", t, [300, 300]))
    leaves = spark.range(600).selectExpr("'v' AS verb_type", "cast(id % 2 AS int) AS leaf", "id AS instance")
    gold = spark.range(600).selectExpr("id AS instance", "concat('L', id % 3) AS label")
    points = tuning.curve(nodes, leaves, gold)
    assert {r.n_clusters: (round(r.precision, 6), round(r.recall, 6), r.weight) for r in points.collect()} == {1: (0.333333, 1.0, 600.0), 2: (0.333333, 0.5, 600.0)}
    plan = points._jdf.queryExecution().optimizedPlan().toString()
    assert any("Aggregate [" in x and "leaf#" in x and "label#" in x for x in plan.split("\n"))


def test_cut_and_curve(spark):
    rows = [("v", i, "ab"[i // 3], 4.0) for i in range(6)]
    nodes, leaves = tree.clustered(spark.createDataFrame(rows, "verb_type string, instance bigint, item string, value double"))
    nodes, leaves = nodes.cache(), leaves.cache()
    step = tree.number_cut(nodes, 2).first().step
    got = {r.instance: r.cluster for r in tree.cut_at(nodes, leaves, step).collect()}
    assert len({got[i] for i in range(3)}) == 1 and len({got[i] for i in range(3, 6)}) == 1 and got[0] != got[5]
    gold = spark.createDataFrame([(i, "LR"[i // 3]) for i in range(6)], "instance bigint, label string")
    points = {r.n_clusters: r for r in tuning.curve(nodes, leaves, gold).collect()}
    assert points[2].precision == pytest.approx(1.0) and points[2].recall == pytest.approx(1.0) and points[1].precision == pytest.approx(0.5)
    extra = spark.createDataFrame([("v", 9, "side")], "verb_type string, instance bigint, cluster string")
    more = tuning.curve(nodes, leaves, gold.union(spark.createDataFrame([(9, "S")], "instance bigint, label string")), extra=extra)
    assert {r.weight for r in more.collect()} == {7.0}
    assert tree.entropy_cut(nodes, 0.0).count() == 1 and tree.path_to(nodes, 0).count() >= 2
    assert tree.depth_limited(nodes, 1).filter("depth = 1 AND left = -1").count() == 2


# --- model strings


def test_model_strings():
    assert models.parse("arg/syntf").kind == "baseline" and models.parse("arg/syntf+").kind == "full"
    assert models.parse("arg/syntf").key != models.parse("arg/syntf+").key
    three = models.parse("arg/qent+pent+dv")
    assert set(three.terms.values()) == {0.33}
    assert models.parse("arg/msc->qent*2+pent").side == frozenset({"modal", "syntf"})
    assert models.side_flags("gr") == frozenset({"gold_nosense"}) and models.side_flags("cr") == frozenset({"syntf2", "gold_wsense"}) and models.side_flags("xyz") == frozenset()
    assert models.parse("verb/gold").kind == "baseline" and models.parse("joint/mlm_masked+qent").index == "joint"
    for bad in ("arg/none", "verb/qent", "text", "arg/"):
        with pytest.raises(ValueError):
            models.parse(bad)


def test_criteria():
    assert tuning.parse("entropy=0.5,1") == ("entropy", [0.5, 1.0]) and len(tuning.parse("num-clusters")[1]) == 35
    assert len(tuning.GRIDS["oracle"]) == 21 and tuning.GRIDS["entropy"][0] == -0.5 and tuning.GRIDS["entropy"][-1] == 5
    with pytest.raises(ValueError):
        tuning.parse("other")


def test_best_threshold_ties(spark):
    rows = lambda ts: spark.createDataFrame([("x", float(t), f) for t, f in ts], "criterion string, t double, f1 double")
    best = lambda ts: tuning.best_threshold(rows(ts), ["criterion"]).first().t
    assert best([(1, 0.5), (2, 0.9), (3, 0.9)]) == 2.0 and best([(1, 0.9), (2, 0.9), (3, 0.5)]) == 2.0 and best([(1, 0.1), (2, 0.9), (3, 0.1)]) == 2.0


def test_noise_and_random(spark):
    labels = spark.createDataFrame([("v", i, "ab"[i % 2]) for i in range(400)], "verb_type string, instance bigint, label string")
    noisy = models.noisy(labels, 0.1, 1)
    changed = noisy.join(labels.withColumnRenamed("label", "old"), ["verb_type", "instance"]).filter("label <> old").count()
    assert 5 <= changed <= 50 and noisy.count() == 400
    assert models.random_clusters(labels, 3, 1).select("cluster").distinct().count() == 3


def _choose(name, points, t):
    """The rules of the criteria over the points of one verb type, in order of steps: dicts of loss, sizes, losses."""
    import math

    n = sum(points[0]["sizes"])
    loss = lambda p: sum(p["losses"])
    mixing = lambda ws: sum(-w * math.log(w / sum(ws)) for w in ws)
    top = lambda p: max(x / s for x, s in zip(p["losses"], p["sizes"]))

    def last_above(f):
        by = sorted(points, key=lambda p: -f(p))
        above = []
        for p in by:
            if f(p) <= t:
                break
            above.append(p)
        return above[-1] if above else by[0]

    if name == "num-clusters":
        return next((p for p in points if len(p["sizes"]) >= t), points[-1])
    if name == "cut-delta":
        by = sorted(points, key=loss)
        passing = 0
        while passing + 1 < len(by) and loss(by[passing + 1]) - loss(by[passing]) < t * n:
            passing += 1
        return by[max(passing - 1, 0)]
    if name in ("loss", "max-loss"):
        return last_above((lambda p: loss(p) / n) if name == "loss" else top)
    score = {
        "entropy": lambda p: loss(p) + t * mixing(p["sizes"]), "wentropy": lambda p: loss(p) + t * mixing(p["weights"]), "max-entropy": lambda p: top(p) + t * mixing(p["sizes"]) / n,
        "log-penalty": lambda p: loss(p) + t * math.log(len(p["sizes"])) * n, "linear-penalty": lambda p: loss(p) + t * len(p["sizes"]) * n, "sq-nclusters": lambda p: loss(p) + t * len(p["sizes"]) ** 2,
    }[name]
    return min(points, key=score)


def test_criteria_choose_by_their_rules(spark):
    """Trees of two verb types: what each criterion chooses, from the lists of clusters of every cut."""
    rng = np.random.default_rng(3)
    rows = [(v, i, f"i{j}", float(x)) for v, n in (("a", 14), ("b", 9)) for i in range(n) for j, x in enumerate(rng.integers(0, 9, 6)) if x]
    nodes, leaves = tree.clustered(spark.createDataFrame(rows, "verb_type string, instance long, item string, value double"))
    weights = spark.createDataFrame([(v, i, float(1 + (i * 7) % 5)) for v in "ab" for i in range(14)], "verb_type string, instance long, weight double")
    gold = spark.createDataFrame([(i, "xyz"[i % 3]) for i in range(14)], "instance long, label string")
    nodes = tree.weighted(nodes, leaves, weights).cache()
    points = tuning.curve(nodes, leaves, gold).cache()
    alive = nodes.toPandas()
    by_verb = {}
    for v, own in alive.groupby("verb_type"):
        at = []
        for step in sorted({int(x) for x in own["born"]}):
            now = own[(own["born"] <= step) & (step < own["died"])]
            at.append({"step": step, "losses": now["loss"].tolist(), "sizes": now["size"].tolist(), "weights": now["weight"].tolist()})
        by_verb[v] = at
    assert all(abs(sum(p[0]["weights"]) - sum(1 + (i * 7) % 5 for i in range(n))) < 1e-9 for p, n in ((by_verb["a"], 14), (by_verb["b"], 9)))
    for r in points.collect():
        p = next(p for p in by_verb[r.verb_type] if p["step"] == r.step)
        assert r.top_loss == pytest.approx(max(x / s for x, s in zip(p["losses"], p["sizes"])))
    for name in tuning.GRIDS:
        if name != "oracle":
            ts = tuning.GRIDS[name][:: max(1, len(tuning.GRIDS[name]) // 9)]
            got = {(r.verb_type, r.t): r.step for r in tuning.chosen(points, f"{name}={','.join(map(str, ts))}").collect()}
            assert got == {(v, float(t)): _choose(name, p, t)["step"] for v, p in by_verb.items() for t in ts}, name


def test_split_by_the_chosen_setting(spark):
    rows = [("a", i, f"i{i % 3}", 5.0) for i in range(9)]
    nodes, leaves = (x.cache() for x in tree.clustered(spark.createDataFrame(rows, "verb_type string, instance long, item string, value double")))
    points = tuning.curve(nodes, leaves, spark.createDataFrame([(i, f"l{i % 3}") for i in range(9)], "instance long, label string")).cache()
    for name, t in (("num-clusters", 3.0), ("entropy", 0.5), ("sq-nclusters", 0.1), ("log-penalty", 0.5)):
        out = tuning.split_by(nodes, leaves, points, name, t).collect()
        assert sorted(r.instance for r in out) == list(range(9))
        assert len({r.cluster for r in out}) == 3, name
    best = tuning.best_setting(tuning.tuned_all(points, list(tuning.GRIDS))).collect()
    assert len(best) == 1 and best[0].criterion != "oracle" and best[0].f1 == pytest.approx(1.0)


def test_side_labels(spark):
    from pyspark.sql import functions as F

    rows = [("would", "MOD", "A", "AM-MOD"), ("no longer", "NEG", "N", "AM-NEG"), ("on the other hand", "ADV", "D", "AM-DIS"), ("then", "TMP", "T", "AM-TMP"), ("the dog", "SBJ", "OBJ", "A0"), (None, "OBJ", None, "A1")]
    df = spark.createDataFrame(rows, "text string, f string, g string, role string")
    c = F.col
    label = lambda flags: [r[0] for r in df.select(models.side_label(models.side_flags(flags), c("text"), c("f"), c("g"), c("role"), F.lit("go.01"))).collect()]
    assert label("mnad") == ["MODAL", "NEG", "DIS", "TMP", None, None]
    assert label("s") == ["MOD", "NEG", "ADV", "TMP", "SBJ", "OBJ"] and label("c") == ["A", "N", "D", "T", "OBJ", None]
    assert label("mg") == ["MODAL", "AM-NEG", "AM-DIS", "AM-TMP", "A0", "A1"] and label("r")[-1] == "go.01.A1" and label("") == [None] * 6


@pytest.mark.parametrize("by_size", [False, True])
def test_random_trees(spark, by_size):
    for n in (1, 2, 3, 40):
        t = agglom.random_tree(n, np.random.default_rng(n), by_size)
        sizes = t.fold(lambda i: 1, lambda _, a, b: a + b)
        assert len(t.merges) == n - 1 and len(t.roots()) == 1 and sizes[t.roots()[0]] == n
    df = spark.createDataFrame([(v, i) for v in "ab" for i in range(30)], "verb_type string, instance long")
    nodes, leaves = tree.random_trees(df, 1, by_size)
    assert leaves.groupBy("verb_type").count().collect()[0]["count"] == 30 and nodes.filter("parent < 0").count() == 2
    again, _ = tree.random_trees(df, 1, by_size)
    assert sorted(map(tuple, nodes.collect())) == sorted(map(tuple, again.collect()))


def test_label_trees_split_off_one_label_a_step(spark):
    rows = [("v", i, label) for i, label in enumerate("aaaabbbccd")] + [("w", 1, "a")]
    nodes, leaves = models.label_trees(spark.createDataFrame(rows, "verb_type string, instance long, cluster string"))
    for step in range(4):
        got = {}
        for r in tree.cut_at(nodes, leaves, step).filter("verb_type = 'v'").collect():
            got.setdefault(r.cluster, set()).add(rows[r.instance][2])
        big = [set("abcd"[: k + 1]) for k in range(4)]
        assert sorted(map(sorted, got.values())) == sorted([sorted(x) for x in [set("dcba"[: 4 - step])] + [{x} for x in "dcba"[4 - step :]]]), (step, got, big)
    assert nodes.filter("verb_type = 'w'").count() == 1 and {r.depth for r in nodes.filter("verb_type = 'w'").collect()} == {0}
    kids = {r.node: (r.left, r.right, r.size) for r in nodes.filter("verb_type = 'v'").collect()}
    assert all(s == kids[a][2] + kids[b][2] for a, b, s in kids.values() if a >= 0)


def test_weighted_terms_cost_their_own_losses(spark):
    """Question entropy and pairs of one verb: merges equal those of the kernel over both terms; large and small verb
    types agree, and arguments without questions are placed too."""
    rng = np.random.default_rng(2)
    n = 24
    counts = rng.integers(0, 6, (n, 5)).astype(float)
    counts[3] = 0
    verbs = np.arange(n) % 8
    q = [("v", i, f"q{j}", float(counts[i, j])) for i in range(n) for j in range(5) if counts[i, j]]
    f = {
        "questions": spark.createDataFrame(q, "verb_type string, instance long, item string, value double"), "verbs": spark.createDataFrame([("v", i, f"s:{verbs[i]}") for i in range(n)], "verb_type string, instance long, verb string"),
        "instances": spark.createDataFrame([("v", i) for i in range(n)], "verb_type string, instance long"),
    }
    nodes, leaves, _ = models.run("arg/qent+dv", f)
    assert leaves.count() == n
    counts = np.c_[counts, np.zeros(n)]
    counts[3, 5] = 1  # <none>
    want = agglom.agglomerate([agglom.min_entropy(counts, 0.5), agglom.repeated_keys(np.eye(8)[verbs], 0.5)], check=False)
    assert sorted(round(r.loss, 6) for r in nodes.collect()) == pytest.approx(sorted(round(want.loss(x), 6) for x in range(2 * n - 1)), abs=2e-6)
    rows, kinds = models.costs(models.parse("arg/qent+dv"), f)
    small = models.hybrid_model(rows, flat_clusters=6, terms=kinds, task_limit=100)
    large = models.hybrid_model(rows, flat_clusters=6, terms=kinds, task_limit=5)
    groups = lambda leaves: sorted(tuple(sorted(r.instance for r in g)) for g in _by_leaf(leaves).values())
    assert groups(large[1]) == groups(models.hybrid_model(rows, flat_clusters=6, terms=kinds, task_limit=100, task_entries=1)[1])
    assert small[1].count() == large[1].count() == n and len(groups(large[1])) <= 6
    one, members, _ = models.run("arg/noop", f)
    assert members.count() == n and one.filter("parent < 0").first().size == n and one.first().loss == 0


def _by_leaf(leaves):
    out = {}
    for r in leaves.collect():
        out.setdefault(r.leaf, []).append(r)
    return out
