"""Divisive tree, merge history and cuts (F1, F3-F5) against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfsense.operators import clusters as C
from shelfsense.operators import properties as PR
from shelfsense.plans import catalog as K

D = "/root/testdata/sf0.001"


def _long(spark, points):
    """Long features of dense points; zeros are left out, as dummies are."""
    rows = [(i, f"f{j:02d}", float(v)) for i, p in points.items() for j, v in enumerate(p) if v]
    rows += [(i, "f00", 0.0) for i, p in points.items() if not any(p)]
    return spark.createDataFrame(rows, "property_id long, feature string, value double")


def _cost(x):
    return float(((x - x.mean(axis=0)) ** 2).sum())


def _halves(x):
    """One split by definition: cut at the mean of the widest feature, then the
    two means move."""
    spread = ((x - x.mean(axis=0)) ** 2).sum(axis=0)
    f = int(np.argmax(np.round(spread, 9)))
    half = x[:, f] > x[:, f].mean()
    for _ in range(C.ROUNDS):
        a, b = x[~half].mean(axis=0), x[half].mean(axis=0)
        half = ((x - b) ** 2).sum(axis=1) < ((x - a) ** 2).sum(axis=1)
    return half


def _brute_history(points, max_k):
    """Splits of the costliest cluster, one after the other."""
    ids = np.array(sorted(points))
    x = np.array([points[i] for i in ids], float)
    groups, out = [np.arange(len(ids))], []
    while len(groups) < max_k:
        costs = [_cost(x[g]) for g in groups]
        at = int(np.argmax(costs))
        if costs[at] <= 1e-9:
            break
        g = groups.pop(at)
        half = _halves(x[g])
        groups += [g[~half], g[half]]
        out.append((costs[at], len(g), sorted([(round(_cost(x[p]), 6), len(p)) for p in (g[~half], g[half])])))
    return out, [set(ids[g].tolist()) for g in groups]


@pytest.fixture(scope="module")
def sixty():
    rng = random.Random(3)
    return {i: [rng.randint(0, 50), rng.randint(0, 9), rng.randint(0, 1), rng.randint(0, 1), rng.choice([0, 0, 0, 7])] for i in range(60)}


def test_history_by_brute_force(spark, sixty):
    tree = C.divisive_tree(_long(spark, sixty), 20)
    rows = C.merge_history(tree).orderBy("step").collect()
    want, groups = _brute_history(sixty, 20)
    assert [r.step for r in rows] == list(range(1, 20))
    for r, (cost, size, halves) in zip(rows, want):
        assert abs(r.cost - cost) < 1e-6 and r["size"] == size
        assert sorted([(round(r.left_cost, 6), r.left_size), (round(r.right_cost, 6), r.right_size)]) == halves
        assert abs(r.gain - (r.cost - r.left_cost - r.right_cost)) < 1e-9 and r.gain > 0
    labels = C.cut(tree, 20).collect()
    found = [{r.property_id for r in labels if r.cluster == c} for c in range(20)]
    assert sorted(map(sorted, found)) == sorted(map(sorted, groups))


def test_every_cut_is_nested_and_numbered(spark, sixty):
    tree = C.divisive_tree(_long(spark, sixty), 20)
    rows = C.cut(tree, list(range(1, 21))).collect()
    of = {k: {r.property_id: r.cluster for r in rows if r.k == k} for k in range(1, 21)}
    for k in range(1, 21):
        assert set(of[k]) == set(sixty) and set(of[k].values()) == set(range(k))
        firsts = [min(i for i in of[k] if of[k][i] == c) for c in range(k)]
        assert firsts == sorted(firsts)
        if k > 1:
            assert all(len({of[k - 1][i] for i in of[k] if of[k][i] == c}) == 1 for c in range(k))
    single = {r.property_id: r.cluster for r in C.cut(C.divisive_tree(_long(spark, sixty), 5), 5).collect()}
    assert single == of[5]  # a shallower tree gives the same groups


def test_few_and_equal_properties(spark):
    points = {i: [float(i % 3) * 10, 1.0] for i in range(30)}
    tree = C.divisive_tree(_long(spark, points), 8)
    assert C.merge_history(tree).count() == 2
    rows = C.cut(tree, [3, 8]).collect()
    for k in (3, 8):
        assert {r.property_id: r.cluster for r in rows if r.k == k} == {i: i % 3 for i in points}
    one = C.divisive_tree(_long(spark, {4: [1.0]}), 3)
    assert [(r.property_id, r.cluster) for r in C.cut(one, 2).collect()] == [(4, 0)] and C.merge_history(one).count() == 0
    none = C.divisive_tree(_long(spark, {4: [1.0]}).limit(0), 3)
    assert C.cut(none, 2).count() == 0


def test_null_values_are_left_out(spark):
    long = _long(spark, {1: [5.0, 1.0], 2: [9.0, 0.0]}).unionByName(
        spark.createDataFrame([(3, "f00", None), (3, "f01", 1.0)], "property_id long, feature string, value double"))
    attrs = spark.createDataFrame([(i,) for i in (1, 2, 3)], "property_id long")
    got = {r.property_id: r.cluster for r in C.property_clusters(attrs, long, 2).collect()}
    assert got == {1: 0, 2: 1, 3: None}


def test_entries_stay_sparse(spark):
    """10,000 levels: a property's row holds its own features only."""
    attrs = spark.range(3000).selectExpr(
        "id AS property_id", "concat('K', id) AS kind", "'G' AS guest_profile", "cast(null AS string) AS location_type",
        "'USD' AS currency", "concat('F', id % 7000) AS flag_name", "'1' AS zip", "1L AS props_under_mgmt", "cast(id % 90 AS int) AS rooms")
    entries, size = C.feature_entries(PR.property_features(attrs))
    assert size == 1 + 2 + 2999 * 2
    assert entries.agg(F.max(F.size("entries"))).first()[0] <= 5
    tree = C.divisive_tree(PR.property_features(attrs), 3)
    assert C.cut(tree, 3).select("cluster").distinct().count() == 3


def test_tree_of_the_tables(spark):
    features = PR.property_features(K.attrs_of(spark, D)).toPandas()
    wide = features.pivot(index="property_id", columns="feature", values="value").fillna(0.0)
    want, _ = _brute_history({int(i): list(row) for i, row in zip(wide.index, wide.values)}, C.MAX_K)
    rows = K.QUERIES["cluster_merge_history"](spark, D).orderBy("step").collect()
    assert [(round(r.cost, 3), r["size"]) for r in rows] == [(round(c, 3), n) for c, n, _ in want]
