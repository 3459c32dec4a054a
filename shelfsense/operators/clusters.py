"""Property clustering, merge tree and profiles.

The properties are clustered hierarchically from the top.  ``divisive_tree``
grows one binary tree, level by level: all clusters of a level that are still
worth a split are split in two at once, so one pass over the properties moves
the centres of every open cluster.  The tree is a table of splits, and any
number of groups is a cut through it (``cut``): a cluster's cost (within-cluster
sum of squares) is never below that of its parts, so splitting in order of cost
gives nested groups, and the first ``k - 1`` splits give ``k`` groups.  Read from
the last split to the first, the table is a merge history.

The reference merges from the bottom (Ward), which needs all pairs of
properties; both minimise the within-cluster sum of squares step by step, but
the groups can differ.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfsense.sources.workspace import Workspace

DEFAULT_K = 6
#: Groups that a tree can be cut into at most, unless stated otherwise.
MAX_K = 20
#: Times the two centres of a split move.
ROUNDS = 4

SPLITS = ("node long, cost double, size long, left long, left_cost double, left_size long, "
          "right long, right_cost double, right_size long")


def feature_entries(features: DataFrame) -> tuple[DataFrame, int]:
    """(property_id, entries) and the number of features.  ``entries`` are
    the (i, v) pairs of a property's features, as sparse as the long ``features``
    (property_id, feature, value); absent features are 0 and a property with a
    null value is left out.

    A feature's number is its place, from 1, in the sorted list of features,
    which has one entry per category level, not per property; like the centres,
    which are as long, it is held by the driver.  Entry 0 is 1 for every property,
    so sums of entries count properties too.
    """
    spark = features.sparkSession
    names = sorted(r.feature for r in features.select("feature").distinct().collect())
    index = spark.createDataFrame([(n, i) for i, n in enumerate(names, 1)], "feature string, i int")
    entry = F.struct("i", F.col("value").alias("v"))
    own = features.join(index, "feature").groupBy("property_id").agg(
        F.collect_list(F.when(F.col("value").isNotNull(), entry)).alias("entries"),
        F.count(F.when(F.col("value").isNull(), 1)).alias("nulls"))
    one = F.array(F.struct(F.lit(0).alias("i"), F.lit(1.0).alias("v")))
    return own.where("nulls = 0").select("property_id", F.concat(one, "entries").alias("entries")), len(names) + 1


def _moments(points: DataFrame, size: int) -> dict[int, np.ndarray]:
    """Per cluster the sums of every number and of its square, (2, size): one
    partial aggregate over the entries, however large a cluster is."""
    e = points.select("node", F.explode("entries").alias("e"))
    sums = e.groupBy("node", F.col("e.i").alias("i")).agg(F.sum("e.v").alias("s"), F.sum(F.col("e.v") * F.col("e.v")).alias("q"))
    found = sums.toArrow()
    node, i, s, q = (found.column(c).to_numpy() for c in ("node", "i", "s", "q"))
    out: dict[int, np.ndarray] = {}
    for n in np.unique(node).tolist():
        own = node == n
        out[n] = np.zeros((2, size))
        out[n][:, i[own]] = s[own], q[own]
    return out


@dataclass
class Cluster:
    """A cluster's size, cost, and the cut it would be split by first: at the mean
    of the number that varies most."""

    size: int
    cost: float
    widest: int
    mean: float

    @classmethod
    def of(cls, moments: np.ndarray) -> Cluster:
        (s, q), n = moments, moments[0, 0]
        spread = q - s * s / n
        spread[spread <= 1e-12 * q] = 0.0
        widest = int(np.argmax(np.round(spread, 9)))
        return cls(int(n), float(spread.sum()), widest, float(s[widest] / n))


def _split(points: DataFrame, chosen: dict[int, Cluster], lefts: dict[int, int], size: int) -> DataFrame:
    """``points`` of the chosen clusters with the number of the half they fall in
    (the left one's of ``lefts``, or the next): 2-means from the cut at the mean
    of the widest number.  The centres of all clusters move in one pass; they
    have ``size`` numbers each and go out with the plan."""
    spark = points.sparkSession
    left = spark.createDataFrame([(n, lefts[n], c.widest, c.mean) for n, c in chosen.items()], "node long, left long, f int, t double")
    value = F.aggregate("entries", F.lit(0.0), lambda a, e: a + F.when(e["i"] == F.col("f"), e["v"]).otherwise(F.lit(0.0)))
    half = points.join(F.broadcast(left), "node").select(
        "property_id", "entries", (F.col("left") + (value > F.col("t")).cast("int")).alias("node"))
    before: dict[int, np.ndarray] = {}
    for _ in range(ROUNDS):
        now = _moments(half, size)
        if before.keys() == now.keys() and all(np.array_equal(before[n], now[n]) for n in now):
            break  # no property changed sides
        before, rows = now, []
        for n, at in lefts.items():
            if n in chosen:
                a, b = (now[m][0] / now[m][0, 0] for m in (at, at + 1))
                # nearer to b when 2 x (a - b) < |a|^2 - |b|^2
                rows.append((n, at, (2 * (a - b)).tolist(), float(a @ a - b @ b)))
        centres = spark.createDataFrame(rows, "node long, left long, apart array<double>, m double")
        dot = F.aggregate("entries", F.lit(0.0), lambda s, e: s + e["v"] * F.col("apart")[e["i"]])
        half = points.join(F.broadcast(centres), "node").select(
            "property_id", "entries", (F.col("left") + (dot < F.col("m")).cast("int")).alias("node"))
    return half


@dataclass
class Tree:
    """``splits``: one row per split (``SPLITS``), the root being node 1;
    ``leaves`` (property_id, node): the last cluster of every property."""

    splits: DataFrame
    leaves: DataFrame
    workspace: Workspace

    def drop(self) -> None:
        self.workspace.drop()


def divisive_tree(features: DataFrame, max_k: int = MAX_K, workspace: Workspace | None = None) -> Tree:
    """the tree over long ``features`` with every split that a cut into at
    most ``max_k`` groups needs.

    Costs fall along the tree, so a cluster is split only while fewer than
    ``max_k - 1`` clusters cost more.  What reaches the driver is the centres of
    at most ``2 max_k`` clusters of a level.  Equal properties are never parted.
    """
    workspace = workspace or Workspace(features.sparkSession, "tree")
    # the features are read twice and may come from a long plan
    points, size = feature_entries(workspace.save(features, "features"))
    level = workspace.save(points.withColumn("node", F.lit(1).cast("long")), "level-0")
    found = {n: Cluster.of(m) for n, m in _moments(level, size).items()}
    lefts: dict[int, int] = {}
    done: list[DataFrame] = []
    fresh = set(found)
    while True:
        chosen = [n for n in _costliest(found, max_k - 1) if n in fresh]
        rest = sorted(fresh - set(chosen))
        if rest or not chosen:
            done.append(level.where(F.col("node").isin(rest)).select("property_id", "node"))
        if not chosen:
            break
        lefts.update({n: 2 * (len(lefts) + i) + 2 for i, n in enumerate(chosen)})
        open_ = level.where(F.col("node").isin(chosen)) if rest else level
        level = workspace.save(_split(open_, {n: found[n] for n in chosen}, lefts, size), f"level-{min(lefts[n] for n in chosen)}")
        new = {n: Cluster.of(m) for n, m in _moments(level, size).items()}
        found.update(new)
        fresh = set(new)
    rows = []
    for n in _costliest({n: found[n] for n in lefts}, max_k - 1):
        halves = [x for m in (lefts[n], lefts[n] + 1) for x in (m, found[m].cost, found[m].size)]
        rows.append((n, found[n].cost, found[n].size, *halves))
    leaves = done[0]
    for more in done[1:]:
        leaves = leaves.unionByName(more)
    return Tree(features.sparkSession.createDataFrame(rows, SPLITS), leaves, workspace)


def _costliest(found: dict[int, Cluster], n: int) -> list[int]:
    """The ``n`` costliest clusters; of equal cost the smallest number."""
    return sorted((k for k in found if found[k].cost > 0), key=lambda k: (-found[k].cost, k))[:max(n, 0)]


def merge_history(tree: Tree) -> DataFrame:
    """one row per split in the order of cost (``step`` from 1): the cluster,
    its cost and size, its halves with theirs, and ``gain``, what the split takes
    off the cost.  Read backwards, step s joins s + 1 groups into s."""
    w = Window.orderBy(F.desc("cost"), "node")  # at most max_k - 1 rows
    return tree.splits.select(
        F.row_number().over(w).alias("step"), F.col("node").alias("parent"), "left", "right", "cost", "size",
        "left_cost", "left_size", "right_cost", "right_size",
        (F.col("cost") - F.col("left_cost") - F.col("right_cost")).alias("gain"))


def cut(tree: Tree, ks: list[int] | int) -> DataFrame:
    """(property_id, k, cluster) for one or several numbers of groups; the
    labels of a cut count from 0 by the smallest property id.  Properties that
    differ in fewer than ``k`` ways give fewer groups."""
    ks = [ks] if isinstance(ks, int) else list(ks)
    steps = merge_history(tree).orderBy("step").collect()  # at most max_k - 1 rows
    parent = {m: r["parent"] for r in steps for m in (r["left"], r["right"])}
    nodes = [1, *parent]
    places = []
    for k in ks:
        split = {r["parent"] for r in steps[:k - 1]}
        groups = {m for m in nodes if m not in split and (m == 1 or parent[m] in split)}
        for node in nodes:
            up = node
            while up not in groups and up != 1:
                up = parent[up]
            if up in groups:
                places.append((node, k, up))
    placed = tree.leaves.sparkSession.createDataFrame(places, "node long, k int, grp long")  # at most 2 max_k rows a cut
    of = tree.leaves.join(F.broadcast(placed), "node")
    names = of.groupBy("k", "grp").agg(F.min("property_id").alias("first")).select(
        "k", "grp", (F.row_number().over(Window.partitionBy("k").orderBy("first")) - 1).cast("int").alias("cluster"))
    return of.join(F.broadcast(names), ["k", "grp"]).select("property_id", "k", "cluster")


def property_clusters(attrs: DataFrame, features: DataFrame, k: int = DEFAULT_K, tree: Tree | None = None) -> DataFrame:
    """``attrs`` with a ``cluster`` label from 0, numbered by the
    smallest property id; rows that cannot be featurised get null.  ``tree`` may
    be one built before with ``max_k`` of ``k`` or more."""
    tree = tree or divisive_tree(features, k)
    return attrs.join(cut(tree, k).select("property_id", "cluster"), "property_id", "left")


def cut_clusters(attrs: DataFrame, features: DataFrame, k: int, tree: Tree | None = None) -> DataFrame:
    """another number of groups, of the same tree where one is given."""
    return property_clusters(attrs, features, k, tree)


def cluster_profile(clusters: DataFrame, features: DataFrame) -> DataFrame:
    """the most distinguishing feature of each cluster: the feature whose
    cluster mean is furthest from the overall mean in overall standard
    deviations (population), ties by feature name.  ``features`` is long; an
    absent feature is 0."""
    labels = clusters.where(F.col("cluster").isNotNull()).select("property_id", "cluster")
    sizes = labels.groupBy("cluster").agg(F.count("*").alias("n"))
    # one row: the clusters and their sizes (at most k entries)
    sizes = sizes.agg(F.collect_list(F.struct("cluster", "n")).alias("sizes"), F.sum("n").alias("total"))
    value = F.col("value")
    sums = features.join(labels, "property_id").groupBy("feature", "cluster").agg(
        F.sum(value).alias("s"), F.sum(value * value).alias("q"))
    by_feature = sums.groupBy("feature").agg(
        F.map_from_entries(F.collect_list(F.struct("cluster", "s"))).alias("by_cluster"),
        F.sum("s").alias("s"), F.sum("q").alias("q"))
    one = by_feature.withColumn("_one", F.lit(1)).join(F.broadcast(sizes.withColumn("_one", F.lit(1))), "_one")
    mean = F.col("s") / F.col("total")
    deviation = F.sqrt(F.greatest(F.col("q") / F.col("total") - mean * mean, F.lit(0.0)))
    rows = one.select("feature", mean.alias("overall_mean"), deviation.alias("overall_std"), "by_cluster",
                      F.explode("sizes").alias("c"))
    rows = rows.select("feature", F.col("c.cluster").alias("cluster"), F.col("c.n").alias("n_properties"),
                       "overall_mean", "overall_std",
                       (F.coalesce(F.col("by_cluster")[F.col("c.cluster")], F.lit(0.0)) / F.col("c.n")).alias("cluster_mean"))
    rows = rows.withColumn("z", F.when(F.col("overall_std") > 0, F.round(
        (F.col("cluster_mean") - F.col("overall_mean")) / F.col("overall_std"), 6)))
    w = Window.partitionBy("cluster").orderBy(F.desc_nulls_last(F.abs("z")), "feature")
    return (rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1)
            .select("cluster", "feature", F.round("cluster_mean", 6).alias("cluster_mean"),
                    F.round("overall_mean", 6).alias("overall_mean"), F.round("overall_std", 6).alias("overall_std"),
                    "z", "n_properties"))


def cluster_labels_by_code(clusters: DataFrame) -> DataFrame:
    """(property_code, cluster) for joining labels into sales (J8); several
    rows of a code count as their largest label."""
    return clusters.groupBy("property_code").agg(F.max("cluster").alias("cluster"))
