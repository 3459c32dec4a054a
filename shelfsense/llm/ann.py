"""Approximate nearest neighbours by NN-descent and graph search (operator 5).

1. Vectors that are equal become one node; only the smallest ids of a node can
   ever be among the nearest k, so those are its members.
2. A first neighbour graph joins nodes that fall into the same cell of random
   hyperplanes, in several independent partitions.
3. NN-descent: the neighbours of a node, in both directions, are compared with
   each other (a join of the graph with itself at the node in the middle); each
   keeps its best ``degree``.  Only pairs with a new edge are compared again.
   Vectors travel as one byte a component in this step.
4. Queries start at their own node's neighbours; each round expands the best
   nodes not yet expanded and scores the neighbours found, in double precision
   of the original vectors at the end.

Every row is indexed.  A round's comparisons are matrix products inside tasks
over groups of bounded size (``sample`` members, ``cell`` nodes); pairs never
leave a task but for those that may enter a neighbour list.

Defined cases: vectors that are null, empty, zero, of another dimension than
most, or that hold null or non-finite components take no part, neither do rows
without an id; fewer than k candidates give fewer rows; ties go to the smaller
id; repeated rows of one id count once; extra columns are not read; an empty
table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfsense.llm._common import Scratch, buckets_for

DEGREE, SAMPLE, ROUNDS = 24, 48, 4
TREES, CELL = 4, 1024
BEAM, SEARCHES = 256, 3


def usable(rows: DataFrame, id: str, vector: str) -> DataFrame:
    """(vec_id, v: array<double>) of the vectors that take part."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    good = rows.select(F.col(id).cast("long").alias("vec_id"), v.alias("v")).where(
        "vec_id is not null and v is not null and size(v) > 0 and "
        "forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)")
    size = (good.groupBy(F.size("v").alias("size")).agg(F.count("*").alias("n"))
            .orderBy(F.desc("n"), "size").limit(1).collect())
    return good.where(F.size("v") == (size[0]["size"] if size else 0))


def top(df: DataFrame, by: list[str], order: list, n: int) -> DataFrame:
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(f"__r <= {n}").drop("__r")


def _groups(batches, n_keys: int):
    """(key, rows) of consecutive rows with equal first columns."""
    key, rows = None, []
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        for row in zip(*columns):
            if row[:n_keys] != key:
                if rows:
                    yield key, rows
                key, rows = row[:n_keys], []
            rows.append(row[n_keys:])
    if rows:
        yield key, rows


def _edges(parts):
    """Record batches of (u, v, sim) lists, a few hundred thousand rows each."""
    held, size = [], 0

    def batch():
        u, v, s = (np.concatenate([h[i] for h in held]) for i in range(3))
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()),
                                           pa.array(s.astype(np.float32), pa.float32())], ["u", "v", "sim"])

    for part in parts:
        held.append(part)
        size += len(part[0])
        if size >= 200_000:
            yield batch()
            held, size = [], 0
    if size:
        yield batch()


def _best_pairs(rows, columns, sims, allowed, n):
    """(row id, column id, similarity) of the n best allowed entries a row."""
    sims = np.where(allowed, sims, -2)
    n = min(n, sims.shape[1])
    best = np.argpartition(-sims, n - 1, axis=1)[:, :n]
    values = np.take_along_axis(sims, best, 1)
    row, at = np.nonzero(values > -2)
    return rows[row], columns[best[row, at]], values[row, at]


def start_graph(nodes: DataFrame, n: int, dimension: int, degree: int, seed: int = 3) -> DataFrame:
    """(u, v, sim): best neighbours inside random cells of about CELL nodes."""
    bits = max(0, int(np.ceil(np.log2(max(n / CELL, 1)))))
    planes = np.random.default_rng(seed).standard_normal((TREES, bits, dimension)).astype(np.float32)
    # cells are cut at the planes' medians over a sample of at most 4,096 nodes
    share = min(1.0, 4096 / max(n, 1))
    sample = nodes.where(F.pmod(F.xxhash64("node", F.lit(1)), F.lit(1_000_000)) < int(share * 1_000_000)).select("unit")
    points = np.array([np.frombuffer(r.unit, np.float32) for r in sample.collect()]).reshape(-1, dimension)
    cuts = np.zeros((TREES, bits), np.float32)
    if len(points) and bits:
        cuts = np.median(np.einsum("tbd,nd->tbn", planes, points), axis=2).astype(np.float32)

    def assign(batches):
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.float32).reshape(-1, dimension)
            ids = batch.column(0)
            for t in range(TREES):
                code = np.zeros(len(x), np.int64)
                for b in range(bits):
                    code = code * 2 + (x @ planes[t, b] > cuts[t, b])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(x), t), pa.int32()), pa.array(code), ids, batch.column(1)],
                    ["tree", "cell", "node", "unit"])

    dealt = nodes.select("node", "unit").mapInArrow(assign, "tree int, cell long, node long, unit binary")
    # a crowded cell is split by a hash of the id
    sizes = dealt.groupBy("tree", "cell").agg(F.ceil(F.count("*") / (2 * CELL)).alias("splits"))
    dealt = (dealt.join(sizes, ["tree", "cell"])
             .withColumn("part", F.pmod(F.xxhash64("node", "tree"), F.col("splits")))
             .select("tree", "cell", "part", "node", "unit"))

    def compare(batches):
        def each():
            for _, rows in _groups(batches, 3):
                ids = np.array([r[0] for r in rows], np.int64)
                x = np.frombuffer(b"".join(r[1] for r in rows), np.float32).reshape(len(rows), -1)
                for at in range(0, len(ids), 1024):
                    s = x[at:at + 1024] @ x.T
                    other = np.arange(at, at + len(s))[:, None] != np.arange(len(ids))[None, :]
                    yield _best_pairs(ids[at:at + 1024], ids, s, other, degree)
        yield from _edges(each())

    return (dealt.repartition("tree", "cell", "part").sortWithinPartitions("tree", "cell", "part", "node")
            .mapInArrow(compare, "u long, v long, sim float"))


def keep_best(edges: DataFrame, degree: int) -> DataFrame:
    """(u, v, sim, fresh): the best ``degree`` edges of every u; an edge is
    fresh unless it was there before."""
    one = edges.groupBy("u", "v").agg(F.max("sim").alias("sim"), F.min("fresh").alias("fresh"))
    return top(one, ["u"], [F.desc("sim"), F.asc("v")], degree)


def descend(graph: DataFrame, nodes: DataFrame, degree: int, salt: int) -> DataFrame:
    """One round of NN-descent: candidate edges (u, v, sim, fresh) found among
    the neighbours of each node."""
    ends = graph.select(F.col("u").alias("middle"), F.col("v").alias("node"), "fresh").unionByName(
        graph.select(F.col("v").alias("middle"), F.col("u").alias("node"), "fresh"))
    ends = ends.groupBy("middle", "node").agg(F.max("fresh").alias("fresh"))
    ends = top(ends, ["middle"], [F.desc("fresh"), F.xxhash64("middle", "node", F.lit(salt))], SAMPLE)
    worst = graph.groupBy("u").agg(F.when(F.count("*") >= degree, F.min("sim")).otherwise(-1.0).cast("float").alias("worst"))
    known = nodes.select("node", "small").join(worst.withColumnRenamed("u", "node"), "node", "left")
    met = ends.join(known, "node").select("middle", "node", "fresh", F.coalesce("worst", F.lit(-1.0)).alias("worst"), "small")

    def compare(batches):
        def each():
            for _, rows in _groups(batches, 1):
                fresh = np.array([r[1] for r in rows], bool)
                if len(rows) < 2 or not fresh.any():
                    continue
                ids = np.array([r[0] for r in rows], np.int64)
                worst = np.array([r[2] for r in rows], np.float32)
                x = np.frombuffer(b"".join(r[3] for r in rows), np.int8).reshape(len(rows), -1).astype(np.float32)
                x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
                s = x @ x.T
                wanted = (fresh[:, None] | fresh[None, :]) & ~np.eye(len(ids), dtype=bool) & (s > worst[:, None])
                yield _best_pairs(ids, ids, s, wanted, 12)
        yield from _edges(each())

    found = (met.repartition("middle").sortWithinPartitions("middle", "node")
             .mapInArrow(compare, "u long, v long, sim float"))
    both = found.unionByName(found.select(F.col("v").alias("u"), F.col("u").alias("v"), "sim"))
    return both.withColumn("fresh", F.lit(True))


def build_graph(nodes: DataFrame, n: int, dimension: int, scratch: Scratch) -> DataFrame:
    """(u, v, sim) neighbour graph of all nodes."""
    graph = scratch.save(keep_best(start_graph(nodes, n, dimension, DEGREE // 2).withColumn("fresh", F.lit(True)), DEGREE), "graph-0")
    for i in range(1, ROUNDS + 1):
        more = descend(graph, nodes, DEGREE, i)
        following = keep_best(graph.withColumn("fresh", F.lit(False)).unionByName(more), DEGREE)
        graph = scratch.save(following, f"graph-{i}")
        scratch.drop(f"graph-{i - 1}")
    return graph


def score(pairs: DataFrame, nodes: DataFrame, queries: DataFrame, parts: int) -> DataFrame:
    """(query, node, sim) of (query, node) pairs that may enter a beam.  Nodes
    are dealt over parts by a hash; a query's vector goes once to each part
    where it has candidates.  Of a query's best BEAM a part holds about
    BEAM / parts; each part returns that many and four standard deviations more."""
    share = BEAM / parts
    most = min(BEAM, int(np.ceil(share + 4 * np.sqrt(share) + 8)))
    part = F.pmod(F.xxhash64("node"), F.lit(parts)).alias("part")
    asked = (pairs.select("query", "node", part).groupBy("part", "query").agg(F.collect_set("node").alias("nodes"))
             .join(queries.select("query", "unit"), "query")
             .select("part", F.lit(1).alias("kind"), F.col("query").alias("id"), "unit", "nodes"))
    held = nodes.select(part, F.lit(0).alias("kind"), F.col("node").alias("id"), "unit",
                        F.lit(None).cast("array<long>").alias("nodes"))

    def run(batches):
        def each():
            now, ids, units, index, x = None, [], [], None, None
            for batch in batches:
                parts_, kinds, keys, vectors, lists = (batch.column(i) for i in range(5))
                for p, kind, key, unit, wanted in zip(parts_.to_pylist(), kinds.to_pylist(), keys.to_pylist(),
                                                      vectors.to_pylist(), lists):
                    if p != now:
                        now, ids, units, index = p, [], [], None
                    if kind == 0:
                        ids.append(key)
                        units.append(unit)
                        continue
                    if index is None:  # nodes come before queries, by id
                        index = np.array(ids, np.int64)
                        x = np.frombuffer(b"".join(units), np.float32).reshape(len(ids), -1)
                        ids, units = [], []
                    want = wanted.values.to_numpy(zero_copy_only=False)
                    s = x[np.searchsorted(index, want)] @ np.frombuffer(unit, np.float32)
                    if len(s) > most:
                        best = np.argpartition(-s, most)[:most]
                        want, s = want[best], s[best]
                    yield np.full(len(want), key, np.int64), want, s
        yield from _edges(each())

    return (held.unionByName(asked).repartition("part").sortWithinPartitions("part", "kind", "id")
            .mapInArrow(run, "u long, v long, sim float")
            .select(F.col("u").alias("query"), F.col("v").alias("node"), "sim"))


def search(graph: DataFrame, nodes: DataFrame, queries: DataFrame, n: int, scratch: Scratch) -> DataFrame:
    """(query, node, sim): the beam of every query (query: a node of the graph)
    after SEARCHES rounds; the node itself is in it."""
    ways = scratch.save(graph.select(F.col("u").alias("at"), F.col("v").alias("node")).unionByName(
        graph.select(F.col("v").alias("at"), F.col("u").alias("node"))).distinct(), "ways")
    parts = buckets_for(n, 8192)
    beam = queries.select("query", F.col("query").alias("node"), F.lit(1.0).cast("float").alias("sim"), F.lit(False).alias("done"))
    for i in range(SEARCHES + 1):
        reached = beam.where("not done").select("query", F.col("node").alias("at")).join(ways, "at").select("query", "node")
        found = score(reached, nodes, queries, parts).withColumn("done", F.lit(False))
        merged = beam.withColumn("done", F.lit(True)).unionByName(found).groupBy("query", "node").agg(
            F.max("sim").alias("sim"), F.max("done").alias("done"))
        beam = scratch.save(top(merged, ["query"], [F.desc("sim"), F.asc("node")], BEAM), f"beam-{i}")
        if i:
            scratch.drop(f"beam-{i - 1}")
    return beam.drop("done")


def nearest(rows: DataFrame, scratch: Scratch, k: int = 5, every: int = 50, id: str = "vec_id",
            vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest by cosine of every row whose
    id is divisible by ``every``, among all other rows."""
    good = scratch.save(usable(rows, id, vector).dropDuplicates(["vec_id"]), "vectors")
    keyed = good.withColumn("key", F.sha2(F.concat_ws(",", F.transform("v", lambda x: x.cast("string"))), 256))
    firsts = keyed.select("key", "vec_id").groupBy("key").agg(F.min("vec_id").alias("node"))
    # of equal vectors only the k + 1 smallest ids can be among the k nearest
    members = scratch.save(top(keyed.select("key", "vec_id"), ["key"], ["vec_id"], k + 1)
                           .join(firsts, "key").select("node", "vec_id"), "members")

    def prepare(batches):
        for batch in batches:
            x = [np.asarray(v, np.float64) for v in batch.column(1).to_pylist()]
            unit = [(v / np.abs(v).max() / np.linalg.norm(v / np.abs(v).max())).astype(np.float32) for v in x]
            small = [np.rint(u / max(np.abs(u).max(), 1e-30) * 127).astype(np.int8).tobytes() for u in unit]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([u.tobytes() for u in unit], pa.binary()),
                                              pa.array(small, pa.binary())], ["node", "unit", "small"])

    nodes = scratch.save(good.join(firsts.select(F.col("node").alias("vec_id")), "vec_id").select("vec_id", "v")
                         .mapInArrow(prepare, "node long, unit binary, small binary"), "nodes")
    n = nodes.count()
    shape = good.select(F.size("v").alias("d")).first()
    graph = build_graph(nodes, n, shape.d if shape else 1, scratch)
    # every query row, also beyond the members of its node
    asked = keyed.where(F.pmod("vec_id", F.lit(every)) == 0).join(firsts, "key").select(F.col("vec_id").alias("query_id"), "node")
    queries = asked.select(F.col("node").alias("query")).distinct().join(
        nodes.select(F.col("node").alias("query"), "unit"), "query")
    queries = scratch.save(queries, "queries")
    beam = top(search(graph, nodes, queries, n, scratch), ["query"], [F.desc("sim"), F.asc("node")], 4 * (k + 1))

    values = good.select(F.col("vec_id").alias("node"), F.col("v").alias("b"))
    pairs = (beam.select("query", "node").join(values, "node")
             .join(good.select(F.col("vec_id").alias("query"), F.col("v").alias("a")), "query"))
    dot = "aggregate(zip_with({0}, {1}, (x, y) -> x * y), 0D, (s, x) -> s + x)"
    exact = F.expr(f"{dot.format('a', 'b')} / (sqrt({dot.format('a', 'a')}) * sqrt({dot.format('b', 'b')}))")
    found = (pairs.select("query", "node", exact.alias("score")).join(members, "node")
             .join(asked.select("query_id", F.col("node").alias("query")), "query").where("vec_id <> query_id"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id")))
    return found.select("query_id", rank.alias("rank"), "vec_id", "score").where(f"rank <= {k}")
