"""Table replacement, rejected lines, increments, buckets, exact quantiles, Bloom
filters, shared caches and the binned kernel density."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfsense.functions.bloom import bloom_filter, might_hold
from shelfsense.functions.selection import exact_quantiles
from shelfsense.operators import pricing as P
from shelfsense.operators import recommend as R
from shelfsense.operators import sales as S
from shelfsense.plans import catalog as K
from shelfsense.plans.bucketed import open_bucketed, write_bucketed
from shelfsense.plans.materialize import Shared
from shelfsense.plans.rollups import LEVELS, Rollups
from shelfsense.sources import (read_pipe_text, read_table, recover_table, replace_partitions,
                                split_pipe_text, write_pipe_text, write_table)

D = "/root/testdata/sf0.001"


# ---------------------------------------------------------------- S5 and S6

def test_a_table_can_replace_itself(spark, tmp_path):
    path = str(tmp_path / "t")
    write_table(spark.range(10).withColumn("x", F.lit("a")), path)
    for n in (9, 8, 7):
        write_table(read_table(spark, path).where(F.col("id") < n), path)
        assert sorted(r.id for r in read_table(spark, path).collect()) == list(range(n))
    assert [p.name for p in tmp_path.iterdir()] == ["t"]


def test_a_failed_write_leaves_the_old_table(spark, tmp_path):
    path = str(tmp_path / "t")
    write_table(spark.range(5), path)
    broken = spark.range(100).withColumn("id", F.when(F.col("id") == 77, F.raise_error(F.lit("no"))).otherwise(F.col("id")))
    with pytest.raises(Exception):
        write_table(broken, path)
    assert read_table(spark, path).count() == 5 and [p.name for p in tmp_path.iterdir()] == ["t"]


def test_an_interrupted_swap_is_mended(spark, tmp_path):
    path = tmp_path / "t"
    write_table(spark.range(5), str(path))
    path.rename(tmp_path / "t__aside-1")  # between the two renames
    (tmp_path / "t__staged-2").mkdir()
    recover_table(spark, str(path))
    assert read_table(spark, str(path)).count() == 5 and [p.name for p in tmp_path.iterdir()] == ["t"]


def test_only_the_month_is_replaced(spark, tmp_path):
    path = str(tmp_path / "t")
    write_table(spark.range(30).selectExpr("id", "concat('m', id % 3) AS month"), path, partition_by=["month"])
    before = {p.name: {f.name for f in p.iterdir()} for p in (tmp_path / "t").iterdir() if p.is_dir()}
    replace_partitions(read_table(spark, path).where("month = 'm1'").withColumn("id", F.col("id") + 100), path, ["month"])
    after = {p.name: {f.name for f in p.iterdir()} for p in (tmp_path / "t").iterdir() if p.is_dir()}
    assert {k for k in before if before[k] != after[k]} == {"month=m1"}
    ids = sorted(r.id for r in read_table(spark, path).collect())
    assert ids == sorted([i for i in range(30) if i % 3 != 1] + [i + 100 for i in range(30) if i % 3 == 1])


def test_a_catalog_table_can_replace_itself(spark, tmp_path):
    options = {"path": str(tmp_path / "cat")}
    write_table(spark.range(6), "replaced_by_itself", fmt="table", options=options)
    write_table(read_table(spark, "replaced_by_itself", fmt="table").where("id < 4"), "replaced_by_itself", fmt="table", options=options)
    assert read_table(spark, "replaced_by_itself", fmt="table").count() == 4
    spark.sql("DROP TABLE replaced_by_itself")


def test_rejected_lines_are_set_aside(spark, tmp_path):
    schema = "name string, units int, price double, __line string"
    df = spark.createDataFrame([("a|b", 3, 1.5, None), ("é \"q\"", None, 2.0, "x"), (None, 4, None, "y")], schema)
    path = str(tmp_path / "pipe")
    write_pipe_text(df, path)
    (tmp_path / "pipe" / "more.csv").write_text("ok|5|2.5|z\nfew|1\nmany|1|2.0|z|z\nword|five|2.0|z\n\nlast|6|x1|z\n")
    rows, bad = split_pipe_text(spark, path, df.schema)
    assert rows.schema == df.schema
    good = sorted(map(tuple, rows.collect()), key=repr)
    assert good == sorted([*map(tuple, df.collect()), ("ok", 5, 2.5, "z")], key=repr)
    assert sorted(map(tuple, bad.collect())) == [("few|1", "number of fields"), ("last|6|x1|z", "value"),
                                                  ("many|1|2.0|z|z", "number of fields"), ("word|five|2.0|z", "value")]
    with pytest.raises(Exception):
        read_pipe_text(spark, path, df.schema).collect()


# --------------------------------------------------------------- increments

def _state(rollups):
    return {level: sorted(map(tuple, rollups.read(level).collect()), key=repr) for level in LEVELS}


def _rebuilt(sales):
    base = S.sales_base(sales)
    found = {"base": base, "cluster": S.cluster_product_sales(base), "national": S.national_product_sales(base)}
    return {k: sorted(map(tuple, df.select(*LEVELS[k][0], LEVELS[k][1]).collect()), key=repr) for k, df in found.items()}


@pytest.fixture
def odd_sales(make_sales):
    rng = random.Random(2)
    rows = [(rng.choice(["S", "T", None]), rng.choice([0, 1, None]), rng.choice(["A", "B", None]), rng.choice("abcd"),
             rng.choice(["2019-01", "2019-02", "2019-03", None]), rng.choice([None, -1, 0, 1, 2, 5])) for _ in range(400)]
    return make_sales(rows)


def test_increments_equal_a_rebuild(spark, odd_sales, tmp_path):
    rollups = Rollups(spark, str(tmp_path))
    part = F.pmod(F.xxhash64(*odd_sales.columns, F.rand(1)), F.lit(3))
    sales = odd_sales.withColumn("part", part).persist()
    for i in range(3):
        assert rollups.update(sales.where(F.col("part") == i).drop("part"), f"b{i}")
    assert _state(rollups) == _rebuilt(sales.drop("part"))
    assert not rollups.update(sales.drop("part"), "b1") and rollups.applied() == ["b0", "b1", "b2"]
    assert _state(rollups) == _rebuilt(sales.drop("part"))
    sales.unpersist()


def test_an_increment_touches_its_periods_only(spark, odd_sales, tmp_path):
    rollups = Rollups(spark, str(tmp_path))
    rollups.update(odd_sales, "first")
    files = lambda: {str(p) for level in LEVELS for p in (tmp_path / level).rglob("*.parquet")}
    before = files()
    rollups.update(odd_sales.where("transaction_month = '2019-02'"), "second")
    assert all("2019-02" in p for p in before ^ files())


@pytest.mark.parametrize("moved", [0, 1, 3])
def test_a_committed_update_is_finished(spark, odd_sales, tmp_path, monkeypatch, moved):
    rollups = Rollups(spark, str(tmp_path))
    rollups.update(odd_sales, "first")
    with monkeypatch.context() as m:
        def stop(self, batch):
            real = self._fs

            class Failing:
                left = moved

                def __getattr__(self, name):
                    return getattr(real, name)

                def rename(self, *args):
                    if Failing.left == 0:
                        raise OSError("lost")
                    Failing.left -= 1
                    return real.rename(*args)

            self._fs = Failing()
            finish(self, batch)

        finish = Rollups._finish
        m.setattr(Rollups, "_finish", stop)
        with pytest.raises(OSError):
            rollups.update(odd_sales, "second")
    after = Rollups(spark, str(tmp_path))
    after.recover()
    assert _state(after) == _rebuilt(odd_sales.unionByName(odd_sales)) and after.applied() == ["first", "second"]


def test_an_uncommitted_update_leaves_no_trace(spark, odd_sales, tmp_path):
    rollups = Rollups(spark, str(tmp_path))
    rollups.update(odd_sales, "first")
    broken = odd_sales.withColumn("number_sold", F.when(F.col("description") == "a", F.raise_error(F.lit("no"))).otherwise(F.col("number_sold")))
    with pytest.raises(Exception):
        rollups.update(broken, "second")
    assert _state(rollups) == _rebuilt(odd_sales)
    assert rollups.update(odd_sales, "second")


# ------------------------------------------------------------------ buckets

def test_rankings_from_buckets_need_no_exchange(spark):
    df = K.QUERIES["store_ranking_bucketed"](spark, D)
    got = sorted(map(tuple, df.collect()), key=repr)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Bucketed: true" in plan
    assert got == sorted(map(tuple, K.QUERIES["store_ranking"](spark, D).select(*df.columns).collect()), key=repr)


def test_a_property_read_opens_one_bucket(spark, tmp_path):
    base = S.sales_base(K.sales_of(spark, D))
    path = str(tmp_path / "b")
    stored = write_bucketed(base, "bucketed_reads", path, 8)
    one = stored.where("property_code = 'Supplier#000000001'")
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")  # so that the plan names the buckets
    try:
        plan = stored.where("property_code = 'Supplier#000000001'")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    assert "SelectedBucketsCount: 1 out of 8" in plan
    want = base.where("property_code = 'Supplier#000000001'").count()
    assert one.count() == want
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stored.schema.fields)
    spark.sql("DROP TABLE bucketed_reads")
    again = open_bucketed(spark, "bucketed_reads", path, ddl, 8)
    assert again.count() == base.count() and again.where("property_code = 'Supplier#000000001'").count() == want
    spark.sql("DROP TABLE bucketed_reads")


# ---------------------------------------------------------------- quantiles

def test_quantiles_equal_percentile(spark):
    rng = random.Random(7)
    rows = []
    for g, draw in enumerate([lambda: rng.gauss(0, 1), lambda: float(rng.randint(0, 3)), lambda: 5.0,
                              lambda: math.exp(rng.uniform(-300, 300)) * rng.choice([-1, 1]), lambda: rng.uniform(0, 1) ** 9]):
        rows += [(f"g{g}", g % 2, draw()) for _ in range(rng.choice([1, 2, 7, 900]))]
    rows += [(None, 1, float(i)) for i in range(10)] + [("g0", None, 3.0), ("nulls", 1, None)]
    rows += [("half", 0, rng.choice([rng.gauss(0, 1e-6), 1e6, 0.1 + rng.randint(0, 20)])) for _ in range(len(rows))]
    df = spark.createDataFrame(rows, "g string, h int, v double")
    probs = (0.0, 0.25, 0.5, 0.731, 1.0)
    for passes in (1, 2):
        got = {(r.g, r.h): (r.n, r.quantiles) for r in exact_quantiles(df, ["g", "h"], "v", probs, passes).collect()}
        want = {(r.g, r.h): (r.n, r.q) for r in df.where("v is not null").groupBy("g", "h").agg(
            F.count("*").alias("n"), F.percentile("v", F.array(*map(F.lit, probs))).alias("q")).collect()}
        assert set(got) == set(want)
        for k, (n, q) in want.items():
            assert got[k][0] == n and all(math.isclose(a, b, rel_tol=1e-12, abs_tol=1e-300) for a, b in zip(got[k][1], q)), k
    assert exact_quantiles(df.limit(0), ["g"], "v", probs).count() == 0
    with pytest.raises(Exception):
        exact_quantiles(spark.createDataFrame([("a", float("nan"))], "g string, v double"), ["g"], "v", [0.5]).collect()


def test_a_heavy_group_is_counted_in_many_tasks(spark):
    df = spark.range(0, 200_000, 1, 8).selectExpr("if(id % 2 = 0, 'heavy', concat('g', id % 1000)) AS g", "cast(id * 7919 % 200003 AS double) AS v")
    out = exact_quantiles(df, ["g"], "v", [0.5])
    got = {r.g: r.quantiles[0] for r in out.collect()}
    assert got["heavy"] == df.where("g = 'heavy'").agg(F.percentile("v", 0.5)).first()[0]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan and "percentile" not in plan and "_salt" in plan


# ------------------------------------------------------------ Bloom filters

def test_bloom_filters_have_no_false_negatives(spark):
    df = spark.range(4000).selectExpr("concat('c', id) AS a", "if(id % 9 = 0, null, id) AS b")
    words = bloom_filter(df, ["a", "b"]).first().words
    assert len(words) == 4096
    held = F.array(*map(F.lit, words))
    assert df.where(~might_hold(held, ["a", "b"])).count() == 0
    others = spark.range(100_000, 104_000).selectExpr("concat('c', id) AS a", "id AS b")
    assert others.where(might_hold(held, ["a", "b"])).count() < 40


def test_a_few_requests_read_few_rows(spark):
    sales = K.sales_of(spark, D, "month")
    few = sales.where("transaction_month = '1998-06'").select(*S.STORE).distinct().orderBy(*S.STORE).limit(3)
    few = spark.createDataFrame(few.collect(), few.schema)
    base = S.sales_base(sales)
    needed = R.needed_rows(base, few)
    assert 0 < needed.count() < 0.05 * base.count()
    plan = needed._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate") < plan.index("getbit")  # the filter is below the base aggregate
    descriptions = K.descriptions_of(spark, D)
    rows = lambda b: sorted(map(tuple, R.recommendation_report(b, descriptions, 5, 0.1, few).collect()))
    assert rows(needed) == rows(base)


# ------------------------------------------------------------ shared caches

def test_owners_of_one_base_are_counted(spark):
    base = lambda: K.base_of(spark, D)
    first, second = Shared(), Shared()
    a, b = first.keep(base()), second.keep(base())
    first.close()
    assert b.is_cached and "InMemoryRelation" in base()._jdf.queryExecution().withCachedData().toString()
    assert not a.is_cached
    second.close()
    assert "InMemoryRelation" not in base()._jdf.queryExecution().withCachedData().toString()


# ------------------------------------------------------------------ density

def test_binned_density_is_near_the_exact_one(spark):
    rng = np.random.default_rng(4)
    rows = [(p, float(v), 1.0, 1.0) for p, draw in (("even", rng.uniform(1, 9, 900)), ("few", rng.uniform(1, 9, 12)),
                                                    ("two", np.concatenate([rng.normal(2, .1, 200), rng.normal(8, 1, 300)])))
            for v in draw]
    pts = spark.createDataFrame(rows, "description string, unit_price double, number_sold double, revenue double")
    exact = {(r.description, r.i): r for r in P.price_kde(pts).collect()}
    peak = {d: max(r.density for (p, _), r in exact.items() if p == d) for d in ("even", "few", "two")}
    binned = P.price_kde(pts, method="binned").collect()
    assert len(binned) == len(exact) == 300
    for r in binned:
        e = exact[r.description, r.i]
        assert abs(r.x - e.x) < 1e-9 and abs(r.density - e.density) <= 1e-3 * peak[r.description]
    with pytest.raises(ValueError):
        P.price_kde(pts, method="guess")


# ------------------------------------------------------------------- spline

def _dense_spline(x, y, residual):
    """The smoothing spline by dense solves and bisection on the penalty."""
    n, h = len(x), np.diff(x)
    r, q = np.zeros((n - 2, n - 2)), np.zeros((n, n - 2))
    for j in range(1, n - 1):
        r[j - 1, j - 1] = (h[j - 1] + h[j]) / 3
        if j < n - 2:
            r[j - 1, j] = r[j, j - 1] = h[j] / 6
        q[j - 1, j - 1], q[j, j - 1], q[j + 1, j - 1] = 1 / h[j - 1], -1 / h[j - 1] - 1 / h[j], 1 / h[j]

    def fit(w):
        return y - w * q @ np.linalg.solve(r + w * q.T @ q, q.T @ y)

    lo, hi = -46.0, 46.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if ((y - fit(np.exp(mid))) ** 2).sum() > residual else (mid, hi)
    return fit(np.exp(lo))


def test_smooth_curve_by_dense_solves(spark):
    rng = np.random.default_rng(9)
    rows, want = [], {}
    for p, n in (("a", 4), ("b", 5), ("c", 40), ("d", 150), ("mild", 30), ("few", 3)):
        x = np.sort(rng.choice(np.arange(100, 4000), n, replace=False)) / 100
        scale = 1.0 if p == "mild" else 60.0
        y = scale * (np.sin(x) + rng.normal(0, .4, n)) + 3 * x
        rows += [(p, float(a), float(b), float(a * b)) for a, b in zip(x, y)]
        want[p] = (x, y)
    pts = spark.createDataFrame(rows, "description string, unit_price double, number_sold double, revenue double")
    got = {}
    for r in P.price_smooth_curve(pts, smoothing=500.0).collect():
        got.setdefault(r.description, []).append(r)
    kinds = {}
    for p, (x, y) in want.items():
        own = sorted(got[p], key=lambda r: r.unit_price)
        for tag, values in (("units", y), ("revenue", x * y)):
            fit = [r[f"fit_{tag}"] for r in own]
            kinds[p, tag] = own[0][f"{tag}_by"]
            if len(x) < 4:
                assert fit == [None] * len(x) and kinds[p, tag] is None
                continue
            cubic = np.polyval(np.polyfit(x - x.mean(), values, 3), x - x.mean())
            beyond = ((values - cubic) ** 2).sum() > 500
            assert kinds[p, tag] == ("spline" if beyond else "cubic")
            assert np.allclose(fit, _dense_spline(x, values, 500.0) if beyond else cubic, atol=2e-3, rtol=1e-6), (p, tag)
            if beyond:
                assert abs(((values - np.array(fit)) ** 2).sum() - 500) < 0.5
    assert set(kinds.values()) == {None, "cubic", "spline"}


def test_smooth_curve_has_no_gaps(spark):
    df = K.QUERIES["price_smooth_curve"](spark, D)
    rows = df.collect()
    assert rows and all((r.fit_units is None) == (r.units_by is None) for r in rows)
    cubic = {(r.description, r.unit_price): r for r in P.price_curve(K.points_of(spark, D)).collect()}
    for r in rows:
        if r.units_by == "cubic":
            assert r.fit_units == cubic[r.description, r.unit_price].fit_units
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "MapIn" not in plan and "FlatMapGroups" not in plan


def test_schemas_follow_the_table(spark, tmp_path):
    from shelfsense.sources.tables import read_parquet
    path = str(tmp_path / "t")
    write_table(spark.range(3), path)
    assert read_parquet(spark, path).columns == ["id"] and read_parquet(spark, path).count() == 3
    write_table(spark.range(5).selectExpr("id AS other", "1 AS more"), path)
    assert read_parquet(spark, path).columns == ["other", "more"] and read_parquet(spark, path).count() == 5
