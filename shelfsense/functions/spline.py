"""Cubic smoothing spline of one group's points, as array folds.

The natural cubic spline g that minimises sum (y - g)^2 + penalty * integral g''^2
has second derivatives c that solve (R + penalty Q'Q) c = Q'y, with R tridiagonal
and Q'Q pentadiagonal in the gaps of x, and g = y - penalty Q c.  One fold
eliminates forwards (L D L'), one substitutes backwards, so a solve is linear in
the points.  The residual sum of squares grows with the penalty; the penalty that
gives a wanted one is found by bisection on its logarithm.

Everything is a column expression over a sorted array of points, so no Python
worker runs.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bisection steps; the logarithm of the penalty starts between -LOGS and LOGS.
STEPS, LOGS = 42, 46.0


def _rows(points: Column) -> Column:
    """Per inner point what its equation needs: inverse gaps before, after and
    one further on (``p``, ``q``, ``r``), the gap terms of R (``d``, ``e``) and the
    right-hand side ``t``.  ``points``: (x, y), x ascending and distinct."""
    gap = lambda a, b: b["x"] - a["x"]
    slope = lambda a, b: (b["y"] - a["y"]) / (b["x"] - a["x"])

    def row(i):
        a, b, c, d = F.get(points, i - 1), F.get(points, i), F.get(points, i + 1), F.get(points, i + 2)
        further = F.when(d.isNotNull(), 1.0 / gap(c, d)).otherwise(F.lit(0.0))
        return F.struct((1.0 / gap(a, b)).alias("p"), (1.0 / gap(b, c)).alias("q"), further.alias("r"),
                        ((gap(a, b) + gap(b, c)) / 3.0).alias("d"), (gap(b, c) / 6.0).alias("e"), (slope(b, c) - slope(a, b)).alias("t"))

    return F.transform(F.sequence(F.lit(1), F.size(points) - 2), row)


def _eliminated(rows: Column, penalty: Column) -> Column:
    """The rows with their pivot ``D``, factors ``l`` and ``m`` and right side ``z``."""
    zero = F.lit(0.0)
    last = F.struct(*[zero.alias(n) for n in ("D", "l", "m", "z", "D2", "m2", "z2")],
                    F.array().cast("array<struct<p:double,q:double,r:double,D:double,l:double,m:double,z:double>>").alias("out"))

    def step(s, x):
        p, q, r = x["p"], x["q"], x["r"]
        d = x["d"] + penalty * (p * p + (p + q) * (p + q) + q * q)
        e = F.when(r > 0, x["e"] - penalty * q * (p + 2 * q + r)).otherwise(zero)
        f = penalty * q * r
        pivot = d - s["D"] * s["l"] * s["l"] - s["D2"] * s["m2"] * s["m2"]
        right = x["t"] - s["l"] * s["z"] - s["m2"] * s["z2"]
        made = F.struct(p.alias("p"), q.alias("q"), r.alias("r"), pivot.alias("D"), ((e - s["D"] * s["l"] * s["m"]) / pivot).alias("l"),
                        (f / pivot).alias("m"), right.alias("z"))
        return F.struct(made["D"].alias("D"), made["l"].alias("l"), made["m"].alias("m"), made["z"].alias("z"),
                        s["D"].alias("D2"), s["m"].alias("m2"), s["z"].alias("z2"), F.concat(s["out"], F.array(made)).alias("out"))

    return F.aggregate(rows, last, step, lambda s: s["out"])


def _bends(eliminated: Column) -> Column:
    """Q c, one number per point from the last to the first."""
    zero = F.lit(0.0)
    start = F.struct(zero.alias("c"), zero.alias("c2"), zero.alias("p"), zero.alias("q"), F.array().cast("array<double>").alias("out"))

    def step(s, x):
        c = x["z"] / x["D"] - x["l"] * s["c"] - x["m"] * s["c2"]
        # the point after x: its own column, x's and the one after
        bend = c * x["q"] - s["c"] * (x["q"] + x["r"]) + s["c2"] * x["r"]
        return F.struct(c.alias("c"), s["c"].alias("c2"), x["p"].alias("p"), x["q"].alias("q"), F.concat(s["out"], F.array(bend)).alias("out"))

    return F.aggregate(F.reverse(eliminated), start, step, lambda s: F.concat(
        s["out"], F.array(s["c2"] * s["q"] - s["c"] * (s["p"] + s["q"]), s["c"] * s["p"])))


def smoothing_spline(points: Column, residual: float) -> Column:
    """Values of the smoothing spline at the points of an array of (x, y) structs,
    x ascending and distinct, whose residual sum of squares is ``residual``; the
    points need at least three and a straight line must leave a larger one."""
    rows = _rows(points)
    off = lambda penalty: penalty * penalty * F.aggregate(
        _bends(_eliminated(rows, penalty)), F.lit(0.0), lambda s, b: s + b * b)

    def narrowed(s, _):
        middle = (s["lo"] + s["hi"]) / 2
        high = off(F.exp(middle)) > residual
        return F.struct(F.when(high, s["lo"]).otherwise(middle).alias("lo"), F.when(high, middle).otherwise(s["hi"]).alias("hi"))

    penalty = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), F.struct(F.lit(-LOGS).alias("lo"), F.lit(LOGS).alias("hi")),
                          narrowed, lambda s: F.exp(s["lo"]))
    # the penalty is put into an array of one, so that it is found once
    return F.element_at(F.transform(F.array(penalty), lambda w: F.zip_with(
        points, F.reverse(_bends(_eliminated(rows, w))), lambda pt, b: pt["y"] - w * b)), 1)
