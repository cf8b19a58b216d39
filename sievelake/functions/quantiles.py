"""Exact quantiles by narrowing: approximate brackets first, then counts of the few values between them.

No task and no driver ever holds the distinct values of a column; what is collected has a fixed bound.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Values that may lie in a bracket when they are counted one by one, and the accuracy of the approximate ranks.
FEW, ACCURACY = 20_000, 10_000  # FEW is the greater, so that brackets of the first pass are some rows wide
#: Fractions at which a bracket that is still too wide is looked at again.
GRID = 256


def exact_quantiles(values: DataFrame, fractions: Sequence[float]) -> dict[object, tuple[int, list[float]]]:
    """By k, the number of values and the quantiles of values (k, x DOUBLE), with linear interpolation; NULLs don't count.

    Two passes find a bracket around each rank and count what is in it; with more than 50 million values by k, one more
    pass narrows by a factor of about 100. Every aggregate combines map-side. k must have few distinct values.
    """
    v = values.where("k is not null and x is not null").select("k", "x")
    delta = 2 / ACCURACY
    marks = sorted({min(max(q + s * delta, 0.0), 1.0) for q in fractions for s in (-1, 1)})
    first = v.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("x", marks, ACCURACY).alias("at")).collect()
    total = {r["k"]: r["n"] for r in first}
    want: dict[tuple[object, int], tuple[float, float]] = {}  # the bracket of each quantile
    for r in first:
        at = dict(zip(marks, r["at"]))
        for i, q in enumerate(fractions):
            low, high = q - delta, q + delta
            few = r["n"] <= FEW
            want[r["k"], i] = (-math.inf if few or low <= 0 else at[min(marks, key=lambda m: abs(m - low))], math.inf if few or high >= 1 else at[min(marks, key=lambda m: abs(m - high))])
    while True:
        counts = {}
        if max(total.values(), default=0) * 4 > FEW * ACCURACY:
            seen = _inside(v, want).groupBy("k", "i").agg(F.count_if(F.col("x") < F.col("a")).alias("below"), F.count_if(F.col("x") >= F.col("a")).alias("m"), F.percentile_approx(F.when(F.col("x") >= F.col("a"), F.col("x")), [g / GRID for g in range(GRID + 1)], ACCURACY).alias("grid"))
            counts = {(r["k"], r["i"]): r for r in seen.collect()}
        narrower = {}
        for key, r in counts.items():
            if r["m"] <= FEW or want[key][0] == want[key][1]:
                continue
            at = (fractions[key[1]] * (total[key[0]] - 1) - r["below"]) / r["m"] * GRID
            slip = 1 + math.ceil(2 * GRID / ACCURACY) + math.ceil(2 * GRID / r["m"])  # a step, what a rank may be off, two rows
            i, j = math.floor(at) - slip, math.ceil(at) + slip
            a, b = want[key]
            narrower[key] = (max(a, r["grid"][i]) if i > 0 else a, min(b, r["grid"][j]) if j < GRID else b)
        if all(want[key] == bracket for key, bracket in narrower.items()):
            break
        want |= narrower
    rows = _inside(v, want).groupBy("k", "i", F.when(F.col("x") >= F.col("a"), F.col("x")).alias("x")).count().collect()
    found: dict[tuple[object, int], list[tuple[float | None, int]]] = {}
    for r in rows:
        found.setdefault((r["k"], r["i"]), []).append((r["x"], r["count"]))
    out: dict[object, tuple[int, list[float]]] = {}
    for k, n in total.items():
        qs = []
        for i, q in enumerate(fractions):
            here = sorted(found[k, i], key=lambda t: (t[0] is not None, t[0] or 0.0))  # NULL stands for all below
            place = q * (n - 1)
            low, high = _at(here, math.floor(place)), _at(here, math.ceil(place))
            qs.append(low if low == high else (math.ceil(place) - place) * low + (place - math.floor(place)) * high)
        out[k] = (n, qs)
    return out


def _inside(v: DataFrame, want: dict[tuple[object, int], tuple[float, float]]) -> DataFrame:
    """Rows up to the upper end of each bracket, with its number i and lower end a. The brackets are few and broadcast."""
    kind = v.schema["k"].dataType.simpleString()
    b = v.sparkSession.createDataFrame([(k, i, float(a), float(z)) for (k, i), (a, z) in want.items()], f"b {kind}, i int, a double, z double")
    return v.join(F.broadcast(b), F.col("k") == F.col("b")).where(F.col("x") <= F.col("z"))


def _at(counts: list[tuple[float | None, int]], place: int) -> float:
    for x, n in counts:
        if place < n:
            return x
        place -= n
    raise AssertionError("a quantile's bracket misses its rank")
