"""A3 as mergeable state: counts, means and centred sums of products per key.

A moment row describes a set of training rows: ``n``, means ``m0..m3, my``, and sums of
centred products ``s{i}{j}`` (of two slots) and ``t{i}`` (of a slot and the target).  The
rows of two disjoint sets merge into those of their union, and a subset's can be taken
out again, by the pairwise centred update: no sum of raw squares is ever formed, so
nothing cancels that a fresh fit would keep.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config
from . import ols

P = config.N_SLOTS
MEANS = tuple(f"m{i}" for i in range(P)) + ("my",)
PAIRS = tuple((i, j) for i in range(P) for j in range(i, P))
SUMS = tuple(f"s{i}{j}" for i, j in PAIRS) + tuple(f"t{i}" for i in range(P))
COLUMNS = ("n",) + MEANS + SUMS


def _factors(name: str) -> tuple[str, str]:
    """The two means whose deviations a centred sum multiplies."""
    return (f"m{name[1]}", f"m{name[2]}") if name.startswith("s") else (f"m{name[1]}", "my")


def of_rows(rows: DataFrame, keys=ols.KEYS) -> DataFrame:
    """Rows ``keys, x0..x3, y`` -> one moment row per key (partial and final merge)."""
    x = [F.col(f"x{i}") for i in range(P)]
    n = F.count(F.lit(1))
    return rows.groupBy(*keys).agg(
        n.alias("n"), *[F.avg(c).alias(m) for c, m in zip([*x, F.col("y")], MEANS, strict=True)],
        *[(F.covar_pop(x[i], x[j]) * n).alias(f"s{i}{j}") for i, j in PAIRS],
        *[(F.covar_pop(x[i], F.col("y")) * n).alias(f"t{i}") for i in range(P)])


def merged(a: Column, b: Column) -> Column:
    """The moments of the union of two disjoint sets (structs; null or n = 0 is the empty set)."""
    n = a["n"] + b["n"]
    step = {m: b[m] - a[m] for m in MEANS}
    both = F.struct(
        n.alias("n"), *[(a[m] + step[m] * b["n"] / n).alias(m) for m in MEANS],
        *[(a[s] + b[s] + step[_factors(s)[0]] * step[_factors(s)[1]] * a["n"] * b["n"] / n).alias(s) for s in SUMS])
    return F.when(_empty(b), a).when(_empty(a), b).otherwise(both)


def without(whole: Column, part: Column) -> Column:
    """The moments of ``whole`` less a subset's: the inverse of ``merged``."""
    n = whole["n"] - part["n"]
    mean = {m: whole[m] - (part[m] - whole[m]) * part["n"] / n for m in MEANS}
    rest = F.struct(
        n.alias("n"), *[mean[m].alias(m) for m in MEANS],
        *[(whole[s] - part[s] - (part[_factors(s)[0]] - mean[_factors(s)[0]]) * (part[_factors(s)[1]] - mean[_factors(s)[1]])
           * n * part["n"] / whole["n"]).alias(s) for s in SUMS])
    return F.when(_empty(part), whole).when(n <= 0, nothing()).otherwise(rest)


def _empty(m: Column) -> Column:
    return F.coalesce(m["n"], F.lit(0)) == 0


def nothing() -> Column:
    """The empty set."""
    return F.struct(F.lit(0).cast("long").alias("n"), *[F.lit(0.0).alias(c) for c in MEANS + SUMS])


def as_struct() -> Column:
    return F.struct(*COLUMNS)


def fit(states: DataFrame, keys=ols.KEYS) -> DataFrame:
    """Moment rows -> one model row per key: ``keys, n, w0..w3, intercept`` (keys of no rows have none)."""
    cov = states.where(F.col("n") > 0).select(
        *keys, "n", *MEANS, *[(F.col(f"s{i}{j}") / F.col("n")).alias(f"c{i}{j}") for i, j in PAIRS],
        *[(F.col(f"t{i}") / F.col("n")).alias(f"b{i}") for i in range(P)])
    return ols.solve(cov).select(*keys, "n", *[f"w{i}" for i in range(P)], "intercept")
