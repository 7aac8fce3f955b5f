"""Reductions of rasters and arrays, exact and independent of order and partitions.

A sum of floats depends on their order, so a finite value is written as a whole number times a
power of two, by column expressions for FLOAT. Whole numbers are cut into limbs of 13 bits and summed for
each power by an ordinary aggregate, in LONGs that hold 2^49 values; the few bins are finished with exact
fractions, rounded once. Counts of special values and extremes come from the same scan.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.exact import lit_f

_NAN, _INF = float("nan"), float("inf")


def _extremes(v):
    """Aggregates for NaN-absorbing extremes with -0 below +0."""
    minus = F.max(((v == 0) & v.cast("string").startswith("-")).cast("int"))
    plus = F.max(((v == 0) & ~v.cast("string").startswith("-")).cast("int"))
    nan = F.max(F.isnan(v).cast("int"))
    lo, hi = F.min(F.when(~F.isnan(v), v)), F.max(v)
    lo = F.when(nan == 1, lit_f(_NAN)).when((lo == 0) & (minus == 1), lit_f(-0.0)).otherwise(lo)
    hi = F.when(nan == 1, lit_f(_NAN)).when((hi == 0) & (plus == 1), lit_f(0.0)).otherwise(hi)
    return lo, hi


def count(r) -> DataFrame:
    """One row: valid cells."""
    return r.df.agg(F.count("v").alias("count"))


def min_max(r) -> DataFrame:
    """One row (min, max, count); NaN if any value is, or none is valid."""
    lo, hi = _extremes(F.col("v"))
    return r.df.agg(F.coalesce(lo, lit_f(_NAN)).alias("min"), F.coalesce(hi, lit_f(_NAN)).alias("max"), F.count("v").alias("count"))


LIMB = 13
#: Bins of FLOAT values by magnitude: 16 powers of two each, from the least subnormal on; and the power of two that values of a bin are multiples of.
_EDGES = [2.0**k for k in range(-133, 128, 16)]
_UNITS = [max(-149, -149 + 16 * j - 23) for j in range(len(_EDGES) + 1)]


def _double_parts(v: pd.Series) -> pd.DataFrame:
    m, e = np.frexp(v.to_numpy(np.float64))
    return pd.DataFrame({"bin": e.astype(np.int32) - 53, "sig": (m * 9007199254740992.0).astype(np.int64)})


def _split(df: DataFrame, column: str, finite) -> tuple[DataFrame, int]:
    """``df`` with bin and sig, v = sig * 2^bin (both null where not ``finite``), and the number of limbs that hold sig."""
    d = F.col(column).cast("double")
    if df.schema[column].dataType.typeName() != "float":
        parts = F.pandas_udf(_double_parts, "struct<bin:int,sig:long>")  # doubles have no whole significand among the built-ins
        return df.withColumn("part_", parts(F.when(finite, d).otherwise(0.0))).select("*", *(F.when(finite, F.col(f"part_.{c}")).alias(c) for c in ("bin", "sig"))), 5
    which = F.lit(len(_EDGES))
    for j, edge in reversed(list(enumerate(_EDGES))):
        which = F.when(F.abs(d) < edge, j).otherwise(which)
    df = df.withColumn("part_", F.when(finite, which))
    pick = lambda values, kind: F.get(F.array(*map(F.lit, values)), F.col("part_")).cast(kind)
    return df.select("*", pick(_UNITS, "int").alias("bin"), (d * pick([2.0**-u for u in _UNITS], "double")).cast("long").alias("sig")), 3


def binned(df: DataFrame, keys: list[str], column: str = "v", squares: bool = False) -> DataFrame:
    """Rows (keys, bin, n, nan, pinf, ninf, mzero, lo, hi, s0, s1, ...[, q00, q01, ...]) of valid values, one scan.

    bin is null for what has none (0, NaN, infinities, invalid cells). sK sums limb K of all significands;
    qIJ the products of two limbs, as LONGs for each task and as DECIMALs over the tasks.
    """
    v = F.col(column)
    d = v.cast("double")
    finite = ~F.isnan(d) & (F.abs(d) != _INF) & (d != 0)
    split, limbs = _split(df, column, finite)
    mask = (1 << LIMB) - 1
    limb = [F.shiftright("sig", LIMB * k) if k == limbs - 1 else F.shiftright("sig", LIMB * k).bitwiseAND(mask) for k in range(limbs)]
    lo, hi = _extremes(v)
    sums = {"n": F.count(v), "nan": F.count(F.when(F.isnan(d), 1)), "pinf": F.count(F.when(d == _INF, 1)), "ninf": F.count(F.when(d == -_INF, 1)), "mzero": F.count(F.when((v == 0) & v.cast("string").startswith("-"), 1))}
    sums |= {f"s{k}": F.sum(x) for k, x in enumerate(limb)}
    if not squares:
        return split.groupBy(*keys, "bin").agg(*(x.alias(n) for n, x in sums.items()), lo.alias("lo"), hi.alias("hi"))
    sums |= {f"q{i}{j}": F.sum(limb[i] * limb[j]) for i in range(limbs) for j in range(i, limbs)}
    task = split.withColumn("task", F.spark_partition_id()).groupBy(*keys, "bin", "task").agg(*(x.alias(n) for n, x in sums.items()), lo.alias("lo"), hi.alias("hi"))
    low, _ = _extremes(F.col("lo"))
    _, high = _extremes(F.col("hi"))
    return task.groupBy(*keys, "bin").agg(*(F.sum(F.col(n).cast("decimal(38,0)") if n[0] == "q" else n).alias(n) for n in sums), low.alias("lo"), high.alias("hi"))


def _limbs(row, name: str) -> int:
    """The sum that a bin's limbs stand for."""
    k, total = 0, 0
    while f"{name}{k}" in row:
        total += int(row[f"{name}{k}"] or 0) << (LIMB * k)
        k += 1
    return total


def _total(rows) -> Fraction:
    return sum((Fraction(_limbs(r, "s")) * Fraction(2) ** int(r["bin"]) for r in rows if r["bin"] is not None), Fraction(0))


def _squares(rows) -> Fraction:
    total = Fraction(0)
    for r in rows:
        if r["bin"] is not None:
            pairs = [(int(n[1]), int(n[2]), int(x)) for n, x in r.items() if n[0] == "q"]
            total += Fraction(sum((x << LIMB * (i + j)) * (1 if i == j else 2) for i, j, x in pairs)) * Fraction(4) ** int(r["bin"])
    return total


def _float(x: Fraction) -> float:
    try:
        return float(x)
    except OverflowError:
        return math.copysign(_INF, x)


def finished_sum(rows: list[dict]) -> tuple[float, Fraction | None, int]:
    """The correctly rounded sum of bins; its exact value if it is finite; the number of values."""
    n, nan, pinf, ninf, mzero = (sum(int(r[c]) for r in rows) for c in ("n", "nan", "pinf", "ninf", "mzero"))
    if nan or (pinf and ninf):
        return _NAN, None, n
    if pinf or ninf:
        return (_INF if pinf else -_INF), None, n
    total = _total(rows)
    return (-0.0 if n and mzero == n else _float(total)), total, n


def rounded_sqrt(x: Fraction) -> float:
    """Square root of an exact value through a 256-bit integer root."""
    if x <= 0:
        return 0.0
    shift = max(0, 512 - (x.numerator.bit_length() - x.denominator.bit_length()))
    shift += shift % 2
    root = math.isqrt((x.numerator << shift) // x.denominator)
    return _float(Fraction(root, 1 << (shift // 2)))


def exact_sum(r) -> DataFrame:
    """One row: the exact sum, rounded once; 0 for no valid cell."""
    rows = [b.asDict() for b in binned(r.df, []).collect()]  # a row for each bin
    return r.df.sparkSession.createDataFrame([(finished_sum(rows)[0],)], "sum double")


def stats(r, column: str = "v") -> DataFrame:
    """One row (count, sum, mean, stddev, min, max): population deviation, all exact and rounded once.

    One scan. What reaches the driver is a row for each bin, 18 for FLOAT.
    """
    rows = [b.asDict() for b in binned(r.df, [], column, squares=True).collect()]
    total, exact, n = finished_sum(rows)
    mean = dev = _NAN
    if n and exact is not None:
        mean = total if str(total) == "-0.0" else _float(exact / n)
        dev = rounded_sqrt(_squares(rows) / n - (exact / n) ** 2)
    elif n:
        mean = total
    lo, hi = (_least([b[c] for b in rows if b[c] is not None], sign) for c, sign in (("lo", -1.0), ("hi", 1.0)))
    return r.df.sparkSession.createDataFrame([(n, total, mean, dev, lo, hi)], "count long, sum double, mean double, stddev double, min float, max float")


def _least(values: list[float], sign: float) -> float:
    """The least (sign -1) or greatest of the bins' extremes; NaN if any is, or there is none; -0 is below 0."""
    if not values or any(math.isnan(x) for x in values):
        return _NAN
    return max(map(float, values), key=lambda x: (sign * x, sign * math.copysign(1.0, x)))


def stats_fast(r) -> DataFrame:
    """The same columns with ordinary double aggregates: one pass, last bits depend on the order."""
    v = F.col("v").cast("double")
    lo, hi = _extremes(F.col("v"))
    return r.df.agg(F.count("v").alias("count"), F.coalesce(F.sum(v), F.lit(0.0)).alias("sum"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("stddev"), lo.alias("min"), hi.alias("max"))


def grouped_sums(df: DataFrame, keys: list[str], mean: bool) -> DataFrame:
    """Exact sums (or means, NULL for no valid value) for each group: (keys, v DOUBLE). Bins meet group by group; groups without a valid value stay."""
    bins = binned(df, keys)
    names = [c for c in bins.columns if c not in (*keys, "lo", "hi")]
    packed = bins.groupBy(*keys).agg(F.collect_list(F.struct(*names)).alias("bins"))

    @F.pandas_udf("double")
    def finish(bins: pd.Series) -> pd.Series:
        out = []
        for b in bins:
            total, exact, n = finished_sum([x if isinstance(x, dict) else x.asDict() for x in b])
            if mean:
                total = None if not n else total if exact is None or str(total) == "-0.0" else _float(exact / n)
            out.append(total)
        return pd.Series(out, dtype="object" if mean else "float64")

    return packed.select(*keys, finish("bins").alias("v"))
