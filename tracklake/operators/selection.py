"""Exact percentiles of groups of any size, with a bounded state.

An exact percentile function keeps every distinct value of a group in one task. Here the ranks that a percentile needs are
selected: the doubles are turned into whole numbers of the same order, and their histogram is refined sixteen bits at a time. A
pass counts only values that share the bits found so far with some rank, so a group has at most 65,536
counters a rank and pass, added up before the shuffle; after four passes the bits of each rank are complete. Percentiles
are interpolated linearly between neighbouring ranks.

Nulls and NaN are left out; -0.0 counts as 0.0. A group without values has n 0 and null percentiles. Null keys are a group.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType

from tracklake.operators.pairs import checkpointed

STEP = 16
#: Ranks up to which what a pass looks for is broadcast; of more, the join is sized (and split where it is skewed) by Spark.
BROADCAST = 100_000


@F.pandas_udf(LongType())
def ordered_bits(v: pd.Series) -> pd.Series:
    """A whole number for each double, in the order of the doubles."""
    bits = (v.to_numpy(float) + 0.0).view(np.int64)
    return pd.Series(bits ^ ((bits >> 63) & np.int64(0x7FFFFFFFFFFFFFFF)))


@F.pandas_udf(DoubleType())
def _double_of(bits: pd.Series) -> pd.Series:
    b = bits.to_numpy(np.int64)
    return pd.Series((b ^ ((b >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))).view(float))


def _same(left: Sequence[str], right: Sequence[str]) -> Column:
    out = F.lit(True)
    for a, b in zip(left, right, strict=True):
        out = out & F.col(a).eqNullSafe(F.col(b))
    return out


def ranked(values: DataFrame, ranks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, rank, value: of ``values`` (keys, bits) those with the places in ``ranks`` (keys, rank from 0, distinct)."""
    mine = [f"_k{i}" for i in range(len(keys))]
    own = ranks.select(*[F.col(k).alias(m) for k, m in zip(keys, mine, strict=True)], "rank", F.col("rank").alias("_left"), F.lit(None).cast("long").alias("_prefix"))
    for shift in range(64 - STEP, -1, -STEP):
        own = checkpointed(own)
        wanted = own.select(*mine, "_prefix").distinct()
        if own.count() <= BROADCAST:  # else a group of any size would be one task of a join by its keys
            wanted = F.broadcast(wanted)
        near = _same(keys, mine)
        if shift < 64 - STEP:
            near = near & (F.shiftright("bits", shift + STEP) == F.col("_prefix"))
        counted = values.join(wanted, near).groupBy(*mine, "_prefix", F.shiftright("bits", shift).alias("_bits")).agg(F.count("*").alias("_m"))
        until = F.sum("_m").over(Window.partitionBy(*mine, "_prefix").orderBy("_bits").rowsBetween(Window.unboundedPreceding, 0))
        there = [f"_t{i}" for i in range(len(keys))]
        counted = counted.withColumn("_until", until).select(*[F.col(m).alias(t) for m, t in zip(mine, there, strict=True)], F.col("_prefix").alias("_tp"), "_bits", "_m", "_until")
        here = _same(mine, there) & F.col("_prefix").eqNullSafe(F.col("_tp")) & (F.col("_until") - F.col("_m") <= F.col("_left")) & (F.col("_left") < F.col("_until"))
        own = own.join(counted, here).select(*mine, "rank", (F.col("_left") - F.col("_until") + F.col("_m")).alias("_left"), F.col("_bits").alias("_prefix"))
    return own.select(*[F.col(m).alias(k) for k, m in zip(keys, mine, strict=True)], "rank", _double_of("_prefix").alias("value"))


def percentiles(df: DataFrame, value: Column, shares: Sequence[float], *keys: str) -> DataFrame:
    """keys, n, p: the exact percentiles of a column as an array, in the order of ``shares`` (0 to 1)."""
    by = list(keys) or ["one_group"]
    rows = (df if keys else df.withColumn("one_group", F.lit(0))).select(*by, value.cast("double").alias("_v"))
    held = checkpointed(rows.where("_v is not null and not isnan(_v)").select(*by, ordered_bits("_v").alias("bits")))
    sizes = rows.groupBy(*by).agg(F.count(F.when(~F.isnan("_v"), F.col("_v"))).alias("n"))
    at = F.explode(F.array(*[F.struct(F.lit(j).alias("j"), (F.lit(float(p)) * (F.col("n") - 1)).alias("at")) for j, p in enumerate(shares)])).alias("_at")
    wanted = checkpointed(sizes.where("n > 0").select(*by, at).select(*by, F.col("_at.j").alias("j"), F.floor("_at.at").alias("low"), F.ceil("_at.at").alias("high"), F.col("_at.at").alias("at")))
    ranks = wanted.select(*by, F.explode(F.array("low", "high")).alias("rank")).distinct()
    found = checkpointed(ranked(held, ranks, by))
    for end in ("low", "high"):
        side = found.select(*[F.col(k).alias(f"_s{i}") for i, k in enumerate(by)], F.col("rank").alias("_r"), F.col("value").alias(f"v_{end}"))
        same = _same(by, [f"_s{i}" for i in range(len(by))]) & (F.col(end) == F.col("_r"))
        wanted = wanted.join(side, same).drop("_r", *[f"_s{i}" for i in range(len(by))])
    between = F.when(F.col("low") == F.col("high"), F.col("v_low")).otherwise((F.col("high") - F.col("at")) * F.col("v_low") + (F.col("at") - F.col("low")) * F.col("v_high"))
    each = wanted.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("j", between.alias("v")))).alias("_p"))
    each = each.select(*[F.col(k).alias(f"_s{i}") for i, k in enumerate(by)], F.transform("_p", lambda s: s["v"]).alias("p"))
    out = sizes.join(each, _same(by, [f"_s{i}" for i in range(len(by))]), "left")
    return out.select(*keys, "n", "p")


def distribution(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """n, min, median, p95 (linear), max, mean of a column, as quality.distribution(), of groups of any size."""
    return _with_percentiles(df, F.col(value), {"median": 0.5, "p95": 0.95}, {"n": F.count, "min": F.min, "max": F.max, "mean": F.avg}, keys)


def residual_summary(df: DataFrame, residual: str, *keys: str) -> DataFrame:
    """n, median and largest absolute residual, mean residual, as quality.residual_summary(), of groups of any size."""
    held = df.withColumn("_a", F.abs(residual))
    most = {"n": F.count, "max_abs": lambda _: F.max("_a"), "mean": lambda _: F.avg(residual)}
    return _with_percentiles(held, F.col("_a"), {"median_abs": 0.5}, most, keys)


def _with_percentiles(df: DataFrame, value: Column, shares: dict[str, float], others: dict, keys: Sequence[str]) -> DataFrame:
    p = percentiles(df, value, list(shares.values()), *keys).drop("n")
    rest = df.groupBy(*keys).agg(*[f(value).alias(n) for n, f in others.items()])
    p = p.select(*[F.col(k).alias(f"_p{i}") for i, k in enumerate(keys)], *[F.get("p", F.lit(j)).alias(n) for j, n in enumerate(shares)])
    return rest.join(p, _same(keys, [f"_p{i}" for i in range(len(keys))])).drop(*[f"_p{i}" for i in range(len(keys))])


def crop_box(points: DataFrame, margin: float, *keys: str) -> DataFrame:
    """1st and 99th percentile of each axis, widened by the margin, as cloud.crop_box(), of clouds of any size."""
    out = None
    for c in "xyz":
        p = percentiles(points, F.col(c), [0.01, 0.99], *keys)
        own = p.select(*keys, *[(F.get("p", F.lit(j)) + s * margin).alias(f"{n}_{c}") for j, (n, s) in enumerate((("low", -1), ("high", 1)))])
        renamed = own.select(*[F.col(k).alias(f"_c{i}") for i, k in enumerate(keys)], f"low_{c}", f"high_{c}")
        out = own if out is None else out.join(renamed, _same(keys, [f"_c{i}" for i in range(len(keys))])).drop(*[f"_c{i}" for i in range(len(keys))])
    return out


def residual_quality(residuals: DataFrame, threshold_m: Column, squared: Column, *keys: str) -> DataFrame:
    """n, median_m, p95_m, inlier_share, inlier_p95_m, median_mahalanobis2, chi2_share, as alignment.residual_quality(), of groups of any size.

    ``squared``: the squared Mahalanobis distance of each residual; 7.8147 is the 0.95 quantile of chi-square(3).
    """
    rows = residuals.withColumn("_m2", squared).withColumn("_in", F.col("residual_m") <= threshold_m)
    parts = [(F.col("residual_m"), {"median_m": 0.5, "p95_m": 0.95}), (F.when(F.col("_in"), F.col("residual_m")), {"inlier_p95_m": 0.95}), (F.col("_m2"), {"median_mahalanobis2": 0.5})]
    out = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(F.col("_in").cast("double")).alias("inlier_share"), F.avg((F.col("_m2") <= 7.8147).cast("double")).alias("chi2_share"))
    for value, shares in parts:
        p = percentiles(rows, value, list(shares.values()), *keys)
        p = p.select(*[F.col(k).alias(f"_p{i}") for i, k in enumerate(keys)], *[F.get("p", F.lit(j)).alias(n) for j, n in enumerate(shares)])
        out = out.join(p, _same(keys, [f"_p{i}" for i in range(len(keys))])).drop(*[f"_p{i}" for i in range(len(keys))])
    return out.select(*keys, "n", "median_m", "p95_m", "inlier_share", "inlier_p95_m", "median_mahalanobis2", "chi2_share")
