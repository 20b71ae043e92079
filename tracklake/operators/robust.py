"""Robust rigid alignment: one hypothesis of all pairs and many of three pairs, scored over all pairs, then fitted again.

Every pair has its own largest residual, and a weight in the fits. A key's pairs are scored in blocks of rows: a worker
multiplies a block with the matrix of all hypotheses and gives back one row for each hypothesis, so pairs are never
multiplied by hypotheses as rows, and a key with very many pairs is many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklake.functions import symmetric
from tracklake.operators.alignment import aligned, moments, rigid_fit
from tracklake.operators.pairs import checkpointed
from tracklake.operators.scans import dealt

#: Pairs that a worker scores at once.
BLOCK = 8192
#: Bits of a residual that one round of the selection of a median settles.
STEP = 16


def pair_limits(covariance: symmetric.Symmetric, threshold_m: Column | float) -> tuple[Column, Column]:
    """Largest residual (the threshold, or three deviations along the worst direction if that is more) and fit weight of a pair."""
    sigma = F.sqrt(F.greatest(symmetric.eigenvalues(covariance)[2], F.lit(1e-8)))
    trace = covariance[0] + covariance[3] + covariance[5]
    return F.greatest(F.lit(threshold_m) if isinstance(threshold_m, float) else threshold_m, 3 * sigma), 1 / F.greatest(trace, F.lit(1e-8))


def weighted_rigid(rows: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Rotation and translation of pairs (x, y, z, u, v, w); none if they stand in a line."""
    total = weights.sum()
    mean = (weights[:, None] * rows).sum(0) / total
    p, q = rows[:, :3] - mean[:3], rows[:, 3:] - mean[3:]
    if np.linalg.matrix_rank(p * np.sqrt(weights / total)[:, None], tol=1e-9) < 2:
        return None
    left, _, right = np.linalg.svd((q * weights[:, None]).T @ p)
    r = left @ np.diag([1, 1, np.sign(np.linalg.det(left @ right)) or 1.0]) @ right
    return r, mean[3:] - r @ mean[:3]


def weighted_rigids(rows: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """weighted_rigid() of many equally long lists of pairs at once: 9 of a rotation and 3 of a translation of each that isn't in a line."""
    total = weights.sum(1)[:, None]
    mean = (weights[:, :, None] * rows).sum(1) / total
    p, q = rows[:, :, :3] - mean[:, None, :3], rows[:, :, 3:] - mean[:, None, 3:]
    wide = (np.linalg.svd(p * np.sqrt(weights / total)[:, :, None], compute_uv=False) > 1e-9).sum(1) >= 2
    p, q, mean, weights = p[wide], q[wide], mean[wide], weights[wide]
    left, _, right = np.linalg.svd((q * weights[:, :, None]).transpose(0, 2, 1) @ p)
    sign = np.sign(np.linalg.det(left @ right))
    left[:, :, 2] *= np.where(sign == 0, 1.0, sign)[:, None]
    r = left @ right
    return np.concatenate([r.reshape(-1, 9), mean[:, 3:] - (r @ mean[:, :3, None])[:, :, 0]], axis=1)


@lru_cache(maxsize=256)
def draws(n: int, hypotheses: int, seed: int) -> list[np.ndarray]:
    """Three different places out of n for each hypothesis; where there are enough pairs no pair is drawn twice."""
    if n < 3:
        return []
    if n >= 3 * hypotheses:
        return list(np.arange(3 * hypotheses).reshape(-1, 3))
    rng = np.random.default_rng(seed)
    return [rng.choice(n, 3, replace=False) for _ in range(hypotheses)]


def normalized_residuals(rows: np.ndarray, limit: np.ndarray, models: np.ndarray) -> np.ndarray:
    """Residual by limit of each pair (rows) under each model (columns), at most 1 for inliers. Models: 9 of a rotation, 3 of a translation."""
    out = np.zeros((len(rows), len(models)))
    for i in range(3):
        e = rows[:, 3 + i, None] - (rows[:, :3] @ models[:, 3 * i : 3 * i + 3].T + models[:, 9 + i])
        out += e * e
    return np.sqrt(out) / limit[:, None]


def _by_block(held: DataFrame, models: DataFrame, keys: list[str], schema: str, score) -> DataFrame:  # noqa: ANN001
    """``score(keys' values, pairs of a block, the key's row of models)`` for every block of every key."""
    there = models.join(held.groupBy(*keys).agg(F.max("_block").alias("_last")), keys).withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), "_last")))
    columns = [f.split()[0].strip("`") for f in schema.split(", ")]

    def run(name: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(score(name[:-1], left, right.iloc[0]) if len(left) and len(right) else [], columns=columns)

    at = [*keys, "_block"]
    return dealt(held, *at).groupBy(*at).cogroup(dealt(there, *at).groupBy(*at)).applyInPandas(run, schema)


_PAIR = [*"xyzuvw"]



def _scores(held: DataFrame, models: DataFrame, keys: list[str], kinds: str) -> DataFrame:
    """keys, h, n inliers, their mark (equal for equal sets) and the sum of their normalised residuals.

    Of a key with one block only the models with most inliers come, and of equal sets of those the first: no other can be the best.
    """

    def score(name: tuple, left: pd.DataFrame, row: pd.Series) -> list[tuple]:
        e = normalized_residuals(left[_PAIR].to_numpy(float), left["_limit"].to_numpy(float), np.reshape(row["models"], (-1, 12)))
        inside = e <= 1
        marks = np.bitwise_xor.reduce(np.where(inside, left["_mark"].to_numpy(np.int64)[:, None], 0), axis=0)
        n, total = inside.sum(0), np.where(inside, e, 0).sum(0)
        at = np.arange(len(n))
        if row["_last"] == 0:
            at = np.flatnonzero(n == n.max())
            at = np.sort(at[np.unique(marks[at], return_index=True)[1]])
        return [(*name, h, *x) for h, *x in zip(at.tolist(), n[at].tolist(), marks[at].tolist(), total[at].tolist(), strict=True)]

    counted = _by_block(held, models, keys, f"{kinds}, h int, n long, mark long, total double", score)
    return counted.groupBy(*keys, "h").agg(F.sum("n").alias("n"), F.bit_xor("mark").alias("mark"), F.sum("total").alias("total"))


def _middles(held: DataFrame, tied: DataFrame, keys: list[str], kinds: str) -> DataFrame:
    """keys, h, and the bits of one or two middle normalised residuals of the inliers of each model in ``tied`` (keys, h, model, n).

    They are selected exactly, sixteen bits of the doubles a round: blocks count their residuals by the next bits, and
    the counts of the bits before a rank name the range that holds it. So no residual becomes a row.
    """
    rank = F.explode(F.array(F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)).cast("array<bigint>"))
    state = tied.select(*keys, "h", "model", F.lit(0).cast("long").alias("prefix"), rank.alias("rank"))
    state = state.withColumn("target", F.row_number().over(Window.partitionBy(*keys).orderBy("h", "rank")))
    for shift in range(64 - STEP, -1, -STEP):
        state = checkpointed(state)
        models = state.groupBy(*keys).agg(F.collect_list(F.struct("target", "prefix", "model")).alias("targets"))

        def count(name: tuple, left: pd.DataFrame, row: pd.Series, shift: int = shift) -> list[tuple]:
            e = normalized_residuals(left[_PAIR].to_numpy(float), left["_limit"].to_numpy(float), np.array([t["model"] for t in row["targets"]]))
            out = []
            for k, target in enumerate(row["targets"]):
                bits = e[:, k][e[:, k] <= 1].view(np.int64)
                if shift < 64 - STEP:
                    bits = bits[bits >> (shift + STEP) == target["prefix"]]
                out += [(*name, target["target"], *x) for x in zip(*(v.tolist() for v in np.unique(bits >> shift, return_counts=True)), strict=True)]
            return out

        counts = _by_block(held, models, keys, f"{kinds}, target int, bits long, m long", count).groupBy(*keys, "target", "bits").agg(F.sum("m").alias("m"))
        until = F.sum("m").over(Window.partitionBy(*keys, "target").orderBy("bits").rowsBetween(Window.unboundedPreceding, 0))
        placed = counts.withColumn("until", until).join(state.drop("prefix"), [*keys, "target"])
        placed = placed.where((F.col("until") - F.col("m") <= F.col("rank")) & (F.col("rank") < F.col("until")))
        state = placed.select(*keys, "h", "model", F.col("bits").alias("prefix"), (F.col("rank") - F.col("until") + F.col("m")).alias("rank"), "target")
    return state.select(*keys, "h", F.col("prefix").alias("bits"))


def _best(held: DataFrame, models: DataFrame, keys: list[str], kinds: str) -> DataFrame:
    """keys, rotation, translation of the model with (most inliers, smallest median, smallest mean, first); at least three inliers."""
    most = Window.partitionBy(*keys)
    scores = _scores(held, models, keys, kinds).where("n >= 3").withColumn("_most", F.max("n").over(most)).where("n = _most")
    first = Window.partitionBy(*keys, "mark").orderBy("h")  # of models with one set of inliers the first stands for all
    reps = scores.withColumn("_k", F.row_number().over(first)).where("_k = 1").withColumn("_reps", F.count("*").over(most)).join(models, keys)
    reps = checkpointed(reps.select(*keys, "h", "n", "total", "_reps", F.slice("models", F.col("h") * 12 + 1, F.lit(12)).alias("model")))
    tied = reps.where("_reps > 1")
    if tied.isEmpty():
        best = reps
    else:
        bits = _middles(held, tied, keys, kinds).groupBy(*keys, "h").agg(F.collect_list("bits").alias("bits"))

        def pick(rows: pd.DataFrame) -> pd.DataFrame:
            value = [np.array(b, np.int64).view(float).mean() if b is not None else 0.0 for b in rows["bits"]]
            return rows.assign(median=value).sort_values(["median", "total", "h"]).drop(columns=["median", "bits"])[:1]

        best = reps.join(bits, [*keys, "h"], "left").groupBy(*keys).applyInPandas(pick, f"{kinds}, h int, n long, total double, _reps long, model array<double>")
    return best.select(*keys, F.slice("model", 1, 9).alias("rotation"), F.slice("model", 10, 3).alias("translation"))


def robust_alignment(pairs: DataFrame, threshold: Column, *keys: str, weight: Column | None = None, hypotheses: int = 512, refits: int = 3, seed: int = 0, index: str = "id") -> DataFrame:
    """keys, rotation, translation, n_inliers, rank, scale: one row for each key (one row for no keys).

    ``threshold``: each pair's largest inlier residual; ``weight``: its weight in every fit. The hypothesis of all pairs
    stands beside ``hypotheses`` of three pairs each, drawn from all pairs of the key (in the order of a seeded hash, of which a
    key needs no more rows than are drawn). The best one has most inliers, then the smallest median and mean of
    residual by threshold. Its inliers are fitted again and chosen anew up to ``refits`` times, until they stay the same
    or are fewer than three; the last fit is over the last inliers. Pairs with a null or a limit that isn't positive
    are left out; a key without three pairs, or whose pairs stand in a line, has no row.
    """
    by = list(keys) or ["all_pairs"]
    rows = pairs if keys else pairs.withColumn("all_pairs", F.lit(0))
    rows = rows.select(*by, F.col(index).alias("_index"), *[F.col(v).cast("double").alias(v) for v in _PAIR], threshold.cast("double").alias("_limit"), (weight if weight is not None else F.lit(1.0)).cast("double").alias("_weight"))
    # written first: limits may be long expressions, which filters and sums would otherwise repeat
    rows = checkpointed(rows.withColumn("_mark", F.xxhash64("_index", *_PAIR, F.lit(seed)))).dropna(subset=[*_PAIR, "_limit", "_weight"]).where("_limit > 0 and _weight > 0")
    sizes = rows.groupBy(*by).agg(F.count("*").alias("_n"), F.sum("_weight").alias("_sum"))
    block = F.pmod(F.xxhash64("_mark"), F.ceil(F.col("_n") / BLOCK)).cast("long")
    held = rows.join(sizes, by).withColumns({"_block": block, "_weight": F.col("_weight") * F.col("_n") / F.col("_sum")}).drop("_sum")
    held = checkpointed(held)
    kinds = ", ".join(f"`{k}` {held.schema[k].dataType.simpleString()}" for k in by)
    order = Window.partitionBy(*by).orderBy("_mark", "_index")
    drawn = held.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= 3 * hypotheses)

    def hypothesise(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_k")
        values, weights = rows[_PAIR].to_numpy(float), rows["_weight"].to_numpy(float)
        at = np.array(draws(len(rows), hypotheses, seed), int).reshape(-1, 3)
        return pd.DataFrame([(*(rows[k].iloc[0] for k in by), weighted_rigids(values[at], weights[at]).ravel())], columns=[*by, "drawn"])

    drawn = dealt(drawn, *by).groupBy(*by).applyInPandas(hypothesise, f"{kinds}, drawn array<double>")
    whole = rigid_fit(moments(held, *by, weight=F.col("_weight")), *by).where("rank >= 2").select(*by, F.concat("rotation", "translation").alias("whole"))
    models = drawn.join(whole, by, "left").select(*by, F.concat(F.coalesce("whole", F.array().cast("array<double>")), "drawn").alias("models")).where("size(models) > 0")
    best = _best(held, checkpointed(models), by, kinds)

    def inside(fit: DataFrame) -> DataFrame:
        chosen = aligned(held, fit, *by).where("residual_m <= _limit")
        marks = chosen.groupBy(*by).agg(F.bit_xor("_mark").alias("_set"))
        return checkpointed(moments(chosen, *by, weight=F.col("_weight")).join(marks, by))

    state = inside(best).where("n >= 3").withColumn("_done", F.lit(False))
    for _ in range(refits):
        state = checkpointed(state)
        if state.where("not _done").isEmpty():
            break
        after = inside(rigid_fit(state.where("not _done"), *by)).where("n >= 3")
        before = state.where("not _done").select(*by, F.col("_set").alias("_before"), F.col("n").alias("_many"))
        moved = before.join(after, by).where("_set <> _before or n <> _many").drop("_before", "_many")
        stay = state.join(moved.select(*by), by, "left_anti").withColumn("_done", F.lit(True))
        state = stay.unionByName(moved.withColumn("_done", F.lit(False)))
    out = rigid_fit(state, *by).where("rank >= 2").select(*keys, "rotation", "translation", F.col("n").alias("n_inliers"), "rank", "scale")
    return checkpointed(out)


def held_out_alignment(pairs: DataFrame, role: str, threshold: Column, *keys: str, **options) -> DataFrame:  # noqa: ANN003
    """Residuals of all pairs under the robust alignment of the calibration rows alone; held-out rows are never fitted."""
    fit = robust_alignment(pairs.where(F.col(role) == "calibration"), threshold, *keys, **options)
    return aligned(pairs, fit, *keys)
