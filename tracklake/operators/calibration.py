"""Calibration of clocks, rigs and colours: sums in Spark, one small linear problem per group in a worker."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklake.operators import alignment, association

c = F.col


def _kinds(df: DataFrame, keys: Sequence[str]) -> str:
    return "".join(f"`{k}` {df.schema[k].dataType.simpleString()}, " for k in keys)


def color_corrected(pixels: DataFrame, *keys: str, fit: Column | None = None) -> DataFrame:
    """Pixels with a0, a1, a2 replaced by the affine map of them that is nearest to b0, b1, b2, clamped to [0, 1].

    One 3x4 map for each group, by least squares over the rows where ``fit`` holds (all, if not given). Of several
    best maps (fewer than four pixels, or one colour) the one of least norm is taken; without rows to fit, nulls.
    """
    use = F.coalesce(fit if fit is not None else F.lit(True), F.lit(False))
    terms = [c("a0"), c("a1"), c("a2"), F.lit(1.0)]
    pairs = [(i, j) for i in range(4) for j in range(i, 4)]
    sums = [F.sum(F.when(use, terms[i] * terms[j])).alias(f"g{i}{j}") for i, j in pairs] + [F.sum(F.when(use, terms[i] * c(f"b{k}"))).alias(f"r{i}{k}") for i in range(4) for k in range(3)]

    def solve(batches):  # noqa: ANN001, ANN202
        for b in batches:
            out = []
            for r in b.to_dict("records"):
                gram = np.array([[r[f"g{min(i, j)}{max(i, j)}"] for j in range(4)] for i in range(4)], float)
                right = np.array([[r[f"r{i}{k}"] for k in range(3)] for i in range(4)], float)
                known = np.isfinite(gram).all() and np.isfinite(right).all()
                out.append((*(r[k] for k in keys), (np.linalg.pinv(gram, rcond=1e-12, hermitian=True) @ right).ravel().tolist() if known else None))
            yield pd.DataFrame(out, columns=[*keys, "_map"])

    summed = pixels.groupBy(*keys).agg(*sums)
    maps = summed.mapInPandas(solve, f"{_kinds(summed, keys)}_map array<double>")
    value = lambda k: sum((terms[i] * F.element_at("_map", 3 * i + k + 1) for i in range(1, 4)), terms[0] * F.element_at("_map", k + 1))
    clamped = {f"a{k}": F.when(c("_map").isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), value(k)))) for k in range(3)}
    return pixels.join(maps, list(keys)).withColumns(clamped).drop("_map")


def clock_profile(reference: DataFrame, sample: DataFrame, offsets_ns: Sequence[int], max_gap_ns: int | None = None, key: str = "segment_id", time: str = "t_ns", index: str = "row_id") -> DataFrame:
    """key, offset_ns, n, cost, median_m: how well samples (x, y, z), read ``offset_ns`` later, align with references (u, v, w).

    The grid of offsets is a parameter; references are repeated for each, samples are not. Cost is the mean squared
    residual of the rigid alignment of that offset; references that no two samples enclose are left out of it, and an
    offset with fewer than three is left out of the profile.
    """
    k = len(offsets_ns)
    numbered = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(int(o)).cast("long").alias("o")) for i, o in enumerate(offsets_ns)]))
    moved = reference.select(key, index, time, numbered.alias("_g")).select(key, (c(index) * k + c("_g.i")).alias(index), (c(time) + c("_g.o")).alias(time))
    at = association.interpolated(moved, sample, ["x", "y", "z"], max_gap_ns, key, time, index).where("x is not null")
    offset = F.element_at(F.array(*[F.lit(int(o)).cast("long") for o in offsets_ns]), (F.pmod(c(index), F.lit(k)) + 1).cast("int"))
    at = at.select(key, F.floor(c(index) / k).cast("long").alias(index), offset.alias("offset_ns"), "x", "y", "z")
    pairs = at.join(reference.select(key, index, "u", "v", "w"), [key, index])
    fits = alignment.rigid_fit(alignment.moments(pairs, key, "offset_ns").where("n >= 3"), key, "offset_ns")
    found = alignment.aligned(pairs, fits, key, "offset_ns")
    return found.groupBy(key, "offset_ns").agg(F.count("*").alias("n"), F.avg(c("residual_m") * c("residual_m")).alias("cost"), F.percentile("residual_m", 0.5).alias("median_m"))


def profile_summary(profile: DataFrame, *keys: str, offset: str = "offset_ns", cost: str = "cost") -> DataFrame:
    """keys, best_offset, interior, drop, separation, prominence of a curve of costs; its length is a parameter's.

    The best offset is the cheapest, the lowest of equals. Drop: from the cheaper end to the best; separation: from the
    best to the second cheapest; prominence: from the best to its cheaper neighbour, 0 at an end; all relative.
    """
    curve = profile.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(c(offset).alias("o"), c(cost).alias("c")))).alias("_a"))
    costs = F.transform("_a", lambda p: p["c"])
    curve = curve.withColumns({"_c": costs, "_s": F.array_sort(costs), "_n": F.size("_a")})
    curve = curve.withColumn("_b", F.array_position("_c", F.element_at("_s", 1)).cast("int"))
    best, at = F.element_at("_s", 1), lambda i: F.get("_c", i)
    share = lambda x, of: x / F.greatest(of, F.lit(1e-12))
    interior = (c("_b") > 1) & (c("_b") < c("_n"))
    ends = F.least(at(F.lit(0)), at(c("_n") - 1))
    beside = F.least(at(c("_b") - 2), at(c("_b")))
    return curve.select(
        *keys, F.get(F.transform("_a", lambda p: p["o"]), c("_b") - 1).alias("best_offset"), interior.alias("interior"), share(ends - best, ends).alias("drop"),
        share(F.get("_s", F.lit(1)) - best, best).alias("separation"), F.when(interior, share(beside - best, best)).otherwise(0.0).alias("prominence"),
    )


def observability(rows: DataFrame, residual: Callable[[Sequence[float]], Sequence[Column]], at: Sequence[float], steps: Sequence[float], prior_sigma: Sequence[float], *keys: str) -> DataFrame:
    """keys, n, posterior_sigma, reduction, nuisance_rank, rank: how far the rows narrow the last parameters down.

    ``residual``: whitened residuals of a row as columns, for a list of parameters. Its derivatives at ``at`` are
    central differences with ``steps``. The first parameters are nuisances and projected out; the last ones, as many as
    ``prior_sigma``, have that prior. Spark sums the products of derivatives, one row a group; a worker takes the Schur
    complement. Eigenvalues under 1e-10 of the largest count as none.
    """
    n, m = len(at), len(at) - len(prior_sigma)
    slopes: dict[str, Column] = {}
    for j, h in enumerate(steps):
        high, low = (residual([x + (s * h if i == j else 0.0) for i, x in enumerate(at)]) for s in (1, -1))
        slopes |= {f"d{j}_{k}": (a - b) / (2 * h) for k, (a, b) in enumerate(zip(high, low, strict=True))}
    parts = len(slopes) // n
    sums = [F.sum(sum((c(f"d{i}_{k}") * c(f"d{j}_{k}") for k in range(1, parts)), c(f"d{i}_0") * c(f"d{j}_0"))).alias(f"g{i}_{j}") for i in range(n) for j in range(i, n)]
    prior = np.asarray(prior_sigma, float)

    def solve(batches):  # noqa: ANN001, ANN202
        for b in batches:
            out = []
            for r in b.to_dict("records"):
                gram = np.array([[r[f"g{min(i, j)}_{max(i, j)}"] for j in range(n)] for i in range(n)], float)
                own = np.linalg.eigvalsh(gram[:m, :m])
                left = gram[m:, m:] - gram[m:, :m] @ np.linalg.pinv(gram[:m, :m], rcond=1e-10, hermitian=True) @ gram[:m, m:]
                information = left * np.outer(prior, prior)
                seen = np.linalg.eigvalsh(information)
                sigma = prior * np.sqrt(np.maximum(np.diag(np.linalg.inv(information + np.eye(n - m))), 0))
                ranks = [int((e > 1e-10 * max(e[-1], 1e-300)).sum()) for e in (own, seen)]
                out.append((*(r[k] for k in keys), r["n"], sigma.tolist(), np.clip(1 - sigma / prior, 0, 1).tolist(), *ranks))
            yield pd.DataFrame(out, columns=[*keys, "n", "posterior_sigma", "reduction", "nuisance_rank", "rank"])

    summed = rows.select(*keys, *[v.alias(k) for k, v in slopes.items()]).groupBy(*keys).agg(F.count("*").alias("n"), *sums).where("n > 0")
    return summed.mapInPandas(solve, f"{_kinds(summed, keys)}n long, posterior_sigma array<double>, reduction array<double>, nuisance_rank int, rank int")


def block_cross_validation(pairs: DataFrame, block: str, *keys: str) -> DataFrame:
    """keys, block, n, n_training, median_m, p95_m, max_m: residuals of each block under the alignment of all others.

    Moments are summed once for each block; those of a fold are the total less the block's. A fold with fewer than
    three rows to train on has null residuals.
    """
    sums = alignment.moments(pairs, *keys, block)
    added = [x for x in sums.columns if x == "n" or x.startswith("s_")]
    others = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))  # one row a block
    folds = sums.withColumns({x: F.sum(x).over(others) - c(x) for x in added})
    counts = folds.select(*keys, block, c("n").alias("n_training"))
    fits = alignment.rigid_fit(folds.where("n >= 3"), *keys, block)
    found = alignment.aligned(pairs, fits, *keys, block).groupBy(*keys, block)
    found = found.agg(F.percentile("residual_m", 0.5).alias("median_m"), F.percentile("residual_m", 0.95).alias("p95_m"), F.max("residual_m").alias("max_m"))
    own = sums.select(*keys, block, "n").join(counts, [*keys, block])
    return own.join(found, [*keys, block], "left")
