"""Greedy selections and robust alignment."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracklake.operators import planning, robust


def test_bounded_degree(spark):
    edges = [(1, 2, 1.0), (2, 3, 2.0), (1, 3, 3.0), (3, 4, 4.0), (2, 4, 5.0), (1, 4, 6.0)]
    df = spark.createDataFrame([(s, *e) for s in ("a", "b") for e in edges], "segment_id string, a long, b long, rank double")
    got = [(r.a, r.b, r.reason) for r in planning.bounded_degree_edges(df, 2).collect() if r.segment_id == "a"]
    assert got == [(1, 2, "connectivity"), (2, 3, "connectivity"), (3, 4, "connectivity"), (1, 4, "candidate")]


def restated(edges, max_degree, max_edges=None):
    """The two passes, edge by edge, over sets of nodes that hang together."""
    groups, degree, taken, rest = {}, {}, [], []
    for rank, a, b in sorted({(min(r for r, x, y in edges if (x, y) == (a, b)), a, b) for _, a, b in edges}):
        if groups.get(a, {a}) == groups.get(b, {b}):
            rest.append((a, b))
        elif max(degree.get(a, 0), degree.get(b, 0)) < max_degree:
            whole = groups.get(a, {a}) | groups.get(b, {b})
            groups.update({n: whole for n in whole})
            degree[a], degree[b] = degree.get(a, 0) + 1, degree.get(b, 0) + 1
            taken.append((a, b, "connectivity"))
    for a, b in rest:
        if max(degree[a], degree[b]) < max_degree and (max_edges is None or len(taken) < max_edges):
            degree[a], degree[b] = degree[a] + 1, degree[b] + 1
            taken.append((a, b, "candidate"))
    return sorted(taken)


@pytest.mark.parametrize("max_edges", [None, 14, 0])
def test_bounded_degree_as_restated(spark, max_edges):
    rng = random.Random(max_edges)
    rows = {s: [(float(rng.randrange(8)), *sorted(rng.sample(range(14), 2))) for _ in range(70)] for s in ("a", "b", None)}
    df = spark.createDataFrame([(s, a, b, r) for s, edges in rows.items() for r, a, b in edges], "segment_id string, a long, b long, rank double")
    found = planning.bounded_degree_edges(df, 3, max_edges).collect()
    for s, edges in rows.items():
        assert sorted((r.a, r.b, r.reason) for r in found if r.segment_id == s) == restated(edges, 3, max_edges)
    assert planning.bounded_degree_edges(df.limit(0), 3).count() == 0


def test_coverage_takes_the_most_new_cells(spark):
    rows = [(0, 1, c) for c in "ab"] + [(0, 2, c) for c in "bcd"] + [(0, 3, c) for c in "cdef"] + [(0, 4, c) for c in "ef"]
    cells = spark.createDataFrame(rows, "tile_id int, frame long, cell string")
    chosen = spark.createDataFrame([(0, 1)], "tile_id int, frame long")
    assert [r.frame for r in planning.completed_coverage(cells, chosen, 1.0, 9).collect()] == [3]
    assert planning.completed_coverage(cells, chosen, 0.3, 9).count() == 0
    assert planning.completed_coverage(cells, chosen, 1.0, 1).count() == 0
    r = planning.coverage_ratio(cells, chosen).first()
    assert (r.total, r.covered) == (6, 2)


def test_tiles_respect_the_bound_and_cover(spark):
    rng = np.random.default_rng(0)
    cells = spark.createDataFrame([(f, float(x), float(y)) for f in range(40) for x, y in rng.normal([f % 8, f // 8], 0.3, (12, 2))], "frame long, u double, v double").cache()
    policy = planning.SplitPolicy(max_frames=18, halo=0.2)
    cores = planning.split_tiles(cells, policy)
    assert len(cores) > 1 and cores == planning.split_tiles(cells, policy)
    points = [(r.frame, r.u, r.v) for r in cells.collect()]
    for u0, v0, u1, v1 in cores:
        assert len({f for f, u, v in points if u0 - 0.2 <= u <= u1 + 0.2 and v0 - 0.2 <= v <= v1 + 0.2}) <= 18
    assert all(sum(u0 <= u < u1 and v0 <= v < v1 for u0, v0, u1, v1 in cores) == 1 for _, u, v in points)


def test_robust_alignment_ignores_outliers(spark):
    rng = np.random.default_rng(3)
    q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    q *= np.sign(np.linalg.det(q))
    rows = []
    for i, p in enumerate(rng.normal(size=(80, 3)) * 4):
        target = q @ p + [1, 2, 3] + (rng.normal(size=3) * 20 if i % 4 == 0 else rng.normal(size=3) * 0.001)
        rows.append((i, *map(float, p), *map(float, target), "holdout" if i % 5 == 0 else "calibration"))
    df = spark.createDataFrame(rows, "id long, x double, y double, z double, u double, v double, w double, role string").cache()
    r = robust.robust_alignment(df, F.lit(0.1), hypotheses=64).first()
    assert r.n_inliers == 60 and np.allclose(np.reshape(r.rotation, (3, 3)), q, atol=1e-3) and np.allclose(r.translation, [1, 2, 3], atol=1e-2)
    held = robust.held_out_alignment(df, "role", F.lit(0.1), hypotheses=64).where("role = 'holdout' and id % 4 <> 0")
    assert held.agg(F.max("residual_m")).first()[0] < 0.01
    assert robust.robust_alignment(df.where("id < 2"), F.lit(0.1)).count() == 0


def aligned_one_by_one(rows, marks, limit, weights, hypotheses, refits, seed):
    """One pair set, one hypothesis after the other, with plain numpy."""
    order = np.argsort(marks, kind="stable")
    weights = weights / weights.mean()
    samples = [np.arange(len(rows)), *(order[at] for at in robust.draws(len(rows), hypotheses, seed))]

    def errors(fit):
        return np.linalg.norm(rows[:, 3:] - rows[:, :3] @ fit[0].T - fit[1], axis=1)

    best = None
    for at in samples:
        if (fit := robust.weighted_rigid(rows[at], weights[at])) is None:
            continue
        inside = errors(fit) <= limit
        if inside.sum() >= 3:
            e = (errors(fit) / limit)[inside]
            score = (inside.sum(), -np.median(e), -np.mean(e))
            if best is None or score > best[0]:
                best = score, inside
    inside = best[1]
    for _ in range(refits):
        now = errors(robust.weighted_rigid(rows[inside], weights[inside])) <= limit
        if now.sum() < 3 or (now == inside).all():
            break
        inside = now
    return robust.weighted_rigid(rows[inside], weights[inside]), int(inside.sum())


@pytest.mark.parametrize(("seed", "n", "block"), [(0, 40, 7), (1, 300, 64), (2, 700, 8192)])
def test_robust_alignment_equals_its_sequential_restatement(spark, monkeypatch, seed, n, block):
    monkeypatch.setattr(robust, "BLOCK", block)
    rng = np.random.default_rng(seed)
    rows = []
    for key in range(3):
        q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
        q *= np.sign(np.linalg.det(q))
        for i in range(n + 20 * key):
            spread = rng.uniform(0.01, 0.3, 3)
            p = rng.normal(size=3) * 4
            off = rng.normal(size=3) * (9 if i % (2 + key) == 0 else 0)
            rows.append((key, i, *map(float, p), *map(float, q @ p + [key, 2, 3] + rng.normal(size=3) * spread + off), *map(float, spread**2)))
    schema = "key int, id long, x double, y double, z double, u double, v double, w double, xx double, yy double, zz double"
    df = spark.createDataFrame(rows, schema).repartition(5).cache()
    zero = F.lit(0.0)
    limit, weight = robust.pair_limits((F.col("xx"), zero, zero, F.col("yy"), zero, F.col("zz")), 0.15)
    got = {r.key: r for r in robust.robust_alignment(df, limit, "key", weight=weight, hypotheses=60, seed=seed).collect()}
    one = robust.robust_alignment(df.where("key = 1"), limit, weight=weight, hypotheses=60, seed=seed).first()
    assert np.allclose(one.rotation, got[1].rotation, atol=1e-12) and one.n_inliers == got[1].n_inliers
    table = df.select("*", limit.alias("limit"), weight.alias("weight"), F.xxhash64("id", *"xyzuvw", F.lit(seed)).alias("mark")).toPandas()
    assert np.allclose(table["limit"], np.maximum(0.15, 3 * np.sqrt(table[["xx", "yy", "zz"]].max(axis=1)))) and np.allclose(table["weight"], 1 / table[["xx", "yy", "zz"]].sum(axis=1))
    for key, own in table.groupby("key"):
        fit, inliers = aligned_one_by_one(own[[*"xyzuvw"]].to_numpy(), own["mark"].to_numpy(), own["limit"].to_numpy(), own["weight"].to_numpy(), 60, 3, seed)
        assert got[key].n_inliers == inliers
        assert np.allclose(np.reshape(got[key].rotation, (3, 3)), fit[0], atol=1e-9) and np.allclose(got[key].translation, fit[1], atol=1e-8)


def test_hypotheses_that_tie_by_other_inliers_are_told_apart_by_their_medians(spark):
    """Two rigid groups of as many pairs: the tighter one is taken, whichever is drawn first."""
    rng = np.random.default_rng(8)
    rows = []
    for i in range(40):
        p = rng.normal(size=3) * 3
        moved = p + ([50, 0, 0] if i % 2 else [0, -50, 0]) + rng.normal(size=3) * (0.001 if i % 2 else 0.02)
        rows.append((i, *map(float, p), *map(float, moved)))
    df = spark.createDataFrame(rows, "id long, x double, y double, z double, u double, v double, w double")
    r = robust.robust_alignment(df, F.lit(0.5), hypotheses=200).first()
    assert r.n_inliers == 20 and np.allclose(r.translation, [50, 0, 0], atol=0.01)


def test_pairs_in_a_line_or_too_few_have_no_alignment(spark):
    line = [(i, 1.0 * i, 0.0, 0.0, 1.0 * i, 1.0, 0.0) for i in range(9)] + [(10, None, 0.0, 0.0, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(line, "id long, x double, y double, z double, u double, v double, w double")
    assert robust.robust_alignment(df, F.lit(1.0)).count() == 0 and robust.robust_alignment(df.limit(0), F.lit(1.0)).count() == 0


def split_one_by_one(cells, policy):
    """The tile with the most frames first, every cut counted from the cells."""
    rows = np.array(cells)

    def frames(box, halo):
        f, u, v = rows.T
        return set(f[(u >= box[0] - halo) & (u <= box[2] + halo) & (v >= box[1] - halo) & (v <= box[3] + halo)])

    def core(box):
        f, u, v = rows.T
        return set(f[(u >= box[0]) & (u < box[2]) & (v >= box[1]) & (v < box[3])])

    m = policy.margin
    cores = [(rows[:, 1].min() - m, rows[:, 2].min() - m, rows[:, 1].max() + m, rows[:, 2].max() + m)]
    while True:
        counts = [len(frames(c, policy.halo)) for c in cores]
        k = int(np.argmax(counts))
        if counts[k] <= policy.max_frames:
            return sorted(cores, key=lambda c: (c[1], c[0], c[3], c[2]))
        lo_u, lo_v, hi_u, hi_v = cores[k]
        f, u, v = rows.T
        own = (u >= lo_u) & (u < hi_u) & (v >= lo_v) & (v < hi_v)
        scored = []
        for axis, values in enumerate((u[own], v[own])):
            for share in (0.15 + 0.7 * j / (policy.cuts - 1) for j in range(policy.cuts)):
                x = float(np.percentile(values, 100 * share, method="linear"))
                if not cores[k][axis] + 1e-6 < x < cores[k][axis + 2] - 1e-6:
                    continue
                a, b = ((lo_u, lo_v, x, hi_v), (x, lo_v, hi_u, hi_v)) if axis == 0 else ((lo_u, lo_v, hi_u, x), (lo_u, x, hi_u, hi_v))
                p, q = frames(a, policy.halo), frames(b, policy.halo)
                if min(len(core(a)), len(core(b))) >= policy.min_core_frames:
                    most = max(len(p), len(q))
                    scored.append((max(0, most - policy.max_frames), most, abs(len(p) - len(q)), len(p & q), axis, round(x, 9), a, b))
        best = min(scored, key=lambda r: r[:6])
        cores[k : k + 1] = best[6:]


@pytest.mark.parametrize(("seed", "most"), [(1, 14), (2, 10)])
def test_split_gives_the_cores_of_the_sequential_one(spark, seed, most):
    rng = np.random.default_rng(seed)
    cells = []
    for f in range(40):
        at = rng.uniform(0, 20, 2)
        cells += {(f, *map(float, np.floor(2 * (at + rng.normal(size=2) * 0.8)) / 2)) for _ in range(25)}
    policy = planning.SplitPolicy(max_frames=most, halo=0.5, min_core_frames=2)
    got = planning.split_tiles(spark.createDataFrame(cells, "frame int, u double, v double"), policy)
    expected = split_one_by_one(cells, policy)
    assert len(got) == len(expected) > 3 and np.allclose(got, expected, atol=1e-9)


def test_split_that_has_no_cut_or_too_few_tiles_raises(spark):
    same = spark.createDataFrame([(f, 1.0, 1.0) for f in range(9)], "frame int, u double, v double")
    with pytest.raises(ValueError, match="no cut"):
        planning.split_tiles(same, planning.SplitPolicy(max_frames=4, halo=0.1))
    line = spark.createDataFrame([(f, float(f), 0.0) for f in range(40)], "frame int, u double, v double")
    with pytest.raises(ValueError, match="too many"):
        planning.split_tiles(line, planning.SplitPolicy(max_frames=3, halo=0.1, max_tiles=4))


def test_split_says_where_no_split_can_be(spark):
    crowd = [(f, 1.0, 1.0) for f in range(9)] + [(f, float(f), 5.0) for f in range(9)]
    with pytest.raises(ValueError, match="no split can be: 9 frames see the place 1.0, 1.0, 6 may be in a tile"):
        planning.split_tiles(spark.createDataFrame(crowd, "frame int, u double, v double"), planning.SplitPolicy(max_frames=6, halo=0.1))


def test_coverage_equals_the_greedy_one_by_one(spark):
    rng = random.Random(6)
    rows = sorted({(t, rng.randrange(40), f"c{rng.randrange(200)}") for t in range(4) for _ in range(900)} | {(9, 1, "only")})
    chosen = [(t, f) for t in range(4) for f in (3, 7, 99)]
    cells, picked = spark.createDataFrame(rows, "tile_id int, frame int, cell string"), spark.createDataFrame(chosen, "tile_id int, frame int")
    for share, most in ((0.97, 40), (1.0, 9), (0.2, 40)):
        got = {(r.tile_id, r.frame) for r in planning.completed_coverage(cells, picked, share, most).collect()}
        expected = set()
        for t in {r[0] for r in rows}:
            own = {}
            for a, f, c in rows:
                if a == t:
                    own.setdefault(f, set()).add(c)
            taken = [f for a, f in chosen if a == t]
            total, seen = len(set().union(*own.values())), set().union(*(own.get(f, set()) for f in taken))
            n = len(taken)
            while n < most and len(seen) < share * total - 1e-12:
                gain, f = min(((-len(s - seen), f) for f, s in own.items() if f not in taken), default=(0, None))
                if not gain:
                    break
                expected.add((t, f))
                seen |= own[f]
                n += 1
        assert got == expected
