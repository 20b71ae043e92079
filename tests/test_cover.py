"""Cell covers of boxes and frusta against every point with every box or view."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracklake.operators import cloud, cover

TILE = "tile_id int, lo_u double, lo_v double, hi_u double, hi_v double"


def test_points_in_boxes_of_all_sizes(spark):
    rng = np.random.default_rng(1)
    corner, size = rng.uniform(-50, 50, (120, 2)), 2.0 ** rng.integers(-12, 7, (120, 2)) * rng.choice([1.0, 0.7], (120, 2))
    size[:5], size[5:8, 0] = 0.0, 0.0  # points and lines
    boxes = [(i, *map(float, corner[i]), *map(float, corner[i] + size[i])) for i in range(120)] + [(500, 1.0, 1.0, 0.0, 2.0)]
    points = [(i, *map(float, p)) for i, p in enumerate(rng.uniform(-60, 60, (400, 2)))]
    points += [(1000 + i, float(corner[i, 0]), float(corner[i, 1])) for i in range(60)] + [(2000 + i, boxes[i][3], boxes[i][4]) for i in range(60)]
    points += [(3000, None, 1.0), (3001, float("nan"), 1.0), (3002, 1e300, -1e300)]
    p = spark.createDataFrame(points, "id long, u double, v double")
    got = sorted(tuple(r) for r in cover.in_boxes(p, spark.createDataFrame(boxes, TILE)).select("id", "tile_id").collect())
    expected = sorted((i, b[0]) for i, u, v in points for b in boxes if u is not None and b[1] <= u <= b[3] and b[2] <= v <= b[4])
    assert got == expected and len(expected) > 250
    assert cover.in_boxes(p, spark.createDataFrame([], TILE)).count() == 0


def grid(n, step):
    return [(i * n + j, i * step, j * step, (i + 1) * step, (j + 1) * step) for i in range(n) for j in range(n)]


def test_owners_among_a_hundred_thousand_tiles(spark):
    n, step = 317, 0.5
    tiles = spark.createDataFrame(grid(n, step), TILE)
    rng = np.random.default_rng(2)
    points = [(i, *map(float, p)) for i, p in enumerate(rng.uniform(-1, n * step + 1, (3000, 2)))]
    points += [(5000 + k, k * step, k * step) for k in range(n + 1)] + [(9000, None, 0.0), (9001, n * step, 3.25)]
    p = spark.createDataFrame(points, "id long, u double, v double")
    out = cloud.tile_owner(p, tiles, n * step, n * step)
    assert out.columns == ["id", "u", "v", "owner", "problem"] and out.count() == len(points)
    end = n * step
    for r in out.collect():
        cell = lambda x: -1 if x is None or x < 0 or x > end else min(int(x / step), n - 1)
        a, b = cell(r.u), cell(r.v)
        assert r.problem is None and r.owner == (a * n + b if a >= 0 and b >= 0 else -1)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_a_point_in_two_cores_is_told(spark):
    tiles = spark.createDataFrame([(7, 0.0, 0.0, 2.0, 1.0), (3, 1.0, 0.0, 3.0, 1.0), (9, 0.25, 0.25, 0.5, 0.5)], TILE)
    p = spark.createDataFrame([(1, 1.5, 0.5), (2, 0.75, 0.75), (3, 0.3, 0.3), (4, 1.0, 0.0), (5, 2.0, 0.5), (5, 2.0, 0.5), (6, 9.0, 9.0)], "id long, u double, v double")
    got = sorted((r.id, r.owner, r.problem) for r in cloud.tile_owner(p, tiles, 3.0, 1.0).collect())
    assert got == [(1, 3, "several"), (2, 7, None), (3, 7, "several"), (4, 3, "several"), (5, 3, None), (5, 3, None), (6, -1, None)]


def test_weights_and_bands_of_many_tiles(spark):
    tiles = spark.createDataFrame(grid(20, 1.0), TILE)
    rng = np.random.default_rng(3)
    points = [(i, *map(float, p)) for i, p in enumerate(rng.uniform(0, 20, (300, 2)))]
    p = spark.createDataFrame(points, "id long, u double, v double")
    total = cloud.tile_weights(p, tiles, 0.3).groupBy("id").agg(F.sum("weight").alias("w")).collect()
    assert len(total) == 300 and all(r.w == pytest.approx(1) for r in total)
    band = {r.id: r.distance for r in cloud.seam_band(p, cloud.seam_segments(tiles, 0.0, 0.0, 20.0, 20.0), 0.2, "id").collect()}
    inner = lambda x: min(abs(x - k) for k in range(1, 20))
    for i, u, v in points:
        d = min(inner(u), inner(v))
        assert band.get(i) == (pytest.approx(d) if d <= 0.2 else None)


@pytest.mark.parametrize(("n", "leaf", "far"), [(3000, 20, None), (3000, 400, 6.0), (1, 512, None)])
def test_frusta_meet_the_same_spheres_by_an_octree(spark, n, leaf, far):
    rng = np.random.default_rng(n + leaf)
    spheres = [(i, *map(float, rng.normal(size=3) * 8), float(2.0 ** rng.uniform(-9, -1))) for i in range(n)]
    spheres += [(n + k, *map(float, rng.normal(size=3) * 20), float(2.0**k)) for k in range(4)] + [(9001, None, 0.0, 0.0, 1.0), (9002, float("nan"), 0.0, 0.0, 1.0), (9003, 0.0, 0.0, 0.0, float("inf"))]
    views = []
    for v in range(12):
        q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
        views.append((v, *map(float, np.column_stack([q, rng.normal(size=3) * 5]).ravel()), 100.0, 120.0, 64.0, 48.0, 128, 96))
    names = ", ".join(f"m{k} double" for k in range(12))
    s = spark.createDataFrame(spheres, "id long, x double, y double, z double, radius double")
    w = spark.createDataFrame(views, f"view int, {names}, fx double, fy double, cx double, cy double, width int, height int")
    clean = s.where("id < 9000")
    expected = sorted(tuple(r) for r in clean.crossJoin(w).where(cover._reaches(0.2, far, F.col("radius"))).select("view", "id").collect())
    got = sorted(tuple(r) for r in cover.in_frustum(s, w, 0.2, far, leaf).select("view", "id").collect())
    assert got == expected
    tested = cover.frustum_candidates(s, w, 0.2, far, leaf).count()
    assert tested >= len(expected)
    if leaf == 20:
        assert tested < 0.5 * 12 * n  # far fewer than every view with every sphere
    assert cover.in_frustum(s.limit(0), w, 0.2).count() == 0


def test_overlapping_boxes_of_all_sizes_are_found_once(spark):
    rng = np.random.default_rng(4)
    corner, size = rng.uniform(-20, 20, (150, 2)), 2.0 ** rng.integers(-6, 5, (150, 2)) * rng.choice([1.0, 0.6], (150, 2))
    boxes = [(i, *map(float, corner[i]), *map(float, corner[i] + size[i])) for i in range(150)]
    boxes += [(900 + i, float(i), 30.0, float(i + 1), 31.0) for i in range(8)] + [(990, 2.0, 30.0, 2.0, 31.0), (991, 0.0, 30.0, 0.5, 31.0)]
    got = [tuple(r) for r in cover.overlapping_pairs(spark.createDataFrame(boxes, TILE), "tile_id").collect()]
    meets = lambda p, q: all(max(p[k], q[k]) < min(p[k + 2], q[k + 2]) for k in (1, 2))
    expected = {(p[0], q[0]) for p in boxes for q in boxes if p[0] < q[0] and meets(p, q)}
    assert len(got) == len(set(got)) and set(got) == expected and len(expected) > 150 and (900, 991) in expected
    assert cover.overlapping_pairs(spark.createDataFrame([], TILE), "tile_id").count() == 0
