"""Geometry, clouds, tiles, pairs, alignment, checks and digests."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracklake.functions import geodesy, keys, rotation, symmetric
from tracklake.operators import alignment, checks, cloud, pairs


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_geodesy(spark):
    zero = F.lit(0.0)
    at = lambda lat, lon, alt: one(spark, *geodesy.enu(F.lit(lat), F.lit(lon), F.lit(alt), zero, zero, zero))
    assert abs(at(0.0, 1e-5, 0.0)[0] - 1.1131949079327301) < 1e-8
    assert abs(at(1e-5, 0.0, 0.0)[1] - 1.1057427582159383) < 1e-8
    assert abs(at(0.0, 0.0, 2.0)[2] - 2) < 1e-8
    assert tuple(one(spark, *geodesy.ned_to_enu(F.lit(3), F.lit(4), F.lit(-2)))) == (4, 3, 2)
    d = tuple(one(spark, *geodesy.ned_to_enu_covariance(*[F.lit(float(x)) for x in (1, 0, 0, 4, 0, 9)])))
    assert (d[0], d[3], d[5]) == (4, 1, 9)


def test_slerp_half_way(spark):
    q = rotation.slerp(tuple(map(F.lit, (0.0, 0.0, 0.0, 1.0))), tuple(map(F.lit, (0.0, 0.0, math.sin(math.pi / 4), math.cos(math.pi / 4)))), F.lit(0.5))
    assert abs(math.degrees(one(spark, *rotation.to_euler(q))[2]) - 45) < 1e-9
    same = rotation.slerp(tuple(map(F.lit, (0.0, 0.0, 0.0, 1.0))), tuple(map(F.lit, (0.0, 0.0, 0.0, -1.0))), F.lit(0.3))
    assert one(spark, *same)[3] == pytest.approx(1)


def test_slerp_of_small_turns_is_even(spark):
    # a line between both ends is up to a part in 60 of the angle's third power off
    q = lambda a: (0.0, 0.0, math.sin(a), math.cos(a))
    rows = [(0.4, 0.4 + d, t) for d in (0.0, 1e-9, 1e-7, 1e-6, 2e-6, 1e-4, 0.005, 0.03, 0.0317, -0.03) for t in (0.0, 0.2, 0.5, 0.8, 1.0)]
    df = spark.createDataFrame([(*q(a), *q(b), t, a + t * (b - a)) for a, b, t in rows], "ax double, ay double, az double, aw double, bx double, by double, bz double, bw double, t double, half double")
    found = df.select(*[v.alias(n) for n, v in zip("xyzw", rotation.slerp(*[tuple(F.col(e + n) for n in "xyzw") for e in "ab"], F.col("t")), strict=True)], "half").collect()
    assert len(found) == 50 and all(abs(math.atan2(r.z, r.w) - r.half) < 3e-15 and r.x == r.y == 0 for r in found)


def test_eigenvalues(spark):
    rng = np.random.default_rng(0)
    for _ in range(5):
        m = rng.normal(size=(3, 3))
        m = m @ m.T
        got = one(spark, *symmetric.eigenvalues(tuple(F.lit(float(m[i, j])) for i, j in ((0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2)))))
        assert np.allclose(tuple(got), np.linalg.eigvalsh(m), atol=1e-9)
    assert tuple(one(spark, *symmetric.eigenvalues(tuple(F.lit(x) for x in (2.0, 0.0, 0.0, 2.0, 0.0, 2.0))))) == (2, 2, 2)


def test_names(spark):
    assert one(spark, keys.stamp_ns(F.lit("a/12-000000034.png")), keys.stamp_ns(F.lit("x")), keys.stamp_ns(F.lit("1-1234567890"))) == (12_000_000_034, None, None)
    assert one(spark, keys.frame_index(keys.frame_name(F.lit(42))), keys.safe_relative_path(F.lit("a/b")), keys.safe_relative_path(F.lit("a/../b")), keys.safe_relative_path(F.lit("/a"))) == (42, True, False, False)
    assert tuple(one(spark, *keys.pair_members(keys.pair_id(F.lit(9), F.lit(4))))) == (4, 9)


def test_z_buffer_and_holes(spark):
    px = spark.createDataFrame([(2.0, 0.0, 1.0), (2.4, 0.0, 2.0), (9.0, 0.0, 1.0), (1.0, 0.0, 0.0)], "u double, v double, z double")
    assert [tuple(r) for r in cloud.z_buffered(px, 4, 1).collect()] == [(2, 0, 1.0)]
    depth = [(u, v, 2.0 if u < 6 else 3.0) for u in range(12) for v in range(9) if u not in (2, 5, 9)]
    filled = cloud.holes_filled(spark.createDataFrame(depth, "u long, v long, z double"), 3, 0.05, 0.02).where("u between 0 and 11 and v between 0 and 8").collect()
    assert {(r.u, r.z) for r in filled} == {(2, 2.0), (9, 3.0)} and len(filled) == 18


def test_tiles(spark):
    tiles = spark.createDataFrame([(0, 0.0, 0.0, 1.0, 1.0), (1, 1.0, 0.0, 2.0, 1.0)], "tile_id int, lo_u double, lo_v double, hi_u double, hi_v double")
    p = spark.createDataFrame([(1, 1.0, 0.5), (2, 2.0, 1.0), (3, 0.0, 0.0), (4, 2.1, 0.5), (5, 0.9, 0.5)], "id int, u double, v double")
    assert {r.id: r.owner for r in cloud.tile_owner(p, tiles, 2.0, 1.0).collect()} == {1: 1, 2: 1, 3: 0, 4: -1, 5: 0}
    assert [tuple(r) for r in cloud.seam_segments(tiles, 0.0, 0.0, 2.0, 1.0).collect()] == [(1.0, 0.0, 1.0, 1.0)]
    assert {(r.tile_id, r.neighbour, r.edge) for r in cloud.adjacent_tiles(tiles).collect()} == {(0, 1, 1.0), (1, 0, 1.0)}
    w = cloud.tile_weights(p, tiles, 0.25).groupBy("id").agg(F.sum("weight").alias("s")).collect()
    assert all(abs(r.s - 1) < 1e-12 for r in w if r.id != 4)


def test_voxels_keep_the_first_point(spark):
    p = spark.createDataFrame([(3, 0.1, 0.1, 0.1), (1, 0.2, 0.2, 0.2), (2, -0.1, 0.0, 0.0)], "id int, x double, y double, z double")
    assert sorted(r.id for r in cloud.voxel_first(p, 1.0, "id").collect()) == [1, 2]
    assert cloud.hash_sample(p, 2, "id").count() == 2


def test_pair_decisions(spark):
    def decide(gap, displacement, std=0.01, matches=0, same=False, stereo=False):
        kept, reason = pairs.pair_decision(pairs.PairPolicy(), F.lit(same), F.lit(stereo), F.lit(gap), F.lit(100.0 * gap), F.lit(std), F.lit(std), F.lit(displacement), F.lit(0.0), F.lit(matches))
        return tuple(one(spark, kept, reason))

    assert decide(50, 5.0) == (False, "nonlocal_gnss_incompatible")
    assert decide(50, 0.25, matches=500) == (True, "strong_locally_consistent_track")
    assert decide(0, 50.0, same=True, stereo=True) == (True, "same_frame_stereo")
    assert decide(1, 50.0) == (True, "adjacent_or_nearby_temporal")
    assert decide(50, 0.25, std=None) == (False, "nonlocal_gnss_untrusted")


def test_components_of_chains(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(40)] + [(100 + rng.randrange(30), 100 + rng.randrange(30)) for _ in range(25)]
    parent = {x: x for p in links for x in p}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for p, q in links:
        p, q = find(p), find(q)
        parent[max(p, q)] = min(p, q)
    linked = {x for p in links for x in p if p[0] != p[1]}
    got = pairs.connected_components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()
    assert {r.node: r.root for r in got} == {x: find(x) for x in linked}


def test_rigid_fit_recovers_a_motion(spark):
    rng = np.random.default_rng(1)
    rows, truth = [], {}
    for g in range(3):
        q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
        q *= np.sign(np.linalg.det(q))
        t = rng.normal(size=3) * 10
        truth[g] = (q, t)
        for p in rng.normal(size=(30, 3)) * 5:
            rows.append((g, *map(float, p), *map(float, q @ p + t)))
    df = spark.createDataFrame(rows, "g int, x double, y double, z double, u double, v double, w double")
    fit = alignment.rigid_fit(alignment.moments(df, "g"), "g")
    for r in fit.collect():
        assert np.allclose(np.reshape(r.rotation, (3, 3)), truth[r.g][0], atol=1e-8) and np.allclose(r.translation, truth[r.g][1], atol=1e-8)
        assert r["rank"] == 3 and abs(r.scale - 1) < 1e-9
    assert alignment.aligned(df, fit, "g").agg(F.max("residual_m")).first()[0] < 1e-8


def test_expected_values(spark):
    actual = spark.createDataFrame([("a", 1.0), ("b", 5.0)], "metric string, value double")
    expected = spark.createDataFrame([("a", 1.0, None, None), ("b", None, 0.0, 4.0), ("c", None, None, None)], "metric string, exact double, minimum double, maximum double")
    assert {r.metric: r.reason for r in checks.verify_expected(actual, expected).collect()} == {"a": None, "b": "above maximum", "c": "missing"}


def test_digest_ignores_order(spark):
    df = spark.createDataFrame([(i, str(i)) for i in range(100)], "a int, b string")
    one_, two = checks.table_digest(df, "a", "b").first(), checks.table_digest(df.orderBy(F.desc("a")).repartition(7), "a", "b").first()
    assert one_ == two and checks.table_digest(df.where("a > 0"), "a", "b").first() != one_
