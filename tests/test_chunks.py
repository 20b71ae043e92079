"""Scans over ranges of rows against the scans over whole keys, and against plain Python."""

import math
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tracklake.operators import association, chunks, quality, series

SCHEMA = "segment_id long, row_id long, t_ns long, x double, y double, v double, flag boolean"
ORDER = ["t_ns", "row_id"]


def recordings(seed, n=1500):
    """One key with most rows, some short ones, one of a single row, a null key; times tie."""
    rng = random.Random(seed)
    keys = [1] * n + [rng.randrange(2, 9) for _ in range(150)] + [20] + [None] * 30
    rows = [(k, i, rng.randrange(n // 2), round(rng.gauss(0, 2), 3), round(rng.gauss(0, 2), 3), rng.choice([None, None, None, round(rng.random(), 3)]), rng.random() < 0.9) for i, k in enumerate(keys)]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(recordings(7), SCHEMA).repartition(5).cache()


def same(a, b, columns):
    rows = lambda df: sorted([tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*columns).collect()], key=repr)
    assert rows(a) == rows(b)


def test_one_key_is_dealt_to_many_chunks(spark, table):
    c = chunks.chunked(table.where("segment_id = 1"), ["segment_id"], ORDER, 8)
    sizes = [r.n for r in c.rows.groupBy("_chunk").agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 8 and max(sizes) < 400
    spans = c.rows.groupBy("_chunk").agg(F.min(F.struct(*ORDER)).alias("a"), F.max(F.struct(*ORDER)).alias("b")).orderBy("_chunk").collect()
    assert all(tuple(p.b) < tuple(q.a) for p, q in zip(spans, spans[1:], strict=False))


@pytest.mark.parametrize("n", [1, 3, 11])
def test_neighbours_sums_and_known_values(spark, table, n):
    w = Window.partitionBy("segment_id").orderBy(*ORDER)
    c = chunks.chunked(table, ["segment_id"], ORDER, n)
    c = chunks.with_neighbour(chunks.with_neighbour(c, ["v"]), ["v"], "_after", ahead=True)
    c = chunks.with_running(c, F.col("row_id"), "total")
    c = chunks.with_known(chunks.with_known(c, F.col("v").isNotNull(), ["v"], "a"), F.col("v").isNotNull(), ["v"], "b", ahead=True)
    got = c.rows.select("segment_id", "row_id", "_before.row_id", "_before.v", "_after.row_id", "total", "a.v", "b.v").toDF(*"kirvstab")
    first = F.first("v", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    expected = table.select("segment_id", "row_id", F.lag("row_id").over(w), F.lag("v").over(w), F.lead("row_id").over(w), F.sum("row_id").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.last("v", ignorenulls=True).over(w), first).toDF(*"kirvstab")
    same(got, expected, list("kirvstab"))


def test_scans_equal_those_over_whole_keys(spark, table, monkeypatch):
    monkeypatch.setattr(chunks, "BLOCK", 64)
    w = series.ordered("segment_id", *ORDER)
    same(chunks.sample_by_distance(table, 20.0, "segment_id", ORDER, "x", "y"), series.sample_by_distance(table, 20.0, w, "x", "y"), ["segment_id", "row_id", "path_m"])
    turned = table.withColumn("a", F.atan2("y", "x"))
    same(chunks.unwrapped(turned, "segment_id", ORDER, "a", "out"), series.unwrapped(turned, w, "a", "out"), ["segment_id", "row_id", "out"])
    same(chunks.gaps_filled(table, "segment_id", ORDER, "v", "out"), series.gaps_filled(table, w, "v", "out"), ["segment_id", "row_id", "out"])
    same(chunks.runs(table, "flag", "segment_id", ORDER, "row_id"), quality.runs(table, "flag", "segment_id", *ORDER), ["segment_id", "flag", "first_index", "last_index", "n"])
    for steps in (5, 40):
        new, old = chunks.path_windows(table, "segment_id", ORDER, steps, ("x", "y"), ("x",), 0.5, 0.3), series.path_windows(table, w, steps, ("x", "y"), ("x",), 0.5, 0.3)
        same(new, old, ["segment_id", "row_id", "prior_m", "refined_m", "failed"])


def test_tables_without_rows(spark, table):
    none = table.limit(0)
    assert chunks.sample_by_distance(none, 1.0, "segment_id", ORDER, "x").count() == 0
    assert chunks.gaps_filled(none, "segment_id", ORDER, "v", "out").count() == 0
    assert chunks.runs(none, "flag", "segment_id", ORDER, "row_id").count() == 0
    assert association.one_to_one(none, none, 5).count() == association.nearest(none, none, None).count() == 0


def test_unbounded_associations_of_one_long_recording(spark, table):
    rows = [r for r in table.where("segment_id = 1").collect()]
    a, b = table.where("row_id % 3 = 0"), table.where("row_id % 3 = 1")
    ref, smp = sorted((r.t_ns, r.row_id) for r in rows if r.row_id % 3 == 0), sorted((r.t_ns, r.row_id) for r in rows if r.row_id % 3 == 1)
    for r in association.nearest(a, b, None).where("segment_id = 1").collect():
        below, above = max((s for s in smp if s[0] < r.t_ns), default=None), min((s for s in smp if s[0] >= r.t_ns), default=None)
        best = below if below and (not above or r.t_ns - below[0] <= above[0] - r.t_ns) else above
        assert (r.sample_t_ns, r.sample_index) == best
    met = {r.row_id: r for r in association.bracket(a, b).where("segment_id = 1").collect()}
    for t, i in ref:
        low, high = [s for s, _ in smp if s <= t], [s for s, _ in smp if s >= t]
        r = met[i]
        assert (r.lower_t_ns, r.upper_t_ns) == ((max(low), min(high)) if low and high else (None, None))
    good = {r.row_id: r.flag for r in rows}
    got = {r.row_id: r.supported for r in association.supported(a, b, F.col("flag"), 6, 9).where("segment_id = 1").collect()}
    for t, i in ref:
        low, high = [s for s in smp if s[0] <= t - 6], [s for s in smp if s[0] >= t + 9]
        if not low or not high:
            assert not got[i]
        elif len({s[0] for s in smp}) == len(smp):
            assert got[i] == all(good[k] for s, k in smp if max(low) <= (s, k) <= min(high))


@pytest.mark.parametrize(("seed", "interval", "spread_over"), [(1, 40, 9_000), (2, 3, 9_000), (3, 700, 6_000), (4, 90, 90_000_000), (5, 9_000, 6_000), (6, 0, 50)])
def test_decimation_without_gaps_is_many_tasks(spark, seed, interval, spread_over):
    """the state passes over groups of intervals, wherever the gaps are."""
    rng = random.Random(seed)
    rows = [(rng.choice([1, 1, 1, 2, None]), i, rng.randrange(-spread_over, spread_over)) for i in range(1200)] + [(3, 9000 + i, t) for i, t in enumerate([5, 5, 5])]
    if seed == 2:
        rows += [(4, 10_000 + i, 5 * i + (i % 7 > 2)) for i in range(900)]  # steps about the interval
    expected, last = [], {}
    for k, i, t in sorted(rows, key=lambda r: (r[2], r[1])):
        if k not in last or t - last[k] >= interval:
            expected.append((k, i, t))
            last[k] = t
    out = series.decimated(spark.createDataFrame(rows, "segment_id long, row_id long, t_ns long"), interval, "segment_id", "t_ns", "row_id")
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(map(repr, expected))
    if seed == 1:
        assert out.where("segment_id = 1").select(F.spark_partition_id()).distinct().count() > 1


def test_decimation_and_one_to_one_of_one_long_recording(spark, table):
    rows = sorted((r.t_ns, r.row_id) for r in table.where("segment_id = 1").collect())
    last, expected = -math.inf, []
    for t, i in rows:
        if t - last >= 7:
            expected.append(i)
            last = t
    assert sorted(r.row_id for r in series.decimated(table, 7, "segment_id", "t_ns", "row_id").where("segment_id = 1").collect()) == sorted(expected)
    ref, smp = [r for r in rows if r[1] % 3 == 0], [r for r in rows if r[1] % 3 == 1]
    a = b = 0
    pairs = []
    while a < len(ref) and b < len(smp):
        d = smp[b][0] - ref[a][0]
        if abs(d) <= 2:
            pairs.append((ref[a][1], smp[b][1]))
        a, b = a + (d >= -2), b + (d <= 2)
    got = association.one_to_one(table.where("row_id % 3 = 0"), table.where("row_id % 3 = 1"), 2).where("segment_id = 1").collect()
    assert sorted((r.row_id, r.sample_index) for r in got) == sorted(pairs)
