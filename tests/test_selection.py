"""Percentiles by selection against numpy, in groups of any kind of value."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracklake.operators import cloud, quality, selection


def test_percentiles_of_all_kinds_of_groups(spark):
    rng = np.random.default_rng(1)
    groups = {
        "normal": rng.normal(size=2001), "tiny and huge": np.concatenate([10.0 ** rng.uniform(-300, 300, 500), -(10.0 ** rng.uniform(-300, 300, 500))]),
        "ties": rng.integers(0, 4, 500).astype(float), "one": np.array([3.5]), "neighbours": np.nextafter(1.0, 2.0) + np.arange(100) * np.finfo(float).eps,
        "zeros": np.array([0.0, -0.0, 0.0, 5e-324, -5e-324]), "infinite": np.array([float("inf"), 1.0, 2.0, -float("inf")]), None: rng.normal(size=300),
    }
    rows = [(k, float(v)) for k, g in groups.items() for v in g] + [("normal", None), ("normal", float("nan")), ("empty", None)]
    shares = [0.0, 0.01, 0.25, 0.5, 0.95, 1.0]
    got = {r.k: r for r in selection.percentiles(spark.createDataFrame(rows, "k string, v double").repartition(6), F.col("v"), shares, "k").collect()}
    assert set(got) == {*groups, "empty"} and got["empty"].n == 0 and got["empty"].p is None
    for k, g in groups.items():
        assert got[k].n == len(g)
        if k == "infinite":
            assert got[k].p[0] == -np.inf and got[k].p[-1] == np.inf and got[k].p[3] == 1.5
        else:
            assert np.allclose(got[k].p, np.quantile(g, shares), rtol=1e-12, atol=0)


def test_summaries_equal_those_by_exact_functions(spark):
    rng = np.random.default_rng(2)
    rows = [(i % 3 if i % 7 else None, float(v), float(v) * 2, float(-v)) for i, v in enumerate(rng.normal(size=600))] + [(1, None, None, None)]
    df = spark.createDataFrame(rows, "k int, x double, y double, z double").cache()
    for new, old in ((selection.distribution(df, "x", "k"), quality.distribution(df, "x", "k")), (selection.residual_summary(df, "x", "k"), quality.residual_summary(df, "x", "k")), (selection.crop_box(df, 0.5, "k"), cloud.crop_box(df, 0.5, "k"))):
        a, b = ({r.k: r.asDict() for r in d.collect()} for d in (new, old))
        assert set(a) == set(b) and all(a[k] == pytest.approx(b[k]) for k in a)
    whole = selection.distribution(df, "x").first()
    assert whole.asDict() == pytest.approx(quality.distribution(df, "x").first().asDict())
    assert selection.percentiles(df.limit(0), F.col("x"), [0.5], "k").count() == 0


def test_state_is_bounded(spark, monkeypatch):
    """No pass keeps more counters than the bits of a pass have values, however many distinct values a group has."""
    seen = []
    keep = selection.checkpointed
    monkeypatch.setattr(selection, "checkpointed", lambda df: seen.append(df.columns) or keep(df))
    df = spark.range(200_000).select((F.col("id") / 7).alias("x"))
    out = selection.percentiles(df, F.col("x"), [0.5]).first()
    assert out.n == 200_000 and out.p == [pytest.approx(199_999 / 14)]
    assert selection.STEP == 16 and len([c for c in seen if "_prefix" in c]) == 4
