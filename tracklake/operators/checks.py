"""Gates and comparisons: long tables of checks, A/B deltas, golden values, inventories, digests, set comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def checks(df: DataFrame, keys: list[str], gates: dict[str, tuple[Column, float | None, float | None]]) -> DataFrame:
    """keys, name, value, minimum, maximum, passed: one row a gate. A null value fails."""
    cells = []
    for name, (value, low, high) in gates.items():
        v = value.cast("double")
        passed = F.lit(True)
        if low is not None:
            passed = passed & (v >= low)
        if high is not None:
            passed = passed & (v <= high)
        cells.append(F.struct(F.lit(name).alias("name"), v.alias("value"), F.lit(low).cast("double").alias("minimum"), F.lit(high).cast("double").alias("maximum"), F.coalesce(passed & ~F.isnan(v), F.lit(False)).alias("passed")))
    return df.select(*keys, F.explode(F.array(*cells)).alias("c")).select(*keys, "c.*")


def compare_arms(metrics: DataFrame, control: str, candidate: str, arm: str, metric: str, value: str, *keys: str) -> DataFrame:
    """keys, metric, control, candidate, delta of two arms."""
    on = [*keys, metric]
    a, b = (metrics.where(F.col(arm) == name).select(*on, F.col(value).alias(out)) for name, out in ((control, "control"), (candidate, "candidate")))
    return a.join(b, on).withColumn("delta", F.col("candidate") - F.col("control"))


def verify_expected(actual: DataFrame, expected: DataFrame, metric: str = "metric") -> DataFrame:
    """metric, value, passed, reason: exact value, minimum and maximum where ``expected`` has them; a missing metric fails."""
    v = F.col("value")
    reason = (
        F.when(v.isNull(), "missing")
        .when(F.col("exact").isNotNull() & (v != F.col("exact")), "not exact")
        .when(F.col("minimum").isNotNull() & (v < F.col("minimum")), "below minimum")
        .when(F.col("maximum").isNotNull() & (v > F.col("maximum")), "above maximum")
    )
    return expected.join(actual.select(metric, "value"), metric, "left").select(metric, "value", reason.isNull().alias("passed"), reason.alias("reason"))


def split_failures(checked: DataFrame, allowed: DataFrame, *keys: str) -> DataFrame:
    """Names of failed checks of each key, those on the allowed list and the others, sorted."""
    failed = checked.where("not passed").join(allowed.select("name").distinct().withColumn("_ok", F.lit(True)), "name", "left")
    pick = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(c, F.col("name")))), ",")
    return failed.groupBy(*keys).agg(pick(F.col("_ok").isNotNull()).alias("allowed"), pick(F.col("_ok").isNull()).alias("structural"))


def inventory(files: DataFrame, path: str, content: str) -> DataFrame:
    """path, size_bytes, sha256 of each file; ``content`` is binary or text."""
    data = F.col(content).cast("binary")
    return files.select(F.col(path).alias("path"), F.octet_length(data).cast("long").alias("size_bytes"), F.sha2(data, 256).alias("sha256"))


def compare_inventories(expected: DataFrame, found: DataFrame) -> DataFrame:
    """Paths that differ, and how: missing, extra, size or content."""
    e, f = (x.select("path", F.col("size_bytes").alias(f"{n}_size"), F.col("sha256").alias(f"{n}_sha")) for x, n in ((expected, "expected"), (found, "found")))
    state = F.when(F.col("found_size").isNull(), "missing").when(F.col("expected_size").isNull(), "extra").when(F.col("expected_size") != F.col("found_size"), "size").when(F.col("expected_sha") != F.col("found_sha"), "content")
    return e.join(f, "path", "full").select("path", state.alias("state")).where("state is not null")


def table_digest(df: DataFrame, *columns: str, buckets: int = 64) -> DataFrame:
    """rows and a digest of a table's rows in any order: rows, then buckets of rows, then all; no bucket is a whole large table.

    Equal rows must be told apart by a column if their number is to count.
    """
    row = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns]), 256)
    # sums of digests' leading words don't depend on order and are taken before any shuffle
    word = lambda k: F.sum(F.conv(F.substr(F.col("_d"), F.lit(1 + 8 * k), F.lit(8)), 16, 10).cast("long"))
    parts = [word(k).cast("string") for k in range(8)]
    return df.select(row.alias("_d")).agg(F.count("*").alias("n_rows"), F.sha2(F.concat_ws(",", *parts), 256).alias("digest"))


def missing_and_extra(expected: DataFrame, found: DataFrame, *keys: str) -> DataFrame:
    """Keys of one table only, with ``side``: missing or extra."""
    a, b = expected.select(*keys).distinct(), found.select(*keys).distinct()
    return a.join(b, list(keys), "left_anti").withColumn("side", F.lit("missing")).unionByName(b.join(a, list(keys), "left_anti").withColumn("side", F.lit("extra")))


def ordered_selection(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Listed rows in list order (``ordinal``); ids that are unknown or listed twice come with ``problem`` and no row."""
    n = ids.groupBy(key).agg(F.min("ordinal").alias("ordinal"), F.count("*").alias("_n"))
    out = n.join(rows.withColumn("_there", F.lit(True)), key, "left")
    problem = F.when(F.col("_n") > 1, "repeated").when(F.col("_there").isNull(), "unknown")
    return out.withColumn("problem", problem).drop("_n", "_there")


def max_difference(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Largest absolute difference of two parameter tables, and whether they hold the same keys."""
    joined = a.select(*keys, F.col(value).alias("_a")).join(b.select(*keys, F.col(value).alias("_b")), keys, "full")
    return joined.agg(F.max(F.abs(F.col("_a") - F.col("_b"))).alias("max_abs"), F.coalesce(F.bool_and(F.col("_a").isNotNull() & F.col("_b").isNotNull()), F.lit(True)).alias("same_keys"))
