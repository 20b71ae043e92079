"""Readers and writers of trajectories, pairs and streams in text and Parquet."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracklake.functions import rotation
from tracklake.functions.keys import stamp_ns
from tracklake.operators.scans import spread

_POSE = "tx double, ty double, tz double, qx double, qy double, qz double, qw double"


def ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """file, t_ns and pose of CSV lines ``sec-nsec,tx,ty,tz,qx,qy,qz,qw``."""
    rows = spark.read.schema(f"stamp string, {_POSE}").csv(path, comment="#", ignoreLeadingWhiteSpace=True)
    return rows.select(F.col("_metadata.file_name").alias("file"), stamp_ns(F.col("stamp")).alias("t_ns"), *_POSE.replace(" double", "").split(", "))


def timed_poses(spark: SparkSession, path: str) -> DataFrame:
    """file, t_ns and pose of text lines of eight numbers: seconds, position, quaternion; ``#`` begins a comment."""
    rows = spark.read.schema(f"seconds string, {_POSE}").option("comment", "#").csv(path, sep=" ", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    return rows.select(F.col("_metadata.file_name").alias("file"), seconds_ns(F.col("seconds")).alias("t_ns"), *_POSE.replace(" double", "").split(", "))


def seconds_ns(text: Column) -> Column:
    """Nanoseconds of decimal seconds, exact: the text never becomes a float."""
    whole, part = F.split_part(text, F.lit("."), F.lit(1)), F.split_part(text, F.lit("."), F.lit(2))
    return whole.cast("long") * 1_000_000_000 + F.rpad(part, 9, "0").cast("long")


def pose_model(spark: SparkSession, path: str) -> DataFrame:
    """file, name, view (row-major 4x4), centre (x, y, z), problem of models in text, one model a file.

    A pose line (id, quaternion w x y z, translation, camera, name) is followed by a line of observations, which may be
    empty; empty lines before a pose and lines that begin with ``#`` don't count. So after each empty line poses and
    observations take turns anew. Of a line only its first ten fields travel; the lines of one file are ordered in one
    task. ``problem``: fields, number, quaternion, repeated or observations (the file ends before them), else null.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_name").alias("file"), F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("i")).alias("_at"),
        F.slice(F.split(F.trim(F.translate("value", "\t\r", "  ")), " +", 11), 1, 10).alias("_f"),
    )
    lines = lines.where(~F.element_at("_f", 1).startswith("#")).withColumn("_full", F.element_at("_f", 1) != "")
    order = Window.partitionBy("file").orderBy("_at")
    lines = lines.withColumns({"_part": F.count_if(~F.col("_full")).over(order.rowsBetween(Window.unboundedPreceding, 0)), "_last": F.lead("_at").over(order).isNull()})
    turn = F.row_number().over(Window.partitionBy("file", "_part", "_full").orderBy("_at"))
    poses = lines.withColumn("_turn", turn).where(F.col("_full") & (F.col("_turn") % 2 == 1))
    number = lambda k: F.get("_f", F.lit(k)).try_cast("double")
    q, t = (number(2), number(3), number(4), number(1)), [number(k) for k in (5, 6, 7)]
    size = F.sqrt(sum((v * v for v in q[1:]), q[0] * q[0]))
    r = rotation.matrix(tuple(v / F.when(size > 1e-12, size) for v in q))  # type: ignore[arg-type]
    view = (*r[0:3], t[0], *r[3:6], t[1], *r[6:9], t[2], *(F.lit(v) for v in (0.0, 0.0, 0.0, 1.0)))
    found = poses.select("file", F.get("_f", F.lit(9)).alias("name"), "_f", "_last", size.alias("_size"), F.array(*view).alias("view"), *[v.alias(k) for k, v in zip("xyz", rotation.camera_center(view), strict=True)])
    many = F.count("*").over(Window.partitionBy("file", "name")) > 1
    problem = F.when(F.size("_f") < 10, "fields").when(F.col("_size").isNull() | F.element_at("view", 4).isNull() | F.element_at("view", 8).isNull() | F.element_at("view", 12).isNull(), "number")
    problem = problem.when(~(F.col("_size") > 1e-12) | F.isnan("_size") | (F.col("_size") == float("inf")), "quaternion").when(many, "repeated").when(F.col("_last"), "observations")
    return found.withColumn("problem", problem).drop("_f", "_last", "_size")


def log_window(messages: DataFrame, chunks: DataFrame, topic: str, start_ns: int, stop_ns: int, pad_ns: int = 0) -> DataFrame:
    """Messages of a topic with log time in the padded window, of the chunks that have the topic and overlap it.

    ``chunks`` (chunk_id, start_log_ns, stop_log_ns, topics) is a small table of files, one row each; it is joined
    on chunk_id, so partitioned message tables are pruned to the chunks that count.
    """
    low, high = start_ns - pad_ns, stop_ns + pad_ns
    held = chunks.where(F.array_contains("topics", topic) & (F.col("stop_log_ns") >= low) & (F.col("start_log_ns") <= high)).select("chunk_id")
    return messages.where((F.col("topic") == topic) & F.col("log_ns").between(low, high)).join(held, "chunk_id", "left_semi")


def publish(df: DataFrame, path: str, *partitions: str) -> None:
    """Write once: an existing target is an error."""
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*partitions) if partitions else writer).parquet(path)


def number_text(x: Column) -> Column:
    """Twelve significant digits, without zeros at the end."""
    shown = F.format_string("%.12g", x)
    return F.when(shown.contains("."), F.regexp_replace(shown, r"\.?0+($|e)", "$1")).otherwise(shown)


def trajectory_lines(df: DataFrame, label: str, labels: list[str], *keys: str) -> DataFrame:
    """One row a key with x, y, z of each label as text of 12 digits."""
    wide = spread(df, *keys).groupBy(*keys).pivot(label, labels).agg(*[F.first(c).alias(c) for c in "xyz"])
    return wide.select(*keys, *[number_text(F.col(f"`{name}_{c}`")).alias(f"{name}_{c}") for name in labels for c in "xyz"])


def pair_lines(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Distinct unordered name pairs, ``low high``, sorted when written."""
    return edges.where(F.col(a) != F.col(b)).select(F.concat_ws(" ", F.least(a, b), F.greatest(a, b)).alias("line")).distinct()


#: Observation tables of a segment and whether each must be there.
OBSERVATIONS = {"frames": True, "gnss": True, "heading": False, "imu": False}


def observations(spark: SparkSession, root: str, kind: str, schema: str) -> DataFrame | None:
    """Observation table ``kind`` under the root, with ``segment_id`` from its folders, or from its files where a folder holds many segments; None if an optional one is missing.

    The schema is given, not inferred: columns that a file lacks are null, others aren't read.
    """
    if kind not in OBSERVATIONS:
        raise ValueError(f"unknown observations: {kind}")
    try:
        return spark.read.schema(f"{schema}, segment_id long").parquet(f"{root}/{kind}")
    except AnalysisException as error:
        if OBSERVATIONS[kind] or error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
