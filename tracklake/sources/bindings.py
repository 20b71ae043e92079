"""Views that give the test tables the shape of recordings. Times are long nanoseconds, never timestamps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nanoseconds(ts: str) -> F.Column:
    """Since 1970, of a timestamp without time zone, whatever the session's zone is."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast({ts} as timestamp_ntz)) * 1000")


def stream(spark: SparkSession, sf_dir: str, *kinds: str) -> DataFrame:
    """segment_id, row_id, t_ns, kind, x, k of the events (of the given kinds)."""
    events = table(spark, sf_dir, "events")
    if kinds:
        events = events.where(F.col("event_type").isin(*kinds))
    number = F.regexp_extract("props", "[0-9]+", 0).cast("long")
    return events.select(F.col("user_id").alias("segment_id"), F.col("event_id").alias("row_id"), nanoseconds("ts").alias("t_ns"), F.col("event_type").alias("kind"), F.col("value").alias("x"), number.alias("k"))


STREAM_SQL = "stream AS (SELECT user_id AS segment_id, event_id AS row_id, epoch_us(ts) * 1000 AS t_ns, event_type AS kind, value AS x, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k FROM events)"


def track(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions per segment: frame (from 0), t_ns, x, y, status (-1 to 2), carrier (0 to 2), var."""
    from pyspark.sql import Window

    order = Window.partitionBy("segment_id").orderBy("t_ns", "row_id")
    return stream(spark, sf_dir).select("segment_id", (F.row_number().over(order) - 1).cast("long").alias("frame"), "t_ns", (F.col("x") / 100).alias("x"), (F.col("k") / 100.0).alias("y"), (F.col("k") % 4 - 1).alias("status"), (F.col("k") % 3).alias("carrier"), ((F.col("k") + 1) / 10000.0).alias("var"))


TRACK_SQL = f"{STREAM_SQL}, track AS (SELECT segment_id, row_number() OVER (PARTITION BY segment_id ORDER BY t_ns, row_id) - 1 AS frame, t_ns, x / 100 AS x, k / 100.0::DOUBLE AS y, k % 4 - 1 AS status, k % 3 AS carrier, (k + 1) / 10000.0::DOUBLE AS var FROM stream)"


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, tile (0 to 9), x, y, z, and a second point u, v, w of each row of embeddings."""
    at = lambda i: (F.element_at("embedding", i).cast("double") * 10)
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("tile"), *[at(i + 1).alias(c) for i, c in enumerate("xyzuvw")])


POINTS_SQL = "points AS (SELECT vec_id AS id, CAST(label AS BIGINT) AS tile, " + ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) * 10 AS {c}" for i, c in enumerate("xyzuvw")) + " FROM embeddings)"
