"""Streaming operators run as streams: the events file is the source, what is there is processed, then the query ends."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklake.operators.pairs import checkpointed
from tracklake.plans.registry import query
from tracklake.plans.time_queries import STEP, TOL
from tracklake.plans.walk_sql import pairs_sql
from tracklake.sources.bindings import STREAM_SQL, nanoseconds, table
from tracklake.streaming import pairing
from tracklake.streaming.ordered import rocksdb_state

c = F.col


#: When the heartbeat comes that ends a stream: beyond every event.
END = 4_000_000_000_000_000_000


def streamed(spark: SparkSession, sf_dir: str, prepare: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows that a stream over the events gives, written to the shared folder by an available-now query.

    A heartbeat after the last event lets the watermark pass all of them, so nothing is left waiting at the end.
    """
    checkpointed(spark.range(1))  # names the shared folder
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/stream-{uuid.uuid4().hex}"
    events = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parquet*")
    number = F.regexp_extract("props", "[0-9]+", 0).cast("long")
    rows = events.select(c("user_id").alias("segment_id"), c("event_id").alias("i"), nanoseconds("ts").alias("t"), c("event_type").alias("kind"), c("value").alias("x"), number.alias("k"))
    spark.range(1).select(*[(F.lit(END) if f.name == "t" else F.lit(None)).cast(f.dataType).alias(f.name) for f in rows.schema]).write.parquet(f"{folder}/end")
    out = prepare(rows.unionByName(spark.readStream.schema(rows.schema).parquet(f"{folder}/end")))
    with rocksdb_state(spark):
        run = out.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start(f"{folder}/rows")
    run.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/rows")


def _sided(rows: DataFrame, first: str, second: str) -> DataFrame:
    """Two kinds of events as the two sides of a stream, and the heartbeat."""
    return rows.where(c("kind").isin(first, second) | c("i").isNull()).select("segment_id", (c("kind") == second).cast("int").alias("side"), "i", "t")


@query(f"""WITH RECURSIVE {STREAM_SQL},
u AS (SELECT segment_id, CAST(kind = 'view' AS INTEGER) AS side, t_ns AS t, row_id AS i
  FROM stream
  WHERE kind IN ('click', 'view')), {pairs_sql('u', TOL)} SELECT *
  FROM met""")
def r1_r2_stereo_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-to-one pairs of clicks and views; what waits longer than the tolerance is evicted."""
    return streamed(spark, sf_dir, lambda rows: pairing.one_to_one_stream(_sided(rows, "click", "view"), TOL)).drop("problem")


@query(f"WITH {STREAM_SQL} SELECT row_id AS i, kind FROM stream WHERE kind = 'click' AND t_ns >= 1704200000000000000 AND t_ns < 1704900000000000000")
def r3_time_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streamed(spark, sf_dir, lambda rows: pairing.time_window_stream(rows.where("kind = 'click'"), 1_704_200_000_000_000_000, 1_704_900_000_000_000_000)).select("i", "kind")


@query(f"""WITH {STREAM_SQL},
d AS (SELECT segment_id, row_id AS i, t_ns - CASE WHEN row_id % 5 = 0 THEN 40000000000000 ELSE 0 END AS t FROM stream),
b AS (SELECT *, max(t) OVER (PARTITION BY segment_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest FROM d)
SELECT segment_id, i, t FROM b WHERE t <= newest""")
def r4_out_of_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows in order of their ids that aren't after all rows before them; every fifth header is half a day behind."""
    late = F.when(c("i") % 5 == 0, 40_000_000_000_000).otherwise(0)
    out = streamed(spark, sf_dir, lambda rows: pairing.out_of_order_stream(rows.select("segment_id", "i", (c("t") - late).alias("t"), F.coalesce(c("i") * 1_000_000, F.lit(END)).alias("log_t"))))
    return out.drop("problem")


@query(f"""WITH {STREAM_SQL}, track AS (SELECT segment_id, row_id AS i, t_ns AS t, x / 100 AS x, k / 100.0::DOUBLE AS y FROM stream),
d AS (SELECT segment_id, i, t, {STEP} AS step FROM track WINDOW w AS (PARTITION BY segment_id ORDER BY t, i)),
s AS (SELECT *, sum(step) OVER (PARTITION BY segment_id ORDER BY t, i ROWS UNBOUNDED PRECEDING) AS path, row_number() OVER (PARTITION BY segment_id ORDER BY t, i) AS place FROM d)
SELECT segment_id, i, t FROM s WHERE place = 1 OR floor((path + 1e-12) / 1.5) > floor((path - step + 1e-12) / 1.5)""")
def r5_distance_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streamed(spark, sf_dir, lambda rows: pairing.distance_sampled_stream(rows.select("segment_id", "i", "t", (c("x") / 100).alias("x"), (c("k") / 100.0).alias("y"), F.lit(0.0).alias("z")), 1.5)).drop("problem")


def _one_key(rows: DataFrame) -> DataFrame:
    """All events as one recording; a heartbeat stays one."""
    return rows.withColumn("segment_id", F.lit(0))


@query(f"""WITH {STREAM_SQL}, d AS (SELECT row_id AS i, t_ns AS t, x / 100 AS x, k / 100.0::DOUBLE AS y FROM stream),
e AS (SELECT i, t, coalesce(sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)), 0) AS step FROM d WINDOW w AS (ORDER BY t, i)),
s AS (SELECT *, sum(step) OVER (ORDER BY t, i ROWS UNBOUNDED PRECEDING) AS path, row_number() OVER (ORDER BY t, i) AS place FROM e)
SELECT i, t FROM s WHERE place = 1 OR floor((path + 1e-12) / 25) > floor((path - step + 1e-12) / 25)""")
def r5_one_long_recording(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distance sampler over all events as one key."""
    rows = lambda r: _one_key(r).select("segment_id", "i", "t", (c("x") / 100).alias("x"), (c("k") / 100.0).alias("y"), F.lit(0.0).alias("z"))
    return streamed(spark, sf_dir, lambda r: pairing.distance_sampled_stream(rows(r), 25.0)).select("i", "t")


_J1 = """SELECT f.segment_id, f.t_ns AS t, f.row_id AS i, s.row_id AS sample_index, s.t_ns - f.t_ns AS residual_ns FROM f LEFT JOIN s ON s.segment_id = f.segment_id AND abs(s.t_ns - f.t_ns) <= {tol}
QUALIFY row_number() OVER (PARTITION BY f.segment_id, f.row_id ORDER BY abs(s.t_ns - f.t_ns), s.t_ns, s.row_id) = 1"""


@query(f"""WITH {STREAM_SQL}, f AS (SELECT 0 AS segment_id, row_id, t_ns FROM stream WHERE kind = 'click'), s AS (SELECT 0 AS segment_id, row_id, t_ns FROM stream WHERE kind = 'view'),
n AS ({_J1.format(tol=20_000_000_000)}) SELECT i, t, sample_index, residual_ns FROM n""")
def r6_one_long_recording(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks with their nearest views over all events as one key."""
    out = streamed(spark, sf_dir, lambda rows: pairing.nearest_stream(_one_key(_sided(rows, "click", "view")), 20_000_000_000))
    return out.select("i", "t", "sample_index", "residual_ns")


@query(f"""WITH {STREAM_SQL}, f AS (SELECT segment_id, row_id, t_ns FROM stream WHERE kind = 'purchase'), s AS (SELECT segment_id, row_id, t_ns FROM stream WHERE kind = 'signup')
{_J1.format(tol=TOL)}""")
def r6_streamed_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases with their nearest sign-ups: the rows of the nearest join over tables."""
    return streamed(spark, sf_dir, lambda rows: pairing.nearest_stream(_sided(rows, "purchase", "signup"), TOL)).drop("problem")
