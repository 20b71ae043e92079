"""Frame pairs: candidates by time and by place, decisions, ids, degrees, expansion to images, components."""

from __future__ import annotations

import tempfile
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklake.functions.keys import pair_id


def checkpointed(df: DataFrame) -> DataFrame:
    """Rows cut from their lineage, in the session's shared folder; a local session without one gets a temporary one."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return df.checkpoint()


def _distance(a: str, b: str) -> Column:
    return F.sqrt(sum(((F.col(f"{a}.{c}") - F.col(f"{b}.{c}")) * (F.col(f"{a}.{c}") - F.col(f"{b}.{c}")) for c in "yz"), (F.col(f"{a}.x") - F.col(f"{b}.x")) * (F.col(f"{a}.x") - F.col(f"{b}.x"))))


def temporal_candidates(frames: DataFrame, max_dt: int, max_distance: float, k: int | None = None, key: str = "segment_id", index: str = "frame", time: str = "t_ns") -> DataFrame:
    """key, current, earlier, distance, dt: earlier frames near in time and place; with k, the k best by d/D + t/T.

    Frames meet in time buckets of the window's width: a frame looks into its own and the one before.
    """
    f = frames.select(F.col(key).alias("key"), F.col(index).alias("i"), F.col(time).alias("t"), "x", "y", "z").withColumn("cell", F.floor(F.col("t") / F.lit(max_dt)).cast("long"))
    near = f.withColumn("cell", F.explode(F.array("cell", F.col("cell") + 1)))
    joined = f.alias("c").join(near.alias("e"), (F.col("c.key") == F.col("e.key")) & (F.col("c.cell") == F.col("e.cell")) & (F.col("e.i") < F.col("c.i")) & (F.col("c.t") - F.col("e.t") <= max_dt))
    out = joined.select(F.col("c.key").alias(key), F.col("c.i").alias("current"), F.col("e.i").alias("earlier"), _distance("c", "e").alias("distance"), (F.col("c.t") - F.col("e.t")).alias("dt")).where(F.col("distance") <= max_distance)
    if k is None:
        return out
    score = F.col("distance") / max_distance + F.col("dt") / max_dt
    order = Window.partitionBy(key, "current").orderBy(score, "distance", "dt", "earlier")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def revisit_candidates(frames: DataFrame, radius: float, min_dt: int, key: str = "segment_id", index: str = "frame", time: str = "t_ns") -> DataFrame:
    """key, current, earlier, distance of frames near in place but far in time, by 27 neighbouring grid cells."""
    cell = lambda c: F.floor(F.col(c) / radius).cast("long")
    f = frames.select(F.col(key).alias("key"), F.col(index).alias("i"), F.col(time).alias("t"), "x", "y", "z").withColumns({"gx": cell("x"), "gy": cell("y"), "gz": cell("z")})
    around = f
    for g in ("gx", "gy", "gz"):
        around = around.withColumn(g, F.explode(F.array(F.col(g) - 1, F.col(g), F.col(g) + 1)))
    same = [F.col(f"c.{g}") == F.col(f"e.{g}") for g in ("key", "gx", "gy", "gz")]
    joined = f.alias("c").join(around.alias("e"), same[0] & same[1] & same[2] & same[3] & (F.col("c.t") - F.col("e.t") >= min_dt))
    return joined.select(F.col("c.key").alias(key), F.col("c.i").alias("current"), F.col("e.i").alias("earlier"), _distance("c", "e").alias("distance")).where(F.col("distance") <= radius)


def revisit_source(frames: DataFrame, radius: float, min_dt: int, key: str = "segment_id", index: str = "frame", time: str = "t_ns") -> DataFrame:
    """Nearest earlier frame of each revisiting frame, then the lowest index."""
    found = revisit_candidates(frames, radius, min_dt, key, index, time)
    return found.groupBy(key, "current").agg(F.min(F.struct("distance", "earlier")).alias("_s")).select(key, "current", F.col("_s.earlier").alias("source"), F.col("_s.distance").alias("distance"))


@dataclass(frozen=True)
class PairPolicy:
    nearby_frames: int = 2
    nearby_s: float = 1.5
    max_std_m: float = 0.5
    distance_m: float = 1.0
    sigmas: float = 3.0
    cap_m: float = 3.0
    strong_matches: int = 200


def pair_decision(policy: PairPolicy, same_frame: Column, other_camera: Column, frame_gap: Column, time_gap_s: Column, std_a: Column, std_b: Column, displacement: Column, combined_std: Column, matches: Column) -> tuple[Column, Column]:
    """(retained, reason); a null std is an untrusted end."""
    allowed = F.least(F.lit(policy.cap_m), policy.distance_m + policy.sigmas * combined_std)
    reason = (
        F.when(same_frame & other_camera, "same_frame_stereo")
        .when((F.abs(frame_gap) <= policy.nearby_frames) | (F.abs(time_gap_s) <= policy.nearby_s), "adjacent_or_nearby_temporal")
        .when(std_a.isNull() | std_b.isNull(), "nonlocal_gnss_untrusted")
        .when(F.greatest(std_a, std_b) > policy.max_std_m, "nonlocal_gnss_too_uncertain")
        .when(displacement > allowed, "nonlocal_gnss_incompatible")
        .when(F.coalesce(matches, F.lit(0)) >= policy.strong_matches, "strong_locally_consistent_track")
        .otherwise("gnss_consistent_revisit")
    )
    return ~reason.startswith("nonlocal_"), reason


def resolved_pairs(pairs: DataFrame, names: DataFrame) -> DataFrame:
    """name_a, name_b to pair_id with ``problem``: unknown, self or repeated."""
    ids = names.select("name", "image_id")
    out = pairs.join(ids.toDF("name_a", "id_a"), "name_a", "left").join(ids.toDF("name_b", "id_b"), "name_b", "left")
    out = out.withColumn("pair_id", F.when(F.col("id_a") != F.col("id_b"), pair_id(F.col("id_a"), F.col("id_b"))))
    copies = out.where("pair_id is not null").groupBy("pair_id").agg(F.count("*").alias("_n"))
    out = out.join(copies, "pair_id", "left")
    problem = F.when(F.col("id_a").isNull() | F.col("id_b").isNull(), "unknown").when(F.col("id_a") == F.col("id_b"), "self").when(F.col("_n") > 1, "repeated")
    return out.select("name_a", "name_b", "pair_id", problem.alias("problem"))


def degrees(edges: DataFrame, a: str, b: str) -> DataFrame:
    """node, degree over distinct undirected edges."""
    distinct = edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a <> b").distinct()
    return distinct.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))


def merged_edges(*edges: DataFrame) -> DataFrame:
    """a, b, reasons (sorted, distinct) of edge tables (a, b, reason), each pair in ascending order."""
    out = edges[0]
    for e in edges[1:]:
        out = out.unionByName(e)
    return out.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.array_sort(F.collect_set("reason")).alias("reasons"))


def hot_left_join(many: DataFrame, one: DataFrame, key: str, share: int = 1000) -> DataFrame:
    """Left join of ``many`` with ``one``, which has each key once, with keys that very many rows hold met by a broadcast.

    Keys of over one in ``share`` of the rows are fewer than ``share``, whatever the data, so that is the broadcast's bound; the
    rest is shuffled without them.
    """
    counts = checkpointed(many.groupBy(key).agg(F.count("*").alias("_n")))
    total = counts.agg(F.sum("_n")).first()[0] or 0
    hot = checkpointed(counts.where(F.col("_n") > max(total // share, 1000)).select(key))
    if hot.isEmpty():
        return many.join(one, key, "left")
    met = many.join(F.broadcast(hot), key, "left_semi").join(F.broadcast(one.join(F.broadcast(hot), key, "left_semi")), key, "left")
    rest = many.join(F.broadcast(hot), key, "left_anti").join(one.join(F.broadcast(hot), key, "left_anti"), key, "left")
    return met.unionByName(rest)


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): labels pass to neighbours, then each label takes its own label, until none changes.

    Minima are taken before the shuffle; nodes with very many links, and roots of very many nodes, are met by broadcasts.
    """
    links = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    links = checkpointed(links.union(links.select("b", "a")).distinct())
    label = links.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("root")).withColumnRenamed("a", "node")
    while True:
        label = checkpointed(label)
        heard = hot_left_join(links, label.toDF("b", "r"), "b").groupBy("a").agg(F.min("r").alias("r"))
        out = checkpointed(label.join(heard.withColumnRenamed("a", "node"), "node").select("node", F.least("root", "r").alias("root"), F.col("root").alias("old")))
        out = hot_left_join(out, label.toDF("root", "further"), "root").select("node", F.least("root", F.coalesce("further", "root")).alias("root"), "old")
        out = checkpointed(out)
        if out.where("root <> old").isEmpty():
            return out.select("node", "root")
        label = out.select("node", "root")
