"""Whole jobs over scenes: a tile plan, depth carried to another camera, evaluation of merged tiles, a probe of one seam."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklake.functions import rotation, symmetric
from tracklake.operators import association, cloud, images, planning, tables, trajectory
from tracklake.operators.checks import checks
from tracklake.operators.pairs import checkpointed

c = F.col
_QUATERNION = ("qx", "qy", "qz", "qw")
_TILE = "tile_id int, lo_u double, lo_v double, hi_u double, hi_v double"


@dataclass(frozen=True)
class PlanPolicy:
    split: planning.SplitPolicy
    cell: float = 0.5
    min_cells: int = 1
    min_share: float = 0.0
    coverage: float = 0.9


@dataclass(frozen=True)
class TilePlan:
    axis: tuple[float, float]
    tiles: DataFrame
    selection: DataFrame
    checks: DataFrame


def tile_plan(support: DataFrame, frames: DataFrame, policy: PlanPolicy) -> TilePlan:
    """Tiles over the scene's main axis, frames (tile_id, frame, role, reason) of each, and seven checks of the plan.

    ``support``: frame and ground positions x, y that it sees; ``frames``: frame, role (training or another). A frame
    is selected for a tile (``visibility``) if enough of its cells, in number and share, lie in the tile's context;
    training frames that see the most new cells of a core are added (``coverage``) up to the bound of a tile. Frames
    without support are in no tile and fail the first check. Support without points raises.
    """
    spark = support.sparkSession
    mean = support.agg(*[F.avg(a).alias(f"_{a}") for a in "xy"])
    dx, dy = c("x") - c("_x"), c("y") - c("_y")
    axis = support.crossJoin(mean).agg(*[F.sum(v).alias(n) for n, v in (("xx", dx * dx), ("xy", dx * dy), ("yy", dy * dy))])  # one row
    first = axis.select(*symmetric.dominant_axis(c("xx"), c("xy"), c("yy"))).first()
    if first[0] is None:
        raise ValueError("no support")
    axis = (first[0], first[1])
    cells = checkpointed(images.support_cells(support.select("frame", "x", "y"), axis, policy.cell, "frame").join(frames.select("frame", "role"), "frame"))
    training = cells.where("role = 'training'")
    cores = planning.split_tiles(training, policy.split, "frame", cells)
    tiles = spark.createDataFrame([(i, *core) for i, core in enumerate(cores)], _TILE)

    seen = cloud.visibility_counts(cells, tiles, policy.split.halo)
    own = cells.groupBy("frame").agg(F.count("*").alias("_cells"), F.first("role").alias("role"))
    enough = F.greatest(F.lit(policy.min_cells), F.ceil(policy.min_share * c("_cells")))
    seen = checkpointed(seen.join(own, "frame").withColumns({"in_core": c("core_cells") >= enough, "in_context": c("context_cells") >= enough}))
    high = [max(core[k] for core in cores) for k in (2, 3)]
    placed = cloud.tile_owner(cells, tiles, *high)
    cores_seen = placed.where("role = 'training' and owner >= 0").select(c("owner").alias("tile_id"), "frame", F.concat_ws(",", "u", "v").alias("cell"))
    chosen = seen.where("in_context").select("tile_id", "frame", "role")
    trained = chosen.where("role = 'training'")
    added = planning.completed_coverage(cores_seen, trained, policy.coverage, policy.split.max_frames)
    selection = checkpointed(chosen.withColumn("reason", F.lit("visibility")).unionByName(added.select("tile_id", "frame", F.lit("training").alias("role"), F.lit("coverage").alias("reason"))))

    taught = selection.where("role = 'training'")
    each = tiles.select("tile_id").join(taught.groupBy("tile_id").agg(F.count("*").alias("n")), "tile_id", "left")
    each = each.join(seen.where("in_core and role = 'training'").groupBy("tile_id").agg(F.count("*").alias("core")), "tile_id", "left")
    each = each.join(planning.coverage_ratio(cores_seen, taught).select("tile_id", "ratio"), "tile_id", "left").fillna(0, ["n", "core", "ratio"])
    measured = each.agg(F.max("n").alias("most"), F.min("n").alias("fewest"), F.min("core").alias("core"), F.min("ratio").alias("ratio"))
    measured = measured.crossJoin(placed.agg(F.count_if(c("owner") < 0).alias("outside")))  # one row each, as below
    measured = measured.crossJoin(frames.join(selection.select("frame").distinct(), "frame", "left_anti").agg(F.count("*").alias("unselected")))
    moved = selection.select("frame", c("role").alias("_role")).join(frames.select("frame", "role"), "frame").where("_role <> role").agg(F.count("*").alias("moved"))
    gates = {
        "all_frames_selected": (c("unselected"), None, 0),
        "support_inside_scene": (c("outside"), None, 0),
        "training_capacity": (c("most"), None, policy.split.max_frames),
        "every_tile_has_training": (c("fewest"), 1, None),
        "core_training_frames": (c("core"), policy.split.min_core_frames, None),
        "core_coverage": (c("ratio"), policy.coverage - 1e-12, None),
        "roles_preserved": (c("moved"), None, 0),
    }
    return TilePlan(axis, tiles, selection, checks(measured.crossJoin(moved).withColumn("plan", F.lit(0)), ["plan"], gates).drop("plan"))


@dataclass(frozen=True)
class Camera:
    fx: float
    fy: float
    cx: float
    cy: float
    width: int
    height: int


@dataclass(frozen=True)
class TransferPolicy:
    tolerance_ns: int
    max_gap_ns: int
    least_neighbours: int = 5
    absolute_m: float = 0.1
    relative: float = 0.05
    min_coverage: float = 0.1
    min_retention: float = 0.1


def transferred_depth(pixels: DataFrame, depths: DataFrame, colors: DataFrame, poses: DataFrame, source: Camera, target: Camera, policy: TransferPolicy, key: str = "segment_id", time: str = "t_ns", index: str = "row_id") -> tuple[DataFrame, DataFrame]:
    """Depth pixels (key, color index, u, v, z, filled) of colour images, and coverage and retention gates of each.

    ``pixels``: key, index of a depth image, u, v, z; ``poses``: camera to world, x, y, z and qx to qw. Each depth image
    goes to the colour image nearest in time that has none nearer, both with poses interpolated at their own times.
    Depth images without a colour image or a pose give no pixel. Both tables are empty if nothing is transferred.
    """
    names = {"key": key, "time": time, "index": index}
    won = association.unique_nearest(depths, colors, policy.tolerance_ns, **names).where("state = 'won'").select(key, index, c("sample_index").alias("color_index"))
    values = ["x", "y", "z", *_QUATERNION]
    at = {s: trajectory.interpolated_poses(f.select(key, index, time), poses, policy.max_gap_ns, **names).where("alpha is not null").select(key, c(index).alias(n), *[c(v).alias(f"{s}_{v}") for v in values]) for s, f, n in (("d", depths, index), ("c", colors, "color_index"))}
    views = won.join(at["d"], [key, index]).join(at["c"], [key, "color_index"])
    r, q = (rotation.matrix(tuple(c(f"{s}_{k}") for k in _QUATERNION)) for s in "dc")  # type: ignore[arg-type]
    away = [c(f"d_{a}") - c(f"c_{a}") for a in "xyz"]
    turn = {f"m{3 * i + j}": q[i] * r[j] + q[3 + i] * r[3 + j] + q[6 + i] * r[6 + j] for i in range(3) for j in range(3)}
    move = {f"t{i}": q[i] * away[0] + q[3 + i] * away[1] + q[6 + i] * away[2] for i in range(3)}
    views = checkpointed(views).select(key, index, "color_index", *[v.alias(n) for n, v in (turn | move).items()])
    x, y, z = cloud.back_projected(c("u"), c("v"), c("z"), *[F.lit(v) for v in (source.fx, source.fy, source.cx, source.cy)])
    seen = [c(f"m{3 * i}") * x + c(f"m{3 * i + 1}") * y + c(f"m{3 * i + 2}") * z + c(f"t{i}") for i in range(3)]
    # merged, not broadcast: Spark takes rows that were exploded into pixels for as few bytes as those before
    rows = pixels.select(key, index, "u", "v", "z").join(checkpointed(views).hint("merge"), [key, index])
    rows = rows.select(key, "color_index", *[v.alias(n) for n, v in zip("xyz", seen, strict=True)]).where("z > 0")
    u, v = cloud.projected(c("x"), c("y"), c("z"), *[F.lit(v) for v in (target.fx, target.fy, target.cx, target.cy)])
    on = (key, "color_index")
    near = cloud.z_buffered(rows.select(*on, u.alias("u"), v.alias("v"), "z"), target.width, target.height, *on)
    holes = cloud.holes_filled(near, policy.least_neighbours, policy.absolute_m, policy.relative, *on)
    inside = c("u").between(0, target.width - 1) & c("v").between(0, target.height - 1)
    out = near.withColumn("filled", F.lit(False)).unionByName(holes.where(inside).withColumn("filled", F.lit(True)))
    held = pixels.select(key, index).join(won.hint("merge"), [key, index]).select(*on)
    return out, images.projection_coverage(held, out, target.width * target.height, policy.min_coverage, policy.min_retention, *on)


def cross_faded(layers: DataFrame, tiles: DataFrame, halo: float, *keys: str) -> DataFrame:
    """Colours (r, g, b, mass) of pixels from the layers of tiles: weights fall from a tile's core to its context's end.

    ``layers``: keys, tile_id, ground position u, v, alpha, r, g, b.
    """
    held = layers.join(tiles.select("tile_id", "lo_u", "lo_v", "hi_u", "hi_v"), "tile_id")
    return cloud.blended_layers(held.withColumn("weight", cloud.core_weight(halo)), *keys)


def color_psnr(pixels: DataFrame, *keys: str) -> DataFrame:
    """psnr over the channels (r, g, b against tr, tg, tb) of each view; views without an error have null."""
    square = sum(((c(x) - c(f"t{x}")) * (c(x) - c(f"t{x}")) for x in "gb"), (c("r") - c("tr")) * (c("r") - c("tr")))
    mean = F.avg(square / 3)
    return pixels.groupBy(*keys).agg(F.when(mean > 0, -10 * F.log10(mean)).alias("psnr"), F.count("*").alias("n"))


@dataclass(frozen=True)
class ScenePolicy:
    halo: float
    band: float
    min_band_pixels: int
    min_band_views: int
    min_psnr: float
    min_seam_psnr: float


def scene_evaluation(gaussians: DataFrame, tiles: DataFrame, run: DataFrame, layers: DataFrame, truth: DataFrame, bounds: Sequence[float], policy: ScenePolicy) -> DataFrame:
    """name, value, passed of a merged scene: ownership, completeness, quality of all pixels and of those at seams.

    ``gaussians``: u, v; ``run``: tile_id of tiles with a result; ``layers``: view, px, py, tile_id, u, v, alpha, r, g,
    b; ``truth``: view, px, py, u, v, tr, tg, tb of held-out views; ``bounds``: lo_u, lo_v, hi_u, hi_v of the scene.
    Seam quality is over views with enough pixels within the band of an inner seam; a null measure fails its gate.
    """
    at = ["view", "px", "py"]
    owned = images.owned_counts(cloud.tile_owner(gaussians, tiles, bounds[2], bounds[3])).select(c("owner").alias("tile_id"), "n")
    merged = truth.join(cross_faded(layers, tiles, policy.halo, *at), at)
    views = color_psnr(merged, "view")
    near = cloud.seam_band(truth.select(*at, "u", "v"), cloud.seam_segments(tiles, *bounds), policy.band, *at).select(*at)
    seams = color_psnr(merged.join(near, at), "view").where(c("n") >= policy.min_band_pixels)
    whole = tables.scene_completeness(tiles, run, owned, gaussians.count(), views.select("view", c("psnr").alias("metric")))
    lost = truth.select("view").distinct().join(views, "view", "left_anti").agg(F.count("*").alias("views_lost"))
    measured = whole.crossJoin(lost).crossJoin(views.agg(F.avg("psnr").alias("psnr"))).crossJoin(seams.agg(F.avg("psnr").alias("seam_psnr"), F.count("*").alias("seam_views")))  # one row each
    flags = {n: (c(n).cast("int"), 1, None) for n in ("tiles_run", "all_owned", "each_contributes", "views_once", "metrics_finite")}
    gates = flags | {"views_lost": (c("views_lost"), None, 0), "psnr": (c("psnr"), policy.min_psnr, None), "seam_psnr": (c("seam_psnr"), policy.min_seam_psnr, None), "seam_views": (c("seam_views"), policy.min_band_views, None)}
    return checks(measured.withColumn("scene", F.lit(0)), ["scene"], gates).select("name", "value", "passed")


def seam_probe(tiles: DataFrame, layers: DataFrame, truth: DataFrame, bounds: Sequence[float], policy: ScenePolicy, max_loss_db: float) -> DataFrame:
    """tile_id, neighbour, name, value, passed: each tile and its neighbour of the longest shared edge, at their seam.

    The merged colours may lose ``max_loss_db`` at most against the mean of what both tiles give alone, over the same
    views and pixels: those of the band that both tiles' layers reach, in views with enough of them.
    """
    at, pair = ["view", "px", "py"], ["tile_id", "neighbour"]
    met = cloud.adjacent_tiles(tiles).where("rank = 1").select(*pair)
    met = met.select(F.least(*pair).alias("tile_id"), F.greatest(*pair).alias("neighbour")).distinct()
    near = cloud.seam_band(truth.select(*at, "u", "v"), cloud.seam_segments(tiles, *bounds), policy.band, *at).select(*at)
    seen = layers.join(near, at)
    both = seen.join(met, "tile_id").join(seen.select(*at, c("tile_id").alias("neighbour")), [*at, "neighbour"]).select(*pair, *at)
    told = both.select(*pair, *at, F.explode(F.array(*pair)).alias("_t")).join(seen.withColumnRenamed("tile_id", "_t"), [*at, "_t"]).join(truth.drop("u", "v"), at)
    alone = color_psnr(told, *pair, "_t", "view").where(c("n") >= policy.min_band_pixels)
    alone = alone.groupBy(*pair, "view").agg(F.avg("psnr").alias("alone"))
    blended = cross_faded(told.withColumnRenamed("_t", "tile_id_").withColumnsRenamed({"tile_id": "first", "tile_id_": "tile_id"}), tiles, policy.halo, "first", "neighbour", *at).withColumnRenamed("first", "tile_id")
    merged = color_psnr(blended.join(truth, at), *pair, "view").where(c("n") >= policy.min_band_pixels).withColumnRenamed("n", "pixels")
    found = alone.join(merged, [*pair, "view"]).groupBy(*pair).agg(F.count("*").alias("views"), F.sum("pixels").alias("pixels"), (F.avg("alone") - F.avg("psnr")).alias("loss_db"))
    found = met.join(found, pair, "left").fillna(0, ["views", "pixels"])
    gates: dict[str, tuple[Column, float | None, float | None]] = {"views": (c("views"), policy.min_band_views, None), "pixels": (c("pixels"), policy.min_band_pixels, None), "loss_db": (c("loss_db"), None, max_loss_db)}
    return checks(found, pair, gates).select(*pair, "name", "value", "passed")
