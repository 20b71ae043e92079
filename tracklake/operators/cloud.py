"""Depth, point clouds, tiles and seams. Points meet tiles, seams and views by cells (operators/cover.py)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklake.operators import cover

SH0 = 0.28209479177387814


def back_projected(u: Column, v: Column, z: Column, fx: Column, fy: Column, cx: Column, cy: Column) -> tuple[Column, Column, Column]:
    """Camera coordinates of a pixel at optical depth z."""
    return (u - cx) * z / fx, (v - cy) * z / fy, z


def depth_pixels(frames: DataFrame, stride: int, least: float = 0.01, *keep: str) -> DataFrame:
    """keep, u, v, z of every ``stride``-th pixel (from half a stride on) whose depth is valid, finite and not under ``least``.

    ``frames``: width, height, depth and valid as row-major arrays. Pixels are picked from the arrays before they
    become rows, so no array is repeated. Arrays of another size than width times height give no pixel.
    """
    axis = lambda n: F.when(n > stride // 2, F.sequence(F.lit(stride // 2), n - 1, F.lit(stride))).otherwise(F.array().cast("array<int>"))
    width, height = F.col("width").cast("int"), F.col("height").cast("int")
    at = lambda name, u, v: F.get(name, v * width + u)
    row = lambda v: F.transform(axis(width), lambda u: F.struct(u.alias("u"), v.alias("v"), at("depth", u, v).cast("double").alias("z"), at("valid", u, v).alias("ok")))
    whole = (F.size("depth") == width * height) & (F.size("valid") == width * height)
    good = F.filter(F.flatten(F.transform(axis(height), row)), lambda p: p["ok"] & (p["z"] >= least) & ~F.isnan(p["z"]) & (p["z"] < float("inf")))
    return frames.select(*keep, F.inline(F.when(whole, good))).drop("ok")


def projected(x: Column, y: Column, z: Column, fx: Column, fy: Column, cx: Column, cy: Column) -> tuple[Column, Column]:
    return fx * x / z + cx, fy * y / z + cy


def disparity_depth(d: Column, fx: Column, baseline: Column, low: float, high: float) -> Column:
    """fx * B / d, or 0 where the disparity is not over half a pixel or the depth is not inside (low, high)."""
    z = fx * baseline / F.when(d > 0.5, d)
    return F.when((z > low) & (z < high), z).otherwise(0.0)


def voxel_first(points: DataFrame, size: float, order: str, *keys: str) -> DataFrame:
    """First point by ``order`` of each voxel, by its exact integer triple."""
    cells = {f"_{c}": F.floor(F.col(c) / size).cast("long") for c in "xyz"}
    kept = [c for c in points.columns if c not in keys]
    return points.withColumns(cells).groupBy(*keys, *cells).agg(F.min(F.struct(order, *[c for c in kept if c != order])).alias("_p")).select(*keys, *[F.col(f"_p.{c}").alias(c) for c in kept])


def hash_sample(points: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """n points by the order of a seeded hash of their key: the same ones whatever the partitioning."""
    return points.withColumn("_h", F.xxhash64(key, F.lit(seed))).orderBy("_h", key).limit(n).drop("_h")


def z_buffered(pixels: DataFrame, width: int, height: int, *keys: str) -> DataFrame:
    """Nearest depth of each target pixel (u, v rounded half to even) inside the image."""
    at = {c: F.bround(c, 0).cast("long") for c in ("u", "v")}
    inside = pixels.withColumns(at).where((F.col("z") > 0) & F.col("u").between(0, width - 1) & F.col("v").between(0, height - 1))
    return inside.groupBy(*keys, "u", "v").agg(F.min("z").alias("z"))


def holes_filled(pixels: DataFrame, least: int, absolute: float, relative: float, *keys: str) -> DataFrame:
    """Missing pixels with enough valid neighbours (of eight) of little spread, at the neighbours' median depth."""
    steps = F.array(*[F.struct(F.lit(a).alias("du"), F.lit(b).alias("dv")) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b])
    told = pixels.withColumn("_s", F.explode(steps)).select(*keys, (F.col("u") + F.col("_s.du")).alias("u"), (F.col("v") + F.col("_s.dv")).alias("v"), "z")
    near = told.groupBy(*keys, "u", "v").agg(F.count("*").alias("n"), F.min("z").alias("low"), F.max("z").alias("high"), F.percentile("z", 0.5).alias("z"))
    good = (F.col("n") >= least) & (F.col("high") - F.col("low") <= F.greatest(F.lit(absolute), relative * F.col("low")))
    # merged: pixels are often exploded rows, which Spark takes for small enough to broadcast
    return near.where(good).join(pixels.select(*keys, "u", "v").hint("merge"), [*keys, "u", "v"], "left_anti").select(*keys, "u", "v", "z")


def tile_owner(points: DataFrame, tiles: DataFrame, high_u: float, high_v: float, tolerance: float = 1e-9) -> DataFrame:
    """Points with ``owner``: the tile whose core holds (u, v), lower edges included, upper ones only at the scene's end; -1 outside.

    ``problem`` is ``several`` where the cores of more than one tile hold the point, which has the lowest of them as its owner
    then; a plan whose cores are disjoint has none.
    """
    wide = tiles.select("tile_id", "lo_u", "lo_v", (F.col("hi_u") + tolerance).alias("hi_u"), (F.col("hi_v") + tolerance).alias("hi_v"))

    def holds(box: Column) -> Column:
        inside = (F.col("u") >= box["lo_u"]) & (F.col("v") >= box["lo_v"])
        for c, end in (("u", high_u), ("v", high_v)):
            high = box[f"hi_{c}"] - tolerance
            inside = inside & ((F.col(c) < high) | ((high >= end - tolerance) & (F.col(c) <= high + tolerance)))
        return inside

    found = cover.holders(points, wide, "tile_id", holds, "_owners")
    owner = F.coalesce(F.get("_owners", F.lit(0)), F.lit(-1))
    return found.withColumns({"owner": owner, "problem": F.when(F.size("_owners") > 1, "several")}).drop("_owners")


def _widened(tiles: DataFrame, halo: float) -> DataFrame:
    """Tiles with bounds widened by the halo, and the core's as core_lo_u to core_hi_v."""
    bounds = [F.col(b).alias(f"core_{b}") for b in ("lo_u", "lo_v", "hi_u", "hi_v")]
    return tiles.select("tile_id", *bounds, *[(F.col(f"lo_{c}") - halo).alias(f"lo_{c}") for c in "uv"], *[(F.col(f"hi_{c}") + halo).alias(f"hi_{c}") for c in "uv"])


def with_core(points: DataFrame, tiles: DataFrame, halo: float) -> DataFrame:
    """As in_context(), with the tile's core as lo_u to hi_v."""
    met = cover.in_boxes(points, _widened(tiles, halo)).drop("lo_u", "lo_v", "hi_u", "hi_v")
    return met.withColumnsRenamed({f"core_{b}": b for b in ("lo_u", "lo_v", "hi_u", "hi_v")})


def in_context(points: DataFrame, tiles: DataFrame, halo: float) -> DataFrame:
    """Each point with each tile whose core, widened by the halo, holds it; edges included."""
    return with_core(points, tiles, halo).drop("lo_u", "lo_v", "hi_u", "hi_v")


def adjacent_tiles(tiles: DataFrame) -> DataFrame:
    """tile_id, neighbour, edge: length of the shared edge; rank 1 is the longest, then the lowest id.

    Tiles meet where one's upper bound is the other's lower one, so four equi-joins find all neighbours.
    """
    parts = []
    for axis, other in (("u", "v"), ("v", "u")):
        a = tiles.select("tile_id", F.col(f"hi_{axis}").alias("at"), F.col(f"lo_{other}").alias("a_lo"), F.col(f"hi_{other}").alias("a_hi"))
        b = tiles.select(F.col("tile_id").alias("neighbour"), F.col(f"lo_{axis}").alias("at"), F.col(f"lo_{other}").alias("b_lo"), F.col(f"hi_{other}").alias("b_hi"))
        met = a.join(b, "at").select("tile_id", "neighbour", (F.least("a_hi", "b_hi") - F.greatest("a_lo", "b_lo")).alias("edge"))
        parts += [met, met.select(F.col("neighbour").alias("tile_id"), F.col("tile_id").alias("neighbour"), "edge")]
    found = reduce(DataFrame.unionByName, parts).where("edge > 0 and tile_id <> neighbour")
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("tile_id").orderBy(F.desc("edge"), "neighbour")))


def seam_segments(tiles: DataFrame, lo_u: float, lo_v: float, hi_u: float, hi_v: float) -> DataFrame:
    """Distinct core edges (u0, v0, u1, v1) that aren't on the scene's border."""
    edge = lambda *c: F.struct(*[F.col(x).alias(n) for x, n in zip(c, ("u0", "v0", "u1", "v1"), strict=True)])
    edges = F.array(edge("lo_u", "lo_v", "lo_u", "hi_v"), edge("hi_u", "lo_v", "hi_u", "hi_v"), edge("lo_u", "lo_v", "hi_u", "lo_v"), edge("lo_u", "hi_v", "hi_u", "hi_v"))
    out = tiles.select(F.explode(edges).alias("e")).select("e.*").distinct()
    border = ((F.col("u0") == F.col("u1")) & F.col("u0").isin(lo_u, hi_u)) | ((F.col("v0") == F.col("v1")) & F.col("v0").isin(lo_v, hi_v))
    return out.where(~border)


def seam_band(points: DataFrame, segments: DataFrame, width: float, *keys: str) -> DataFrame:
    """Points within ``width`` of a segment, with the distance to the nearest."""
    nearest = lambda c: F.greatest(F.col(f"{c}0"), F.least(F.col(f"{c}1"), F.col(c)))
    du, dv = F.col("u") - nearest("u"), F.col("v") - nearest("v")
    around = segments.select("*", *[(F.col(f"{c}0") - width).alias(f"lo_{c}") for c in "uv"], *[(F.col(f"{c}1") + width).alias(f"hi_{c}") for c in "uv"])
    met = cover.in_boxes(points, around)
    return met.groupBy(*keys, "u", "v").agg(F.sqrt(F.min(du * du + dv * dv)).alias("distance")).where(F.col("distance") <= width)


def visibility_counts(cells: DataFrame, tiles: DataFrame, halo: float) -> DataFrame:
    """tile_id, frame, core_cells, context_cells of support cells (frame, u, v)."""
    held = with_core(cells, tiles, halo)
    core = (F.col("u") >= F.col("lo_u")) & (F.col("u") < F.col("hi_u")) & (F.col("v") >= F.col("lo_v")) & (F.col("v") < F.col("hi_v"))
    return held.groupBy("tile_id", "frame").agg(F.count_if(core).alias("core_cells"), F.count("*").alias("context_cells"))


def blended_layers(layers: DataFrame, *keys: str) -> DataFrame:
    """Colour of each pixel: sum of weight * alpha * colour over sum of weight * alpha."""
    w = F.col("weight") * F.col("alpha")
    total = F.sum(w)
    return layers.groupBy(*keys).agg(*[F.when(total > 0, F.sum(w * F.col(c)) / total).alias(c) for c in "rgb"], total.alias("mass"))


def core_weight(halo: float) -> Column:
    """1 inside a core (lo_u to hi_v), falling with the distance of (u, v) from it to 0 at the halo."""
    out = lambda c: F.greatest(F.col(f"lo_{c}") - F.col(c), F.col(c) - F.col(f"hi_{c}"), F.lit(0.0))
    return F.greatest(1 - F.sqrt(out("u") * out("u") + out("v") * out("v")) / halo, F.lit(0.0))


def tile_weights(points: DataFrame, tiles: DataFrame, halo: float, key: str = "id") -> DataFrame:
    """Partition of unity over tiles: 1 minus distance outside the core over the halo, normalised for each point."""
    held = with_core(points, tiles, halo)
    held = held.withColumn("_w", core_weight(halo))
    total = F.sum("_w").over(Window.partitionBy(key))
    return held.withColumn("weight", F.when(total > 0, F.col("_w") / total).otherwise(0.0)).drop("_w", "lo_u", "lo_v", "hi_u", "hi_v")


def reweighted_opacity(alpha: Column, weight: Column) -> Column:
    """Opacity whose optical thickness is scaled by the weight."""
    return -F.expm1(F.log1p(-alpha) * weight)


def pruned(gaussians: DataFrame, min_opacity: float, box: tuple[float, ...]) -> DataFrame:
    """Gaussians of opacity over the bound, strictly inside the box (low x, y, z, high x, y, z)."""
    inside = (1 / (1 + F.exp(-F.col("opacity_logit")))) > min_opacity
    for k, c in enumerate("xyz"):
        inside = inside & (F.col(c) > box[k]) & (F.col(c) < box[k + 3])
    return gaussians.where(inside)


def crop_box(points: DataFrame, margin: float, *keys: str) -> DataFrame:
    """1st and 99th percentile of each axis, widened by the margin."""
    cols = [(F.percentile(c, q) + s * margin).alias(f"{n}_{c}") for c in "xyz" for n, q, s in (("low", 0.01, -1), ("high", 0.99, 1))]
    return points.groupBy(*keys).agg(*cols)


def clamped_scales(a: Column, b: Column, c: Column, low: float, high: float, log_ratio: float) -> tuple[Column, ...]:
    """Log scales inside bounds, then within half the log anisotropy of their mean."""
    inner = [F.greatest(F.lit(low), F.least(F.lit(high), x)) for x in (a, b, c)]
    mean = (inner[0] + inner[1] + inner[2]) / 3
    return tuple(F.greatest(mean - log_ratio / 2, F.least(mean + log_ratio / 2, x)) for x in inner)


def initial_color(rgb: Column) -> Column:
    """Zeroth harmonic of a colour in [0, 1]."""
    return (rgb - 0.5) / SH0


def psnr(pixels: DataFrame, *keys: str) -> DataFrame:
    """-10 log10 of the mean squared error (columns a, b) of each view."""
    e = F.col("a") - F.col("b")
    return pixels.groupBy(*keys).agg((-10 * F.log10(F.avg(e * e))).alias("psnr"))


def in_frustum(gaussians: DataFrame, views: DataFrame, near: float, sigmas: float = 3.0, far: float | None = None) -> DataFrame:
    """(view, id) of spheres of ``sigmas`` scales that reach inside a view's four side planes, beyond its near plane and before the far one.

    ``views``: view, row-major rotation and translation m0 to m11, fx, fy, cx, cy, width, height. Views go down an octree of
    the Gaussians, so that only those in leaves that reach into a view are tested against it.
    """
    spheres = gaussians.select("id", "x", "y", "z", (sigmas * F.exp("log_scale")).alias("radius"))
    return cover.in_frustum(spheres, views, near, far).select("view", "id")


def view_counts(visible: DataFrame, views: DataFrame, most: int) -> DataFrame:
    """view, n, problem: ``none`` if a view sees nothing, ``most`` if it sees more than may be rendered at once."""
    n = views.select("view").distinct().join(visible.groupBy("view").agg(F.count("*").alias("n")), "view", "left").fillna(0, ["n"])
    return n.withColumn("problem", F.when(F.col("n") == 0, "none").when(F.col("n") > most, "most"))
