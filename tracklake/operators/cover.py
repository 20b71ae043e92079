"""Covers of boxes and of view frusta by grid cells, so that points meet them by equal keys.

A box gets, on each axis, the grid whose cells are the next power of two above its side; it touches two of these cells at
most, so it is at most four rows whatever its size. A point looks into one cell of every pair of grids that any box has.
The exact test comes after. Spark decides by size whether the cells of the boxes are broadcast.

For frusta, which are unbounded, the points make an octree: nodes are the cells that hold any, with the largest radius
inside, and one tree for each class of radii, so that a few large spheres don't widen all cells. Views
go down the tree level by level, by equal parent cells; only nodes that reach into a frustum go on.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklake.operators.pairs import checkpointed

#: Exponents of the smallest and the largest cell of a grid.
LOWEST, HIGHEST = -30, 60
_BOX = ("lo_u", "lo_v", "hi_u", "hi_v")


def _grid(low: str, high: str) -> Column:
    side = F.col(high) - F.col(low)
    return F.greatest(F.lit(LOWEST), F.least(F.lit(HIGHEST), F.ceil(F.log2(F.greatest(side, F.lit(2.0**LOWEST)))).cast("int"))).cast("int")


def _cell(value: Column, grid: Column) -> Column:
    return F.floor(value / F.pow(F.lit(2.0), grid)).cast("long")


def covered(boxes: DataFrame) -> DataFrame:
    """The boxes (lo_u, lo_v, hi_u, hi_v, edges included) once for each cell that they touch: gu, gv, cu, cv."""
    rows = boxes.where("lo_u <= hi_u and lo_v <= hi_v").withColumns({"gu": _grid("lo_u", "hi_u"), "gv": _grid("lo_v", "hi_v")})
    for c in "uv":
        g = F.col(f"g{c}")
        rows = rows.withColumn(f"c{c}", F.explode(F.sequence(_cell(F.col(f"lo_{c}"), g), _cell(F.col(f"hi_{c}"), g))))
    return rows


def grids(cells: DataFrame) -> list[tuple[int, int]]:
    """The pairs of grids in use: at most one for every two powers of two, whatever the number of boxes."""
    return sorted((r.gu, r.gv) for r in cells.select("gu", "gv").distinct().collect())


def in_boxes(points: DataFrame, boxes: DataFrame) -> DataFrame:
    """Each point (u, v) with each box that holds it, edges included; all columns of both."""
    cells = checkpointed(covered(boxes))
    used = grids(cells)
    if not used:
        return points.join(cells.drop("gu", "gv", "cu", "cv"), F.lit(False))
    looks = F.array(*[F.struct(F.lit(gu).alias("gu"), F.lit(gv).alias("gv"), _cell(F.col("u"), F.lit(gu)).alias("cu"), _cell(F.col("v"), F.lit(gv)).alias("cv")) for gu, gv in used])
    looking = points.where("u is not null and v is not null and not isnan(u) and not isnan(v)").select("*", F.inline(looks))
    inside = F.col("u").between(F.col("lo_u"), F.col("hi_u")) & F.col("v").between(F.col("lo_v"), F.col("hi_v"))
    return looking.join(cells, ["gu", "gv", "cu", "cv"]).where(inside).drop("gu", "gv", "cu", "cv")


def overlapping_pairs(boxes: DataFrame, identity: str) -> DataFrame:
    """a, b: the identities (a < b) of every two boxes whose insides overlap, each pair once.

    Two boxes meet in the grid that is the larger of theirs on each axis, where both touch four cells at most, and count
    in the cell of their overlap's lower corner.
    """
    rows = boxes.where("lo_u < hi_u and lo_v < hi_v").select(identity, *_BOX, _grid("lo_u", "hi_u").alias("gu"), _grid("lo_v", "hi_v").alias("gv"))
    rows = checkpointed(rows)
    used = {c: sorted(r[0] for r in rows.select(f"g{c}").distinct().collect()) for c in "uv"}  # a few powers of two
    for c in "uv":
        own = F.col(f"g{c}")
        larger = F.array_compact(F.array(*[F.when(own <= g, F.lit(g)) for g in used[c]])) if used[c] else F.array().cast("array<int>")
        rows = rows.withColumn(f"k{c}", F.explode(larger))
        rows = rows.withColumn(f"c{c}", F.explode(F.sequence(_cell(F.col(f"lo_{c}"), F.col(f"k{c}")), _cell(F.col(f"hi_{c}"), F.col(f"k{c}")))))
    key = ["ku", "kv", "cu", "cv"]
    a, b = (rows.select(*key, *[F.col(c).alias(f"{side}_{c}") for c in (identity, *_BOX, "gu", "gv")]) for side in "ab")
    here = F.col(f"a_{identity}") < F.col(f"b_{identity}")
    for c in "uv":
        low = F.greatest(f"a_lo_{c}", f"b_lo_{c}")
        here = here & (F.greatest(f"a_g{c}", f"b_g{c}") == F.col(f"k{c}")) & (low < F.least(f"a_hi_{c}", f"b_hi_{c}")) & (_cell(low, F.col(f"k{c}")) == F.col(f"c{c}"))
    return a.join(b, key).where(here).select(F.col(f"a_{identity}").alias("a"), F.col(f"b_{identity}").alias("b"))


def holders(points: DataFrame, boxes: DataFrame, identity: str, holds: Callable[[Column], Column], out: str) -> DataFrame:
    """Every point (u, v) once, with the sorted array of the identities of the boxes that ``holds`` says hold it.

    The boxes of a cell are gathered beforehand, so every join finds one row at most and points are never repeated.
    """
    cells = checkpointed(covered(boxes))
    found, box = F.array().cast(f"array<{boxes.schema[identity].dataType.simpleString()}>"), F.struct(identity, *_BOX)
    held = points
    for k, (gu, gv) in enumerate(grids(cells)):
        own = cells.where((F.col("gu") == gu) & (F.col("gv") == gv)).groupBy(F.col("cu").alias("_cu"), F.col("cv").alias("_cv")).agg(F.collect_list(box).alias(f"_boxes{k}"))
        met = (_cell(F.col("u"), F.lit(gu)) == F.col("_cu")) & (_cell(F.col("v"), F.lit(gv)) == F.col("_cv"))
        held = held.join(own, met, "left").drop("_cu", "_cv")
        inside = F.transform(F.filter(F.col(f"_boxes{k}"), holds), lambda b: b[identity])
        found = F.concat(found, F.coalesce(inside, F.array().cast(f"array<{boxes.schema[identity].dataType.simpleString()}>")))
    return held.withColumn(out, F.array_sort(found)).select(*points.columns, out)


def _reaches(near: float, far: float | None, radius: Column) -> Column:
    """Whether a sphere about x, y, z reaches inside a view's side planes, beyond its near plane and before the far one."""
    m = [F.col(f"m{k}") for k in range(12)]
    cam = [m[4 * k] * F.col("x") + m[4 * k + 1] * F.col("y") + m[4 * k + 2] * F.col("z") + m[4 * k + 3] for k in range(3)]
    keep = cam[2] + radius > near
    if far is not None:
        keep = keep & (cam[2] - radius < far)
    for c, f, center, size in ((cam[0], "fx", "cx", "width"), (cam[1], "fy", "cy", "height")):
        for sign, edge in ((1, F.col(center)), (-1, F.col(size) - F.col(center))):
            slope = edge / F.col(f)
            keep = keep & (sign * c + slope * cam[2] > -radius * F.sqrt(1 + slope * slope))
    return keep


def frustum_candidates(spheres: DataFrame, views: DataFrame, near: float, far: float | None = None, leaf: int = 512, identity: str = "id") -> DataFrame:
    """View columns with the spheres (identity, x, y, z, radius) of every octree leaf that reaches into the view's frustum.

    ``leaf``: about how many spheres a leaf holds if they are spread evenly. Spheres whose place or radius is null or
    isn't finite are left out.
    """
    finite = F.lit(True)
    for c in ("x", "y", "z", "radius"):
        finite = finite & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    good = spheres.select(identity, *[F.col(c).cast("double").alias(c) for c in ("x", "y", "z", "radius")]).where(finite)
    span = good.agg(F.count("*").alias("n"), *[f(c).alias(f"{n}_{c}") for c in "xyz" for n, f in (("lo", F.min), ("hi", F.max))]).first()
    side = max([span[f"hi_{c}"] - span[f"lo_{c}"] for c in "xyz"] + [1e-9]) if span.n else 1.0
    depth = max(1, min(20, math.ceil(math.log(max(span.n / leaf, 1), 8)) + 1))
    size = side / (1 << depth) * (1 + 1e-12)
    # spheres up to half a leaf are one class, larger ones go by powers of two
    kind = F.greatest(F.ceil(F.log2(F.greatest(F.col("radius"), F.lit(size / 2)) / (size / 2))), F.lit(0)).cast("int")
    at = {f"_{c}": F.floor((F.col(c) - F.lit(span[f"lo_{c}"] or 0.0)) / size).cast("long") for c in "xyz"}
    placed = good.withColumns({"_kind": kind, **at})
    key = ["_kind", "_x", "_y", "_z"]
    nodes = [checkpointed(placed.groupBy(*key).agg(F.max("radius").alias("_most")))]
    for _ in range(depth):
        up = [F.shiftright(c, 1).alias(c) for c in key[1:]]
        nodes.append(checkpointed(nodes[-1].groupBy("_kind", *up).agg(F.max("_most").alias("_most"))))
    # views begin at the top nodes: one for each class of radii, at cell 0
    going = views.select("*", F.lit(0).cast("long").alias("_x"), F.lit(0).cast("long").alias("_y"), F.lit(0).cast("long").alias("_z"))
    for level in range(depth, -1, -1):
        cells = nodes[level]
        if level == depth:
            kinds = [r._kind for r in cells.select("_kind").distinct().collect()]  # a few powers of two
            going = going.withColumn("_kind", F.explode(F.array(*[F.lit(k) for k in kinds]) if kinds else F.array().cast("array<int>"))).join(cells, key)
        else:
            parent = [F.shiftright(c, 1).alias(f"_p{c}") for c in key[1:]]
            cells = cells.select(*key, F.col("_most").alias("_own"), F.col("_kind").alias("_pk"), *parent)
            up = going.select(*views.columns, F.col("_kind").alias("_pk"), *[F.col(c).alias(f"_p{c}") for c in key[1:]])
            going = up.join(cells, ["_pk", *[f"_p{c}" for c in key[1:]]]).drop("_pk", *[f"_p{c}" for c in key[1:]]).withColumnRenamed("_own", "_most")
        width = size * (1 << level)
        center = {c: (F.col(f"_{c}") + 0.5) * width + F.lit(span[f"lo_{c}"] or 0.0) for c in "xyz"}
        bound = (width * math.sqrt(3) / 2 + F.col("_most")) * (1 + 1e-9)
        going = checkpointed(going.withColumns(center).where(_reaches(near, far, bound)).drop("x", "y", "z"))
    return going.drop("_most").join(placed, key).drop(*key)


def in_frustum(spheres: DataFrame, views: DataFrame, near: float, far: float | None = None, leaf: int = 512, identity: str = "id") -> DataFrame:
    """view columns and identity of the spheres (identity, x, y, z, radius) that reach into each frustum, tested one by one in the leaves that do.

    ``views``: row-major rotation and translation m0 to m11, fx, fy, cx, cy, width, height, and any other columns.
    """
    met = frustum_candidates(spheres, views, near, far, leaf, identity)
    return met.where(_reaches(near, far, F.col("radius"))).select(*views.columns, identity)
