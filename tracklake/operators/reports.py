"""Reports of overlaps, refinements, submaps and whole assemblies as tables of checks; models joined from their tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklake.functions import rotation
from tracklake.operators.checks import checks
from tracklake.sources.readers import number_text

c = F.col
_QUATERNION = ("qx", "qy", "qz", "qw")


def overlap_differences(overlaps: DataFrame, key: str = "segment_id", frame: str = "frame") -> DataFrame:
    """key, first_window, frame, center_m, rotation_deg of poses a and b of one frame in following windows."""
    square = sum(((c(f"b_{x}") - c(f"a_{x}")) * (c(f"b_{x}") - c(f"a_{x}")) for x in "yz"), (c("b_x") - c("a_x")) * (c("b_x") - c("a_x")))
    angle = rotation.angle_between(*[tuple(c(f"{s}_{q}") for q in _QUATERNION) for s in "ab"])  # type: ignore[arg-type]
    return overlaps.select(key, "first_window", frame, F.sqrt(square).alias("center_m"), F.degrees(angle).alias("rotation_deg"))


def overlap_report(differences: DataFrame, least: int, center_m: Sequence[float], rotation_deg: Sequence[float], key: str = "segment_id") -> DataFrame:
    """Seven checks of each pair of windows: frames in common, and median, p95 and largest of both differences."""
    names = ("median", "p95", "max")
    found = differences.groupBy(key, "first_window").agg(
        F.count("*").alias("n"),
        *[f.alias(f"{v}_{n}") for v in ("center_m", "rotation_deg") for n, f in zip(names, (F.percentile(v, 0.5), F.percentile(v, 0.95), F.max(v)), strict=True)],
    )
    gates: dict[str, tuple[Column, float | None, float | None]] = {"frames": (c("n"), least, None)}
    for v, bounds in (("center_m", center_m), ("rotation_deg", rotation_deg)):
        gates |= {f"{v}_{n}": (c(f"{v}_{n}"), None, bound) for n, bound in zip(names, bounds, strict=True)}
    return checks(found, [key, "first_window"], gates)


def overlap_lines(differences: DataFrame, key: str = "segment_id", frame: str = "frame") -> DataFrame:
    """Text lines ``segment,first,second,frame,center,rotation``, sorted when written."""
    return differences.select(F.concat_ws(",", key, "first_window", c("first_window") + 1, frame, number_text(c("center_m")), number_text(c("rotation_deg"))).alias("line"))


def refinement_acceptance(source: DataFrame, refined: DataFrame, max_loss: float, *keys: str) -> DataFrame:
    """Eight checks of a refinement against its source: nothing that counts got worse by more than a share.

    Both tables have a row a key: images, points, observations, track_length, reprojection_px, median_m, p95_m, inlier_share.
    """
    larger = ("images", "points", "observations", "track_length", "inlier_share")
    smaller = ("reprojection_px", "median_m", "p95_m")
    a = source.select(*keys, *[c(x).alias(f"a_{x}") for x in larger + smaller])
    b = refined.select(*keys, *[c(x).alias(f"b_{x}") for x in larger + smaller])
    ratio = lambda x: c(f"b_{x}") / F.when(c(f"a_{x}") != 0, c(f"a_{x}"))
    gates = {"images": (ratio("images"), 1.0, None)} | {x: (ratio(x), 1 - max_loss, None) for x in larger[1:]} | {x: (ratio(x), None, 1 + max_loss) for x in smaller}
    return checks(a.join(b, list(keys), "left"), list(keys), gates)


def acceptance(tables: Sequence[DataFrame], advisory: Sequence[str], *keys: str) -> DataFrame:
    """keys, n_checks, n_failed, failed (sorted names), accepted: whether no check fails but advisory ones.

    ``tables``: check tables with keys, name, passed.
    """
    all_ = reduce(DataFrame.unionByName, [t.select(*keys, "name", "passed") for t in tables])
    failed = ~c("passed")
    binding = failed & ~c("name").isin(*advisory) if advisory else failed
    return all_.groupBy(*keys).agg(
        F.count("*").alias("n_checks"), F.count_if(failed).alias("n_failed"),
        F.array_join(F.array_sort(F.collect_set(F.when(failed, c("name")))), ",").alias("failed"), (F.count_if(binding) == 0).alias("accepted"),
    )


def camera_priors(images: DataFrame, priors: DataFrame) -> DataFrame:
    """name, x, y, z, problem: the prior of each image that has one; not Cartesian, not positive semidefinite, repeated."""
    n = priors.groupBy("image_id").agg(F.count("*").alias("_n"))
    m = {k: c(k) for k in ("xx", "xy", "xz", "yy", "yz", "zz")}
    det = m["xx"] * (m["yy"] * m["zz"] - m["yz"] * m["yz"]) - m["xy"] * (m["xy"] * m["zz"] - m["yz"] * m["xz"]) + m["xz"] * (m["xy"] * m["yz"] - m["yy"] * m["xz"])
    minors = [m["xx"], m["yy"], m["zz"], m["xx"] * m["yy"] - m["xy"] * m["xy"], m["xx"] * m["zz"] - m["xz"] * m["xz"], m["yy"] * m["zz"] - m["yz"] * m["yz"], det]
    whole = reduce(lambda a, b: a & b, [x >= 0 for x in minors])
    problem = F.when(c("system") != "cartesian", "not cartesian").when(~F.coalesce(whole, F.lit(False)), "not semidefinite").when(c("_n") > 1, "repeated")
    return images.join(priors.join(n, "image_id"), "image_id").select("name", "x", "y", "z", problem.alias("problem"))


def rig_trajectory(sensors: DataFrame, frames: DataFrame, images: DataFrame) -> DataFrame:
    """name, frame_id, camera, centre (x, y, z), lefts: camera_from_world is sensor_from_rig times rig_from_world.

    ``sensors``: rig_id, camera, sensor_from_rig; ``frames``: frame_id, rig_id, rig_from_world (row-major 4x4 arrays);
    ``images``: name, frame_id, camera. ``lefts`` is the number of the frame's images of the camera ``left``; one is right.
    """
    lefts = images.where("camera = 'left'").groupBy("frame_id").agg(F.count("*").alias("lefts"))
    joined = images.join(frames, "frame_id").join(sensors, ["rig_id", "camera"]).join(lefts, "frame_id", "left")
    cell = lambda name: tuple(F.element_at(name, k + 1) for k in range(16))
    view = rotation.product4(cell("sensor_from_rig"), cell("rig_from_world"))
    x, y, z = rotation.camera_center(view)
    return joined.select("name", "frame_id", "camera", x.alias("x"), y.alias("y"), z.alias("z"), F.coalesce("lefts", F.lit(0).cast("long")).alias("lefts"))


def quaternion_product(a: Sequence[Column], b: Sequence[Column]) -> tuple[Column, ...]:
    """The rotation b, then a."""
    (x, y, z, w), (p, q, r, s) = a, b
    return w * p + x * s + y * r - z * q, w * q - x * r + y * s + z * p, w * r + x * q - y * p + z * s, w * s - x * p - y * q - z * r


def camera_from_antenna(
    position: Sequence[Column], yaw: Column, lever: Sequence[float], mount: Sequence[Column], baseline_yaw: float = 0.0, roll: Column | None = None, pitch: Column | None = None
) -> tuple[tuple[Column, ...], tuple[Column, ...]]:
    """Centre and rotation (quaternion) of a camera from an antenna's position and heading.

    ``baseline_yaw``: angle of the antennas' baseline against the vehicle; ``lever``: from antenna to camera in the
    vehicle's axes; ``mount``: rotation from camera to vehicle; tilt is optional.
    """
    level = F.lit(0.0)
    body = rotation.from_euler(level if roll is None else roll, level if pitch is None else pitch, yaw - baseline_yaw)
    r = rotation.matrix(body)
    center = tuple(position[i] + r[3 * i] * lever[0] + r[3 * i + 1] * lever[1] + r[3 * i + 2] * lever[2] for i in range(3))
    return center, quaternion_product(body, mount)


def reprojection_check(rows: DataFrame, *keys: str) -> DataFrame:
    """keys, n, median_px, p95_px, px_per_s: predicted (pu, pv) against observed (ou, ov) pixels, and against the
    prediction ``dt_s`` later (lu, lv), which tells how much a clock error would show."""
    away = lambda a, b: F.sqrt((c(f"{a}u") - c(f"{b}u")) * (c(f"{a}u") - c(f"{b}u")) + (c(f"{a}v") - c(f"{b}v")) * (c(f"{a}v") - c(f"{b}v")))
    found = rows.select(*keys, away("p", "o").alias("_d"), (away("l", "p") / c("dt_s")).alias("_s"))
    return found.groupBy(*keys).agg(F.count("*").alias("n"), F.percentile("_d", 0.5).alias("median_px"), F.percentile("_d", 0.95).alias("p95_px"), F.percentile("_s", 0.5).alias("px_per_s"))
