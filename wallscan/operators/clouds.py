"""Operators on point clouds: points(point_id, x, y, z)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wallscan.functions.geometry import arc_distance, hypot2, line_distance


def one_row(df: DataFrame, row: DataFrame) -> DataFrame:
    """df with the columns of a table of one row (an ungrouped aggregate), which is broadcast."""
    return df.crossJoin(F.broadcast(row))


def filter_points_z(points: DataFrame, lo: float, hi: float) -> DataFrame:
    return points.where(F.col("z").between(lo, hi))


def z_band(points: DataFrame, f_lo: float, f_hi: float) -> DataFrame:
    """Points in a sub-band of the observed z range, by fractions of it."""
    band = points.agg(F.min("z").alias("z_min"), F.max("z").alias("z_max"))
    lo, hi = (F.col("z_min") + f * (F.col("z_max") - F.col("z_min")) for f in (f_lo, f_hi))
    return one_row(points, band).where(F.col("z").between(lo, hi)).select(points.columns)


def voxel_downsample(points: DataFrame, size: float, dims: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """One averaged point for each occupied voxel; voxels are anchored at zero."""
    keys = [F.floor(F.col(d) / size).alias(f"i{d}") for d in dims]
    return points.groupBy(*keys).agg(F.count("*").alias("n"), *(F.avg(d).alias(d) for d in dims))


def occupied_voxels(points: DataFrame, size: float) -> DataFrame:
    return points.select(*(F.floor(F.col(d) / size).alias(f"i{d}") for d in "xyz")).distinct()


#: Buckets of a round of exact_quantile; no more values come to the driver.
BUCKETS = 4096


def exact_quantile(df: DataFrame, value: str, q: float) -> float | None:
    """The interpolated quantile of a column, exact: lower + (upper - lower) * fraction of the two values beside rank q * (n - 1).

    Values are counted in BUCKETS of equal width, and the bucket that holds the wanted rank is counted
    again between its own least and greatest value, until it is one value or has few, so each round is one
    partial aggregate of at most BUCKETS rows, however many distinct values there are. Nulls and NaN don't
    count; without values the quantile is None."""
    held = df.select(F.col(value).cast("double").alias("v")).where("v is not null and not isnan(v)")
    n, lo, hi = held.agg(F.count("*"), F.min("v"), F.max("v")).first()
    if not n:
        return None
    rank = q * (n - 1)
    left = int(rank)  # the rank within the bucket
    while lo < hi:
        inside = held.where(F.col("v").between(lo, hi))
        place = F.least(F.lit(BUCKETS - 1), F.floor((F.col("v") - lo) / (hi - lo) * BUCKETS))
        known = inside.agg(F.count("*")).first()[0] <= BUCKETS
        key = F.col("v") if known else place
        rows = inside.groupBy(key.alias("b")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("b").collect()  # at most BUCKETS rows
        for row in rows:
            if left < row.n:
                lo, hi = row.lo, row.hi
                break
            left -= row.n
    upto, after = held.agg(F.count(F.when(F.col("v") <= lo, 1)), F.min(F.when(F.col("v") > lo, F.col("v")))).first()
    upper = lo if upto > int(rank) + 1 or after is None else after
    return lo + (upper - lo) * (rank - int(rank))


def quantile_centre(points: DataFrame, q: float) -> DataFrame:
    """Mean of the points at or above the interpolated z quantile, and their number; nulls and 0 without points."""
    cut = exact_quantile(points, "z", q)
    return points.where(F.col("z") >= F.lit(cut)).agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.avg("z").alias("z"), F.count("*").alias("n"))


def sample_points(points: DataFrame, n: int | None = None, fraction: float | None = None, key: Column | None = None, id_col: str = "point_id") -> DataFrame:
    """A reproducible uniform sample without replacement: the n rows (or int(N * fraction)) with the least key; default key: a hash of the id.

    A fraction is taken by the rank of the key within hash groups, so nothing is sorted as a whole."""
    key = F.xxhash64(id_col) if key is None else key
    if n is not None:
        return points.withColumn("_k", key).orderBy("_k", id_col).limit(n).drop("_k")
    wanted = points.agg(F.floor(F.count("*") * fraction).alias("wanted"))
    keyed = points.withColumn("_k", key)
    bucket = keyed.withColumn("_b", F.floor(F.col("_k") / _bucket_width(keyed)))
    sizes = bucket.groupBy("_b").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n"))  # at most 4,096 rows
    ranked = bucket.join(F.broadcast(before), "_b").withColumn("_r", F.row_number().over(Window.partitionBy("_b").orderBy("_k", id_col)) + F.col("_before"))
    return one_row(ranked, wanted).where("_r <= wanted").select(points.columns)


def _bucket_width(keyed: DataFrame) -> float:
    lo, hi = keyed.agg(F.min("_k"), F.max("_k")).first()
    return max(((hi or 0) - (lo or 0)) / 4000.0, 1e-12)


def drop_outliers(points: DataFrame, neighbours: DataFrame, k: int, ratio: float) -> DataFrame:
    """Points whose mean distance to their k nearest (themselves included) is below mean + ratio * population deviation of all; all points when fewer than k.

    neighbours has id and distance, k rows for each point."""
    mean = neighbours.groupBy("id").agg(F.avg("distance").alias("d"), F.count("*").alias("n"))
    limit = mean.agg((F.avg("d") + ratio * F.stddev_pop("d")).alias("cut"), F.min("n").alias("least"))
    keep = one_row(mean, limit).where(f"d < cut or least < {k}").select("id")
    return points.join(keep, "id", "left_semi")


def fit_line(points: DataFrame) -> DataFrame:
    """Least squares y = a x + b."""
    return points.agg(F.regr_slope("y", "x").alias("a"), F.regr_intercept("y", "x").alias("b"))


def fit_arc(points: DataFrame, rounds: int = 30, tolerance: float = 1e-12) -> tuple[float, float, float]:
    """Least squares circle (cx, cy, r).

    The algebraic fit is the start; each Gauss-Newton step is one aggregate of the 3 x 3 normal
    equations over all points, solved on the driver."""
    import numpy as np

    x, y = F.col("x"), F.col("y")
    q = x * x + y * y
    m = points.agg(*(F.sum(e) for e in (x * x, x * y, x, y * y, y, F.lit(1.0), x * q, y * q, q))).first()
    if m[5] is None:
        raise ValueError("no points")
    a, b, c = np.linalg.lstsq(np.array([[m[0], m[1], m[2]], [m[1], m[3], m[4]], [m[2], m[4], m[5]]]), np.array([m[6], m[7], m[8]]), rcond=None)[0]
    cx, cy = a / 2, b / 2
    r = float(np.sqrt(max(c + cx * cx + cy * cy, 0.0)))
    for _ in range(rounds):
        dx, dy = x - float(cx), y - float(cy)
        d = F.greatest(F.sqrt(dx * dx + dy * dy), F.lit(1e-300))
        jx, jy, e = dx / d, dy / d, d - r
        s = points.agg(*(F.sum(v) for v in (jx * jx, jx * jy, jx, jy * jy, jy, F.lit(1.0), jx * e, jy * e, e))).first()
        step = np.linalg.lstsq(np.array([[s[0], s[1], s[2]], [s[1], s[3], s[4]], [s[2], s[4], s[5]]]), np.array([s[6], s[7], s[8]]), rcond=None)[0]
        cx, cy, r = cx + step[0], cy + step[1], r + step[2]
        if np.abs(step).max() < tolerance:
            break
    return float(cx), float(cy), float(r)


def arc_angles(points: DataFrame, cx: float, cy: float) -> DataFrame:
    a = F.atan2(F.col("y") - cy, F.col("x") - cx)
    return points.agg(F.min(a).alias("angle_min"), F.max(a).alias("angle_max"))


def fit_rmse(points: DataFrame, cx: float, cy: float, r: float) -> DataFrame:
    """Root mean square distance to the fitted line and to an arc."""
    both = one_row(points, fit_line(points))
    return both.agg(F.sqrt(F.avg(F.pow(line_distance("x", "y", "a", "b"), 2))).alias("line_rmse"), F.sqrt(F.avg(F.pow(arc_distance("x", "y", F.lit(cx), F.lit(cy), F.lit(r)), 2))).alias("arc_rmse"))


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """Equal-width bins from least to greatest value; the last is closed."""
    ends = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    place = F.least(F.lit(bins - 1), F.floor((F.col(value) - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins))
    return one_row(df, ends).groupBy(F.coalesce(place, F.lit(0)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def radial_line(arc: DataFrame, percent: float) -> DataFrame:
    """Point and direction of the radial line at a percentage of the arc's angles."""
    theta = F.col("angle_min") + (F.col("angle_max") - F.col("angle_min")) * percent / 100
    return arc.select((F.col("cx") + F.col("radius") * F.cos(theta)).alias("lx"), (F.col("cy") + F.col("radius") * F.sin(theta)).alias("ly"), F.cos(theta).alias("dx"), F.sin(theta).alias("dy"))


def near_line(points: DataFrame, line: DataFrame, most: float) -> DataFrame:
    """Points within `most` of the infinite line in the xy plane; z is ignored. Adds the line's columns."""
    both = one_row(points, line)
    d = F.abs((F.col("x") - F.col("lx")) * F.col("dy") - (F.col("y") - F.col("ly")) * F.col("dx")) / hypot2("dx", "dy")
    return both.where(d <= most)


def project_to_plane(near: DataFrame) -> DataFrame:
    """Removes the component across the line: columns px, py."""
    across = (F.col("x") - F.col("lx")) * -F.col("dy") + (F.col("y") - F.col("ly")) * F.col("dx")
    return near.withColumn("px", F.col("x") + across * F.col("dy")).withColumn("py", F.col("y") - across * F.col("dx"))


def strip_profile(points: DataFrame, arc: DataFrame, percent: float, most: float) -> DataFrame:
    """(u along the radial line, v above the lowest of all points) of the points near it."""
    floor = points.agg(F.min("z").alias("z_floor"))
    near = project_to_plane(near_line(points, radial_line(arc, percent), most))
    u = (F.col("px") - F.col("lx")) * F.col("dx") + (F.col("py") - F.col("ly")) * F.col("dy")
    return one_row(near, floor).select("point_id", u.alias("u"), (F.col("z") - F.col("z_floor")).alias("v"))


def rebase_origin(points: DataFrame, pad: float = 5.0) -> DataFrame:
    """Shifts the cloud so that its minimum corner lies at (pad, pad)."""
    low = points.agg(F.min("x").alias("x_low"), F.min("y").alias("y_low"))
    return one_row(points, low).select("point_id", (F.col("x") - F.col("x_low") + pad).alias("x"), (F.col("y") - F.col("y_low") + pad).alias("y"))


def crop_window(points: DataFrame, cx: float, cy: float, width: float, height: float) -> DataFrame:
    return points.where(F.col("x").between(cx - width / 2, cx + width / 2) & F.col("y").between(cy - height / 2, cy + height / 2))


def quantise(points: DataFrame, scale: float = 0.001) -> DataFrame:
    """Whole steps of `scale` from the column minimum, and that offset."""
    low = points.agg(*(F.min(d).alias(f"{d}_off") for d in "xyz"))
    return one_row(points, low).select("point_id", *(F.rint((F.col(d) - F.col(f"{d}_off")) / scale).cast("int").alias(f"q{d}") for d in "xyz"), *(f"{d}_off" for d in "xyz"))


def failure_zone(orientations: DataFrame, slope_dip: float, slope_dir: float, friction: float, offset: float) -> DataFrame:
    """Kinematic class of each orientation (dip, dip_dir): daylight and planar zones about the slope direction, overhang zone opposite."""
    def apart(direction: float) -> Column:
        d = F.pmod(F.col("dip_dir") - direction, F.lit(360.0))
        return F.least(d, 360.0 - d)

    facing, behind = apart(slope_dir) <= offset, apart(slope_dir + 180) <= offset
    zone = F.when(facing & F.col("dip").between(friction, slope_dip), "planar").when(facing & (F.col("dip") <= slope_dip), "daylight").when(behind & F.col("dip").between(friction, 90), "overhang").otherwise("stable")
    return orientations.withColumn("zone", zone)


def minmax_gamma(df: DataFrame, value: str, gamma: float = 4.0) -> DataFrame:
    """Scaled to 0..1, then to the power gamma; opacity rises from 0.8 to 1."""
    ends = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    s = (F.col(value) - F.col("lo")) / (F.col("hi") - F.col("lo") + 1e-8)
    return one_row(df, ends).withColumn("scaled", F.pow(s, gamma)).withColumn("opacity", 0.8 + 0.2 * s).drop("lo", "hi")
