"""Column expressions of plane geometry; every one is built in and stays inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-8


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def r6(c: Column | str) -> Column:
    """Six decimals, without a negative zero."""
    c = col(c)
    return F.when(F.abs(c) < 5e-7, F.lit(0.0)).otherwise(F.round(c, 6))


def key6(c: Column | str) -> Column:
    """A coordinate as a whole number of millionths: an exact key for points that are computed twice."""
    return F.rint(col(c) * 1e6).cast("long")


def sign_eps(c: Column | str, eps: float = EPS) -> Column:
    c = col(c)
    return F.when(c > eps, 1).when(c < -eps, -1).otherwise(0)


def plane_distance(x, y) -> Column:
    """Signed distance of a point to a vertical plane with columns ox, oy, nx, ny."""
    return (col(x) - F.col("ox")) * F.col("nx") + (col(y) - F.col("oy")) * F.col("ny")


def profile_u(x, y) -> Column:
    """Horizontal profile coordinate: along the radial direction from the origin."""
    return (col(x) - F.col("ox")) * F.col("rx") + (col(y) - F.col("oy")) * F.col("ry")


def profile_v(z) -> Column:
    return col(z) - F.col("oz")


def from_profile(u, v) -> tuple[Column, Column, Column]:
    """The point in space of a profile point, of a plane with columns ox, oy, oz, rx, ry."""
    return F.col("ox") + col(u) * F.col("rx"), F.col("oy") + col(u) * F.col("ry"), F.col("oz") + col(v)


def azimuth(rx, ry) -> Column:
    """Degrees clockwise from north, three decimals."""
    return F.round(F.pmod(F.degrees(F.atan2(col(rx), col(ry))), F.lit(360.0)), 3)


def hypot2(a, b) -> Column:
    return F.sqrt(col(a) * col(a) + col(b) * col(b))


def angle_from_down(nu, nv) -> Column:
    """Degrees between a normal (nu, nv) and straight down."""
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), -col(nv) / hypot2(nu, nv)))))


def seed_angle(du, dv) -> Column:
    """Degrees between a segment's normal and the horizontal axis; null for a segment of no length."""
    length = hypot2(du, dv)
    return F.when(length > 0, F.degrees(F.acos(F.least(F.lit(1.0), F.abs(col(dv)) / length))))


def line_distance(x, y, a, b) -> Column:
    """Distance to the line y = a x + b."""
    return F.abs(col(a) * col(x) - col(y) + col(b)) / F.sqrt(col(a) * col(a) + 1)


def arc_distance(x, y, cx, cy, r) -> Column:
    return F.abs(hypot2(col(x) - col(cx), col(y) - col(cy)) - col(r))


def line_foot(x, y, a, b) -> tuple[Column, Column]:
    """Foot of the perpendicular on y = a x + b."""
    a, b = col(a), col(b)
    fx = (col(x) + a * (col(y) - b)) / (a * a + 1)
    return fx, a * fx + b
