"""Profile planes along an arc, and the cut of a triangle mesh by many planes."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wallscan.functions.geometry import azimuth, plane_distance, profile_u, profile_v, sign_eps


def computed(df: DataFrame, *columns: Column) -> DataFrame:
    """df with columns that are computed once for each row.

    A plain select is merged with those that use it, and then each use computes the column again; behind a generator of one row it isn't."""
    return df.select("*", F.inline(F.array(F.struct(*columns))))


def planes(arc: DataFrame, start: float, step: float, stop: float | None = None, every: int = 1) -> DataFrame:
    """Planes at start + step * k along the arc, from its first angle on: k, slice_key, pos, theta, azimuth, origin, normal, radial direction.

    arc has one row: cx, cy, radius, angle_min, angle_max. Without stop the planes go to the end of the arc."""
    end = F.lit(float(stop)) if stop is not None else F.col("radius") * (F.col("angle_max") - F.col("angle_min"))
    last = F.floor((end - start) / step + 1e-9)
    k = arc.select("*", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"), F.lit(every).cast("long"))).alias("k"))
    return _plane_columns(k.withColumn("pos", start + step * F.col("k")).withColumn("theta", F.col("angle_min") + F.col("pos") / F.col("radius")))


def mid_plane(arc: DataFrame) -> DataFrame:
    """The plane in the middle of the arc's angles."""
    theta = (F.col("angle_min") + F.col("angle_max")) / 2
    return _plane_columns(arc.withColumn("k", F.lit(0).cast("long")).withColumn("pos", (theta - F.col("angle_min")) * F.col("radius")).withColumn("theta", theta))


def _plane_columns(df: DataFrame) -> DataFrame:
    rx, ry = F.cos("theta"), F.sin("theta")
    return df.select("k", F.format_string("%.2f", "pos").alias("slice_key"), "pos", "theta", azimuth(rx, ry).alias("azimuth"), F.col("cx").alias("ox"), F.col("cy").alias("oy"), F.lit(0.0).alias("oz"), ry.alias("nx"), (-rx).alias("ny"), rx.alias("rx"), ry.alias("ry"))


def scanline_grid(arc: DataFrame, n_lat: int, n_lon: int) -> DataFrame:
    """Polylines on the arc wall, n_lat heights by n_lon angles, ends included: lat, lon, x, y, z. arc has one row with z_min and z_max."""
    share = lambda c, n: F.col(c) / max(n - 1, 1)
    both = arc.withColumn("lat", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_lat - 1).cast("long")))).withColumn("lon", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_lon - 1).cast("long"))))
    a = F.col("angle_min") + (F.col("angle_max") - F.col("angle_min")) * share("lon", n_lon)
    return both.select("lat", "lon", (F.col("cx") + F.col("radius") * F.cos(a)).alias("x"), (F.col("cy") + F.col("radius") * F.sin(a)).alias("y"), (F.col("z_min") + (F.col("z_max") - F.col("z_min")) * share("lat", n_lat)).alias("z"))


def scanline_layout(arc: DataFrame, vertices: DataFrame, n: int) -> DataFrame:
    """n radial lines from the centre over the arc's angles and n upright lines over the width of the vertices: kind, i, x1, y1, x2, y2."""
    t = F.col("i") / max(n - 1, 1)
    a = F.col("angle_min") + (F.col("angle_max") - F.col("angle_min")) * t
    numbers = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("i")
    radial = arc.select("*", numbers).select(F.lit("radial").alias("kind"), "i", F.col("cx").alias("x1"), F.col("cy").alias("y1"), (F.col("cx") + F.col("radius") * F.cos(a)).alias("x2"), (F.col("cy") + F.col("radius") * F.sin(a)).alias("y2"))
    low = vertices.agg(F.min("x").alias("x_min"), F.max("x").alias("x_max"), F.min("y").alias("y_min"), F.max("y").alias("y_max"))
    x = F.col("x_min") + (F.col("x_max") - F.col("x_min")) * t
    return radial.unionByName(low.select("*", numbers).select(F.lit("upright").alias("kind"), "i", x.alias("x1"), F.col("y_min").alias("y1"), x.alias("x2"), F.col("y_max").alias("y2")))


def triangles(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """Faces with the coordinates of their vertices; three equi joins on the vertex id."""
    out = faces
    for i in (0, 1, 2):
        out = out.join(vertices.select(F.col("vertex_id").alias(f"v{i}"), *(F.col(d).alias(f"{d}{i}") for d in "xyz")), f"v{i}")
    return out.select("face_id", "v0", "v1", "v2", *(f"{d}{i}" for i in (0, 1, 2) for d in "xyz"))


def filter_faces_z(tri: DataFrame, lo: float, hi: float) -> DataFrame:
    """Faces whose z range overlaps [lo, hi]."""
    return tri.where((F.greatest("z0", "z1", "z2") >= lo) & (F.least("z0", "z1", "z2") <= hi))


def invalid_faces(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """Faces that name a vertex which isn't there."""
    corners = faces.select("face_id", F.explode(F.array("v0", "v1", "v2")).alias("vertex_id"))
    return corners.join(vertices, "vertex_id", "left_anti").select("face_id").distinct()


def near_plane_points(vertices: DataFrame, plane: DataFrame, arc: DataFrame, start: float, step: float, tol: float = 0.1) -> DataFrame:
    """Vertices within tol of planes laid with this start and step along the arc: columns of both.

    A point at radius r is within tol of the planes whose angle, modulo pi, is within asin(tol / r) of its
    own; it is sent to those numbers k only, and an equi join and the exact test follow. A point within tol
    of the axis is near all planes."""
    last = F.floor((F.col("radius") * (F.col("angle_max") - F.col("angle_min")) - start) / step + 1e-9)
    dx, dy = F.col("x") - F.col("cx"), F.col("y") - F.col("cy")
    p = vertices.crossJoin(F.broadcast(arc)).withColumn("_last", last).withColumn("_r", F.sqrt(dx * dx + dy * dy))
    half = F.asin(F.least(F.lit(1.0), tol / F.greatest(F.col("_r"), F.lit(1e-300)))) * F.col("radius") / step
    spans = []
    for m in (-2, -1, 0, 1, 2):
        at = ((F.atan2(dy, dx) + m * math.pi - F.col("angle_min")) * F.col("radius") - start) / step
        lo, hi = F.greatest(F.lit(0), F.floor(at - half - 1e-6)).cast("long"), F.least(F.col("_last"), F.ceil(at + half + 1e-6)).cast("long")
        spans.append(F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<long>")))
    ks = F.when(F.col("_r") <= tol, F.sequence(F.lit(0).cast("long"), F.col("_last").cast("long"))).otherwise(F.array_distinct(F.concat(*spans)))
    near = p.withColumn("k", F.explode(ks)).drop(*arc.columns, "_last", "_r").join(plane, "k")
    return near.where(F.abs(plane_distance("x", "y")) <= tol)


def may_meet(lo: Column, hi: Column, start: float, step: float, spare: float = 0.01) -> Column:
    """Whether a plane may stand between two azimuths or within `spare` steps of them, given the columns radius and angle_min of the arc."""
    place = lambda a: ((a - F.col("angle_min")) * F.col("radius") - start) / step
    return F.floor(place(hi) + spare) >= F.ceil(place(lo) - spare)


def _candidates(tri: DataFrame, arc: DataFrame, start: float, step: float) -> DataFrame:
    """Numbers k of the planes that a face may meet.

    All planes hold the vertical axis through the centre. A face away from the axis meets the planes
    whose angle, modulo pi, lies within the face's azimuths; one about the axis may meet any. The azimuths are
    widened by what a sign of zero allows, at the corner nearest to the axis, and no further: where faces are
    narrower than a step most meet no plane, and those make no row."""
    both = tri.crossJoin(F.broadcast(arc))
    angle = [F.atan2(F.col(f"y{i}") - F.col("cy"), F.col(f"x{i}") - F.col("cx")) for i in (0, 1, 2)]
    both = computed(both, *(a.alias(f"_t{i}") for i, a in enumerate(angle)))
    turn = [F.pmod(F.col(f"_t{i}") - F.col("_t0") + math.pi, F.lit(2 * math.pi)) - math.pi for i in (1, 2)]
    both = computed(both, (F.col("_t0") + F.least(F.lit(0.0), *turn)).alias("_lo"), (F.col("_t0") + F.greatest(F.lit(0.0), *turn)).alias("_hi")).drop("_t0", "_t1", "_t2")
    both = both.withColumn("_r2", F.least(*(F.pow(F.col(f"x{i}") - F.col("cx"), 2) + F.pow(F.col(f"y{i}") - F.col("cy"), 2) for i in (0, 1, 2))))
    any_plane = (F.col("_hi") - F.col("_lo") >= math.pi - 1e-9) | (F.col("_r2") < 1e-12)
    spare = 1e-6 + F.lit(2e-8) / F.greatest(F.sqrt("_r2"), F.lit(1e-6)) * F.col("radius") / step  # twice the sine of the angle at which a corner is 1e-8 off a plane
    last = F.floor((F.col("radius") * (F.col("angle_max") - F.col("angle_min")) - start) / step + 1e-9)
    first_turn, last_turn = F.ceil((F.col("angle_min") - F.col("_hi")) / math.pi - 1e-9), F.floor((F.col("angle_max") - F.col("_lo")) / math.pi + 1e-9)
    turned = both.withColumn("_last", last).withColumn("_m", F.explode(F.when(any_plane, F.array(F.lit(0).cast("long"))).when(first_turn <= last_turn, F.sequence(first_turn.cast("long"), last_turn.cast("long")))))
    place = lambda a: ((F.col(a) + F.col("_m") * math.pi - F.col("angle_min")) * F.col("radius") - start) / step
    lo = F.when(any_plane, F.lit(0)).otherwise(F.greatest(F.lit(0), F.ceil(place("_lo") - spare)))
    hi = F.when(any_plane, F.col("_last")).otherwise(F.least(F.col("_last"), F.floor(place("_hi") + spare)))
    return turned.withColumn("_a", lo.cast("long")).withColumn("_b", hi.cast("long")).where("_a <= _b").withColumn("k", F.explode(F.sequence("_a", "_b"))).drop("_lo", "_hi", "_r2", "_last", "_m", "_a", "_b", *arc.columns)


def cut(tri: DataFrame, planes_table: DataFrame, arc: DataFrame, start: float, step: float) -> DataFrame:
    """The segment of each face in each plane that crosses it: slice_key, k, face_id and both ends in space and in the profile.

    A range join: each face is sent only to the planes within its azimuths, then an equi join on k with the
    table of planes, which is broadcast, so faces stay where they are.
    Signs within 1e-8 are zero; faces with corners on both sides, or with one edge in the plane and
    the third corner on the positive side, give a segment, so an edge in the plane comes once. Points
    on an edge are interpolated from its lower vertex id, so both faces of an edge get equal points.
    """
    near = _candidates(tri, arc, start, step).join(F.broadcast(planes_table), "k")  # a row for each plane
    return segments_of(near)


def _interpolated(kept: list[str]) -> Callable:
    """The first and the last of a face's corners in the plane and its edges through it, as x1, ... z2 beside the columns kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = lambda c: batch.column(batch.schema.get_field_index(c))
            d, s, v, *xyz = (np.stack([column(f"{c}{i}").to_numpy(zero_copy_only=False) for i in (0, 1, 2)]) for c in "dsvxyz")
            corners, edges = np.stack(xyz, 1), ((0, 1), (1, 2), (2, 0))
            there, spots = [*(s == 0), *(s[i] * s[j] < 0 for i, j in edges)], list(corners)
            for i, j in edges:
                first = v[i] < v[j]
                da, db, a, b = np.where(first, d[i], d[j]), np.where(first, d[j], d[i]), np.where(first, corners[i], corners[j]), np.where(first, corners[j], corners[i])
                with np.errstate(divide="ignore", invalid="ignore"):
                    spots.append(a + da / (da - db) * (b - a))
            there, spots, row = np.stack(there), np.stack(spots), np.arange(batch.num_rows)
            ends = [spots[at, :, row].T for at in (there.argmax(0), 5 - there[::-1].argmax(0))]
            names = [*kept, *(f"{c}{i}" for i in (1, 2) for c in "xyz")]
            yield pa.RecordBatch.from_arrays([*(column(c) for c in kept), *(pa.array(c) for end in ends for c in end)], names=names)

    return run


def segments_of(near: DataFrame) -> DataFrame:
    """The exact test and interpolation on rows of a face and a plane."""
    d = computed(near, *(plane_distance(f"x{i}", f"y{i}").alias(f"d{i}") for i in (0, 1, 2)))
    d = computed(d, *(sign_eps(f"d{i}").alias(f"s{i}") for i in (0, 1, 2)))
    signs = [F.col(f"s{i}") for i in (0, 1, 2)]
    count = lambda v: sum((s == v).cast("int") for s in signs)
    hit = d.where(((count(1) > 0) & (count(-1) > 0)) | ((count(0) == 2) & (count(1) == 1)))

    kept = ["slice_key", "k", "face_id", "ox", "oy", "oz", "rx", "ry"]
    given = hit.select(*kept, *(f"{c}{i}" for c in "dsvxyz" for i in (0, 1, 2)))
    schema = T.StructType([*(given.schema[c] for c in kept), *(T.StructField(f"{c}{i}", T.DoubleType()) for i in (1, 2) for c in "xyz")])
    flat = given.mapInArrow(_interpolated(kept), schema)
    return flat.select("slice_key", "k", "face_id", *(f"{c}{i}" for i in (1, 2) for c in "xyz"), *(f.alias(n) for i in (1, 2) for f, n in ((profile_u(f"x{i}", f"y{i}"), f"u{i}"), (profile_v(f"z{i}"), f"v{i}"))))


def nearest_plane(points: DataFrame, planes_table: DataFrame, arc: DataFrame, start: float, step: float) -> DataFrame:
    """The plane nearest to each point, and its distance; the first of equally near ones.

    The distance to plane k is the point's radius times the sine of the angle between; the nearest are the
    planes about the point's azimuth or its antipode, else an end plane. Those few are compared."""
    last = F.floor((F.col("radius") * (F.col("angle_max") - F.col("angle_min")) - start) / step + 1e-9)
    p = points.crossJoin(F.broadcast(arc)).withColumn("_last", last)
    angle = F.atan2(F.col("y") - F.col("cy"), F.col("x") - F.col("cx"))
    guess = [F.rint(((angle + m * math.pi - F.col("angle_min")) * F.col("radius") - start) / step) for m in (-2, -1, 0, 1, 2)]
    ks = F.array_distinct(F.array(F.lit(0.0), F.col("_last").cast("double"), *(F.least(F.col("_last"), F.greatest(F.lit(0.0), g + e)) for g in guess for e in (-1, 0, 1))))
    near = p.withColumn("k", F.explode(F.transform(ks, lambda x: x.cast("long")))).drop(*arc.columns, "_last").join(planes_table, "k")
    best = F.min(F.struct(F.abs(plane_distance("x", "y")).alias("d"), "k"))
    return near.groupBy("point_id").agg(best.alias("b")).select("point_id", F.col("b.k").alias("k"), F.col("b.d").alias("distance"))
