"""Faces, their graph, and sub-meshes: faces(face_id, v0, v1, v2), vertices(vertex_id, x, y, z)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wallscan.operators.neighbours import moved, numbered


def edges_of(faces: DataFrame) -> DataFrame:
    """Three directed edges for each face: face_id, a, b, lo, hi."""
    e = F.array(F.struct(F.col("v0").alias("a"), F.col("v1").alias("b")), F.struct(F.col("v1").alias("a"), F.col("v2").alias("b")), F.struct(F.col("v2").alias("a"), F.col("v0").alias("b")))
    return faces.select("face_id", F.inline(e)).select("face_id", "a", "b", F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"))


def face_edges(faces: DataFrame) -> DataFrame:
    """Pairs of faces that share an edge, a < b."""
    e = edges_of(faces).select("lo", "hi", "face_id")
    return e.select("lo", "hi", F.col("face_id").alias("a")).join(e.select("lo", "hi", F.col("face_id").alias("b")), ["lo", "hi"]).where("a < b").select("a", "b").distinct()


def valid_pairs(faces: DataFrame) -> DataFrame:
    """Pairs of faces a <= b on which the ends of one segment may lie: equal, or with a common edge."""
    return faces.select(F.col("face_id").alias("a"), F.col("face_id").alias("b")).unionByName(face_edges(faces))


def mesh_check(faces: DataFrame) -> DataFrame:
    """Counts, and whether each edge is in two faces (watertight) that use it in opposite directions (winding)."""
    e = edges_of(faces).groupBy("lo", "hi").agg(F.count("*").alias("n"), F.sum(F.when(F.col("a") == F.col("lo"), 1).otherwise(-1)).alias("s"))
    return e.agg(F.count("*").alias("n_edges"), F.count(F.when(F.col("n") == 1, 1)).alias("n_border"), F.coalesce(F.bool_and(F.col("n") == 2), F.lit(True)).alias("watertight"), F.coalesce(F.bool_and((F.col("n") != 2) | (F.col("s") == 0)), F.lit(True)).alias("winding"))


def select_faces(faces: DataFrame, ids: DataFrame) -> DataFrame:
    return faces.join(ids, "face_id", "left_semi")


def submesh(faces: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Selected faces with compact vertex ids, and old and new id of the vertices used.

    New ids count from 0 by old id."""
    chosen = select_faces(faces, ids)
    used = chosen.select(F.explode(F.array("v0", "v1", "v2")).alias("vertex_id")).distinct()
    new = numbered(used, "vertex_id", "new_id")
    out = chosen
    for i in (0, 1, 2):
        out = out.join(new.select(F.col("vertex_id").alias(f"v{i}"), F.col("new_id").alias(f"w{i}")), f"v{i}")
    return out.select("face_id", *(F.col(f"w{i}").alias(f"v{i}") for i in (0, 1, 2))), new


def bounds(tri: DataFrame) -> DataFrame:
    """Least and greatest corner of triangles."""
    return tri.agg(*(F.min(F.least(*(f"{d}{i}" for i in (0, 1, 2)))).alias(f"{d}_min") for d in "xyz"), *(F.max(F.greatest(*(f"{d}{i}" for i in (0, 1, 2)))).alias(f"{d}_max") for d in "xyz"))


def grid_meta(tri: DataFrame, size: float) -> DataFrame:
    """Origin and dimensions of a voxel grid over a mesh."""
    return bounds(tri).select(*(F.col(f"{d}_min").alias(f"o{d}") for d in "xyz"), *(F.ceil((F.col(f"{d}_max") - F.col(f"{d}_min")) / size).cast("int").alias(f"n{d}") for d in "xyz"))


def prisms(tri: DataFrame, heights: DataFrame) -> DataFrame:
    """Eight triangles for each face: base, top at mean z + height, and the sides; columns face_id, part and corners.

    Heights are of as many faces as the mesh may have, so they are moved by face."""
    t = tri.join(moved(heights), "face_id").withColumn("top", (F.col("z0") + F.col("z1") + F.col("z2")) / 3 + F.col("height"))
    low = [tuple(F.col(f"{d}{i}") for d in "xyz") for i in (0, 1, 2)]
    high = [(F.col(f"x{i}"), F.col(f"y{i}"), F.col("top")) for i in (0, 1, 2)]
    parts = [low, high] + [x for i in (0, 1, 2) for x in ([low[i], low[(i + 1) % 3], high[(i + 1) % 3]], [low[i], high[(i + 1) % 3], high[i]])]
    rows = [F.struct(F.lit(n).alias("part"), *(c.alias(f"p{d}{i}") for i, p in enumerate(corners) for d, c in zip("xyz", p, strict=True))) for n, corners in enumerate(parts)]
    return t.select("face_id", F.inline(F.array(*rows)))


def layers(runs: DataFrame) -> DataFrame:
    """The distinct voxels of runs(ix, iy, first, last) of layers. Runs of a column that overlap or touch are united first, so each voxel is listed once."""
    column = Window.partitionBy("ix", "iy").orderBy("first", "last")
    before = F.max("last").over(column.rowsBetween(Window.unboundedPreceding, -1))
    apart = F.coalesce(F.col("first") > before + 1, F.lit(True)).cast("int")
    joined = runs.where("first <= last").withColumn("_new", apart).withColumn("_run", F.sum("_new").over(column.rowsBetween(Window.unboundedPreceding, 0)))
    joined = joined.groupBy("ix", "iy", "_run").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    return joined.select("ix", "iy", F.explode(F.sequence("first", "last")).alias("iz"))


def voxelise(tri: DataFrame, heights: DataFrame, meta: DataFrame, size: float) -> DataFrame:
    """Distinct voxels whose centre lies in a face's vertical prism, from its least z to its mean z + height.

    Faces of almost no height or area are skipped; cells outside the grid are cut off. Columns of cells are
    made first and tested; the runs of layers of a column are united before they are listed."""
    return voxelise_raised(tri.join(moved(heights), "face_id"), meta, size)


def voxelise_raised(raised: DataFrame, meta: DataFrame, size: float) -> DataFrame:
    """voxelise for triangles that have a height."""
    t = raised.where("height > 1e-8").crossJoin(F.broadcast(meta))
    cross = lambda a, b, px, py: (F.col(f"x{b}") - F.col(f"x{a}")) * (py - F.col(f"y{a}")) - (F.col(f"y{b}") - F.col(f"y{a}")) * (px - F.col(f"x{a}"))
    t = t.where(F.abs(cross(0, 1, F.col("x2"), F.col("y2"))) / 2 >= 1e-10)
    for d in "xy":
        lo, hi = F.least(*(f"{d}{i}" for i in (0, 1, 2))), F.greatest(*(f"{d}{i}" for i in (0, 1, 2)))
        a, b = F.greatest(F.lit(0), F.floor((lo - F.col(f"o{d}")) / size)), F.least(F.col(f"n{d}") - 1, F.ceil((hi - F.col(f"o{d}")) / size))
        t = t.withColumn(f"_a{d}", a.cast("int")).withColumn(f"_b{d}", b.cast("int")).where(f"_a{d} <= _b{d}").withColumn(f"i{d}", F.explode(F.sequence(f"_a{d}", f"_b{d}")))
    px, py = (F.col("ox") + size * (F.col("ix") + 0.5)), (F.col("oy") + size * (F.col("iy") + 0.5))
    sides = [cross(0, 1, px, py), cross(1, 2, px, py), cross(2, 0, px, py)]
    inside = (F.least(*sides) > 0) | (F.greatest(*sides) < 0)
    low, high = F.least("z0", "z1", "z2"), (F.col("z0") + F.col("z1") + F.col("z2")) / 3 + F.col("height")
    t = t.where(inside).withColumn("_lo", low).withColumn("_hi", high)
    centre = lambda n: F.col("oz") + size * (n + 0.5)
    a, b = F.greatest(F.lit(0), F.floor((F.col("_lo") - F.col("oz")) / size)), F.least(F.col("nz") - 1, F.ceil((F.col("_hi") - F.col("oz")) / size))
    first = F.when(centre(a) >= F.col("_lo"), a).otherwise(a + 1)
    last = F.when(centre(b) <= F.col("_hi"), b).when(centre(b - 1) <= F.col("_hi"), b - 1).otherwise(b - 2)
    return layers(t.select("ix", "iy", first.cast("int").alias("first"), last.cast("int").alias("last")))


def points_in_mesh(tri: DataFrame, meta: DataFrame, size: float) -> DataFrame:
    """Cells whose centre lies inside at least one of several closed meshes (mesh_id): an odd number of its faces above it.

    The crossings of a column with a mesh, from the top, bound runs of layers that are inside; the runs of
    all meshes are united before they are listed.

    The ray is moved off the centre by a ten-millionth of a cell, so that it meets no shared edge twice."""
    t = tri.crossJoin(F.broadcast(meta))
    cross = lambda a, b, px, py: (F.col(f"x{b}") - F.col(f"x{a}")) * (py - F.col(f"y{a}")) - (F.col(f"y{b}") - F.col(f"y{a}")) * (px - F.col(f"x{a}"))
    for d in "xy":
        lo, hi = F.least(*(f"{d}{i}" for i in (0, 1, 2))), F.greatest(*(f"{d}{i}" for i in (0, 1, 2)))
        t = t.withColumn(f"i{d}", F.explode(F.sequence(F.greatest(F.lit(0), F.floor((lo - F.col(f"o{d}")) / size)).cast("int"), F.least(F.col(f"n{d}") - 1, F.floor((hi - F.col(f"o{d}")) / size)).cast("int"))))
    px, py = (F.col("ox") + size * (F.col("ix") + 0.5 + 1e-7)), (F.col("oy") + size * (F.col("iy") + 0.5 + 1.7e-7))
    w0, w1, w2 = cross(1, 2, px, py), cross(2, 0, px, py), cross(0, 1, px, py)
    total = w0 + w1 + w2
    inside = (total != 0) & (w0 * total > 0) & (w1 * total > 0) & (w2 * total > 0)
    hit = t.where(inside).withColumn("_z", (w0 * F.col("z0") + w1 * F.col("z1") + w2 * F.col("z2")) / total)
    top = F.floor((F.col("_z") - F.col("oz")) / size - 0.5).cast("int")
    column = Window.partitionBy("mesh_id", "ix", "iy").orderBy(F.col("_top").desc())
    crossed = hit.withColumn("_top", top).withColumn("_n", F.row_number().over(column)).withColumn("_next", F.lead("_top").over(column)).where("_n % 2 = 1")
    return layers(crossed.select("ix", "iy", F.greatest(F.lit(0), F.coalesce(F.col("_next") + 1, F.lit(0))).alias("first"), F.least(F.col("nz") - 1, F.col("_top")).alias("last")))


def voxel_centres(voxels: DataFrame, meta: DataFrame, size: float) -> DataFrame:
    return voxels.crossJoin(F.broadcast(meta)).select(*voxels.columns, *((F.col(f"o{d}") + size * (F.col(f"i{d}") + 0.5)).alias(d) for d in "xyz"))


def sample_segments(segments: DataFrame, step: float) -> DataFrame:
    """max(2, int(length / step)) points along each segment, ends included."""
    length = F.sqrt(sum((F.pow(F.col(f"{d}2") - F.col(f"{d}1"), 2) for d in "xyz"), F.lit(0.0)))
    s = segments.withColumn("n", F.greatest(F.lit(2), F.floor(length / step + 1e-9).cast("int"))).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    t = F.col("i") / (F.col("n") - 1)
    return s.select("k", "face_id", "i", *((F.col(f"{d}1") + t * (F.col(f"{d}2") - F.col(f"{d}1"))).alias(d) for d in "xyz"))
