"""Queries on points, rasters, fits, planes and faces, each with its oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from wallscan.functions.geometry import from_profile, line_foot, plane_distance, profile_u, profile_v, r6
from wallscan.functions import geometry as g
from wallscan.operators import clouds, meshes, planes, rasters
from wallscan.plans.fixtures import RADIUS, START, STEP, Fixtures, r6 as sql6, with_ctes
from wallscan.plans.registry import query


def rounded(df, *names):
    return df.select(*(r6(c).alias(c) if c in names else F.col(c) for c in df.columns))


def all6(*names: str) -> str:
    return ", ".join(f"{sql6(n)} AS {n}" for n in names)


PLANE = "ox oy oz nx ny rx ry theta pos".split()

query("p1_filter_points_z", lambda f: clouds.filter_points_z(f.points, 3.0, 6.0), with_ctes("points", "SELECT * FROM points WHERE z BETWEEN 3 AND 6"))
query("p2_filter_faces_z", lambda f: planes.filter_faces_z(f.tri(), 5.2, 9.9).select("face_id"), with_ctes("tri", "SELECT face_id FROM tri WHERE greatest(z0, z1, z2) >= 5.2e0 AND least(z0, z1, z2) <= 9.9e0"))
query("p3_z_band", lambda f: clouds.z_band(f.points, 0.08, 0.4), with_ctes("points", "SELECT p.* FROM points p, (SELECT min(z) a, max(z) b FROM points) WHERE z BETWEEN a + 0.08e0 * (b - a) AND a + 0.4e0 * (b - a)"))
query("p4_planes", lambda f: rounded(f.planes(), *PLANE), with_ctes("planes", f"SELECT k, slice_key, azimuth, {all6(*PLANE)} FROM planes"))
query("p5_mid_plane", lambda f: rounded(planes.mid_plane(f.arc5), *PLANE).drop("slice_key", "k"), with_ctes("arc", f"SELECT azimuth, {all6(*PLANE)} FROM (SELECT cx AS ox, cy AS oy, 0e0 AS oz, (t - angle_min) * radius AS pos, t AS theta, sin(t) AS nx, -cos(t) AS ny, cos(t) AS rx, sin(t) AS ry, round(((degrees(atan2(cos(t), sin(t))) % 360) + 360) % 360, 3) AS azimuth FROM (SELECT *, (angle_min + angle_max) / 2 AS t FROM arc))"))
query("p6_plane_distance", lambda f: f.vertices.crossJoin(F.broadcast(planes.mid_plane(f.arc5))).select("vertex_id", r6(plane_distance("x", "y")).alias("d")), with_ctes("vertices arc", f"SELECT vertex_id, {sql6('x * sin(t) - y * cos(t)')} AS d FROM vertices, (SELECT (angle_min + angle_max) / 2 AS t FROM arc)"))
query("p7_near_plane_points", lambda f: planes.near_plane_points(f.vertices, f.planes(), f.arc5, START, STEP, 0.1).select("vertex_id", "k"), with_ctes("vertices planes", "SELECT vertex_id, k FROM vertices, planes WHERE abs((x - ox) * nx + (y - oy) * ny) <= 0.1e0"))
query("p8_to_profile", lambda f: f.vertices.crossJoin(F.broadcast(planes.mid_plane(f.arc5))).select("vertex_id", r6(profile_u("x", "y")).alias("u"), r6(profile_v("z")).alias("v")), with_ctes("vertices arc", f"SELECT vertex_id, {sql6('x * cos(t) + y * sin(t)')} AS u, {sql6('z')} AS v FROM vertices, (SELECT (angle_min + angle_max) / 2 AS t FROM arc)"))
query("p9_from_profile", lambda f: f.segments().join(f.planes().select("k", "ox", "oy", "oz", "rx", "ry"), "k").select("k", "face_id", *(r6(c).alias(d) for d, c in zip("xyz", from_profile("u1", "v1"), strict=True))), with_ctes("segments", f"SELECT k, face_id, {sql6('x1')} AS x, {sql6('y1')} AS y, {sql6('z1')} AS z FROM segments"))
_LINE = "(SELECT cx + radius * cos(t) AS lx, cy + radius * sin(t) AS ly, cos(t) AS dx, sin(t) AS dy FROM (SELECT *, angle_min + (angle_max - angle_min) * 40e0 / 100 AS t FROM arc))"
query("p10_radial_line", lambda f: rounded(clouds.radial_line(f.arc, 40.0), "lx", "ly", "dx", "dy"), with_ctes("arc", f"SELECT {all6('lx', 'ly', 'dx', 'dy')} FROM line", {"line": _LINE}))
_NEAR = "(SELECT * FROM vertices, line WHERE abs((x - lx) * dy - (y - ly) * dx) / sqrt(dx * dx + dy * dy) <= 0.6e0)"
query("p11_near_line_points", lambda f: clouds.near_line(f.vertices, clouds.radial_line(f.arc, 40.0), 0.6).select("vertex_id"), with_ctes("arc vertices", "SELECT vertex_id FROM near", {"line": _LINE, "near": _NEAR}))
_FLAT = "(SELECT *, x + a * dy AS px, y - a * dx AS py FROM (SELECT *, (x - lx) * -dy + (y - ly) * dx AS a FROM near))"
query("p12_project_to_plane", lambda f: rounded(clouds.project_to_plane(clouds.near_line(f.vertices, clouds.radial_line(f.arc, 40.0), 0.6)).select("vertex_id", "px", "py", "z"), "px", "py"), with_ctes("arc vertices", f"SELECT vertex_id, {all6('px', 'py')}, z FROM flat_", {"line": _LINE, "near": _NEAR, "flat_": _FLAT}))
query("p13_strip_profile", lambda f: rounded(clouds.strip_profile(f.vertices.withColumnRenamed("vertex_id", "point_id"), f.arc, 40.0, 0.6), "u", "v"), with_ctes("arc vertices", f"SELECT vertex_id AS point_id, {sql6('(px - lx) * dx + (py - ly) * dy')} AS u, {sql6('z - (SELECT min(z) FROM vertices)')} AS v FROM flat_", {"line": _LINE, "near": _NEAR, "flat_": _FLAT}))
_LB = "(SELECT regr_slope(y, x) AS a, regr_intercept(y, x) AS b FROM points)"
query("p19_distances", lambda f: clouds.one_row(f.points, clouds.fit_line(f.points)).select("point_id", F.round(g.line_distance("x", "y", "a", "b"), 5).alias("d_line"), r6(g.arc_distance("x", "y", F.lit(1.0), F.lit(2.0), F.lit(9.0))).alias("d_arc")), with_ctes("points", f"SELECT point_id, round(abs(a * x - y + b) / sqrt(a * a + 1), 5) AS d_line, {sql6('abs(sqrt((x - 1) * (x - 1) + (y - 2) * (y - 2)) - 9)')} AS d_arc FROM points, lb", {"lb": _LB}))


def _feet(f: Fixtures):
    fx, fy = line_foot("x", "y", F.lit(0.5), F.lit(1.25))
    return f.points.select("point_id", r6(fx).alias("fx"), r6(fy).alias("fy"))


query("p20_project_to_line", _feet, with_ctes("points", f"SELECT point_id, {sql6('fx')} AS fx, {sql6('0.5e0 * fx + 1.25e0')} AS fy FROM (SELECT point_id, (x + 0.5e0 * (y - 1.25e0)) / (0.5e0 * 0.5e0 + 1) AS fx FROM points)"))
query("p22_rebase_origin", lambda f: rounded(clouds.rebase_origin(f.points), "x", "y"), with_ctes("points", f"SELECT point_id, {sql6('x - a + 5')} AS x, {sql6('y - b + 5')} AS y FROM points, (SELECT min(x) a, min(y) b FROM points)"))
query("p23_crop_window", lambda f: clouds.crop_window(f.points, 10.0, 7.0, 4.0, 3.0), with_ctes("points", "SELECT * FROM points WHERE x BETWEEN 8 AND 12 AND y BETWEEN 5.5e0 AND 8.5e0"))
query("p24_failure_zone", lambda f: clouds.failure_zone(f.orientations, 70.0, 120.0, 30.0, 20.0), with_ctes("orientations", "SELECT id, dip, dip_dir, CASE WHEN f <= 20 AND dip BETWEEN 30 AND 70 THEN 'planar' WHEN f <= 20 AND dip <= 70 THEN 'daylight' WHEN b <= 20 AND dip BETWEEN 30 AND 90 THEN 'overhang' ELSE 'stable' END AS zone FROM (SELECT *, least((dip_dir + 240) % 360, 360 - (dip_dir + 240) % 360) AS f, least((dip_dir + 60) % 360, 360 - (dip_dir + 60) % 360) AS b FROM orientations)"))
query("p25_minmax_gamma", lambda f: rounded(clouds.minmax_gamma(f.points.select("point_id", "z"), "z"), "scaled", "opacity").drop("z"), with_ctes("points", f"SELECT point_id, {sql6('pow(s, 4)')} AS scaled, {sql6('0.8e0 + 0.2e0 * s')} AS opacity FROM (SELECT point_id, (z - a) / (b - a + 1e-8) AS s FROM points, (SELECT min(z) a, max(z) b FROM points))"))

query("a1_dsm_max", lambda f: rasters.dsm(f.points, 0.5, "max"), with_ctes("points", "SELECT floor((y - b) / 0.5e0)::INT AS row, floor((x - a) / 0.5e0)::INT AS col, max(z) AS z FROM points, (SELECT min(x) a, min(y) b FROM points) GROUP BY 1, 2"))
query("a1_dsm_min", lambda f: rasters.dsm(f.points, 0.5, "min"), with_ctes("points", "SELECT floor((y - b) / 0.5e0)::INT AS row, floor((x - a) / 0.5e0)::INT AS col, min(z) AS z FROM points, (SELECT min(x) a, min(y) b FROM points) GROUP BY 1, 2"))
query("a1_dsm_mean", lambda f: rounded(rasters.dsm(f.points, 0.5, "mean"), "z"), with_ctes("points", f"SELECT floor((y - b) / 0.5e0)::INT AS row, floor((x - a) / 0.5e0)::INT AS col, {sql6('avg(z)')} AS z FROM points, (SELECT min(x) a, min(y) b FROM points) GROUP BY 1, 2"))
query("a1_dsm_running", lambda f: rounded(rasters.dsm(f.points, 0.5, "running", "point_id"), "z"), with_ctes("points", f"SELECT row, col, {sql6('list_reduce(zs, lambda a, x: (a + x) / 2)')} AS z FROM (SELECT floor((y - b) / 0.5e0)::INT AS row, floor((x - a) / 0.5e0)::INT AS col, list(z ORDER BY point_id) AS zs FROM points, (SELECT min(x) a, min(y) b FROM points) GROUP BY 1, 2)"))
query("a2_voxel_downsample", lambda f: rounded(clouds.voxel_downsample(f.points, 1.0), "x", "y", "z"), with_ctes("points", f"SELECT floor(x / 1e0)::BIGINT AS ix, floor(y / 1e0)::BIGINT AS iy, floor(z / 1e0)::BIGINT AS iz, count(*) AS n, {sql6('avg(x)')} AS x, {sql6('avg(y)')} AS y, {sql6('avg(z)')} AS z FROM points GROUP BY 1, 2, 3"))
query("a3_occupied_voxels", lambda f: clouds.occupied_voxels(f.points, 0.7), with_ctes("points", "SELECT DISTINCT floor(x / 0.7e0)::BIGINT AS ix, floor(y / 0.7e0)::BIGINT AS iy, floor(z / 0.7e0)::BIGINT AS iz FROM points"))
query("a4_quantile_centre", lambda f: rounded(clouds.quantile_centre(f.points, 0.15), "x", "y", "z"), with_ctes("points", f"SELECT {sql6('avg(x)')} AS x, {sql6('avg(y)')} AS y, {sql6('avg(z)')} AS z, count(*) AS n FROM points WHERE z >= (SELECT quantile_cont(z, 0.15) FROM points)"))
query("a4_quantile_vertices", lambda f: rounded(clouds.quantile_centre(f.vertices.select("y", F.col("x").alias("z"), F.col("z").alias("x")), 0.37), "x", "y", "z"), with_ctes("vertices", f"SELECT {sql6('avg(z)')} AS x, {sql6('avg(y)')} AS y, {sql6('avg(x)')} AS z, count(*) AS n FROM vertices WHERE x >= (SELECT quantile_cont(x, 0.37) FROM vertices)"))
query("a18_fit_line", lambda f: clouds.fit_line(f.points).select(F.round("a", 5).alias("a"), F.round("b", 5).alias("b")), with_ctes("points", "SELECT round(regr_slope(y, x), 5) AS a, round(regr_intercept(y, x), 5) AS b FROM points"))
# Gauss-Newton steps from the wall's axis, one table expression each: the normal equations of the distances to a circle, solved by Cramer's rule.
_STEP = "(SELECT g.cx + (rx * (m22 * m33 - m23 * m23) - m12 * (ry * m33 - m23 * rr) + m13 * (ry * m23 - m22 * rr)) / det AS cx, g.cy + (m11 * (ry * m33 - m23 * rr) - rx * (m12 * m33 - m23 * m13) + m13 * (m12 * rr - ry * m13)) / det AS cy, g.r + (m11 * (m22 * rr - ry * m23) - m12 * (m12 * rr - ry * m13) + rx * (m12 * m23 - m22 * m13)) / det AS r FROM (SELECT *, m11 * (m22 * m33 - m23 * m23) - m12 * (m12 * m33 - m23 * m13) + m13 * (m12 * m23 - m22 * m13) AS det FROM (SELECT any_value(cx) AS cx, any_value(cy) AS cy, any_value(r) AS r, sum(a * a) AS m11, sum(a * b) AS m12, -sum(a) AS m13, sum(b * b) AS m22, -sum(b) AS m23, count(*)::DOUBLE AS m33, -sum(a * e) AS rx, -sum(b * e) AS ry, sum(e) AS rr FROM (SELECT cx, cy, r, (cx - x) / d AS a, (cy - y) / d AS b, d - r AS e FROM (SELECT g.*, x, y, sqrt((x - g.cx) * (x - g.cx) + (y - g.cy) * (y - g.cy)) AS d FROM vertices, {0} g)))) g)"
_FIT = {"g0": "(SELECT 0e0 AS cx, 0e0 AS cy, avg(sqrt(x * x + y * y)) AS r FROM vertices)", **{f"g{i + 1}": _STEP.format(f"g{i}") for i in range(8)}}
query("a19_fit_arc", lambda f: f.spark.createDataFrame([tuple(round(v, 5) for v in clouds.fit_arc(f.vertices))], "cx double, cy double, r double"), with_ctes("vertices", "SELECT round(cx, 5) AS cx, round(cy, 5) AS cy, round(r, 5) AS r FROM g8", _FIT))
query("a20_arc_angles", lambda f: rounded(clouds.arc_angles(f.vertices, -1.0, 0.5), "angle_min", "angle_max"), with_ctes("vertices", f"SELECT {sql6('min(atan2(y - 0.5e0, x + 1))')} AS angle_min, {sql6('max(atan2(y - 0.5e0, x + 1))')} AS angle_max FROM vertices"))
query("a21_fit_rmse", lambda f: clouds.fit_rmse(f.vertices, 0.0, 0.0, RADIUS).select(*(F.round(c, 5).alias(c) for c in ("line_rmse", "arc_rmse"))), with_ctes("vertices", f"SELECT round(sqrt(avg(pow(abs(a * x - y + b) / sqrt(a * a + 1), 2))), 5) AS line_rmse, round(sqrt(avg(pow(sqrt(x * x + y * y) - {RADIUS}e0, 2))), 5) AS arc_rmse FROM vertices, (SELECT regr_slope(y, x) AS a, regr_intercept(y, x) AS b FROM vertices)"))
query("a22_residual_histogram", lambda f: clouds.histogram(f.points.select(g.arc_distance("x", "y", F.lit(10.03), F.lit(7.51), F.lit(4.17)).alias("e")), "e", 50), with_ctes("points", "SELECT least(49, floor((e - lo) / (hi - lo) * 50))::INT AS bin, count(*) AS n FROM (SELECT *, min(e) OVER () AS lo, max(e) OVER () AS hi FROM (SELECT abs(sqrt((x - 10.03e0) * (x - 10.03e0) + (y - 7.51e0) * (y - 7.51e0)) - 4.17e0) AS e FROM points)) GROUP BY 1"))

_DSM = "(SELECT floor((y - b) / 0.1e0)::INT AS row, floor((x - a) / 0.1e0)::INT AS col, max(z) AS z FROM points, (SELECT min(x) a, min(y) b FROM points) GROUP BY 1, 2)"


def _sparse(f: Fixtures):
    """The surface of all points in fine cells, of which some are empty."""
    low = f.points.agg(F.min("x").alias("a"), F.min("y").alias("b"))
    p = clouds.one_row(f.points, low)
    return p.groupBy(F.floor((F.col("y") - F.col("b")) / 0.1).cast("int").alias("row"), F.floor((F.col("x") - F.col("a")) / 0.1).cast("int").alias("col")).agg(F.max("z").alias("z"))


query("o17_dsm_fill", lambda f: rounded(rasters.fill(_sparse(f), 150, 200), "z"), with_ctes("points", f"SELECT g.row, g.col, {sql6('coalesce(d.z, m.z)')} AS z FROM grid_ g LEFT JOIN dsm d ON d.row = g.row AND d.col = g.col LEFT JOIN (SELECT r0, c0, avg(d.z) AS z FROM (SELECT g.row AS r0, g.col AS c0, greatest(0, least(149, g.row + a.a)) AS r, greatest(0, least(199, g.col + b.b)) AS c FROM grid_ g, (SELECT unnest([-1, 0, 1]) AS a) a, (SELECT unnest([-1, 0, 1]) AS b) b) n JOIN dsm d ON d.row = n.r AND d.col = n.c GROUP BY 1, 2) m ON m.r0 = g.row AND m.c0 = g.col", {"dsm": _DSM, "grid_": "(SELECT r::INT AS row, c::INT AS col FROM range(150) a(r), range(200) b(c))"}))
query("o18_dsm_mesh", lambda f: rasters.to_mesh(_sparse(f), 0.1, 150), with_ctes("points", "SELECT v AS v0, v + 150 AS v1, v + 1 AS v2 FROM full_ UNION ALL SELECT v + 150, v + 151, v + 1 FROM full_", {"dsm": _DSM, "full_": "(SELECT d.row + d.col * 150 AS v FROM dsm d JOIN dsm r ON r.row = d.row AND r.col = d.col + 1 JOIN dsm u ON u.row = d.row + 1 AND u.col = d.col JOIN dsm q ON q.row = d.row + 1 AND q.col = d.col + 1)"}))

query("j1_triangles", lambda f: f.tri().select("face_id", *(f"{d}{i}" for i in (0, 1, 2) for d in "xyz")), with_ctes("tri", f"SELECT face_id, {', '.join(f'{d}{i}' for i in (0, 1, 2) for d in 'xyz')} FROM tri"))
query("j2_cut", lambda f: rounded(f.cut().select("k", "slice_key", "face_id", *(f"{d}{i}" for i in (1, 2) for d in "xyz")), *(f"{d}{i}" for i in (1, 2) for d in "xyz")), with_ctes("segments", f"SELECT k, slice_key, face_id, {all6(*(f'{d}{i}' for i in (1, 2) for d in 'xyz'))} FROM segments"))
query("p27_project_slices", lambda f: rounded(f.cut().select("k", "face_id", "u1", "v1", "u2", "v2"), "u1", "v1", "u2", "v2"), with_ctes("segments", f"SELECT k, face_id, {all6('u1', 'v1', 'u2', 'v2')} FROM segments"))
query("j6_nearest_plane", lambda f: planes.nearest_plane(f.points.select("point_id", (F.col("x") * 4 + 10).alias("x"), (F.col("y") * 6 - 40).alias("y")), f.planes(), f.arc5, START, STEP).select("point_id", r6("distance").alias("distance")), with_ctes("points planes", f"SELECT point_id, {sql6('min(abs((x * 4 + 10) * nx + (y * 6 - 40) * ny))')} AS distance FROM points, planes GROUP BY 1"))
query("j10_invalid_faces", lambda f: planes.invalid_faces(f.faces(), f.vertices.where("vertex_id % 37 != 5")), with_ctes("faces vertices", "SELECT DISTINCT face_id FROM (SELECT face_id, unnest([v0, v1, v2]) AS v FROM faces) WHERE v NOT IN (SELECT vertex_id FROM vertices WHERE vertex_id % 37 <> 5)"))
query("a14_mesh_bounds", lambda f: meshes.bounds(f.tri()), with_ctes("tri", "SELECT " + ", ".join(f"min(least({d}0, {d}1, {d}2)) AS {d}_min, max(greatest({d}0, {d}1, {d}2)) AS {d}_max" for d in "xyz") + " FROM tri"))
query("a14_grid_meta", lambda f: meshes.grid_meta(f.tri(), 0.5), with_ctes("tri", "SELECT " + ", ".join(f"min(least({d}0, {d}1, {d}2)) AS o{d}, ceil((max(greatest({d}0, {d}1, {d}2)) - min(least({d}0, {d}1, {d}2))) / 0.5e0)::INT AS n{d}" for d in "xyz") + " FROM tri"))
_EDGES = "(SELECT least(a, b) AS lo, greatest(a, b) AS hi, face_id, CASE WHEN a < b THEN 1 ELSE -1 END AS s FROM (SELECT face_id, v0 AS a, v1 AS b FROM {0} UNION ALL SELECT face_id, v1, v2 FROM {0} UNION ALL SELECT face_id, v2, v0 FROM {0}))"
query("a15_mesh_check", lambda f: meshes.mesh_check(f.faces()), with_ctes("faces", "SELECT count(*) AS n_edges, count(*) FILTER (n = 1) AS n_border, bool_and(n = 2) AS watertight, bool_and(n <> 2 OR s = 0) AS winding FROM (SELECT lo, hi, count(*) AS n, sum(s) AS s FROM e GROUP BY 1, 2)", {"e": _EDGES.format("faces")}))
query("o8_face_edges", lambda f: meshes.face_edges(f.faces()), with_ctes("faces", "SELECT DISTINCT p.face_id AS a, q.face_id AS b FROM e p JOIN e q ON p.lo = q.lo AND p.hi = q.hi AND p.face_id < q.face_id", {"e": _EDGES.format("faces")}))
_LOW, _HIGH = [("x0", "y0", "z0"), ("x1", "y1", "z1"), ("x2", "y2", "z2")], [("x0", "y0", "top"), ("x1", "y1", "top"), ("x2", "y2", "top")]
_PARTS = [_LOW, _HIGH, *(x for i in (0, 1, 2) for x in ([_LOW[i], _LOW[(i + 1) % 3], _HIGH[(i + 1) % 3]], [_LOW[i], _HIGH[(i + 1) % 3], _HIGH[i]]))]
_PRISM = [f"p{d}{i}" for i in (0, 1, 2) for d in "xyz"]
query("o15_prisms", lambda f: rounded(meshes.prisms(f.tri(), f.faces().select("face_id", (F.col("face_id") % 7 * 0.25).alias("height"))).select("face_id", "part", *_PRISM), *_PRISM), with_ctes("tri", " UNION ALL ".join(f"SELECT face_id, {n} AS part, " + ", ".join(f"{sql6(c)} AS p{d}{i}" for i, corner in enumerate(part) for d, c in zip("xyz", corner, strict=True)) + " FROM topped" for n, part in enumerate(_PARTS)), {"topped": "(SELECT *, (z0 + z1 + z2) / 3 + (face_id % 7) * 0.25e0 AS top FROM tri)"}))


def _submesh(f: Fixtures):
    chosen, _ = meshes.submesh(f.faces(), f.faces().where("face_id % 11 < 3").select("face_id"))
    return chosen


query("o16_submesh", _submesh, with_ctes("faces", "SELECT c.face_id, a.n AS v0, b.n AS v1, d.n AS v2 FROM chosen c JOIN used a ON a.v = v0 JOIN used b ON b.v = v1 JOIN used d ON d.v = v2", {"chosen": "(SELECT * FROM faces WHERE face_id % 11 < 3)", "used": "(SELECT v, row_number() OVER (ORDER BY v) - 1 AS n FROM (SELECT DISTINCT unnest([v0, v1, v2]) AS v FROM chosen))"}))


query("o20_scanline_grid", lambda f: rounded(planes.scanline_grid(f.arc, 9, 21), "x", "y", "z"), with_ctes("arc", f"SELECT lat, lon, {sql6('cx + radius * cos(angle_min + (angle_max - angle_min) * lon / 20)')} AS x, {sql6('cy + radius * sin(angle_min + (angle_max - angle_min) * lon / 20)')} AS y, {sql6('z_min + (z_max - z_min) * lat / 8')} AS z FROM arc, range(9) a(lat), range(21) b(lon)"))


query("o21_scanline_layout", lambda f: rounded(planes.scanline_layout(f.arc, f.vertices, 12), "x1", "y1", "x2", "y2"), with_ctes("arc vertices", f"SELECT 'radial' AS kind, i, {sql6('cx')} AS x1, {sql6('cy')} AS y1, {sql6('cx + radius * cos(angle_min + (angle_max - angle_min) * i / 11)')} AS x2, {sql6('cy + radius * sin(angle_min + (angle_max - angle_min) * i / 11)')} AS y2 FROM arc, range(12) r(i) UNION ALL SELECT 'upright', i, {sql6('a + (b - a) * i / 11')}, {sql6('c')}, {sql6('a + (b - a) * i / 11')}, {sql6('d')} FROM (SELECT min(x) a, max(x) b, min(y) c, max(y) d FROM vertices), range(12) r(i)"))


def _arith():
    return F.pmod(F.col("point_id") % 1_000_003 * 7919 + 13, F.lit(1_000_003))


query("t6_sample_points", lambda f: clouds.sample_points(f.points, n=500, key=_arith()), with_ctes("points", "SELECT * FROM points ORDER BY ((point_id % 1000003) * 7919 + 13) % 1000003, point_id LIMIT 500"))
query("t6_sample_fraction", lambda f: clouds.sample_points(f.points, fraction=0.1, key=_arith()), with_ctes("points", "SELECT point_id, x, y, z FROM (SELECT *, row_number() OVER (ORDER BY ((point_id % 1000003) * 7919 + 13) % 1000003, point_id) AS r FROM points) WHERE r <= floor((SELECT count(*) FROM points) * 0.1e0)"))
query("s11_quantise_points", lambda f: clouds.quantise(f.points), with_ctes("points", "SELECT point_id, " + ", ".join(f"round_even(({d} - {d}_off) / 0.001e0, 0)::INT AS q{d}, {d}_off" for d in "xyz") + " FROM points, (SELECT " + ", ".join(f"min({d}) AS {d}_off" for d in "xyz") + " FROM points)"))
