"""Queries on neighbours, clusters, voxels, densities and stores, each with its oracle."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from wallscan.functions.geometry import r6
from wallscan.operators import clouds, clusters as cl, meshes, neighbours as nb, profiles as pr
from wallscan.plans.fixtures import Fixtures, r6 as sql6, with_ctes
from wallscan.plans.profile_queries import FACED, GROW, heights, scratch
from wallscan.plans.registry import ORACLES, query
from wallscan.sources import store, text, tiles
from wallscan.streaming.recognition import read_recognised, recognise_pieces_stream, recognise_stream, write_heights_stream

#: Voxels of recognised faces; the clustering of all of them, where neighbours are at most one step away in two directions; and that of a tenth of them.
VOX, EPS, SAMPLES, WIDE, DENSE = 0.2, 0.29, 10, 0.5, 5


def _face_heights(f: Fixtures, planes: str = "true"):
    """The greatest recognised height of each face over all planes, or some."""
    return pr.face_heights(heights(f).where(planes), "max").select("face_id", "height")


_META = "(SELECT " + ", ".join(f"min(least({d}0, {d}1, {d}2)) AS o{d}, ceil((max(greatest({d}0, {d}1, {d}2)) - min(least({d}0, {d}1, {d}2))) / {VOX}e0)::INT AS n{d}" for d in "xyz") + " FROM tri_g)"
_CROSS = lambda a, b: f"((x{b} - x{a}) * (py - y{a}) - (y{b} - y{a}) * (px - x{a}))"
_VOXELS = {
    **GROW,
    **FACED,
    "meta": _META,
    "prism": "(SELECT t.*, h.height, m.* FROM tri_g t JOIN (SELECT face_id, max(height) AS height FROM faced WHERE face_id IS NOT NULL GROUP BY 1) h USING (face_id), meta m WHERE h.height > 1e-8 AND abs((x1 - x0) * (y2 - y0) - (y1 - y0) * (x2 - x0)) / 2 >= 1e-10)",
    "col": f"(SELECT *, ox + {VOX}e0 * (ix + 0.5e0) AS px, oy + {VOX}e0 * (iy + 0.5e0) AS py FROM (SELECT *, unnest(range(greatest(0, floor((least(y0, y1, y2) - oy) / {VOX}e0))::BIGINT, least(ny - 1, ceil((greatest(y0, y1, y2) - oy) / {VOX}e0))::BIGINT + 1)) AS iy FROM (SELECT *, unnest(range(greatest(0, floor((least(x0, x1, x2) - ox) / {VOX}e0))::BIGINT, least(nx - 1, ceil((greatest(x0, x1, x2) - ox) / {VOX}e0))::BIGINT + 1)) AS ix FROM prism)))",
    "inside": f"(SELECT *, least(z0, z1, z2) AS lo, (z0 + z1 + z2) / 3 + height AS hi FROM col WHERE least({_CROSS(0, 1)}, {_CROSS(1, 2)}, {_CROSS(2, 0)}) > 0 OR greatest({_CROSS(0, 1)}, {_CROSS(1, 2)}, {_CROSS(2, 0)}) < 0)",
    "vox": f"(SELECT DISTINCT ix::INT AS ix, iy::INT AS iy, iz::INT AS iz FROM (SELECT *, unnest(range(greatest(0, floor((lo - oz) / {VOX}e0))::BIGINT, least(nz - 1, floor((hi - oz) / {VOX}e0))::BIGINT + 1)) AS iz FROM inside) WHERE oz + {VOX}e0 * (iz + 0.5e0) BETWEEN lo AND hi)",
}


def voxels(f: Fixtures, planes: str = "true"):
    return meshes.voxelise_raised(f.tri_of(_face_heights(f, planes).where("height > 1e-8"), gaps=True), _meta(f), VOX)


def _meta(f: Fixtures):
    return f.grid_meta(VOX)


def voxel_points(f: Fixtures):
    """All voxels with a number and their centres, kept for the query."""
    number = ((F.col("ix").cast("long") * 100_000 + F.col("iy")) * 100_000 + F.col("iz")).alias("id")
    return f.kept("voxel points", lambda: meshes.voxel_centres(voxels(f), _meta(f), VOX).select(number, "ix", "iy", "iz", "x", "y", "z"))


def exact6(c):
    """Six decimals by operations that give the same number in any engine."""
    return F.floor(F.col(c) * 1e6 + 0.5) / 1e6


def voxel_sql(body: str, names: str = "", more: dict | None = None) -> str:
    return with_ctes(f"keyed_g tri_g {names}", body, {**_VOXELS, **(more or {})}, recursive=True)


query("o14_voxelise", voxels, voxel_sql("SELECT * FROM vox"))
_PARTS = {f"{n}{i}": re.sub(r"\b(prism|col|inside)\b(?= WHERE|\)| h)", rf"\g<1>{i}", _VOXELS[n]).replace("FROM faced WHERE face_id", f"FROM faced WHERE k % 2 = {i} AND face_id") for i in (0, 1) for n in ("prism", "col", "inside", "vox")}
query("u2_voxel_union", lambda f: voxels(f, "k % 2 = 0").unionByName(voxels(f, "k % 2 = 1")).distinct(), voxel_sql("SELECT * FROM vox0 UNION SELECT * FROM vox1", more=_PARTS))
query("p21_voxel_centres", lambda f: voxel_points(f).select("ix", "iy", "iz", *(r6(d).alias(d) for d in "xyz")), voxel_sql("SELECT ix, iy, iz, " + ", ".join(f"{sql6(f'o{d} + {VOX}e0 * (i{d} + 0.5e0)')} AS {d}" for d in "xyz") + " FROM vox, meta"))


def _box_meta(f: Fixtures):
    high = f.lineitem.agg((F.floor(F.max("l_partkey") / 8) * 4 + 8).cast("int").alias("ny"))
    return f.vertices.agg(F.max("z").cast("int").alias("nz")).crossJoin(high).select(*(F.lit(0.0).alias(f"o{d}") for d in "xyz"), F.lit(30).alias("nx"), "ny", "nz")


def _boxes(f: Fixtures):
    """A closed box for each part number: place and size follow the part's lines."""
    b = f.lineitem.groupBy("l_partkey").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("q"))
    b = b.select(F.col("l_partkey").alias("id"), (F.col("l_partkey") % 8 * 3 + 0.1).alias("x_lo"), (F.expr("l_partkey div 8") * 4 + 0.1).alias("y_lo"), (1 + F.col("n") % 3 + 0.3).alias("w"), (1 + F.col("q") % 5 + 0.3).alias("h"))
    return b.withColumn("x_hi", F.col("x_lo") + F.col("w")).withColumn("y_hi", F.col("y_lo") + F.col("w"))


_BOXES = "(SELECT *, x_lo + w AS x_hi, y_lo + w AS y_hi FROM (SELECT l_partkey AS id, l_partkey % 8 * 3 + 0.1e0 AS x_lo, (l_partkey // 8) * 4 + 0.1e0 AS y_lo, 1 + count(*) % 3 + 0.3e0 AS w, 1 + sum(l_quantity) % 5 + 0.3e0 AS h FROM lineitem GROUP BY l_partkey))"


def _box_triangles(f: Fixtures):
    """Twelve outward faces of each box, from z 0.1 to h."""
    corner = lambda i: tuple(F.col(n) if isinstance(n, str) else F.lit(n) for n in (("x_hi" if i & 1 else "x_lo"), ("y_hi" if i & 2 else "y_lo"), ("h" if i & 4 else 0.1)))
    quads = [(0, 2, 3, 1), (4, 5, 7, 6), (0, 1, 5, 4), (2, 6, 7, 3), (0, 4, 6, 2), (1, 3, 7, 5)]
    tris = [t for a, b, c, d in quads for t in ((a, b, c), (a, c, d))]
    rows = [F.struct(F.lit(n).alias("n"), *(v.alias(f"{d}{k}") for k, i in enumerate(t) for d, v in zip("xyz", corner(i), strict=True))) for n, t in enumerate(tris)]
    return _boxes(f).select(F.col("id").alias("mesh_id"), F.inline(F.array(*rows))).withColumn("face_id", F.col("mesh_id") * 12 + F.col("n"))


_CELLS = "(SELECT *, unnest(range(ceil(0.1e0 - 0.5e0)::BIGINT, least((SELECT max(z)::INT FROM vertices), ceil(h - 0.5e0)::BIGINT))) AS iz FROM (SELECT *, unnest(range(ceil(y_lo - 0.5e0)::BIGINT, ceil(y_hi - 0.5e0)::BIGINT)) AS iy FROM (SELECT *, unnest(range(ceil(x_lo - 0.5e0)::BIGINT, ceil(x_hi - 0.5e0)::BIGINT)) AS ix FROM b)))"
query("j12_points_in_mesh_union", lambda f: meshes.points_in_mesh(_box_triangles(f), _box_meta(f), 1.0), with_ctes("vertices", "SELECT DISTINCT ix::INT AS ix, iy::INT AS iy, iz::INT AS iz FROM cells_", {"b": _BOXES, "cells_": _CELLS}))


def _rects(f: Fixtures):
    """The box of each face on the unrolled wall: angle and height."""
    t = f.tri().select("face_id", *(F.atan2(f"y{i}", f"x{i}").alias(f"a{i}") for i in (0, 1, 2)), "z0", "z1", "z2")
    return f.kept("rects", lambda: t.select(F.col("face_id").alias("id"), *(fn(*(f"{d}{i}" for i in (0, 1, 2))).alias(f"{p}_{n}") for n, fn in (("lo", F.least), ("hi", F.greatest)) for p, d in (("x", "a"), ("y", "z")))))


_RECTS = "(SELECT face_id AS id, least(atan2(y0, x0), atan2(y1, x1), atan2(y2, x2)) AS x_lo, least(z0, z1, z2) AS y_lo, greatest(atan2(y0, x0), atan2(y1, x1), atan2(y2, x2)) AS x_hi, greatest(z0, z1, z2) AS y_hi FROM tri)"
query("j5_bbox_overlap", lambda f: nb.bbox_overlap(_rects(f), _rects(f)).where("a < b"), with_ctes("tri", "SELECT a.id AS a, b.id AS b FROM r a JOIN r b ON a.id < b.id AND a.x_lo <= b.x_hi AND b.x_lo <= a.x_hi AND a.y_lo <= b.y_hi AND b.y_lo <= a.y_hi", {"r": _RECTS}))
_KNN = "(SELECT *, row_number() OVER (PARTITION BY id ORDER BY d2, target) AS rank FROM (SELECT a.id, b.id AS target, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d2 FROM flat a, flat b) QUALIFY rank <= 5)"
query("j8_knn", lambda f: nb.nearest(f.flat, f.flat, 5, "xy").select("id", "target", r6("distance").alias("distance"), F.col("rank").cast("long").alias("rank")), with_ctes("flat", f"SELECT id, target, {sql6('sqrt(d2)')} AS distance, rank FROM knn", {"knn": _KNN}))
query("j7_nearest_label", lambda f: nb.nearest(f.flat, f.flat.where("id % 10 = 3"), 1, "xy").select("id", "target"), with_ctes("flat", "SELECT id, arg_min(target, struct_pack(a := d2, b := target)) AS target FROM (SELECT a.id, b.id AS target, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d2 FROM flat a, flat b WHERE b.id % 10 = 3) GROUP BY 1"))
query("a23_drop_outliers", lambda f: clouds.drop_outliers(f.flat, nb.nearest(f.flat, f.flat, 5, "xy"), 5, 2.0).select("id"), with_ctes("flat", "SELECT id FROM m WHERE d < (SELECT avg(d) + 2 * stddev_pop(d) FROM m)", {"knn": _KNN, "m": "(SELECT id, avg(sqrt(d2)) AS d FROM knn GROUP BY 1)"}))

# DBSCAN on voxel centres: neighbours within EPS, clusters by least reachable core.
_DB = {
    "near": f"(SELECT a.id AS a, b.id AS b FROM blob_points a JOIN blob_points b ON b.x BETWEEN a.x - {EPS} AND a.x + {EPS} AND b.y BETWEEN a.y - {EPS} AND a.y + {EPS} AND b.z BETWEEN a.z - {EPS} AND a.z + {EPS} WHERE a.id <> b.id AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) <= {EPS}e0 * {EPS}e0)",
    "core": f"(SELECT a AS id FROM near GROUP BY a HAVING count(*) + 1 >= {SAMPLES})",
    "link": "(SELECT a, b FROM near WHERE a IN (SELECT id FROM core) AND b IN (SELECT id FROM core))",
    "reach": "(SELECT id, id AS root FROM core UNION SELECT l.b, r.root FROM reach r JOIN link l ON l.a = r.id WHERE r.root <= l.b)",
    "root": "(SELECT id, min(root) AS root FROM reach GROUP BY 1)",
    "cored": "(SELECT id, (dense_rank() OVER (ORDER BY root) - 1)::INT AS label FROM root)",
    "labelled": "(SELECT p.id, coalesce(c.label, n.label, -1) AS label FROM blob_points p LEFT JOIN cored c ON c.id = p.id LEFT JOIN (SELECT a AS id, min(label) AS label FROM near JOIN cored ON cored.id = near.b GROUP BY 1) n ON n.id = p.id)",
}


_POINTS = f"(SELECT (ix::BIGINT * 100000 + iy) * 100000 + iz AS id, ix, iy, iz, ox + {VOX}e0 * (ix + 0.5e0) AS x, oy + {VOX}e0 * (iy + 0.5e0) AS y, oz + {VOX}e0 * (iz + 0.5e0) AS z FROM vox, meta)"
_STEPS = ", ".join(f"({a}, {b}, {c})" for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1) if 0 < a * a + b * b + c * c <= 2)
#: The same on voxels: neighbours by index, and labels by updates in place, as there are many voxels.
_VDB = {
    "blob_points": _POINTS,
    **_DB,
    "near": f"(SELECT a.id AS a, b.id AS b FROM (SELECT id, ix + dx AS ix, iy + dy AS iy, iz + dz AS iz FROM blob_points, (VALUES {_STEPS}) s(dx, dy, dz)) a JOIN blob_points b USING (ix, iy, iz))",
    "core": f"(SELECT a AS id FROM near GROUP BY a HAVING count(*) + 1 >= {SAMPLES})",
    "reach": "(SELECT id, id AS root FROM core UNION SELECT l.b, min(r.root) FROM reach r JOIN link l ON l.a = r.id JOIN recurring.reach o ON o.id = l.b WHERE r.root < o.root GROUP BY 1)",
}


def blocks_of(f: Fixtures):
    return f.kept("blocks", lambda: cl.dbscan_points(voxel_points(f), EPS, SAMPLES))


def _stats(f: Fixtures):
    return nb.cluster_stats(blocks_of(f).join(voxel_points(f), "id"), _meta(f), VOX)


_CENTRES = ", ".join(f"o{d} + {VOX}e0 * (sum(i{d})::DOUBLE / count(*) + 0.5e0) AS c{d}" for d in "xyz")
_STATS = {**_VDB, "stats": f"(SELECT label, count(*) AS n, count(*) * {VOX**3!r}::DOUBLE AS volume, {_CENTRES} FROM labelled JOIN blob_points USING (id), meta GROUP BY label, ox, oy, oz)"}


def db(body: str, more: dict | None = None) -> str:
    return voxel_sql(body, more={"all_points": _POINTS, **_STATS, **(more or {})}).replace(" reach AS (", " reach(id, root) USING KEY (id) AS (")


def sql_exact6(c: str) -> str:
    return f"floor({c} * 1e6 + 0.5e0) / 1e6"


query("o11_dbscan_points", blocks_of, db("SELECT id, label FROM labelled"))
query("o12_dbscan_from_pairs", lambda f: nb.dbscan_from_pairs(voxel_points(f).select("id"), nb.pairs_within(voxel_points(f), EPS), SAMPLES), db("SELECT id, label FROM labelled"))
query("a16_cluster_stats", lambda f: _stats(f).select("label", "n", *(exact6(c).alias(c) for c in ("volume", "cx", "cy", "cz"))), db(f"SELECT label, n, {', '.join(f'{sql_exact6(c)} AS {c}' for c in ('volume', 'cx', 'cy', 'cz'))} FROM stats"))
_REPORT = ("total_volume", "valid_volume", "noise_volume", "range_volume", "noise_percent", "range_percent")
query("a17_volume_report", lambda f: nb.volume_report(_stats(f), 0.4, 4.0).select("n_clusters", "n_in_range", *(r6(c).alias(c) for c in _REPORT)), db(f"SELECT n_clusters, n_in_range, {', '.join(f'{sql6(c)} AS {c}' for c in _REPORT)} FROM (SELECT *, CASE WHEN total_volume > 0 THEN 100 * noise_volume / total_volume ELSE 0 END AS noise_percent, CASE WHEN valid_volume > 0 THEN 100 * range_volume / valid_volume ELSE 0 END AS range_percent FROM (SELECT sum(volume) AS total_volume, coalesce(sum(volume) FILTER (label >= 0), 0) AS valid_volume, coalesce(sum(volume) FILTER (label < 0), 0) AS noise_volume, count(*) FILTER (label >= 0) AS n_clusters, count(*) FILTER (label >= 0 AND volume BETWEEN 0.4 AND 4) AS n_in_range, coalesce(sum(volume) FILTER (label >= 0 AND volume BETWEEN 0.4 AND 4), 0) AS range_volume FROM stats))"))
query("t1_top_blocks", lambda f: nb.top_blocks(_stats(f), 10).select("label", "n", r6("volume").alias("volume")), db(f"SELECT label, n, {sql6('volume')} AS volume FROM stats WHERE label >= 0 ORDER BY stats.n DESC, label LIMIT 10"))
query("t2_block", lambda f: nb.block(blocks_of(f), _stats(f), 2).select("id"), db("SELECT id FROM labelled WHERE label = (SELECT label FROM stats WHERE label >= 0 ORDER BY n DESC, label LIMIT 1 OFFSET 1)"))
_SAMPLE = "pmod(id * 7919 + 13, 1000003) % 10 < 8"


def _sampled(f: Fixtures):
    return cl.cluster_sampled(voxel_points(f), voxel_points(f).where(_SAMPLE), EPS, SAMPLES)


#: Each voxel's nearest sampled one, the voxel itself where it is sampled; of 80 of 100 one is within four steps.
_NEAREST = "(SELECT id, label FROM labelled UNION ALL SELECT id, arg_min(label, struct_pack(a := d, b := b)) FROM (SELECT p.id, q.id AS b, l.label, (p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) + (p.z - q.z) * (p.z - q.z) AS d FROM (SELECT *, ix + dx AS jx, iy + dy AS jy, iz + dz AS jz FROM all_points ANTI JOIN blob_points USING (id), (SELECT a.i, b.i, c.i FROM range(-4, 5) a(i), range(-4, 5) b(i), range(-4, 5) c(i)) s(dx, dy, dz)) p JOIN blob_points q ON q.ix = jx AND q.iy = jy AND q.iz = jz JOIN labelled l ON l.id = q.id) GROUP BY 1)"
query("o13_cluster_sampled", _sampled, db("SELECT id, label FROM nearest", {"blob_points": "(SELECT * FROM all_points WHERE (id * 7919 + 13) % 1000003 % 10 < 8)", "nearest": _NEAREST}))


_TENTH = "pmod(id * 7919 + 13, 1000003) % 10 = 0"


def hazard_blocks(f: Fixtures, k: int = 10):
    """From recognised overhangs to blocks: all planes, groups, face heights, voxels, clusters of a tenth of the voxels, and the k largest blocks."""
    p = voxel_points(f)
    return cl.hazard_blocks(p, p.where(_TENTH), _meta(f), WIDE, DENSE, VOX, k).select("label", "n", *(exact6(c).alias(c) for c in ("volume", "cx", "cy", "cz")))


_WIDE = {n: q.replace("blob_points", "sampled").replace(f"{EPS}", f"{WIDE}").replace(f">= {SAMPLES})", f">= {DENSE})") for n, q in _DB.items()}
_BLOCKS = {
    "blob_points": _POINTS,
    "sampled": "(SELECT * FROM blob_points WHERE (id * 7919 + 13) % 1000003 % 10 = 0)",
    **_WIDE,
    "spread": "(SELECT p.id, p.ix, p.iy, p.iz, (SELECT arg_min(l.label, struct_pack(a := (p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) + (p.z - q.z) * (p.z - q.z), b := q.id)) FROM sampled q JOIN labelled l ON l.id = q.id) AS label FROM blob_points p)",
    "stats": f"(SELECT label, count(*) AS n, count(*) * {VOX**3!r}::DOUBLE AS volume, {_CENTRES} FROM spread, meta GROUP BY label, ox, oy, oz)",
}
query("o22_hazard_blocks", hazard_blocks, voxel_sql(f"SELECT label, n, {', '.join(f'{sql_exact6(c)} AS {c}' for c in ('volume', 'cx', 'cy', 'cz'))} FROM stats WHERE label >= 0 ORDER BY stats.n DESC, label LIMIT 10", more=_BLOCKS))

#: Hops between recognised faces, over the whole mesh, and neighbours that make a core.
HOPS, CORE = 4, 8


def _targets(f: Fixtures):
    return f.kept("recognised", lambda: heights(f).where("face_id is not null").select("face_id").distinct())


def _hops(f: Fixtures):
    return nb.hops(meshes.face_edges(f.faces(gaps=True)), _targets(f), HOPS)


_HOPS = {
    **GROW,
    **FACED,
    "target": "(SELECT DISTINCT face_id FROM faced WHERE face_id IS NOT NULL)",
    "e": "(SELECT least(a, b) AS lo, greatest(a, b) AS hi, face_id FROM (SELECT face_id, v0 AS a, v1 AS b FROM faces_g UNION ALL SELECT face_id, v1, v2 FROM faces_g UNION ALL SELECT face_id, v2, v0 FROM faces_g))",
    "step": "(SELECT DISTINCT p.face_id AS a, q.face_id AS b FROM e p JOIN e q ON p.lo = q.lo AND p.hi = q.hi AND p.face_id <> q.face_id)",
    "way": f"(SELECT face_id AS a, face_id AS b, 0 AS d FROM target UNION SELECT w.a, s.b, w.d + 1 FROM way w JOIN step s ON s.a = w.b WHERE w.d < {HOPS})",
    "hop": "(SELECT a, b, min(d)::INT AS d FROM way WHERE b IN (SELECT face_id FROM target) GROUP BY 1, 2 HAVING min(d) > 0)",
}
_HDB = {**_HOPS, "blob_points": "(SELECT face_id AS id FROM target)", **_DB, "near": "(SELECT a, b FROM hop)", "core": f"(SELECT a AS id FROM near GROUP BY a HAVING count(*) + 1 >= {CORE})", "reach": _VDB["reach"]}
query("o9_hops", _hops, with_ctes("keyed_g faces_g", "SELECT a, b, d FROM hop", _HOPS, recursive=True))
query("o10_dbscan_hops", lambda f: nb.dbscan_from_pairs(_targets(f).select(F.col("face_id").alias("id")), _hops(f).select("a", "b"), CORE), with_ctes("keyed_g faces_g", "SELECT id, label FROM labelled", _HDB, recursive=True).replace(" reach AS (", " reach(id, root) USING KEY (id) AS ("))

_KDE = "(SELECT t.id, sum(exp(-((t.x - s.x) * (t.x - s.x) + (t.y - s.y) * (t.y - s.y) + (t.z - s.z) * (t.z - s.z)) / (2 * {h}e0 * {h}e0))) / (count(*) * pow(2 * pi(), 1.5) * pow({h}e0, 3)) AS density FROM {t} t, {s} s GROUP BY 1)"
_KEY, _DRAWN = "pmod(k * 7919 + face_id * 31, 1000003)", 20_000


def _kde(f: Fixtures):
    """Density of the profiles, from a sample of their segments as the surveyed tool draws one, at all vertices."""
    drawn = clouds.sample_points(f.segments().select((F.col("k") * 10_000_000 + F.col("face_id")).alias("point_id"), "k", "face_id", "x1", "y1", "z1"), n=_DRAWN, key=F.expr(_KEY))
    return nb.kde(drawn.select("x1", "y1", "z1").toDF("x", "y", "z"), f.vertices.withColumnRenamed("vertex_id", "id"), 5.0).select("id", F.round(F.col("density") * 1e6, 4).alias("density"))


query("a24_kde", _kde, with_ctes("segments vertices", "SELECT id, round(density * 1e6, 4) AS density FROM kd", {"s": f"(SELECT x1 AS x, y1 AS y, z1 AS z FROM segments ORDER BY (k * 7919 + face_id * 31) % 1000003, k * 10000000 + face_id LIMIT {_DRAWN})", "t": "(SELECT vertex_id AS id, x, y, z FROM vertices)", "kd": _KDE.format(h=5.0, t="t", s="s")}))
def _kde_of_all(f: Fixtures):
    """Density of all segments of all planes, none drawn, at all vertices."""
    return nb.certified_kde(f.segments().select("x1", "y1", "z1").toDF("x", "y", "z"), f.vertices.withColumnRenamed("vertex_id", "id"), 5.0).select("id", F.round(F.col("density") * 1e6, 4).alias("density"), F.round(F.col("error") * 1e6, 4).alias("error"))


query("a24_kde_certified", _kde_of_all, None)
_BANDWIDTH = 2.0
query("o23_density_by_size", lambda f: nb.density_by_size(_stats(f), voxel_points(f).select("id", "x", "y", "z"), 0.4, 4.0, _BANDWIDTH).select("id", F.round(F.col("density") * 1e6, 2).alias("density")), db("SELECT id, round(coalesce(density, 0) * 1e6, 2) AS density FROM blob_points LEFT JOIN kd USING (id)", {"c": "(SELECT * FROM stats WHERE label >= 0 AND volume BETWEEN 0.4 AND 4)", "s": "(SELECT " + ", ".join(f"round_even((c{d} - m{d}) / 0.001e0, 0) * 0.001e0 + m{d} AS {d}" for d in "xyz") + " FROM c, (SELECT min(cx) AS mx, min(cy) AS my, min(cz) AS mz FROM c))", "kd": _KDE.format(h=_BANDWIDTH, t="blob_points", s="s")}))
query("o19_sample_segments", lambda f: meshes.sample_segments(f.segments(), 0.05).groupBy("k", "face_id").agg(F.count("*").alias("n"), r6(F.sum("x")).alias("x"), r6(F.sum("z")).alias("z")), with_ctes("segments", f"SELECT k, face_id, n, {sql6('n * (x1 + x2) / 2')} AS x, {sql6('n * (z1 + z2) / 2')} AS z FROM (SELECT *, greatest(2, floor(sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1) + (z2 - z1) * (z2 - z1)) / 0.05e0 + 1e-9))::BIGINT AS n FROM segments)"))


def _points_text(f: Fixtures):
    path = scratch(f, "points")
    text.write_points_txt(f.points, path)
    return text.read_points_txt(f.spark, path, "xyz").groupBy("x", "y", "z").agg(F.count("*").alias("n"))


def _arc_json(f: Fixtures):
    path = scratch(f, "arc")
    store.write_arc(f.arc, path)
    return store.read_arc(f.spark, path).withColumn("arc_length", r6("arc_length"))


def _as_rows(v, t):
    """Vertices and faces of a mesh in one table."""
    row = lambda kind, i, *three: (F.lit(kind).alias("kind"), F.col(i).alias("i"), *(F.col(c).cast("double").alias(n) for c, n in zip(three, "abc", strict=True)))
    return v.select(*row("v", "vertex_id", *"xyz")).unionByName(t.select(*row("f", "face_id", "v0", "v1", "v2")))


def _obj(f: Fixtures):
    """A sub-mesh written as one OBJ in parts and read back."""
    path = scratch(f, "mesh")
    faces, used = meshes.submesh(f.faces(), f.faces().where("face_id % 11 < 3").select("face_id"))
    text.write_obj(f.vertices.join(used, "vertex_id"), faces, path)
    return _as_rows(*text.read_obj_tiles(f.spark, path, tiles=False))


def _obj_tiles(f: Fixtures):
    """The whole mesh as OBJ tiles of 997 faces each by number, read back as one mesh."""
    path = scratch(f, "tiles")
    text.write_obj_tiles(f.vertices, f.faces().withColumn("tile", F.format_string("%06d", F.expr("face_id div 997"))), path)
    return _as_rows(*text.read_obj_tiles(f.spark, path))


_ROWS = "SELECT 'v' AS kind, i, x AS a, y AS b, z AS c FROM nv JOIN vertices ON vertex_id = v UNION ALL SELECT 'f', i, v0::DOUBLE, v1::DOUBLE, v2::DOUBLE FROM nf"
_CHOSEN = {"chosen": "(SELECT * FROM faces WHERE face_id % 11 < 3)", "nv": "(SELECT v, row_number() OVER (ORDER BY v) - 1 AS i FROM (SELECT DISTINCT unnest([v0, v1, v2]) AS v FROM chosen))", "nf": "(SELECT row_number() OVER (ORDER BY face_id) - 1 AS i, a.i AS v0, b.i AS v1, d.i AS v2 FROM chosen c JOIN nv a ON a.v = c.v0 JOIN nv b ON b.v = c.v1 JOIN nv d ON d.v = c.v2)"}
_TILED = {"tiled": "(SELECT *, face_id // 997 AS tile FROM faces)", "nv": "(SELECT tile, v, row_number() OVER (ORDER BY tile, v) - 1 AS i FROM (SELECT DISTINCT tile, unnest([v0, v1, v2]) AS v FROM tiled))", "nf": "(SELECT row_number() OVER (ORDER BY c.tile, face_id) - 1 AS i, a.i AS v0, b.i AS v1, d.i AS v2 FROM tiled c JOIN nv a ON a.v = c.v0 AND a.tile = c.tile JOIN nv b ON b.v = c.v1 AND b.tile = c.tile JOIN nv d ON d.v = c.v2 AND d.tile = c.tile)"}


def _scene(f: Fixtures) -> str:
    """A folder of all points as tiles of a scene: a tile for each 2,048 order numbers, with a parent node and a child."""
    path = scratch(f, "scene")
    p = f.points.select(F.expr("point_id div 204800000000000").cast("int").alias("tile"), F.when(F.col("z") < 5, "low").otherwise("high").alias("node"), F.when(F.col("z") >= 5, "low").alias("parent"), "point_id", "x", "y", "z")
    tiles.write_3mx_tiles(p, path)
    return path


_TILE = "(SELECT point_id // 204800000000000 AS tile, CASE WHEN z < 5 THEN 'low' ELSE 'high' END AS node, x, y, z, point_id FROM points)"
_number = lambda c: F.regexp_extract(c, r"tile-(\d+)\.3mxb$", 1).cast("int").alias("tile")
query("s2_obj_tiles", _obj_tiles, with_ctes("faces vertices", _ROWS, _TILED))
query("s3_3mx_tiles", lambda f: tiles.read_3mx_tiles(f.spark, _scene(f)).select(_number("path"), F.octet_length("buffer").alias("n_bytes"), F.get_json_object("header", "$.nodes[0].id").alias("first")), with_ctes("points", "SELECT tile::INT AS tile, (12 * count(*))::INT AS n_bytes, min(node) AS first FROM t GROUP BY 1", {"t": _TILE}))
query("s4_tile_nodes", lambda f: tiles.tile_nodes(tiles.read_3mx_headers(f.spark, _scene(f))).select(_number("path"), "id", "resource_start", "resource_end", "parent", "kind"), with_ctes("points", "SELECT tile::INT AS tile, node AS id, CASE WHEN node = 'high' THEN 0 ELSE 12 * (total - n) END::BIGINT AS resource_start, CASE WHEN node = 'high' THEN 12 * n ELSE 12 * total END::BIGINT AS resource_end, CASE WHEN node = 'high' THEN 'low' END AS parent, CASE WHEN node = 'high' THEN 'child' ELSE 'parent' END AS kind FROM (SELECT tile, node, count(*) AS n, sum(count(*)) OVER (PARTITION BY tile) AS total FROM t GROUP BY 1, 2)", {"t": _TILE}))
query("s5_tile_points", lambda f, piece=12 << 18: tiles.ranged_tile_points(tiles.read_3mx_headers(f.spark, _scene(f)).withColumn("tile", _number("path")), piece).select("tile", "node", F.col("i").cast("int").alias("i"), *(F.round(F.col(d).cast("double"), 4).alias(d) for d in "xyz")), with_ctes("points", "SELECT tile::INT AS tile, node, (row_number() OVER (PARTITION BY tile, node ORDER BY point_id, x, y, z) - 1)::INT AS i, " + ", ".join(f"round({d}::FLOAT::DOUBLE, 4) AS {d}" for d in "xyz") + " FROM t", {"t": _TILE}))
query("s5_tile_buffers", lambda f: tiles.tile_points(tiles.read_3mx_tiles(f.spark, _scene(f))).select(_number("path"), "node", "i", *(F.round(F.col(d).cast("double"), 4).alias(d) for d in "xyz")), with_ctes("points", "SELECT tile::INT AS tile, node, (row_number() OVER (PARTITION BY tile, node ORDER BY point_id, x, y, z) - 1)::INT AS i, " + ", ".join(f"round({d}::FLOAT::DOUBLE, 4) AS {d}" for d in "xyz") + " FROM t", {"t": _TILE}))


def _streamed_groups(f: Fixtures):
    """Slices that arrive in two batches of files, recognised as they come, and read from the results."""
    slices, out, marks = (scratch(f, n) for n in ("slices", "groups", "marks"))
    for part in (0, 1):
        f.segments(gaps=True).where(F.col("k") % 2 == part).repartition(4, "k").write.mode("append").parquet(slices)
        recognise_stream(f.spark, slices, f.segments(gaps=True).schema, out, marks).awaitTermination()
    return store.read_results(f.spark, out).select("k", "path_id", "group_id", r6("cu").alias("cu"), r6("cv").alias("cv"), "n_nodes", r6("width").alias("width"), "n_segments")


def _streamed_pieces(f: Fixtures):
    """Slices whose segments come in two batches, most of them split between both, recognised when they are whole."""
    arrived, out, marks = (scratch(f, n) for n in ("pieces", "versions", "marks"))
    n = f.segments(gaps=True).groupBy("k").agg(F.count("*").alias("n_slice"))
    pieces = nb.checkpointed(f.segments(gaps=True).join(n, "k"))
    for part in (0, 1):
        pieces.where(F.col("face_id") % 2 == part).write.mode("append").parquet(arrived)
        recognise_pieces_stream(f.spark.readStream.schema(pieces.schema).parquet(arrived), out, marks).awaitTermination()
    return read_recognised(f.spark, out).select("k", "path_id", "group_id", r6("cu").alias("cu"), r6("cv").alias("cv"), "n_nodes", r6("width").alias("width"), "n_segments")


def _streamed_heights(f: Fixtures):
    """Heights that arrive as files; each batch writes the faces it changed, and the newest row of a face counts."""
    arrived, out, marks = (scratch(f, n) for n in ("heights", "running", "marks"))
    rows = nb.checkpointed(heights(f).select("k", "face_id", "height"))
    for part in (0, 1):
        rows.where(F.col("k") % 2 == part).select("face_id", "height").write.mode("append").parquet(arrived)
        write_heights_stream(f.spark.readStream.schema("face_id long, height double").parquet(arrived), out, marks).awaitTermination()
    return store.read_latest(f.spark, out, "face_id").select("face_id", r6("height").alias("height"), "n")


query("x1_recognise_stream", _streamed_groups, ORACLES["o7_recognise"])
query("x1_recognise_pieces", _streamed_pieces, ORACLES["o7_recognise"])
query("x2_face_heights_stream", _streamed_heights, ORACLES["a13_face_heights_max"])
query("s1_points_text", _points_text, with_ctes("points", "SELECT x, y, z, count(*) AS n FROM points GROUP BY 1, 2, 3"))
query("s6_arc_json", _arc_json, with_ctes("arc", f"SELECT *, {sql6('radius * (angle_max - angle_min)')} AS arc_length FROM arc"))
query("s9_obj_round_trip", _obj, with_ctes("faces vertices", _ROWS, _CHOSEN))
