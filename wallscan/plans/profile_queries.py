"""Queries on profiles: nodes, paths, overhangs, groups and heights, each with its oracle."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from wallscan.functions.geometry import r6
from wallscan.operators import chains, meshes, profiles as pr
from wallscan.operators.neighbours import checkpointed, shared_folder
from wallscan.plans.fixtures import Fixtures, r6 as sql6, with_ctes
from wallscan.plans.registry import ORACLES, query
from wallscan.sources import store


def paths(f: Fixtures):
    return pr.components(f.segments(gaps=True))


def nodes(f: Fixtures):
    """The ordered nodes of all paths, kept for the query that uses them several times."""
    return f.kept("nodes", lambda: pr.ordered(f.segments(gaps=True)))


def red(f: Fixtures):
    return f.kept("red", lambda: pr.overhangs(pr.path_edges(nodes(f)).drop("a", "b")))


# Components, ordered nodes, overhangs and groups of the broken wall, as SQL. A profile there is a chain that falls all the way, so its
# pieces are runs of segments, by height, each of which begins where the one before ends.
WALK = {
    "raised": "(SELECT *, CASE WHEN v1 < v2 THEN struct_pack(a := aax, b := aay, c := aaz) ELSE struct_pack(a := bbx, b := bby, c := bbz) END AS low, CASE WHEN v1 < v2 THEN struct_pack(a := bbx, b := bby, c := bbz) ELSE struct_pack(a := aax, b := aay, c := aaz) END AS top, least(v1, v2) AS v_low FROM keyed_g)",
    "piece": "(SELECT *, sum(CASE WHEN before IS NOT DISTINCT FROM low THEN 0 ELSE 1 END) OVER (PARTITION BY k ORDER BY v_low) AS piece FROM (SELECT *, lag(top) OVER (PARTITION BY k ORDER BY v_low) AS before FROM raised))",
    "ends": "(SELECT k, piece, aax AS kx, aay AS ky, aaz AS kz, x1 AS x, y1 AS y, z1 AS z, u1 AS u, v1 AS v FROM piece UNION ALL SELECT k, piece, bbx, bby, bbz, x2, y2, z2, u2, v2 FROM piece)",
    "placed": "(SELECT k, piece, (row_number() OVER (PARTITION BY k ORDER BY min(struct_pack(a := kx, b := ky, c := kz))) - 1)::INT AS path_id FROM ends GROUP BY k, piece)",
    "node": "(SELECT e.k, p.path_id, e.kx, e.ky, e.kz, min(x) AS x, min(y) AS y, min(z) AS z, min(u) AS u, min(v) AS v, count(*) AS degree FROM ends e JOIN placed p ON p.k = e.k AND p.piece = e.piece GROUP BY 1, 2, 3, 4, 5)",
    "first_": "(SELECT k, path_id, min(struct_pack(v := -v, a := kx, b := ky, c := kz)) AS s, min(struct_pack(v := v, a := kx, b := ky, c := kz)) AS e FROM node GROUP BY 1, 2)",
    "ordered": "(SELECT k, path_id, (row_number() OVER (PARTITION BY k, path_id ORDER BY v DESC) - 1)::INT AS ord, * EXCLUDE (k, path_id) FROM node)",
    "pair": "(SELECT * FROM (SELECT k, path_id, ord, kx AS aax, ky AS aay, kz AS aaz, x AS x1, y AS y1, z AS z1, u AS u1, v AS v1, lead(kx) OVER w AS bbx, lead(ky) OVER w AS bby, lead(kz) OVER w AS bbz, lead(x) OVER w AS x2, lead(y) OVER w AS y2, lead(z) OVER w AS z2, lead(u) OVER w AS u2, lead(v) OVER w AS v2 FROM ordered WINDOW w AS (PARTITION BY k, path_id ORDER BY ord)) WHERE bbx IS NOT NULL)",
    "framed": "(SELECT *, -(v2 - v1) / len AS nu, (u2 - u1) / len AS nv, (u1 + u2) / 2 AS mu, (v1 + v2) / 2 AS mv FROM (SELECT *, sqrt((u2 - u1) * (u2 - u1) + (v2 - v1) * (v2 - v1)) AS len FROM pair) WHERE len > 0)",
    "red": "(SELECT *, degrees(acos(least(1e0, abs(v2 - v1) / len))) > 40 AS seed, row_number() OVER (PARTITION BY k, path_id ORDER BY ord DESC) AS rn FROM framed WHERE nv < -0.1e0)",
    "face_of": "(SELECT k, least(struct_pack(a := aax, b := aay, c := aaz), struct_pack(a := bbx, b := bby, c := bbz)) AS lo, greatest(struct_pack(a := aax, b := aay, c := aaz), struct_pack(a := bbx, b := bby, c := bbz)) AS hi, min(face_id) AS face_id FROM keyed_g GROUP BY 1, 2, 3)",
}
GROW = {
    **WALK,
    "grow": "(SELECT k, path_id, rn, ord, CASE WHEN seed THEN 0 ELSE -1 END AS g, seed AS member, CASE WHEN seed THEN u2 END AS su, CASE WHEN seed THEN v2 END AS sv, u1 AS lu, v1 AS lv FROM red WHERE rn = 1 UNION ALL SELECT k, path_id, rn, ord, CASE WHEN grows OR NOT seed THEN g ELSE g + 1 END, grows OR seed, CASE WHEN grows THEN su WHEN seed THEN u2 END, CASE WHEN grows THEN sv WHEN seed THEN v2 END, u1, v1 FROM (SELECT r.*, g.g, g.su, g.sv, g.member AND g.su IS NOT NULL AND r.u2 - g.lu > -0.3e0 AND abs(g.lv - r.v2) < 1 AND degrees(atan2(abs(r.v1 - g.sv), abs(r.u1 - g.su))) <= 70 AS grows FROM grow g JOIN red r ON r.k = g.k AND r.path_id = g.path_id AND r.rn = g.rn + 1))",
    "grouped": "(SELECT r.*, g.g::INT AS group_id FROM red r JOIN grow g ON g.k = r.k AND g.path_id = r.path_id AND g.rn = r.rn WHERE g.member)",
    "span": "(SELECT o.*, s.group_id, CASE WHEN o.ord IN (s.lo, s.hi) THEN 1 ELSE 2 END::INT AS flag FROM (SELECT k, path_id, group_id, min(ord) AS lo, max(ord) + 1 AS hi FROM grouped GROUP BY 1, 2, 3) s JOIN ordered o ON o.k = s.k AND o.path_id = s.path_id AND o.ord BETWEEN s.lo AND s.hi)",
}


def walk(body: str) -> str:
    return with_ctes("keyed_g", body, WALK)


def grow(body: str) -> str:
    return with_ctes("keyed_g", body, GROW, recursive=True)


def grouped(f: Fixtures):
    return f.kept("grouped", lambda: pr.grow_groups(red(f)))


def span(f: Fixtures):
    return pr.group_span(grouped(f), nodes(f))


def heights(f: Fixtures):
    return pr.segment_heights(grouped(f))


_SAME = "s.k = {0}.k AND s.lo = least(struct_pack(a := {0}.aax, b := {0}.aay, c := {0}.aaz), struct_pack(a := {0}.bbx, b := {0}.bby, c := {0}.bbz)) AND s.hi = greatest(struct_pack(a := {0}.aax, b := {0}.aay, c := {0}.aaz), struct_pack(a := {0}.bbx, b := {0}.bby, c := {0}.bbz))"
query("a25_slice_stats", lambda f: pr.slice_stats(f.segments(), f.planes()).select("k", "slice_key", "azimuth", "n_segments", r6("length").alias("length")), with_ctes("segments planes", f"SELECT s.k, p.slice_key, p.azimuth, count(*) AS n_segments, {sql6('sum(sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1) + (z2 - z1) * (z2 - z1)))')} AS length FROM segments s JOIN planes p USING (k) GROUP BY ALL"))
_DEG = "(SELECT k, x, y, z, count(*) AS degree FROM (SELECT k, aax AS x, aay AS y, aaz AS z FROM keyed UNION ALL SELECT k, bbx, bby, bbz FROM keyed) GROUP BY ALL)"
query("a5_node_degree", lambda f: pr.node_degree(f.segments()).select("k", "node.kx", "node.ky", "node.kz", "degree"), with_ctes("keyed", "SELECT k, x AS kx, y AS ky, z AS kz, degree FROM deg", {"deg": _DEG}))
query("a6_degree_histogram", lambda f: pr.degree_histogram(f.segments()), with_ctes("keyed", "SELECT k, degree, count(*) AS nodes FROM deg GROUP BY ALL", {"deg": _DEG}))
query("a7_unique_nodes", lambda f: pr.unique_nodes(f.segments()), with_ctes("keyed", "SELECT k, x AS kx, y AS ky, z AS kz FROM deg", {"deg": _DEG}))
query("o1_components", lambda f: paths(f).select("k", "face_id", "path_id"), walk("SELECT s.k, s.face_id, p.path_id FROM piece s JOIN placed p ON p.k = s.k AND p.piece = s.piece"))
query("a8_path_kinds", lambda f: pr.path_kinds(paths(f)), walk("SELECT k, path_id, (sum(degree) // 2)::BIGINT AS n_segments, count(*) AS n_nodes, count(*) FILTER (degree = 1) AS loose, count(*) FILTER (degree = 1) = 0 AS closed, max(degree) <= 2 AND count(*) FILTER (degree = 1) IN (0, 2) AS simple FROM node GROUP BY 1, 2"))
query("o2_section_paths", lambda f: pr.section_paths(paths(f)).select("k", "path_id", "ord", "kx", "ky", "kz"), walk("SELECT k, path_id, (row_number() OVER (PARTITION BY k, path_id ORDER BY CASE WHEN low_first THEN v ELSE -v END) - 1)::INT AS ord, kx, ky, kz FROM (SELECT n.*, struct_pack(a := f.e.a, b := f.e.b, c := f.e.c) < struct_pack(a := f.s.a, b := f.s.b, c := f.s.c) AS low_first FROM node n JOIN first_ f ON f.k = n.k AND f.path_id = n.path_id)"))
query("o3_order_path", lambda f: pr.order_path(paths(f)).select("k", "path_id", "ord", "kx", "ky", "kz"), walk("SELECT k, path_id, ord, kx, ky, kz FROM ordered"))
query("o1_long_components", lambda f: chains.long_components(f.segments(gaps=True)).select("k", "face_id", "path_id"), ORACLES["o1_components"])
query("o3_long_order", lambda f: chains.long_order(paths(f)).select("k", "path_id", "ord", "kx", "ky", "kz"), ORACLES["o3_order_path"])
query("o4_order_whole_slice", lambda f: pr.order_whole_slice(f.segments(gaps=True)).select("k", "ord", "kx", "ky", "kz"), walk("SELECT k, ord, kx, ky, kz FROM ordered WHERE k IN (SELECT k FROM node GROUP BY k HAVING max(path_id) = 0)"))
query("w1_path_edges", lambda f: pr.path_edges(nodes(f)).select("k", "path_id", "ord", *(r6(c).alias(c) for c in ("u1", "v1", "u2", "v2"))), walk(f"SELECT k, path_id, ord, {', '.join(f'{sql6(c)} AS {c}' for c in ('u1', 'v1', 'u2', 'v2'))} FROM pair"))
query("p14_segment_frame", lambda f: pr.segment_frame(pr.path_edges(nodes(f))).select("k", "path_id", "ord", *(r6(c).alias(c) for c in ("len", "nu", "nv", "mu", "mv"))), walk(f"SELECT k, path_id, ord, {', '.join(f'{sql6(c)} AS {c}' for c in ('len', 'nu', 'nv', 'mu', 'mv'))} FROM framed"))
query("o5_path_normals", lambda f: pr.path_normals(pr.path_edges(nodes(f)), pr.path_kinds(paths(f))).select("k", "path_id", "ord", *(r6(c).alias(c) for c in ("mu", "mv", "nu", "nv"))), walk(f"SELECT k, path_id, ord, {', '.join(f'{sql6(c)} AS {c}' for c in ('mu', 'mv', 'nu', 'nv'))} FROM framed"))
query("p15_overhang_filter", lambda f: pr.overhangs(pr.path_edges(nodes(f))).select("k", "path_id", "ord"), walk("SELECT k, path_id, ord FROM red"))
query("p16_facing_down", lambda f: pr.facing_down(pr.path_edges(nodes(f)), 80.0).select("k", "path_id", "ord"), walk("SELECT k, path_id, ord FROM framed WHERE degrees(acos(greatest(-1e0, least(1e0, -nv / sqrt(nu * nu + nv * nv))))) < 80"))
query("p17_seed_flag", lambda f: pr.seed_flags(red(f)).select("k", "path_id", "ord", "seed"), walk("SELECT k, path_id, ord, seed FROM red"))
query("p18_segment_valid", lambda f: meshes.valid_pairs(f.faces()), with_ctes("faces", "SELECT DISTINCT p.face_id AS a, q.face_id AS b FROM e p JOIN e q ON p.lo = q.lo AND p.hi = q.hi AND p.face_id <= q.face_id", {"e": "(SELECT least(a, b) AS lo, greatest(a, b) AS hi, face_id FROM (SELECT face_id, v0 AS a, v1 AS b FROM faces UNION ALL SELECT face_id, v1, v2 FROM faces UNION ALL SELECT face_id, v2, v0 FROM faces))"}))
query("j3_segment_face_match", lambda f: pr.match_faces(pr.path_edges(nodes(f).drop("face_id")), f.segments(gaps=True)).select("k", "path_id", "ord", "face_id"), walk(f"SELECT p.k, path_id, ord, face_id FROM pair p LEFT JOIN face_of s ON {_SAME.format('p')}"))
query("w2_gap_groups", lambda f: pr.gap_groups(red(f), 0.1).select("k", "path_id", "ord", "group_id"), walk("SELECT k, path_id, ord, (sum(n) OVER (PARTITION BY k, path_id ORDER BY ord DESC))::INT AS group_id FROM (SELECT *, CASE WHEN lag(greatest(u1, u2)) OVER (PARTITION BY k, path_id ORDER BY ord DESC) - least(u1, u2) >= 0.1e0 THEN 1 ELSE 0 END AS n FROM red)"))
query("w3_grow_groups", lambda f: pr.grow_groups(red(f)).select("k", "path_id", "ord", "group_id"), grow("SELECT k, path_id, ord, group_id FROM grouped"))
query("a9_group_span", lambda f: span(f).select("k", "path_id", "group_id", "ord", "flag"), grow("SELECT k, path_id, group_id, ord, flag FROM span"))
query("w4_connectivity_flags", lambda f: span(f).select("k", "path_id", "group_id", "ord", r6("u").alias("u"), r6("v").alias("v"), "flag"), grow(f"SELECT k, path_id, group_id, ord, {sql6('u')} AS u, {sql6('v')} AS v, flag FROM span"))
query("j4_group_to_path", lambda f: span(f).groupBy("k", "path_id", "group_id").agg(F.min("ord").alias("first"), F.max("ord").alias("last")), grow("SELECT k, path_id, group_id, min(ord) AS first, max(ord) + 1 AS last FROM grouped GROUP BY 1, 2, 3"))
query("a10_group_centroids", lambda f: pr.group_centroids(span(f)).select("k", "path_id", "group_id", r6("cu").alias("cu"), r6("cv").alias("cv"), "n_nodes"), grow(f"SELECT k, path_id, group_id, {sql6('avg(u)')} AS cu, {sql6('avg(v)')} AS cv, count(*) AS n_nodes FROM span GROUP BY 1, 2, 3"))
query("a11_wide_groups", lambda f: pr.wide_groups(span(f), 0.35).select("k", "path_id", "group_id", "n_nodes", r6("width").alias("width")), grow(f"SELECT * REPLACE ({sql6('width')} AS width) FROM (SELECT k, path_id, group_id, count(*) AS n_nodes, abs(arg_max(u, ord) - arg_min(u, ord)) AS width FROM span GROUP BY 1, 2, 3) WHERE n_nodes >= 2 AND width >= 0.35e0"))
query("w5_rank_groups", lambda f: pr.rank_groups(span(f)), grow("SELECT *, row_number() OVER (PARTITION BY k, path_id ORDER BY n_nodes DESC, group_id)::INT AS rank FROM (SELECT k, path_id, group_id, count(*) AS n_nodes FROM span GROUP BY 1, 2, 3)"))
query("t4_top_groups", lambda f: pr.rank_groups(span(f)).where("rank <= 3").join(pr.group_centroids(span(f)).drop("n_nodes"), ["k", "path_id", "group_id"]).select("k", "path_id", "group_id", "rank", r6("cu").alias("cu"), r6("cv").alias("cv")), grow(f"SELECT k, path_id, group_id, rank::INT AS rank, {sql6('cu')} AS cu, {sql6('cv')} AS cv FROM (SELECT *, row_number() OVER (PARTITION BY k, path_id ORDER BY n DESC, group_id) AS rank FROM (SELECT k, path_id, group_id, count(*) AS n, avg(u) AS cu, avg(v) AS cv FROM span GROUP BY 1, 2, 3)) WHERE rank <= 3"))
query("t3_longest_path", lambda f: pr.longest_path(nodes(f)), walk("SELECT k, path_id, n_nodes FROM (SELECT k, path_id, count(*) AS n_nodes, row_number() OVER (PARTITION BY k ORDER BY count(*) DESC, path_id) AS r FROM ordered GROUP BY 1, 2) WHERE r = 1"))
query("t5_path_start_end", lambda f: pr.start_end(paths(f)), walk("SELECT k, path_id, s.a AS sx, s.b AS sy, s.c AS sz, e.a AS ex, e.b AS ey, e.c AS ez FROM first_"))
query("j11_centroid_pairing", lambda f: pr.centroid_pairing(grouped(f), span(f)).select("k", "path_id", "group_id", "n_segments", r6("cu").alias("cu"), r6("cv").alias("cv")), grow(f"SELECT g.k, g.path_id, g.group_id, n_segments, {sql6('cu')} AS cu, {sql6('cv')} AS cv FROM (SELECT k, path_id, group_id, count(*) AS n_segments FROM grouped GROUP BY 1, 2, 3) g JOIN (SELECT k, path_id, group_id, avg(u) AS cu, avg(v) AS cv FROM span GROUP BY 1, 2, 3) USING (k, path_id, group_id)"))
query("a26_group_points_3d", lambda f: pr.group_points(grouped(f)).select("k", "path_id", "group_id", *(r6(d).alias(d) for d in "xyz")).distinct(), grow("SELECT DISTINCT k, path_id, group_id, x, y, z FROM (SELECT k, path_id, group_id, " + ", ".join(f"{sql6(d + '1')} AS {d}" for d in "xyz") + " FROM grouped UNION ALL SELECT k, path_id, group_id, " + ", ".join(sql6(d + "2") for d in "xyz") + " FROM grouped)"))
FACED = {"faced": f"(SELECT g.*, s.face_id, max(greatest(z1, z2)) OVER (PARTITION BY g.k, path_id, group_id) - (z1 + z2) / 2 AS height FROM grouped g LEFT JOIN face_of s ON {_SAME.format('g')})"}
faced = lambda body: with_ctes("keyed_g", body, {**GROW, **FACED}, recursive=True)
query("a12_segment_heights", lambda f: heights(f).select("k", "path_id", "ord", "face_id", r6("height").alias("height")), faced(f"SELECT k, path_id, ord, face_id, {sql6('height')} AS height FROM faced"))
for _how in ("max", "min", "avg"):
    query(f"a13_face_heights_{_how}", lambda f, how=_how: pr.face_heights(heights(f), how).select("face_id", r6("height").alias("height"), "n"), faced(f"SELECT face_id, {sql6(f'{_how}(height)')} AS height, count(*) AS n FROM faced WHERE face_id IS NOT NULL GROUP BY 1"))
query("a27_face_set", lambda f: heights(f).where("face_id is not null").select("face_id").distinct(), faced("SELECT DISTINCT face_id FROM faced WHERE face_id IS NOT NULL"))
query("j9_faces_of_groups", lambda f: f.faces(gaps=True).join(heights(f).select("face_id"), "face_id", "left_semi"), with_ctes("keyed_g faces_g", "SELECT * FROM faces_g WHERE face_id IN (SELECT face_id FROM faced)", {**GROW, **FACED}, recursive=True))
query("u1_union_segments", lambda f: f.segments().select("k", "face_id").unionByName(f.segments(gaps=True).select("k", "face_id")).groupBy("k", "face_id").agg(F.count("*").alias("n")), with_ctes("segments segments_g", "SELECT k, face_id, count(*) AS n FROM (SELECT k, face_id FROM segments UNION ALL SELECT k, face_id FROM segments_g) GROUP BY 1, 2"))
query("u3_contained_paths", lambda f: _contained(f), walk("SELECT k, path_id FROM (SELECT k, path_id, min(v) AS lo, max(v) AS hi FROM node GROUP BY 1, 2) p WHERE NOT EXISTS (SELECT 1 FROM (SELECT k, path_id, min(v) AS lo, max(v) AS hi, count(*) AS n FROM node GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY k ORDER BY count(*) DESC, path_id) = 1) m WHERE m.k = p.k AND p.lo >= m.lo AND p.hi <= m.hi)"))
#: Pieces of the broken wall lie one above the other, so they are only put in order.
_STACKED = f"SELECT o.k, r.path_id, o.ord, {sql6('u')} AS u, {sql6('v')} AS v, o.path_id AS source_path, o.ord AS source_ord FROM ordered o JOIN (SELECT k, path_id AS p, (row_number() OVER (PARTITION BY k ORDER BY max(v) DESC) - 1)::INT AS path_id FROM ordered GROUP BY 1, 2 HAVING count(*) > 1) r ON r.k = o.k AND r.p = o.path_id"
query("o6_merge_open_paths", lambda f: pr.merge_open_paths(nodes(f)).select("k", "path_id", "ord", r6("u").alias("u"), r6("v").alias("v"), "source_path", "source_ord"), walk(_STACKED))
query("o6_merge_open_paths_replace", lambda f: pr.merge_open_paths(nodes(f), replace=True).select("k", "path_id", "ord", r6("u").alias("u"), r6("v").alias("v"), "source_path", "source_ord"), walk(_STACKED))
query("o7_recognise", lambda f: pr.recognise(f.segments(gaps=True)).select("k", "path_id", "group_id", r6("cu").alias("cu"), r6("cv").alias("cv"), "n_nodes", r6("width").alias("width"), "n_segments"), grow(f"SELECT s.k, s.path_id, s.group_id, {sql6('cu')} AS cu, {sql6('cv')} AS cv, n_nodes, {sql6('width')} AS width, n_segments FROM (SELECT k, path_id, group_id, avg(u) AS cu, avg(v) AS cv, count(*) AS n_nodes, abs(arg_max(u, ord) - arg_min(u, ord)) AS width FROM span GROUP BY 1, 2, 3) s JOIN (SELECT k, path_id, group_id, count(*) AS n_segments FROM grouped GROUP BY 1, 2, 3) USING (k, path_id, group_id)"))


# Open paths that overlap: the profiles of the whole wall in pieces of 20 nodes, each with three more at its top and moved sideways.
def _pieces(f: Fixtures):
    whole = f.kept("whole nodes", lambda: pr.ordered(f.segments()))
    whole = whole.withColumn("ord", F.row_number().over(Window.partitionBy("k").orderBy(F.col("v").desc())) - 1)  # few profiles have two paths
    piece = F.expr("ord div 20").cast("int")
    cut = whole.withColumn("piece", F.explode(F.when(F.col("ord") % 20 >= 17, F.array(piece, piece + 1)).otherwise(F.array(piece))))
    return cut.select("k", F.col("piece").alias("path_id"), "ord", (F.col("u") + F.col("piece") % 3 * 0.07).alias("u"), "v")


def _piece_segments(f: Fixtures):
    """The pieces as segments; a node is known by its piece and place."""
    along = Window.partitionBy("k", "path_id").orderBy("ord")
    ends = _pieces(f).withColumn("u2", F.lead("u").over(along)).withColumn("v2", F.lead("v").over(along)).where("u2 is not null")
    return ends.select("k", *(F.col(a).cast("double").alias(b) for a, b in (("u", "x1"), ("path_id", "y1"), ("v", "z1"), ("u", "u1"), ("v", "v1"), ("u2", "x2"), ("path_id", "y2"), ("v2", "z2"), ("u2", "u2"), ("v2", "v2"))))


_BRIDGE = "SELECT k, path_id, p, 0 AS kind, -1 AS spot, f.u AS u, f.v AS v, NULL::INT AS source_path, NULL::INT AS source_ord FROM state WHERE f IS NOT NULL"


def _merged_sql(replace: bool = False) -> dict[str, str]:
    out = {n: WALK[n].replace("keyed_g", "keyed") for n in ("raised", "piece", "ends", "placed", "node", "ordered")}
    return out | {
        "bit": "(SELECT k, p::INT AS p, ord, u + 0.07e0 * (p % 3) AS u, v, row_number() OVER (PARTITION BY k, p ORDER BY ord) AS j, row_number() OVER (PARTITION BY k, p ORDER BY ord DESC) AS back FROM (SELECT k, ord, u, v, unnest(CASE WHEN ord % 20 >= 17 THEN [ord // 20, ord // 20 + 1] ELSE [ord // 20] END) AS p FROM (SELECT k, (row_number() OVER (PARTITION BY k ORDER BY v DESC) - 1)::INT AS ord, u, v FROM ordered)))",
        "tail": "(SELECT k, p + 1 AS p, u AS tu, v AS tv FROM bit WHERE back = 1)",
        "side": "(SELECT b.k, b.p, j, u - tu AS qu, v - tv AS qv, lead(u - tu) OVER w AS wu, lead(v - tv) OVER w AS wv, tu, tv FROM bit b JOIN tail t ON t.k = b.k AND t.p = b.p WINDOW w AS (PARTITION BY b.k, b.p ORDER BY j))",
        "crossed": "(SELECT k, p, 0 AS axis, min(j) AS j FROM side WHERE qv * wv < 0 GROUP BY 1, 2 UNION ALL SELECT k, p, 1, min(j) FROM side WHERE qu * wu < 0 GROUP BY 1, 2)",
        "foot": "(SELECT k, p, j, axis, tu + fu AS u, tv + fv AS v, sqrt(fu * fu + fv * fv) AS dist FROM (SELECT *, qu + s * (wu - qu) AS fu, qv + s * (wv - qv) AS fv FROM (SELECT e.*, axis, -(qu * (wu - qu) + qv * (wv - qv)) / ((wu - qu) * (wu - qu) + (wv - qv) * (wv - qv) + 1e-8) AS s FROM side e JOIN crossed c ON c.k = e.k AND c.p = e.p AND c.j = e.j)))",
        "best": "(SELECT k, p, arg_min(struct_pack(j := j, u := u, v := v), struct_pack(d := dist, a := axis)) AS f FROM foot GROUP BY 1, 2)",
        "state": "(SELECT k, p, f, (sum(CASE WHEN f IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY p) - 1)::INT AS path_id, lead(f IS NOT NULL) OVER (PARTITION BY k ORDER BY p) AS goes_on FROM (SELECT b.k, b.p, f, b.p > 0 AND f IS NULL AND lo >= tv AS gone FROM (SELECT k, p, min(v) AS lo FROM bit GROUP BY 1, 2) b LEFT JOIN best ON best.k = b.k AND best.p = b.p LEFT JOIN tail t ON t.k = b.k AND t.p = b.p) WHERE NOT gone)",
        "merged": f"(SELECT k, path_id, (row_number() OVER (PARTITION BY k, path_id ORDER BY p, kind, spot) - 1)::INT AS ord, 0 AS kx, 0 AS ky, 0 AS kz, 0e0 AS x, 0e0 AS y, 0e0 AS z, u, v, source_path, source_ord FROM (SELECT s.k, path_id, s.p, 1 AS kind, b.ord AS spot, u, v, s.p AS source_path, b.ord AS source_ord FROM bit b JOIN state s ON s.k = b.k AND s.p = b.p WHERE (f IS NULL OR b.j > f.j){' AND NOT (goes_on IS TRUE AND back = 1)' * replace} UNION ALL {_BRIDGE}))",
    }


for _name, _replace in (("o6_merge_overlapping", False), ("o6_merge_overlapping_replace", True)):
    query(_name, lambda f, replace=_replace: pr.merge_open_paths(_pieces(f), replace).select("k", "path_id", "ord", r6("u").alias("u"), r6("v").alias("v"), "source_path", "source_ord"), with_ctes("keyed", f"SELECT k, path_id, ord, {sql6('u')} AS u, {sql6('v')} AS v, source_path, source_ord FROM merged", _merged_sql(_replace)))
_GROUPS = f"SELECT s.k, s.path_id, s.group_id, {sql6('cu')} AS cu, {sql6('cv')} AS cv, n_nodes, {sql6('width')} AS width, n_segments FROM (SELECT k, path_id, group_id, avg(u) AS cu, avg(v) AS cv, count(*) AS n_nodes, abs(arg_max(u, ord) - arg_min(u, ord)) AS width FROM span GROUP BY 1, 2, 3) s JOIN (SELECT k, path_id, group_id, count(*) AS n_segments FROM grouped GROUP BY 1, 2, 3) USING (k, path_id, group_id)"
query("o7_recognise_merged", lambda f: pr.recognise(_piece_segments(f), merge=True).select("k", "path_id", "group_id", r6("cu").alias("cu"), r6("cv").alias("cv"), "n_nodes", r6("width").alias("width"), "n_segments"), with_ctes("keyed", _GROUPS, {**_merged_sql(), **{n: GROW[n].replace("ordered", "merged") for n in ("pair", "framed", "red", "grow", "grouped", "span")}}, recursive=True))
query("s10_profiles_json", lambda f: store.profiles_json(pr.group_centroids(span(f)).withColumn("cu", F.round(F.col("cu") * 1000).cast("long")).withColumn("cv", F.round(F.col("cv") * 1000).cast("long")), f.planes()), grow("SELECT k, '{\"slice_key\":\"' || slice_key || '\",\"azimuth\":' || azimuth::VARCHAR || ',\"groups\":[' || string_agg('{\"path_id\":' || path_id || ',\"group_id\":' || group_id || ',\"cu\":' || cu || ',\"cv\":' || cv || ',\"n_nodes\":' || n || '}', ',' ORDER BY path_id, group_id) || ']}' AS record FROM (SELECT k, path_id, group_id, round(avg(u) * 1000)::BIGINT AS cu, round(avg(v) * 1000)::BIGINT AS cv, count(*) AS n FROM span GROUP BY 1, 2, 3) JOIN planes USING (k) GROUP BY k, slice_key, azimuth"))
query("s7_slice_store", lambda f: _stored_slices(f), with_ctes("segments", "SELECT k, face_id FROM segments WHERE k % 180 = 0"))
query("s8_result_store", lambda f: _stored_results(f), grow("SELECT k, path_id, group_id, count(*) AS n_nodes FROM span GROUP BY 1, 2, 3"))
query("p26_slice_subset", lambda f: store.slice_subset(f.segments(), 3.01, 30.01, 1.5).select("k", "face_id"), with_ctes("segments", "SELECT k, face_id FROM segments WHERE round_even(slice_key::DOUBLE * 1e8, 0)::BIGINT IN (SELECT round_even((3.01e0 + i * 1.5e0) * 1e8, 0)::BIGINT FROM range(19) r(i))"))


def _contained(f: Fixtures):
    n = nodes(f)
    spans = n.groupBy("k", "path_id").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    best = pr.longest_path(n).join(spans, ["k", "path_id"]).select("k", F.col("lo").alias("m_lo"), F.col("hi").alias("m_hi"))
    return pr.contained_paths(spans, best).select("k", "path_id")


def scratch(f: Fixtures, name: str) -> str:
    """A new folder beside the checkpoints, which driver and executors share."""
    return f"{shared_folder(f.spark)}/wallscan/{name}-{uuid.uuid4().hex}"


def _stored_slices(f: Fixtures):
    path = scratch(f, "slices")
    store.write_slices(f.segments(), path)
    return store.read_slices(f.spark, path, f.planes(180).select("k")).select("k", "face_id")


def _stored_results(f: Fixtures):
    """Groups written in three batches, one of them twice, and read back."""
    path = scratch(f, "results")
    groups = checkpointed(pr.group_centroids(span(f)).select("k", "path_id", "group_id", "n_nodes"))
    for batch in (0, 1, 2, 1):
        store.append_results(groups.where(F.col("k") % 3 == batch), path, batch)
    return store.read_results(f.spark, path).drop("batch")
