"""Properties, sources and streams of the surface operators."""

import json
import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from wallscan.operators import clouds, meshes, neighbours, planes, profiles
from wallscan.plans.fixtures import Fixtures
from wallscan.sources import store, text, tiles
from wallscan.streaming.recognition import face_heights_stream, recognise_stream

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def fixtures(spark):
    return Fixtures(spark, SF)


@pytest.fixture(scope="module")
def segments(fixtures):
    return fixtures.segments(gaps=True).cache()


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_cut_near_and_over_the_axis(spark):
    """The range join finds the segments that testing all pairs finds, also at the antipode and about the axis."""
    rng = random.Random(1)
    arc = spark.createDataFrame([(0.0, 0.0, 5.0, -0.75, 0.75)], "cx double, cy double, radius double, angle_min double, angle_max double")
    rows = []
    for i in range(400):
        c = [rng.uniform(-6, 6) * rng.choice([0.1, 1]) for _ in range(2)]
        size = rng.choice([0.3, 4])
        rows.append((i, 3 * i, 3 * i + 1, 3 * i + 2, *(x for _ in range(3) for x in (c[0] + rng.uniform(-size, size), c[1] + rng.uniform(-size, size), rng.uniform(0, 2)))))
    tri = spark.createDataFrame(rows, "face_id long, v0 long, v1 long, v2 long, " + ", ".join(f"{d}{i} double" for i in (0, 1, 2) for d in "xyz"))
    table = planes.planes(arc, 0.0125, 0.05)
    fast = {(r.k, r.face_id, round(r.x1, 9)) for r in planes.cut(tri, table, arc, 0.0125, 0.05).collect()}
    slow = {(r.k, r.face_id, round(r.x1, 9)) for r in planes.segments_of(tri.crossJoin(table)).collect()}
    assert fast == slow and len(slow) > 3000


def test_cut_points_lie_on_the_plane(fixtures, segments):
    off = segments.join(fixtures.planes(60), "k").agg(F.max(F.abs((F.col("x1") - F.col("ox")) * F.col("nx") + (F.col("y1") - F.col("oy")) * F.col("ny")))).first()[0]
    assert off < 1e-9


def test_fused_equals_composed(segments):
    nodes = profiles.order_path(profiles.components(segments))
    span = profiles.group_span(profiles.grow_groups(profiles.overhangs(profiles.path_edges(nodes))), nodes)
    key = lambda r: (r.k, r.path_id, r.group_id, round(r.cu, 9), round(r.cv, 9), r.n_nodes)
    assert sorted(map(key, profiles.group_centroids(span).collect())) == sorted(map(key, profiles.recognise(segments).collect()))


def test_planted_circle(spark):
    rng = random.Random(2)
    points = [(3 + 7.5 * math.cos(a) + rng.gauss(0, 1e-3), -2 + 7.5 * math.sin(a) + rng.gauss(0, 1e-3)) for a in (rng.uniform(-1, 1) for _ in range(2000))]
    assert clouds.fit_arc(spark.createDataFrame(points, "x double, y double")) == pytest.approx((3, -2, 7.5), abs=1e-3)


def test_watertight(spark):
    box = [(0, 2, 3), (0, 3, 1), (4, 5, 7), (4, 7, 6), (0, 1, 5), (0, 5, 4), (2, 6, 7), (2, 7, 3), (0, 4, 6), (0, 6, 2), (1, 3, 7), (1, 7, 5)]
    faces = spark.createDataFrame([(i, *t) for i, t in enumerate(box)], "face_id long, v0 long, v1 long, v2 long")
    full = meshes.mesh_check(faces).first()
    assert full.watertight and full.winding and full.n_edges == 18
    part = meshes.mesh_check(faces.where("face_id > 0")).first()
    assert not part.watertight and part.n_border == 3


def test_merge_of_two_chains():
    upper = [(0.0, 10.0, 0), (0.2, 8.0, 1), (0.1, 5.0, 2)]
    lower = [(1.0, 6.0, 3), (1.2, 4.0, 4), (1.0, 1.0, 5)]
    (way,) = profiles.merge_nodes([lower, upper])
    assert [n[2] for n in way] == [0, 1, 2, -1, 4, 5]
    (way,) = profiles.merge_nodes([lower, upper], replace=True)
    assert [n[2] for n in way] == [0, 1, -1, 4, 5]
    assert profiles.merge_nodes([upper, [(0.5, 7.0, 6), (0.5, 6.0, 7)]]) == [upper]


def test_notch_is_one_group(spark):
    """A wall with one C-shaped notch gives one overhang group."""
    uv = [(0, 10), (0, 8), (0, 6), (-2, 5.5), (-2, 4), (0, 3.5), (0, 2), (0, 0)]
    rows = [(0, i, *(x for u, v in (uv[i], uv[i + 1]) for x in (u, 0.0, v, u, v))) for i in range(len(uv) - 1)]
    names = "k long, face_id long, " + ", ".join(f"{c}{i} double" for i in (1, 2) for c in ("x", "y", "z", "u", "v"))
    got = profiles.recognise(spark.createDataFrame([(r[0], r[1], *map(float, r[2:])) for r in rows], names)).collect()
    assert len(got) == 1 and got[0].n_segments == 1 and got[0].width == pytest.approx(2)


def test_kde_integrates_to_one(spark):
    samples = spark.createDataFrame([(0.0, 0.0, 0.0), (1.0, 0.5, -0.5)], "x double, y double, z double")
    grid = spark.range(21**3).select("id", *(((F.floor(F.col("id") / 21**n) % 21) * 0.5 - 5).alias(d) for n, d in enumerate("xyz")))
    dense = neighbours.kde(samples, grid, 0.8).agg(F.sum("density")).first()[0] * 0.125
    near = neighbours.kde(samples, grid, 0.8, cutoff=5).agg(F.sum("density")).first()[0] * 0.125
    assert dense == pytest.approx(1, abs=0.01) and near == pytest.approx(dense, abs=1e-3)


def test_nearest_in_sparse_places(spark):
    rng = random.Random(3)
    points = [(i, rng.uniform(0, 100) if i % 3 else rng.uniform(0, 1), rng.uniform(0, 1)) for i in range(150)]
    df = spark.createDataFrame(points, "id long, x double, y double")
    got = {(r.id, r["rank"]): r.target for r in neighbours.nearest(df, df, 3, "xy").collect()}
    for i, x, y in points:
        order = sorted(points, key=lambda p: ((p[1] - x) ** 2 + (p[2] - y) ** 2, p[0]))
        assert [got[i, n] for n in (1, 2, 3)] == [p[0] for p in order[:3]]


def test_kde_takes_no_sample_of_its_own(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "MOST_SAMPLES", 3)
    samples = spark.range(4).select(F.col("id").cast("double").alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
    targets = samples.select(F.col("x").cast("long").alias("id"), "x", "y", "z")
    with pytest.raises(ValueError):
        neighbours.kde(samples, targets, 1.0)
    assert neighbours.kde(samples, targets, 1.0, cutoff=4).count() == 4
    assert {r.density for r in neighbours.kde(samples.limit(0), targets, 1.0).collect()} == {0.0}


def test_near_plane_points_meet_all_planes(spark, fixtures):
    """The planes within a point's azimuths are those that a test of all pairs finds, also near the axis and behind it."""
    rng = random.Random(5)
    points = spark.createDataFrame([(i, rng.uniform(-3, 3) * rng.choice([0.01, 1]), rng.uniform(-3, 3) * rng.choice([0.01, 1]), 0.0) for i in range(300)], "vertex_id long, x double, y double, z double")
    arc = spark.createDataFrame([(0.1, -0.2, 5.0, -0.75, 0.75)], "cx double, cy double, radius double, angle_min double, angle_max double")
    table = planes.planes(arc, 0.0125, 0.05)
    fast = {(r.vertex_id, r.k) for r in planes.near_plane_points(points, table, arc, 0.0125, 0.05, 0.1).collect()}
    slow = points.crossJoin(table).where(F.abs((F.col("x") - F.col("ox")) * F.col("nx") + (F.col("y") - F.col("oy")) * F.col("ny")) <= 0.1)
    assert fast == {(r.vertex_id, r.k) for r in slow.collect()} and len(fast) > 1000


def test_numbered(spark):
    ids = [*range(0, 50_000, 977), -4, 10**15, 10**15 + 3]
    got = dict(neighbours.numbered(spark.createDataFrame([(i,) for i in ids], "id long"), "id", "n").collect())
    assert got == {x: n for n, x in enumerate(sorted(ids))}


def test_text_layouts(spark, tmp_path):
    (tmp_path / "a.txt").write_text("1 2 3 255 0 51 9 0 0 1\n 4  5 6 0 0 0 9 1 0 0\nbad line\n")
    rows = text.read_points_txt(spark, str(tmp_path / "a.txt")).orderBy("x").collect()
    assert [(r.x, r.r, r.b, r.nz) for r in rows] == [(1, 1.0, 0.2, 1), (4, 0, 0, 0)]


def test_obj_tiles(spark, tmp_path):
    (tmp_path / "a.obj").write_text("# tile\nv 0 0 0\nv 1 0 0\nv 0 1 0\nf 1 2 3\n")
    (tmp_path / "b.obj").write_text("v 0 0 5\nv 1 0 5\nv 0 1 5\nf 1/1 2/2 3/3\n")
    vertices, faces = text.read_obj_tiles(spark, str(tmp_path))
    assert vertices.count() == 6 and sorted((r.face_id, r.v0, r.v1, r.v2) for r in faces.collect()) == [(0, 0, 1, 2), (1, 3, 4, 5)]


def test_tiles(spark, tmp_path):
    points = np.arange(12, dtype="<f4")
    header = json.dumps({"nodes": [{"id": "r", "resource_start": 0, "resource_end": 24}, {"id": "c", "resource_start": 24, "resource_end": 48, "parent": "r"}, {"id": "e", "resource_start": 48, "resource_end": 50, "parent": "r"}]}).encode()
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "t.3mxb").write_bytes(b"3MXBO" + struct.pack("<I", 9 + len(header)) + header + points.tobytes() + b"xx")
    (tmp_path / "no.3mxb").write_bytes(b"other")
    t = tiles.read_3mx_tiles(spark, str(tmp_path))
    assert t.count() == 1
    assert dict(tiles.tile_nodes(t).groupBy("kind").count().collect()) == {"parent": 1, "child": 2}
    rows = tiles.tile_points(t).orderBy("node", "i").collect()
    assert [(r.node, r.x) for r in rows] == [("c", 6), ("c", 9), ("r", 0), ("r", 3)]


def test_arc_forms(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"center": [1, 2, 3], "radius": 5.0, "angle_min": 0.0, "angle_max": 1.0, "z_min": 0.5, "z_max": 2.5}))
    r = store.read_arc(spark, str(tmp_path / "a.json")).first()
    assert (r.cx, r.cy, r.z_min, r.z_max, r.arc_length) == (1, 2, 0.5, 2.5, 5)


def test_stream_equals_batch(spark, segments, tmp_path):
    slices, out = str(tmp_path / "slices"), str(tmp_path / "out")
    for part in (0, 1):
        segments.where(F.col("k") % 2 == part).coalesce(1).write.mode("append").parquet(slices)
        recognise_stream(spark, slices, segments.schema, out, str(tmp_path / "check")).awaitTermination()
    got = sorted(tuple(r) for r in store.read_results(spark, out).drop("batch").collect())
    assert got == sorted(tuple(r) for r in profiles.recognise(segments).collect()) and got


def test_running_heights(spark, tmp_path):
    path = str(tmp_path / "heights")
    spark.createDataFrame([(1, 2.0), (1, 5.0), (2, 1.0), (None, 9.0)], "face_id long, height double").write.parquet(path)
    stream = face_heights_stream(spark.readStream.schema("face_id long, height double").parquet(path))
    stream.writeStream.format("memory").queryName("heights").outputMode("update").trigger(availableNow=True).start().awaitTermination()
    assert {(r.face_id, r.height, r.n) for r in spark.table("heights").collect()} == {(1, 5.0, 2), (2, 1.0, 1)}
