"""The steps that the surface queries share: lean cells, the cut of columns that meet a plane, slices walked along arrays, groups grown in one fold."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wallscan.operators import meshes, neighbours, planes, profiles
from wallscan.plans.fixtures import START, STEP, Fixtures
from wallscan.plans.profile_queries import heights
from wallscan.sources import text

SF = "/root/testdata/sf0.001"


def _same(a, b):
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def _exchanges(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


@pytest.fixture(scope="module")
def wall(spark):
    return Fixtures(spark, SF)


def _shapes(spark):
    """Slices of all kinds: a chain, a chain with a repeated segment, a fork, a ring with a tail, a ring, a lone point, a flat chain."""
    chain = lambda *nodes: list(zip(nodes, nodes[1:]))
    slices = [chain(3, 1, 4, 0, 5), [*chain(2, 0, 1), (1, 0)], [*chain(0, 1, 2), *chain(1, 3, 4)], [*chain(0, 1, 2, 3, 0), (3, 5)], chain(0, 2, 4, 0), [(1, 1), *chain(4, 2, 3)], chain(10, 11, 12)]
    place = lambda n: (float(n), n % 3 * 0.5, float(n % 5 if n < 10 else 1), float(n), float(n % 5 if n < 10 else 1))
    rows = [(k, 100 * k + i, *place(a), *place(b)) for k, s in enumerate(slices) for i, (a, b) in enumerate(s)]
    return spark.createDataFrame(rows, "k long, face_id long, " + ", ".join(f"{c}{i} double" for i in (1, 2) for c in "xyzuv"))


def test_slices_walked_once(spark, wall):
    """Ordered nodes and the faces of their segments after one shuffle, as components, walks and a join on node keys give them."""
    for segments in (_shapes(spark), wall.segments(gaps=True).where("k % 40 = 0"), wall.segments().where("k % 40 = 0")):
        got = neighbours.checkpointed(profiles.ordered(segments))
        want = neighbours.checkpointed(profiles.order_path(profiles.components(segments)))
        assert _same(got.drop("face_id"), want) and got.count() > 10
        edges = profiles.path_edges(got)
        assert _same(profiles.match_faces(edges.drop("face_id"), segments).select("k", "path_id", "ord", "face_id"), edges.select("k", "path_id", "ord", "face_id"))
        assert _exchanges(profiles.ordered(segments)) == 1


def test_faces_without_a_number(spark):
    segments = _shapes(spark).withColumn("face_id", F.expr("if(face_id % 2 = 0, null, face_id)"))
    edges = profiles.path_edges(profiles.ordered(segments))
    assert _same(profiles.match_faces(edges.drop("face_id"), segments).select("k", "path_id", "ord", "face_id"), edges.select("k", "path_id", "ord", "face_id"))


def test_heights_join_no_segments(wall):
    """Faces come with the nodes, so that no query joins all segments by their ends again."""
    assert "Join" not in heights(wall)._jdf.queryExecution().optimizedPlan().toString()


def test_growth_in_one_fold(spark, wall):
    red = neighbours.checkpointed(profiles.overhangs(profiles.path_edges(profiles.ordered(wall.segments(gaps=True).where("k % 20 = 0")))))
    grown = profiles.grow_groups(red)
    plan = grown._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "collect_list" not in plan and grown.count() > 10
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert _same(profiles.grow_groups(red), grown)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_columns_between_planes_make_no_faces(wall):
    """Slices of the pruned wall are those of all faces; a cell's corners come with one shuffle."""
    for gaps in (False, True):
        assert _same(wall.segments(gaps), planes.cut(wall.tri(gaps), wall.planes(), wall.arc5, START, STEP))
    assert _exchanges(wall._cells()) == 1
    heights = wall.faces(True).where("face_id % 3 = 1").select("face_id", (F.col("face_id") % 7 * 0.5).alias("height"))
    raised = wall.tri_of(heights, gaps=True)
    assert _same(raised, wall.tri(True).join(heights, "face_id").select(raised.columns)) and raised.count() == heights.count()
    meta = wall.grid_meta(0.2)
    assert _same(meshes.voxelise(wall.tri(True), heights, meta, 0.2), meshes.voxelise_raised(raised, meta, 0.2))


def test_may_meet(spark):
    """No plane between two angles is missed."""
    rng = np.random.default_rng(3)
    lo = rng.uniform(-0.7, 0.7, 500)
    rows = [(float(a), float(a + w), -0.75, 51.25) for a, w in zip(lo, rng.uniform(0, 0.002, 500))]
    df = spark.createDataFrame(rows, "lo double, hi double, angle_min double, radius double").withColumn("met", planes.may_meet(F.col("lo"), F.col("hi"), START, STEP))
    at = -0.75 + (START + STEP * np.arange(2000)) / 51.25
    met = [bool(((at >= r.lo) & (at <= r.hi)).any()) for r in df.collect()]
    assert all(r.met for r, m in zip(df.collect(), met) if m) and sum(not r.met for r in df.collect()) > 50


def test_tiles_without_joins_by_corner(spark, wall, tmp_path):
    """Tiles come in one shuffle and are read without another; lines of a file keep their numbers, odd ones are left out."""
    faces = wall.faces().withColumn("tile", F.format_string("%06d", F.expr("face_id div 97")))
    text.write_obj_tiles(wall.vertices, faces, f"{tmp_path}/tiles")
    assert len(list((tmp_path / "tiles").rglob("*.obj"))) == faces.select("tile").distinct().count() > 10
    vertices, read = text.read_obj_tiles(spark, f"{tmp_path}/tiles")
    assert _exchanges(vertices) == _exchanges(read) == 0 and read.count() == faces.count()
    at = lambda i: vertices.select(F.col("vertex_id").alias(f"v{i}"), *(F.col(d).alias(f"{d}{i}") for d in "xyz"))
    shapes = read
    for i in (0, 1, 2):
        shapes = shapes.join(at(i), f"v{i}")
    names = [f"{d}{i}" for i in (0, 1, 2) for d in "xyz"]
    assert _same(shapes.select(names), wall.tri().select(names))
    (tmp_path / "odd").mkdir()
    (tmp_path / "odd" / "a.obj").write_text("# v 9 9 9\nvn 0 0 1\n  v 1 2 3 \r\nv 4 5 6\n\nf 1/1 2/2 1/3\n\tv 7 7 7\nv")
    (tmp_path / "odd" / "b.obj").write_text("v 1 1 1\nf 1 1 1\n")
    vertices, read = text.read_obj_tiles(spark, f"{tmp_path}/odd")
    assert sorted(map(tuple, vertices.select("vertex_id", *"xyz").collect())) == [(0, 1, 2, 3), (1, 4, 5, 6), (2, 1, 1, 1)]
    assert sorted(map(tuple, read.select("face_id", "v0", "v1", "v2").collect())) == [(0, 0, 1, 0), (1, 2, 2, 2)]
