"""Tables that Spark takes for small, as their files are, are moved by key and never gathered by the driver."""

import re

from pyspark.sql import functions as F

from wallscan.operators import clusters, meshes, neighbours
from wallscan.plans.fixtures import Fixtures

SF = "/root/testdata/sf0.001"


def _broadcast(df) -> set:
    """First keys of the joins whose one side is broadcast."""
    return set(re.findall(r"BroadcastHashJoin \[(\w+)#", df._jdf.queryExecution().executedPlan().toString()))


def test_rows_around_a_point_are_moved(spark):
    """A file of 20,000 points is small, but their 540,000 rows in the cells around are not."""
    grid = spark.range(20_000).select("id", *(F.expr(f"cast({e} as double)").alias(d) for d, e in zip("xyz", ("id % 40", "id div 40 % 25", "id div 1000"), strict=True)))
    points = neighbours.checkpointed(grid)
    pairs = neighbours.pairs_within(points, 1.0)
    assert not _broadcast(pairs) and "Broadcast" not in pairs._jdf.queryExecution().executedPlan().toString()
    assert pairs.count() == pairs.distinct().count() == 2 * (39 * 25 * 20 + 40 * 24 * 20 + 40 * 25 * 19)
    asked = neighbours.kde(points.select(*"xyz"), points, 0.5, cutoff=4)
    assert not _broadcast(asked)


def test_cores_beyond_a_bound_are_moved(spark, monkeypatch):
    """With more cores than SMALL_LEVEL, none of the joins of cores and labels broadcasts; labels are those of DBSCAN by cells."""
    rows = [(i, (i % 20) * 0.1 + (i // 400) * 5.0, (i // 20 % 20) * 0.1, 0.01 * (i % 7)) for i in range(2000)] + [(9000 + i, -9.0 * i, 3.0, 0.0) for i in range(20)]
    points = neighbours.checkpointed(spark.createDataFrame(rows, "id long, x double, y double, z double"))
    want = {tuple(r) for r in clusters.dbscan_points(points, 0.16, 5).collect()}
    plans, real = [], neighbours.checkpointed

    def seen(df):
        plans.append(_broadcast(df))
        return real(df)

    monkeypatch.setattr(neighbours, "checkpointed", seen)
    for level in (100, 50_000):
        plans.clear()
        monkeypatch.setattr(neighbours, "SMALL_LEVEL", level)
        got = neighbours.dbscan_from_pairs(points.select("id"), neighbours.pairs_within(points, 0.16), 5)
        keys = set().union(*plans, _broadcast(got))
        assert keys <= {"_b", "_s"} if level == 100 else {"a", "u"} <= keys  # _b, _s: blocks of 4096 ids
        assert {tuple(r) for r in got.collect()} == want and len(want) == len(rows) and {label for _, label in want} == {-1, 0, 1, 2, 3, 4}


def test_cells_are_moved_to_the_rows_of_their_faces(spark):
    wall = Fixtures(spark, SF)
    rows = wall.faces(True).select("face_id", F.lit(0.5).alias("height"))
    raised = wall.tri_of(rows, gaps=True)
    assert not _broadcast(raised) and raised.count() == rows.count() > 1000


def test_heights_of_faces_are_moved(spark):
    """Prisms and voxels of faces whose heights fill a small file, as two columns of kept cells do."""
    wall = Fixtures(spark, SF)
    heights = wall.faces().select("face_id", (F.col("face_id") % 7 * 0.25).alias("height"))
    solid = meshes.prisms(wall.tri(), heights)
    assert not _broadcast(solid) and not _broadcast(meshes.voxelise(wall.tri(), heights, wall.grid_meta(0.2), 0.2))
    parts = solid.groupBy("face_id").agg(F.count("*").alias("n"), F.countDistinct("part").alias("parts"))
    assert parts.where("n = 8 and parts = 8").count() == parts.count() == wall.faces().count() > 1000
