"""Steps whose work follows what a query asks for, not all that its tables hold."""

from collections import deque

import numpy as np
from pyspark.sql import functions as F

from wallscan.operators import neighbours
from wallscan.plans.fixtures import Fixtures
from wallscan.sources import tiles

SF = "/root/testdata/sf0.001"


def _hops_by_walks(links, targets, most):
    beside = {}
    for a, b in links:
        beside.setdefault(a, set()).add(b)
        beside.setdefault(b, set()).add(a)
    out = set()
    for t in targets:
        far, queue = {t: 0}, deque([t])
        while queue:
            n = queue.popleft()
            for o in beside.get(n, ()):
                if o not in far and far[n] < most:
                    far[o] = far[n] + 1
                    queue.append(o)
        out |= {(t, o, d) for o, d in far.items() if d and o in targets}
    return out


def test_hops_meet_halfway(spark, monkeypatch):
    """Hops as by walks from each target, with ways that branch and close; no more is written than what lies within half the hops, and all links once."""
    n, written = 6000, []
    links = [(i // 2, i) for i in range(1, n)] + [(i, i + 7) for i in range(0, 60, 9)]
    targets = [*range(0, 40, 3), *range(2000, 2100, 7), n - 1, n + 5]
    edges = spark.createDataFrame([(a, b) for a, b in links if a < b], "a long, b long")
    asked = spark.createDataFrame([(t,) for t in targets], "face_id long")

    def counted(df):
        kept = real(df)
        written.append(kept.count())
        return kept

    real = neighbours.checkpointed
    monkeypatch.setattr(neighbours, "checkpointed", counted)
    for most in (1, 2, 3, 4, 7, 10):
        written.clear()
        got = [tuple(r) for r in neighbours.hops(edges, asked, most).select("a", "b", "d").collect()]
        assert len(got) == len(set(got)) and set(got) == _hops_by_walks([(a, b) for a, b in links if a < b], set(targets), most)
        if most == 10:
            assert max(written) == written[0] == edges.count()  # twice as many links and five times as many ways before


def test_places_aggregated_once(spark):
    """Rows of lineitem are moved before they are aggregated, not after each task has made a group of nearly every row."""
    f = Fixtures(spark, SF)
    plan = f._wall()._jdf.queryExecution().executedPlan().toString()
    assert plan.index("partial_avg") < plan.index("Exchange hashpartitioning(i")
    rows = f.lineitem.crossJoin(f.grid).groupBy((F.col("l_partkey") % F.col("ni")).alias("i"), (F.col("l_orderkey") % F.col("nj")).alias("j"))
    want = rows.agg((50 + F.avg("l_quantity") * 0.05).alias("r"))
    got = f._wall().select("i", "j", "r")
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty() and got.count() > 100


def test_ranges_of_tiles_are_many_tasks(spark, tmp_path):
    """Ranges of small tiles are read by as many tasks as a shuffle has, and columns of headers come along; odd tiles are written as they are."""
    rows = [(t, node, None if node == "a" else "a", 10 * t + i, t + 0.1, None if i == 2 else float(i), -1e300 if i == 3 else 0.3) for t in range(60) for node in ("a", "b") for i in range(1 + t % 5)]
    points = spark.createDataFrame(rows, "tile int, node string, parent string, point_id long, x double, y double, z double")
    tiles.write_3mx_tiles(points, f"{tmp_path}/scene")
    heads = tiles.read_3mx_headers(spark, f"{tmp_path}/scene").withColumn("tile", F.regexp_extract("path", r"tile-(\d+)", 1).cast("int"))
    read = tiles.ranged_tile_points(heads, 24)
    assert read.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    numbers = [float(np.float32(t + 0.1)) for t in range(60)]
    want = {(t, node, i, numbers[t], y, float("-inf") if z < 0 else float(np.float32(z))) for (t, node, _, p, _, y, z) in rows for i in [p - 10 * t]}
    got = [(r.tile, r.node, r.i, r.x, r.y, r.z) for r in read.collect()]
    assert len(got) == len(rows) and set(got) == want
    plain = tiles.tile_points(tiles.read_3mx_tiles(spark, f"{tmp_path}/scene"))
    same = lambda df: sorted(repr(tuple(r)) for r in df.select("path", "node", F.col("i").cast("int"), *"xyz").collect())
    assert same(read) == same(plain)


def test_a_leaf_gives_a_point_no_more_than_k(spark):
    """Targets are listed after the k nearest of a leaf are taken and moved, so no task sorts all targets that points meet; ties go by id."""
    places = spark.range(900).select("id", (F.col("id") % 30 * 1.0).alias("x"), F.expr("id div 30 * 1.0D").alias("y"))
    got = neighbours.nearest(places, places, 6, "xy")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate inline(_t") < plan.index("Exchange hashpartitioning(_a")
    at = np.array(places.orderBy("id").select("x", "y").collect())
    d2 = ((at[:, None] - at[None]) ** 2).sum(2)
    want = {(i, int(t), r + 1) for i in range(900) for r, t in enumerate(np.lexsort((np.arange(900), d2[i]))[:6])}
    rows = got.collect()
    assert {(r.id, r.target, r.rank) for r in rows} == want and len(rows) == len(want)
    assert all(r.distance == d2[r.id, r.target] ** 0.5 for r in rows)
