"""Neighbours and clusters of uneven points: equal to brute force, and with work that follows the points."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from wallscan.operators import clouds, clusters, meshes, neighbours


def cloud(spark, rows, dims="xyz"):
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rows)], "id long, " + ", ".join(f"{d} double" for d in dims))


def uneven(rng, n, dims):
    """Half of the points in a tiny place, some at one place, the rest anywhere and on a lattice."""
    crowd = [[0.3 + rng.random() * 1e-3 for _ in range(dims)] for _ in range(n // 2)]
    wide = [[rng.random() for _ in range(dims)] for _ in range(n // 4)]
    same = [[0.7] * dims] * (n // 8)
    lattice = [[rng.randrange(5) * 0.25 for _ in range(dims)] for _ in range(n // 8)]
    rows = crowd + wide + same + lattice
    rng.shuffle(rows)
    return rows


def apart(a, b):
    total = 0.0  # sum() would compensate, which Spark's addition doesn't
    for x, y in zip(a, b, strict=True):
        total += (x - y) * (x - y)
    return total


@pytest.mark.parametrize(("dims", "k"), [("xy", 1), ("xy", 5), ("xyz", 3), ("x", 2)])
def test_nearest_of_uneven_points(spark, dims, k):
    rng = random.Random(k)
    rows, asked = uneven(rng, 500, len(dims)), uneven(rng, 160, len(dims)) + [[9.0] * len(dims)]
    got = {}
    for r in neighbours.nearest(cloud(spark, asked, dims), cloud(spark, rows, dims), k, dims).collect():
        got[r.id, r["rank"]] = (r.target, r.distance)
    want = {}
    for i, a in enumerate(asked):
        best = sorted((apart(a, b), j) for j, b in enumerate(rows))[:k]
        want.update({(i, n + 1): (j, math.sqrt(d)) for n, (d, j) in enumerate(best)})
    assert got == want


def test_nearest_on_edge_cases(spark):
    two = cloud(spark, [[0, 0], [1, 1]], "xy")
    assert neighbours.nearest(two, two, 5, "xy").count() == 4
    assert neighbours.nearest(two, two.limit(0), 5, "xy").count() == 0
    assert neighbours.nearest(two.limit(0), two, 5, "xy").count() == 0
    unknown = two.unionByName(two.select((F.col("id") + 10).alias("id"), "x", F.lit(None).cast("double").alias("y")))
    assert neighbours.nearest(unknown, unknown, 5, "xy").count() == 4


def test_tree_holds_few_in_a_leaf(spark):
    """However uneven the points, leaves are small, boxes are tight, and levels are few."""
    rng = random.Random(3)
    rows = [[0.5 + rng.random() * 1e-6, 0.5 + rng.random() * 1e-6] for _ in range(20_000)] + [[rng.random(), rng.random()] for _ in range(20_000)]
    leaves, levels = neighbours.split_tree(cloud(spark, rows, "xy"), "xy")
    sizes = [r["count"] for r in leaves.groupBy("node").count().collect()]
    assert sum(sizes) == 40_000 and max(sizes) <= neighbours.LEAF and len(levels) <= 10
    assert sum(n for _, n in levels) < 40_000 / 4


def test_pairs_met_in_a_crowd_are_few(spark):
    """Half of all points in a millionth of the area: a point meets about as many targets as in even data."""
    rng = random.Random(5)
    crowd = [[0.5 + rng.random() * 1e-3, 0.5 + rng.random() * 1e-3] for _ in range(3000)] + [[rng.random(), rng.random()] for _ in range(3000)]
    even = [[rng.random(), rng.random()] for _ in range(6000)]
    counts = [_joined_rows(neighbours.nearest(cloud(spark, rows, "xy"), cloud(spark, rows, "xy"), 5, "xy")) for rows in (even, crowd)]
    assert 6000 * 5 <= counts[1] <= 2 * counts[0] and counts[0] < 6000 * 300


def _joined_rows(df) -> int:
    """Pairs of a point and a target that the last join of nearest() makes."""
    plan = df._jdf.queryExecution().optimizedPlan()
    node = plan
    while "Join" not in node.nodeName():
        node = node.children().head()
    return df.sparkSession._jvm.org.apache.spark.sql.classic.Dataset.ofRows(df.sparkSession._jsparkSession, node).count()


def brute_dbscan(rows, eps, min_samples):
    n = len(rows)
    near = [[j for j in range(n) if apart(rows[i], rows[j]) <= eps * eps] for i in range(n)]
    core = [len(x) >= min_samples for x in near]
    label, out = 0, [-1] * n
    for i in range(n):
        if core[i] and out[i] < 0:
            todo, out[i] = [i], label
            while todo:
                for j in near[todo.pop()]:
                    if core[j] and out[j] < 0:
                        out[j] = label
                        todo.append(j)
            label += 1
    for i in range(n):
        if not core[i]:
            out[i] = min((out[j] for j in near[i] if core[j]), default=-1)
    return out


@pytest.mark.parametrize(("dims", "eps", "min_samples", "seed"), [("xyz", 0.12, 4, 1), ("xyz", 0.25, 12, 2), ("xy", 0.05, 5, 3), ("xy", 0.25, 1, 4), ("xy", 0.0007, 8, 5), ("x", 0.004, 3, 6)])
def test_dbscan_as_brute_force(spark, dims, eps, min_samples, seed):
    rows = uneven(random.Random(seed), 400, len(dims))
    got = {r.id: r.label for r in clusters.dbscan_points(cloud(spark, rows, dims), eps, min_samples, dims).collect()}
    assert [got[i] for i in range(len(rows))] == brute_dbscan(rows, eps, min_samples)


def test_dbscan_of_crowds_side_by_side(spark):
    """Dense cells just within, at and beyond eps of each other are decided by their boxes."""
    rng, rows = random.Random(7), []
    for at in (0.0, 1.3, 2.7, 4.1, 9.0):
        rows += [[at + rng.random() * 0.4, rng.random() * 0.4] for _ in range(300)]
    rows += [[at + rng.random(), 0.9 + rng.random()] for at in range(6) for _ in range(4)]
    for eps in (0.9, 1.0, 1.05):
        got = {r.id: r.label for r in clusters.dbscan_points(cloud(spark, rows, "xy"), eps, 40, "xy").collect()}
        assert [got[i] for i in range(len(rows))] == brute_dbscan(rows, eps, 40)


def test_dbscan_on_edge_cases(spark):
    one = cloud(spark, [[0, 0, 0]])
    assert clusters.dbscan_points(one.limit(0), 1.0, 3).count() == 0
    assert [r.label for r in clusters.dbscan_points(one, 1.0, 2).collect()] == [-1]
    unknown = one.unionByName(spark.createDataFrame([(5, None, 0.0, 0.0)], one.schema))
    assert {(r.id, r.label) for r in clusters.dbscan_points(unknown, 1.0, 1).collect()} == {(0, 0), (5, -1)}
    with pytest.raises(ValueError):
        clusters.dbscan_points(one, 0.0, 3)


def test_crowded_cells_make_no_pairs(spark):
    """A million points in ten cells: the links between units stay a handful of rows."""
    rows = spark.range(1_000_000).select("id", (F.col("id") % 10 * 0.7 + F.rand(1) * 0.3).alias("x"), (F.rand(2) * 0.3).alias("y"), (F.rand(3) * 0.3).alias("z"))
    points = neighbours.checkpointed(rows)
    labels = clusters.dbscan_points(points, 1.0, 10)
    assert [tuple(r) for r in labels.groupBy("label").count().collect()] == [(0, 1_000_000)]


def test_labels_that_do_not_settle_raise(spark):
    chain = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    with pytest.raises(RuntimeError):
        neighbours.least_labels(chain, rounds=1)
    assert {r.label for r in neighbours.least_labels(chain).collect()} == {0}


def brute_density(samples, targets, h):
    out = []
    for t in targets:
        out.append(sum(math.exp(-apart(t, s) / (2 * h * h)) for s in samples) / (len(samples) * (2 * math.pi) ** 1.5 * h**3))
    return out


@pytest.mark.parametrize(("h", "tolerance"), [(0.05, 1e-3), (0.4, 1e-4), (3.0, 1e-3), (0.2, 0.0)])
def test_certified_density(spark, h, tolerance):
    rng = random.Random(11)
    samples, asked = uneven(rng, 1500, 3), uneven(rng, 60, 3) + [[50.0, 0.0, 0.0]]
    rows = neighbours.certified_kde(cloud(spark, samples), cloud(spark, asked), h, tolerance, most=8).orderBy("id").collect()
    want = brute_density(samples, asked, h)
    most = tolerance / ((2 * math.pi) ** 1.5 * h**3)
    assert len(rows) == len(asked)
    for r, true in zip(rows, want, strict=True):
        assert abs(r.density - true) <= r.error + 1e-9 * max(true, 1e-12) and r.error <= most * (1 + 1e-9) + 1e-15


def test_certified_density_of_many(spark):
    """Two million samples, compared with a sum over all of them at some targets."""
    samples = neighbours.checkpointed(spark.range(2_000_000).select((F.rand(1) * 40).alias("x"), (F.rand(2) * 10).alias("y"), F.rand(3).alias("z")))
    asked = cloud(spark, [[20.0, 5.0, 0.5], [0.0, 0.0, 0.0], [45.0, 5.0, 0.5]])
    got = {r.id: r for r in neighbours.certified_kde(samples, asked, 2.0, 1e-3).collect()}
    norm = (2 * math.pi) ** 1.5 * 8 * 2_000_000
    for t in asked.collect():
        d2 = (F.col("x") - t.x) ** 2 + (F.col("y") - t.y) ** 2 + (F.col("z") - t.z) ** 2
        true = samples.agg(F.sum(F.exp(-d2 / 8))).first()[0] / norm
        assert abs(got[t.id].density - true) <= got[t.id].error + 1e-12 and got[t.id].error <= 1e-3 / ((2 * math.pi) ** 1.5 * 8)


def test_certified_density_on_edge_cases(spark):
    one = cloud(spark, [[0, 0, 0]])
    assert [(r.density, r.error) for r in neighbours.certified_kde(one.limit(0), one, 1.0).collect()] == [(0.0, 0.0)]
    assert neighbours.certified_kde(one, one.limit(0), 1.0).count() == 0


@pytest.mark.parametrize("q", [0.0, 0.1, 0.5, 0.77, 1.0])
def test_quantile_is_exact(spark, q):
    rng = random.Random(12)
    values = [rng.choice([rng.gauss(0, 1), rng.gauss(0, 1e-9), 5.0, 1e12 * rng.random()]) for _ in range(9000)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,), (float("nan"),)], "z double")
    rank, held = q * (len(values) - 1), sorted(values)
    low = held[int(rank)]
    high = held[min(int(rank) + 1, len(held) - 1)]
    assert clouds.exact_quantile(df, "z", q) == low + (high - low) * (rank - int(rank))
    assert clouds.exact_quantile(df.limit(0), "z", q) is None


def test_layers_are_listed_once(spark):
    rng = random.Random(13)
    runs = [(rng.randrange(3), rng.randrange(3), a, a + rng.randrange(-1, 5)) for a in (rng.randrange(40) for _ in range(200))]
    got = [tuple(r) for r in meshes.layers(spark.createDataFrame(runs, "ix int, iy int, first int, last int")).collect()]
    assert len(got) == len(set(got)) and set(got) == {(x, y, z) for x, y, a, b in runs for z in range(a, b + 1)}
