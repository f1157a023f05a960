"""Work that grows no faster than the input: the cut, boxes of one shape, lists, densities."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from wallscan.operators import chains, densities, neighbours, planes, profiles
from wallscan.plans.fixtures import START, STEP, Fixtures

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("gaps", [False, True])
def test_corners_of_cells_as_joined(spark, gaps):
    f = Fixtures(spark, SF)
    want = planes.triangles(f.faces(gaps), f.vertices)
    assert f.tri(gaps).exceptAll(want).isEmpty() and want.exceptAll(f.tri(gaps)).isEmpty() and want.count() > 100


def test_faces_narrower_than_a_step_meet_no_plane(spark):
    """A face is sent to the planes that it meets, and to none beside them."""
    f = Fixtures(spark, SF)
    arc, tri = f.arc5, f.tri()
    for i in (0, 1, 2):  # narrow faces: their corners drawn to the first
        tri = tri.withColumn(f"x{i}", F.col("x0") + (F.col(f"x{i}") - F.col("x0")) * 0.01).withColumn(f"y{i}", F.col("y0") + (F.col(f"y{i}") - F.col("y0")) * 0.01)
    laid = planes.planes(arc, START, step)
    sent, hit = planes._candidates(tri, arc, START, step).count(), planes.cut(tri, laid, arc, START, step)
    every = planes.segments_of(tri.crossJoin(laid))
    assert hit.exceptAll(every).isEmpty() and every.exceptAll(hit).isEmpty()
    assert sent <= 1.05 * hit.count() + 2


def _sheet(spark, n, seed):
    """Places on a curved sheet, half of them in a small part of it."""
    wide = F.when(F.col("id") % 2 == 0, F.lit(1.0)).otherwise(F.lit(0.02))
    t = spark.range(n).select("id", (F.rand(seed) * wide).alias("t"), (F.rand(seed + 1) * 60 * wide).alias("z"))
    return neighbours.checkpointed(t.select("id", (20 * F.cos("t")).alias("x"), (20 * F.sin("t")).alias("y"), "z"))


def test_densities_by_polynomials(spark):
    """Certified and plain densities of many samples at many targets: true within their bounds, and no target lists the boxes it meets."""
    samples, asked, h = _sheet(spark, 60_000, 1), _sheet(spark, 20_000, 3), 2.0
    sure, plain = neighbours.certified_kde(samples, asked, h), neighbours.kde(samples, asked, h)
    assert "collect_list" not in sure._jdf.queryExecution().toString()
    got, close = {r.id: r for r in sure.collect()}, {r.id: r.density for r in plain.collect()}
    assert len(got) == len(close) == 20_000
    at, peak = np.array(samples.select(*"xyz").collect()), 1 / ((2 * math.pi) ** 1.5 * h**3)
    for t in asked.where("id % 400 < 2").collect():
        true = float(np.exp(-((at - np.array(t[1:])) ** 2).sum(1) / (2 * h * h)).mean()) * peak
        assert abs(got[t.id].density - true) <= got[t.id].error <= 1e-3 * peak
        assert abs(close[t.id] - true) <= 1e-13 * peak


def test_order_of_polynomials_is_proven():
    """The bound of what Chebyshev points leave out holds for pairs of cells, and shrinks with their number."""
    rng = np.random.default_rng(5)
    for q in (3, 5, 7, 10):
        held = densities._Held(q, 0, 9.0)
        places = rng.random((50, 3))
        held.add((1, 0, -1), [50], [True], [places.tobytes()])
        held.settle()
        at = rng.random((200, 3))
        total, n, error = held.density((0, 0, 0), at)
        true = densities._direct(at, places + np.array([1, 0, -1]))
        assert n == 50 and np.abs(total - true).max() <= error and error == 50 * densities._error(q)
    assert densities.order(1e-3) == 7 and densities.order(0.0) == 0


def test_long_boxes_of_one_shape_meet_few(spark):
    """Boxes a thousand times as high as wide, side by side: a box meets few others in its cells, not all of its row."""
    boxes = spark.range(20_000).select("id", *(F.expr(e).alias(c) for c, e in (("x_lo", "id * 0.001D"), ("y_lo", "0.1D"), ("x_hi", "id * 0.001D + 0.00105D"), ("y_hi", "1.1D"))))
    pairs = neighbours.bbox_overlap(boxes, boxes)
    assert pairs.count() == 20_000 + 2 * 19_999
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    unit = min(float(x) for x in re.findall(r"x_lo#\d+L? / ([0-9.E-]+)\)", plan))
    assert unit < 0.002  # the width of its cells follows that of the boxes


def test_components_across_pieces(spark, monkeypatch):
    """Slices in pieces of a few segments are joined as if whole; whole ones leave nothing to contract."""
    seen = []
    monkeypatch.setattr(chains, "least_labels", lambda edges: (seen.append(edges.where("a != b").count()), neighbours.least_labels(edges))[1])
    segments = neighbours.checkpointed(Fixtures(spark, SF).segments(gaps=True).where("k % 40 = 0"))
    want = sorted(map(tuple, profiles.components(segments).collect()))
    assert sorted(map(tuple, chains.long_components(segments).collect())) == want
    monkeypatch.setattr(chains, "PIECE", 3)
    assert sorted(map(tuple, chains.long_components(segments).collect())) == want
    assert seen[0] < len(want) / 10 and seen[1] > seen[0]
