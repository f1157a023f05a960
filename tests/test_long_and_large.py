"""Slices of any length, boxes of any size, tiles in ranges, slices in pieces, heights by version."""

import itertools
import math
import os
import random

import pytest
from pyspark.sql import functions as F

from wallscan.operators import chains, neighbours, profiles
from wallscan.plans.fixtures import Fixtures
from wallscan.sources import store, tiles
from wallscan.streaming.recognition import _wait, read_recognised, recognise_pieces_stream, write_heights_stream

SEGMENT = "k long, face_id long, x1 double, y1 double, z1 double, x2 double, y2 double, z2 double, u1 double, v1 double, u2 double, v2 double"


def _segments(spark, slices: dict[int, list[tuple[tuple, tuple]]], seed=1):
    """Segments between points (x, z) of each slice, in any order and either way round."""
    rng, rows = random.Random(seed), []
    for k, pairs in slices.items():
        for i, (p, q) in enumerate(pairs):
            p, q = (p, q) if rng.random() < 0.5 else (q, p)
            rows.append((k, i, p[0], 0.0, p[1], q[0], 0.0, q[1], p[0], p[1], q[0], q[1]))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, SEGMENT)


def _line(points):
    return list(itertools.pairwise(points))


def _shapes():
    def ring(n, x):
        return [(x + math.cos(6.283185 * i / n), math.sin(6.283185 * i / n)) for i in range(n)]

    wave = [(math.sin(i), -float(i)) for i in range(37)]
    hump = [(float(i), -abs(i - 9.0)) for i in range(30)]  # highest inside, lowest at an end
    return {
        0: _line(wave),
        1: _line(hump) + _line([(p[0] + 100, p[1]) for p in wave]),
        2: _line([*(r := ring(11, 0.0)), r[0]]) + _line([*(s := ring(8, 50.0)), s[0]]),
        3: [((0.0, 0.0), (0.0, 1.0)), ((0.0, 1.0), (1.0, 2.0)), ((0.0, 1.0), (-1.0, 3.0)), ((5.0, 5.0), (5.0, 5.0))],  # branches, and a segment of no length
        4: [((0.0, 0.0), (1.0, 0.0)), ((1.0, 0.0), (2.0, 0.0))],  # level: highest and lowest are one node
        5: [((0.0, 0.0), (0.0, 1.0))] * 3,
    }


def _same(a, b):
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_long_components_as_the_walk(spark):
    s = _segments(spark, _shapes())
    _same(chains.long_components(s), profiles.components(s))
    assert chains.long_components(s.where("false")).count() == 0


def test_long_order_as_the_walk(spark):
    paths = neighbours.checkpointed(profiles.components(_segments(spark, _shapes())))
    got = chains.long_order(paths)
    _same(got, profiles.order_path(paths))
    assert got.where("k = 4").count() == 0 and got.where("k = 2").count() > 5
    assert chains.long_order(paths.where("false")).count() == 0


def test_one_slice_of_many_nodes(spark):
    n = 100_000
    i = F.col("id").cast("double")
    s = spark.range(n).select(F.lit(0).cast("long").alias("k"), F.lit(0).alias("path_id"), *(v.alias(f"{d}{e}") for e, j in ((1, i), (2, i + 1)) for d, v in zip("xyzuv", (F.sin(j) * 3, F.lit(0.0), -j, F.sin(j) * 3, -j))))
    got = chains.long_order(s)
    assert got.agg(F.count("*"), F.min("ord"), F.max("ord"), F.max(F.abs(F.col("v") + F.col("ord")))).first()[:] == (n + 1, 0, n, 0.0)


def test_rings_without_a_root_are_left_out(spark):
    arcs = spark.createDataFrame([(1, None), (2, 1), (3, 2), (7, 8), (8, 7)], "id long, up long")
    assert sorted(map(tuple, chains.list_ranks(arcs).collect())) == [(1, 1, 1), (2, 1, 2), (3, 1, 3)]


BOX = "id long, x_lo double, y_lo double, x_hi double, y_hi double"


def test_boxes_of_all_sizes(spark):
    rng = random.Random(3)

    def boxes(n, first):
        for i in range(n):
            x, y, w, h = rng.uniform(-50, 50), rng.uniform(-50, 50), 2.0 ** rng.uniform(-12, 6), 2.0 ** rng.uniform(-12, 6)
            yield first + i, x, y, x + w * (i % 7 > 0), y + h * (i % 5 > 0)

    a = [*boxes(300, 0), (900, 0.0, 0.0, 1.0, 1.0), (901, -1e6, -1e6, 1e6, 1e6), (902, None, 0.0, 1.0, 1.0), (903, 2.0, 0.0, 1.0, 1.0), (904, 0.0, 0.0, float("inf"), 1.0), (905, float("nan"), 0.0, 1.0, 1.0)]
    b = [*boxes(300, 1000), (1900, 1.0, 1.0, 2.0, 2.0), (1901, 1.0, 0.0, 1.0, 9.0), (1902, 0.0, 0.0, 0.0, 0.0)]
    good = lambda r: None not in r and all(map(math.isfinite, r)) and r[1] <= r[3] and r[2] <= r[4]
    want = sorted((p[0], q[0]) for p in a if good(p) for q in b if good(q) and p[1] <= q[3] and q[1] <= p[3] and p[2] <= q[4] and q[2] <= p[4])
    frame = lambda rows: spark.createDataFrame(rows, BOX)
    assert sorted(map(tuple, neighbours.bbox_overlap(frame(a), frame(b)).collect())) == want and len(want) > 300
    assert neighbours.bbox_overlap(frame(a).where("false"), frame(b)).count() == 0


def test_a_giant_among_small_boxes(spark):
    """A box over all others lies in four cells, and every other box in eight or fewer."""
    n = 40_000
    small = spark.range(n).select("id", *(F.expr(e).alias(c) for c, e in (("x_lo", "(id % 200) * 1.0D"), ("y_lo", "(id div 200) * 1.0D"), ("x_hi", "(id % 200) + 0.4D"), ("y_hi", "(id div 200) + 0.4D"))))
    every = small.unionByName(spark.createDataFrame([(n, 0.0, 0.0, 200.0, 200.0)], BOX))
    pairs = neighbours.bbox_overlap(every, every)
    assert pairs.agg(F.count("*"), F.count(F.when(F.col("a") < F.col("b"), 1))).first()[:] == (3 * n + 1, n)


@pytest.mark.parametrize("piece", [12, 36, 12 << 18])
def test_tiles_by_ranges(spark, tmp_path, piece):
    points = spark.range(500).select((F.col("id") % 3).cast("int").alias("tile"), F.concat(F.lit("n"), F.col("id") % 4).alias("node"), F.when(F.col("id") % 4 > 0, "n0").alias("parent"), (500 - F.col("id")).alias("point_id"), *(F.col("id").cast("double").alias(d) for d in "xyz"))
    folder = str(tmp_path / "scene")
    tiles.write_3mx_tiles(points, folder)
    tiles.write_3mx_tiles(points, folder)  # a repeated attempt
    (tmp_path / "scene" / "no.3mxb").write_bytes(b"3M")
    whole, heads = tiles.read_3mx_tiles(spark, folder), tiles.read_3mx_headers(spark, folder)
    assert sorted(map(tuple, whole.select("path", "header").collect())) == sorted(map(tuple, heads.select("path", "header").collect()))
    _same(tiles.ranged_tile_points(heads, piece), tiles.tile_points(whole))
    assert heads.count() == 3 and tiles.ranged_tile_points(heads, piece).count() == 500


def test_slices_in_pieces(spark, tmp_path):
    segments = Fixtures(spark, "/root/testdata/sf0.001").segments(gaps=True).where("k < 40").cache()
    pieces = segments.join(segments.groupBy("k").agg(F.count("*").alias("n_slice")), "k").cache()
    arrived, out, marks = (str(tmp_path / n) for n in ("arrived", "out", "marks"))
    for part in (2, 0, 1):
        pieces.where(F.col("face_id") % 3 == part).coalesce(1).write.mode("append").parquet(arrived)
        recognise_pieces_stream(spark.readStream.schema(pieces.schema).parquet(arrived), out, marks).awaitTermination()
    want = [tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in profiles.recognise(segments).collect()]
    got = [tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in read_recognised(spark, out).collect()]
    assert sorted(got) == sorted(want) and got
    assert sum(r["count"] for r in store.read_results(spark, out).groupBy("k").agg(F.countDistinct("batch").alias("count")).collect()) == segments.select("k").distinct().count()


class State:
    """What applyInPandasWithState hands over."""

    def __init__(self):
        self.held, self.hasTimedOut, self.wait = None, False, None

    exists = property(lambda self: self.held is not None)
    get = property(lambda self: self.held)

    def update(self, held):
        self.held = held

    def remove(self):
        self.held = None

    def setTimeoutDuration(self, wait):
        self.wait = wait


def test_a_slice_that_stays_short_is_passed_on_as_it_is():
    import pandas as pd

    state, step = State(), _wait(1000)
    rows = lambda *ids: iter([pd.DataFrame({"k": 5, "face_id": list(ids), "n_slice": 3})])
    assert list(step((5,), rows(1), state)) == [] and state.wait == 1000
    state.hasTimedOut = True
    assert [list(d["face_id"]) for d in step((5,), iter([]), state)] == [[1]] and state.exists
    state.hasTimedOut = False
    assert [list(d["face_id"]) for d in step((5,), rows(2, 3), state)] == [[1, 2, 3]] and not state.exists


def test_a_batch_writes_only_the_faces_it_changed(spark, tmp_path):
    arrived, out, marks = (str(tmp_path / n) for n in ("arrived", "out", "marks"))
    for rows in ([(1, 2.0), (2, 7.0), (None, 1.0)], [(1, 5.0), (3, 1.0)], [(2, 6.0)]):
        spark.createDataFrame(rows, "face_id long, height double").write.mode("append").parquet(arrived)
        write_heights_stream(spark.readStream.schema("face_id long, height double").parquet(arrived), out, marks).awaitTermination()
    assert [r["count"] for r in store.read_results(spark, out).groupBy("batch").count().orderBy("batch").collect()] == [2, 2, 1]
    want = [(1, 5.0, 2), (2, 7.0, 2), (3, 1.0, 1)]
    assert sorted(map(tuple, store.read_latest(spark, out, "face_id").collect())) == want
    store.compact(spark, out, str(tmp_path / "less"), "face_id")
    assert sorted(map(tuple, store.read_latest(spark, str(tmp_path / "less"), "face_id").collect())) == want and os.listdir(tmp_path / "less") == ["batch=0"]
