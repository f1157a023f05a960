"""Density clusters of points, by cells that are clusters of their own where they are dense."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wallscan.operators.neighbours import box, checkpointed, cluster_stats, gap, least_labels, nearest, numbered, span, top_blocks

#: Pairs of boxes with no more pairs of points are decided point by point.
FEW_PAIRS = 256


def _half(dims: int, rings: int) -> list[tuple[int, ...]]:
    """Steps to the cells around, one of each opposite two, and to the cell itself."""
    zero = (0,) * dims
    return [s for s in product(range(-rings, rings + 1), repeat=dims) if s >= zero]


def _boxed(df: DataFrame, dims: Sequence[str], p: str, *keys: str) -> DataFrame:
    return df.select(*(F.col(k).alias(f"{p}_{k}") for k in keys), *(F.col(f"{e}_{d}").alias(f"{p}_{e}_{d}") for d in dims for e in ("lo", "hi")))


def _linked_units(points: DataFrame, cells: DataFrame, eps: float, width: float, min_samples: int, dims: Sequence[str]) -> DataFrame:
    """Pairs of units within eps: u, v, un, vn (points of either that are), u_dense, v_dense; several rows for a pair add up.

    A unit is a dense cell or a point of a sparse cell. Boxes decide most pairs: none within eps if their gap is wider,
    all if their span is not. Undecided boxes are halved in each dimension, and a dense pair is left as
    soon as one pair of its boxes is within eps, since one witness links two cells of cores. Boxes with few
    points meet point by point. Nothing lists the pairs of points of two crowds.
    """
    key, limit = [f"_c{d}" for d in dims], eps * eps
    dense = cells.where(F.col("n") >= min_samples).select(*key, F.col("head").alias("unit"), "n", *(f"{e}_{d}" for d in dims for e in ("lo", "hi")))
    single = points.where("not dense").select(*key, "unit", F.lit(1).cast("long").alias("n"), *(F.col(d).alias(f"{e}_{d}") for d in dims for e in ("lo", "hi")))
    units = checkpointed(dense.unionByName(single))
    steps = F.array(*(F.struct(*(F.lit(x).alias(d) for d, x in zip(dims, s, strict=True))) for s in _half(len(dims), int(math.sqrt(len(dims)) * (1 + 1e-8)) + 1)))
    a = _boxed(cells, dims, "a", *key).withColumn("_s", F.explode(steps))
    a = a.select("*", *((F.col(f"a_{k}") + F.col(f"_s.{d}")).alias(f"b_{k}") for k, d in zip(key, dims, strict=True))).drop("_s")
    near = a.join(_boxed(cells, dims, "b", *key), [f"b_{k}" for k in key]).where(gap(dims, "a", "b") <= limit).select(*(f"{p}_{k}" for p in "ab" for k in key))
    met = near.join(_boxed(units, dims, "a", *key, "unit", "n"), [f"a_{k}" for k in key]).join(_boxed(units, dims, "b", *key, "unit", "n"), [f"b_{k}" for k in key])
    apart = F.greatest(*(F.col(f"a_{k}") != F.col(f"b_{k}") for k in key), F.lit(False))
    met = met.where((apart | (F.col("a_unit") < F.col("b_unit"))) & (gap(dims, "a", "b") <= limit)).withColumn("sure", span(dims, "a", "b") <= limit)
    met = checkpointed(met.select(F.col("a_unit").alias("u"), F.col("b_unit").alias("v"), F.col("a_n").alias("un"), F.col("b_n").alias("vn"), "sure", *(F.col(f"a_{k}").alias(f"u{k}") for k in key), *(F.col(f"b_{k}").alias(f"v{k}") for k in key)))
    found, undecided, level = met.where("sure").select("u", "v", "un", "vn"), met.where("not sure").drop("sure"), 0
    while not undecided.isEmpty():
        used = undecided.select(F.col("u").alias("unit")).unionByName(undecided.select(F.col("v").alias("unit"))).distinct()
        inner = points.join(used, "unit", "left_semi")
        at = lambda n: [F.floor(F.col(d) / (width / 2**n)).alias(f"_c{d}") for d in dims]
        small = (F.col("un") * F.col("vn") <= FEW_PAIRS) | F.lit(level >= 40)  # by then boxes are as fine as numbers
        few = undecided.where(small)
        here = inner.select("unit", *at(level), *dims)
        side = lambda df, p, q: df.select(F.col("unit").alias(p), *(F.col(k).alias(f"{p}{k}") for k in key), *(F.col(d).alias(f"{q}_{e}_{d}") for d in dims for e in ("lo", "hi")))
        pairs = few.join(side(here, "u", "a"), ["u", *(f"u{k}" for k in key)]).join(side(here, "v", "b"), ["v", *(f"v{k}" for k in key)]).where(gap(dims, "a", "b") <= limit)
        # Of two units one is a point, or both are cells of cores, where any number above none will do.
        close = pairs.groupBy("u", "v").agg(F.count("*").alias("vn")).select("u", "v", F.col("vn").alias("un"), "vn")
        rest = undecided.where(~small)
        nodes = inner.select("unit", *at(level + 1), *dims).groupBy("unit", *key).agg(F.count("*").alias("n"), *box(dims))
        child = lambda p, q: _boxed(nodes, dims, q, "unit", "n", *key).withColumnRenamed(f"{q}_unit", p).withColumnsRenamed({f"{q}_{k}": f"{p}n{k}" for k in key}).select("*", *(F.shiftright(f"{p}n{k}", 1).alias(f"{p}{k}") for k in key))
        finer = rest.select("u", "v", *(f"{p}{k}" for p in "uv" for k in key)).join(child("u", "a"), ["u", *(f"u{k}" for k in key)]).join(child("v", "b"), ["v", *(f"v{k}" for k in key)])
        finer = finer.where(gap(dims, "a", "b") <= limit).select("u", "v", F.col("a_n").alias("un"), F.col("b_n").alias("vn"), (span(dims, "a", "b") <= limit).alias("sure"), *(F.col(f"{p}n{k}").alias(f"{p}{k}") for p in "uv" for k in key))
        finer = checkpointed(finer)
        now = checkpointed(close.unionByName(finer.where("sure").select("u", "v", "un", "vn")))
        found = found.unionByName(now)
        crowds = now.join(units.where("n > 1").select(F.col("unit").alias("u")), "u", "left_semi").join(units.where("n > 1").select(F.col("unit").alias("v")), "v", "left_semi").select("u", "v").distinct()
        undecided = checkpointed(finer.where("not sure").drop("sure").join(crowds, ["u", "v"], "left_anti"))
        level += 1
    return found


def dbscan_points(points: DataFrame, eps: float, min_samples: int, dims: Sequence[str] = "xyz") -> DataFrame:
    """Euclidean DBSCAN labels (id, label) of points(id, x, y, z).

    A core has min_samples points within eps, itself included; clusters are the components of cores within
    eps of each other; a border point takes the least label next to it; labels count from 0 by least
    core id; the rest is noise, -1. Points without a coordinate are noise.

    Cells are eps / sqrt(dimensions) wide, so all points of a cell are within eps: a cell with min_samples
    points is all core and one cluster. Work follows the points, however many share a cell, and no list
    of neighbours is made.
    """
    if eps <= 0:
        raise ValueError("eps must be positive")
    width = eps / math.sqrt(len(dims)) * (1 - 1e-9)
    key = [f"_c{d}" for d in dims]
    placed = points.select("id", *(F.col(d).cast("double").alias(d) for d in dims)).dropna(subset=list(dims)).select("*", *(F.floor(F.col(d) / width).alias(f"_c{d}") for d in dims))
    cells = checkpointed(placed.groupBy(*key).agg(F.count("*").alias("n"), F.min("id").alias("head"), *box(dims)))
    dense = F.col("n") >= min_samples
    placed = checkpointed(placed.join(cells.select(*key, "n", "head"), key).select("id", *dims, *key, dense.alias("dense"), F.when(dense, F.col("head")).otherwise(F.col("id")).alias("unit")))
    found = _linked_units(placed, cells, eps, width, min_samples, dims)
    links = checkpointed(found.select("u", "v", "vn").unionByName(found.select(F.col("v").alias("u"), F.col("u").alias("v"), F.col("un").alias("vn"))).groupBy("u", "v").agg(F.sum("vn").alias("n")))
    crowd = cells.where(dense).select(F.col("head").alias("core"))
    core = checkpointed(crowd.unionByName(links.groupBy("u").agg(F.sum("n").alias("n")).where(F.col("n") + 1 >= min_samples).select(F.col("u").alias("core"))).distinct())
    of = lambda side: core.select(F.col("core").alias(side))
    edges = links.where("u < v").join(of("u"), "u", "left_semi").join(of("v"), "v", "left_semi").select(F.col("u").alias("a"), F.col("v").alias("b"))
    root = core.join(least_labels(edges), F.col("core") == F.col("node"), "left").select("core", F.coalesce("label", "core").alias("root"))
    number = numbered(root.select("root").distinct(), "root", "label").withColumn("label", F.col("label").cast("int"))
    labelled = checkpointed(root.join(number, "root").select(F.col("core").alias("unit"), "label"))
    border = links.join(of("u"), "u", "left_anti").join(labelled.withColumnRenamed("unit", "v"), "v").groupBy("u").agg(F.min("label").alias("label")).withColumnRenamed("u", "unit")
    known = placed.select("id", "unit").join(labelled.unionByName(border), "unit").select("id", "label")
    return points.select("id").join(known, "id", "left").select("id", F.coalesce("label", F.lit(-1)).alias("label"))


def cluster_sampled(points: DataFrame, sample: DataFrame, eps: float, min_samples: int, dims: Sequence[str] = "xyz") -> DataFrame:
    """Clusters a sample, then gives each point the label of its nearest sampled point."""
    labels = dbscan_points(sample, eps, min_samples, dims)
    near = nearest(points, sample, 1, dims)
    return near.join(labels.withColumnRenamed("id", "target"), "target").select("id", "label")


def hazard_blocks(voxels: DataFrame, sample: DataFrame, meta: DataFrame, eps: float, min_samples: int, size: float, k: int = 10) -> DataFrame:
    """The k largest blocks of voxels(id, ix, iy, iz and their centres x, y, z), clustered through a sample: label, n, volume, cx, cy, cz."""
    labels = cluster_sampled(voxels, sample, eps, min_samples)
    return top_blocks(cluster_stats(labels.join(voxels, "id"), meta, size), k)
