"""Digital surface models: dsm(row, col, z)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wallscan.operators.clouds import one_row


def dsm(points: DataFrame, res: float, keep: str = "max", order: str | None = None) -> DataFrame:
    """The surface of each cell: 'max', 'min', 'mean', or 'running': (current + z) / 2 in the order of a column.

    'running' depends on the order of rows and gathers a cell's points, so it is for bounded cells."""
    low = points.agg(F.min("x").alias("x_low"), F.min("y").alias("y_low"))
    cells = one_row(points, low).select(F.floor((F.col("y") - F.col("y_low")) / res).cast("int").alias("row"), F.floor((F.col("x") - F.col("x_low")) / res).cast("int").alias("col"), "z", *([order] if order else []))
    if keep == "running":
        said = F.array_sort(F.collect_list(F.struct(order, "z")))
        return cells.groupBy("row", "col").agg(said.alias("s")).select("row", "col", F.aggregate(F.slice("s", F.lit(2), F.size("s")), F.element_at("s", 1).z, lambda a, x: (a + x.z) / 2).alias("z"))
    return cells.groupBy("row", "col").agg({"max": F.max, "min": F.min, "mean": F.avg}[keep]("z").alias("z"))


def fill(surface: DataFrame, rows: int, cols: int) -> DataFrame:
    """All cells of a grid; an empty one takes the mean of the filled cells of its 3 x 3 block.

    Cells beyond the border repeat the border, so border cells weigh more; fills read the original grid only."""
    spark = surface.sparkSession
    grid = spark.range(rows * cols).select((F.col("id") / cols).cast("int").alias("row"), (F.col("id") % cols).cast("int").alias("col"))
    holes = grid.join(surface, ["row", "col"], "left_anti")
    steps = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)))
    near = holes.select("row", "col", F.explode(steps).alias("s")).select(F.col("row").alias("r0"), F.col("col").alias("c0"), F.greatest(F.lit(0), F.least(F.lit(rows - 1), F.col("row") + F.col("s.a"))).alias("row"), F.greatest(F.lit(0), F.least(F.lit(cols - 1), F.col("col") + F.col("s.b"))).alias("col"))
    filled = near.join(surface, ["row", "col"], "left").groupBy("r0", "c0").agg(F.avg("z").alias("z"))
    return surface.select("row", "col", "z").unionByName(filled.select(F.col("r0").alias("row"), F.col("c0").alias("col"), "z"))


def to_mesh(surface: DataFrame, res: float, rows: int) -> DataFrame:
    """Two triangles for each cell with four filled corners: v0, v1, v2, a vertex id being row + col * rows."""
    s = surface.where("z is not null").select("row", "col")
    right, up, far = s.select("row", (F.col("col") - 1).alias("col")), s.select((F.col("row") - 1).alias("row"), "col"), s.select((F.col("row") - 1).alias("row"), (F.col("col") - 1).alias("col"))
    full = s.join(right, ["row", "col"], "left_semi").join(up, ["row", "col"], "left_semi").join(far, ["row", "col"], "left_semi")
    v = F.col("row") + F.col("col") * rows
    two = F.array(F.struct(v.alias("v0"), (v + rows).alias("v1"), (v + 1).alias("v2")), F.struct((v + rows).alias("v0"), (v + rows + 1).alias("v1"), (v + 1).alias("v2")))
    return full.select(F.inline(two))
