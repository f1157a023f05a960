"""Point clouds and OBJ meshes as text."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wallscan.sources.tiles import _filesystem

#: Columns of each text layout; "_" is skipped.
LAYOUTS = {"xyz": "x y z", "xyzrgb": "x y z r g b", "xyzrgbn": "x y z r g b _ nx ny nz"}


def read_points_txt(spark: SparkSession, path: str, layout: str = "xyzrgbn") -> DataFrame:
    """White-space separated numbers, a point a line; colours become 0..1. Lines with fewer or unreadable numbers are dropped."""
    names = LAYOUTS[layout].split()
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).select(parts.alias("p")).where(F.size("p") >= len(names))
    cols = [(F.try_element_at("p", F.lit(i + 1)).try_cast("double") / (255.0 if n in "rgb" else 1.0)).alias(n) for i, n in enumerate(names) if n != "_"]
    return rows.select(*cols).where("x is not null and y is not null and z is not null")


def write_points_txt(points: DataFrame, path: str) -> None:
    points.select(F.concat_ws(" ", *(F.col(d).cast("string") for d in "xyz"))).write.text(path)


def _numbers(value: str, kind: str) -> list[list[str]]:
    """The first three entries of each line of a kind."""
    lines = (line.lstrip(" ") for line in value.split("\n"))
    return [line.split()[1:4] for line in lines if line[:1] == kind and line[1:2].isspace()]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = [[len(_numbers(value, kind)) for value in batch.column("value").to_pylist()] for kind in "vf"]
        yield pa.RecordBatch.from_arrays([batch.column("path"), *(pa.array(c, pa.int64()) for c in n)], names=["path", "nv", "nf"])


def _lines_of(kind: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, value in zip(batch.column("path").to_pylist(), batch.column("value").to_pylist(), strict=True):
                found = _numbers(value, kind)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(found)), pa.array(np.arange(len(found))), pa.array(found, pa.list_(pa.string()))], names=["path", "rank", "p"])

    return run


def read_obj_tiles(spark: SparkSession, path: str, tiles: bool = True) -> tuple[DataFrame, DataFrame]:
    """OBJ tiles of a folder as one mesh: vertices(path, vertex_id, x, y, z) and faces(path, face_id, v0, v1, v2).

    Ids follow the lines of a tile; tiles follow each other by path. Faces name vertices of their own
    tile, or with tiles=False, where the files are the parts of one OBJ, of all of them. A file is read
    whole, so files, not the mesh, must fit a task."""
    files = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))
    counts = files.mapInArrow(_counted, "path string, nv long, nf long")
    before = Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)  # a row for each tile
    base = counts.select("path", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(b) for c, b in (("nv", "v_base"), ("nf", "f_base"))))
    rows = lambda kind: files.mapInArrow(_lines_of(kind), "path string, rank long, p array<string>").join(F.broadcast(base), "path")
    number = lambda i: F.element_at("p", i + 1).cast("double")
    vertices = rows("v").select("path", (F.col("rank") + F.col("v_base")).alias("vertex_id"), *(number(i).alias(d) for i, d in enumerate("xyz")))
    corner = lambda i: F.element_at(F.split(F.element_at("p", i + 1), "/"), 1).cast("long") - 1 + (F.col("v_base") if tiles else F.lit(0))
    faces = rows("f").select("path", (F.col("rank") + F.col("f_base")).alias("face_id"), *(corner(i).alias(f"v{i}") for i in (0, 1, 2)))
    return vertices, faces


def write_obj(vertices: DataFrame, faces: DataFrame, path: str) -> None:
    """v and f lines with compact ids (0, 1, ...) in order of id; the parts of the folder, by name, are one OBJ file."""
    v = vertices.select(F.lit(0).alias("o"), F.col("new_id").alias("i"), F.concat_ws(" ", F.lit("v"), *(F.col(d).cast("string") for d in "xyz")).alias("t"))
    f = faces.select(F.lit(1).alias("o"), F.col("face_id").alias("i"), F.concat_ws(" ", F.lit("f"), *((F.col(f"v{i}") + 1).cast("string") for i in (0, 1, 2))).alias("t"))
    v.unionByName(f).orderBy("o", "i").select("t").write.text(path)


def write_obj_tiles(vertices: DataFrame, faces: DataFrame, path: str) -> None:
    """tile-<name>.obj for each tile of faces(face_id, v0, v1, v2, tile); ids count within a tile. A tile's vertex ids must fit a task.

    Vertices and faces come in one shuffle by tile, and a task writes tile after tile as its sorted rows pass.
    path is a folder that driver and executors share; a repeated attempt writes the same files again."""
    corners = ("v0", "v1", "v2")
    used = faces.select("tile", F.explode(F.array(*corners)).alias("vertex_id")).distinct()
    v = used.join(vertices, "vertex_id").select("tile", F.lit(0).alias("o"), F.col("vertex_id").cast("long").alias("i"), *(F.lit(None).cast("long").alias(c) for c in corners), F.concat_ws(" ", F.lit("v"), *(F.col(d).cast("string") for d in "xyz")).alias("t"))
    f = faces.select("tile", F.lit(1).alias("o"), F.col("face_id").cast("long").alias("i"), *(F.col(c).cast("long").alias(c) for c in corners), F.lit(None).cast("string").alias("t"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = _filesystem(path)
        system.create_dir(folder, recursive=True)
        out, last, known, n = None, None, [], 0
        for batch in batches:
            tile, kind = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("tile", "o"))
            starts = [0, *(np.flatnonzero((tile[1:] != tile[:-1]) | (kind[1:] != kind[:-1])) + 1).tolist()] if len(tile) else []
            for a, b in zip(starts, [*starts[1:], len(tile)]):
                own = batch.slice(a, b - a)
                if tile[a] != last:
                    if out:
                        out.close()
                    out, last, known, n = system.open_output_stream(f"{folder}/tile-{tile[a]}.obj", compression=None), tile[a], [], n + 1
                column = lambda c: own.column(own.schema.get_field_index(c))
                if kind[a] == 0:
                    known.append(column("i").to_numpy())
                    lines = column("t").to_pylist()
                else:
                    known = [np.concatenate(known)]
                    lines = [f"f {x} {y} {z}" for x, y, z in zip(*((np.searchsorted(known[0], column(c).to_numpy()) + 1).tolist() for c in corners))]
                out.write(("\n".join(lines) + "\n").encode())
        if out:
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array([n])], names=["n"])

    v.unionByName(f).repartition("tile").sortWithinPartitions("tile", "o", "i").mapInArrow(write, "n long").agg(F.sum("n")).collect()
