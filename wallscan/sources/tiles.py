"""Tiles of a tiled scene: binary files of a magic, a JSON header and float32 buffers."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAGIC = b"3MXBO"
NODE = "struct<id:string,resource_start:long,resource_end:long,parent:string>"


def read_3mx_tiles(spark: SparkSession, folder: str) -> DataFrame:
    """path, header (JSON text) and buffer of each *.3mxb below a folder; files without the magic are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.3mxb").load(folder).select("path", "content")

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, raw in zip(batch["path"], batch["content"], strict=True):
                if raw[:5] == MAGIC and len(raw) >= 9:
                    size = struct.unpack("<I", raw[5:9])[0]
                    rows.append((path, raw[9:size].decode("utf-8", "replace"), raw[size:]))
            yield pd.DataFrame(rows, columns=["path", "header", "buffer"])

    return files.mapInPandas(split, "path string, header string, buffer binary")


def _filesystem(path: str):
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)


def read_3mx_headers(spark: SparkSession, folder: str) -> DataFrame:
    """path, header (JSON text), buffer_start and length of each *.3mxb below a folder, of whatever size; only headers are read.

    Files without the magic are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.3mxb").load(folder).select("path", "length")

    def heads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, length in zip(batch["path"], batch["length"], strict=True):
                system, at = _filesystem(path)
                with system.open_input_file(at) as file:
                    raw = file.read(9)
                    if raw[:5] == MAGIC and len(raw) == 9:
                        size = struct.unpack("<I", raw[5:9])[0]
                        rows.append((path, file.read(max(0, size - 9)).decode("utf-8", "replace"), size, length))
            yield pd.DataFrame(rows, columns=["path", "header", "buffer_start", "length"])

    return files.mapInPandas(heads, "path string, header string, buffer_start long, length long")


def ranged_tile_points(headers: DataFrame, piece: int = 12 << 18) -> DataFrame:
    """x, y, z of each node, as tile_points gives them, from headers of read_3mx_headers; columns added to these come along.

    A node's bytes are read by ranges of `piece` bytes, each a row of its own that any task may take, so neither a
    tile nor a node must fit a task. Rows of ranges are few and small, so their number of tasks is given: by size
    they would all be one task's. A range comes from Python as one row and is listed after, so paths and names are not
    repeated for each point there. Bytes beyond the file's end are not there; nodes of under 12 bytes are skipped."""
    if piece % 12:
        raise ValueError("a piece holds whole points of 12 bytes")
    more = [c for c in headers.columns if c not in ("path", "header", "buffer_start", "length")]
    nodes = headers.select("path", *more, "buffer_start", "length", F.explode(F.from_json("header", f"nodes array<{NODE}>").nodes).alias("n"))
    nodes = nodes.select("path", *more, F.col("n.id").alias("node"), (F.col("buffer_start") + F.col("n.resource_start")).alias("start"), F.least(F.col("buffer_start") + F.col("n.resource_end"), "length").alias("end")).where("end - start >= 12")
    parts = nodes.select("*", F.explode(F.sequence("start", F.col("end") - 1, F.lit(piece).cast("long"))).alias("at"))
    parts = parts.select("path", "node", *more, ((F.col("at") - F.col("start")) / 12).cast("long").alias("first"), "at", F.expr(f"least(end - at, {piece}L) div 12").alias("n"))
    parts = parts.repartition(int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path", "at")

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, (path, at, n) in enumerate(zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("path", "at", "n")), strict=True)):
                system, place = _filesystem(path)
                with system.open_input_file(place) as file:
                    xyz = np.frombuffer(file.read_at(12 * n, at), "<f4").reshape(-1, 3)
                points = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(xyz[:, d]), from_pandas=True) for d in range(3)], names=list("xyz"))  # NaN is null, as in tile_points
                yield pa.RecordBatch.from_arrays([*batch.slice(row, 1).columns, pa.ListArray.from_arrays(pa.array([0, len(xyz)], pa.int32()), points)], names=[*batch.schema.names, "points"])

    point = T.ArrayType(T.StructType([T.StructField(d, T.FloatType()) for d in "xyz"]))
    read = parts.mapInArrow(unpack, T.StructType([*parts.schema, T.StructField("points", point)]))
    listed = read.select("path", "node", *more, "first", F.posexplode("points").alias("_i", "_p"))
    return listed.select("path", "node", (F.col("first") + F.col("_i")).alias("i"), *(F.col(f"_p.{d}").alias(d) for d in "xyz"), *more)


def write_3mx_tiles(points: DataFrame, folder: str) -> None:
    """tile-<n>.3mxb for each tile of points(tile int, node, parent, point_id, x, y, z): nodes by name, points of a node by point_id.

    Sizes of nodes are counted first and become the header, a row that sorts before the tile's points; a task then
    writes tile after tile as its sorted rows pass, and holds one batch. folder is one that driver and executors
    share; a repeated attempt writes the same file again."""
    sizes = points.groupBy("tile", "node").agg((12 * F.count("*")).alias("bytes"), F.min("parent").alias("parent"))
    sizes = sizes.withColumn("resource_end", F.sum("bytes").over(Window.partitionBy("tile").orderBy("node"))).withColumn("resource_start", F.col("resource_end") - F.col("bytes"))
    node = F.struct(F.col("node").alias("id"), "resource_start", "resource_end", "parent")
    heads = sizes.groupBy("tile").agg(F.to_json(F.struct(F.array_sort(F.collect_list(node)).alias("nodes"))).alias("header"))
    rows = points.select("tile", "node", "point_id", *(F.col(c).cast("double").alias(c) for c in "xyz"), F.lit(None).cast("string").alias("header"))
    rows = heads.select("tile", *(F.lit(None).cast(t).alias(c) for c, t in rows.dtypes if c not in ("tile", "header")), "header").unionByName(rows)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = _filesystem(folder)
        system.create_dir(path, recursive=True)
        out, n = None, 0
        for batch in batches:
            tile, header, *xyz = (batch.column(batch.schema.get_field_index(c)) for c in ("tile", "header", *"xyz"))
            xyz = np.stack([c.to_numpy(zero_copy_only=False) for c in xyz], 1).astype("<f4", copy=False)
            begins = np.flatnonzero(header.is_valid().to_numpy(zero_copy_only=False)).tolist()  # a new tile begins
            for at, end in zip([-1, *begins], [*begins, len(xyz)], strict=True):
                if at >= 0:
                    if out:
                        out.close()
                    out = system.open_output_stream(f"{path}/tile-{tile[at]}.3mxb", compression=None)
                    head = header[at].as_py().encode()
                    out.write(MAGIC + struct.pack("<I", 9 + len(head)) + head)
                    n += 1
                if end > at + 1:
                    out.write(np.ascontiguousarray(xyz[at + 1 : end]))
        if out:
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    dealt = rows.repartition("tile").sortWithinPartitions("tile", F.col("header").isNull(), "node", "point_id", "x", "y", "z")
    dealt.select("tile", "header", *(F.col(d).cast("float").alias(d) for d in "xyz")).mapInArrow(write, "n long").agg(F.sum("n")).collect()


def tile_nodes(tiles: DataFrame) -> DataFrame:
    """The nodes of each tile's header; a node is a child when it names a parent."""
    nodes = tiles.select("path", F.explode(F.from_json("header", f"nodes array<{NODE}>").nodes).alias("n"))
    return nodes.select("path", "n.*", F.when(F.col("n.parent").isNull(), "parent").otherwise("child").alias("kind"))


def tile_points(tiles: DataFrame) -> DataFrame:
    """x, y, z of each node's bytes [resource_start, resource_end); pieces of under 12 bytes are skipped."""
    parts = tiles.select("path", "buffer", F.explode(F.from_json("header", f"nodes array<{NODE}>").nodes).alias("n"))
    parts = parts.select("path", F.col("n.id").alias("node"), F.expr("substring(buffer, cast(n.resource_start as int) + 1, cast(n.resource_end - n.resource_start as int))").alias("raw")).where("octet_length(raw) >= 12")

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, node, raw in zip(batch["path"], batch["node"], batch["raw"], strict=True):
                xyz = np.frombuffer(raw[: len(raw) // 12 * 12], "<f4").reshape(-1, 3)
                yield pd.DataFrame({"path": path, "node": node, "i": np.arange(len(xyz), dtype=np.int32), "x": xyz[:, 0], "y": xyz[:, 1], "z": xyz[:, 2]})

    return parts.mapInPandas(unpack, "path string, node string, i int, x float, y float, z float")
