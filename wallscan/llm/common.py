"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local master, where all is one machine, gets a new one if that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='spark-wallscan-')}"
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/wallscan/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as a table in the shared folder and read again: cuts lineage and survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def without(documents: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of documents whose doc_id isn't in gone(doc_id); columns of any name stay in their order, and so do rows with a null doc_id."""
    gone = gone.select(F.col("doc_id").alias("_gone_id"))
    return documents.join(gone, documents["doc_id"] == gone["_gone_id"], "left_anti")


def placed(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """rows with pos, the place from 0 within their group in this order, and n, the group's size; a null group has no place.

    Rows are range partitioned by group, order and, where all that is equal, by a number of their own, so a
    group or a key with a third of all rows spreads over many tasks; places are counted within a partition
    and offset by the counts of the partitions before it."""
    by = [group, *order, "_own"]
    rows = stored(rows.withColumn("_own", F.monotonically_increasing_id()), "to-place")
    dealt = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()).drop("_own")
    dealt = stored(dealt, "in-order")
    sizes = dealt.groupBy(group, "_part").agg(F.count("*").alias("_size"), F.min("_at").alias("_first"))
    whole = Window.partitionBy(group)  # over a row for each partition
    sizes = sizes.select(group, "_part", "_first", (F.sum("_size").over(whole.orderBy("_part")) - F.col("_size")).alias("_before"), F.sum("_size").over(whole).alias("n"))
    return dealt.join(sizes, [group, "_part"]).withColumn("pos", F.col("_at") - F.col("_first") + F.col("_before")).drop("_part", "_at", "_first", "_before")


def named(column: str) -> Column:
    """The column of exactly this name, dots and backticks included."""
    return F.col("`" + column.replace("`", "``") + "`")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of a string column; nulls count as empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if len(column) else np.empty(0, np.uint8)
    return data, (offsets - offsets[0] if len(column) else np.zeros(1, np.int64))


def blocks(batch: pa.RecordBatch, column: str = "text", limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in runs of at most `limit` bytes of text (a longer text comes alone)."""
    _, offsets = utf8(batch.column(batch.schema.get_field_index(column)))
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield batch.slice(lo, hi - lo)
        lo = hi


def batch_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(columns, schema.types, strict=True)], schema=schema)


def lists(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from flat values and offsets."""
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, kind))
