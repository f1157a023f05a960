"""Arc settings, slice stores and result stores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BAND = 64
#: Up to so many keys are sent to every task.
MOST_KEYS = 1_000_000


def arc_of(config: DataFrame) -> DataFrame:
    """cx, cy, radius, angle_min, angle_max, z_min, z_max, arc_length of a settings table; z_range or z_min and z_max, centres of two or three numbers."""
    have = set(config.columns)
    z = lambda i, n: F.coalesce(*([F.element_at("z_range", i)] if "z_range" in have else []), *([F.col(n)] if n in have else []), F.lit(None).cast("double"))
    return config.select(F.element_at("center", 1).cast("double").alias("cx"), F.element_at("center", 2).cast("double").alias("cy"), "radius", "angle_min", "angle_max", z(1, "z_min").alias("z_min"), z(2, "z_max").alias("z_max"), (F.col("radius") * (F.col("angle_max") - F.col("angle_min"))).alias("arc_length"))


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    return arc_of(spark.read.json(path, multiLine=True))


def write_arc(arc: DataFrame, path: str) -> None:
    arc.select(F.array("cx", "cy").alias("center"), "radius", "angle_min", "angle_max", F.array("z_min", "z_max").alias("z_range")).coalesce(1).write.mode("overwrite").json(path)


def write_slices(segments: DataFrame, path: str) -> None:
    """Slices as Parquet in bands of planes: a read by key opens its bands only."""
    segments.withColumn("band", F.floor(F.col("k") / BAND).cast("int")).repartition("band").sortWithinPartitions("k").write.mode("overwrite").partitionBy("band").parquet(path)


def read_slices(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """Slices whose k is in keys(k)."""
    wanted = keys.select("k", F.floor(F.col("k") / BAND).cast("int").alias("band")).distinct()
    if wanted.limit(MOST_KEYS + 1).count() <= MOST_KEYS:
        wanted = F.broadcast(wanted)
    return spark.read.parquet(path).join(wanted, ["band", "k"], "left_semi").drop("band")


def append_results(results: DataFrame, path: str, batch: int) -> None:
    """Writes a batch; writing it again replaces it, so a repeated batch counts once."""
    results.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_latest(spark: SparkSession, path: str, *keys: str) -> DataFrame:
    """The row of the newest batch for each key of a result store to which batches add only what they changed.

    A partial aggregation keeps one row for each key, so old versions cost a scan and are not shuffled."""
    every = read_results(spark, path)
    rest = [c for c in every.columns if c not in (*keys, "batch")]
    newest = every.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_row"))
    return newest.select(*keys, "_row.*")


def compact(spark: SparkSession, path: str, target: str, *keys: str) -> None:
    """Writes the newest rows of a result store as batch 0 of another."""
    append_results(read_latest(spark, path, *keys), target, 0)


def profiles_json(groups: DataFrame, planes: DataFrame) -> DataFrame:
    """A JSON record for each slice: key, angle, azimuth, and its groups with their centroids."""
    one = groups.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("path_id", "group_id", "cu", "cv", "n_nodes"))).alias("groups"))
    return one.join(planes, "k").select("k", F.to_json(F.struct("slice_key", "azimuth", "groups")).alias("record"))


def slice_subset(segments: DataFrame, lower: float, upper: float, step: float) -> DataFrame:
    """Segments whose plane position (the slice key) is lower + i * step, to eight decimals."""
    spark = segments.sparkSession
    n = int((upper - lower) / step + 1e-9)
    wanted = spark.range(n + 1).select(F.rint((lower + F.col("id") * step) * 1e8).cast("long").alias("at"))
    return segments.withColumn("at", F.rint(F.col("slice_key").try_cast("double") * 1e8).cast("long")).join(wanted, "at", "left_semi").drop("at")
