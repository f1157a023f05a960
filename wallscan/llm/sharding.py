"""Sharding through fixed virtual slots; DataFrame functions only.

Records are hashed into thousands of virtual slots. A versioned map says which shard holds which
slot; rebalancing edits the map by the bytes of each slot, and records never hash anew.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wallscan.llm.common import placed, scratch, stored, text_or_empty

SLOTS = 8_192


def virtual_slots(documents: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size (UTF-8 bytes of the text plus 8), text_crc32 and virtual_slot (by doc_id, without one by the text) of each row."""
    text = text_or_empty().cast("binary")
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32")).withColumn("virtual_slot", F.pmod(F.when(F.col("doc_id").isNull(), F.xxhash64("text_crc32")).otherwise(F.xxhash64("doc_id")), F.lit(slots)).cast("int"))


def spread_hot_ids(rows: DataFrame, slots: int = SLOTS) -> DataFrame:
    """rows with other slots for ids that hold more than a slot's mean share of the bytes in several rows.

    Such an id, of which there can be no more than slots, would outweigh its shard. Each of its rows gets the
    slot of the id and of its place among the id's rows by size and crc32, so the slots are the same for the
    same rows, in whatever order they come."""
    keyed = rows.withColumn("_key", F.coalesce(F.col("doc_id").cast("string"), F.lit("none")))
    total = rows.agg((F.sum("size") / slots).alias("mean"))
    heavy = keyed.groupBy("_key").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes")).where("rows > 1")
    hot = stored(heavy.crossJoin(F.broadcast(total)).where("bytes > mean").select("_key"), "hot-ids")
    if hot.isEmpty():
        return rows
    hot = F.broadcast(hot)  # at most `slots` rows
    apart = placed(keyed.join(hot, "_key", "left_semi"), "_key", ["size", "text_crc32"])
    apart = apart.withColumn("virtual_slot", F.pmod(F.xxhash64("_key", "pos"), F.lit(slots)).cast("int"))
    return stored(keyed.join(hot, "_key", "left_anti").unionByName(apart.select(keyed.columns)).drop("_key"), "spread-slots")


def slot_totals(placed: DataFrame) -> DataFrame:
    """Rows and bytes of each virtual slot; at most as many rows as slots."""
    return placed.groupBy("virtual_slot").agg(F.count("*").alias("slot_rows"), F.sum("size").alias("slot_bytes"))


def edited_map(totals: list[tuple[int, int]], shards: int, old: dict[int, int]) -> dict[int, int]:
    """The old slot-to-shard map, edited for near equal bytes, from (slot, bytes) of all its slots.

    Slots of shards that are no more go to the emptiest shard, largest first. Then slots move from the
    fullest to the emptiest shard while that narrows the gap, the best fitting slot first, so few records move.
    """
    out, held, load = {}, [{} for _ in range(shards)], [0] * shards
    homeless = [(size, slot) for slot, size in totals if old[slot] >= shards]
    for slot, size in totals:
        if (shard := old[slot]) < shards:
            out[slot], held[shard][slot] = shard, size
            load[shard] += size
    for size, slot in sorted(homeless, key=lambda x: (-x[0], x[1])):
        low = min(range(shards), key=load.__getitem__)
        out[slot], held[low][slot] = low, size
        load[low] += size
    for _ in range(4 * len(totals)):
        top, low = max(range(shards), key=load.__getitem__), min(range(shards), key=load.__getitem__)
        gap = load[top] - load[low]
        fits = [(abs(gap - 2 * size), slot) for slot, size in held[top].items() if 0 < size < gap]
        if not fits:
            break
        slot = min(fits)[1]
        size = held[top].pop(slot)
        held[low][slot], out[slot] = size, low
        load[top] -= size
        load[low] += size
    return out


def last_map(spark: SparkSession, path: str) -> tuple[int, dict[int, int]] | None:
    """Number and slots of the last version of the map at path; None where there is no map."""
    try:
        table = spark.read.schema("virtual_slot int, shard int, version int").parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    version = table.agg(F.max("version")).first()[0]
    return None if version is None else (version, {r.virtual_slot: r.shard for r in table.where(F.col("version") == version).collect()})  # a row for each slot


def save_map(spark: SparkSession, mapping: dict[int, int], version: int, path: str) -> None:
    """Writes a version of the map (virtual_slot int, shard int) below path; one that exists is never replaced."""
    spark.createDataFrame(sorted(mapping.items()), "virtual_slot int, shard int").coalesce(1).write.mode("errorifexists").parquet(f"{path}/version={version}")


def rebalanced(spark: SparkSession, totals: DataFrame, shards: int, slots: int, path: str) -> tuple[int, DataFrame]:
    """Number and rows (virtual_slot, shard) of the map at path, edited for these slot totals if need be.

    Without a map, version 0 deals the slots in turn. The last version is edited; what differs from it is
    the next version."""
    size = {r.virtual_slot: r.slot_bytes for r in totals.collect()}  # at most `slots` rows
    known = last_map(spark, path)
    if known is None:
        known = (0, {slot: slot % shards for slot in range(slots)})
        save_map(spark, known[1], 0, path)
    version, old = known
    if sorted(old) != list(range(slots)):
        raise ValueError(f"the map has {len(old)} slots, not {slots}")
    new = edited_map([(slot, size.get(slot, 0)) for slot in range(slots)], shards, old)
    if new != old:
        version += 1
        save_map(spark, new, version, path)
    return version, spark.read.schema("virtual_slot int, shard int").parquet(f"{path}/version={version}")


def shard_documents(documents: DataFrame, shards: int = 24, slots: int = SLOTS, map_path: str | None = None) -> DataFrame:
    """Assigns each row of documents (doc_id long, text) to one of `shards` shards of near equal bytes.

    Returns doc_id, size, text_crc32, law ('bytes'), shard, slot (the place within the shard, gapless
    from 0), grown_shard (null: the law is not 'key') and virtual_slot. The map at map_path (unset: a
    new folder beside the checkpoints) is read, edited by the bytes of each slot for this number of shards,
    and written as its next version if it changed; the same call again finds nothing to edit and gives
    the same rows. `slots` is fixed for the life of a map.

    Slots go by doc_id, not by text: equal texts, of which there may be a third of all rows, spread over
    the shards, as the law asks for near equal bytes. A null text counts 8 bytes, an empty one too; rows
    that repeat a doc_id share its virtual slot and get places of their own, but where an id holds more than
    a slot's share of all bytes, its rows get slots of their own; rows without a doc_id count
    as one id, or go by their text where they are few; an empty table gives no rows; other columns are ignored. Places are counted within a
    virtual slot and offset by the slots before it in the shard, so no task sorts a whole shard.
    """
    spark = documents.sparkSession
    dealt = spread_hot_ids(virtual_slots(documents, slots), slots)
    totals = stored(slot_totals(dealt), "slot-totals")
    _, mapping = rebalanced(spark, totals, shards, slots, map_path or scratch(spark, "slot-map"))
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    based = mapping.join(totals, "virtual_slot").select("virtual_slot", "shard", F.coalesce(F.sum("slot_rows").over(before), F.lit(0)).alias("base"))
    place = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "size", "text_crc32"))
    return dealt.withColumn("place", place).join(F.broadcast(based), "virtual_slot").select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base") + F.col("place") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")
