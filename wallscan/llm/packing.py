"""Best-fit packing of tokenised documents into sequences, with certified bin counts.

Documents are dealt into groups of bounded size, and each group is packed by best-fit decreasing.
Dual-feasible functions give a lower bound on the sequences that the group needs. Where the bound is
met, the group is settled. In a group with a gap only the full sequences are settled; the documents
of the others are dealt anew, together with those of other groups, and packed again.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wallscan.llm.common import batch_of, blocks, stored, text_or_empty
from wallscan.llm.tokens import default_path, encoder, spread, with_end

_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
_PACKED = "row long, doc_id long, piece int, start long, length long, ids_crc32 long, bin long, offset long, settled boolean, certified boolean"


def _cut(path: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for whole in batches:
            for batch in blocks(whole, limit=1 << 24):
                ids, offsets = with_end(*coder.column(batch.column("text")), end_id)
                ids = ids.astype("<u4")
                size = np.diff(offsets)
                n = -(-size // capacity)
                row = np.repeat(np.arange(len(size)), n)
                piece = spread(np.zeros(len(n), np.int64), n)
                first = size - (n - 1) * capacity  # the first piece may be shorter
                start = np.where(piece == 0, 0, first[row] + (piece - 1) * capacity)
                length = np.where(piece == 0, first[row], capacity)
                at = (offsets[row] + start).tolist()
                raw = memoryview(ids)
                crc = [zlib.crc32(raw[a : a + m]) for a, m in zip(at, length.tolist())]
                yield batch_of(_PIECES, batch.column("doc_id").take(pa.array(row)), piece.astype(np.int32), start, length, crc)

    return run


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """The bins that `sizes` need at least, by two families of dual-feasible functions."""
    if not len(sizes):
        return 0
    count = np.bincount(sizes, minlength=capacity + 1).astype(np.int64)
    value = np.arange(capacity + 1, dtype=np.int64)
    above = count[::-1].cumsum()[::-1]  # items of at least this size
    mass = np.append(0, (count * value).cumsum())
    cut = np.arange(capacity // 2 + 1)
    large = np.append(above, 0)[capacity - cut + 1]
    best = int((large - (-(mass[capacity - cut + 1] - mass[cut]) // capacity)).max())
    for k in range(1, 33):
        scaled = np.where((k + 1) * value % capacity == 0, k * value, (k + 1) * value // capacity * capacity)
        best = max(best, -int(-(count * scaled).sum() // (k * capacity)))
    return best


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and place of each item, and the room left in each bin."""
    at, place, room = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64), []
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    some = 0  # bit r: a bin with room r is open
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fits = some >> size
        if fits:
            left = size + (fits & -fits).bit_length() - 1
            b = open_bins[left].pop()
            if not open_bins[left]:
                some ^= 1 << left
        else:
            b, left = len(room), capacity
            room.append(capacity)
        at[i], place[i], room[b] = b, capacity - left, left - size
        if left > size:
            open_bins[left - size].append(b)
            some |= 1 << (left - size)
    return at, place, np.array(room, np.int64)


def _pack(capacity: int, last: bool):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("row", ignore_index=True)
        at, place, room = best_fit_decreasing(group["length"].to_numpy(), capacity)
        certified = len(room) == lower_bound(group["length"].to_numpy(), capacity)
        part = int(group["part"].iloc[0]) if len(group) else 0
        settled = np.full(len(group), True) if certified or last else room[at] == 0
        return group.drop(columns="part").assign(bin=(part << 32) + at, offset=place, settled=settled, certified=certified)

    return run


def token_pieces(documents: DataFrame, tokenizer: str | None = None, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """The pieces of each tokenised document: only one of over `capacity` tokens is cut, and its first piece may be shorter."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return docs.mapInArrow(_cut(tokenizer or default_path(), capacity, end_id), "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(pieces: DataFrame, capacity: int = 1024, group_rows: int = 16_384, rounds: int = 6) -> DataFrame:
    """pieces with sequence_id, offset and certified (its group met the lower bound).

    A group has about group_rows rows, so no task grows with the input. Pieces of full length are
    sequences of their own. After the last round, or once a single group is left, all is settled.
    No piece is dropped; repeated rows are packed like others; a null doc_id is an id like others.
    Pieces are dealt by a stored row number, so rows that repeat a doc_id spread like others.
    """
    columns = pieces.columns
    pieces = stored(pieces.withColumn("row", F.monotonically_increasing_id()), "pieces").select("row", *columns)
    full = pieces.where(F.col("length") == capacity).select(*columns, (F.col("row") * 2).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.lit(True).alias("certified"))
    done, rest = [full], pieces.where(F.col("length") < capacity)
    rows = rest.count()
    for number in range(rounds):
        if not rows:
            break
        parts = -(-rows // group_rows)
        last = parts == 1 or number == rounds - 1
        dealt = rest.withColumn("part", F.pmod(F.xxhash64("row", F.lit(number)), F.lit(parts)))
        packed = stored(dealt.groupBy("part").applyInPandas(_pack(capacity, last), _PACKED), "packed")
        sequence = (F.col("bin") * 16 + number) * 2 + 1
        done.append(packed.where("settled").select(*columns, sequence.alias("sequence_id"), "offset", "certified"))
        rest = packed.where("not settled").select(*pieces.columns)
        rows = 0 if last else rest.count()
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def pack_documents(documents: DataFrame, tokenizer: str | None = None, capacity: int = 1024, end_id: int = 2, **options) -> DataFrame:
    """Packs documents (doc_id long, text) into sequences of at most `capacity` tokens.

    Returns per piece doc_id, piece, start, length, ids_crc32, sequence_id, offset, certified. Null
    and empty texts are the end id alone; texts of any length are cut, never shortened; repeated
    rows are packed as often as they come; other columns are ignored; an empty table gives no rows.
    """
    return pack(token_pieces(documents, tokenizer, capacity, end_id), capacity, **options)


def _fill(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        schema = pa.schema([("sequence_id", pa.int64()), ("offset", pa.int64()), ("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
        for whole in batches:
            for batch in blocks(whole, limit=1 << 22):
                ids, offsets = with_end(*coder.column(batch.column("text")), end_id)
                rows = []
                for i, (doc_id, places) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("places").to_pylist(), strict=True)):
                    own = ids[offsets[i] : offsets[i + 1]].astype(np.int32)
                    rows += [(p["sequence_id"], p["offset"], doc_id, own[p["start"] : p["start"] + p["length"]]) for p in places]
                yield batch_of(schema, *(zip(*rows, strict=True) if rows else [[]] * 4))

    return run


def sequences(documents: DataFrame, packed: DataFrame, tokenizer: str | None = None, end_id: int = 2) -> DataFrame:
    """The packed sequences: sequence_id, ids, and doc_ids and lengths of their pieces in order.

    A sequence has at most `capacity` tokens, so a group is bounded. Pieces name their text by doc_id, so
    repeated or null doc_ids raise ValueError."""
    if not documents.groupBy("doc_id").count().where("doc_id is null or count > 1").isEmpty():
        raise ValueError("doc_id must be distinct and not null")
    places = packed.groupBy("doc_id").agg(F.collect_list(F.struct("sequence_id", "offset", "start", "length")).alias("places"))
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    parts = docs.join(places, "doc_id").mapInArrow(_fill(tokenizer or default_path(), end_id), "sequence_id long, offset long, doc_id long, ids array<int>")
    one = parts.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("p"))
    return one.select("sequence_id", F.flatten("p.ids").alias("ids"), F.col("p.doc_id").alias("doc_ids"), F.transform("p.ids", F.size).alias("lengths"))
