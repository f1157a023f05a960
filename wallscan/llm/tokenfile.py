"""Files of token ids: a zstandard frame for each document, and a seek table at the end.

A file is a run of independent zstandard frames, then two skippable frames: the doc_ids, and a seek
table in the public seekable format (compressed size, size and XXH64 checksum of each frame). Any
zstandard reader can decompress the whole file; one that wants a few documents reads the tables and
only those frames.
"""

from __future__ import annotations

import itertools
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wallscan.llm.common import batch_of, blocks, scratch, stored, text_or_empty
from wallscan.llm.tokens import default_path, encoder, with_end

# Fixed values of the format.
SKIPPABLE_IDS, SKIPPABLE_TABLE, SEEKABLE_MAGIC, CHECKSUMS = 0x184D2A5D, 0x184D2A5E, 0x8F92EAB1, 0x80
NO_ID = -(1 << 63)

_FILES = pa.schema([("path", pa.string()), ("first_doc", pa.int64()), ("last_doc", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("nulls", pa.bool_())])
_READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.list_(pa.int32()))])
_READ_SQL = "doc_id long, start long, n_tokens long, ids_crc32 long, ids array<int>"


def file_system(uri: str):
    """The file system and path of a folder or file, local or remote."""
    from pyarrow import fs

    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return (fs.LocalFileSystem(), uri) if uri.startswith("/") else fs.FileSystem.from_uri(uri)


def _write(folder: str, path: str, end_id: int, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        import zstandard

        coder, press = encoder(path), zstandard.ZstdCompressor(level=level, write_content_size=True)
        width = coder.dtype.itemsize
        system, at = file_system(folder)
        system.create_dir(at, recursive=True)
        name = f"{uuid.uuid4().hex}.tokens.zst"  # a new name for each attempt; the manifest lists the one that counts
        doc_ids, table, out, tokens = [], [], None, 0
        for whole in batches:
            for batch in blocks(whole, limit=1 << 24):
                ids, offsets = with_end(*coder.column(batch.column("text")), end_id)
                out = out or system.open_output_stream(f"{at}/{name}", compression=None)
                doc_ids += batch.column("doc_id").fill_null(NO_ID).to_pylist()
                for a, b in itertools.pairwise(offsets.tolist()):
                    raw = ids[a:b].tobytes()
                    frame = press.compress(raw)
                    out.write(frame)
                    table.append((len(frame), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
                tokens += len(ids)
        if out:
            index = struct.pack("<B", width) + np.array(doc_ids, "<i8").tobytes()
            out.write(struct.pack("<II", SKIPPABLE_IDS, len(index)) + index)
            seek = np.array(table, "<u4").tobytes() + struct.pack("<IBI", len(table), CHECKSUMS, SEEKABLE_MAGIC)
            out.write(struct.pack("<II", SKIPPABLE_TABLE, len(seek)) + seek)
            out.close()
            known = [x for x in doc_ids if x != NO_ID]
            yield batch_of(_FILES, [f"{folder}/{name}"], [known[0] if known else None], [known[-1] if known else None], [len(doc_ids)], [tokens], [len(known) < len(doc_ids)])

    return run


class TokenFile:
    """Random access to one file; `source` is an open file of pyarrow.fs or any object with seek, read and size()."""

    def __init__(self, source):
        self.source, end = source, source.size()
        source.seek(end - 9)
        n, flags, magic = struct.unpack("<IBI", source.read(9))
        if magic != SEEKABLE_MAGIC or not flags & CHECKSUMS:
            raise ValueError("no seek table with checksums")
        source.seek(end - 9 - 12 * n)
        table = np.frombuffer(source.read(12 * n), "<u4").reshape(n, 3).astype(np.int64)
        source.seek(end - 9 - 12 * n - 8 - 8 * n - 1)
        self.width = struct.unpack("<B", source.read(1))[0]
        self.doc_ids = np.frombuffer(source.read(8 * n), "<i8")
        self.at = np.append(0, table[:, 0].cumsum())
        self.tokens = table[:, 1] // self.width
        self.starts = np.append(0, self.tokens.cumsum())
        self.checks = table[:, 2]

    def frames(self, lo: int, hi: int, budget: int = 8 << 20) -> Iterator[np.ndarray]:
        """The ids of documents lo to hi - 1; their checksums are verified."""
        import xxhash
        import zstandard

        plain = zstandard.ZstdDecompressor()
        while lo < hi:
            to = max(lo + 1, min(hi, int(np.searchsorted(self.at, self.at[lo] + budget, "right")) - 1))
            self.source.seek(int(self.at[lo]))
            raw = self.source.read(int(self.at[to] - self.at[lo]))
            for i in range(lo, to):
                ids = plain.decompress(raw[self.at[i] - self.at[lo] : self.at[i + 1] - self.at[lo]])
                if xxhash.xxh64_intdigest(ids) & 0xFFFFFFFF != self.checks[i]:
                    raise ValueError(f"frame {i} does not match its checksum")
                yield np.frombuffer(ids, f"<u{self.width}")
            lo = to


def _read(with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base, lo, hi, wanted in zip(*(batch.column(c).to_pylist() for c in ("path", "base", "lo", "hi", "wanted")), strict=True):
                system, at = file_system(path)
                with system.open_input_file(at) as source:
                    file = TokenFile(source)
                    places = np.arange(lo, hi) if wanted is None else np.flatnonzero(np.isin(file.doc_ids, np.array(wanted, np.int64)))
                    cuts = np.flatnonzero(np.diff(places) != 1) + 1
                    for run_of in np.split(places, cuts) if len(places) else ():
                        rows = []
                        for i, ids in enumerate(file.frames(int(run_of[0]), int(run_of[-1]) + 1), int(run_of[0])):
                            doc_id = int(file.doc_ids[i])
                            rows.append((None if doc_id == NO_ID else doc_id, base + int(file.starts[i]), len(ids), zlib.crc32(ids.astype("<u4").tobytes()), ids.astype(np.int32) if with_ids else None))
                            if len(rows) == 512:
                                yield batch_of(_READ, *zip(*rows, strict=True))
                                rows = []
                        if rows:
                            yield batch_of(_READ, *zip(*rows, strict=True))

    return run


def write_token_files(documents: DataFrame, folder: str | None = None, tokenizer: str | None = None, end_id: int = 0, level: int = 1) -> DataFrame:
    """Encodes documents (doc_id long, text), appends end_id to each and writes ids in ascending doc_id order.

    A file holds a range of doc_ids, one for each shuffle partition. Returns the manifest, a row for each
    file: path, first_doc, last_doc, n_docs, n_tokens, nulls (whether it has documents without an id) and
    base (tokens in the files before it). folder must be one that driver and executors share; unset, a
    new one beside the checkpoints. Null and empty texts are the end id alone; a null doc_id comes first;
    rows with one doc_id stand together in order of text; other columns are ignored; an empty table gives
    an empty manifest and no files.
    """
    spark = documents.sparkSession
    folder = folder or scratch(spark, "token-files")
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    dealt = docs.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id").sortWithinPartitions("doc_id", "text")
    schema = "path string, first_doc long, last_doc long, n_docs long, n_tokens long, nulls boolean"
    files = stored(dealt.mapInArrow(_write(folder, tokenizer or default_path(), end_id, level), schema), "manifest")
    before = Window.orderBy(F.col("first_doc").asc_nulls_first(), "path").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    return files.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_token_files(manifest: DataFrame, doc_ids: DataFrame | None = None, with_ids: bool = True, frames: int = 2048) -> DataFrame:
    """Documents of the files: doc_id, start (tokens of all documents before it), n_tokens, ids_crc32 and ids.

    With doc_ids (a column doc_id, null for the documents without an id) only the frames of those
    documents are read and decompressed. Runs of `frames` documents are dealt to as many tasks as there
    are cores, at least, and to one for each 16 runs. An empty manifest gives no rows; documents that
    were not asked for, or are not there, give none.
    """
    cores = manifest.sparkSession.sparkContext.defaultParallelism
    total = manifest.agg(F.coalesce(F.sum("n_docs"), F.lit(0))).first()[0]
    tasks = max(1, min(cores, total // frames + 1), total // (16 * frames))
    if doc_ids is None:
        cut = manifest.select("path", "base", "n_docs", F.explode(F.expr(f"sequence(0L, n_docs - 1, {frames}L)")).alias("lo"))
        asked = cut.select("path", "base", "lo", F.least(F.col("lo") + frames, "n_docs").alias("hi"), F.lit(None).cast("array<long>").alias("wanted"))
        asked = asked.repartition(tasks, "path", "lo")
    else:
        # Files are bands of ids: an id belongs to the bands that its place among the sorted ends allows, found by an equi join on a coarse number.
        ask = doc_ids.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
        spread = manifest.agg(F.min("first_doc").alias("lo"), F.max("last_doc").alias("hi"), F.count("*").alias("n"))
        number = lambda c: F.floor((F.col(c).cast("double") - F.col("lo")) * F.col("n") / F.greatest(F.lit(1.0), F.col("hi").cast("double") - F.col("lo")))
        bands = manifest.where("first_doc is not null").crossJoin(F.broadcast(spread)).withColumn("band", F.explode(F.sequence(number("first_doc"), number("last_doc"))))
        hit = ask.crossJoin(F.broadcast(spread)).withColumn("band", number("doc_id")).select("doc_id", "band").join(bands, "band").where("doc_id between first_doc and last_doc").select("path", "base", "n_docs", "doc_id")
        unknown = ask.where("doc_id is null").crossJoin(manifest.where("nulls").select("path", "base", "n_docs")).select("path", "base", "n_docs", "doc_id")  # one row by the files with nulls
        hit = hit.unionByName(unknown).withColumn("block", F.pmod(F.xxhash64("doc_id"), F.greatest(F.lit(1), F.ceil(F.col("n_docs") / frames))))
        asked = hit.groupBy("path", "base", "block").agg(F.collect_list(F.coalesce("doc_id", F.lit(NO_ID))).alias("wanted")).select("path", "base", F.lit(0).cast("long").alias("lo"), F.lit(0).cast("long").alias("hi"), "wanted")
        asked = asked.repartition(tasks, "path", "wanted")
    return asked.mapInArrow(_read(with_ids), _READ_SQL)
