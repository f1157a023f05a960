"""Removal of passages that repeat across documents.

Rabin-Karp hashes of every fixed-length token window are counted in Spark; repeated windows merge
into maximal removal intervals. A window's owner is the least doc_id in which its word sequence
starts; each word of another document that such a window covers goes.

Shuffling one row for each window of the corpus would move more bytes than the corpus has. Two
reductions keep the count exact and the volume small:

* Each window is represented by the least hash of its inner 16-word runs (winnowing). Equal windows
  have equal representatives, so a window whose representative occurs in one document only can't
  repeat, and only windows with a representative seen in two documents are counted one by one.
* Within a block of documents, a window is sent on once, for the least doc_id of the block; its
  other occurrences there are already known to be repeats. A frequent window is sent once by a whole
  task, so a passage that a third of all documents share is a row for each task, not for each document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wallscan.llm.common import batch_of, blocks, stored, text_or_empty, utf8
from wallscan.llm.hashing import mix, runs, sliding_min, words

INNER = 16
#: Of a representative in more documents, a task sends each window once.
FREQUENT = 1_000
_ANCHORS = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("anchor", pa.int64())])
_WINDOWS = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("h1", pa.int64()), ("h2", pa.int32()), ("start", pa.int32()), ("stop", pa.int32()), ("known", pa.bool_())])
_KEPT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("removed", pa.list_(pa.int32())), ("kept_text", pa.string()), ("kept_sha256", pa.string())])


def _windows(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, ...]:
    """Tokens, their offsets by text, and the row, place in `tokens` and representative of each window of a block."""
    inner = min(INNER, width)
    tokens, offsets = words(*utf8(batch.column("text")))
    least = sliding_min(mix(runs(tokens, inner)), width - inner + 1) if len(tokens) >= width else np.empty(0, np.uint64)
    row = np.repeat(np.arange(batch.num_rows), np.diff(offsets))[: len(least)]
    at = np.flatnonzero(np.arange(len(least)) + width <= offsets[row + 1])
    return tokens, offsets, row[at], at, least[at].view(np.int64)


def _new(*keys: np.ndarray) -> np.ndarray:
    """Whether a row differs from the one before it."""
    out = np.ones(len(keys[0]), bool)
    out[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return out


def _anchors(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in blocks(whole):
                _, _, row, _, anchor = _windows(batch, width)
                keep = _new(row, anchor)
                row, anchor = row[keep], anchor[keep]
                order = np.lexsort((anchor, row))
                row, anchor = row[order], anchor[order]
                keep = _new(row, anchor)
                ids, texts = (batch.column(c).to_numpy(zero_copy_only=False)[row[keep]] for c in ("doc_id", "text_hash"))
                yield batch_of(_ANCHORS, ids, texts, anchor[keep])

    return run


def _merged(keys: np.ndarray, start: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal intervals of windows that overlap or touch; rows are in order of key and start."""
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (start[1:] > start[:-1] + width)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(keys)) - 1
    return keys[first], start[first], start[last] + width if len(keys) else start


class _Sent:
    """The owners of frequent windows that this task has sent already; emptied when it holds `most`, which costs rows and changes no result."""

    def __init__(self, most: int = 1 << 20):
        self.most = most
        self.h1, self.h2, self.owner = np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.int64)

    def owners(self, h1: np.ndarray, h2: np.ndarray, own: np.ndarray) -> np.ndarray:
        """The least owner sent so far of each window, if less than its own; h1 is in order and distinct windows come once."""
        if not len(self.h1):
            return own
        at = np.minimum(np.searchsorted(self.h1, h1), len(self.h1) - 1)
        same = (self.h1[at] == h1) & (self.h2[at] == h2)
        return np.where(same, np.minimum(self.owner[at], own), own)

    def add(self, h1: np.ndarray, h2: np.ndarray, owner: np.ndarray) -> None:
        if len(self.h1) + len(h1) > self.most:
            self.__init__(self.most)
        h1, h2, owner = (np.concatenate(x) for x in ((self.h1, h1), (self.h2, h2), (self.owner, owner)))
        order = np.lexsort((owner, h2, h1))
        keep = order[_new(h1[order], h2[order])]
        self.h1, self.h2, self.owner = h1[keep], h2[keep], owner[keep]


def _candidates(width: int):
    """Of each document, the windows whose representative is in its `anchors`; windows known to be repeats as intervals.

    A window that one document has at several places comes as intervals too, so a run of one word is a row.
    Windows of frequent representatives (`hot`) are sent on once by a task and not by each of its blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt, sent = np.uint64(0x9E3779B97F4A7C15), _Sent()
        for whole in batches:
            for batch in blocks(whole):
                tokens, offsets, row, at, anchor = _windows(batch, width)
                wanted = batch.column("anchors")
                names = wanted.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
                of = np.repeat(np.arange(batch.num_rows), wanted.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)).astype(np.uint64)
                keep = np.isin(mix(anchor.view(np.uint64) + row.astype(np.uint64) * salt), mix(names + of * salt))
                row, at, anchor = row[keep], at[keep], anchor[keep]
                hot = np.isin(anchor, batch.column("hot").flatten().to_numpy(zero_copy_only=False))
                ids, texts = (batch.column(c).to_numpy(zero_copy_only=False)[row] for c in ("doc_id", "text_hash"))
                h1 = mix(runs(tokens, width)[at]).view(np.int64)
                h2 = mix(runs(tokens, width, 0xA24BAED4963EE407)[at]).view(np.int64).astype(np.int32)
                start = (at - offsets[row]).astype(np.int32)
                order = np.lexsort((start, texts, ids, h2, h1))
                h1, h2, ids, texts, start, hot = h1[order], h2[order], ids[order], texts[order], start[order], hot[order]
                first = np.flatnonzero(_new(h1, h2)) if len(ids) else np.empty(0, np.int64)
                group = np.repeat(np.arange(len(first)), np.diff(first, append=len(ids)))
                owner = ids[first].copy()
                some = np.flatnonzero(hot[first])
                owner[some] = sent.owners(h1[first[some]], h2[first[some]], owner[some])
                sent.add(h1[first[some]], h2[first[some]], owner[some])
                known = ids > owner[group]
                rows = np.cumsum(_new(group, texts)) - 1 if len(ids) else group  # the least document of a window may have two texts
                top = np.flatnonzero(np.diff(rows, prepend=-1))
                rows, begin, end = _merged(rows[~known], start[~known], width)
                one = top[rows]
                yield batch_of(_WINDOWS, ids[one], texts[one], h1[one], h2[one], begin.astype(np.int32), end.astype(np.int32), np.zeros(len(one), bool))
                ids, texts, start = ids[known], texts[known], start[known]
                order = np.lexsort((start, texts, ids))
                ids, texts, start = ids[order], texts[order], start[order]
                rows, begin, end = _merged(np.cumsum(_new(ids, texts)) - 1 if len(ids) else ids, start, width)
                top = np.flatnonzero(_new(ids, texts)) if len(ids) else ids
                ids, texts = ids[top[rows]], texts[top[rows]]
                one = mix(ids.astype(np.uint64) * salt + begin.astype(np.uint64)).view(np.int64)  # spreads them over the partitions
                yield batch_of(_WINDOWS, ids, texts, one, np.zeros(len(ids), np.int32), begin.astype(np.int32), end.astype(np.int32), np.ones(len(ids), bool))

    return run


def _remove(texts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in blocks(whole):
                n_words, n_removed, spans, kept, digest = [], [], [], [], []
                for text, pairs in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                    found = (text or "").encode().split()  # splits at 0x20 and 0x09-0x0D
                    left, at, merged = [], 0, []
                    for a, b in sorted((p["start"], p["stop"]) for p in pairs or ()):
                        if merged and a <= merged[-1][1]:
                            merged[-1][1] = max(merged[-1][1], b)
                        else:
                            merged.append([a, b])
                    for a, b in merged:
                        left += found[at:a]
                        at = b
                    left += found[at:]
                    out = b" ".join(left)
                    n_words.append(len(found))
                    n_removed.append(len(found) - len(left))
                    spans.append([x for s in merged for x in s])
                    kept.append(out.decode() if texts else None)
                    digest.append(hashlib.sha256(out).hexdigest())
                yield batch_of(_KEPT, batch.column("doc_id"), n_words, n_removed, spans, kept, digest)

    return run


def remove_repeated_passages(documents: DataFrame, width: int = 50, texts: bool = True) -> DataFrame:
    """documents without the words that a repeated window of `width` words covers.

    documents has doc_id long and text; other columns are ignored. Returns doc_id, n_words,
    n_removed, removed (start and stop of each interval, by word, in one list), kept_text (kept words
    joined by a space; null where texts is false) and kept_sha256.

    Words are `[^\\x20\\x09-\\x0D]+`, unchanged. A window counts as repeated in a document when the
    same words start in a document with a smaller doc_id; repeats within one document don't count.
    Null and empty texts have no words. Rows with a null doc_id own nothing and lose nothing. Rows
    with the same doc_id are kept, and each loses what documents with smaller ids have, by its own text.
    """
    if width < 1:
        raise ValueError("width must be positive")
    every = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    docs = every.where("doc_id is not null")
    # Texts of one id are told apart by their hash; it is 0, which costs nothing to shuffle, where an id has one row.
    # Both joins of the texts are by id and hash, so Spark shuffles them once.
    again = stored(docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", F.lit(True).alias("again")), "repeated-ids")
    docs = docs.join(again, "doc_id", "left").select("doc_id", "text", F.when(F.col("again"), F.xxhash64("text")).otherwise(F.lit(0).cast("long")).alias("text_hash"))
    anchors = stored(docs.mapInArrow(_anchors(width), "doc_id long, text_hash long, anchor long"), "anchors")
    shared = anchors.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.count("*").alias("n")).where("a < b").select("anchor", F.when(F.col("n") > FREQUENT, F.col("anchor")).alias("hot"))
    wanted = anchors.join(shared, "anchor").groupBy("doc_id", "text_hash").agg(F.collect_set("anchor").alias("anchors"), F.collect_set("hot").alias("hot"))
    found = docs.join(wanted, ["doc_id", "text_hash"]).mapInArrow(_candidates(width), "doc_id long, text_hash long, h1 long, h2 int, start int, stop int, known boolean")
    owner = F.min("doc_id").over(Window.partitionBy("h1", "h2", "known"))
    spans = found.withColumn("owner", owner).where("known or doc_id > owner").groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    schema = "doc_id long, n_words long, n_removed long, removed array<int>, kept_text string, kept_sha256 string"
    kept = docs.join(spans, ["doc_id", "text_hash"], "left").select("doc_id", "text", "spans").mapInArrow(_remove(texts), schema)
    unknown = every.where("doc_id is null").withColumn("spans", F.lit(None).cast("array<struct<start:int,stop:int>>"))
    return kept.unionByName(unknown.mapInArrow(_remove(texts), schema))
