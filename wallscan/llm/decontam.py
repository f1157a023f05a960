"""Benchmark decontamination: passages of documents within a few word edits of a benchmark item.

The CGK walk (Chakraborty, Goldenberg, Koucky 2016) maps a sequence to one in which few edits are
few differing places. Several independent walks are sampled at a few places each; windows of a
document as long as an item that agree with the item on all places of some walk are candidates,
and the exact edit distance to the item decides.

Walking every window of every document would cost hundreds of operations a word. An item of n words
with e edits keeps at least n - 1 - 2e of its pairs and n - 2 - 3e of its triples of neighbouring
words, so windows of n words with fewer of those known from items of n words can't match. Maps of
fixed size hold the pairs and triples with the lengths (modulo 64) of their items, and the walk keys of
all items. A fuller map lets more windows through and never fewer; every window let through is walked.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wallscan.llm.common import batch_of, blocks, lists, stored, text_or_empty, utf8, without
from wallscan.llm.hashing import mix, runs, words

SLOT_BITS, KEY_BITS, PLACES = 18, 25, 3
_ITEM = pa.schema([("item_id", pa.int64()), ("n", pa.int32()), ("tokens", pa.list_(pa.int64())), ("pairs", pa.list_(pa.int32())), ("triples", pa.list_(pa.int32())), ("keys", pa.list_(pa.int64()))])
_WINDOW = pa.schema([("doc_id", pa.int64()), ("start", pa.int32()), ("first", pa.int32()), ("n", pa.int32()), ("region", pa.list_(pa.int64())), ("keys", pa.list_(pa.int64()))])
_HIT = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("start_word", pa.int32()), ("stop_word", pa.int32()), ("edits", pa.int32()), ("n_item_words", pa.int32())])


def walks_for(sizes: np.ndarray, share: float, recall: float) -> np.ndarray:
    """How many walks of three places find a window at its limit of edits with probability `recall`, for items of these sizes.

    With e = floor(share * n) edits a walk shows the same at three places with probability 1.4 / (e + 2)
    (simulated: 20 to 300 words, share 0.2). Some edits hide a window from most walks, so 1.6 times the
    walks are taken that independent chances would need. There is no upper limit; counts are multiples of 8.
    """
    chance = 1.4 / ((share * sizes).astype(np.int64) + 2)
    return np.maximum(16, np.ceil(1.6 * np.log(1 - recall) / np.log1p(-chance) / 8).astype(np.int64) * 8)


def walk_keys(tokens: np.ndarray, starts: np.ndarray, sizes: np.ndarray, walks: int, places: int) -> np.ndarray:
    """For each window the key of each walk: what the walk shows at its sampled places, with the window's length."""
    rng = np.random.default_rng(31)
    spread = rng.random((walks, places))
    flips = rng.integers(1, 2**63, (walks, 4096), dtype=np.uint64) | np.uint64(1)
    keys = np.repeat(mix(sizes.astype(np.uint64))[None], walks, 0) + np.arange(walks, dtype=np.uint64)[:, None]
    if not len(starts):
        return keys
    at = np.zeros((walks, len(starts)), np.int64)
    wanted = (spread[:, :, None] * (2 * sizes)).astype(np.int64)  # walk, place, window
    last = int(wanted.max())
    for step in range(last + 1):
        ended = at >= sizes
        token = np.where(ended, np.uint64(0), tokens[starts + np.minimum(at, sizes - 1)])
        for p in range(places):
            hit = wanted[:, p] == step
            if hit.any():
                keys[hit] = mix(keys[hit] * np.uint64(0x9E3779B97F4A7C15) + token[hit] + np.uint64(p + 1))
        at += ((token * flips[:, step % 4096][:, None]) >> np.uint64(63)).astype(np.int64)
    return mix(keys)


def infix_distance(item: list[int], region: list[int]) -> tuple[int, int]:
    """The least edit distance of item to any run of region, and where that run ends (Myers' bit vectors; the first of equals)."""
    at: dict[int, int] = {}
    for i, t in enumerate(item):
        at[t] = at.get(t, 0) | 1 << i
    full = (1 << len(item)) - 1
    top = 1 << len(item) - 1
    more, less, now, best = full, 0, len(item), (len(item), 0)
    for j, t in enumerate(region):
        same = at.get(t, 0)
        diagonal = (((same & more) + more) ^ more | same | less) & full
        up, down = less | ~(diagonal | more) & full, more & diagonal
        now += bool(up & top) - bool(down & top)
        up, down = up << 1 & full, down << 1 & full
        more, less = (down | ~(diagonal | up)) & full, up & diagonal
        best = min(best, (now, j + 1))
    return best


def _items(share: float, recall: float, places: int, min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, offsets = words(*utf8(batch.column("text")), lower=True, letters=True)
            sizes = np.diff(offsets)
            some = np.flatnonzero(sizes >= min_words)
            walks = walks_for(sizes[some], share, recall)
            keys = [np.empty(0, np.uint64)] * len(some)
            for w in np.unique(walks):
                alike = np.flatnonzero(walks == w)
                for i, key in zip(alike, walk_keys(tokens, offsets[some[alike]], sizes[some[alike]], int(w), places).T):
                    keys[i] = key
            pairs, triples = ((mix(runs(tokens, k)) & np.uint64((1 << SLOT_BITS) - 1)).astype(np.int32) for k in (2, 3))
            ids = batch.column("item_id").to_numpy(zero_copy_only=False)
            yield batch_of(
                _ITEM, ids[some], sizes[some].astype(np.int32),
                pa.array([tokens[offsets[i] : offsets[i + 1]].view(np.int64) for i in some], _ITEM.types[2]), pa.array([pairs[offsets[i] : offsets[i + 1] - 1] for i in some], _ITEM.types[3]),
                pa.array([triples[offsets[i] : offsets[i + 1] - 2] for i in some], _ITEM.types[4]), lists(np.concatenate([np.empty(0, np.uint64), *keys]).view(np.int64), np.append(0, walks.cumsum()), pa.int64()),
            )

    return run


def _filled(values: dict[int, int], size: int) -> np.ndarray:
    filled = np.zeros(size, np.uint64)
    for at, value in values.items():
        filled[at] = value & (1 << 64) - 1
    return filled


def _dense_starts(hits: np.ndarray, n: int, need: int, inner: int) -> np.ndarray:
    """Starts of windows of n words that hold at least `need` of the places in hits, a place being the start of `inner` words."""
    if len(hits) < need:
        return np.empty(0, np.int64)
    first, last = hits[: len(hits) - need + 1], hits[need - 1 :]
    lo = np.maximum(last - (n - inner), 0)
    ok = lo <= first
    first, lo = first[ok], lo[ok]
    size = first - lo + 1
    return np.unique(np.repeat(lo - np.append(0, size.cumsum()[:-1]), size) + np.arange(size.sum())) if len(size) else first


def _windows(pairs: dict[int, int], triples: dict[int, int], keyed: dict[int, int], lengths: list[int], share: float, recall: float, places: int):
    filled = [_filled(pairs, 1 << SLOT_BITS), _filled(triples, 1 << SLOT_BITS), _filled(keyed, 1 << KEY_BITS - 6)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, triples, keyed = filled
        slot, low = np.uint64((1 << SLOT_BITS) - 1), np.uint64((1 << KEY_BITS) - 1)
        for whole in batches:
            for batch in blocks(whole, limit=1 << 21):
                tokens, offsets = words(*utf8(batch.column("text")), lower=True, letters=True)
                if len(tokens) < 3:
                    continue
                pair, triple = pairs[mix(runs(tokens, 2)) & slot], triples[mix(runs(tokens, 3)) & slot]
                inner = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(tokens))]
                pair[inner - 1] = 0  # words of two texts
                triple[inner[inner <= len(triple)] - 1] = 0
                triple[inner[inner > 1] - 2] = 0
                pair_at, triple_at = np.flatnonzero(pair), np.flatnonzero(triple)
                pair, triple = pair[pair_at], triple[triple_at]
                found = []
                for n in lengths:
                    edits, bit = int(share * n), np.uint64(n % 64)
                    need = n - 2 - 3 * edits
                    hits = pair_at[(pair >> bit & np.uint64(1)).astype(bool)]
                    start = _dense_starts(triple_at[(triple >> bit & np.uint64(1)).astype(bool)], n, need, 3) if need > 0 else _dense_starts(hits, n, 1, 2)
                    if not len(start):
                        continue
                    doc = np.searchsorted(offsets, start, "right") - 1
                    end = offsets[doc + 1]
                    value = np.searchsorted(hits, np.minimum(start + n, end) - 1) - np.searchsorted(hits, start)
                    ok = (value >= max(1, n - 1 - 2 * edits)) & (end - start >= n - edits)
                    found.append((doc[ok], start[ok], np.full(ok.sum(), n)))
                if not found:
                    continue
                ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
                padded = np.append(tokens, np.zeros(max(lengths), np.uint64))
                every = [np.concatenate(x).astype(np.int64) for x in zip(*found)]
                walks = walks_for(every[2], share, recall)
                for w, some in ((int(w), np.flatnonzero(walks == w)) for w in np.unique(walks)):
                    step = max(1, (1 << 20) // w)
                    for lo in range(0, len(some), step):
                        doc, start, n = (x[some[lo : lo + step]] for x in every)
                        keys = walk_keys(padded, start, n, w, places)
                        hit = (keyed[(keys & low) >> np.uint64(6)] >> (keys & np.uint64(63)) & np.uint64(1)).astype(bool)
                        met = np.flatnonzero(hit.any(0))
                        if not len(met):
                            continue
                        doc, start, n, keys, hit = doc[met], start[met], n[met], keys[:, met], hit[:, met]
                        slack = (share * n).astype(np.int64)
                        a, b = np.maximum(offsets[doc], start - slack), np.minimum(offsets[doc + 1], start + n + slack)
                        yield batch_of(
                            _WINDOW, ids[doc], (start - offsets[doc]).astype(np.int32), (a - offsets[doc]).astype(np.int32), n.astype(np.int32),
                            pa.array([tokens[x:y].view(np.int64) for x, y in zip(a, b)], _WINDOW.types[4]), lists(keys.T[hit.T].view(np.int64), np.append(0, hit.sum(0).cumsum()), pa.int64()),
                        )

    return run


def _verify(share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, first, item_id, region, item in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "first", "item_id", "region", "tokens")), strict=True):
                edits, stop = infix_distance(item, region)
                if edits <= int(share * len(item)):
                    _, back = infix_distance(item[::-1], region[:stop][::-1])
                    rows.append((doc_id, item_id, first + stop - back, first + stop, edits, len(item)))
            yield batch_of(_HIT, *(zip(*rows, strict=True) if rows else [[]] * 6))

    return run


def _separate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of hits of one item that share over half of its words the one with the fewest edits, as those of windows beside a place show a part of it."""
    for batch in batches:
        rows = []
        for doc_id, item_id, n, hits in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "item_id", "n", "hits")), strict=True):
            kept: list[tuple[int, int]] = []
            for edits, start, stop in sorted((h["edits"], h["start"], h["stop"]) for h in hits):
                near = kept[bisect.bisect(kept, (start - 2 * n, 0)) : bisect.bisect(kept, (stop, 0))]
                if not any(2 * (min(stop, b) - max(start, a)) > n for a, b in near):
                    bisect.insort(kept, (start, stop))
                    rows.append((doc_id, item_id, start, stop, edits, n))
        yield batch_of(_HIT, *(zip(*rows, strict=True) if rows else [[]] * 6))


def contaminated(documents: DataFrame, benchmark: DataFrame, share: float = 0.2, recall: float = 0.98, min_words: int = 8) -> DataFrame:
    """Places of benchmark items in documents: doc_id, item_id, start_word, stop_word, edits, n_item_words.

    Words are runs without ASCII punctuation or white space, A-Z in lower case. A place counts when
    the item is within floor(share * n) word edits of it, n being the item's words; a place with so
    many edits is found with probability `recall` at least, which sets the number of walks for each
    length. documents has doc_id long and text, benchmark item_id and text; other columns are ignored.

    Items of fewer than min_words words are too short to be evidence and match nothing. Null and
    empty texts match nothing; a null doc_id or item_id is reported like others; repeated rows give
    one place, and so do spans of one item that share over half of its words (the one with the fewest edits). Candidates are joined by walk key, so neither the table of items nor that of windows
    has to fit anywhere; what tasks get is two maps of 2**18
    words of 64 bits, a bit map of 2**25 bits and the distinct item lengths.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), text_or_empty().alias("text"))
    items = stored(rows.mapInArrow(_items(share, recall, PLACES, min_words), "item_id long, n int, tokens array<long>, pairs array<int>, triples array<int>, keys array<long>"), "items")
    lengths = sorted(r.n for r in items.select("n").distinct().collect())
    if not lengths:
        return docs.limit(0).mapInArrow(_verify(share), "doc_id long, item_id long, start_word int, stop_word int, edits int, n_item_words int")
    known = lambda c: dict(items.select(F.explode(c).alias("at"), "n").groupBy("at").agg(F.bit_or(F.expr("shiftleft(1L, n % 64)")).alias("lengths")).collect())
    at = items.select(F.explode("keys").alias("at")).select(F.col("at").bitwiseAND((1 << KEY_BITS) - 1).alias("at"))
    keyed = dict(at.groupBy(F.shiftright("at", 6).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits")).collect())
    windows = docs.mapInArrow(_windows(known("pairs"), known("triples"), keyed, lengths, share, recall, PLACES), "doc_id long, start int, first int, n int, region array<long>, keys array<long>")
    windows = stored(windows.withColumn("window", F.monotonically_increasing_id()), "windows")
    met = windows.select("window", F.explode("keys").alias("k")).join(items.select("item_id", F.explode("keys").alias("k")), "k").select("window", "item_id").distinct()
    both = met.join(windows.drop("keys", "start", "n"), "window").join(items.select(F.col("item_id").alias("i"), "tokens"), F.expr("item_id <=> i")).select("doc_id", "first", "item_id", "region", "tokens")
    hits = both.mapInArrow(_verify(share), "doc_id long, item_id long, start_word int, stop_word int, edits int, n_item_words int")
    hits = hits.groupBy("doc_id", "item_id", F.col("n_item_words").alias("n")).agg(F.collect_set(F.struct("edits", F.col("start_word").alias("start"), F.col("stop_word").alias("stop"))).alias("hits"))
    return hits.mapInArrow(_separate, "doc_id long, item_id long, start_word int, stop_word int, edits int, n_item_words int")


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """documents in which no benchmark item was found; columns stay. Rows with a null doc_id stay."""
    gone = stored(contaminated(documents, benchmark, **options).select("doc_id").distinct(), "leaks")
    return without(documents, gone)
