"""Removal of lines that were seen before, exactly or within a few edits.

Lines within `edits` edits are found by a segment-partition join: of two such lines, the shorter one
cut into edits + 1 segments has a segment that also stands in the other, close to its own place.
Segments are indexed and the few possible substrings of each line probe the index (Li et al. 2011).
A banded bit-parallel edit distance verifies each pair. Where a crowd of lines shares its segments, as
numbered lines of one template do, lines are grouped by patterns of two edits instead of being paired.
"""

from __future__ import annotations

import hashlib
import itertools
import os.path
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wallscan.llm.common import batch_of, blocks, lists, named, stored, text_or_empty, utf8
from wallscan.llm.components import components
from wallscan.llm.hashing import mix, span_hashes

_LINES = pa.schema([("doc_id", pa.int64()), ("line", pa.int32()), ("chars", pa.int32()), ("h1", pa.int64()), ("h2", pa.int32())])
_KEYS = pa.schema([("h1", pa.int64()), ("indexed", pa.list_(pa.int64())), ("probes", pa.list_(pa.int64()))])
_FINE = pa.schema([("h1", pa.int64()), ("parities", pa.int64()), ("indexed", pa.list_(pa.int64())), ("probes", pa.list_(pa.int64()))])
_SPREAD = pa.schema([("k", pa.int64()), ("h1", pa.int64()), ("slot", pa.int32()), ("left", pa.string()), ("right", pa.string())])
_TRIMS = pa.schema([("k", pa.int64()), *((c, pa.int32()) for c in ("left_start", "left_end", "right_start", "right_end"))])
_PATTERNS = pa.schema([("k", pa.int64()), ("pattern", pa.string()), ("role", pa.int8()), ("h1", pa.int64())])
_TEXTS = pa.schema([("h1", pa.int64()), ("said", pa.string())])
_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("distance", pa.int32())])
_CLEAN = pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_removed", pa.int64()), ("removed", pa.list_(pa.int32())), ("text", pa.string()), ("kept_sha256", pa.string())])
_CLEAN_SQL = "doc_id long, n_lines long, n_removed long, removed array<int>, text string, kept_sha256 string"
_BASE = np.uint64(0x9FB21C651E98DF25)
FILTER_BITS = 25
_powers = np.ones(1, np.uint64)


def edit_distance(a: str, b: str, most: int) -> int:
    """The edit distance of two strings, or most + 1 if it is greater.

    Bit d of a state says that, with that many edits, some start of a and the start of b read so far
    are alike, on diagonal d - most; states are 2 * most + 1 bits wide however long the strings."""
    start = len(os.path.commonprefix([a, b]))
    a, b = a[start:], b[start:]
    end = len(os.path.commonprefix([a[::-1], b[::-1]]))
    a, b = a[: len(a) - end], b[: len(b) - end]
    if abs(len(a) - len(b)) > most:
        return most + 1
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i + most
    band = (1 << 2 * most + 1) - 1
    states = [((1 << e + 1) - 1) << most & band for e in range(most + 1)]
    for j, c in enumerate(b):
        match = at.get(c, 0) >> j & band
        old, states[0] = states[0], states[0] & match
        for e in range(1, most + 1):
            old, states[e] = states[e], states[e] & match | old | old >> 1 | states[e - 1] << 1 & band
        if not states[most]:
            return most + 1
    last = 1 << len(a) - len(b) + most
    return next((e for e, s in enumerate(states) if s & last), most + 1)


def _points(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Prefix hashes over the code points of all lines, and where each line starts."""
    global _powers
    points = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    while len(_powers) <= len(points):
        _powers = np.concatenate([_powers, _powers * np.uint64(pow(int(_BASE), len(_powers), 1 << 64))])
    return np.append(np.uint64(0), np.cumsum(mix(points + np.uint64(7)) * _powers[: len(points)], dtype=np.uint64)), np.append(0, np.cumsum([len(x) for x in lines]))


def segment_keys(lines: list[str], edits: int) -> tuple[np.ndarray, np.ndarray]:
    """For each line the keys of its edits + 1 segments, and the keys of its substrings that could be a segment of a line as long or up to `edits` shorter."""
    sums, starts = _points(lines)
    size, begin, top = np.diff(starts), starts[:-1], _powers[len(sums) - 1 :][0] if len(_powers) >= len(sums) else np.uint64(1)
    whole = len(sums) - 1

    def key(at: np.ndarray, width: np.ndarray, length: np.ndarray, segment: int) -> np.ndarray:
        inside = (at >= 0) & (width > 0) & (at + width <= size)
        a = np.where(inside, begin + at, 0)
        b = np.where(inside, a + width, 0)
        value = (sums[b] - sums[a]) * inverse[a]
        return np.where(inside, mix(value + mix(length.astype(np.uint64) * np.uint64(64) + np.uint64(segment))), np.uint64(0))

    inverse = _inverse(whole)
    parts = edits + 1

    def segment(length: np.ndarray, i: int) -> tuple[np.ndarray, np.ndarray]:
        short, longer = length // parts, length % parts
        before = i * short + np.maximum(0, i - (parts - longer))
        return before, short + (i >= parts - longer)

    indexed = np.stack([key(*segment(size, i), size, i) for i in range(parts)], 1)
    probes = []
    for less in range(edits + 1):
        length = size - less
        for i in range(parts):
            p, width = segment(length, i)
            left, right = max(-i, less - (edits - i)), min(i, less + (edits - i))
            probes += [np.where(length > 0, key(p + shift, width, length, i), np.uint64(0)) for shift in range(left, right + 1)]
    return indexed, np.stack(probes, 1)


def letter_parities(lines: list[str]) -> np.ndarray:
    """64 bits for each line: whether the characters of each of 64 classes are odd in number. An edit changes two bits at most."""
    points = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    starts = np.append(0, np.cumsum([len(x) for x in lines]))[:-1]
    return np.bitwise_xor.reduceat(np.uint64(1) << (mix(points + np.uint64(99)) & np.uint64(63)), starts).view(np.int64) if len(points) else np.zeros(len(lines), np.int64)


# Gaps are the two of six segments that may differ. A probe takes a line as one with `less` characters
# more than the other and the segments between its gaps moved by t.
_GAPS = [(i, j) for i in range(6) for j in range(i + 1, 6)]
_PROBES = [(less, i, j, t) for less, between in ((0, (-1, 0, 1)), (1, (0, 1)), (2, (0, 1, 2))) for i, j in _GAPS for t in (between if j > i + 1 else (0,))]
_SLOTS = [(0, i, j, 0) for i, j in _GAPS] + _PROBES  # of the indexed keys, then of the probes


def fine_keys(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of four of six segments of each line, and the keys of its substrings that could be those of a line as long or up to two shorter.

    Two edits touch at most two of six segments. Before the first of them a segment stands at its own
    place, after the second it is moved by the difference in length, and between them by what the edits
    in the first may move it."""
    sums, starts = _points(lines)
    size, begin, inverse = np.diff(starts), starts[:-1], _inverse(len(sums) - 1)

    def piece(length: np.ndarray, s: int, shift: int) -> np.ndarray:
        short, longer = length // 6, length % 6
        at = s * short + np.maximum(0, s - (6 - longer)) + shift
        width = short + (s >= 6 - longer)
        inside = (at >= 0) & (width > 0) & (at + width <= size)
        a = np.where(inside, begin + at, 0)
        b = np.where(inside, a + width, 0)
        return np.where(inside, mix((sums[b] - sums[a]) * inverse[a] + np.uint64(s + 1)), np.uint64(0))

    def key(pieces: list[np.ndarray], length: np.ndarray, i: int, j: int) -> np.ndarray:
        out = mix(length.astype(np.uint64) * np.uint64(64) + np.uint64(6 * i + j))
        for p in pieces:
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + p)
        return np.where(np.logical_and.reduce([p != 0 for p in pieces]), out, np.uint64(0))

    own = [piece(size, s, 0) for s in range(6)]
    indexed = np.stack([key([own[s] for s in range(6) if s not in gap], size, *gap) for gap in _GAPS], 1)
    probes, pieces = [], {}
    for less, i, j, t in _PROBES:
        moved = [(s, 0 if s < i else t if s < j else less) for s in range(6) if s not in (i, j)]
        for s, shift in moved:
            if (less, s, shift) not in pieces:
                pieces[less, s, shift] = piece(size - less, s, shift)
        probes.append(key([pieces[less, *m] for m in moved], size - less, i, j))
    return indexed, np.stack(probes, 1)


def gap_strings(line: str, slot: int) -> tuple[str, str]:
    """What stands in the two gaps of a slot; gaps that touch are one string, and the second is empty."""
    less, i, j, t = _SLOTS[slot]
    short, longer = divmod(len(line) - less, 6)
    at = lambda s: s * short + max(0, s - (6 - longer))
    if j == i + 1:
        return line[at(i) : at(j + 1) + less], ""
    return line[at(i) : at(i + 1) + t], line[at(j) + t : at(j + 1) + less]


SHORT, LONG, EITHER = 0, 1, 2


def edit_patterns(slot: int, left: str, right: str) -> set[tuple[str, int]]:
    """Patterns of two edits in the gaps of a slot, each with the role of the line in it.

    Lines with one key and one pattern are within two edits: all of EITHER, and each SHORT with each
    LONG. Lines within two edits share a pattern in such roles: where both edits are in one segment, in
    the slots whose gaps touch, else in the slot with one edit in each gap."""
    less, i, j, t = _SLOTS[slot]

    def cut(x: str) -> list[str]:
        return [x[:p] + x[p + 1 :] for p in range(len(x))]

    def masked(x: str, most: int = 1) -> list[str]:
        places = itertools.combinations(range(len(x)), min(most, len(x)))
        return [f"{at}\n" + "".join(c for p, c in enumerate(x) if p not in at) for at in places]

    own = slot < len(_GAPS)
    if j == i + 1:
        if own:
            same = [("two masked", m) for m in masked(left, 2)] + [("one cut", c) for c in cut(left)]
            return {(f"{k}\n{x}", EITHER) for k, x in same} | {(f"cut and masked\n{m}", SHORT) for m in masked(left)} | {(f"two cut\n{left}", SHORT)}
        if less == 1:
            return {(f"cut and masked\n{m}", LONG) for c in cut(left) for m in masked(c)}
        return {(f"two cut\n{x}", LONG) for c in cut(left) for x in cut(c)} if less == 2 else set()
    if own:
        both = {(f"masked, masked\n{x}\n{y}", EITHER) for x in masked(left) for y in masked(right)} | {(f"cut, cut\n{left}\n{y}", EITHER) for y in cut(right)}
        return both | {(f"masked, longer\n{x}\n{right}", SHORT) for x in masked(left)} | {(f"longer, masked\n{left}\n{y}", SHORT) for y in masked(right)} | {(f"longer, longer\n{left}\n{right}", SHORT)}
    if (less, t) == (0, 1):
        return {(f"cut, cut\n{x}\n{right}", EITHER) for x in cut(left)}
    if (less, t) == (1, 0):
        return {(f"masked, longer\n{x}\n{y}", LONG) for x in masked(left) for y in cut(right)}
    if (less, t) == (1, 1):
        return {(f"longer, masked\n{x}\n{y}", LONG) for x in cut(left) for y in masked(right)}
    return {(f"longer, longer\n{x}\n{y}", LONG) for x in cut(left) for y in cut(right)} if (less, t) == (2, 1) else set()


_PATTERN_SLOTS = [n for n in range(len(_SLOTS)) if edit_patterns(n, "ab", "cd")]


_inverses = np.ones(1, np.uint64)


def _inverse(n: int) -> np.ndarray:
    """Powers of the inverse of the base: they shift the hash of a substring to place 0."""
    global _inverses
    step = pow(int(_BASE), -1, 1 << 64)
    while len(_inverses) <= n:
        _inverses = np.concatenate([_inverses, _inverses * np.uint64(pow(step, len(_inverses), 1 << 64))])
    return _inverses


def _names(lines: list[str]) -> np.ndarray:
    """The hash by which lines are known, without the second one."""
    data, offsets = utf8(pa.array(lines, pa.string()))
    return span_hashes(data, offsets[:-1], offsets[1:]).view(np.int64)


def _hashes(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return _names(lines), _second(*utf8(pa.array(lines, pa.string())))


def _second(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """An independent 32-bit hash, a sum of mixed bytes and places; equal lines are told by both hashes."""
    weighted = np.append(np.uint64(0), np.cumsum(mix((data.astype(np.uint64) << np.uint64(40)) + np.arange(len(data), dtype=np.uint64) - np.repeat(offsets[:-1], np.diff(offsets)).astype(np.uint64)), dtype=np.uint64))
    return (mix(weighted[offsets[1:]] - weighted[offsets[:-1]]) >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _split(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Row, number and stripped text of each line that isn't blank."""
    row, number, lines = [], [], []
    for i, text in enumerate(batch.column("text").to_pylist()):
        for j, line in enumerate((text or "").split("\n")):
            if line := line.strip():
                row.append(i)
                number.append(j)
                lines.append(line)
    return np.array(row, np.int64), np.array(number, np.int32), lines


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in blocks(whole):
            row, number, lines = _split(batch)
            if lines:
                h1, h2 = _hashes(lines)
                yield batch_of(_LINES, batch.column("doc_id").to_numpy(zero_copy_only=False)[row], number, np.array([len(x) for x in lines], np.int32), h1, h2)


def _keys(edits: int, min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in blocks(whole):
                lines = list(dict.fromkeys(x for x in _split(batch)[2] if len(x) >= min_chars - edits))
                if lines:
                    h1 = _names(lines)
                    indexed, probes = segment_keys(lines, edits)
                    probes[np.array([len(x) < min_chars for x in lines])] = 0
                    yield batch_of(_KEYS, h1, *(lists(k.ravel().view(np.int64), np.arange(len(lines) + 1) * k.shape[1], pa.int64()) for k in (indexed, probes)))

    return run


def _fine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in blocks(whole, "said", 1 << 18):
            lines = batch.column("said").to_pylist()
            indexed, probes = fine_keys(lines)
            yield batch_of(_FINE, batch.column("h1"), letter_parities(lines), *(lists(k.ravel().view(np.int64), np.arange(len(lines) + 1) * k.shape[1], pa.int64()) for k in (indexed, probes)))


def _wanted(bits: dict[int, int]):
    """The lines whose hash is in the filter."""
    filled = np.zeros(1 << FILTER_BITS - 6, np.uint64)
    for word, value in bits.items():
        filled[word] = value & (1 << 64) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in blocks(whole):
                lines = list(dict.fromkeys(_split(batch)[2]))
                if lines:
                    h1 = _names(lines)
                    at = h1.view(np.uint64) & np.uint64((1 << FILTER_BITS) - 1)
                    hit = np.flatnonzero(filled[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1))
                    yield batch_of(_TEXTS, h1[hit], [lines[i] for i in hit])

    return run


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in filter(len, batches):
        slots, lines = batch.column("slot").to_pylist(), batch.column("said").to_pylist()
        yield batch_of(_SPREAD, batch.column("k"), batch.column("h1"), slots, *zip(*map(gap_strings, lines, slots), strict=True))


def _trims(weight: int):
    """What all lines of a key have in common at the ends of their gaps, for keys with more lines than a line has patterns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = lambda a, b: len(os.path.commonprefix([a, b]))
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                trims, widths = [], []
                for gap in ("left", "right"):
                    start = common(row[f"{gap}_min"], row[f"{gap}_max"])
                    end = min(common(row[f"{gap}_rmin"], row[f"{gap}_rmax"]), row[f"{gap}_least"] - start)
                    trims += [start, end]
                    widths.append(row[f"{gap}_most"] - start - end)
                if row["n"] > weight * ((sum(widths) + 1) ** 2 if row["touching"] else (widths[0] + 1) * (widths[1] + 1)):
                    rows.append((row["k"], *trims))
            yield batch_of(_TRIMS, *(zip(*rows, strict=True) if rows else [[]] * 5))

    return run


def _patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            left, right = r["left"], r["right"]
            left, right = left[r["left_start"] : len(left) - r["left_end"]], right[r["right_start"] : len(right) - r["right_end"]]
            rows += [(r["k"], pattern, role, r["h1"]) for pattern, role in edit_patterns(r["slot"], left, right)]
            if len(rows) > 1 << 14:
                yield batch_of(_PATTERNS, *zip(*rows, strict=True))
                rows = []
        if rows:
            yield batch_of(_PATTERNS, *zip(*rows, strict=True))


def _starred(fine: DataFrame, found: DataFrame, most: int, weight: int) -> tuple[DataFrame, DataFrame] | None:
    """Links (a, b) that join the lines of crowded keys without pairing them, and those keys (k); None if there are none.

    In each pattern a line meets only the least line that it is linked with, so links are as many as
    patterns at most. A key is taken if more than `most` lines are indexed under it, and if its lines are
    more than weight times the patterns of one; other keys make few pairs for each line that probes them."""
    own = fine.select("h1", F.posexplode("indexed").alias("slot", "k")).where("k != 0")
    busy = stored(own.groupBy("k").agg(F.count("*").alias("n")).where(F.col("n") > most), "busy-gaps").select("k")
    if busy.isEmpty():
        return None
    probes = F.array(*(F.struct(F.lit(n).alias("slot"), F.col("probes")[n - len(_GAPS)].alias("k")) for n in _PATTERN_SLOTS if n >= len(_GAPS)))
    members = own.unionByName(fine.select("h1", F.inline(F.filter(probes, lambda x: x["k"] != 0))))
    spread = stored(members.join(busy, "k").join(found, "h1").mapInArrow(_spread, "k long, h1 long, slot int, left string, right string"), "gaps")
    ends = [f(g).alias(f"{c}_{name}") for c in ("left", "right") for f, g, name in ((F.min, c, "min"), (F.max, c, "max"), (F.min, F.reverse(c), "rmin"), (F.max, F.reverse(c), "rmax"), (F.min, F.char_length(c), "least"), (F.max, F.char_length(c), "most"))]
    touching = F.min(F.col("slot").isin([n for n, (_, i, j, _) in enumerate(_SLOTS) if j == i + 1])).alias("touching")
    keys = spread.groupBy("k").agg(F.count("*").alias("n"), touching, *ends)
    keys = stored(keys.mapInArrow(_trims(weight), "k long, left_start int, left_end int, right_start int, right_end int"), "pattern-keys")
    patterns = spread.join(keys, "k").mapInArrow(_patterns, "k long, pattern string, role byte, h1 long")
    patterns = stored(patterns.select(F.xxhash64("k", "pattern").alias("p"), "role", "h1"), "patterns")
    least = patterns.groupBy("p").agg(F.min(F.when(F.col("role") != LONG, F.col("h1"))).alias("short"), F.min(F.when(F.col("role") != SHORT, F.col("h1"))).alias("long"), F.count("*").alias("n")).where("n > 1")
    met = patterns.join(least.drop("n"), "p").select("h1", F.when(F.col("role") == LONG, F.col("short")).otherwise(F.col("long")).alias("other")).where("h1 != other")
    return met.select(F.least("h1", "other").alias("a"), F.greatest("h1", "other").alias("b")).distinct(), keys.select("k")


def _verify(edits: int, min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(a, b, d) for a, b, x, y in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "ta", "tb")), strict=True) if max(len(x), len(y)) >= min_chars and (d := edit_distance(x, y, edits)) <= edits]
            yield batch_of(_LINKS, *(zip(*rows, strict=True) if rows else [[]] * 3))

    return run


def near_lines(documents: DataFrame, edits: int = 2, min_chars: int = 20, most: int = 16, every: bool = True, weight: int = 2) -> DataFrame:
    """Pairs of different lines within `edits` edits, the longer of at least min_chars: a, b (line hashes), distance.

    Lines are stripped; their length and edits are in code points. Each distinct line is joined once,
    however often it stands in the corpus. Lines that share a segment with more than `most` others are
    joined on four of six segments instead, which two edits leave whole, so long lines that are alike in
    one third only don't meet in all pairs. The texts of candidates are fetched through a filter of
    2**25 bits, whose size is fixed: a full filter would fetch more lines than needed, never fewer.
    edits is 0 (no pairs: equal lines are one), 1 or 2; the finer segments are laid out for two.

    Without `every` the links have the same components, but not all pairs are listed: lines that share
    four of six segments with a crowd are grouped by patterns of two edits, as soon as the crowd is
    larger than weight times what a line has of them, and each is linked to one line of its pattern.
    Patterns cover only what differs in the crowd. With one edit all pairs are listed.
    """
    if edits not in (0, 1, 2):
        raise ValueError("edits must be 0, 1 or 2")
    if not edits:
        return documents.sparkSession.createDataFrame([], "a long, b long, distance int")
    keys = documents.mapInArrow(_keys(edits, min_chars), "h1 long, indexed array<long>, probes array<long>")
    keys = stored(keys.groupBy("h1").agg(F.first("indexed").alias("indexed"), F.first("probes").alias("probes")), "segments")
    index = keys.select(F.explode("indexed").alias("k"), F.col("h1").alias("a")).where("k != 0")
    probe = keys.select(F.explode("probes").alias("k"), F.col("h1").alias("b")).where("k != 0")
    busy = stored(index.groupBy("k").agg(F.count("*").alias("n")).where(F.col("n") > most), "busy-segments").select("k")
    crowd = stored(index.join(busy, "k").select(F.col("a").alias("h1")).unionByName(probe.join(busy, "k").select(F.col("b").alias("h1"))).distinct(), "crowd")
    pair = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
    pairs = stored(index.join(busy, "k", "left_anti").join(probe, "k").where("a != b").select(*pair).distinct(), "line-pairs")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("h1")).unionByName(crowd).distinct().withColumn("at", F.col("h1").bitwiseAND((1 << FILTER_BITS) - 1))
    bits = wanted.groupBy(F.shiftright("at", 6).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits"))
    found = documents.mapInArrow(_wanted(dict(bits.collect())), "h1 long, said string")
    found = stored(found.join(wanted.select("h1"), "h1", "left_semi").groupBy("h1").agg(F.min("said").alias("said")), "line-texts")
    if not crowd.isEmpty():
        fine = stored(found.join(crowd, "h1", "left_semi").mapInArrow(_fine, "h1 long, parities long, indexed array<long>, probes array<long>"), "fine-segments")
        side = lambda keys, line, bits: fine.select(F.explode(keys).alias("k"), F.col("h1").alias(line), F.col("parities").alias(bits)).where("k != 0")
        starred = _starred(fine, found, most, weight) if edits == 2 and not every else None
        left = side("indexed", "a", "p")
        near = (left.join(starred[1], "k", "left_anti") if starred else left).join(side("probes", "b", "q"), "k").where(f"a != b and bit_count(p ^ q) <= {2 * edits}")
        pairs = pairs.unionByName(near.select(*pair))
        pairs = (pairs.unionByName(starred[0]) if starred else pairs).distinct()
    both = pairs.join(found.select(F.col("h1").alias("a"), F.col("said").alias("ta")), "a").join(found.select(F.col("h1").alias("b"), F.col("said").alias("tb")), "b")
    return stored(both.mapInArrow(_verify(edits, min_chars), "a long, b long, distance int"), "line-links")


def _clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc_id, text, seen in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "seen")), strict=True):
            lines = (text or "").split("\n") if text else []
            gone = set(seen or ())
            left = "\n".join(x for i, x in enumerate(lines) if i not in gone) if gone else text or ""
            rows.append((doc_id, len(lines), len(gone), sorted(gone), left, hashlib.sha256(left.encode()).hexdigest()))
        yield batch_of(_CLEAN, *(zip(*rows, strict=True) if rows else [[]] * 6))


def repeated_lines(docs: DataFrame, edits: int = 2, min_chars: int = 20) -> DataFrame:
    """doc_id and seen, the numbers of the lines that repeat an earlier one; docs has no null doc_id."""
    seen = stored(docs.mapInArrow(_lines, "doc_id long, line int, chars int, h1 long, h2 int"), "lines")
    links = near_lines(docs, edits, min_chars, every=False)
    near = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    place = F.struct("doc_id", "line")
    first = seen.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("n")).join(near, F.col("h1") == near.node, "left")
    best = first.where("component is not null").groupBy("component").agg(F.min("first").alias("class_first"))
    first = first.where("n > 1 or component is not null").join(best, "component", "left").select("h1", "h2", F.coalesce("class_first", "first").alias("first"))
    again = seen.join(first, ["h1", "h2"]).where(place != F.col("first")).select("doc_id", "line")
    return again.distinct().groupBy("doc_id").agg(F.collect_list("line").alias("seen"))


def dedupe_lines(documents: DataFrame, edits: int = 2, min_chars: int = 20) -> DataFrame:
    """documents without the lines seen before: doc_id, n_lines, n_removed, removed (line numbers), text, kept_sha256.

    Lines are compared stripped. Lines are alike when equal, or when within `edits` edits (0 to 2) and
    the longer has at least min_chars code points; likeness is transitive. Of each class of lines the
    first stays (least doc_id, then line number); all others go. Blank lines stay.

    Null and empty texts have no lines. Rows that repeat a doc_id count as one document. Rows with a
    null doc_id are neither compared nor changed. Other columns are ignored.
    """
    every = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    docs = every.where("doc_id is not null")
    cleaned = docs.join(repeated_lines(docs, edits, min_chars), "doc_id", "left").mapInArrow(_clean, _CLEAN_SQL)
    unknown = every.where("doc_id is null").withColumn("seen", F.lit(None).cast("array<int>"))
    return cleaned.unionByName(unknown.mapInArrow(_clean, _CLEAN_SQL))


def clean_documents(documents: DataFrame, edits: int = 2, min_chars: int = 20, drop_emptied: bool = False) -> DataFrame:
    """documents with the lines that dedupe_lines keeps; rows and columns stay, and a column n_chars is counted anew where a text changed.

    With drop_emptied, a document goes if the removal of lines leaves it blank. Null and empty texts, rows
    with a null doc_id and documents without repeated lines come back as they are; rows that repeat a
    doc_id lose the same lines; columns may have any names and types.
    """
    base = documents.select(F.col("doc_id").cast("long").alias("id"), F.struct(*(named(c) for c in documents.columns)).alias("row"))
    gone = repeated_lines(base.where("id is not null").select(F.col("id").alias("doc_id"), F.coalesce(F.col("row.text").cast("string"), F.lit("")).alias("text")), edits, min_chars)
    out = base.join(gone.withColumnRenamed("doc_id", "id"), "id", "left")
    left = F.array_join(F.filter(F.split("row.text", "\n", -1), lambda x, i: ~F.array_contains("seen", i)), "\n")
    out = out.withColumn("said", F.when(F.size("seen") > 0, left))
    if drop_emptied:
        out = out.where(F.col("said").isNull() | F.col("said").rlike("\\S"))
    new = {"text": F.col("said"), "n_chars": F.char_length("said")}
    kept = lambda c: F.col("row")[c]
    return out.select(*((F.when(F.col("said").isNotNull(), new[c].cast(documents.schema[c].dataType)).otherwise(kept(c)) if c in new else kept(c)).alias(c) for c in documents.columns))
