"""Fill-in-middle examples, cut between units by SWAR select over the UTF-8 bytes.

A unit is a run of ASCII letters or one other code point. The bytes of each text are viewed as
unsigned 64-bit words. Bit arithmetic marks, in eight bytes at once, those that end a unit;
bitwise_count gives the marks of each word and their running sum those of all words before. To find
the k-th end, the running sum is searched for its word, and a prefix sum of the word's eight marks, by
one multiplication, gives the byte. No text is split into units.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wallscan.llm.common import batch_of, blocks, text_or_empty, utf8

#: Fixed values of the output format: what stands before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"

_ONES = np.uint64(0x0101010101010101)
_HIGH = np.uint64(0x8080808080808080)
_LOW = np.uint64(0x7F7F7F7F7F7F7F7F)
_CASE = np.uint64(0x2020202020202020)
_EXAMPLES = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.binary()), ("output_sha256", pa.string()), ("restored_sha256", pa.string())])


def padded_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of each text as 64-bit words, at least one zero byte after each, and where each text's words begin (one more at the end)."""
    sizes = np.diff(offsets)
    first = np.append(0, np.cumsum(sizes // 8 + 1))
    out = np.zeros(int(first[-1]) * 8, np.uint8)
    for i in range(len(sizes)):
        out[first[i] * 8 : first[i] * 8 + sizes[i]] = data[offsets[i] : offsets[i + 1]]
    return out.view("<u8").astype(np.uint64, copy=False), first


def _next(marks: np.ndarray) -> np.ndarray:
    """The marks of the byte after each byte."""
    out = marks >> np.uint64(8)
    out[:-1] |= marks[1:] << np.uint64(56)
    return out


def marks(words: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two marks, each the high bit of a byte: bytes that end a unit, and bytes that begin a code point."""
    inner = words & ~(words << np.uint64(1)) & _HIGH  # 10xxxxxx; bit 6 of a byte comes to bit 7 of the same
    lower = words | _CASE
    letter = ((lower & _LOW) + np.uint64(0x80 - ord("a")) * _ONES) & ~((lower & _LOW) + np.uint64(0x80 - ord("z") - 1) * _ONES) & ~words & _HIGH
    ends = ~(_next(inner) | (letter & _next(letter))) & _HIGH
    begins = ~inner & _HIGH
    last = first[1:] - 1  # the word with a text's zero bytes
    used = (np.uint64(1) << (np.uint64(8) * (sizes % 8).astype(np.uint64))) - np.uint64(1)
    ends[last] &= used
    begins[last] &= used
    return ends, begins


def select(ends: np.ndarray, total: np.ndarray, base: np.ndarray, start: np.ndarray, k: np.ndarray) -> np.ndarray:
    """How many bytes the first k units of each text have. total: marks up to and with each word; base: marks before each text; start: its first word."""
    wanted = base + k
    at = np.searchsorted(total, wanted)
    at = np.minimum(at, len(ends) - 1)
    rank = wanted - (total[at] - np.bitwise_count(ends[at]))  # from 1 to 8 within the word
    sums = (ends[at] >> np.uint64(7)) * _ONES  # byte i: marks of bytes 0 to i
    reached = ((sums | _HIGH) - rank.astype(np.uint64) * _ONES) & _HIGH
    return np.where(k > 0, (at - start) * 8 + 9 - np.bitwise_count(reached), 0)


def code_points(begins: np.ndarray, total: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """How many code points begin in the first `size` bytes of each text."""
    at = start + size // 8
    part = begins[at] & ((np.uint64(1) << (np.uint64(8) * (size % 8).astype(np.uint64))) - np.uint64(1))
    before = total[at] - np.bitwise_count(begins[at])
    return before - (total[start] - np.bitwise_count(begins[start])) + np.bitwise_count(part)


def restored(output: bytes, form: str) -> bytes:
    """The text of an example, from its output and form. No text with a mark inside gets a form with marks, and marks can't overlap, so the first ones found are those put there."""
    if form == "plain":
        return output
    marks_of = {"psm": (PREFIX, SUFFIX, MIDDLE), "spm": (SUFFIX, PREFIX, MIDDLE)}[form]
    if not output.startswith(marks_of[0]):
        raise ValueError(f"not an example of form {form}")
    one, rest = output[len(marks_of[0]) :].split(marks_of[1], 1)
    two, middle = rest.split(marks_of[2], 1)
    return one + middle + two if form == "psm" else two + middle + one


def _examples(seed: str, rate: int, spm_rate: int, texts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in blocks(whole):
                data, offsets = utf8(batch.column("text"))
                sizes, raw = np.diff(offsets), data.tobytes()
                words, first = padded_words(data, offsets)
                ends, begins = marks(words, first, sizes)
                total, points = np.cumsum(np.bitwise_count(ends), dtype=np.int64), np.cumsum(np.bitwise_count(begins), dtype=np.int64)
                start = first[:-1]
                base = np.append(0, total[first[1:] - 1])
                n = np.diff(base)
                ids = batch.column("doc_id").to_pylist()
                h = np.array([struct.unpack(">4I", hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).digest()[:16]) for i in ids], np.int64).reshape(-1, 4)
                cuts = np.sort(h[:, :2] % (n[:, None] + 1), 1)
                a, b = (select(ends, total, base[:-1], start, cuts[:, i]) for i in (0, 1))
                n_a, n_b = (code_points(begins, points, start, x) for x in (a, b))
                rows = []
                for i in range(len(ids)):
                    text = raw[offsets[i] : offsets[i + 1]]
                    if not text or h[i, 2] % 100 >= rate or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)):
                        form, output = "plain", text
                    elif h[i, 3] % 100 < spm_rate:
                        form, output = "spm", b"".join((SUFFIX, text[b[i] :], PREFIX, text[: a[i]], MIDDLE, text[a[i] : b[i]]))
                    else:
                        form, output = "psm", b"".join((PREFIX, text[: a[i]], SUFFIX, text[b[i] :], MIDDLE, text[a[i] : b[i]]))
                    plain = form == "plain"
                    rows.append((form, None if plain else n_a[i], None if plain else n_b[i] - n_a[i], output if texts else None, hashlib.sha256(output).hexdigest(), hashlib.sha256(restored(output, form)).hexdigest()))
                yield batch_of(_EXAMPLES, batch.column("doc_id"), n, *(zip(*rows, strict=True) if rows else [[]] * 6))

    return run


def fill_in_middle(documents: DataFrame, seed: str = "1", rate: int = 90, spm_rate: int = 20, texts: bool = True) -> DataFrame:
    """A fill-in-middle example of each row of documents (doc_id long, text).

    Returns doc_id, n (units of the text: runs of ASCII letters and other code points), form (plain, psm or
    spm), prefix_chars, middle_chars (code points; null where plain), output (the example; null where texts is
    false), output_sha256 and restored_sha256 (of the text that `restored` rebuilds from output and form).

    Cuts and form follow from the hash of seed, ':' and doc_id alone, so repeated rows get equal examples
    and a rerun the same ones. rate of 100 documents are transformed, of these spm_rate of 100 with the
    suffix first. Null and empty texts, and texts that contain a mark, stay plain. A null doc_id hashes as
    an empty one. Texts of any length are cut whole; other columns are ignored; no rows give no rows.
    """
    schema = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output binary, output_sha256 string, restored_sha256 string"
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(_examples(seed, rate, spm_rate, texts), schema).withColumn("output", F.col("output").cast("string"))
