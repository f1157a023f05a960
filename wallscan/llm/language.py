"""Language identification with string kernels.

The kernel of two texts counts the character n-grams, of one to ORDERS letters, that both contain
(blended spectrum, presence only), divided by the geometric mean of their own counts. N-grams are hashed
into BUCKETS places, so a text is a row of bits and the kernel a matrix product. A bounded number of
landmark texts spans the Nyström space; kernel ridge regression, one language against the rest, is
solved there. Documents are scored in batches: bits times landmarks, times coefficients.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wallscan.llm.common import batch_of, stored

ORDERS = 4
BUCKETS = 1 << 14
UNKNOWN = "und"
_BITS = pa.schema([("lang", pa.string()), ("rank", pa.int64()), ("bits", pa.binary())])
_FITTED = pa.schema([("landmark", pa.int64()), ("bits", pa.binary()), ("langs", pa.list_(pa.string())), ("coefficients", pa.list_(pa.float64()))])
_SCORES = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])


@functools.cache
def _letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def letters_of(text: str) -> np.ndarray:
    """The text in lower case as code points, a space for each run of what isn't a letter, and at both ends."""
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[points]
    keep = letter.copy()
    keep[0] = True
    keep[1:] |= letter[:-1]
    return np.where(letter, points, np.uint32(32))[keep]


def grams(text: str) -> np.ndarray:
    """The buckets of all n-grams of a text, with repeats; none where it has no letter. A space alone is no n-gram."""
    points = letters_of(text)
    if len(points) < 2:
        return np.empty(0, np.uint32)
    out, rolled = [], np.zeros(len(points) + 1, np.uint32)
    for order in range(1, ORDERS + 1):
        if len(points) < order:
            break
        rolled = rolled[:-1] * np.uint32(0x01000193) + points[order - 1 :]
        mixed = (rolled ^ (rolled >> np.uint32(15))) * np.uint32(0x9E3779B1 + 2 * order)
        out.append((mixed >> np.uint32(32 - BUCKETS.bit_length() + 1))[(points != 32) if order == 1 else slice(None)])
    return np.concatenate(out)


def presence(texts: list[str]) -> np.ndarray:
    """A row of zeros and ones for each text."""
    out = np.zeros((len(texts), BUCKETS), np.float32)
    for row, text in zip(out, texts, strict=True):
        row[grams(text)] = 1
    return out


def kernel(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The normalised kernel of two sets of rows of zeros and ones; a row without ones has none."""
    norms = [1 / np.sqrt(np.maximum(x.sum(1), 1)) for x in (a, b)]
    return (a @ b.T) * norms[0][:, None] * norms[1][None, :]


def fit(rows: np.ndarray, lang: np.ndarray, landmarks: np.ndarray, ridge: float = 1e-3) -> tuple[list[str], np.ndarray]:
    """Languages in order, and coefficients (landmark, language) of the kernel with the landmarks; the last row is the intercept.

    The Nyström features of a text are its kernel with the landmarks times the inverse root of the
    landmarks' own kernel; each language is regressed, as 1 against 0, on the centred features."""
    langs, of = np.unique(lang, return_inverse=True)
    values, vectors = np.linalg.eigh(kernel(landmarks, landmarks).astype(np.float64))
    some = values > 1e-6 * max(values.max(initial=0), 1e-12)
    root = vectors[:, some] / np.sqrt(values[some])
    features = np.concatenate([kernel(rows[i : i + 256], landmarks).astype(np.float64) @ root for i in range(0, len(rows), 256)])
    wanted = (of[:, None] == np.arange(len(langs))[None, :]).astype(np.float64)
    weight = 1 / np.bincount(of)[of]  # every language counts the same
    weight /= weight.sum()
    middle, share = weight @ features, weight @ wanted
    centred = features - middle
    gram = (centred * weight[:, None]).T @ centred + ridge * np.eye(features.shape[1])
    slope = np.linalg.solve(gram, (centred * weight[:, None]).T @ (wanted - share))
    return langs.tolist(), np.concatenate([root @ slope, (share - middle @ slope)[None, :]])


def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for lo in range(0, whole.num_rows, 64):
            batch = whole.slice(lo, 64)
            packed = np.packbits(presence(batch.column("text").to_pylist()).astype(bool), axis=1)
            yield batch_of(_BITS, batch.column("lang"), batch.column("rank"), [row.tobytes() for row in packed])


def _unpacked(column: list[bytes]) -> np.ndarray:
    return np.unpackbits(np.frombuffer(b"".join(column), np.uint8).reshape(len(column), -1), axis=1).astype(np.float32)


def _fitted(landmarks: int, ridge: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        got = pa.Table.from_batches(got).sort_by([("rank", "ascending"), ("lang", "ascending")])
        packed = got["bits"].to_pylist()
        first = packed[:landmarks]  # by rank, so all languages have as many, if they have them
        langs, coefficients = fit(_unpacked(packed), np.array(got["lang"].to_pylist(), object).astype(str), _unpacked(first), ridge)
        yield batch_of(_FITTED, list(range(len(coefficients))), [*first, b""], [langs] * len(coefficients), list(coefficients))

    return run


def train(documents: DataFrame, most_rows: int = 1_600, landmarks: int = 160, ridge: float = 1e-3) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, landmarks (rows of zeros and ones) and coefficients, from documents (doc_id, text, lang).

    Fits on a bounded sample: at most most_rows documents, as many of each language, those with the least
    hash of doc_id; the first of them are the landmarks. Whole texts become bits in many tasks, and one task
    gets the bits. The number of languages is taken to be far below most_rows; each has a column of the model.
    Rows that repeat a doc_id and a language count once, with the least text. Null ids, languages and
    texts, and texts without letters, teach nothing.
    """
    known = documents.where("doc_id is not null and lang is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    counts = known.groupBy("lang").agg(F.count("*").alias("n"))
    per_lang = counts.select((F.lit(most_rows) / F.greatest(F.count("*").over(Window.partitionBy()), F.lit(1))).cast("int").alias("most"), "lang", "n")  # a row for each language
    # About four times as many as are wanted, by their hash, so that no task ranks all documents of a language.
    hashed = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / (1 << 30)
    some = known.join(F.broadcast(per_lang), "lang").where(hashed <= 4 * F.greatest("most", F.lit(8)) / F.col("n")).where(F.col("text").rlike("\\p{L}"))
    one = some.groupBy("lang", "doc_id", "most").agg(F.min("text").alias("text"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")).cast("long")
    chosen = one.withColumn("rank", rank).where("rank <= greatest(most, 1)").select("lang", "rank", "text")
    model = stored(chosen.mapInArrow(_bits, "lang string, rank long, bits binary").repartition(1).mapInArrow(_fitted(landmarks, ridge), "landmark long, bits binary, langs array<string>, coefficients array<double>"), "languages")
    rows = model.orderBy("landmark").collect()  # landmarks + 1 rows
    if not rows:
        return [], np.zeros((0, BUCKETS), np.float32), np.zeros((1, 0))
    return rows[0].langs, _unpacked([bytes(r.bits) for r in rows[:-1]]), np.array([r.coefficients for r in rows])


def _predict(model: tuple[list[str], np.ndarray, np.ndarray]):
    langs, landmarks, coefficients = model
    packed = np.packbits(landmarks.astype(bool), axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        side = np.unpackbits(packed, axis=1).astype(np.float32)
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                batch = whole.slice(lo, 256)
                rows = presence([t or "" for t in batch.column("text").to_pylist()])
                some = rows.any(1) if langs else np.zeros(len(rows), bool)
                values = kernel(rows, side).astype(np.float64) @ coefficients[:-1] + coefficients[-1] if langs else np.zeros((len(rows), 1))
                best = values.argmax(1)
                sure = np.maximum(values, 0)
                score = np.take_along_axis(sure, best[:, None], 1)[:, 0] / np.maximum(sure.sum(1), 1e-12)
                yield batch_of(_SCORES, batch.column("doc_id"), [langs[b] if s else UNKNOWN for b, s in zip(best.tolist(), some, strict=True)], np.where(some, np.clip(score, 0, 1), 0.0))

    return run


def predict(documents: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray]) -> DataFrame:
    """doc_id, lang_pred and score of each row of documents (doc_id long, text); only the text decides."""
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_predict(model), "doc_id long, lang_pred string, score double")


def identify(documents: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, lang_pred and score of each row of documents (doc_id long, text, lang).

    Learns from rows whose crc32 of the doc_id as text, modulo 4, is not 2; the others are held out. The
    score is the share of the best language in the positive parts of all regressions, 0 to 1. Null texts
    and texts without a letter (of any script) get `und` with score 0, as do all texts where nothing could
    be learned. Ties go to the language that sorts first. Repeated rows get equal rows; a null doc_id is never
    held out; texts of any length are read whole; other columns are ignored; no rows give no rows.
    """
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return predict(documents, train(documents.where(~held), **options)).select("doc_id", held.alias("held_out"), "lang_pred", "score")
