"""Toxicity scores by a factorization machine over hashed terms.

score = sigmoid(bias + sum of weights + sum over pairs of <factors, factors>), over the distinct
hashed words of a text and the beginnings of its words. The pair terms learn interactions, such as
an insult beside a group, that additive weights miss.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wallscan.llm.common import batch_of, stored, text_or_empty, without

STEM = 4
_MODEL = "is_bias boolean, term long, weight double, factors array<double>"
_FITTED = pa.schema([("is_bias", pa.bool_()), ("term", pa.int64()), ("weight", pa.float64()), ("factors", pa.list_(pa.float64()))])
_SCORES = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


def terms(text: str = "text"):
    """The distinct hashed words of a text, and of the first letters of its words; built-in functions only."""
    found = F.array_distinct(F.split(F.lower(text_or_empty(text)), r"[^\p{L}\p{N}]+"))  # an empty word: the text begins or ends with a sign
    found = F.when(F.exists(found, lambda w: w != ""), found).otherwise(F.array().cast("array<string>"))  # a text without words has no terms
    stems = F.array_distinct(F.transform(found, lambda w: F.substring(w, 1, STEM)))
    return F.concat(F.transform(found, lambda w: F.xxhash64(w)), F.transform(stems, lambda w: F.xxhash64(w, F.lit(STEM))))


def fit_machine(flat: np.ndarray, lengths: np.ndarray, toxic: np.ndarray, rank: int = 4, steps: int = 600, rate: float = 0.3, l1: float = 3e-4, least_rows: int = 3, seed: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Terms, weights, factors and bias by proximal AdaGrad on the log loss; the penalty sets the weights of noise to zero.

    flat holds the terms of all rows, lengths how many each row has. Terms of fewer than least_rows rows
    are left out. Batches hold a fortieth of the rows (32 to 512), and there are at least `steps` of them
    and twelve passes."""
    n_rows = len(lengths)
    order = np.sort(flat)
    first = np.flatnonzero(np.append(True, order[1:] != order[:-1])) if len(order) else np.empty(0, np.int64)
    keys = order[first][np.diff(np.append(first, len(order))) >= least_rows]
    del order
    index = np.minimum(np.searchsorted(keys, flat), max(len(keys) - 1, 0)).astype(np.int32)
    used = keys[index] == flat if len(keys) else np.zeros(len(flat), bool)
    index, row = index[used], np.repeat(np.arange(n_rows, dtype=np.int32), lengths)[used]
    del used
    offsets = np.searchsorted(row, np.arange(n_rows + 1))
    rng = np.random.default_rng(seed)
    w, v, bias = np.zeros(len(keys)), rng.normal(0, 0.02, (len(keys), rank)), 0.0
    gw, gv, gb = np.full(len(keys), 1e-2), np.full((len(keys), rank), 1e-2), 1e-2
    if not len(keys) or len(set(toxic.tolist())) < 2:
        return keys[:0], w[:0], v[:0], 0.0
    batch = int(np.clip(n_rows // 40, 32, 512))
    for _ in range(max(12, -(-steps * batch // n_rows))):
        order = rng.permutation(n_rows)
        for lo in range(0, len(order), batch):
            some = order[lo : lo + batch]
            size = offsets[some + 1] - offsets[some]
            at = np.repeat(offsets[some] - np.append(0, size.cumsum()[:-1]), size) + np.arange(size.sum())
            ix, of = index[at], np.repeat(np.arange(len(some)), size)
            part = v[ix]
            sums = np.stack([np.bincount(of, part[:, f], len(some)) for f in range(rank)], 1)
            square = np.bincount(of, (part**2).sum(1), len(some))
            z = bias + np.bincount(of, w[ix], len(some)) + 0.5 * ((sums**2).sum(1) - square)
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - toxic[some]) / len(some)
            own, back = np.unique(ix, return_inverse=True)
            grad = np.bincount(back, error[of], len(own))
            gw[own] += grad**2
            step = rate / np.sqrt(gw[own])
            new = w[own] - step * grad
            w[own] = np.sign(new) * np.maximum(np.abs(new) - step * l1, 0)
            pull = error[of][:, None] * (sums[of] - part)
            grad = np.stack([np.bincount(back, pull[:, f], len(own)) for f in range(rank)], 1)
            gv[own] += grad**2
            new = v[own] - 0.3 * rate / np.sqrt(gv[own]) * grad
            norm = np.sqrt((new**2).sum(1, keepdims=True))
            v[own] = new * np.maximum(1 - 0.3 * rate / np.sqrt(gv[own].max(1, keepdims=True)) * l1 / np.maximum(norm, 1e-12), 0)
            gb += error.sum() ** 2
            bias -= rate / np.sqrt(gb) * error.sum()
    used = np.flatnonzero((w != 0) | ((v**2).sum(1) > 1e-4))
    return keys[used], w[used], v[used], float(bias)


def train(documents: DataFrame, labels: DataFrame, per_class: int = 6_000, most_terms: int = 100_000, rank: int = 4) -> tuple:
    """Fits on a bounded sample of labelled rows: at most per_class rows of either label, those with the least hash of doc_id.

    The model has at most most_terms terms, those with the largest weights and factors, so it can be
    sent to every task. The bias is corrected for the share of toxic rows among all labels given.
    """
    labels = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    counts = dict(labels.groupBy("toxic").count().collect())
    sides = [labels.where(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for t in (0, 1)]
    chosen = F.broadcast(sides[0].unionByName(sides[1]))  # at most 2 * per_class rows of two numbers
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(chosen, "doc_id").select("toxic", "doc_id", terms().alias("terms"))

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        got = pa.Table.from_batches(got).sort_by("doc_id")
        toxic, found = got["toxic"].to_numpy().astype(np.float64), got["terms"].combine_chunks()
        keys, w, v, bias = fit_machine(found.flatten().to_numpy(), found.value_lengths().to_numpy().astype(np.int64), toxic, rank)
        top = np.argsort(-(np.abs(w) + (v**2).sum(1)), kind="stable")[:most_terms]
        share = np.log(max((toxic == 0).sum(), 1) / max((toxic == 1).sum(), 1))
        yield batch_of(_FITTED, [False] * len(top), keys[top], w[top], list(v[top]))
        yield batch_of(_FITTED, [True], [0], [bias + share], [[0.0] * rank])

    model = stored(rows.repartition(1).mapInArrow(fit, _MODEL), "machine").toPandas()
    prior = np.log(max(counts.get(1, 0), 1) / max(counts.get(0, 0), 1))
    known = model[~model["is_bias"]].sort_values("term")
    bias = float(model[model["is_bias"]]["weight"].sum()) + prior
    factors = np.stack(known["factors"].to_list()) if len(known) else np.zeros((0, rank))
    return known["term"].to_numpy(), known["weight"].to_numpy(), factors, bias


def score(documents: DataFrame, model: tuple) -> DataFrame:
    """doc_id and score in 0..1 for each row of documents; a text without words has the score of the bias."""
    keys, w, v, bias = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 500):  # few rows at a time: a long text has many terms
                batch = whole.slice(lo, 500)
                found = batch.column("terms")
                lengths = found.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                flat = found.flatten().to_numpy(zero_copy_only=False)
                at = np.minimum(np.searchsorted(keys, flat), max(len(keys) - 1, 0))
                hit = np.flatnonzero(keys[at] == flat) if len(keys) else np.empty(0, np.int64)
                row, at, n = np.repeat(np.arange(len(lengths)), lengths)[hit], at[hit], len(lengths)
                sums = np.stack([np.bincount(row, v[at, f], n) for f in range(v.shape[1])], 1)
                z = bias + np.bincount(row, w[at], n) + 0.5 * ((sums**2).sum(1) - np.bincount(row, (v[at] ** 2).sum(1), n))
                yield batch_of(_SCORES, batch.column("doc_id"), 1 / (1 + np.exp(-np.clip(z, -30, 30))))

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), terms().alias("terms")).mapInArrow(run, "doc_id long, score double")


def toxicity(documents: DataFrame, labels: DataFrame, threshold: float = 0.7, **options) -> DataFrame:
    """doc_id, held_out, score and predicted (score >= threshold) for each row of documents.

    Learns from labels (doc_id, toxic 0/1) whose crc32 of the doc_id as text, modulo 3, is not 1; the
    others are held out. Labels without text, null labels and repeated labels (the larger counts)
    are allowed; without labels of both kinds the scores are the prior. Null and empty texts, and those
    without letters and digits, get the score of the bias; repeated rows get equal scores; other columns are ignored.
    """
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    model = train(documents, labels.where(~held), **options)
    scored = score(documents, model)
    return scored.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def drop_toxic(documents: DataFrame, labels: DataFrame, threshold: float = 0.7, **options) -> DataFrame:
    """documents without those predicted toxic; columns stay. Rows with a null doc_id stay."""
    gone = toxicity(documents, labels, threshold, **options).where("predicted = 1").select("doc_id").distinct()
    return without(documents, gone)
