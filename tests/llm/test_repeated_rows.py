"""Rows that repeat a doc_id, a third of all rows under one id, and columns with dots in their names."""

from __future__ import annotations

import collections
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tests.llm.test_corpus import brute_components, frame, prose, words
from wallscan.llm import decontam, linededup, minhash, sharding, substring, toxicity


def test_links_of_repeated_ids(spark):
    """Two near-duplicate documents with 30 rows each are linked once."""
    rng = random.Random(1)
    a = prose(rng, 80)
    b = a + " tano rola"
    other = [prose(rng, 40) for _ in range(20)]
    rows = minhash.near_duplicates(frame(spark, [*[a] * 30, *[b] * 30, *other], [*[5] * 30, *[9] * 30, *range(100, 120)])).collect()
    assert len(rows) == 80
    assert {(r.doc_id, r.n_links, r.component_id, r.kept) for r in rows if r.doc_id < 100} == {(5, 1, 5, True), (9, 1, 5, False)}
    assert all(r.n_links == 0 and r.kept for r in rows if r.doc_id >= 100)


def test_one_text_counts_for_a_repeated_id(spark):
    """Results for an id don't depend on the order of its rows."""
    rng = random.Random(2)
    texts = [prose(rng, 50) for _ in range(6)]
    ids = [1, 1, 2, 3, 3, 4]
    texts[2], texts[5] = texts[0], texts[1]
    first = frame(spark, texts, ids)
    least = {r.doc_id: r.text for r in first.withColumn("h", F.xxhash64("text")).groupBy("doc_id").agg(F.min_by("text", "h").alias("text")).collect()}
    want = brute_components([least.get(i) for i in range(5)], 5, 80)
    for rows in (first, frame(spark, texts[::-1], ids[::-1])):
        got = minhash.near_duplicates(rows).collect()
        assert len(got) == 6 and {(r.doc_id, r.n_shingles, r.component_id) for r in got} == {(i, *want[i]) for i in least}


def brute_passages(rows, width):
    """n_removed and kept words of each row, by its own text."""
    owner = {}
    for i, t in rows:
        w = words(t)
        for j in range(len(w) - width + 1):
            key = tuple(w[j : j + width])
            owner[key] = min(owner.get(key, i), i)
    out = []
    for i, t in rows:
        w = words(t)
        gone = {p for j in range(len(w) - width + 1) if owner[tuple(w[j : j + width])] < i for p in range(j, j + width)}
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(x for p, x in enumerate(w) if p not in gone).encode()).hexdigest()))
    return sorted(out)


def test_passages_of_repeated_ids(spark):
    """Each row of an id loses what smaller ids have, by its own text; a third of all rows has one id."""
    rng = random.Random(3)
    passages = [prose(rng, 30) for _ in range(4)]
    rows = [(rng.choice([7, 7, *range(12)]), " ".join([prose(rng, rng.randint(0, 9)), rng.choice(passages), prose(rng, 5), rng.choice(passages)])) for _ in range(120)]
    rows += rows[:20]
    got = substring.remove_repeated_passages(frame(spark, [t for _, t in rows], [i for i, _ in rows]), width=20).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute_passages(rows, 20)


@pytest.mark.parametrize("hot", [5, None])
def test_shards_of_a_hot_id(spark, hot):
    """1,000 of 3,000 rows have one doc_id; shards stay near equal, and the same rows get the same shards."""
    rng = random.Random(4)
    rows = [(hot if i % 3 == 0 else i, "x" * rng.randint(100, 900) if i % 2 else "same text" * 40) for i in range(3000)]
    documents = frame(spark, [t for _, t in rows], [i for i, _ in rows])
    got = sharding.shard_documents(documents).collect()
    size = collections.Counter()
    for r in got:
        size[r.shard] += r.size
    mean = sum(size.values()) / 24
    assert len(got) == 3000 and len(size) == 24 and max(size.values()) < 1.05 * mean and min(size.values()) > 0.95 * mean
    for shard in range(24):
        slots = sorted(r.slot for r in got if r.shard == shard)
        assert slots == list(range(len(slots)))
    again = sharding.shard_documents(documents.repartition(5, "n_chars")).collect()
    key = lambda rs: sorted((str(r.doc_id), r.size, r.text_crc32, r.shard, r.slot) for r in rs)
    assert key(again) == key(got)


def test_stages_keep_columns_of_any_name(spark):
    rng = random.Random(5)
    documents = frame(spark, [prose(rng, 30) for _ in range(8)] + [None, ""]).select(F.lit(1).alias("meta.x"), "text", "doc_id", F.lit("y").alias("a`b"), "lang", "source", "n_chars", "_lines", "bucket")
    labels = spark.createDataFrame([(i, i % 2) for i in range(8)], "doc_id long, toxic int")
    benchmark = spark.createDataFrame([(1, prose(rng, 20))], "item_id long, text string")
    for kept in (toxicity.drop_toxic(documents, labels), linededup.clean_documents(documents), minhash.drop_near_duplicates(documents), decontam.drop_contaminated(documents, benchmark)):
        assert kept.columns == documents.columns
        assert all(r["meta.x"] == 1 and r["a`b"] == "y" for r in kept.collect())
