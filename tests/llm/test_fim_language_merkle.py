"""Fill-in-middle, language identification and the Merkle manifest against brute force and on edge cases."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.test_corpus import ODD, SCHEMA, frame
from wallscan.llm import fim, language, merkle
from wallscan.llm.common import placed, utf8

SIGNS = "abcXYZ zé漢🎉\n\x00@[`{0<PSM>\x7f"


@pytest.fixture(scope="module")
def odd(spark):
    return frame(spark, [*ODD, "one", "again", None], [*range(len(ODD)), 3, None, None])


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def units(text):
    return re.findall(r"[A-Za-z]+|[^A-Za-z]", text, re.S)


def example(doc_id, text):
    text = text or ""
    tokens, h = units(text), hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(tokens)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(x) for x in (tokens[:a], tokens[a:b], tokens[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    spm = h4 % 100 < 20
    return doc_id, n, "spm" if spm else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"


def random_texts(n, most):
    rng = random.Random(n)
    return ["".join(rng.choice(SIGNS) for _ in range(rng.randrange(most))) for _ in range(n)]


def test_examples_as_brute_force(spark):
    texts = ["", "a", "é", "🎉" * 9, "abcdefgh", "abcdefg", "<P>", "a<", "<S", *random_texts(800, 60), *random_texts(3, 20_000)]
    rows = fim.fill_in_middle(frame(spark, texts)).orderBy("doc_id").collect()
    want = [example(i, t) for i, t in enumerate(texts)]
    assert [tuple(r)[:6] for r in rows] == want
    assert [(r.output_sha256, r.restored_sha256) for r in rows] == [(sha(w[5]), sha(t)) for w, t in zip(want, texts, strict=True)]
    assert {r.form for r in rows} == {"plain", "psm", "spm"}
    assert all(fim.restored(r.output.encode(), r.form).decode() == t for r, t in zip(rows, texts, strict=True))


def test_every_cut_is_found():
    """select and code_points at each unit of each text."""
    texts = [t for t in random_texts(60, 50) if t]
    data, offsets = utf8(pa.array(texts))
    words, first = fim.padded_words(data, offsets)
    ends, begins = fim.marks(words, first, np.diff(offsets))
    total, points = (np.cumsum(np.bitwise_count(x), dtype=np.int64) for x in (ends, begins))
    base = np.append(0, total[first[1:] - 1])
    for i, text in enumerate(texts):
        found, one = units(text), np.array([i])
        assert base[i + 1] - base[i] == len(found)
        for k in range(len(found) + 1):
            size = fim.select(ends, total, base[one], first[one], np.array([k]))
            assert size[0] == len("".join(found[:k]).encode())
            assert fim.code_points(begins, points, first[one], size)[0] == len("".join(found[:k]))


def test_examples_on_edge_cases(odd, none):
    rows = fim.fill_in_middle(odd).collect()
    assert sorted((tuple(r)[:6] for r in rows), key=repr) == sorted((example(r.doc_id, r.text) for r in odd.collect()), key=repr)
    assert fim.fill_in_middle(none).count() == 0
    assert all(r.form == "plain" for r in fim.fill_in_middle(odd, rate=0).collect())
    with pytest.raises(ValueError):
        fim.restored(b"text", "psm")


LANGS = {"xa": ["ta", "ro", "mi", "ku"], "xb": ["sch", "ung", "keit", "ver"], "xc": ["eau", "oir", "ment", "é"], "xd": ["漢字", "日本", "語", "学"]}


def spoken(rng, lang, n):
    return " ".join("".join(rng.choice(LANGS[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(2)
    rows = [(i, spoken(rng, lang, rng.randint(1, 60)), lang, "s", 0, "x", 1) for i in range(600) for lang in [rng.choice(list(LANGS))]]
    return spark.createDataFrame(rows, SCHEMA)


def test_kernel_as_sets():
    """The kernel of two texts counts shared n-grams of sets."""
    rng = random.Random(3)
    texts = [spoken(rng, lang, 12) for lang in LANGS for _ in range(3)] + ["", "a", "A a a", "!! 7"]
    sets = [set(language.grams(t).tolist()) for t in texts]
    assert sets[-1] == sets[-4] == set() and sets[-3] < sets[-2]
    assert [set(np.flatnonzero(row).tolist()) for row in language.presence(texts)] == sets
    got = language.kernel(language.presence(texts), language.presence(texts))
    want = [[len(a & b) / max(len(a), 1) ** 0.5 / max(len(b), 1) ** 0.5 for b in sets] for a in sets]
    assert np.allclose(got, want, atol=1e-6)


def test_grams_are_those_of_the_letters():
    """As many n-grams as the folded text has, and none across what isn't a letter but one space."""
    text = "Ab,  cD9é"
    folded = " ab cd é "
    n = sum(len(folded) - k + 1 for k in range(1, language.ORDERS + 1)) - folded.count(" ")
    assert len(language.grams(text)) == n
    assert set(language.grams(text)) == set(language.grams("AB cd -- É!"))


def test_regression_as_brute_force():
    """With all rows as landmarks, Nyström regression is kernel ridge regression in the kernel's own space."""
    rng = random.Random(4)
    langs = [lang for lang in LANGS for _ in range(8)]
    texts = [spoken(rng, lang, 8) for lang in langs]
    rows = language.presence(texts)
    names, coefficients = language.fit(rows, np.array(langs), rows, ridge=1e-2)
    k = language.kernel(rows, rows).astype(float)
    got = k @ coefficients[:-1] + coefficients[-1]
    n = len(rows)
    middle = np.eye(n) - 1 / n
    centred = middle @ k @ middle
    wanted = (np.array(langs)[:, None] == np.array(names)[None, :]).astype(float)
    want = centred @ np.linalg.solve(centred + n * 1e-2 * np.eye(n), middle @ wanted) + wanted.mean(0)
    assert np.allclose(got, want, atol=2e-3)


def test_languages_held_out(corpus):
    rows = language.identify(corpus).join(corpus.select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert len(held) > 100 and sum(r.lang_pred == r.lang for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_only_learned_rows_and_texts_decide(corpus):
    """Other labels on held-out rows, and other ids or languages on scored rows, change nothing."""
    model = language.train(corpus.where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2))
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    changed = corpus.withColumn("lang", F.when(held, "zz").otherwise(F.col("lang")))
    want = {r.doc_id: (r.lang_pred, round(r.score, 6)) for r in language.predict(corpus, model).collect()}
    assert {r.doc_id: (r.lang_pred, round(r.score, 6)) for r in language.identify(changed).collect()} == want
    other = corpus.select((F.col("doc_id") + 10_000).alias("doc_id"), "text")
    assert {r.doc_id - 10_000: (r.lang_pred, round(r.score, 6)) for r in language.predict(other, model).collect()} == want


def test_languages_on_edge_cases(spark, odd, none, corpus):
    model = language.train(corpus)
    rows = language.predict(odd, model).collect()
    assert len(rows) == odd.count()
    text = {r.doc_id: r.text for r in odd.collect() if r.doc_id is not None}
    assert all((r.lang_pred == "und") == (not any(c.isalpha() for c in text[r.doc_id] or "")) and (r.score == 0) == (r.lang_pred == "und") for r in rows if r.doc_id is not None)
    assert language.identify(none).count() == 0
    assert {(r.lang_pred, r.score) for r in language.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {("und", 0.0)}
    assert {r.lang_pred for r in language.identify(odd).collect()} == {"en", "und"}
    crowd = corpus.unionByName(corpus.limit(1).crossJoin(spark.range(2000)).drop("id"))  # one id holds most rows
    learned = language.train(crowd)
    assert learned[0] == sorted(LANGS) and len(learned[1]) == 160


def tree(nodes):
    """All levels of a tree."""
    out = [nodes]
    while len(nodes) > 1:
        nodes = [sha("".join(nodes[i : i + 2])) for i in range(0, len(nodes), 2)]
        out.append(nodes)
    return out


def path(levels, i):
    out = []
    for level in levels[:-1]:
        out.append((i % 2, level[i ^ 1] if i ^ 1 < len(level) else ""))
        i //= 2
    return out


def leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[c] for c in merkle.FIELDS)))


def brute_manifest(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r.lang, []).append(r)
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for name in names:
        groups[name].sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf(r)))
        trees[name] = tree([leaf(r) for r in groups[name]])
    top = tree([trees[n][-1][0] for n in names])
    out = []
    for at, name in enumerate(names):
        for i, r in enumerate(groups[name]):
            steps = path(trees[name], i) + path(top, at)
            tampered = r.doc_id is not None and r.n_chars is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 0
            got = leaf(r.asDict() | {"n_chars": r.n_chars + 1}) if tampered else leaf(r)
            for right, other in steps:
                got = sha(other + got if right else got + other)
            out.append((r.doc_id, leaf(r), trees[name][-1][0], top[-1][0], sha("".join(o for _, o in steps)), got, got == top[-1][0]))
    return sorted(out, key=repr)


def proved(documents, **options):
    changed = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    return sorted((tuple(r) for r in merkle.manifest(documents, claims={"n_chars": changed}, **options).drop("proof").collect()), key=repr)


def told(spark, sizes):
    rng, rows = random.Random(6), []
    for lang, n in sizes.items():
        rows += [(rng.choice([None, *range(10**6)]) if i else None, rng.choice([None, "", "é", "same"]), None if lang == "null" else lang, rng.choice([None, "s"]), rng.choice([None, 5]), "x", 1) for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize(("step", "sizes"), [(2, {"null": 1, "": 2, "a": 37, "b": 64, "é": 65}), (1, {"a": 9}), (3, {"a": 1}), (6, {"a": 130, "b": 1, "c": 3})])
def test_manifest_as_brute_force(spark, step, sizes):
    documents = told(spark, sizes)
    assert proved(documents, step=step) == brute_manifest(documents.collect())


def test_manifest_on_edge_cases(spark, odd, none):
    assert proved(odd) == brute_manifest(odd.collect())
    assert merkle.manifest(none).count() == 0
    same = frame(spark, ["text"] * 300, [7] * 300)  # one row, many times
    assert proved(same, step=3) == brute_manifest(same.collect())


def test_only_some_levels_are_stored_and_proofs_fold(spark, tmp_path):
    documents = told(spark, {"a": 700, "b": 90})
    root = merkle.write_manifest(documents, str(tmp_path / "m"), step=4)
    assert sorted(p.name for p in (tmp_path / "m/levels").iterdir()) == ["level=1", "level=2", "level=3"]
    rows = merkle.read_proofs(spark, str(tmp_path / "m"), step=4).collect()
    assert len(rows) == 790 and all(r.root == root and r.verified and merkle.folded(r.leaf, r.proof) == root for r in rows)
    assert all(merkle.folded(sha(r.leaf), r.proof) != root for r in rows)


def test_places_of_a_crowd(spark):
    """A key with most rows spreads over the partitions, and places stay gapless."""
    rows = spark.range(20_000).select(F.lit("1a").alias("tree"), F.when(F.col("id") < 15_000, 3).otherwise(F.col("id")).alias("doc_id"), F.lit("same").alias("leaf"))
    got = placed(rows, "tree", ["doc_id", "leaf"]).orderBy("pos").collect()
    assert [r.pos for r in got] == list(range(20_000)) and {r.n for r in got} == {20_000}
    assert [r.doc_id for r in got] == sorted(r.doc_id for r in got)
