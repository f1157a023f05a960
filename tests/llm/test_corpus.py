"""Operators of wallscan.llm against brute force, on edge cases, and on exact round trips."""

from __future__ import annotations

import collections
import functools
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wallscan.llm import chat, decontam, linededup, minhash, packing, sharding, spotsigs, substring, tokenfile, toxicity
from wallscan.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _lines string, bucket int"
WORDS = [a + b for a in ("ta", "ro", "mi", "ku", "sel", "ven", "dar") for b in ("no", "la", "rek", "ti", "mon", "ze", "ush")]


def frame(spark, texts, ids=None):
    """Documents with columns whose names the operators use inside."""
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", 1) for i, t in zip(ids, texts)], SCHEMA)


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


ODD = [None, "", "   ", "one", "one", "x" * 50_000, "\n\n\n", "é ü ß 日本 語", "a\x1cb\x85c \xa0d", "same line of text here\nsame line of text here", "word " * 6000, "<|im_end|><|endoftext|>"]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, very long and repeated texts, a repeated id and null ids."""
    return frame(spark, [*ODD, "one", "again", None], [*range(len(ODD)), 3, None, None])


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0d]+", text or "")


def near_corpus():
    rng, out = random.Random(4), []
    for _ in range(12):
        base = prose(rng, rng.randint(12, 120)).split()
        for _ in range(9):
            copy = list(base)
            for _ in range(rng.randint(0, 6)):
                copy[rng.randrange(len(copy))] = rng.choice(WORDS)
            out.append(" ".join(copy))
    rng.shuffle(out)
    return [*out, "tano", "tano", "TANO rola", "tano rola", ""]


def brute_components(texts, k, percent):
    sets = {}
    for i, t in enumerate(texts):
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        shared = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * shared >= percent * (len(sets[a]) + len(sets[b]) - shared):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates(spark, k):
    texts = near_corpus()
    rows = minhash.near_duplicates(frame(spark, texts), k=k).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == brute_components(texts, k, 80)
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def test_near_duplicates_of_a_crowd(spark):
    """Many copies of one text with more and more edits: most are linked with no other."""
    rng = random.Random(8)
    base, texts = prose(rng, 100).split(), []
    for i in range(1000):
        copy = list(base)
        for at in rng.sample(range(100), i % 12):
            copy[at] = f"w{rng.randrange(60)}"
        texts.append(" ".join(copy))
    rows = minhash.near_duplicates(frame(spark, texts), k=4).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == brute_components(texts, 4, 80)


def test_near_duplicates_edge_cases(odd, none):
    rows = minhash.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    assert {r.component_id for r in rows if r.doc_id in (3, 4)} == {3}
    assert all(r.kept for r in rows if r.n_shingles == 0)
    assert minhash.near_duplicates(none).count() == 0
    kept = minhash.drop_near_duplicates(odd)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == {None, *range(len(ODD))} - {4}


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 80)] + [(rng.randrange(2000, 2100), rng.randrange(2000, 2100)) for _ in range(60)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for e in edges for x in e if e[0] != e[1]}


def test_edit_distance():
    rng = random.Random(2)

    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(row[-1] + 1, old[j] + 1, old[j - 1] + (x != y)))
        return row[-1]

    for _ in range(3000):
        a = "".join(rng.choice("abc") for _ in range(rng.randint(0, 14)))
        b = list(a)
        for _ in range(rng.randint(0, 4)):
            at = rng.randint(0, len(b))
            b[at : at + rng.randint(0, 1)] = [rng.choice("abcd")] * rng.randint(0, 1)
        b = "".join(b)
        for most in (0, 1, 2, 3):
            assert linededup.edit_distance(a, b, most) == min(plain(a, b), most + 1), (a, b, most)


def line_corpus(n=60):
    rng, lines = random.Random(3), []
    for _ in range(n):
        base = prose(rng, rng.randint(3, 30))
        for _ in range(rng.randint(1, 6)):
            line = list(base)
            for _ in range(rng.randint(0, 4)):
                at = rng.randrange(len(line))
                line[at : at + rng.randint(0, 1)] = [rng.choice("abcdeü")] * rng.randint(0, 1)
            lines.append("".join(line).strip())
    return lines


@pytest.mark.parametrize("most", [16, 0])
def test_near_lines(spark, most):
    """Every pair within two edits is found, by the segments and by the finer ones (most=0)."""
    lines = line_corpus()
    found = linededup.near_lines(frame(spark, ["\n".join(lines[i : i + 5]) for i in range(0, len(lines), 5)]), most=most).collect()
    names = dict(zip(linededup._hashes(lines)[0].tolist(), lines))
    got = {frozenset((names[r.a], names[r.b])) for r in found}
    want = {frozenset((a, b)) for a, b in itertools.combinations(sorted(set(lines)), 2) if max(len(a), len(b)) >= 20 and linededup.edit_distance(a, b, 2) <= 2}
    assert got == want and len(want) > 30


def test_dedupe_lines(spark):
    lines = line_corpus(30)
    rng = random.Random(5)
    texts = ["\n".join(rng.choice([*lines, "", " "]) for _ in range(rng.randint(1, 8))) for _ in range(60)]
    distinct = sorted({x.strip() for t in texts for x in t.split("\n")} - {""})
    root = {x: x for x in distinct}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(distinct, 2):
        if max(len(a), len(b)) >= 20 and linededup.edit_distance(a, b, 2) <= 2:
            root[find(a)] = find(b)
    first, want = {}, {}
    for i, t in enumerate(texts):
        left = []
        for j, line in enumerate(t.split("\n")):
            key = find(line.strip()) if line.strip() else None
            if key is None or first.setdefault(key, (i, j)) == (i, j):
                left.append(line)
        want[i] = "\n".join(left)
    docs = frame(spark, texts)
    rows = linededup.dedupe_lines(docs).collect()
    assert {r.doc_id: r.text for r in rows} == want
    assert all(r.kept_sha256 == hashlib.sha256(r.text.encode()).hexdigest() for r in rows)
    cleaned = linededup.clean_documents(docs)
    assert cleaned.columns == docs.columns and {r.doc_id: (r.text, r.n_chars) for r in cleaned.collect()} == {i: (t, len(t)) for i, t in want.items()}


def test_line_edge_cases(spark, odd, none):
    rows = linededup.dedupe_lines(odd).collect()
    assert len(rows) == odd.count() and linededup.dedupe_lines(none).count() == 0
    assert next(r for r in rows if r.doc_id == 9).text == "same line of text here"
    assert next(r for r in rows if r.doc_id == 4).text == ""
    assert linededup.clean_documents(odd).count() == odd.count()


def test_clean_documents_of_any_columns(spark):
    """Columns named like those used inside come back with their values; n_chars keeps its type."""
    said = ["first line of the text\nsecond line of the text", "first line of the text\na line of its own", None, ""]
    rows = [(i, t, len(t or ""), f"seen{i}", [f"line{i}"], i * 10, f"gone{i}", {"a": i}) for i, t in enumerate(said)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, n_chars int, seen string, _lines array<string>, id long, `said so` string, row map<string,int>")
    got = linededup.clean_documents(docs)
    assert got.schema.simpleString() == docs.schema.simpleString()
    want = [(*r[:1], "a line of its own", 17, *r[3:]) if r[0] == 1 else r for r in rows]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


@pytest.mark.parametrize("edits", [0, 1])
def test_near_lines_of_fewer_edits(spark, edits):
    lines = line_corpus()
    for most in (16, 0):
        found = linededup.near_lines(frame(spark, ["\n".join(lines[i : i + 5]) for i in range(0, len(lines), 5)]), edits=edits, most=most).collect()
        names = dict(zip(linededup._hashes(lines)[0].tolist(), lines))
        want = {frozenset((a, b)) for a, b in itertools.combinations(sorted(set(lines)), 2) if max(len(a), len(b)) >= 20 and linededup.edit_distance(a, b, edits) <= edits}
        assert {frozenset((names[r.a], names[r.b])) for r in found} == want
    with pytest.raises(ValueError):
        linededup.near_lines(frame(spark, lines), edits=3)


def repeat_corpus():
    rng = random.Random(6)
    passages = [prose(rng, n) for n in (50, 55, 70, 130, 20)]
    texts = []
    for _ in range(80):
        parts = [prose(rng, rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            parts += [rng.choice(passages), prose(rng, rng.randint(0, 40))]
        texts.append(rng.choice([" ", "\n", "\t "]).join(parts))
    return texts + texts[:5]


def brute_repeats(texts, width=50):
    owner, out = {}, {}
    for i, t in enumerate(texts):
        w = words(t)
        for j in range(len(w) - width + 1):
            owner.setdefault(tuple(w[j : j + width]), i)
    for i, t in enumerate(texts):
        w = words(t)
        gone = set()
        for j in range(len(w) - width + 1):
            if owner[tuple(w[j : j + width])] < i:
                gone |= set(range(j, j + width))
        out[i] = (len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone))
    return out


@pytest.mark.parametrize("width", [50, 7])
def test_repeated_passages(spark, width):
    texts = repeat_corpus()
    rows = substring.remove_repeated_passages(frame(spark, texts).repartition(7), width).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in rows} == brute_repeats(texts, width)
    assert all(r.kept_sha256 == hashlib.sha256(r.kept_text.encode()).hexdigest() for r in rows)


def test_repeated_passages_edge_cases(odd, none):
    rows = substring.remove_repeated_passages(odd).collect()
    assert len(rows) == odd.count() and substring.remove_repeated_passages(none).count() == 0
    assert all(r.n_removed == 0 for r in rows if r.doc_id is None)


def benchmark_of(rng, n=40):
    return [(i, prose(rng, rng.randint(12, 60))) for i in range(n)] + [(n, "too short"), (n + 1, None), (n, "too short")]


def test_contaminated(spark):
    """Recall against the exact word edit distance of every item to every place."""
    rng = random.Random(9)
    items = benchmark_of(rng)
    texts = []
    for i in range(160):
        w = words(items[i % 40][1])
        for _ in range(rng.randint(0, int(0.2 * len(w)))):
            at = rng.randrange(len(w))
            w[at : at + rng.randint(0, 1)] = [f"q{rng.randrange(999)}"] * rng.randint(0, 1)
        texts.append(prose(rng, 30) + ". " + " ".join(w).upper() + ", " + prose(rng, 30))
    texts += [prose(rng, 200) for _ in range(40)]
    rows = decontam.contaminated(frame(spark, texts), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = {}
    for i, t in enumerate(texts):
        region = words(t.lower().replace(".", " ").replace(",", " "))
        for k, item in items[:40]:
            best, _ = decontam.infix_distance(words(item), region)
            if best <= int(0.2 * len(words(item))):
                want[i, k] = best
    got = {(r.doc_id, r.item_id): r.edits for r in rows}
    assert set(got) <= set(want) and all(r.edits <= 0.2 * r.n_item_words for r in rows)
    assert len(want) >= 150 and len(set(got) & set(want)) >= 0.97 * len(want)


def test_contaminated_beside_richer_places(spark):
    """An item at its limit of edits is found also where other items or parts of them follow or precede it."""
    rng = random.Random(21)
    items = [(i, " ".join(f"w{rng.randrange(5000)}" for _ in range(40))) for i in range(60)]
    texts = []
    for i in range(60):
        w, other, third = (words(items[(i + d) % 60][1]) for d in (0, 1, 2))
        for k in range(8):
            w[2 + 5 * k] = f"q{k}"
        texts.append(" ".join([[*w, *other], [*w, *other[:20]], [*third[20:], *w], [*other, *w, *third]][i % 4]))
    rows = decontam.contaminated(frame(spark, texts), spark.createDataFrame(items, "item_id long, text string")).collect()
    got = {(r.doc_id, r.item_id) for r in rows}
    for kind in range(4):
        assert sum((i, i) in got for i in range(kind, 60, 4)) >= 12, kind
    assert len(rows) == len(got)


def test_contaminated_at_the_limit(spark):
    """Recall for items of 20 to 300 words with exactly the allowed number of edits."""
    rng = random.Random(33)
    items, texts = [], []
    for i in range(180):
        n = (20, 40, 60, 100, 200, 300)[i % 6]
        w = [f"w{rng.randrange(9000)}" for _ in range(n)]
        items.append((i, " ".join(w)))
        for k in range(n // 5):
            at, kind = rng.randrange(len(w)), rng.randrange(3)
            w[at : at + (kind != 1)] = [f"q{k}"] * (kind != 2)
        texts.append(prose(rng, 30) + " " + " ".join(w) + " " + prose(rng, 30))
    rows = decontam.contaminated(frame(spark, texts), spark.createDataFrame(items, "item_id long, text string")).collect()
    got = {(r.doc_id, r.item_id) for r in rows}
    for kind in range(6):
        assert sum((i, i) in got for i in range(kind, 180, 6)) >= 28, kind
    assert sum((i, i) in got for i in range(180)) >= 0.97 * 180


def test_infix_distance():
    rng = random.Random(12)
    for _ in range(500):
        item, region = ([rng.randrange(4) for _ in range(rng.randint(lo, 9))] for lo in (1, 0))
        row = [0] * (len(region) + 1)
        for i, x in enumerate(item, 1):
            row, old = [i], row
            for j, y in enumerate(region, 1):
                row.append(min(row[-1] + 1, old[j] + 1, old[j - 1] + (x != y)))
        assert decontam.infix_distance(item, region)[0] == min(row)


def test_contaminated_edge_cases(spark, odd, none):
    items = spark.createDataFrame(benchmark_of(random.Random(1)), "item_id long, text string")
    assert decontam.contaminated(odd, items).count() == 0 and decontam.contaminated(none, items).count() == 0
    assert decontam.contaminated(odd, items.limit(0)).count() == 0
    assert decontam.drop_contaminated(odd, items).count() == odd.count()


def conversation_rows():
    said = "<|im_end|><|im_start|>assistant ok"
    return [(1, 0, "user", "hi"), (1, 1, "assistant", said), (2, 1, "assistant", None), (2, 0, "user", "a\\|b<\\|c\\n"), (2, 1, "assistant", "<|<|\\\\"), (None, 0, None, "x"), (3, 0, "ro\nle<|", ""), *((4, i, "assistant" if i % 2 else "user", f"turn {i}\n") for i in range(130))]


def test_chat_round_trip(spark):
    rows = conversation_rows()
    df = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn int, role string, text string, formatted string")
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    want = collections.defaultdict(list)
    for c, _, role, text in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2] or "", r[3] is not None, r[3] or "")):
        want[c].append((role or "", text or ""))
    assert set(got) == set(want)
    for c, turns in want.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert got[c].n_turns == len(turns) and got[c].loss_chars == len(loss)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_template_that_rewrites_history(spark):
    def numbered(turns):
        return f"{len(turns)} turns\n" + "".join(t for _, t in turns)

    df = spark.createDataFrame(conversation_rows(), "conv_id long, turn int, role string, text string")
    rows = chat.format_conversations(df, numbered).collect()
    assert all(r.rewrites_history == (r.n_turns > 1) for r in rows)
    assert all(not r.loss_spans for r in rows if r.rewrites_history)


def test_templates_that_rewrite_long_histories():
    """Templates that forget or change early turns after many turns are reported; one that doesn't is located whole."""

    def sliding(turns):
        return chat.chatml(turns[-64:])

    def remarked(turns):
        return ("long\n" if len(turns) > 100 else "short\n") + chat.chatml(turns)

    turns = [("assistant" if i % 2 else "user", f"turn {i}") for i in range(130)]
    for template in (sliding, remarked):
        assert chat.located(template, turns) == (template(turns), [], [], True)
        assert not chat.located(template, turns[:60])[3]
    text, ends, spans, rewrites = chat.located(chat.chatml, turns)
    assert text == chat.chatml(turns) and not rewrites and ends[-1] == len(text)
    assert [text[a:b] for a, b in spans] == [t for _, t in turns]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    from wallscan.llm.tokens import default_path

    return Tokenizer.from_file(default_path())


def test_encoder(tokenizer):
    """The plain call of the library, whatever white space and special strings there are, also while the store of words is emptied."""
    from wallscan.llm.tokens import Encoder, default_path

    rng, coder = random.Random(7), Encoder(default_path(), cached=60)
    parts = ["the", "it's", "'s", "Été,", "naïve.", "12", "3.5%", "日本", "a\nb", "\n", "\n\n", "  ", "\t", "é", "\xa0x", "x　", "...", "don't", "ǅz", "ª", "\x1c", "end.\nStart", "<|endoftext|>", "Ünḯ", "a\n\nb", "x\r\ny", "\x85", "q\x0bw", "b\n", ""]
    for _ in range(20):
        gap = rng.choice([" ", " ", "\n"])
        texts = [rng.choice(["", " ", "\n"]) + gap.join(rng.choice(parts) for _ in range(rng.randint(0, 12))) + rng.choice(["", " ", "\n"]) for _ in range(200)] + [None]
        ids, at = coder.column(pa.array(texts))
        for i, text in enumerate(texts):
            assert ids[at[i] : at[i + 1]].tolist() == tokenizer.encode(text or "", add_special_tokens=False).ids, repr(text)
    assert tokenizer.encode("a<|endoftext|>b", add_special_tokens=False).ids == coder.encode("a<|endoftext|>b").tolist()
    assert len(Encoder(default_path(), special=False).encode("<|endoftext|>")) > 1


def test_encoder_on_whole_documents(tokenizer):
    import pyarrow.parquet as pq

    from wallscan.llm.tokens import Encoder, default_path

    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text"])["text"].combine_chunks()
    ids, at = Encoder(default_path()).column(texts)
    for i, text in enumerate(texts.to_pylist()):
        assert ids[at[i] : at[i + 1]].tolist() == tokenizer.encode(text or "", add_special_tokens=False).ids


def test_token_files(spark, odd, none, tokenizer, tmp_path):
    manifest = tokenfile.write_token_files(odd, f"file://{tmp_path}/files")
    rows = sorted(tokenfile.read_token_files(manifest).collect(), key=lambda r: r.start)
    want = sorted(((-1 if i is None else i, t or "") for i, t in ((r.doc_id, r.text) for r in odd.collect())))
    at = 0
    for r, (i, t) in zip(rows, want, strict=True):
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 0], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32, r.ids) == (None if i < 0 else i, at, len(ids), zlib.crc32(ids.tobytes()), ids.tolist())
        at += len(ids)
    some = tokenfile.read_token_files(manifest, odd.where("doc_id in (5, 7)")).collect()
    assert sorted((r.doc_id, r.start, r.ids) for r in some) == [(r.doc_id, r.start, r.ids) for r in rows if r.doc_id in (5, 7)]
    some = tokenfile.read_token_files(manifest, odd.where("doc_id is null or doc_id = 5")).collect()
    assert sorted((r.start, r.ids) for r in some) == sorted((r.start, r.ids) for r in rows if r.doc_id in (None, 5))
    assert tokenfile.read_token_files(manifest, frames=2).rdd.getNumPartitions() == min(spark.sparkContext.defaultParallelism, len(rows) // 2 + 1)
    assert sorted((r.start, r.ids_crc32) for r in tokenfile.read_token_files(manifest, frames=2).collect()) == [(r.start, r.ids_crc32) for r in rows]
    assert tokenfile.read_token_files(tokenfile.write_token_files(none)).count() == 0


def test_token_file_checksum(tmp_path):
    import io

    from wallscan.llm.tokens import default_path

    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text": ["some words", "other words"]})
    (row,) = list(tokenfile._write(str(tmp_path), default_path(), 0, 1)(iter([batch])))
    raw = bytearray(open(row["path"][0].as_py(), "rb").read())

    class Source(io.BytesIO):
        def size(self):
            return len(raw)

    assert len(list(tokenfile.TokenFile(Source(raw)).frames(0, 2))) == 2
    raw[8] ^= 1
    with pytest.raises(Exception):
        list(tokenfile.TokenFile(Source(raw)).frames(0, 1))
    assert len(list(tokenfile.TokenFile(Source(raw)).frames(1, 2))) == 1


def least_bins(sizes, capacity):
    """The least number of bins by search."""
    sizes = sorted(sizes, reverse=True)
    best = len(sizes)

    def place(i, room):
        nonlocal best
        if len(room) >= best:
            return
        if i == len(sizes):
            best = len(room)
            return
        for r in sorted(set(room)):
            if r >= sizes[i]:
                room.remove(r)
                room.append(r - sizes[i])
                place(i + 1, room)
                room.remove(r - sizes[i])
                room.append(r)
        room.append(capacity - sizes[i])
        place(i + 1, room)
        room.pop()

    place(0, [])
    return best


def test_bounds():
    rng = random.Random(10)
    for _ in range(200):
        capacity = rng.choice([10, 16, 100])
        sizes = np.array([rng.randint(1, capacity) for _ in range(rng.randint(1, 8))])
        at, place, room = packing.best_fit_decreasing(sizes, capacity)
        least = least_bins(sizes.tolist(), capacity)
        assert packing.lower_bound(sizes, capacity) <= least <= len(room)
        for b in set(at.tolist()):
            own = np.flatnonzero(at == b)
            spans = sorted((place[i], place[i] + sizes[i]) for i in own)
            assert spans[0][0] == 0 and all(x[1] == y[0] for x, y in zip(spans, spans[1:])) and spans[-1][1] + room[b] == capacity


@pytest.mark.parametrize("group_rows", [16_384, 40])
def test_packing(spark, odd, none, tokenizer, group_rows):
    texts = {r.doc_id: r.text for r in odd.where("doc_id is not null and doc_id != 3").collect()}
    rng = random.Random(11)
    texts |= {100 + i: prose(rng, rng.randint(1, 900)) for i in range(300)}
    docs = frame(spark, list(texts.values()), list(texts))
    packed = packing.pack_documents(docs, group_rows=group_rows)
    rows = packed.collect()
    sequences, total = collections.defaultdict(list), 0
    by = collections.defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append(r)
        by[r.doc_id].append(r)
        total += r.length
    for i, t in texts.items():
        ids, at = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4"), 0
        pieces = sorted(by[i], key=lambda r: r.piece)
        assert len(pieces) == -(-len(ids) // 1024) and all(p.length == 1024 for p in pieces[1:])
        for n, p in enumerate(pieces):
            assert (p.piece, p.start, p.ids_crc32) == (n, at, zlib.crc32(ids[at : at + p.length].tobytes()))
            at += p.length
        assert at == len(ids)
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    assert len(sequences) <= packing.lower_bound(np.array([r.length for r in rows]), 1024) + (3 if group_rows > 40 else 15)
    filled = {r.sequence_id: r for r in packing.sequences(docs, packed).collect()}
    assert set(filled) == set(sequences) and sum(len(r.ids) for r in filled.values()) == total
    assert packing.pack_documents(none).count() == 0 and packing.pack_documents(odd).agg({"length": "sum"}).first()[0] > 0


def test_spot_signatures(spark, odd, none):
    texts = {r.doc_id: r.text or "" for r in odd.where("doc_id is not null").dropDuplicates(["doc_id"]).collect()}
    rng = random.Random(13)
    texts |= {100 + i: " the ".join(prose(rng, 6) for _ in range(rng.randint(1, 20))) for i in range(60)}
    texts[161] = texts[160] = texts[159]
    docs = frame(spark, list(texts.values()), list(texts))
    rows = {r.doc_id: r for r in spotsigs.edited_and_next(docs).collect()}
    order = sorted(texts)
    assert set(rows) == set(order)
    prints = {r.doc_id: set(r.fingerprint.split()) for r in rows.values()}
    for i, after in zip(order, order[1:] + order[:1]):
        half = len(texts[i]) // 2
        edited = texts[i][: len(texts[i]) - half] + texts[after][:half]
        r = rows[i]
        assert r.n_chars == len(texts[i]) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        a, b, e = prints[i], prints[after], set(r.edited_fingerprint.split())
        assert r.near_next == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0)
        assert r.near_edited == pytest.approx(len(a & e) / len(a | e) if a | e else 1.0)
    assert rows[159].fingerprint == rows[161].fingerprint and rows[159].near_next == 1.0
    assert spotsigs.edited_and_next(none).count() == 0 and spotsigs.edited_and_next(odd).count() == odd.count()


def plain_chains(text, chain=2):
    """Chains of content words after common words and after words that end in a vowel, in plain Python."""
    common = {w for line in spotsigs.ANCHORS.values() for w in line.split()}
    found = re.findall(r"[^\W_]+", text.lower())
    out = set()
    for i, w in enumerate(found):
        if w in common or w[-1] in spotsigs.VOWELS:
            after = [x for x in found[i + 1 :] if x not in common][:chain]
            if len(after) == chain:
                out.add(" ".join(after))
    return out or ({"whole: " + re.sub(r"\s+", " ", text.lower())} if text else set())


def test_fingerprints_by_hand(spark):
    rng = random.Random(19)
    texts = ["", "the", "Lola Mart, the big and red HOUSE", "names | borg | fald", "the one", *(" ".join(rng.choice(["the", "und", "la", *(prose(rng, 1) for _ in range(5))]) for _ in range(rng.randint(1, 40))) for _ in range(80))]
    said = lambda c: c if c.startswith("whole: ") else f" {c}"
    rows = spark.createDataFrame([(c, said(c)) for c in {c for t in texts for c in plain_chains(t)}], "c string, said string")
    hashes = {r.c: r.h for r in rows.select("c", F.hash("said").alias("h")).collect()}
    got = {r.doc_id: set(r.spots) for r in spotsigs.fingerprints(frame(spark, texts)).collect()}
    assert got == {i: {hashes[c] for c in plain_chains(t)} for i, t in enumerate(texts)}


def test_one_more_chain_changes_one_spot(spark):
    """Texts with few chains and with more are compared by the same kind of spots."""
    names = "borg fald kirn the molt verd the stig hult the brant"
    prints = {r.doc_id: set(r.spots) for r in spotsigs.fingerprints(frame(spark, [names, names + " furst", names + " furst the gald wirk"])).collect()}
    assert prints[0] < prints[1] < prints[2] and len(prints[2]) == len(prints[1]) + 1 == len(prints[0]) + 2


@pytest.mark.parametrize("rows", [1, 3, 10_000])
def test_next_in_many_ranges(spark, monkeypatch, rows):
    monkeypatch.setattr(spotsigs, "in_ranges", functools.partial(spotsigs.in_ranges, rows=rows))
    monkeypatch.setattr(spotsigs, "COARSE", 4)
    ids = [None, *range(0, 400, 7), 14, 14, 10**12, -5]
    got = spotsigs.with_next(spark.createDataFrame([(i, f"v{n}") for n, i in enumerate(ids)], "doc_id long, v string"), ["v"]).collect()
    order = sorted(((-(10**18) if i is None else i, f"v{n}") for n, i in enumerate(ids)))
    assert {r.v: r.next_v for r in got} == {a[1]: b[1] for a, b in zip(order, order[1:] + order[:1])}


def test_spot_join(spark):
    rng = random.Random(14)
    texts = []
    for _ in range(20):
        base = [prose(rng, 3) for _ in range(rng.randint(3, 30))]
        for _ in range(5):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = prose(rng, 3)
            texts.append("the " + " the ".join(copy))
    prints = spotsigs.fingerprints(frame(spark, texts))
    sets = {}
    for r in prints.collect():
        sets.setdefault(tuple(r.spots), r.doc_id)
        sets[tuple(r.spots)] = min(sets[tuple(r.spots)], r.doc_id)
    want = {}
    for (x, a), (y, b) in itertools.combinations(sets.items(), 2):
        j = len(set(x) & set(y)) / len(set(x) | set(y))
        if j >= 0.8:
            want[min(a, b), max(a, b)] = j
    got = {(r.a, r.b): r.similarity for r in spotsigs.similar_pairs(prints).collect()}
    assert got.keys() == want.keys() and got == pytest.approx(want) and len(want) > 5


def test_sharding(spark, odd, none):
    rng = random.Random(15)
    docs = frame(spark, [prose(rng, rng.randint(0, 300)) for _ in range(3000)]).unionByName(odd)
    rows = sharding.shard_documents(docs).collect()
    assert len(rows) == docs.count()
    held = collections.defaultdict(list)
    for r in rows:
        held[r.shard].append(r)
    assert set(held) == set(range(24))
    assert all(sorted(r.slot for r in h) == list(range(len(h))) for h in held.values())
    sizes = [sum(r.size for r in h) for h in held.values()]
    assert max(sizes) - min(sizes) <= max(0.02 * sum(sizes) / 24, max(r.size for r in rows))
    texts = collections.Counter((r.doc_id, len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in docs.collect())
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == texts
    assert sharding.shard_documents(none).count() == 0
    moved = sharding.edited_map([(s, 10 + s % 7) for s in range(200)], 5, {s: s % 4 for s in range(200)})
    fewer = sharding.edited_map([(s, 10 + s % 7) for s in range(200)], 3, moved)
    assert set(fewer.values()) == {0, 1, 2}
    loads = collections.Counter()
    for s, shard in moved.items():
        loads[shard] += 10 + s % 7
    assert max(loads.values()) - min(loads.values()) <= 16 and all(moved[s] in (s % 4, 4) for s in moved if moved[s] == s % 4 or moved[s] == 4)


def test_shard_map_is_kept_and_edited(spark, tmp_path):
    """The same call again writes nothing and gives the same rows; another number of shards edits the map and moves few rows."""
    import os

    rng = random.Random(18)
    docs = frame(spark, [prose(rng, rng.randint(0, 60)) for _ in range(2000)])
    path = f"file://{tmp_path}/map"
    key = lambda df: {r.doc_id: (r.shard, r.slot) for r in df.collect()}
    one = key(sharding.shard_documents(docs, map_path=path))
    versions = sorted(os.listdir(tmp_path / "map"))
    assert versions == ["version=0", "version=1"] and key(sharding.shard_documents(docs, map_path=path)) == one and len(one) == 2000
    assert sorted(os.listdir(tmp_path / "map")) == versions
    more = key(sharding.shard_documents(docs, shards=30, map_path=path))
    assert {s for s, _ in more.values()} == set(range(30)) and sum(one[i][0] != more[i][0] for i in one) < 0.3 * len(one)
    fewer = key(sharding.shard_documents(docs, shards=20, map_path=path))
    assert {s for s, _ in fewer.values()} == set(range(20)) and sum(fewer[i][0] != more[i][0] for i in more) < 0.45 * len(more)
    assert len(os.listdir(tmp_path / "map")) == 4
    with pytest.raises(Exception):
        sharding.save_map(spark, {0: 0}, 1, path)
    with pytest.raises(ValueError):
        sharding.shard_documents(docs, slots=64, map_path=path)


def test_toxicity_scores_by_hand(spark):
    """Scores equal a plain sum over the words and word beginnings of each text; a text without words has the bias."""
    terms = {"bad": 1.5, "word": -0.5, "grum": 0.7}
    texts = ["Bad word!", "bad, bad. word", "grumbug", "", None, "...", "nothing here"]
    hashed = spark.createDataFrame([("bad", 0), ("word", 0), ("grum", 4)], "w string, stem int").select("w", F.when(F.col("stem") > 0, F.xxhash64("w", F.lit(4))).otherwise(F.xxhash64("w")).alias("h")).collect()
    order = sorted(hashed, key=lambda r: r.h)
    factors = {r.w: np.array([0.3 + i, -0.2 * i]) for i, r in enumerate(order)}
    model = (np.array([r.h for r in order]), np.array([terms[r.w] for r in order]), np.stack([factors[r.w] for r in order]), -0.25)
    got = {r.doc_id: r.score for r in toxicity.score(frame(spark, texts), model).collect()}
    for i, text in enumerate(texts):
        found = {w for w in re.split(r"[^\w]+", (text or "").lower()) if w}
        own = [w for w in ("bad", "word") if w in found] + (["grum"] if any(w[:4] == "grum" for w in found) else [])
        z = -0.25 + sum(terms[w] for w in own) + sum(float(factors[a] @ factors[b]) for a, b in itertools.combinations(own, 2))
        assert got[i] == pytest.approx(1 / (1 + np.exp(-z))), text


def test_machine_learns_pairs():
    """Toxic only where two terms meet: additive weights can't tell, the pair terms can."""
    rng = np.random.default_rng(3)
    rows, toxic = [], []
    for _ in range(3000):
        a, b = rng.integers(0, 2, 2)
        rows.append(np.unique(np.concatenate([rng.integers(10, 60, 6), [1] if a else [2], [3] if b else [4]])))
        toxic.append(float(a == b))
    keys, w, v, bias = toxicity.fit_machine(np.concatenate(rows[:2000]), np.array([len(r) for r in rows[:2000]]), np.array(toxic[:2000]), steps=2000)
    at = {k: i for i, k in enumerate(keys.tolist())}

    def score(row):
        own = [at[t] for t in row.tolist() if t in at]
        s = v[own].sum(0)
        return bias + w[own].sum() + 0.5 * ((s**2).sum() - (v[own] ** 2).sum())

    right = np.mean([(score(r) > 0) == (t > 0) for r, t in zip(rows[2000:], toxic[2000:])])
    assert right > 0.9


def test_toxicity(spark, odd, none):
    rng = random.Random(16)
    texts, labels = [], []
    for i in range(900):
        bad = rng.random() < 0.2
        w = prose(rng, rng.randint(5, 80)).split()
        if bad:
            for _ in range(2):
                w.insert(rng.randrange(len(w)), rng.choice(["grumbug", "snotface", "vilebag"]))
        texts.append(" ".join(w))
        labels.append((i, int(bad)))
    docs = frame(spark, texts)
    table = spark.createDataFrame([*labels, (None, 1), (5, None), (7, labels[7][1])], "doc_id long, toxic int")
    rows = toxicity.toxicity(docs, table).collect()
    held = [(r.score, r.predicted, labels[r.doc_id][1]) for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    assert np.mean([p == t for _, p, t in held]) > 0.97
    scores = toxicity.toxicity(odd, table).collect()
    assert len(scores) == odd.count() and len({r.score for r in scores if r.doc_id in (0, 1)}) == 1
    assert toxicity.toxicity(none, table).count() == 0 and toxicity.toxicity(odd, table.limit(0)).count() == odd.count()
    assert toxicity.drop_toxic(docs, table).columns == docs.columns


def test_oracles(spark):
    from tests.oracle import connection, differences
    from wallscan.llm.queries import ORACLES, QUERIES

    sf_dir = "/root/testdata/sf0.001"
    con = connection(sf_dir)
    for name, sql in ORACLES.items():
        assert not differences(QUERIES[name](spark, sf_dir), con, sql), name


def test_pipeline_removes_lines_of_mixed_copies(spark):
    """A document that is mostly lines of several others loses them all; one with no line of its own goes."""
    import corpus_pipeline

    rng = random.Random(12)
    lines = [prose(rng, 12) for _ in range(12)]
    texts = ["\n".join(lines[4 * i : 4 * i + 4]) for i in range(3)]
    texts += ["\n".join([lines[0], lines[5], "a line of its own that is new", lines[10]]), "\n".join([lines[1], "", lines[6]]), "", None]
    got = {r.doc_id: r.text for r in corpus_pipeline.dedupe_lines(spark, frame(spark, texts), "").collect()}
    assert got == {**{i: t for i, t in enumerate(texts) if i < 3}, 3: "a line of its own that is new", 5: "", 6: None}


def test_pipeline(spark):
    """Every stage keeps the columns of documents, and the last packs what is left; no near-duplicates or leaks are."""
    import corpus_pipeline
    from wallscan.llm.common import stored, table

    sf_dir = "/root/testdata/sf0.001"
    docs = table(spark, sf_dir, "documents")
    columns, kept = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "stage")
        assert docs.columns == columns and 0.5 * kept < docs.count() <= kept
    texts = {r.doc_id: r.text for r in docs.collect()}
    order = sorted(texts)
    assert all(c == i for i, (_, c) in brute_components([texts[i] for i in order], 5, 80).items())
    assert decontam.contaminated(docs, table(spark, sf_dir, "benchmark")).count() == 0
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf_dir).collect()} == set(texts)
