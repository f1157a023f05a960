"""Lines that share a template: links by patterns of two edits join what pairs would, without the pairs."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tests.llm.test_corpus import frame, line_corpus
from wallscan.llm import linededup
from wallscan.llm.components import components


def classes(pairs, nodes):
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        root[find(a)] = find(b)
    out = {}
    for x in nodes:
        out.setdefault(find(x), set()).add(x)
    return {frozenset(v) for v in out.values()}


def templates(rng, n):
    """Lines of a few templates with places filled from few letters: many are one or two edits apart, of any kind and place."""
    fill = lambda: "".join(rng.choice("ab0") for _ in range(rng.randint(2, 5)))
    kinds = [
        lambda: f"the reservation {fill()} was made for two guests",
        lambda: f"ticket {fill()} of the night train to port {fill()}",
        lambda: f"{fill()} opens the line that ends with the code {fill()}",
        lambda: "x" * rng.randint(17, 23) + rng.choice(["", "y", "yy", "z"]),
    ]
    return sorted({rng.choice(kinds)() for _ in range(n)})


def test_patterns_of_two_edits():
    """Two gaps are within two edits exactly if some pattern is shared in roles that link."""
    rng = random.Random(8)
    adjacent = [n for n, s in enumerate(linededup._SLOTS) if s[1:3] == (2, 3)]
    for _ in range(3000):
        a = "".join(rng.choice("ab") for _ in range(rng.randint(0, 5)))
        b = list(a)
        for _ in range(rng.randint(0, 3)):
            at = rng.randint(0, len(b))
            b[at : at + rng.randint(0, 1)] = [rng.choice("abc")] * rng.randint(0, 1)
        a, b = sorted((a, "".join(b)), key=len)
        less = len(b) - len(a)
        if less > 2:
            continue
        own, other = adjacent[0], next(n for n in adjacent if n >= 15 and linededup._SLOTS[n][0] == less)
        one = linededup.edit_patterns(own, a, "")
        two = linededup.edit_patterns(own, b, "") if not less else linededup.edit_patterns(other, b, "")
        met = any((p, linededup.LONG if r == linededup.SHORT else r) in two for p, r in one)
        assert met == (linededup.edit_distance(a, b, 2) <= 2), (a, b)


@pytest.mark.parametrize("weight", [0, 2])
def test_components_equal_those_of_all_pairs(spark, weight):
    rng = random.Random(9)
    lines = sorted({*templates(rng, 500), *line_corpus(25)})
    docs = frame(spark, ["\n".join(lines[i : i + 7]) for i in range(0, len(lines), 7)])
    names = dict(zip(linededup._hashes(lines)[0].tolist(), lines))
    found = [(names[r.a], names[r.b]) for r in linededup.near_lines(docs, most=2, every=False, weight=weight).collect()]
    want = [(a, b) for a, b in itertools.combinations(lines, 2) if max(len(a), len(b)) >= 20 and linededup.edit_distance(a, b, 2) <= 2]
    assert {frozenset(x) for x in found} <= {frozenset(x) for x in want}
    assert classes(found, lines) == classes(want, lines)


def test_numbered_lines(spark, monkeypatch):
    """20,000 numbered lines of one template: rows grow with the lines, not with their pairs."""
    n, rows = 20_000, {}
    keep = linededup.stored

    def counted(df, name):
        out = keep(df, name)
        rows[name] = rows.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(linededup, "stored", counted)
    lines = [f"your reservation number {i:06d} is held until the evening" for i in range(n)]
    docs = frame(spark, ["\n".join(lines[i : i + 50]) for i in range(0, n, 50)])
    links = linededup.near_lines(docs, every=False)
    near = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    assert near.count() == n and near.select("component").distinct().count() == 1
    assert rows["patterns"] < 400 * n and rows["line-links"] < 150 * n
