"""Near-duplicate documents by min-max hashing.

Each permutation gives two signature values, its least and its greatest hash, so 48 hash evaluations
make a signature of 96 values with less variance than 96 plain minima (Ji et al. 2013). 24 bands of
four values propose candidates; every link is confirmed on the full shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wallscan.llm.common import batch_of, blocks, lists, stored, text_or_empty, utf8, without
from wallscan.llm.components import components
from wallscan.llm.hashing import mix, runs, words

_SIGNED = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_shingles", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("bands", pa.list_(pa.int64()))])
_PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("shared", pa.int64()), ("total", pa.int64())])


def shingle_sets(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct k-word shingles of each text as sorted hashes, flat, and the offsets by text.

    Words are `[^\\x20\\x09-\\x0D]+` with A-Z in lower case. A text of fewer words has its whole
    sequence as its one shingle, a text without words none.
    """
    tokens, offsets = words(*utf8(column), lower=True)
    counts = np.diff(offsets)
    row = np.repeat(np.arange(len(counts)), counts)
    full = mix(runs(tokens, k))
    at = np.flatnonzero(np.arange(len(full)) + k <= offsets[row[: len(full)] + 1])
    short = np.flatnonzero((counts > 0) & (counts < k))
    whole = np.array([mix(runs(tokens[offsets[i] : offsets[i + 1]], int(counts[i])) + np.uint64(counts[i]))[0] for i in short], np.uint64)
    rows, values = np.concatenate([row[at], short]), np.concatenate([full[at], whole])
    order = np.lexsort((values, rows))
    rows, values = rows[order], values[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (values[1:] != values[:-1])
    rows, values = rows[new], values[new]
    return values, np.searchsorted(rows, np.arange(len(counts) + 1))


def _sign(k: int, permutations: int, rows: int):
    rng = np.random.default_rng(7)
    a = rng.integers(1, 2**63, permutations, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 2**63, permutations, dtype=np.uint64)
    weights = rng.integers(1, 2**63, (rows,), dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in blocks(whole):
                values, offsets = shingle_sets(batch.column("text"), k)
                sizes = np.diff(offsets)
                some = np.flatnonzero(sizes)
                at = offsets[some]
                least, most = (np.empty((len(some), permutations), np.uint64) for _ in "ab")
                sums = np.zeros((2, len(sizes)), np.uint64)
                if len(some):
                    for p in range(permutations):
                        hashed = values * a[p] + b[p]
                        hashed ^= hashed >> np.uint64(29)
                        hashed *= a[-1 - p]
                        least[:, p], most[:, p] = np.minimum.reduceat(hashed, at), np.maximum.reduceat(hashed, at)
                    sums[0, some], sums[1, some] = np.add.reduceat(values, at), np.bitwise_xor.reduceat(mix(values + np.uint64(11)), at)
                signature = np.concatenate([least, most], 1)  # 2 * permutations values
                n_bands = signature.shape[1] // rows
                picked = signature[:, np.arange(n_bands * rows).reshape(rows, n_bands).T]  # a band: least and greatest of two permutations
                keys = mix((mix(picked) * weights).sum(2, dtype=np.uint64) + np.arange(n_bands, dtype=np.uint64))
                lengths = np.zeros(len(sizes) + 1, np.int64)
                lengths[1:][some] = n_bands
                yield batch_of(_SIGNED, batch.column("doc_id"), batch.column("text_hash"), sizes, mix(sums[0]).view(np.int64), mix(sums[1]).view(np.int64), lists(keys.ravel().view(np.int64), lengths.cumsum(), pa.int64()))

    return run


def _confirm(k: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[int, np.ndarray] = {}
        for whole in batches:
            for batch in blocks(whole, "ta"):
                rows = []
                ids = [batch.column(c).to_pylist() for c in "ab"]
                for side, of in enumerate(ids):
                    column = batch.column(("ta", "tb")[side])
                    new = {x: i for i, x in enumerate(of) if x not in sets}
                    if new:
                        values, offsets = shingle_sets(column.take(pa.array(list(new.values()))), k)
                        sets.update((x, values[offsets[i] : offsets[i + 1]]) for i, x in enumerate(new))
                for x, y in zip(*ids, strict=True):
                    shared = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                    total = len(sets[x]) + len(sets[y]) - shared
                    if 100 * shared >= percent * total:
                        rows.append((x, y, shared, total))
                if sum(map(len, sets.values())) > 2_000_000:
                    sets.clear()
                yield batch_of(_PAIRS, *(zip(*rows, strict=True) if rows else ([], [], [], [])))

    return run


def _with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    first = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a")
    return first.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb")


def confirmed(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Of pairs(a, b) those whose full shingle sets meet the threshold: a, b, shared, total."""
    return _with_texts(pairs, texts).mapInArrow(_confirm(k, percent), "a long, b long, shared long, total long")


PARITY = 8  # longs of a parity map


def parity_maps(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each set 64 * PARITY bits: whether the values of each of so many classes are odd in number. A value that two sets don't share changes one bit."""
    n, bits = len(offsets) - 1, 64 * PARITY
    at = np.repeat(np.arange(n), np.diff(offsets)) * bits + (mix(values.view(np.uint64) + np.uint64(77)) % np.uint64(bits)).astype(np.int64)
    odd = (np.bincount(at, minlength=n * bits) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view("<i8").reshape(n, PARITY)


def _deltas(k: int):
    names = ["hub", "x", "n_hub", "n", *(f"p{i}" for i in range(PARITY))]
    schema = pa.schema([*((n, pa.int64()) for n in names), ("delta", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in blocks(whole, "ta"):
                values, at = shingle_sets(batch.column("ta"), k)
                own, own_at = shingle_sets(batch.column("tb"), k)
                delta = [np.setxor1d(values[at[i] : at[i + 1]], own[own_at[i] : own_at[i + 1]], assume_unique=True).view(np.int64) for i in range(batch.num_rows)]
                flat, ends = np.concatenate([np.empty(0, np.int64), *delta]), np.append(0, np.cumsum([len(d) for d in delta], dtype=np.int64))
                yield batch_of(schema, batch.column("a"), batch.column("b"), np.diff(at), np.diff(own_at), *parity_maps(flat, ends).T, lists(flat, ends, pa.int64()))

    return run


def _links_beyond_hub(apart: DataFrame, links: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Links between members x of a hub that are still in different components: apart(hub, x, part).

    Members of a hub mostly look like it, so they are compared by what sets them apart from it: D = x xor
    hub. x and y are linked when |D_x xor D_y| = |x xor y| <= c (|x| + |y|), c = (100 - percent) / (100 +
    percent). If y isn't linked with the hub, |D_y| > c (|y| + |hub|), so D_x and D_y of a linked pair share
    more than (|D_x| + c (|hub| - |x|)) / 2 values, at least one. Two sets that share t values meet among
    the |D| - t + 1 rarest of each: members meet on those only, and not in all pairs.

    Two bounds keep a crowd that is alike in little from meeting in pairs, and neither can drop a linked
    pair. Of the rarest value that a pair shares, the places in both sets leave room for at most 1 + min(|D_x|
    - place_x, |D_y| - place_y) shared values. And the parity maps of D_x and D_y differ in at most |D_x xor
    D_y| bits.
    """
    more, less = 100 + percent, 100 - percent
    parity = [f"p{i}" for i in range(PARITY)]
    schema = f"hub long, x long, n_hub long, n long, {', '.join(f'{p} long' for p in parity)}, delta array<long>"
    deltas = _with_texts(apart.select(F.col("hub").alias("a"), F.col("x").alias("b")), docs).mapInArrow(_deltas(k), schema)
    direct = links.select(F.col("a").alias("hub"), F.col("b").alias("x")).unionByName(links.select(F.col("b").alias("hub"), F.col("a").alias("x"))).withColumn("linked", F.lit(True))
    d = deltas.join(apart, ["hub", "x"]).join(direct, ["hub", "x"], "left").withColumn("linked", F.coalesce("linked", F.lit(False))).withColumn("s", F.size("delta"))
    d = stored(d, "deltas")
    share = F.greatest(F.lit(1), F.expr(f"({more} * s + {less} * (n_hub - n)) div {2 * more} + 1"))
    far = F.greatest(F.lit(1), F.expr(f"s - floor({less} * (n + 100 * least(n, n_hub) / {percent}) / {more} + 1e-9)"))
    values = d.select("hub", "x", "part", "n", "s", "linked", *parity, (F.col("s") - share + 1).alias("own"), (F.col("s") - far + 1).alias("wide"), F.explode("delta").alias("value"))
    seen = values.groupBy("hub", "value").agg(F.count("*").alias("df")).where("df > 1")
    # A value of one member is the rarest; counted from the most frequent end, place s - r + 1 is that from the rarest.
    shared = values.join(seen, ["hub", "value"]).withColumn("r", F.row_number().over(Window.partitionBy("hub", "x").orderBy(F.col("df").desc(), "value")))
    ranked = stored(shared.withColumn("place", F.col("s") - F.col("r") + 1).where("place <= greatest(own, wide)"), "ranked")
    side = lambda df, p: df.select("hub", "value", *(F.col(c).alias(f"{p}_{c}") for c in ("x", "part", "n", "s", "place", *parity)))
    left, rest = ranked.where("place <= own"), ranked.where("not linked")
    fits = f"100 * least(a_n, b_n) >= {percent} * greatest(a_n, b_n) and {more} * abs(a_s - b_s) <= {less} * (a_n + b_n) and a_part != b_part"
    fits += f" and {2 * more} * (1 + least(a_s - a_place, b_s - b_place)) >= {more} * (a_s + b_s) - {less} * (a_n + b_n)"
    fits += f" and {more} * ({' + '.join(f'bit_count(a_{p} ^ b_{p})' for p in parity)}) <= {less} * (a_n + b_n)"
    first = side(left.where("not linked"), "a").join(side(rest.where("place <= own"), "b"), ["hub", "value"]).where(f"a_x < b_x and {fits}")
    second = side(left.where("linked"), "a").join(side(rest.where("place <= wide"), "b"), ["hub", "value"]).where(fits)
    met = first.unionByName(second).select("hub", "a_x", "b_x").distinct()
    one = lambda p: d.select("hub", F.col("x").alias(f"{p}_x"), F.col("n").alias(f"{p}_n"), F.col("delta").alias(f"{p}_d"))
    both = met.join(one("a"), ["hub", "a_x"]).join(one("b"), ["hub", "b_x"])
    apart_by = F.size("a_d") + F.size("b_d") - 2 * F.size(F.array_intersect("a_d", "b_d"))
    both = both.withColumn("apart_by", apart_by).where(f"{more} * apart_by <= {less} * (a_n + b_n)")
    found = both.select(F.least("a_x", "b_x").alias("a"), F.greatest("a_x", "b_x").alias("b"), F.expr("(a_n + b_n - apart_by) div 2").alias("shared"), F.expr("(a_n + b_n + apart_by) div 2").alias("total")).distinct()
    return stored(found, "more-links")


def near_duplicates(documents: DataFrame, k: int = 5, percent: int = 80, permutations: int = 48, rows: int = 4) -> DataFrame:
    """Groups of documents linked by a Jaccard similarity of at least percent/100 on k-word shingles.

    Returns for each row of documents (doc_id long, text): doc_id, n_shingles, class_id (least doc_id
    with the same shingle set), n_links (confirmed links of the class to other classes), component_id
    (least doc_id reachable) and kept (doc_id = component_id). Other columns are ignored.

    Null and empty texts have no shingles and are linked with nothing. Copies are one class and never
    meet in pairs. In each bucket every class meets its hub, the class with the most bucket mates, which
    joins large groups in linear work. Classes of one hub that are still in different components are
    then joined on what sets them apart from the hub, so no link that could join two components is
    left unchecked, and no bucket is expanded into all pairs. Rows with the same
    doc_id form one document, that of the text with the least hash, and get its result; a null doc_id
    gets a null component and is kept.
    A pair at the threshold of 0.8 shares a band with probability 1 - (1 - 0.8**4)**24 > 0.99999.
    """
    every = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    docs = every.where("doc_id is not null")
    hashed = docs.withColumn("text_hash", F.xxhash64("text"))
    written = stored(hashed.mapInArrow(_sign(k, permutations, rows), "doc_id long, text_hash long, n_shingles long, s1 long, s2 long, bands array<long>"), "signatures")
    again = stored(written.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("text_hash").alias("text_hash")).where("n > 1").select("doc_id", "text_hash"), "repeated-ids")
    one = written.join(again, ["doc_id", "text_hash"], "left_semi").dropDuplicates(["doc_id"])
    signed = written.join(again, "doc_id", "left_anti").unionByName(one)
    repeated = hashed.join(again, ["doc_id", "text_hash"]).groupBy("doc_id").agg(F.min("text").alias("text"))
    docs = docs.join(again, "doc_id", "left_anti").unionByName(repeated)
    key = ["n_shingles", "s1", "s2"]
    classes = signed.where("n_shingles > 0").groupBy(*key).agg(F.min("doc_id").alias("class_id"))
    lead = signed.join(classes, key).where("doc_id = class_id").select("class_id", F.explode("bands").alias("bucket"))
    lead = stored(lead, "buckets")
    size = lead.groupBy("bucket").agg(F.count("*").alias("mates")).where("mates > 1")
    member = stored(lead.join(size, "bucket"), "mates")
    mass = member.groupBy("class_id").agg(F.sum("mates").alias("mass"))
    member = stored(member.join(mass, "class_id").select("bucket", "class_id", "mass"), "members")
    hub = member.groupBy("bucket").agg(F.max(F.struct("mass", F.negative("class_id").alias("id"))).alias("hub")).select("bucket", F.negative("hub.id").alias("hub"))
    pairs = member.join(hub, "bucket").where("class_id != hub").select(F.least("class_id", "hub").alias("a"), F.greatest("class_id", "hub").alias("b")).distinct()
    pairs = stored(pairs, "hub-pairs")
    links = stored(confirmed(pairs, docs, k, percent), "links")
    joined = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    part = joined.select(F.col("node").alias("x"), F.col("component").alias("part"))
    placed = member.select("bucket", F.col("class_id").alias("x")).join(part, "x", "left").withColumn("part", F.coalesce("part", "x"))
    mixed = placed.groupBy("bucket").agg(F.min("part").alias("p"), F.max("part").alias("q")).where("p < q").select("bucket")
    apart = placed.join(mixed, "bucket").join(hub, "bucket").where("x != hub").select("hub", "x", "part").distinct()
    more = _links_beyond_hub(stored(apart, "apart"), links, docs, k, percent)
    if not more.isEmpty():
        links = links.unionByName(more)
        joined = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    degree = links.select(F.explode(F.array("a", "b")).alias("class_id")).groupBy("class_id").agg(F.count("*").alias("n_links"))
    found = classes.join(joined.withColumnRenamed("node", "class_id"), "class_id", "left").join(degree, "class_id", "left")
    result = signed.drop("bands").join(found, key, "left").select("doc_id", "n_shingles", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component", "class_id", "doc_id").alias("component_id"))
    result = result.withColumn("kept", F.col("doc_id") == F.col("component_id"))
    others = written.select("doc_id").join(again, "doc_id", "left_semi").join(result.join(again, "doc_id", "left_semi"), "doc_id")
    result = result.join(again, "doc_id", "left_anti").unionByName(others.select(result.columns))
    unknown = every.where("doc_id is null").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.lit(None).cast("long").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(None).cast("long").alias("component_id"), F.lit(True).alias("kept"))
    return result.unionByName(unknown)


def drop_near_duplicates(documents: DataFrame, **options) -> DataFrame:
    """documents with one document of each near-duplicate group, the one with the least doc_id; columns stay.

    Rows that repeat a doc_id stay or go together; rows with a null doc_id stay."""
    gone = near_duplicates(documents, **options).where("not kept").select("doc_id").distinct()
    return without(documents, gone)
