"""SpotSigs fingerprints; DataFrame functions only.

A spot signature is a chain of content words that follows a common word (Theobald et al. 2008). The
fingerprint of a text is the set of its hashed chains. Sets are compared by Jaccard similarity; a
join deals sets by their size, since sets whose sizes differ too much can't reach the threshold.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wallscan.llm.common import stored, text_or_empty

# Common words of English, German, French and Spanish that anchor the chains.
ANCHORS = {
    "en": "a an and are as at be by for from in is it of on or that the this to was were with",
    "de": "als am auf aus das dem den der des die ein eine einer es für im ist mit nicht sich und von zu",
    "fr": "au aux avec ce dans des du elle en est et il la le les par pas pour qui sur un une",
    "es": "al con como de del el los las lo más no para por que se su una y",
}
VOWELS = "aeiouyàáâäæèéêëìíîïòóôöœùúûü"
MARK = "\u0001"


def marked(text: Column) -> Column:
    """Lower-case words, each after one space; a common word is only a mark."""
    words = sorted({w for line in ANCHORS.values() for w in line.split()})
    plain = F.concat(F.lit(" "), F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "), F.lit(" "))
    return F.regexp_replace(plain, " +(?:" + "|".join(words) + ")(?= )", MARK)


def spots(text: Column, chain: int = 2) -> Column:
    """The sorted distinct hashes (int) of a text's chains of `chain` content words.

    A chain follows a common word or a word that ends in a vowel, in every text alike: so texts with few
    common words, such as lists of names, have chains of the same kind as others. A text in which no
    chain fits has one hash of its whole text. An empty text has none.
    """
    word = f"{MARK}*+ +[^ {MARK}]++"
    chains = F.regexp_extract_all(marked(text), F.lit(f"(?:{MARK}|(?<=[{VOWELS}]))(?=({word * chain}))"), F.lit(1))
    whole = F.when(F.length(text) > 0, F.array(F.concat(F.lit("whole: "), F.regexp_replace(F.lower(text), r"\s+", " ")))).otherwise(F.array().cast("array<string>"))
    found = F.when(F.size(chains) > 0, chains).otherwise(whole)
    return F.array_sort(F.array_distinct(F.transform(found, lambda x: F.hash(F.translate(x, MARK, "")))))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets; two empty sets are alike, and an empty and a filled one are not.

    Sets with equal hashes are equal, and their similarity needs no intersection."""
    shared = F.size(F.array_intersect(a, b))
    return F.when(a == b, 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(shared / (F.size(a) + F.size(b) - shared))


def as_text(spot_set: Column) -> Column:
    return F.concat_ws(" ", F.transform(spot_set, lambda x: F.lpad(F.lower(F.hex(x.cast("long").bitwiseAND(0xFFFFFFFF))), 8, "0")))


def fingerprints(documents: DataFrame, chain: int = 2) -> DataFrame:
    """doc_id, spots (sorted int array) and fingerprint (their hex digits) of each row.

    Null and empty texts have no spots and an empty fingerprint; equal texts have equal fingerprints;
    repeated rows and null doc_ids pass through; other columns are ignored."""
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), spots(text_or_empty(), chain).alias("spots")).withColumn("fingerprint", as_text(F.col("spots")))


def similar_pairs(prints: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Pairs of different fingerprints with a Jaccard similarity of at least `threshold`: a, b (least doc_ids), similarity.

    prints has doc_id and spots. Equal sets are one class and meet nothing; empty sets are left out.
    Sets are dealt by length: a set of n spots belongs to the length class floor(log n / log(1 / t))
    and can only match sets of its own and the next class. Within two classes, sets meet on a spot
    of their prefix: the rarest spots first, n - ceil(t n) + 1 of them, since two sets that share no
    prefix spot can't reach the threshold. No candidate is capped.
    """
    sets = stored(prints.where("size(spots) > 0").groupBy("spots").agg(F.min("doc_id").alias("id")), "spot-sets")
    df = sets.select(F.explode("spots").alias("spot")).groupBy("spot").agg(F.count("*").alias("df"))
    ranked = sets.select("id", F.size("spots").alias("n"), F.explode("spots").alias("spot")).join(df, "spot")
    order = Window.partitionBy("id").orderBy("df", "spot")
    step = math.log(1 / threshold)
    prefix = ranked.withColumn("r", F.row_number().over(order)).where(F.col("r") <= F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1)
    prefix = stored(prefix.select("id", "n", "spot", F.floor(F.log("n") / step + 1e-9).alias("length_class")), "spot-prefixes")
    left = prefix.select(F.col("id").alias("a"), F.col("n").alias("na"), "spot", F.explode(F.array("length_class", F.col("length_class") + 1)).alias("length_class"))
    right = prefix.select(F.col("id").alias("b"), F.col("n").alias("nb"), "spot", "length_class")
    met = left.join(right, ["spot", "length_class"]).where(f"a != b and nb >= na and na >= {threshold} * nb - 1e-9 and (na < nb or a < b)").select("a", "b").distinct()
    full = met.join(sets.select(F.col("id").alias("a"), F.col("spots").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("spots").alias("sb")), "b")
    return full.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), likeness(F.col("sa"), F.col("sb")).alias("similarity")).where(F.col("similarity") >= threshold - 1e-12)


COARSE, MOST_RANGES = 256, 65_536


def in_ranges(documents: DataFrame, rows: int = 16_384) -> DataFrame:
    """Adds _range: ranges of ascending doc_id of about `rows` rows each, at most 65,536 of them; null doc_ids are in the first.

    Bounds are quantiles, taken first over all rows and then within each of 256 coarse ranges."""
    below = lambda bounds: F.coalesce(F.array_size(F.filter(bounds, lambda b: b < F.col("doc_id"))), F.lit(0))
    cuts = lambda n: [i / n for i in range(1, n)]
    count, bounds = documents.agg(F.count("*"), F.percentile_approx("doc_id", cuts(COARSE), 10_000)).first()
    coarse = documents.withColumn("_coarse", below(F.lit(sorted(set(bounds or ()))).cast("array<long>")) if bounds else F.lit(0))  # fewer than 256 numbers
    fine = max(1, min(MOST_RANGES, -(-count // rows)) // COARSE)
    if fine == 1:
        return coarse.withColumnRenamed("_coarse", "_range")
    inner = coarse.groupBy("_coarse").agg(F.array_sort(F.array_distinct(F.percentile_approx("doc_id", cuts(fine), 10_000))).alias("_bounds"))  # at most 256 rows of 255 numbers
    return coarse.join(F.broadcast(inner), "_coarse").withColumn("_range", F.col("_coarse") * fine + below(F.col("_bounds"))).drop("_coarse", "_bounds")


def with_next(documents: DataFrame, values: list[str]) -> DataFrame:
    """Adds next_<value> for each value: that of the next row by ascending doc_id, after the last the first.

    Each range of doc_ids also gets the first row of the range after it, so no task sorts the whole table;
    the heads of the ranges, at most 65,536 numbers, are all that goes through the driver. Rows with a
    null doc_id come first; rows that repeat a doc_id follow each other.
    """
    dealt = in_ranges(documents)
    heads = dealt.groupBy("_range").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id")).alias("head")).select("_range", "head.doc_id").orderBy("_range").collect()
    guests = documents.sparkSession.createDataFrame([(r.doc_id, heads[i - 1]._range) for i, r in enumerate(heads)], "_head long, _also int")
    both = dealt.join(F.broadcast(guests), F.col("doc_id").eqNullSafe(F.col("_head")), "left").drop("_head")
    place = lambda r, guest: F.struct(F.col(r).alias("r"), F.lit(guest).alias("guest"))
    copies = both.withColumn("_at", F.explode(F.when(F.col("_also").isNull(), F.array(place("_range", False))).otherwise(F.array(place("_range", False), place("_also", True)))))
    window = Window.partitionBy("_at.r").orderBy("_at.guest", F.col("doc_id").asc_nulls_first(), *values)
    return copies.select("*", *(F.lead(v).over(window).alias(f"next_{v}") for v in values)).where("not _at.guest").drop("_range", "_also", "_at")


def edited_and_next(documents: DataFrame, chain: int = 2) -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likeness to each other and to the next document's.

    The edited text has the last floor(n_chars / 2) code points replaced by the first as many (or all)
    of the next document. Nulls count as empty texts."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    own = docs.withColumn("spots", spots(F.col("text"), chain))
    both = with_next(own, ["text", "spots"]).withColumn("n_chars", F.char_length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    both = both.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substring("next_text", F.lit(1), half)))
    both = both.withColumn("edited_spots", spots(F.col("edited"), chain))
    return both.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), as_text(F.col("spots")).alias("fingerprint"), as_text(F.col("edited_spots")).alias("edited_fingerprint"), likeness(F.col("spots"), F.col("edited_spots")).alias("near_edited"), likeness(F.col("spots"), F.col("next_spots")).alias("near_next"))
