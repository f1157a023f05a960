"""A corpus pipeline of five stages; each works on all documents that the stage before it kept.

ORACLE_SQL is None: a learned score, approximate candidates and a packing heuristic can't be
expressed in SQL. The stages are tested against brute-force versions in tests/llm.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wallscan.llm import decontam, linededup, minhash, packing, toxicity
from wallscan.llm.common import stored, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic (score of at least 0.7) go."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def dedupe_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines seen before go from all texts, by the rule of op5. A document in which no line is new goes."""
    return linededup.clean_documents(docs, drop_emptied=True)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: five-word shingles, similarity of 0.8 or more."""
    return minhash.drop_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of a benchmark item go."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents become token pieces, packed into sequences of at most 1024."""
    return packing.pack_documents(docs)


STAGES = [("toxicity", drop_toxic), ("line dedup", dedupe_lines), ("near dedup", drop_near_duplicates), ("decontamination", drop_contaminated), ("packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages; what each keeps is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, name.replace(" ", "-"))
    return docs
