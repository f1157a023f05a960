"""A Merkle manifest of a data set, with few stored levels and proofs for all rows.

Rows are leaves of one tree for each value of a column; the roots of these trees are the leaves of a
top tree. Nodes are hashed in pairs. Only every `step`-th level is written (checkpoint); a proof needs
all of them, so its extraction takes each aligned subtree of 2**step stored nodes, computes the levels
between again (recompute), emits the siblings of every node and drops what it computed. A subtree is
one row of Spark with at most 2**step nodes, so no task holds a tree, however many rows share a key.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wallscan.llm.common import batch_of, named, placed, scratch, stored

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
STEP = 6
_NODES = pa.schema([("tree", pa.string()), ("pos", pa.int64()), ("n", pa.int64()), ("hash", pa.string())])
_PATHS = pa.schema([("tree", pa.string()), ("pos", pa.int64()), ("hash", pa.string()), ("path", pa.list_(pa.string()))])
_PATHS_SQL = "tree string, pos long, hash string, path array<string>"
_PROOFS = pa.schema([("doc_id", pa.int64()), ("leaf", pa.string()), ("subroot", pa.string()), ("root", pa.string()), ("proof", pa.list_(pa.string())), ("proof_sha256", pa.string()), ("folded_root", pa.string()), ("verified", pa.bool_())])


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_hash(fields: list[Column]) -> Column:
    """Lowercase hex sha256 of the fields, each `-` if null, else its UTF-8 byte count, `:` and value."""
    said = [c.cast("string") for c in fields]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in said)), 256)


def leaves(documents: DataFrame, tree: str = "lang", fields: tuple[str, ...] = FIELDS, claims: dict[str, Column] | None = None) -> DataFrame:
    """tree, doc_id, leaf and claim (the leaf of the row as `claims` changes it; null if equal) of each row. A null tree key sorts before all others."""
    now = leaf_hash([named(f) for f in fields])
    claimed = [(claims or {}).get(f, named(f)) for f in fields]
    same = F.lit(True)
    for f, c in zip(fields, claimed, strict=True):
        same &= named(f).eqNullSafe(c)
    key = F.coalesce(F.concat(F.lit("1"), named(tree).cast("string")), F.lit("0"))
    return documents.select(key.alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), now.alias("leaf"), F.when(~same, leaf_hash(claimed)).alias("claim"))


def height(n: int) -> int:
    """Levels above n nodes: pairs become nodes until one is left."""
    return (n - 1).bit_length() if n > 1 else 0


def _levels(nodes: list[str], n: int, step: int) -> list[list[str]]:
    """The nodes of an aligned subtree of a level with n nodes, and of the levels above it, `step` at most. A last node without another is hashed alone."""
    out = [nodes]
    for _ in range(min(step, height(n))):
        nodes = [digest(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)]
        out.append(nodes)
    return out


def _subtrees(nodes: DataFrame, step: int, *more: str) -> DataFrame:
    """A row for each aligned subtree of 2**step nodes: tree, block, n and the nodes in order."""
    block = F.shiftright("pos", step).alias("block")
    return nodes.groupBy("tree", block).agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("pos", "hash", *more))).alias("nodes"))


def _folded(step: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column("n").to_pylist()
            tops = [_levels([x["hash"] for x in nodes], m, step)[-1][0] for m, nodes in zip(n, batch.column("nodes").to_pylist(), strict=True)]
            yield batch_of(_NODES, batch.column("tree"), batch.column("block"), [(m - 1 >> step) + 1 for m in n], tops)

    return run


def _kept(df: DataFrame, path: str) -> DataFrame:
    """df written at path and read again; a path that exists is never replaced."""
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _above(nodes: DataFrame, step: int) -> int:
    """How many levels are stored above these nodes."""
    return -(-height(nodes.agg(F.max("n")).first()[0] or 0) // step)


def build(nodes: DataFrame, path: str, step: int = STEP) -> list[DataFrame]:
    """Writes the stored levels of all trees at path, from nodes(tree, pos, n, hash) up: level i holds the nodes i * step levels above them. A tree ends with its root, the node with n = 1."""
    levels = [nodes]
    for i in range(_above(nodes, step)):
        up = _subtrees(levels[-1].where("n > 1"), step).mapInArrow(_folded(step), "tree string, pos long, n long, hash string")
        levels.append(_kept(up, f"{path}/level={i + 1}"))
    return levels


def stored_levels(nodes: DataFrame, path: str, step: int = STEP) -> list[DataFrame]:
    """What build(nodes, path, step) wrote."""
    read = nodes.sparkSession.read.schema("tree string, pos long, n long, hash string")
    return [nodes, *(read.parquet(f"{path}/level={i + 1}") for i in range(_above(nodes, step)))]


def roots_of(levels: list[DataFrame]) -> DataFrame:
    out = levels[0].where("n = 1")
    for level in levels[1:]:
        out = out.unionByName(level.where("n = 1"))
    return out.select("tree", "hash")


def _siblings(levels: list[list[str]]) -> Iterator[list[str]]:
    """For each node of the lowest level, its siblings by level: `L` or `R`, the side it stands on, and its hash; empty where it has none."""
    for i in range(len(levels[0])):
        out = []
        for level in levels[:-1]:
            other = i ^ 1
            out.append(("L" if other < i else "R") + level[other] if other < len(level) else "")
            i >>= 1
        yield out


def _extended(step: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tree, n, nodes, above in zip(*(batch.column(c).to_pylist() for c in ("tree", "n", "nodes", "above")), strict=True):
                paths = [p + (above or []) for p in _siblings(_levels([x["hash"] for x in nodes], n, step))]
                yield batch_of(_PATHS, [tree] * len(nodes), [x["pos"] for x in nodes], [x["hash"] for x in nodes], paths)

    return run


def _with_above(level: DataFrame, above: DataFrame, step: int, *more: str) -> DataFrame:
    """The subtrees of a level with the path of the node each folds to; a root is a subtree of its own."""
    return _subtrees(level, step, *more).join(above.select("tree", F.col("pos").alias("block"), F.col("path").alias("above")), ["tree", "block"])


def paths(levels: list[DataFrame], roots: DataFrame, step: int = STEP) -> DataFrame:
    """What is needed above level 0: tree, pos and path of the nodes of level 1, and of the roots that level 0 holds. roots(tree, path) has the path of each tree's root in the tree above it, if any."""
    top = lambda level: level.where("n = 1").join(roots, "tree").select("tree", "pos", "hash", "path")
    above = top(levels[-1])
    for level in reversed(levels[1:-1]):
        longer = _with_above(level.where("n > 1"), above, step).mapInArrow(_extended(step), _PATHS_SQL)
        above = stored(longer.unionByName(top(level)), "merkle-paths")
    return above if len(levels) == 1 else above.unionByName(top(levels[0]))


def folded(leaf: str, path: list[str]) -> str:
    """The root that a leaf and its siblings give."""
    for other in path:
        leaf = digest(other[1:], leaf) if other[:1] == "L" else digest(leaf, other[1:])
    return leaf


def _proved(step: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, nodes, above, subroot, root in zip(*(batch.column(c).to_pylist() for c in ("n", "nodes", "above", "subroot", "root")), strict=True):
                rows = []
                for x, own in zip(nodes, _siblings(_levels([x["hash"] for x in nodes], n, step)), strict=True):
                    path = own + (above or [])
                    got = folded(x["claim"] or x["hash"], path)
                    rows.append((x["doc_id"], x["hash"], subroot, root, path, digest(*(p[1:] for p in path)), got, got == root))
                yield batch_of(_PROOFS, *zip(*rows, strict=True))

    return run


_LEAVES = "tree string, doc_id long, leaf string, claim string, n long, pos long"
_CROWN = "tree string, name string, hash string, n long, pos long"


def write_manifest(documents: DataFrame, path: str, tree: str = "lang", claims: dict[str, Column] | None = None, step: int = STEP, fields: tuple[str, ...] = FIELDS) -> str:
    """Writes the manifest of documents at path and returns the root ('' without rows).

    Folders: leaves, levels (of the trees), crown (a row for each tree) and tops (of the top tree). Only
    each step-th level is there. claims maps field names to what somebody says they hold: a row that
    differs gets the claimed leaf beside its own."""
    columns = lambda df, schema: df.select(*(c.split()[0] for c in schema.split(", ")))
    rows = _kept(columns(placed(leaves(documents, tree, fields, claims), "tree", ["doc_id", "leaf"]), _LEAVES), f"{path}/leaves")
    levels = build(rows.select("tree", "pos", "n", F.col("leaf").alias("hash")), f"{path}/levels", step)
    one = roots_of(levels).select(F.lit("").alias("tree"), F.col("tree").alias("name"), "hash")
    crown = _kept(columns(placed(one, "tree", ["name"]), _CROWN), f"{path}/crown")
    root = roots_of(build(crown.select("tree", "pos", "n", "hash"), f"{path}/tops", step)).first()  # one row at most
    return root.hash if root else ""


def read_proofs(spark: SparkSession, path: str, step: int = STEP) -> DataFrame:
    """The proofs of all leaves of a manifest; its columns are those of `manifest`."""
    rows = spark.read.schema(_LEAVES).parquet(f"{path}/leaves").withColumnRenamed("leaf", "hash")
    crown = spark.read.schema(_CROWN).parquet(f"{path}/crown")
    levels = stored_levels(rows.select("tree", "pos", "n", "hash"), f"{path}/levels", step)
    tops = stored_levels(crown.select("tree", "pos", "n", "hash"), f"{path}/tops", step)
    root = roots_of(tops).select(F.col("hash").alias("root"))  # one row at most
    upper = paths(tops, roots_of(tops).select("tree", F.array().cast("array<string>").alias("path")), step)
    upper = _with_above(crown, upper, step).mapInArrow(_extended(step), _PATHS_SQL)
    roots = stored(crown.join(upper.select("tree", "pos", "path"), ["tree", "pos"]).select(F.col("name").alias("tree"), "path", F.col("hash").alias("subroot")), "merkle-roots")
    above = paths(levels, roots.select("tree", "path"), step)
    full = _with_above(rows, above, step, "doc_id", "claim").join(roots.select("tree", "subroot"), "tree").crossJoin(F.broadcast(root))
    return full.mapInArrow(_proved(step), "doc_id long, leaf string, subroot string, root string, proof array<string>, proof_sha256 string, folded_root string, verified boolean")


def manifest(documents: DataFrame, path: str | None = None, tree: str = "lang", claims: dict[str, Column] | None = None, step: int = STEP, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """Leaf, roots and inclusion proof of each row of documents, and whether the row as claimed still proves.

    The leaf hashes `fields`; the leaves of each value of column `tree` ascend by doc_id (null first), equal
    ones by hash. Subroots ascend by that value (null first, UTF-8 bytewise) and give the root. The
    manifest is written at path (unset: beside the checkpoints). A row that differs from its claims is
    folded from the claimed leaf and the true siblings, any other from its own.

    Returns doc_id, leaf, subroot, root, proof (by level, `L` or `R` for the sibling's side and its hash, empty
    where there is none), proof_sha256 (of the siblings' hashes in a row), folded_root and verified.

    Rows that repeat a doc_id are leaves of their own; wholly equal rows stand next to each other, in any
    order. Null and empty fields have different leaves. A tree of one row is its leaf. No rows give no rows.
    Texts are hashed whole; columns that are not fields change nothing.
    """
    path = path or scratch(documents.sparkSession, "merkle")
    write_manifest(documents, path, tree, claims, step, fields)
    return read_proofs(documents.sparkSession, path, step)
