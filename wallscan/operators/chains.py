"""Components and orders of slices of any length: no task holds a slice.

`profiles.components` and `profiles.order_path` walk a slice in one task, which is quickest while slices are short.
The functions here give the same rows for slices that no task could hold.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wallscan.operators.neighbours import checkpointed, least_labels
from wallscan.operators.profiles import _ends, _roots, _slices, order_path, with_keys

_KEY = ("kx", "ky", "kz")
_PLACE = ("x", "y", "z", "u", "v")
#: Segments that a task joins at a time.
PIECE = 1 << 16


def long_components(segments: DataFrame) -> DataFrame:
    """segments with path_id, as `profiles.components` gives it, by pieces and star contraction of what joins them.

    Segments are dealt by ranges of plane and height, so a long slice goes to many tasks; a task joins at most PIECE
    neighbouring segments at a time and names the least node of what is connected there. Nodes that lie in several
    pieces link these names, and only those links go through star contraction, whose rounds grow with the
    logarithm of the longest way among pieces. The ranks of a slice's components are one window over their least nodes only."""
    names = [f"_{c}" for c in _KEY]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, table in _slices(batches, ("k",)):
            for part in (table.slice(at, PIECE) for at in range(0, len(table), PIECE)):
                a, b = _ends(part)
                root = _roots(a, b)
                for i, name in enumerate(names):
                    part = part.append_column(name, pa.array([root[x][i] for x in a], pa.int64()))
                yield from part.combine_chunks().to_batches()

    schema = segments.schema.simpleString()[7:-1].replace(":", " ") + "".join(f", {n} long" for n in names)
    dealt = segments.repartitionByRange("k", "z1").sortWithinPartitions("k", "z1")
    s = checkpointed(dealt.mapInArrow(run, schema)).withColumn("_piece", F.struct("k", *(F.col(n).alias(d) for n, d in zip(names, _KEY, strict=True))))
    shared = with_keys(s).select("k", "_piece", F.explode(F.array("a", "b")).alias("node")).groupBy("k", "node").agg(F.min("_piece").alias("a"), F.max("_piece").alias("most"), F.collect_set("_piece").alias("_all")).where("a != most")
    labels = least_labels(shared.select("a", F.explode("_all").alias("b")))
    rooted = s.join(labels.withColumnRenamed("node", "_piece"), "_piece", "left").withColumn("_root", F.coalesce("label", "_piece"))
    rank = F.row_number().over(Window.partitionBy("k").orderBy("_root")) - 1
    roots = rooted.select("k", "_root").distinct().withColumn("path_id", rank.cast("int"))
    return rooted.join(roots, ["k", "_root"]).select(*segments.columns, "path_id")


def list_ranks(arcs: DataFrame, rounds: int = 64) -> DataFrame:
    """(id, root, steps) of arcs (id, up): the arc without `up` that each comes from, and how many arcs lie on the way, both counted.

    Pointer doubling: a round joins each arc with the one it points to and takes over that one's pointer, so the
    way that is left halves, and a list of n arcs takes log2(n) rounds. Arcs on a ring without a root have none
    and are left out; they are known by pointing at an arc still when a round settles no other. Raises RuntimeError
    when `rounds` do not suffice, which 2 ** 64 arcs would need. Arcs are numbered first, so that a round moves numbers
    and not what they are known by."""
    known = checkpointed(arcs.select("id", "up").withColumn("_n", F.monotonically_increasing_id()))
    arcs = known.join(known.select(F.col("id").alias("up"), F.col("_n").alias("_m")), "up", "left").select(F.col("_n").alias("id"), F.when(F.col("up").isNotNull(), F.coalesce("_m", F.lit(-1).cast("long"))).alias("up"))
    named = known.select("id", "_n")
    own, top = named.withColumnRenamed("_n", "_i"), named.select(F.col("id").alias("root"), F.col("_n").alias("_t"))
    back = lambda ranks: ranks.select(F.col("id").alias("_i"), F.col("root").alias("_t"), "steps").join(own, "_i").join(top, "_t").select("id", "root", "steps")
    now = checkpointed(arcs.select("id", "up", F.when(F.col("up").isNull(), F.col("id")).alias("root"), F.lit(1).cast("long").alias("steps")))
    left = now.where("root is null").count()
    for _ in range(rounds):
        if not left:
            return back(now)
        there = now.select(F.col("id").alias("up"), F.col("up").alias("_up"), F.col("root").alias("_root"), F.col("steps").alias("_steps"))
        moved = now.where("root is null").join(there, "up").select("id", F.col("_up").alias("up"), F.col("_root").alias("root"), (F.col("steps") + F.col("_steps")).alias("steps"))
        now = checkpointed(now.where("root is not null").unionByName(moved))
        before, left = left, now.where("root is null").count()
        if before == left:
            return back(now.where("root is not null"))
    raise RuntimeError(f"lists did not settle in {rounds} rounds")


def long_order(paths: DataFrame) -> DataFrame:
    """The ordered nodes of each path from its highest to its lowest, as `profiles.order_path` gives them.

    A path that is a chain or a ring is cut at its highest node and ranked by pointer doubling in both
    directions; the shorter way to its lowest node is taken, of equal ones that with the lesser first node.
    Paths that branch have no ranks: `order_path` walks each in one task."""
    p = with_keys(paths)
    end = lambda c, i: F.struct("k", "path_id", F.col(c).alias("n"), F.struct(*(F.col(f"{d}{i}").alias(d) for d in _PLACE)).alias("at"))
    nodes = checkpointed(p.select(F.inline(F.array(end("a", 1), end("b", 2)))).groupBy("k", "path_id", "n").agg(F.min("at").alias("at")))
    both = p.where("a != b").select("k", "path_id", F.inline(F.array(F.struct(F.col("a").alias("n"), F.col("b").alias("m")), F.struct(F.col("b").alias("n"), F.col("a").alias("m")))))
    degree = checkpointed(both.distinct().groupBy("k", "path_id", "n").agg(F.count("*").alias("degree"), F.min("m").alias("m1"), F.max("m").alias("m2")))
    simple = degree.groupBy("k", "path_id").agg(F.max("degree").alias("most")).where("most <= 2").select("k", "path_id")
    top = F.min(F.struct((-F.col("at.v")).alias("v"), "n")).alias("t")
    low = F.min(F.struct(F.col("at.v").alias("v"), "n")).alias("l")
    ends = nodes.groupBy("k", "path_id").agg(top, low).select("k", "path_id", F.col("t.n").alias("first"), F.col("l.n").alias("last")).where("first != last")
    ends = checkpointed(ends.join(simple, ["k", "path_id"], "left_semi"))
    # An arc leads from n to m; the one before it comes to n from n's other neighbour, unless n is first or a loose end.
    near = degree.join(ends, ["k", "path_id"])
    arcs = near.select("k", "path_id", "n", "first", "degree", "m1", "m2", F.explode(F.array_distinct(F.array("m1", "m2"))).alias("m"))
    other = F.when((F.col("n") != F.col("first")) & (F.col("degree") == 2), F.when(F.col("m") == F.col("m1"), F.col("m2")).otherwise(F.col("m1")))
    arc = lambda a, b: F.struct("k", "path_id", a.alias("a"), b.alias("b"))
    arcs = arcs.withColumn("_from", other).select(arc(F.col("n"), F.col("m")).alias("id"), F.when(F.col("_from").isNotNull(), arc(F.col("_from"), F.col("n"))).alias("up"))
    ranks = list_ranks(arcs).select("id.k", "id.path_id", F.col("id.b").alias("n"), F.col("root.a").alias("first"), F.col("root.b").alias("turn"), "steps")
    ranks = checkpointed(ranks.join(ends, ["k", "path_id", "first"]))  # those that come from the highest node
    chosen = ranks.where("n = last").groupBy("k", "path_id").agg(F.min(F.struct("steps", "turn")).alias("_way")).select("k", "path_id", "_way.turn", F.col("_way.steps").alias("_most"))
    way = ranks.join(chosen, ["k", "path_id", "turn"]).where("steps <= _most").select("k", "path_id", F.col("steps").cast("int").alias("ord"), "n")
    way = way.unionByName(ends.select("k", "path_id", F.lit(0).alias("ord"), F.col("first").alias("n")))
    ranked = way.join(nodes, ["k", "path_id", "n"]).select("k", "path_id", "ord", *(F.col(f"n.{c}").alias(c) for c in _KEY), *(F.col(f"at.{c}").alias(c) for c in _PLACE))
    return ranked.unionByName(order_path(paths.join(simple, ["k", "path_id"], "left_anti")))
