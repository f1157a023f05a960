"""Profiles: the segments of each plane, joined at their ends, ordered, and searched for overhangs.

A slice (one plane's profile) is a chain and bounded by the resolution of the mesh, so steps that must
walk it get slices whole, one after another, from partitions dealt and sorted by plane; all else is
joins and windows.
"""

from __future__ import annotations

import math
from collections import defaultdict, deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wallscan.functions.geometry import angle_from_down, hypot2, key6, seed_angle


def with_keys(segments: DataFrame) -> DataFrame:
    """Adds node keys a and b (struct of millionths) of both ends."""
    key = lambda i: F.struct(*(key6(f"{d}{i}").alias(f"k{d}") for d in "xyz"))
    return segments.withColumn("a", key(1)).withColumn("b", key(2))


def node_degree(segments: DataFrame) -> DataFrame:
    """Segment ends at each node of a slice; a segment of no length counts twice."""
    return with_keys(segments).select("k", F.explode(F.array("a", "b")).alias("node")).groupBy("k", "node").agg(F.count("*").alias("degree"))


def degree_histogram(segments: DataFrame) -> DataFrame:
    return node_degree(segments).groupBy("k", "degree").agg(F.count("*").alias("nodes"))


def unique_nodes(segments: DataFrame) -> DataFrame:
    return with_keys(segments).select("k", F.explode(F.array("a", "b")).alias("node")).distinct().select("k", "node.kx", "node.ky", "node.kz")


def slice_stats(segments: DataFrame, planes: DataFrame) -> DataFrame:
    """Number and total length of the segments of each plane, with its azimuth."""
    length = F.sqrt(sum(((F.col(f"{d}2") - F.col(f"{d}1")) * (F.col(f"{d}2") - F.col(f"{d}1")) for d in "xyz"), F.lit(0.0)))
    return segments.groupBy("k").agg(F.count("*").alias("n_segments"), F.sum(length).alias("length")).join(planes.select("k", "slice_key", "azimuth"), "k")


def _roots(a: list, b: list) -> dict:
    """Least node of each node's component."""
    up: dict = {}

    def find(x):
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for p, q in zip(a, b, strict=True):
        p, q = find(p), find(q)
        up[max(p, q)] = min(p, q)
    return {x: find(x) for x in list(up)}


def _slices(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[tuple[tuple, pa.Table]]:
    """The key and the rows of each group of sorted batches."""
    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        new = np.logical_or.reduce([c[1:] != c[:-1] for c in cols])
        starts = [0, *(np.flatnonzero(new) + 1).tolist()]
        for a, b in zip(starts, [*starts[1:], batch.num_rows], strict=True):
            key = tuple(int(c[a]) for c in cols)
            if held and key != last:
                yield last, pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield last, pa.Table.from_batches(held)


_KINDS = {pa.int64(): "long", pa.int32(): "int", pa.float64(): "double"}


def _by_slice(df: DataFrame, keys: tuple[str, ...], columns: str, rows_of: Callable, fields: list[tuple[str, pa.DataType]]) -> DataFrame:
    """The rows that rows_of(key, table) gives for each group of df by keys; columns names what it reads."""
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for key, table in _slices(batches, keys):
            rows += rows_of(key, table)
            if len(rows) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    dealt = df.select(*dict.fromkeys([*keys, *columns.split()])).repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(run, ", ".join(f"{n} {_KINDS[t]}" for n, t in fields))


def _ends(table: pa.Table) -> tuple[list, list]:
    at = np.rint(np.stack([table[c].to_numpy() for c in ("x1", "y1", "z1", "x2", "y2", "z2")], 1) * 1e6).astype(np.int64).tolist()
    return [tuple(r[:3]) for r in at], [tuple(r[3:]) for r in at]


class _Walked:
    """The nodes and components of a slice's segments.

    Nodes are numbered by key; `at` holds their places (x, y, z, u, v), `of` the two nodes of each segment. `ways` has for each component,
    by its least node, whether it has a loose end and its ordered nodes as `shortest_order` gives them. Where no node has more than two neighbours
    a chain is walked once along arrays; other components are searched."""

    def __init__(self, table: pa.Table, places: bool = True):
        ends = np.rint(np.stack([table[c].to_numpy() for c in ("x1", "y1", "z1", "x2", "y2", "z2")], 1) * 1e6).astype(np.int64).reshape(-1, 3)
        order = np.lexsort(ends.T[::-1])
        ranked = ends[order]
        new = np.concatenate([[True], (ranked[1:] != ranked[:-1]).any(1)])
        number = np.empty(len(ends), np.int64)
        number[order] = np.cumsum(new) - 1
        self.keys, self.of, self.n = ranked[new], number.reshape(-1, 2), int(new.sum())
        self.at = np.stack([table[c].to_numpy() for c in _PLACES.split()], 1).reshape(-1, 5)[order[new]] if places else None
        lo, hi = self.of.min(1), self.of.max(1)
        self.links = lo * self.n + hi  # a number for each pair of nodes
        pairs = np.unique(self.links[lo != hi])
        a, b = np.concatenate([pairs // self.n, pairs % self.n]), np.concatenate([pairs % self.n, pairs // self.n])
        order = np.argsort(a, kind="stable")
        self.degree = np.bincount(a, minlength=self.n)
        self.start, self.beside = np.concatenate([[0], np.cumsum(self.degree)]), b[order]

    def components(self) -> tuple[np.ndarray, list[np.ndarray], list[bool]]:
        """The component of each node, counted by least node; the nodes of each, along the way where it is a chain; and whether it is one."""
        found: list[tuple[int, np.ndarray, bool]] = []
        left = np.ones(self.n, bool)
        if self.degree.max() <= 2:
            padded, start = np.append(self.beside, [-1, -1]), self.start[:-1]
            one, two = np.where(self.degree > 0, padded[start], -1).tolist(), np.where(self.degree > 1, padded[start + 1], -1).tolist()
            done = set()
            for end in np.flatnonzero(self.degree == 1).tolist():
                if end in done:
                    continue
                way, before, here = [end], -1, end
                while (then := one[here] if one[here] != before else two[here]) >= 0:
                    way.append(then)
                    before, here = here, then
                done.add(here)
                nodes = np.array(way)
                left[nodes] = False
                found.append((int(nodes.min()), nodes, True))
        beside, start = self.beside, self.start
        for first in np.flatnonzero(left).tolist():
            if left[first]:
                left[first], queue = False, [first]
                for node in queue:
                    for other in beside[start[node] : start[node + 1]].tolist():
                        if left[other]:
                            left[other] = False
                            queue.append(other)
                found.append((first, np.array(queue), False))
        found.sort(key=lambda c: c[0])
        path = np.empty(self.n, np.int64)
        for p, (_, nodes, _) in enumerate(found):
            path[nodes] = p
        return path, [nodes for _, nodes, _ in found], [chain for *_, chain in found]

    def ways(self) -> list[tuple[bool, np.ndarray]]:
        """For each component, by its least node, whether it has a loose end, and its nodes from the highest to the lowest."""
        out = []
        _, components, chains = self.components()
        for nodes, chain in zip(components, chains, strict=True):
            if chain:
                v = self.at[nodes, 4]
                top, low = np.flatnonzero(v == v.max()), np.flatnonzero(v == v.min())
                top, low = int(top[nodes[top].argmin()]), int(low[nodes[low].argmin()])
                way = nodes[top : low + 1] if top <= low else nodes[low : top + 1][::-1]
                out.append((True, way if len(way) > 1 else way[:0]))
            else:
                at = dict(zip(nodes.tolist(), self.at[nodes].tolist(), strict=True))
                beside = {n: set(self.beside[self.start[n] : self.start[n + 1]].tolist()) for n in at}
                out.append((bool((self.degree[nodes] == 1).any()), np.array(shortest_order(beside, at), np.int64)))
        return out

    def least_between(self, values: np.ndarray, a: np.ndarray, b: np.ndarray, none: int) -> np.ndarray:
        """The least of the segments' values for each pair of nodes, or none."""
        order = np.lexsort((values, self.links))
        links = self.links[order]
        first = np.concatenate([[True], links[1:] != links[:-1]])
        wanted = np.where(b < 0, -1, np.minimum(a, b) * self.n + np.maximum(a, b))
        place = np.minimum(np.searchsorted(links[first], wanted), first.sum() - 1)
        return np.where(links[first][place] == wanted, values[order][first][place], none)


def _path_ids(table: pa.Table) -> np.ndarray:
    """For each segment of a slice the rank of its component's least node."""
    walked = _Walked(table, places=False)
    return walked.components()[0][walked.of[:, 0]]


def components(segments: DataFrame) -> DataFrame:
    """segments with path_id: the rank, from 0, of its connected component's least node within the slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, table in _slices(batches, ("k",)):
            yield from table.append_column("path_id", pa.array(_path_ids(table), pa.int32())).combine_chunks().to_batches()

    schema = segments.schema.simpleString()[7:-1].replace(":", " ") + ", path_id int"
    return segments.repartition("k").sortWithinPartitions("k").mapInArrow(run, schema)


def ordered(segments: DataFrame) -> DataFrame:
    """order_path(components(segments)) after one shuffle by plane, with face_id: that of the segment to the path's next node, as match_faces finds it; null at the last."""
    schema = pa.schema([*_NODES, ("face_id", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.iinfo(np.int64).max
        for (k,), table in _slices(batches, ("k",)):
            walked = _Walked(table)
            ways = [(p, way) for p, (_, way) in enumerate(walked.ways()) if len(way)]
            if ways:
                at, sizes = np.concatenate([way for _, way in ways]), [len(way) for _, way in ways]
                face = walked.least_between(table["face_id"].fill_null(none).to_numpy(), at, np.append(at[1:], -1), none)
                face[np.cumsum(sizes) - 1] = none
                columns = [np.full(len(at), k), np.repeat([p for p, _ in ways], sizes), np.concatenate([np.arange(n) for n in sizes]), *walked.keys[at].T, *walked.at[at].T]
                yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(columns, schema.types)), pa.array(face, pa.int64(), mask=face == none)], schema=schema)

    dealt = segments.select("k", "face_id", *_PLACES.split()).repartition("k").sortWithinPartitions("k")
    return dealt.mapInArrow(run, ", ".join(f"{n} {_KINDS[t]}" for n, t in zip(schema.names, schema.types)))


def path_kinds(paths: DataFrame) -> DataFrame:
    """For each path: number of segments and nodes, loose ends, closed (no loose end), and simple (a cycle or a chain of two ends)."""
    ends = with_keys(paths).select("k", "path_id", F.explode(F.array("a", "b")).alias("node")).groupBy("k", "path_id", "node").agg(F.count("*").alias("degree"))
    kinds = ends.groupBy("k", "path_id").agg((F.sum("degree") / 2).cast("long").alias("n_segments"), F.count("*").alias("n_nodes"), F.count(F.when(F.col("degree") == 1, 1)).alias("loose"), F.max("degree").alias("most"))
    return kinds.select("k", "path_id", "n_segments", "n_nodes", "loose", (F.col("loose") == 0).alias("closed"), ((F.col("most") <= 2) & F.col("loose").isin(0, 2)).alias("simple"))


_NODES = [("k", pa.int64()), ("path_id", pa.int32()), ("ord", pa.int32()), *((c, pa.int64()) for c in ("kx", "ky", "kz")), *((c, pa.float64()) for c in ("x", "y", "z", "u", "v"))]
_PLACES = "x1 y1 z1 u1 v1 x2 y2 z2 u2 v2"


def _graph(a: list, b: list, rows: list[list[float]]) -> tuple[dict, dict]:
    """Neighbours and places of the nodes of segments with ends a and b."""
    beside, at = defaultdict(set), {}
    for p, q, row in zip(a, b, rows, strict=True):
        at.setdefault(p, row[:5])
        at.setdefault(q, row[5:])
        if p != q:
            beside[p].add(q)
            beside[q].add(p)
    return beside, at


def _rows(table: pa.Table) -> list[list[float]]:
    return np.stack([table[c].to_numpy() for c in _PLACES.split()], 1).tolist()


def shortest_order(beside: dict, at: dict) -> list:
    """Nodes of the shortest way from the highest to the lowest node; ties by node; empty when there is none."""
    first, last = min(at, key=lambda n: (-at[n][4], n)), min(at, key=lambda n: (at[n][4], n))
    came, queue = {first: None}, deque([first])
    while queue and last not in came:
        node = queue.popleft()
        for other in sorted(beside[node]):
            if other not in came:
                came[other] = node
                queue.append(other)
    if last not in came or first == last:
        return []
    way = [last]
    while came[way[-1]] is not None:
        way.append(came[way[-1]])
    return way[::-1]


def _node_rows(k, path_id, way: list, at: dict) -> list[tuple]:
    return [(k, path_id, i, *n, *at[n]) for i, n in enumerate(way)]


def order_path(paths: DataFrame) -> DataFrame:
    """The ordered nodes of each path, from its highest to its lowest; side branches are left out."""

    def rows_of(key: tuple, table: pa.Table) -> list[tuple]:
        beside, at = _graph(*_ends(table), _rows(table))
        return _node_rows(*key, shortest_order(beside, at), at)

    return _by_slice(paths, ("k", "path_id"), _PLACES, rows_of, _NODES)


def order_whole_slice(segments: DataFrame) -> DataFrame:
    """One way from the highest to the lowest node of a slice; none when it is in pieces."""

    def rows_of(key: tuple, table: pa.Table) -> list[tuple]:
        beside, at = _graph(*_ends(table), _rows(table))
        return _node_rows(*key, 0, shortest_order(beside, at), at)

    return _by_slice(segments, ("k",), _PLACES, rows_of, _NODES)


def section_paths(paths: DataFrame) -> DataFrame:
    """Ordered nodes of the components that are a chain of two ends (from the lesser end) or a simple cycle (from its least node, which is repeated); others are skipped."""

    def rows_of(key: tuple, table: pa.Table) -> list[tuple]:
        beside, at = _graph(*_ends(table), _rows(table))
        loose = sorted(n for n in at if len(beside[n]) == 1)
        if any(len(beside[n]) > 2 for n in at) or len(loose) not in (0, 2) or len(at) < 2:
            return []
        node = loose[0] if loose else min(at)
        way, seen = [node], {node}
        while nxt := sorted(n for n in beside[node] if n not in seen):
            node = nxt[0]
            way.append(node)
            seen.add(node)
        return _node_rows(*key, way if loose else [*way, way[0]], at)

    return _by_slice(paths, ("k", "path_id"), _PLACES, rows_of, _NODES)


def path_edges(nodes: DataFrame) -> DataFrame:
    """Pairs of consecutive nodes: k, path_id, ord, ends 1 and 2 in space and profile, and their keys a and b; face_id if nodes have it."""
    w = Window.partitionBy("k", "path_id").orderBy("ord")
    key = F.struct("kx", "ky", "kz")
    faces = ["face_id"] if "face_id" in nodes.columns else []
    both = nodes.select("k", "path_id", "ord", *faces, key.alias("a"), *(F.col(c).alias(f"{c}1") for c in ("x", "y", "z", "u", "v")), F.lead(key).over(w).alias("b"), F.lead("ord").over(w).alias("_next"), *(F.lead(c).over(w).alias(f"{c}2") for c in ("x", "y", "z", "u", "v")))
    return both.where("_next is not null").drop("_next")  # keys that nobody reads are not moved


def segment_frame(edges: DataFrame) -> DataFrame:
    """Adds length, direction, left normal and midpoint of profile segments; those of no length go."""
    du, dv = F.col("u2") - F.col("u1"), F.col("v2") - F.col("v1")
    e = edges.withColumn("len", hypot2(du, dv)).where("len > 0")
    return e.withColumn("nu", -(F.col("v2") - F.col("v1")) / F.col("len")).withColumn("nv", (F.col("u2") - F.col("u1")) / F.col("len")).withColumn("mu", (F.col("u1") + F.col("u2")) / 2).withColumn("mv", (F.col("v1") + F.col("v2")) / 2)


def path_normals(edges: DataFrame, closed: DataFrame) -> DataFrame:
    """Left normals along open paths; on closed ones turned away from the mean of the distinct nodes."""
    f = segment_frame(edges)
    nodes = edges.select("k", "path_id", F.explode(F.array(F.struct(F.col("a").alias("n"), F.col("u1").alias("u"), F.col("v1").alias("v")), F.struct(F.col("b").alias("n"), F.col("u2").alias("u"), F.col("v2").alias("v")))).alias("p"))
    mean = nodes.groupBy("k", "path_id", "p.n").agg(F.min("p.u").alias("u"), F.min("p.v").alias("v")).groupBy("k", "path_id").agg(F.avg("u").alias("cu"), F.avg("v").alias("cv"))
    both = f.join(closed.select("k", "path_id", "closed"), ["k", "path_id"]).join(mean, ["k", "path_id"])
    flip = F.when(F.col("closed") & (F.col("nu") * (F.col("mu") - F.col("cu")) + F.col("nv") * (F.col("mv") - F.col("cv")) < 0), -1).otherwise(1)
    return both.select("k", "path_id", "ord", "mu", "mv", (F.col("nu") * flip).alias("nu"), (F.col("nv") * flip).alias("nv"))


def match_faces(edges: DataFrame, segments: DataFrame) -> DataFrame:
    """edges (with keys a, b) with the face_id of the segment between the same nodes, either way round; null if none, the least if several."""
    s = with_keys(segments).select("k", F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"), "face_id").groupBy("k", "lo", "hi").agg(F.min("face_id").alias("face_id"))
    return edges.withColumn("lo", F.least("a", "b")).withColumn("hi", F.greatest("a", "b")).join(s, ["k", "lo", "hi"], "left").drop("lo", "hi")


def overhangs(edges: DataFrame, threshold: float = -0.1) -> DataFrame:
    """Segments whose left normal points down by more than the threshold: there the path runs back toward the axis while it goes down."""
    return segment_frame(edges).where(F.col("nv") < threshold)


def facing_down(edges: DataFrame, degrees: float = 30.0) -> DataFrame:
    f = segment_frame(edges)
    return f.where(angle_from_down("nu", "nv") < degrees)


def seed_flags(edges: DataFrame, degrees: float = 40.0) -> DataFrame:
    return edges.withColumn("seed", F.coalesce(seed_angle(F.col("u2") - F.col("u1"), F.col("v2") - F.col("v1")) > degrees, F.lit(False)))


def gap_groups(red: DataFrame, tol: float = 0.1) -> DataFrame:
    """red with group_id: walking a path from its end, a new group begins where the previous segment's greatest u lies tol or more beyond this one's least."""
    w = Window.partitionBy("k", "path_id").orderBy(F.col("ord").desc())
    gap = F.lag(F.greatest("u1", "u2")).over(w) - F.least("u1", "u2")
    flagged = red.withColumn("_new", F.when(gap >= tol, 1).otherwise(0))
    return flagged.withColumn("group_id", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("_new")


def grow_groups(red: DataFrame, tol: float = -0.3, y_tol: float = 1.0, most: float = 70.0, seed_degrees: float = 40.0) -> DataFrame:
    """red with group_id of seeded growth; segments that no group reaches go.

    Walking a path from its end, a segment joins the running group if growth may pass to it; otherwise it
    starts a group if it is a seed. One fold over the sorted segments does the same as growing seed by
    seed; it holds a batch, and nothing of a path but its group's start and last segment."""
    seeded = seed_flags(red, seed_degrees)
    rest = [c for c in red.columns if c not in ("k", "path_id", "ord")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, group, start, last = None, -1, None, None
        for batch in batches:
            out = []
            for k, p, seed, *row in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("k", "path_id", "seed", "u1", "v1", "u2", "v2"))):
                if (k, p) != path:
                    path, group, start, last = (k, p), -1, None, None
                u1, v1, u2, v2 = row
                grows = last is not None and u2 - last[0] > tol and abs(last[1] - v2) < y_tol and math.degrees(math.atan2(abs(v1 - start[3]), abs(u1 - start[2]))) <= most
                if not grows:
                    start, group = (row, group + 1) if seed else (None, group)
                last = row if grows or seed else None
                out.append(group if last else None)
            member = pa.array([g is not None for g in out])
            kept = pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in ("k", "path_id", "ord", *rest)), pa.array(out, pa.int32())], names=["k", "path_id", "ord", *rest, "group_id"])
            yield kept.filter(member)

    dealt = seeded.repartition("k", "path_id").sortWithinPartitions("k", "path_id", F.col("ord").desc())
    return dealt.mapInArrow(run, T.StructType([*(red.schema[c] for c in ("k", "path_id", "ord", *rest)), T.StructField("group_id", T.IntegerType())]))


def group_span(groups: DataFrame, nodes: DataFrame) -> DataFrame:
    """Path nodes from the first to the last node of each group, gaps filled: k, path_id, group_id, ord, u, v, x, y, z, flag (1 at the ends, 2 inside)."""
    span = groups.groupBy("k", "path_id", "group_id").agg(F.min("ord").alias("lo"), (F.max("ord") + 1).alias("hi"))
    both = span.join(nodes, ["k", "path_id"]).where("ord between lo and hi")
    flag = F.when((F.col("ord") == F.col("lo")) | (F.col("ord") == F.col("hi")), 1).otherwise(2)
    return both.select("k", "path_id", "group_id", "ord", "u", "v", "x", "y", "z", flag.alias("flag"))


def group_centroids(span: DataFrame) -> DataFrame:
    return span.groupBy("k", "path_id", "group_id").agg(F.avg("u").alias("cu"), F.avg("v").alias("cv"), F.count("*").alias("n_nodes"))


def centroid_pairing(groups: DataFrame, span: DataFrame) -> DataFrame:
    """Groups that have segments, with their number and the centroid of their span."""
    return groups.groupBy("k", "path_id", "group_id").agg(F.count("*").alias("n_segments")).join(group_centroids(span).drop("n_nodes"), ["k", "path_id", "group_id"])


def group_points(groups: DataFrame) -> DataFrame:
    """Both ends in space of all segments of each group: k, path_id, group_id, x, y, z."""
    ends = F.array(*(F.struct(*(F.col(f"{d}{i}").alias(d) for d in "xyz")) for i in (1, 2)))
    return groups.select("k", "path_id", "group_id", F.inline(ends))


def wide_groups(span: DataFrame, least: float = 0.1) -> DataFrame:
    """Groups of at least two nodes whose ends are at least `least` apart in u."""
    g = span.groupBy("k", "path_id", "group_id").agg(F.count("*").alias("n_nodes"), F.abs(F.max_by("u", "ord") - F.min_by("u", "ord")).alias("width"))
    return g.where((F.col("n_nodes") >= 2) & (F.col("width") >= least))


def rank_groups(span: DataFrame) -> DataFrame:
    """Groups of a path by number of nodes, ties by id."""
    n = span.groupBy("k", "path_id", "group_id").agg(F.count("*").alias("n_nodes"))
    return n.withColumn("rank", F.row_number().over(Window.partitionBy("k", "path_id").orderBy(F.col("n_nodes").desc(), "group_id")))


def longest_path(nodes: DataFrame) -> DataFrame:
    """The path with most nodes of each slice, the first of equals."""
    n = nodes.groupBy("k", "path_id").agg(F.count("*").alias("n_nodes"))
    return n.groupBy("k").agg(F.max(F.struct("n_nodes", (-F.col("path_id")).alias("p"))).alias("m")).select("k", (-F.col("m.p")).alias("path_id"), "m.n_nodes")


def start_end(paths: DataFrame) -> DataFrame:
    """Highest and lowest node of each path, ties by node."""
    p = with_keys(paths)
    ends = p.select("k", "path_id", F.inline(F.array(F.struct(F.col("v1").alias("v"), F.col("a").alias("n")), F.struct(F.col("v2").alias("v"), F.col("b").alias("n")))))
    top, low = F.min(F.struct((-F.col("v")).alias("v"), "n")), F.min(F.struct("v", "n"))
    g = ends.groupBy("k", "path_id").agg(top.alias("t"), low.alias("l"))
    return g.select("k", "path_id", *(F.col(f"t.n.k{d}").alias(f"s{d}") for d in "xyz"), *(F.col(f"l.n.k{d}").alias(f"e{d}") for d in "xyz"))


def segment_heights(groups: DataFrame) -> DataFrame:
    """Height of each grouped segment: the group's greatest end z less the segment's mean z."""
    w = Window.partitionBy("k", "path_id", "group_id")
    return groups.withColumn("height", F.max(F.greatest("z1", "z2")).over(w) - (F.col("z1") + F.col("z2")) / 2)


def face_heights(heights: DataFrame, strategy: str) -> DataFrame:
    """One height for each face over all slices: 'max', 'min' or 'avg'."""
    how = {"max": F.max, "min": F.min, "avg": F.avg}[strategy]
    return heights.where("face_id is not null").groupBy("face_id").agg(how("height").alias("height"), F.count("*").alias("n"))


def contained_paths(open_paths: DataFrame, merged: DataFrame) -> DataFrame:
    """Open paths (k, path_id, lo, hi) whose v range lies in none of a slice's merged ranges (k, m_lo, m_hi)."""
    return open_paths.join(merged, (open_paths.k == merged.k) & (open_paths.lo >= merged.m_lo) & (open_paths.hi <= merged.m_hi), "left_anti")


def _foot_where_crossed(way: list[tuple], point: tuple[float, float], axis: int) -> Iterator[tuple[int, tuple[float, float]]]:
    """The first edge of a way whose ends lie on either side of a point by one coordinate, and the point's foot on the edge's line; nothing where no edge does."""
    for i, (a, b) in enumerate(zip(way, way[1:])):
        if (a[axis] - point[axis]) * (b[axis] - point[axis]) < 0:
            along = (b[0] - a[0], b[1] - a[1])
            share = ((point[0] - a[0]) * along[0] + (point[1] - a[1]) * along[1]) / (along[0] ** 2 + along[1] ** 2 + 1e-8)
            yield i, (a[0] + share * along[0], a[1] + share * along[1])
            return


def merge_nodes(paths: list[list[tuple]], replace: bool = False) -> list[list[tuple]]:
    """Joins ordered open paths of one slice; a node is (u, v, number or -1), and a bridge node has number -1.

    Takes the path that starts highest. While the v range of another holds the tail's v, the one ending
    lowest is joined: the first of its edges that crosses the tail's v, and the first that crosses its u,
    give feet of the tail; the nearer is the bridge (v on ties), appended or put in the tail's place, and
    the nodes after the edge follow. Open paths within the merged v range are then dropped."""
    todo = sorted((p for p in paths if len(p) > 1), key=lambda p: -p[0][1])
    out = []
    while todo:
        way = list(todo.pop(0))
        while True:
            tu, tv = way[-1][:2]
            fits = [p for p in todo if min(n[1] for n in p) <= tv <= max(n[1] for n in p)]
            if not fits:
                break
            other = min(fits, key=lambda p: p[-1][1])
            feet = [(math.dist(foot, (tu, tv)), place, i, (*foot, -1)) for place, axis in enumerate((1, 0)) for i, foot in _foot_where_crossed(other, (tu, tv), axis)]
            if not feet:
                break
            _, _, i, foot = min(feet)
            way[-1:] = [foot] if replace else [way[-1], foot]
            way += other[i + 1 :]
            todo.remove(other)
        out.append(way)
        lo, hi = min(n[1] for n in way), max(n[1] for n in way)
        todo = [p for p in todo if min(n[1] for n in p) < lo or max(n[1] for n in p) > hi]
    return out


def merge_open_paths(nodes: DataFrame, replace: bool = False) -> DataFrame:
    """Ordered nodes of merged paths of each slice: k, path_id, ord, u, v, source_path and source_ord (null at a bridge)."""

    def rows_of(key: tuple, table: pa.Table) -> list[tuple]:
        at = sorted(zip(*(table[c].to_pylist() for c in ("path_id", "ord", "u", "v"))))
        paths = defaultdict(list)
        for i, (path, _, u, v) in enumerate(at):
            paths[path].append((u, v, i))
        merged = merge_nodes(list(paths.values()), replace)
        return [(*key, p, o, u, v, *((None, None) if i < 0 else at[i][:2])) for p, way in enumerate(merged) for o, (u, v, i) in enumerate(way)]

    fields = [("k", pa.int64()), ("path_id", pa.int32()), ("ord", pa.int32()), ("u", pa.float64()), ("v", pa.float64()), ("source_path", pa.int32()), ("source_ord", pa.int32())]
    return _by_slice(nodes, ("k",), "path_id ord u v", rows_of, fields)


def recognise(segments: DataFrame, threshold: float = -0.1, tol: float = -0.3, y_tol: float = 1.0, most: float = 70.0, merge: bool = False) -> DataFrame:
    """All overhang groups of each slice in one grouped pass after one shuffle by plane: k, path_id, group_id, cu, cv, n_nodes, width, n_segments.

    Equals the composition components -> order_path -> overhangs -> grow_groups -> group_span -> group_centroids on open paths.
    With merge, the open paths of a slice are first joined as by merge_open_paths, and path_id counts the joined ones."""

    def rows_of(key: tuple, table: pa.Table) -> list[tuple]:
        walked = _Walked(table)
        rows, ways = [], {p: walked.at[way, 3:5] for p, (loose, way) in enumerate(walked.ways()) if loose}
        if merge:
            ways = dict(enumerate([n[:2] for n in way] for way in merge_nodes([[(u, v, i) for i, (u, v) in enumerate(way.tolist())] for way in ways.values()])))
        for p, way in ways.items():
            whole = np.asarray(way, float).reshape(-1, 2)
            du, dv = np.diff(whole, axis=0).T
            length = np.sqrt(du * du + dv * dv)
            with np.errstate(invalid="ignore", divide="ignore"):
                down = np.flatnonzero((length > 0) & (du / length < threshold))
            seeds = np.degrees(np.arccos(np.minimum(1.0, np.abs(dv[down]) / length[down]))) > 40
            red, uv = list(zip(down.tolist(), seeds.tolist(), strict=True)), whole.tolist()
            groups: list[list[int]] = []
            start = last = None
            for i, seed in reversed(red):
                grows = False
                if last is not None:
                    du, dv = abs(uv[i][0] - uv[start + 1][0]), abs(uv[i][1] - uv[start + 1][1])
                    grows = uv[i + 1][0] - uv[last][0] > tol and abs(uv[last][1] - uv[i + 1][1]) < y_tol and math.degrees(math.atan2(dv, du)) <= most
                if grows:
                    groups[-1].append(i)
                    last = i
                elif seed:
                    groups.append([i])
                    start = last = i
                else:
                    start = last = None
            for g, own in enumerate(groups):
                span = whole[min(own) : max(own) + 2]
                rows.append((*key, p, g, float(span[:, 0].mean()), float(span[:, 1].mean()), len(span), float(abs(span[-1, 0] - span[0, 0])), len(own)))
        return rows

    fields = [("k", pa.int64()), ("path_id", pa.int32()), ("group_id", pa.int32()), ("cu", pa.float64()), ("cv", pa.float64()), ("n_nodes", pa.int64()), ("width", pa.float64()), ("n_segments", pa.int64())]
    return _by_slice(segments, ("k",), _PLACES, rows_of, fields)
