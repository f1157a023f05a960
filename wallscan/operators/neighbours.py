"""Neighbour joins over grids and trees of boxes, components, hops, cluster reports and densities."""

from __future__ import annotations

import itertools
import math
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wallscan.operators.clouds import quantise
from wallscan.operators.densities import summed


def _cells(df: DataFrame, dims: Sequence[str], size: float) -> DataFrame:
    return df.select("*", *(F.floor(F.col(d) / size).alias(f"_c{d}") for d in dims))


def moved(df: DataFrame) -> DataFrame:
    """df, to be joined by key and never broadcast.

    Spark expects of a table what its files hold, compressed, and nothing of the rows that are made from one. Of a kept
    table in a file of 10 MB the rows, hashed on the driver, can be a hundred times as large."""
    return df.hint("merge")


def _around(df: DataFrame, dims: Sequence[str], rings: int) -> DataFrame:
    """Each row once for each cell within `rings` cells of its own; what joins it is moved, like these rows."""
    steps = [F.struct(*(F.lit(x).alias(d) for d, x in zip(dims, s, strict=True))) for s in itertools.product(range(-rings, rings + 1), repeat=len(dims))]
    out = df.withColumn("_s", F.explode(F.array(*steps)))
    for d in dims:
        out = out.withColumn(f"_c{d}", F.col(f"_c{d}") + F.col(f"_s.{d}"))
    return moved(out.drop("_s"))


def squared(dims: Sequence[str], a: str = "a", b: str = "b") -> Column:
    return sum(((F.col(f"{a}_{d}") - F.col(f"{b}_{d}")) * (F.col(f"{a}_{d}") - F.col(f"{b}_{d}")) for d in dims), F.lit(0.0))


def pairs_within(points: DataFrame, radius: float, dims: Sequence[str] = "xyz", id_col: str = "id") -> DataFrame:
    """All ordered pairs of different points within radius: a, b. Cells are as wide as the radius, so neighbours are in adjacent cells."""
    cells = [f"_c{d}" for d in dims]
    p = _cells(points, dims, radius)
    a = _around(p, dims, 1).select(F.col(id_col).alias("a"), *(F.col(d).alias(f"a_{d}") for d in dims), *cells)
    b = p.select(F.col(id_col).alias("b"), *(F.col(d).alias(f"b_{d}") for d in dims), *cells)
    return a.join(b, cells).where((squared(dims) <= radius * radius) & (F.col("a") != F.col("b"))).select("a", "b")


#: A node of the tree that holds more targets is split.
LEAF = 32
#: Tables of nodes of no more rows are broadcast; larger ones are joined by key.
SMALL_LEVEL = 50_000


def gap(dims: Sequence[str], a: str, b: str) -> Column:
    """Least squared distance of two boxes a_lo_x, a_hi_x, ... and b_lo_x, ...; exact for boxes that are points."""
    apart = lambda d: F.greatest(F.col(f"{b}_lo_{d}") - F.col(f"{a}_hi_{d}"), F.col(f"{a}_lo_{d}") - F.col(f"{b}_hi_{d}"), F.lit(0.0))
    return sum((apart(d) * apart(d) for d in dims), F.lit(0.0))


def span(dims: Sequence[str], a: str, b: str) -> Column:
    """Greatest squared distance of two points in two boxes."""
    apart = lambda d: F.greatest(F.col(f"{b}_hi_{d}") - F.col(f"{a}_lo_{d}"), F.col(f"{a}_hi_{d}") - F.col(f"{b}_lo_{d}"))
    return sum((apart(d) * apart(d) for d in dims), F.lit(0.0))


def box(dims: Sequence[str]) -> list[Column]:
    """Aggregates lo_x, hi_x, ..."""
    return [f(d).alias(f"{n}_{d}") for d in dims for n, f in (("lo", F.min), ("hi", F.max))]


def _hinted(table: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(table) if rows <= SMALL_LEVEL else moved(table)


def _at_most(column: str):
    return lambda cut: cut <= F.col(column)


def split_tree(rows: DataFrame, dims: Sequence[str], most: int = LEAF, *more: Column) -> tuple[DataFrame, list[tuple[DataFrame, int]]]:
    """rows with `node`, the leaf of each, and the levels of a tree of boxes over them.

    A node with more than `most` rows is split in each dimension at the sketched quartiles of its own rows,
    or at the mean where these are one value, so crowds get small boxes and a child holds a fraction of its
    parent. Rows that are all at one place stay together, and so do those of a node at the last level that
    numbers of 60 bits allow. Each level is (table, its number of rows): parent, node, n, leaf, the tight box
    and the aggregates `more`. Each round is one aggregate and one join of the rows not in leaves yet.
    """
    bits, depth = 2 * len(dims), 0
    rows, settled, levels = checkpointed(rows.withColumn("node", F.lit(0).cast("long"))), None, []
    wide = lambda d: F.col(f"hi_{d}") > F.col(f"lo_{d}")
    cuts = lambda d: F.when(~wide(d), F.array().cast("array<double>")).when(F.col(f"q_{d}")[0] == F.col(f"q_{d}")[2], F.array(f"m_{d}")).otherwise(F.col(f"q_{d}"))
    while True:
        depth += 1
        quartiles = [F.percentile_approx(d, F.array(*(F.lit(q) for q in (0.25, 0.5, 0.75))), F.lit(100)).alias(f"q_{d}") for d in dims]
        stats = rows.groupBy("node").agg(F.count("*").alias("n"), *box(dims), *(F.avg(d).alias(f"m_{d}") for d in dims), *quartiles, *more)
        over = (F.col("n") > most) & F.lit(depth * bits <= 60) & F.greatest(*(wide(d) for d in dims), F.lit(False))
        stats = checkpointed(stats.withColumn("leaf", ~over).withColumn("parent", F.shiftright("node", bits) - 1))
        n = stats.count()
        levels.append((stats.drop(*(f"{c}_{d}" for d in dims for c in ("q", "m"))), n))
        if stats.where("not leaf").isEmpty():
            return rows if settled is None else settled.unionByName(rows), levels
        moved = rows.join(_hinted(stats.select("node", "leaf", *(cuts(d).alias(f"q_{d}") for d in dims)), n), "node")
        done = moved.where("leaf").select(rows.columns)
        settled = done if settled is None else settled.unionByName(done)
        child = F.lit(0)
        for d in dims:
            child = child * 4 + F.size(F.filter(f"q_{d}", _at_most(d)))
        rows = checkpointed(moved.where("not leaf").withColumn("node", F.shiftleft(F.col("node") + 1, bits) + child).select(rows.columns))


def nearest(points: DataFrame, targets: DataFrame, k: int, dims: Sequence[str] = "xyz", id_col: str = "id", target_id: str = "id") -> DataFrame:
    """The k nearest targets of each point: id, target, distance, rank; ties by target id. Exact.

    Targets are split into boxes of at most max(LEAF, 2 k) of them, small where they crowd. All points go down
    this tree together: a box with k targets bounds the distance of the k-th by its farthest corner, and boxes
    beyond the least such bound are left, so a point meets the targets of a few leaves, however uneven
    the targets lie. Of targets at one place only the k with the least ids can be among the nearest, and no
    others are kept. A leaf's targets are one row, of which a point takes the k nearest within its bound at once, so
    the rows that are moved and ranked are k for a leaf, not all its targets. Fewer than k targets give fewer rows; a point or a target without a coordinate gives none.
    """
    known = lambda df: df.dropna(subset=list(dims))
    every = known(targets.select(F.col(target_id).alias("_b"), *(F.col(d).cast("double").alias(d) for d in dims)))
    same = F.row_number().over(Window.partitionBy(*dims).orderBy("_b"))
    every, levels = split_tree(every.withColumn("_r", same).where(f"_r <= {k}").drop("_r"), dims, max(LEAF, 2 * k))
    met = known(points.select(F.col(id_col).alias("_a"), *(F.col(d).cast("double").alias(d) for d in dims))).select("_a", *(F.col(d).alias(f"a_{e}_{d}") for d in dims for e in ("lo", "hi")))
    at = met.columns
    met = met.select("*", F.lit(-1).cast("long").alias("node"), F.lit(float("inf")).alias("bound"), F.lit(0.0).alias("_gap"))
    for level, n in levels:  # down to the children; a leaf has none and stays
        boxes = level.select(F.col("parent").alias("node"), F.col("node").alias("_child"), "n", *(F.col(f"{e}_{d}").alias(f"b_{e}_{d}") for d in dims for e in ("lo", "hi")))
        down, inner = met.join(_hinted(boxes, n), "node", "left"), F.col("_child").isNotNull()
        down = down.withColumn("_gap", F.when(inner, gap(dims, "a", "b")).otherwise(F.col("_gap"))).where("_gap <= bound")
        bound = F.when(F.col("n") >= k, F.least("bound", span(dims, "a", "b"))).otherwise(F.col("bound"))
        down = down.select(*at, F.coalesce("_child", "node").alias("node"), bound.alias("bound"), "_gap")
        met = down.withColumn("bound", F.min("bound").over(Window.partitionBy("_a"))).where("_gap <= bound")
    leaves = every.groupBy("node").agg(F.collect_list(F.struct("_b", *dims)).alias("_t"))
    apart = lambda t: F.struct(sum(((F.col(f"a_lo_{d}") - t[d]) * (F.col(f"a_lo_{d}") - t[d]) for d in dims), F.lit(0.0)).alias("_d2"), t["_b"].alias("_b"))
    own = F.slice(F.array_sort(F.filter(F.transform("_t", apart), lambda t: t["_d2"] <= F.col("bound"))), 1, k)
    few = met.join(leaves, "node").select("_a", own.alias("_t")).where(F.size("_t") > 0)
    few = few.repartition(int(few.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_a").select("_a", F.inline("_t"))
    order = Window.partitionBy("_a").orderBy("_d2", "_b")
    ranked = few.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select(F.col("_a").alias("id"), F.col("_b").alias("target"), F.sqrt("_d2").alias("distance"), "rank")


#: Levels of cells below that of the largest coordinate; smaller boxes share the last.
LEVELS = 40


def bbox_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs of rectangles (id, x_lo, y_lo, x_hi, y_hi) that overlap, borders included.

    Both directions are first measured in the power of two next to the median side in that direction, so that
    rectangles of one long shape are like squares. A rectangle belongs to the level of its own size, whose cells have
    the power of two above its longer side, so it covers four of them or fewer. Two meet at the level of the larger: each is dealt to its own level and
    to the coarser ones that the other side has, LEVELS + 2 or fewer, and a giant among small ones lies in four
    cells. A pair is kept in the cell of the overlap's lower corner only, so it comes once. Rectangles with a
    null or infinite coordinate, and those whose lower corner lies above the upper, overlap nothing.
    """
    sides = ("x_lo", "y_lo", "x_hi", "y_hi")
    finite = lambda df: df.select("id", *(F.col(c).cast("double").alias(c) for c in sides)).where(" and ".join(f"abs({c}) < double('infinity')" for c in sides)).where("x_lo <= x_hi and y_lo <= y_hi")
    a, b = finite(a), finite(b)
    long = lambda d: F.col(f"{d}_hi") - F.col(f"{d}_lo")
    medians = [F.percentile_approx(F.when(long(d) > 0, long(d)), 0.5) for d in "xy"]
    median = a.unionByName(b).agg(*medians).first()
    unit = {d: 2.0 ** round(math.log2(m)) if m and math.isfinite(m) else 1.0 for d, m in zip("xy", median, strict=True)}
    largest = F.max(F.greatest(*(F.abs(c) / unit[c[0]] for c in sides)))
    scale = max((r[0] or 0.0 for r in a.agg(largest).unionAll(b.agg(largest)).collect()), default=0.0)
    least = math.ceil(math.log2(scale)) - LEVELS if scale else 0
    side = F.greatest(*(long(d) / unit[d] for d in "xy"))
    level = F.when(side > 0, F.greatest(F.lit(least), F.ceil(F.log2(side)).cast("int"))).otherwise(F.lit(least))
    a, b = a.withColumn("_level", level), b.withColumn("_level", level)

    def dealt(df: DataFrame, p: str, levels: Column) -> DataFrame:
        cell = lambda c: F.floor(F.col(c) / unit[c[0]] / F.pow(F.lit(2.0), "_at"))
        at = df.withColumn("_at", F.explode(levels))
        out = at.withColumn("_cx", F.explode(F.sequence(cell("x_lo"), cell("x_hi")))).withColumn("_cy", F.explode(F.sequence(cell("y_lo"), cell("y_hi"))))
        return out.select("_at", "_cx", "_cy", *(F.col(c).alias(f"{p}_{c}") for c in ("id", *sides)))

    def met(large: DataFrame, small: DataFrame, p: str, q: str, equal: bool) -> DataFrame:
        known = F.array(*(F.lit(r[0]) for r in large.select("_level").distinct().collect())).cast("array<int>")  # LEVELS + 2 numbers or fewer
        coarser = F.filter(known, lambda at: at >= F.col("_level") if equal else at > F.col("_level"))
        both = dealt(large, p, F.array("_level")).join(dealt(small, q, coarser), ["_at", "_cx", "_cy"]).where("a_x_lo <= b_x_hi and b_x_lo <= a_x_hi and a_y_lo <= b_y_hi and b_y_lo <= a_y_hi")
        own = [F.floor(F.greatest(f"a_{d}_lo", f"b_{d}_lo") / unit[d] / F.pow(F.lit(2.0), "_at")) == F.col(f"_c{d}") for d in "xy"]
        return both.where(own[0] & own[1]).select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))

    return met(a, b, "a", "b", True).unionByName(met(b, a, "b", "a", False))


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which driver and executors share. Only a local master, where all is one machine, gets a new folder if that is unset."""
    known = spark.sparkContext.getCheckpointDir()
    base = spark.conf.get("spark.checkpoint.dir", None) or known
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='spark-wallscan-')}"
    if not known:
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """df written as a table to the checkpoint folder that all executors share, and read from it.

    Columns are compressed and read one by one, and the table's size is known, so small ones are broadcast in joins;
    a checkpoint of rows is several times as large and of unknown size."""
    path = f"{shared_folder(df.sparkSession)}/wallscan/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(ids: DataFrame, id_col: str, name: str) -> DataFrame:
    """Distinct ids with their rank from 0 by id, as long.

    Ranks are counted within blocks of 4096 ids and offset by the blocks before, and these again, so no
    task ranks all ids."""
    used = ids.select(id_col).withColumn("_b", F.floor(F.col(id_col) / 4096))
    sizes = used.groupBy("_b").agg(F.count("*").alias("_n")).withColumn("_s", F.floor(F.col("_b") / 4096))
    tops = sizes.groupBy("_s").agg(F.sum("_n").alias("_t")).withColumn("_top", F.sum("_t").over(Window.orderBy("_s")) - F.col("_t"))
    before = sizes.withColumn("_in", F.sum("_n").over(Window.partitionBy("_s").orderBy("_b")) - F.col("_n")).join(tops, "_s").select("_b", (F.col("_in") + F.col("_top")).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_b").orderBy(id_col)) - 1
    return used.withColumn("_r", place).join(before, "_b").select(id_col, (F.col("_r") + F.col("_before")).cast("long").alias(name))


def least_labels(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, label): the least node of each connected component of edges (a, b), by star contraction.

    Raises RuntimeError when labels still change after so many rounds; a round halves the longest way, roughly."""
    e = checkpointed(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = None
    for _ in range(rounds):
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state or not now[0]:
            break
        state = now
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))  # least has no more rows, and twice as many as links at most
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(_hinted(least, now[0]), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(_hinted(least, now[0]), "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        e = checkpointed(small.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def dbscan_from_pairs(ids: DataFrame, pairs: DataFrame, min_samples: int) -> DataFrame:
    """DBSCAN labels (id, label) from all ordered pairs of neighbours.

    A core has min_samples neighbours, itself included; clusters are the components of core-core
    pairs; a border point takes the least label next to it; labels count from 0 by least core id; the
    rest is noise, -1."""
    pairs = checkpointed(pairs)
    core = pairs.groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") + 1 >= min_samples).select(F.col("a").alias("core"))
    if min_samples <= 1:
        core = ids.select(F.col("id").alias("core"))
    core = checkpointed(core)
    n = core.count()  # and no more rows have the tables of cores
    links = pairs.join(_hinted(core, n), pairs.a == core.core, "left_semi").join(_hinted(core, n), pairs.b == core.core, "left_semi")
    root = core.join(_hinted(least_labels(links), n), F.col("core") == F.col("node"), "left").select("core", F.coalesce("label", "core").alias("root"))
    roots = root.select("root").distinct()
    number = numbered(roots, "root", "label").withColumn("label", F.col("label").cast("int"))
    labelled = root.join(_hinted(number, n), "root").select(F.col("core").alias("id"), "label")
    border = pairs.join(_hinted(core, n), pairs.a == core.core, "left_anti").join(_hinted(labelled, n), pairs.b == labelled.id).groupBy("a").agg(F.min("label").alias("label")).select(F.col("a").alias("id"), "label")
    known = labelled.unionByName(border)
    return ids.select("id").join(moved(known), "id", "left").select("id", F.coalesce("label", F.lit(-1)).alias("label"))


def hops(edges: DataFrame, targets: DataFrame, most: int) -> DataFrame:
    """Hop distances d in 1..most between target faces (a, b both ways); the way may pass other faces.

    edges has each pair once (a < b). A shortest way of d hops has a face that is ceil(d / 2) hops from one end
    and floor(d / 2) from the other. So ways are walked from all targets over half of `most` only, and meet at
    that face. Links that start farther from every target are left out first, by semi joins with the faces within
    reach, so no round moves the links of all faces; later work follows the targets."""
    half = (most + 1) // 2
    every = checkpointed(edges.select("a", "b"))
    both = every.select(F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))))
    start = checkpointed(targets.select(F.col("face_id").alias("a")).distinct())
    reached, step = start, None
    for d in range(half):
        if d:
            reached = checkpointed(reached.unionByName(step.select(F.col("b").alias("a"))).distinct())
        step = checkpointed(both.join(reached, "a", "left_semi"))
    seen = front = start.select("a", F.col("a").alias("b"), F.lit(0).alias("d"))
    for d in range(1, half + 1):
        new = front.select("a", "b").join(step.select(F.col("a").alias("b"), F.col("b").alias("c")), "b").select("a", F.col("c").alias("b")).distinct().join(seen, ["a", "b"], "left_anti")
        front = checkpointed(new.withColumn("d", F.lit(d)))
        seen = seen.unionByName(front)
    far = seen.select("a", F.col("b").alias("face"), F.col("d").alias("far"))
    near = seen.select(F.col("a").alias("b"), F.col("b").alias("face"), F.col("d").alias("near"))
    met = far.join(near, "face").where(f"a != b and far - near between 0 and 1 and far + near <= {most}")
    return met.groupBy("a", "b").agg(F.min(F.col("far") + F.col("near")).alias("d"))  # every pair is met from both ends


def cluster_stats(labelled: DataFrame, meta: DataFrame, size: float) -> DataFrame:
    """For each label n, volume and centroid of voxels(label, ix, iy, iz) of a grid (ox, oy, oz: its origin).

    Indices are summed as whole numbers and scaled once, so a centroid doesn't depend on the order of rows."""
    sums = labelled.groupBy("label").agg(F.count("*").alias("n"), *(F.sum(f"i{d}").alias(f"s{d}") for d in "xyz"))
    centre = lambda d: F.col(f"o{d}") + size * (F.col(f"s{d}") / F.col("n") + 0.5)
    return sums.crossJoin(F.broadcast(meta)).select("label", "n", (F.col("n") * size**3).alias("volume"), *(centre(d).alias(f"c{d}") for d in "xyz"))  # meta is one row


def volume_report(stats: DataFrame, v_min: float, v_max: float) -> DataFrame:
    """Totals of the clusters, of noise (label -1), and of the clusters within [v_min, v_max]."""
    valid, inside = F.col("label") >= 0, (F.col("label") >= 0) & F.col("volume").between(v_min, v_max)
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("volume"))), F.lit(0.0))
    s = stats.agg(F.coalesce(F.sum("volume"), F.lit(0.0)).alias("total_volume"), total(valid).alias("valid_volume"), total(~valid).alias("noise_volume"), F.count(F.when(valid, 1)).alias("n_clusters"), F.count(F.when(inside, 1)).alias("n_in_range"), total(inside).alias("range_volume"))
    share = lambda a, b: F.when(F.col(b) > 0, 100 * F.col(a) / F.col(b)).otherwise(0.0)
    return s.select("*", share("noise_volume", "total_volume").alias("noise_percent"), share("range_volume", "valid_volume").alias("range_percent"))


def top_blocks(stats: DataFrame, k: int = 10) -> DataFrame:
    """The k largest clusters, ties by label; noise is left out."""
    return stats.where("label >= 0").orderBy(F.col("n").desc(), "label").limit(k)


def block(labelled: DataFrame, stats: DataFrame, rank: int) -> DataFrame:
    """Points of the block of a rank, 1 being the largest; none when there is no such block."""
    place = F.row_number().over(Window.orderBy(F.col("n").desc(), "label"))  # over `rank` rows
    return labelled.join(top_blocks(stats, rank).withColumn("_place", place).where(F.col("_place") == rank).select("label"), "label", "left_semi")


#: kde without a cutoff takes no more samples.
MOST_SAMPLES = 200_000
#: Share of the kernel's peak that kde without a cutoff may leave out for each sample, at most: about what additions of doubles do.
CLOSE = 1e-12


def kde(samples: DataFrame, targets: DataFrame, h: float, cutoff: float | None = None) -> DataFrame:
    """Gaussian density of samples(x, y, z) at targets(id, x, y, z): id, density.

    Without a cutoff each target sums over all of at most MOST_SAMPLES samples, as `densities.summed` does it
    within CLOSE; more raise ValueError. With a cutoff, in units of h, samples and targets are dealt in
    cells of that width and a target sums over what is within it, at every size: at 4 what is left out is
    below exp(-8) of a kernel's peak for each sample."""
    n = samples.count()
    scale = max(n * (2 * math.pi) ** 1.5 * h**3, 1e-300)
    if cutoff is None:
        if n > MOST_SAMPLES:
            raise ValueError(f"{n} samples: give a cutoff, or sample at most {MOST_SAMPLES}")
        sums = summed(samples.select(*"xyz"), targets.select(F.col("id").cast("long").alias("id"), *"xyz"), h, CLOSE)
        return sums.select("id", (F.col("sum") / scale).alias("density"))
    width = cutoff * h
    cell = lambda df, p: df.select("*", *(F.floor(F.col(f"{p}_{d}") / width).alias(f"_c{d}") for d in "xyz"))
    b = samples.select(*(F.col(d).alias(f"b_{d}") for d in "xyz"))
    a = targets.select(F.col("id").cast("long").alias("id"), *(F.col(d).alias(f"a_{d}") for d in "xyz"))
    met = _around(cell(a, "a"), "xyz", 1).join(cell(b, "b"), [f"_c{d}" for d in "xyz"]).where(squared("xyz") <= width * width)
    found = met.groupBy("id").agg((F.sum(F.exp(-squared("xyz") / (2 * h * h))) / scale).alias("density"))
    return a.select("id").join(found, "id", "left").select("id", F.coalesce("density", F.lit(0.0)).alias("density"))


def certified_kde(samples: DataFrame, targets: DataFrame, h: float, tolerance: float = 1e-3, most: int = LEAF) -> DataFrame:
    """Gaussian density of any number of samples(x, y, z) at targets(id, x, y, z): id, density, error.

    Sums are those of `densities.summed`, whose polynomials are proven to leave out at most `tolerance` of the
    kernel's peak for each sample, as do samples out of reach. So |density - true density| <= error <=
    tolerance / ((2 pi)**1.5 h**3). No sample is left out and none is sent to all tasks. Rows without a
    coordinate are left out; without samples all is 0.
    """
    dims = "xyz"
    known = lambda df, *names: df.select(*names, *(F.col(d).cast("double").alias(d) for d in dims)).dropna(subset=list(dims))
    samples = known(samples)
    n = samples.count()
    scale = max(n * (2 * math.pi) ** 1.5 * h**3, 1e-300)
    sums = summed(samples, known(targets, F.col("id").cast("long").alias("id")), h, tolerance, most)
    return sums.select("id", (F.col("sum") / scale).alias("density"), ((F.col("error") + (n - F.col("near")) * F.lit(float(tolerance))) / scale).alias("error"))


def density_by_size(stats: DataFrame, targets: DataFrame, v_min: float, v_max: float, h: float, cutoff: float | None = None) -> DataFrame:
    """Density, at targets, of the centroids of the blocks with a volume within [v_min, v_max], as they are stored in whole steps."""
    some = stats.where((F.col("label") >= 0) & F.col("volume").between(v_min, v_max))
    q = quantise(some.select(F.col("label").cast("long").alias("point_id"), *(F.col(f"c{d}").alias(d) for d in "xyz")))
    return kde(q.select(*((F.col(f"q{d}") * 0.001 + F.col(f"{d}_off")).alias(d) for d in "xyz")), targets, h, cutoff)
