"""Gaussian densities by polynomials over cells: work that follows samples and targets, not their product."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wallscan.operators.profiles import _slices

#: Cells of a block in each direction; a task works on one block at a time.
BLOCK = 8
#: Targets of a block that one task takes; a block with more is dealt to several.
MANY = 1 << 18


def _error(q: int) -> float:
    """Most that q Chebyshev points in each of six directions, on cells as wide as h, leave out of the kernel for one sample.

    One direction leaves at most sup|g^(q)| (1/4)**q * 2 / q! with |g^(q)| <= 1.09 sqrt(q!) for exp(-x**2 / 2) (Cramer);
    the others multiply it by no more than the Lebesgue constant 2 / pi * log(q + 1) + 1."""
    lebesgue = 2 / math.pi * math.log(q + 1) + 1
    return 2 * 1.09 * 0.25**q / math.sqrt(math.factorial(q)) * sum(lebesgue**i for i in range(6))


def order(tolerance: float) -> int:
    """Fewest points that leave out no more than tolerance; 0 if more than 16 are needed: then all is summed sample by sample."""
    return next((q for q in range(2, 17) if _error(q) <= tolerance), 0)


def _nodes(q: int) -> np.ndarray:
    return np.cos((2 * np.arange(q) + 1) * math.pi / (2 * q)) / 2 + 0.5


def _basis(x: np.ndarray, q: int) -> np.ndarray:
    """Values of the q Lagrange polynomials of Chebyshev points at x in [0, 1], a row each."""
    t, at = np.arccos(np.clip(2 * x - 1, -1, 1)), (2 * np.arange(q) + 1) * math.pi / (2 * q)
    k = np.arange(q)
    return (np.cos(t[:, None] * k) * np.where(k, 2.0, 1.0)) @ np.cos(k[:, None] * at) / q


def _moments(xyz: np.ndarray, q: int) -> np.ndarray:
    """The sample's weights at a cell's q**3 points, of places in the cell from 0 to 1."""
    out = np.zeros((q, q * q))
    for a in range(0, len(xyz), 4096):
        x, y, z = (_basis(xyz[a : a + 4096, d], q) for d in range(3))
        out += x.T @ (y[:, :, None] * z[:, None, :]).reshape(len(x), -1)
    return out


def _direct(at: np.ndarray, near: np.ndarray) -> np.ndarray:
    out = np.zeros(len(at))
    for a in range(0, len(at), 256):
        for b in range(0, len(near), 4096):
            out[a : a + 256] += np.exp(-sum((at[a : a + 256, d, None] - near[None, b : b + 4096, d]) ** 2 for d in range(3)) / 2).sum(1)
    return out


class _Held:
    """Samples about a block, in units of h: moments of cells with many, the places of others."""

    def __init__(self, q: int, few: int, reach: float):
        self.q, self.few, self.reach, self.parts = q, few, reach, {}

    def add(self, cell: tuple, n: list, raw: list, data: list) -> None:
        self.parts[cell] = (sum(n), list(zip(raw, data, strict=True)))

    def settle(self) -> None:
        full, thin = [], []
        for cell, (n, parts) in self.parts.items():
            places = [np.frombuffer(d).reshape(-1, 3) for raw, d in parts if raw]
            if n > self.few:
                total = sum((_moments(p, self.q) for p in places), np.zeros((self.q, self.q**2)))
                full.append((cell, n, total + sum(np.frombuffer(d).reshape(self.q, -1) for raw, d in parts if not raw)))
            else:
                thin += [(cell, p) for p in places]
        self.cells, self.n, self.full = np.array([c for c, *_ in full], np.int64).reshape(-1, 3), np.array([n for _, n, _ in full]), [m for *_, m in full]
        self.thin, self.places = np.array([c for c, _ in thin], np.int64).reshape(-1, 3), [p + np.array(c, float) for c, p in thin]

    def density(self, cell: tuple, at: np.ndarray) -> tuple[np.ndarray, int, float]:
        """Sums of the kernel at places `at` of a cell, the samples met, and the most that these sums may be wrong by."""
        origin, limit = np.array(cell, np.int64), self.reach**2
        apart = lambda cells: (np.maximum(np.abs(cells - origin) - 1, 0).astype(float) ** 2).sum(1) <= limit
        near = [self.places[i] - origin for i in np.flatnonzero(apart(self.thin))]
        near = np.concatenate(near) if near else np.zeros((0, 3))
        some = np.flatnonzero(apart(self.cells))
        if not len(some) and (not self.q or len(at) * 16 < self.q**3):
            return _direct(at, near), len(near), 0.0
        q, x = self.q, _nodes(self.q)
        local = np.zeros((q, q, q))
        shift = (self.cells - origin)[some].astype(float)
        for i, s in zip(some, shift, strict=True):
            kx, ky, kz = (np.exp(-((x[:, None] - x[None, :] - s[d]) ** 2) / 2) for d in range(3))
            part = (kx @ self.full[i]).reshape(q, q, q)
            local += ky @ (part @ kz.T)
        for b in range(0, len(near), 4096):
            gx, gy, gz = (np.exp(-((near[b : b + 4096, d, None] - x) ** 2) / 2) for d in range(3))
            local += (gx.T @ (gy[:, :, None] * gz[:, None, :]).reshape(len(gx), -1)).reshape(q, q, q)
        out = np.empty(len(at))
        for a in range(0, len(at), 4096):
            bx, by, bz = (_basis(at[a : a + 4096, d], q) for d in range(3))
            mid = (bx @ local.reshape(q, -1)).reshape(len(bx), q, q)
            out[a : a + 4096] = (np.einsum("nj,njk->nk", by, mid) * bz).sum(1)
        n = len(near) + int(self.n[some].sum())
        return out, n, n * _error(q)


def summed(samples: DataFrame, targets: DataFrame, h: float, tolerance: float, most: int = 32) -> DataFrame:
    """Sums of the kernel exp(-d**2 / (2 h**2)) of samples(x, y, z) at targets(id, x, y, z): id, sum, near, error.

    |sum - true sum| is at most error, for the `near` samples that were met, and tolerance more for each of the others.
    Cells are as wide as h. A cell with many samples is known by their weights at Chebyshev points; blocks of cells
    get those of the cells in reach, and the targets of a cell one polynomial of all of these. A cell with `most` samples
    or fewer, or whose places take less room than weights do, gives the places. So a sample is read once, what is sent follows samples and cells, a block holds a bounded number
    of them, and a block with many targets is dealt to several tasks. With a tolerance below that of 16 points
    all samples in reach are summed one by one. Samples that are infinite, or as far away as 1e15 h, count as out of reach."""
    from wallscan.operators.neighbours import checkpointed  # that module's densities are sums of this one

    q = order(tolerance)
    few = max(q**3 // 8, most) if q else 1 << 62
    reach = math.sqrt(2 * math.log(1 / tolerance)) if 0 < tolerance < 1 else 38.7  # beyond that exp() is 0
    wide = math.ceil(reach) + 1
    cell = [F.floor(F.col(d) / h).alias(f"c{d}") for d in "xyz"]
    key = ("cx", "cy", "cz")
    own = samples.select(*((F.col(d) / h - F.floor(F.col(d) / h)).alias(d) for d in "xyz"), *cell).where(" and ".join(f"abs(c{d}) < 1e15" for d in "xyz"))

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for at, table in _slices(batches, key):
            for a in range(0, len(table), 1 << 16):
                xyz = np.stack([table[d].to_numpy()[a : a + (1 << 16)] for d in "xyz"], 1)
                raw = len(xyz) <= few
                data = (xyz if raw else _moments(xyz, q)).tobytes()
                yield pa.RecordBatch.from_pydict({"cx": [at[0]], "cy": [at[1]], "cz": [at[2]], "n": [len(xyz)], "raw": [raw], "data": pa.array([data], pa.binary())})

    held = own.hint("rebalance", *(F.col(k) for k in key)).sortWithinPartitions(*key).mapInArrow(parts, "cx long, cy long, cz long, n long, raw boolean, data binary")
    block = [F.floor(F.col(c) / BLOCK).alias(f"b{c[1]}") for c in key]
    placed = targets.select("id", *((F.col(d) / h - F.floor(F.col(d) / h)).alias(d) for d in "xyz"), *cell).select("*", *block)
    sizes = checkpointed(placed.groupBy("bx", "by", "bz").agg(F.ceil(F.count("*") / MANY).alias("parts")))
    asked = placed.join(sizes, ["bx", "by", "bz"]).withColumn("part", F.pmod(F.xxhash64("id"), "parts"))
    for c in key:
        held = held.withColumn(f"b{c[1]}", F.explode(F.sequence(F.floor((F.col(c) - wide) / BLOCK), F.floor((F.col(c) + wide) / BLOCK))))
    held = held.join(sizes, ["bx", "by", "bz"]).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    groups = ("bx", "by", "bz", "part", "kind", *key)
    none = lambda kind: F.lit(None).cast(kind)
    rows = held.select("bx", "by", "bz", "part", F.lit(0).alias("kind"), *key, "n", "raw", "data", none("long").alias("id"), *(none("double").alias(d) for d in "xyz"))
    rows = rows.unionByName(asked.select("bx", "by", "bz", "part", F.lit(1).alias("kind"), *key, none("long").alias("n"), none("boolean").alias("raw"), none("binary").alias("data"), "id", *"xyz"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = about = None
        for at, table in _slices(batches, groups):
            if at[:4] != last:
                last, about, settled = at[:4], _Held(q, few, reach), False
            if not at[4]:
                about.add(at[5:], *(table[c].to_pylist() for c in ("n", "raw", "data")))
                continue
            if not settled:
                about.settle()
                settled = True
            total, n, off = about.density(at[5:], np.stack([table[d].to_numpy() for d in "xyz"], 1))
            full = lambda v, t: pa.array(np.full(len(total), v), t)
            yield pa.RecordBatch.from_arrays([table["id"].combine_chunks(), pa.array(total), full(n, pa.int64()), full(off, pa.float64())], names=["id", "sum", "near", "error"])

    return rows.repartition("bx", "by", "bz", "part").sortWithinPartitions(*groups).mapInArrow(run, "id long, sum double, near long, error double")
