"""Adjacency of nodes: voxel lattices, masks, and given graphs. Undirected, without self loops."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import IntEnum

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators.errors import StatError


class NeuroError(StatError):
    """Errors of graphs, enhancement and inference."""


class InvalidAdjacency(NeuroError):
    """A neighbour list that isn't one."""


class Conn(IntEnum):
    """Neighbours of a voxel: faces, edges too, corners too."""

    FACE = 6
    EDGE = 18
    VERTEX = 26


def offsets(conn: int) -> np.ndarray:
    """The steps (dx, dy, dz) to all neighbours, in lexicographic order."""
    if conn not in (6, 18, 26):
        raise NeuroError("conn must be 6, 18 or 26")
    most = {6: 1, 18: 2, 26: 3}[conn]
    g = np.stack(np.meshgrid(*[[-1, 0, 1]] * 3, indexing="ij"), -1).reshape(-1, 3)
    n = np.abs(g).sum(1)
    return g[(n > 0) & (n <= most)]


@dataclass(frozen=True)
class Domain:
    """n nodes and their edges (src < dst), as arrays; for lattices also the shape and the mask. Nodes of a mask are numbered in C order."""

    n: int
    src: np.ndarray
    dst: np.ndarray
    shape: tuple[int, int, int] | None = None
    mask: np.ndarray | None = field(default=None, repr=False)

    @classmethod
    def from_volume(cls, dims: tuple[int, int, int], conn: int) -> Domain:
        """Every voxel of a box."""
        return cls.from_mask(np.ones(dims, bool), conn)

    @classmethod
    def from_mask(cls, mask, conn: int) -> Domain:
        """The voxels of a mask."""
        mask = np.asarray(mask, bool)
        if mask.ndim != 3:
            raise NeuroError("a mask has three dimensions")
        number = np.full(mask.shape, -1, np.int64)
        number[mask] = np.arange(mask.sum())
        src, dst = [], []
        for step in offsets(conn):
            if tuple(step) < (0, 0, 0):
                continue  # each edge once
            a = tuple(slice(max(0, -d), s - max(0, d)) for d, s in zip(step, mask.shape, strict=True))
            b = tuple(slice(max(0, d), s - max(0, -d)) for d, s in zip(step, mask.shape, strict=True))
            both = mask[a] & mask[b]
            src.append(number[a][both])
            dst.append(number[b][both])
        u, v = np.concatenate(src), np.concatenate(dst)
        return cls(int(mask.sum()), np.minimum(u, v), np.maximum(u, v), mask.shape, mask)

    @classmethod
    def from_csr(cls, offs, neighbours) -> Domain:
        """Neighbour lists: those of node i are neighbours[offs[i]:offs[i + 1]]."""
        offs, neighbours = np.asarray(offs, np.int64), np.asarray(neighbours, np.int64)
        n = len(offs) - 1
        if n < 0 or offs[0] != 0 or offs[-1] != len(neighbours) or (np.diff(offs) < 0).any() or ((neighbours < 0) | (neighbours >= n)).any():
            raise InvalidAdjacency("offsets and neighbours don't fit")
        src = np.repeat(np.arange(n), np.diff(offs))
        if (src == neighbours).any():
            raise InvalidAdjacency("a node is its own neighbour")
        return cls._edges(n, src, neighbours)

    @classmethod
    def from_adjacency(cls, rows, cols, values=None, n: int | None = None) -> Domain:
        """Entries of an adjacency matrix: made symmetric; self loops, repeats and stored zeros are left out."""
        rows, cols = np.asarray(rows, np.int64), np.asarray(cols, np.int64)
        keep = rows != cols
        if values is not None:
            keep &= np.asarray(values) != 0
        n = n if n is not None else int(max(rows.max(initial=-1), cols.max(initial=-1))) + 1
        return cls._edges(n, rows[keep], cols[keep])

    @classmethod
    def _edges(cls, n: int, u: np.ndarray, v: np.ndarray) -> Domain:
        pairs = np.unique(np.stack((np.minimum(u, v), np.maximum(u, v)), 1), axis=0) if len(u) else np.zeros((0, 2), np.int64)
        return cls(n, pairs[:, 0].copy(), pairs[:, 1].copy())

    @property
    def n_nodes(self) -> int:
        return self.n

    @property
    def n_edges(self) -> int:
        """Directed edges."""
        return 2 * len(self.src)

    def neighbours(self, node: int) -> np.ndarray:
        """The neighbours of a node."""
        return np.sort(np.concatenate((self.dst[self.src == node], self.src[self.dst == node])))

    def to_csr(self) -> tuple[np.ndarray, np.ndarray]:
        """Offsets and sorted neighbours."""
        u, v = np.concatenate((self.src, self.dst)), np.concatenate((self.dst, self.src))
        order = np.lexsort((v, u))
        return np.concatenate(([0], np.cumsum(np.bincount(u, minlength=self.n)))), v[order]

    def to_nodes(self, volume: np.ndarray) -> np.ndarray:
        """A value for each node, from a vector or a volume."""
        volume = np.asarray(volume, float)
        if volume.ndim == 1:
            if len(volume) != self.n:
                raise NeuroError(f"needs {self.n} values, got {len(volume)}")
            return volume
        if self.mask is None or volume.shape != self.shape:
            raise NeuroError("the volume doesn't fit the mask")
        return volume[self.mask]

    def scatter(self, values: np.ndarray, fill: float = 0.0) -> np.ndarray:
        """A volume with the nodes' values."""
        out = np.full(self.shape, fill)
        out[self.mask] = values
        return out


def node_table(spark: SparkSession, dims: tuple[int, int, int], mask: DataFrame | None = None) -> DataFrame:
    """(lin, x, y, z, node) of a box, or of the rows lin of a mask; node numbers the rows in C order.

    Numbers are dealt out by ranges: counts of ranges are summed, so no window runs over all voxels.
    """
    _, ny, nz = dims
    total = dims[0] * ny * nz
    rows = spark.range(total).select(F.col("id").alias("lin"))
    if mask is not None:
        rows = rows.join(mask.select("lin").distinct(), "lin", "left_semi")
    size = max(1, total // 1024)
    from pyspark.sql import Window

    rows = rows.withColumn("_part", F.floor(F.col("lin") / size))
    counts = rows.groupBy("_part").agg(F.count("*").alias("_n"))  # about a thousand rows
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_part", "_before")
    w = Window.partitionBy("_part").orderBy("lin")
    lin = F.col("lin")
    return rows.join(F.broadcast(before), "_part").select("lin", F.floor(lin / (ny * nz)).cast("int").alias("x"), (F.floor(lin / nz) % ny).cast("int").alias("y"), (lin % nz).cast("int").alias("z"), (F.col("_before") + F.row_number().over(w) - 1).alias("node"))


def edge_table(nodes: DataFrame, dims: tuple[int, int, int], conn: int) -> DataFrame:
    """(src, dst) of a node table, both directions: an equi join on the neighbours' places."""
    nx, ny, nz = dims
    steps = F.array(*(F.struct(*(F.lit(int(v)).alias(a) for v, a in zip(s, ("dx", "dy", "dz"), strict=True))) for s in offsets(conn)))
    near = nodes.select("node", "x", "y", "z", F.explode(steps).alias("s"))
    x, y, z = F.col("x") + F.col("s.dx"), F.col("y") + F.col("s.dy"), F.col("z") + F.col("s.dz")
    inside = (x >= 0) & (x < nx) & (y >= 0) & (y < ny) & (z >= 0) & (z < nz)
    near = near.where(inside).select(F.col("node").alias("src"), ((x * ny + y) * nz + z).cast("long").alias("lin"))
    return near.join(nodes.select("lin", F.col("node").alias("dst")), "lin").select("src", "dst")
