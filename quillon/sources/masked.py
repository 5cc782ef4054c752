"""Scans and sinks of masked data: long rows (subject, lin, value) in, result maps out. Image decoding is left to the caller."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators.graph import Domain, NeuroError, node_table


@dataclass(frozen=True)
class MaskedData:
    """values (subject, node, value), nodes (lin, x, y, z, node) and the shape of the box."""

    values: DataFrame
    nodes: DataFrame
    dims: tuple[int, int, int]

    def domain(self, conn: int) -> Domain:
        """The graph of the nodes, on the driver."""
        import numpy as np

        mask = np.zeros(self.dims[0] * self.dims[1] * self.dims[2], bool)
        mask[self.nodes.select("lin").toArrow().column("lin").to_numpy()] = True
        return Domain.from_mask(mask.reshape(self.dims), conn)


def image_mask(volume: DataFrame, value: str = "value") -> DataFrame:
    """(lin) of voxels whose value is finite and not 0."""
    v = F.col(value).cast("double")
    return volume.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")) & (v != 0)).select("lin").distinct()


def import_from(data: DataFrame, dims: tuple[int, int, int], mask: DataFrame | None = None) -> MaskedData:
    """Long rows (subject, lin, value) with voxels numbered in C order; mask: rows (lin), all voxels that occur by default."""
    if {"subject", "lin", "value"} - set(data.columns):
        raise NeuroError("data needs the columns subject, lin and value")
    nodes = node_table(data.sparkSession, dims, mask if mask is not None else data.select("lin"))
    return MaskedData(data.join(nodes.select("lin", "node"), "lin").select("subject", "node", F.col("value").cast("double").alias("value")), nodes, dims)


def export_to(result: DataFrame, nodes: DataFrame, dims: tuple[int, int, int], path: str | None = None) -> DataFrame:
    """(lin, stat, tfce, log_p_fwe, log_p_unc) of every voxel of the box, 0 outside the mask; log_p is -log10. Written as Parquet where a path is given."""
    log = lambda c: (-F.log10(F.col(c))).alias(f"log_{c}")
    maps = result.join(nodes.select("lin", "node"), "node").select("lin", "stat", "tfce", log("p_fwe"), log("p_unc"))
    box = data_box(nodes, dims).join(maps, "lin", "left").na.fill(0.0)
    if path:
        box.write.parquet(path)
    return box


def data_box(nodes: DataFrame, dims: tuple[int, int, int]) -> DataFrame:
    """(lin) of every voxel of a box."""
    return nodes.sparkSession.range(dims[0] * dims[1] * dims[2]).select(F.col("id").alias("lin"))
