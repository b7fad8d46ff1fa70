"""Hazards: which nodes of a graph are hit. Each is a predicate or a join; an own kind subclasses Hazard."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


class Hazard:
    def impacted(self, nodes: DataFrame) -> DataFrame:
        """(graph_id, node_id) of the nodes hit."""
        raise NotImplementedError


class NodeHazard(Hazard):
    """Given nodes, of those that exist. ids: (graph_id, node_id)."""

    def __init__(self, ids: DataFrame):
        self.ids = ids

    def impacted(self, nodes):
        return nodes.join(self.ids.select("graph_id", "node_id").distinct(), ["graph_id", "node_id"], "left_semi").select("graph_id", "node_id")


class RadiusHazard(Hazard):
    """A disc, its rim included. center: (x, y), or a table (graph_id, cx, cy)."""

    def __init__(self, center, radius: float):
        self.center, self.radius = center, radius

    def impacted(self, nodes):
        if isinstance(self.center, DataFrame):
            nodes, cx, cy = nodes.join(self.center, "graph_id"), F.col("cx"), F.col("cy")
        else:
            cx, cy = map(F.lit, self.center)
        d2 = (F.col("x") - cx) * (F.col("x") - cx) + (F.col("y") - cy) * (F.col("y") - cy)
        return nodes.where(d2 <= self.radius * self.radius).select("graph_id", "node_id")


class BandHazard(Hazard):
    """A band along an axis, both ends included."""

    def __init__(self, axis: str = "y", lo: float = float("-inf"), hi: float = float("inf")):
        if axis not in ("x", "y"):
            raise ValueError("axis must be x or y")
        self.axis, self.lo, self.hi = axis, lo, hi

    def impacted(self, nodes):
        return nodes.where(F.col(self.axis).between(self.lo, self.hi)).select("graph_id", "node_id")


class RasterHazard(Hazard):
    """Nodes on raster cells: depth above the threshold, or elevation at most that. cells: (row, col, v), or with raster_id
    and headers for several rasters.

    inverse: affine (a, b, c, d, e, f) from x, y to col, row. Places truncate toward zero, as a cast to int does; a node
    off the raster, on a missing value or on NaN isn't hit. node_epsg, epsg: codes of the nodes' and the raster's
    coordinates; where they differ, nodes are moved first.
    """

    def __init__(self, cells: DataFrame, inverse, height: int, width: int, mode: str = "depth", threshold: float = 0.3, nodata: float | None = None, node_epsg: int | None = None, epsg: int | None = None):
        if mode not in ("depth", "elevation"):
            raise ValueError(f"unknown mode {mode!r}")
        self.cells, self.inverse, self.height, self.width, self.mode, self.threshold, self.nodata, self.node_epsg, self.epsg = cells, inverse, height, width, mode, threshold, nodata, node_epsg, epsg

    def _places(self, nodes):
        """nodes with the (raster_id, row, col) they lie on."""
        x, y = "x", "y"
        if self.node_epsg and self.epsg and self.node_epsg != self.epsg:
            from arterial.functions.geodesy import with_reprojected

            nodes = with_reprojected(nodes, self.node_epsg, self.epsg, ("moved_x", "moved_y"))
            x, y = "moved_x", "moved_y"
        a, b, c, d, e, f = map(float, self.inverse)
        at = nodes.withColumn("col", (a * F.col(x) + b * F.col(y) + c).cast("int")).withColumn("row", (d * F.col(x) + e * F.col(y) + f).cast("int"))
        return at.where(F.col("row").between(0, self.height - 1) & F.col("col").between(0, self.width - 1))

    def impacted(self, nodes):
        v = F.col("v")
        hit = v > self.threshold if self.mode == "depth" else v <= self.threshold
        ok = v.isNotNull() & ~F.isnan(v.cast("double"))
        if self.nodata is not None:
            ok = ok & (v != self.nodata)
        # the cells that hit are filtered before the join: of a raster mostly few
        return self._places(nodes).join(self.cells.where(ok & hit).select("row", "col"), ["row", "col"], "left_semi").select("graph_id", "node_id")


def raster_hazards(spark, path: str, mode: str = "depth", threshold: float = 0.3, band: int = 1, node_epsg: int | None = None) -> list[RasterHazard]:
    """A hazard for each raster file at path, with its own header, no-data value and coordinates."""
    from arterial.functions.scalars import inverse_affine
    from arterial.sources import tiff

    rasters = tiff.read(spark, path)
    found = []
    for r in rasters.where("error is null").select("path", "height", "width", "transform", "epsg", "nodata").toLocalIterator():
        cells = tiff.values(rasters.where(F.col("path") == r["path"]), band)
        found.append(RasterHazard(cells, inverse_affine(r["transform"] or (1, 0, 0, 0, 1, 0)), r["height"], r["width"], mode, threshold, r["nodata"], node_epsg, r["epsg"]))
    return found


#: Hazards by name; own kinds are added here.
HAZARDS = {"nodes": NodeHazard, "radius": RadiusHazard, "band": BandHazard, "raster": RasterHazard}
