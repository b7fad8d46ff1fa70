"""The flagship composition: mask -> graph -> healing -> criticality -> hazard -> resilience report, all tiles at once."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, functions as F

from arterial.operators import graph as G, raster as R, resilience
from arterial.operators.hazard import Hazard, RadiusHazard


def healed_graph(cells: DataFrame, width: int, transform=None, resolution: float = 1.0, heal: bool = True, max_gap: float = 40.0):
    """(nodes, edges, bridges) of every tile."""
    nodes, edges = R.mask_to_graph(cells, width, transform, resolution)
    bridges = G.heal(nodes, edges, max_gap)
    marked = edges.withColumn("healed", F.lit(False))
    if heal:
        marked = marked.unionByName(bridges.withColumn("healed", F.lit(True)))
    return nodes, marked, bridges


def tile_graph(cells: DataFrame, width: int, transform=None, resolution: float = 1.0, epsg: int | None = None, heal: bool = True, max_gap: float = 40.0):
    """(nodes, edges) of every tile, healed; with a UTM code, nodes have lon and lat too."""
    nodes, edges, _ = healed_graph(cells, width, transform, resolution, heal, max_gap)
    if epsg:
        from arterial.functions.geodesy import with_reprojected

        nodes = with_reprojected(nodes, epsg, 4326)
    return nodes, edges


_TILE = f"graph_id string, {resilience._REPORT}, critical_nodes array<long>, n_bridges long, empty boolean"


def _tile(pdf, width, transform, resolution, heal, max_gap, radius, top):
    """A tile's whole chain in one call: its graph is made once and stays where it is."""
    import numpy as np
    import pandas as pd

    from arterial.operators import kernels as K

    mask = np.zeros((int(pdf["row"].max()) + 1, width), bool)
    mask[pdf["row"], pdf["col"]] = True
    adj, xy = K.mask_graph(mask, transform, resolution)
    names = [c.split()[0] for c in _TILE.split(", ")]
    if not adj:
        return pd.DataFrame([(pdf["tile_id"].iloc[0], *[None] * 9, 0, True)], columns=names)
    bridges = K.heal(adj, xy, max_gap)
    healed = K.with_edges(adj, bridges) if heal else adj
    bc = K.betweenness(healed)
    worst = sorted(bc, key=lambda v: (-bc[v], v))[:top]
    cx, cy = xy[worst[0]]
    hit = [u for u, (x, y) in xy.items() if (x - cx) * (x - cx) + (y - cy) * (y - cy) <= radius * radius]
    got = K.report(healed, hit)
    return pd.DataFrame([(pdf["tile_id"].iloc[0], *(got[n] for n in names[1:9]), worst, len(bridges), False)], columns=names)


def tile_reports(cells: DataFrame, width: int, transform=None, resolution: float = 1.0, heal: bool = True, max_gap: float = 12.0, radius: float = 5.0, top: int = 5, hazard: Hazard | None = None) -> DataFrame:
    """One row per tile; a tile whose mask gives no graph is marked empty. Without a hazard, a disc around the most critical
    node: one kernel call per tile, one shuffle in all. With one, the operators' composition, as a hazard may be a join."""
    if hazard is None:
        run = partial(_tile, width=width, transform=transform, resolution=resolution, heal=heal, max_gap=max_gap, radius=radius, top=top)
        return cells.select("tile_id", "row", "col").groupBy("tile_id").applyInPandas(run, _TILE)
    tiles = cells.select(F.col("tile_id").alias("graph_id")).distinct()
    nodes, edges, bridges = healed_graph(cells, width, transform, resolution, heal, max_gap)
    worst = G.critical(G.betweenness(nodes, edges), top)
    names = worst.groupBy("graph_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "node_id"))), lambda s: s["node_id"]).alias("critical_nodes"))
    healed = bridges.groupBy("graph_id").agg(F.count("*").alias("n_bridges"))
    rep = resilience.report(nodes, edges, hazard)
    out = tiles.join(rep, "graph_id", "left").join(names, "graph_id", "left").join(healed, "graph_id", "left")
    return out.withColumn("n_bridges", F.coalesce("n_bridges", F.lit(0))).withColumn("empty", F.col("n_nodes").isNull())


def as_json(reports: DataFrame) -> DataFrame:
    """Reports as JSON text; infinities become strings, which JSON lacks."""
    cols = [F.when(F.col(c) == float("inf"), F.lit(None)).otherwise(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in reports.dtypes]
    return reports.select("graph_id", F.to_json(F.struct(*cols)).alias("report"))


def healing_ablation(cells: DataFrame, width: int, max_gap: float = 12.0) -> DataFrame:
    """Means over tiles of components and largest component before and after healing, with changes in percent."""
    nodes, edges, bridges = healed_graph(cells, width, max_gap=max_gap)
    plain = edges.where("not healed")
    a = G.stats(nodes, plain).select("graph_id", F.col("n_components").alias("before")).join(G.stats(nodes, edges).select("graph_id", F.col("n_components").alias("after")), "graph_id")
    b = G.largest_component(nodes, plain).withColumnRenamed("lcc_fraction", "lcc_before").join(G.largest_component(nodes, edges).withColumnRenamed("lcc_fraction", "lcc_after"), "graph_id")
    n = bridges.groupBy("graph_id").agg(F.count("*").alias("n"))
    m = a.join(b, "graph_id").join(n, "graph_id", "left").agg(*[F.avg(c).alias(c) for c in ("before", "after", "lcc_before", "lcc_after")], F.avg(F.coalesce("n", F.lit(0))).alias("bridges_per_tile"), F.count("*").alias("n_tiles"))
    return m.withColumns({"components_change_pct": (F.col("after") / F.col("before") - 1) * 100, "lcc_change_pct": (F.col("lcc_after") / F.col("lcc_before") - 1) * 100})


def attack_ablation(nodes: DataFrame, edges: DataFrame, k: int = 5) -> DataFrame:
    """Means over graphs of the resilience after static and dynamic attacks, their difference, and how often dynamic is worse."""
    a = G.attacks(nodes, edges, k)
    m = a.agg(F.count("*").alias("n_graphs"), F.avg("ri_static").alias("ri_static"), F.avg("ri_dynamic").alias("ri_dynamic"), F.count_if("dynamic_worse").alias("n_dynamic_worse"))
    return m.withColumn("difference_pp", (F.col("ri_static") - F.col("ri_dynamic")) * 100)


def map_layers(nodes: DataFrame, edges: DataFrame, bc: DataFrame, hit: DataFrame, routes: DataFrame | None = None, center: DataFrame | None = None, radius: float | None = None) -> DataFrame:
    """What a map draws, as rows: edges (healed ones dashed), nodes coloured and sized by betweenness, the hazard's disc
    (center: graph_id, cx, cy), and routes before and after it (of graph.route_places())."""
    from arterial.functions.scalars import heat_colour, marker_radius

    at = lambda e: nodes.select("graph_id", F.col("node_id").alias(e), F.col("x").alias(f"{e}_x"), F.col("y").alias(f"{e}_y"))
    nothing = F.lit(None).cast("double")
    lines = edges.join(at("src"), ["graph_id", "src"]).join(at("dst"), ["graph_id", "dst"])
    out = lines.select("graph_id", F.when(F.col("healed"), "healed").otherwise("road").alias("layer"), F.format_string("LINESTRING(%s %s, %s %s)", "src_x", "src_y", "dst_x", "dst_y").alias("geometry"),
                       F.when(F.col("healed"), "#ff0000").otherwise("#444444").alias("colour"), nothing.alias("radius"), F.format_string("%.3f", "length").alias("tooltip"))
    top = bc.groupBy("graph_id").agg(F.max("bc").alias("top"))
    marked = nodes.join(bc, ["graph_id", "node_id"]).join(top, "graph_id").join(hit.select("graph_id", "node_id", F.lit(True).alias("hit")), ["graph_id", "node_id"], "left")
    share = F.when(F.col("top") > 0, F.col("bc") / F.col("top")).otherwise(0.0)
    out = out.unionByName(marked.select(
        "graph_id", F.when(F.col("hit"), "impacted").otherwise("node").alias("layer"), F.format_string("POINT(%s %s)", "x", "y").alias("geometry"), heat_colour(share).alias("colour"),
        marker_radius(F.col("bc"), F.col("top")).alias("radius"), F.format_string("%.3f", "bc").alias("tooltip")))
    if center is not None:
        out = out.unionByName(center.select("graph_id", F.lit("hazard").alias("layer"), F.format_string("POINT(%s %s)", "cx", "cy").alias("geometry"), F.lit("#3388ff").alias("colour"),
                                            F.lit(radius).cast("double").alias("radius"), F.format_string("%.0f m", F.lit(radius).cast("double")).alias("tooltip")))
    for side, colour in (("before", "#2e8b57"), ("after", "#ff8c00")):
        if routes is not None:
            line = F.concat(F.lit("LINESTRING("), F.array_join(F.transform(f"places_{side}", lambda p: F.format_string("%s %s", p["x"], p["y"])), ", "), F.lit(")"))
            out = out.unionByName(routes.where(F.size(f"places_{side}") > 0).select("graph_id", F.lit(f"route_{side}").alias("layer"), line.alias("geometry"), F.lit(colour).alias("colour"), nothing.alias("radius"),
                                                                                    F.format_string("%.1f", side).alias("tooltip")))
    return out
