"""What a hazard does to graphs: efficiency before and after on one universe, components, largest component."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from arterial.operators import graph as G
from arterial.operators.hazard import Hazard, RadiusHazard


_REPORT = "n_nodes long, n_impacted long, efficiency_before double, efficiency_after double, components_after long, lcc_after double, resilience_index double, efficiency_drop double"


def _reports(batches):
    import pandas as pd

    from arterial.operators import kernels as K

    names = [c.split()[0] for c in _REPORT.split(", ")]
    for pdf in batches:
        out = []
        for r in pdf.itertuples():
            adj = K.adjacency([(e["src"], e["dst"], e["length"]) for e in (r.edges if r.edges is not None else [])], r.nodes)
            some = lambda x: None if x is None else sorted(x)
            got = K.report(adj, r.hit if r.hit is not None else [], some(r.before), some(r.after))
            out.append((r.graph_id, *(got[n] for n in names)))
        yield pd.DataFrame(out, columns=["graph_id", *names])


def report(nodes: DataFrame, edges: DataFrame, hazard: Hazard | DataFrame, sample_k: int | None = None) -> DataFrame:
    """One row per graph. The resilience index is 0 where the efficiency before is 0. One kernel call per packed graph
    makes all figures; sample_k: sources of the efficiencies, picked by a seeded hash from all and from the nodes left."""
    hit = (hazard.impacted(nodes) if isinstance(hazard, Hazard) else hazard).select("graph_id", "node_id").distinct()
    gather = lambda df, name: df.groupBy("graph_id").agg(F.collect_set("node_id").alias(name))
    rows = G.pack(nodes, edges).join(gather(hit, "hit"), "graph_id", "left")
    for name, of in (("before", nodes), ("after", nodes.join(hit, ["graph_id", "node_id"], "left_anti"))):
        rows = rows.join(gather(G.sample_sources(of, sample_k), name), "graph_id", "left") if sample_k else rows.withColumn(name, F.lit(None).cast("array<long>"))
    return rows.mapInPandas(_reports, f"graph_id {dict(nodes.dtypes)['graph_id']}, {_REPORT}")


def flood(nodes: DataFrame, edges: DataFrame, centers: DataFrame, radius: float):
    """(report, hit, betweenness of what is left) of discs around nodes; centers: (graph_id, node_id)."""
    at = nodes.join(centers.select("graph_id", "node_id"), ["graph_id", "node_id"], "left_semi").select("graph_id", F.col("x").alias("cx"), F.col("y").alias("cy"))
    hit = RadiusHazard(at, radius).impacted(nodes)
    left = G.ablate(nodes, edges, hit)
    return report(nodes, edges, hit), hit, G.betweenness(*left)
