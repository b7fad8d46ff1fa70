"""Graph operators on node and edge tables keyed by graph_id. Set-shaped work is relational; traversal goes through kernels."""

from __future__ import annotations

from functools import partial
from itertools import islice

import numpy as np
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from arterial.operators import kernels as K

CHUNK = 64  # sources a slice of a graph has at least, where the graph is cut at all
MOST_NODES = 2_000_000  # nodes and edges of one graph that a worker is given; beyond them kernels refuse it
FEW_CUTS = 100_000  # cut edges of all graphs that are broadcast
LARGE = 200_000  # nodes from which components() goes by relational rounds, where the caller knows of such graphs


def degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges by node; a loop counts twice, a node without edges has 0."""
    ends = edges.select("graph_id", F.explode(F.array("src", "dst")).alias("node_id"))
    counts = ends.groupBy("graph_id", "node_id").agg(F.count("*").alias("degree"))
    return nodes.select("graph_id", "node_id").join(counts, ["graph_id", "node_id"], "left").fillna(0, ["degree"])


def pack(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row per graph: its node ids, and its edges as structs. A graph of more than MOST_NODES nodes or edges is an error,
    not a lost executor."""
    def bounded(column, n, what):
        return F.when(n <= MOST_NODES, column).otherwise(F.raise_error(F.concat(F.lit(f"more than {MOST_NODES} {what} in graph "), F.col("graph_id"))))

    n = nodes.groupBy("graph_id").agg(F.array_sort(F.collect_set("node_id")).alias("nodes"), F.count("*").alias("n"))
    e = edges.groupBy("graph_id").agg(F.array_sort(F.collect_list(F.struct("src", "dst", F.col("length").cast("double").alias("length")))).alias("edges"), F.count("*").alias("m"))
    both = n.join(e, "graph_id", "left")
    return both.select("graph_id", bounded(F.col("nodes"), F.col("n"), "nodes").alias("nodes"), F.when(F.col("m").isNotNull(), bounded(F.col("edges"), F.col("m"), "edges")).alias("edges"))


def _triples(row):
    return [(e["src"], e["dst"], e["length"]) for e in (row.edges if row.edges is not None else [])]


def _labels(batches):
    import pandas as pd

    for pdf in batches:
        out = [(r.graph_id, n, c) for r in pdf.itertuples() for n, c in K.labels(r.nodes, _triples(r)).items()]
        yield pd.DataFrame(out, columns=["graph_id", "node_id", "component"])


SLICES = 8  # parts by node that one graph's edges are thinned in, before a worker is given what is left


class _Forests:
    """One or two disjoint spanning forests of a graph, grown by batches of edges. Labels of its nodes are held as arrays too, anew
    after as many edges in vain as it has nodes: an edge within one tree of each forest can't join any, and goes without a loop.
    With two, an edge of the first is held until the second joins its ends as well, with the least length of its parallels."""

    def __init__(self, forests: int):
        self.sets, self.ids, self.roots, self.vain, self.held = [K.Sets(()) for _ in range(forests)], np.zeros(0, np.int64), [], 0, {}

    def grow(self, src: np.ndarray, dst: np.ndarray, length: np.ndarray) -> list:
        """The (src, dst, length) that are known to stay, of these edges and those held."""
        if len(self.ids):
            i, j = (np.minimum(np.searchsorted(self.ids, end), len(self.ids) - 1) for end in (src, dst))
            within = (self.ids[i] == src) & (self.ids[j] == dst)
            for root in self.roots:
                within &= root[i] == root[j]
            src, dst, length = src[~within], dst[~within], length[~within]
        first, second = self.sets[0], self.sets[-1]
        out = []
        for edge in zip(src.tolist(), dst.tolist(), length.tolist(), strict=True):
            a, b, w = edge
            if first.link(a, b):
                if first is second:
                    out.append(edge)
                else:
                    self.held[min(a, b), max(a, b)] = w
                continue
            if first is not second:
                least = self.held.get((min(a, b), max(a, b)))
                if least is None and second.link(a, b):
                    out.append(edge)
                    continue
                if least is not None and (w < least or least != least):
                    self.held[min(a, b), max(a, b)] = w
            self.vain += 1
        if self.vain > len(first.up):
            self.settle()
            out += [(*e, self.held.pop(e)) for e in [e for e in self.held if e[0] in second.up and e[1] in second.up and second.find(e[0]) == second.find(e[1])]]
        return out

    def settle(self) -> None:
        ids = sorted(self.sets[0].up)
        self.ids, self.roots, self.vain = np.array(ids), [np.array([s.find(n) if n in s.up else n for n in ids]) for s in self.sets], 0


def _thinned(batches, forests: int):
    import pyarrow as pa

    held: dict = {}

    def made(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(schema.types)], schema.names)

    for batch in batches:
        schema = batch.schema
        graphs = batch.column(0).dictionary_encode("encode")
        number = graphs.indices.to_numpy(zero_copy_only=False)
        edge = [batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 2, 3)]
        order, out = np.argsort(number, kind="stable"), []
        for graph, own in zip(graphs.dictionary.to_pylist(), np.split(order, np.cumsum(np.bincount(number))[:-1]), strict=True) if len(order) else ():
            if graph not in held:
                held[graph] = _Forests(forests)
            out += [(graph, *e) for e in held[graph].grow(*(x[own] for x in edge))]
        yield made(out)
    rest = ((graph, *e, w) for graph, f in held.items() for e, w in f.held.items())
    while out := list(islice(rest, 10_000)):
        yield made(out)


def thinned(edges: DataFrame, forests: int = 1) -> DataFrame:
    """Edges that hold the graph together as all do: those of one or two disjoint spanning forests, of what a task has at hand,
    of each of SLICES parts of a graph, and last of the graph. One forest keeps the components; two keep the cut edges too,
    with the least length of their parallels (which count as one edge). At most `forests` edges a node are left; edges stream
    by, a task holds labels of nodes and the edges that may be cut edges."""
    schema = f"graph_id {dict(edges.dtypes)['graph_id']}, src {dict(edges.dtypes)['src']}, dst {dict(edges.dtypes)['dst']}, length double"
    run = partial(_thinned, forests=forests)
    e = edges.select("graph_id", "src", "dst", F.col("length").cast("double").alias("length")).mapInArrow(run, schema)
    parts = e.repartition("graph_id", F.pmod(F.xxhash64("src"), F.lit(SLICES))).mapInArrow(run, schema)
    return parts.repartition("graph_id").mapInArrow(run, schema)


def has_large(nodes: DataFrame, most: int = LARGE) -> bool:
    """Whether any graph has more than `most` nodes: one count per graph, run when called."""
    return (nodes.groupBy("graph_id").count().agg(F.max("count")).first()[0] or 0) > most


def components(nodes: DataFrame, edges: DataFrame, large: bool = False) -> DataFrame:
    """Component of each node: its least node_id. One kernel call per graph, which is given the nodes and the thinned edges;
    large: by relational rounds, for graphs of any size (ask has_large() where sizes aren't known)."""
    kinds = dict(nodes.dtypes)
    if large:
        return components_of_large(nodes, edges)
    return pack(nodes, thinned(edges)).mapInPandas(_labels, f"graph_id {kinds['graph_id']}, node_id long, component long")


def components_of_large(nodes: DataFrame, edges: DataFrame, rounds: int = 50) -> DataFrame:
    """The same by relational rounds: least label of the neighbourhood, then pointer jumping, checkpointed each round."""
    both = edges.select("graph_id", F.col("src").alias("a"), F.col("dst").alias("b"))
    both = both.unionByName(both.select("graph_id", F.col("b").alias("a"), F.col("a").alias("b"))).distinct().checkpoint()
    label = nodes.select("graph_id", "node_id", F.col("node_id").alias("component")).checkpoint()
    for _ in range(rounds):
        near = both.join(label.select("graph_id", F.col("node_id").alias("b"), "component"), ["graph_id", "b"]).groupBy("graph_id", F.col("a").alias("node_id")).agg(F.min("component").alias("near"))
        low = label.join(near, ["graph_id", "node_id"], "left").select("graph_id", "node_id", "component", F.least("component", F.coalesce("near", "component")).alias("low"))
        jump = low.select("graph_id", F.col("node_id").alias("low"), F.col("low").alias("jumped"))
        new = low.join(jump, ["graph_id", "low"], "left").select("graph_id", "node_id", F.coalesce("jumped", "low").alias("component"), F.col("component").alias("old")).checkpoint()
        label = new.drop("old")
        if new.where("component <> old").isEmpty():
            return label
    raise RuntimeError("components did not settle")


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes, edges, components, isolated nodes and total length of each graph."""
    d = degree(nodes, edges).groupBy("graph_id").agg(F.count("*").alias("n_nodes"), F.count_if(F.col("degree") == 0).alias("n_isolated"))
    e = edges.groupBy("graph_id").agg(F.count("*").alias("n_edges"), F.sum("length").alias("total_length"))
    c = components(nodes, edges).groupBy("graph_id").agg(F.countDistinct("component").alias("n_components"))
    return d.join(e, "graph_id", "left").join(c, "graph_id", "left").fillna(0)


def largest_component(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Share of each graph's nodes in its largest component."""
    size = components(nodes, edges).groupBy("graph_id", "component").agg(F.count("*").alias("n"))
    return size.groupBy("graph_id").agg((F.max("n") / F.sum("n")).alias("lcc_fraction"))


def ablate(nodes: DataFrame, edges: DataFrame, hit: DataFrame):
    """Graphs without the (graph_id, node_id) of hit, and without their edges."""
    hit = hit.select("graph_id", "node_id").distinct()
    left = edges
    for end in ("src", "dst"):
        left = left.join(hit.withColumnRenamed("node_id", end), ["graph_id", end], "left_anti")
    return nodes.join(hit, ["graph_id", "node_id"], "left_anti"), left.select(*edges.columns)


# ------------------------------------------------------------------------------------------------------ spatial joins


def _cells(points: DataFrame, size: float, spread: str = ""):
    """points with the cell (cx, cy) they lie in; spread: one row for each cell they look into instead, all nine around
    ("all") or the half ahead with their own ("ahead")."""
    cx, cy = F.floor(F.col("x") / size), F.floor(F.col("y") / size)
    if not spread:
        return points.withColumn("cx", cx).withColumn("cy", cy)
    steps = [(0, 0), (0, 1), (1, -1), (1, 0), (1, 1)] if spread == "ahead" else [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    wide = points.withColumn("o", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in steps])))
    return wide.withColumn("own", (F.col("o.i") == 0) & (F.col("o.j") == 0)).withColumn("cx", cx + F.col("o.i")).withColumn("cy", cy + F.col("o.j")).drop("o")


SALTS = 8  # parts that one side of a dense cell is cut into


def pairs_within(points: DataFrame, radius: float, key: str = "graph_id", salts: int = 1) -> DataFrame:
    """(key, a, b, d2) of points of one key at most radius apart, a < b: an equi-join on grid cells, then the exact test.

    Each pair of cells meets once: a point looks into its own cell and the half of its neighbours ahead. salts: parts that
    a cell's points are cut into on one side (and repeated on the other), for tables with very dense cells (SALTS)."""
    part = F.pmod(F.xxhash64("node_id"), F.lit(salts)).cast("int")
    a = _cells(points.select(key, "node_id", "x", "y", part.alias("s")), radius, "ahead").select(key, "cx", "cy", "s", "own", F.col("node_id").alias("u"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    b = _cells(points.select(key, "node_id", "x", "y"), radius).select(key, "cx", "cy", F.col("node_id").alias("v"), F.col("x").alias("bx"), F.col("y").alias("by"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("s"))
    d2 = (F.col("ax") - F.col("bx")) ** 2 + (F.col("ay") - F.col("by")) ** 2
    near = a.join(b, [key, "cx", "cy", "s"]).where(~F.col("own") | (F.col("u") < F.col("v"))).withColumn("d2", d2).where(F.col("d2") <= radius * radius)
    return near.where("u <> v").select(key, F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"), "d2")


def nearest(left: DataFrame, right: DataFrame, reach: float, key: str = "graph_id") -> DataFrame:
    """(key, a, b, d2): each left point's nearest right point within reach, ties to the smaller id; b is null if none."""
    a = _cells(left.select(key, F.col("node_id").alias("a"), "x", "y"), reach, "all").withColumnsRenamed({"x": "ax", "y": "ay"})
    b = _cells(right.select(key, F.col("node_id").alias("b"), "x", "y"), reach).withColumnsRenamed({"x": "bx", "y": "by"})
    d2 = (F.col("ax") - F.col("bx")) ** 2 + (F.col("ay") - F.col("by")) ** 2
    near = a.join(b, [key, "cx", "cy"]).withColumn("d2", d2).where(F.col("d2") <= reach * reach)
    best = near.groupBy(key, "a").agg(F.min(F.struct("d2", "b")).alias("m")).select(key, "a", F.col("m.b").alias("b"), F.col("m.d2").alias("d2"))
    return left.select(key, F.col("node_id").alias("a")).join(best, [key, "a"], "left")


def nearest_to(nodes: DataFrame, x: float, y: float) -> DataFrame:
    """The node of each graph nearest to a place, ties to the smaller id."""
    d2 = (F.col("x") - x) ** 2 + (F.col("y") - y) ** 2
    return nodes.groupBy("graph_id").agg(F.min(F.struct(d2.alias("d2"), "node_id")).alias("m")).select("graph_id", F.col("m.node_id").alias("node_id"), F.col("m.d2").alias("d2"))


def heal_candidates(nodes: DataFrame, edges: DataFrame, gap: float, endpoints_only: bool = True) -> DataFrame:
    """(graph_id, a, b, d2, ca, cb): pairs across components within gap, with a dead end on at least one side."""
    about = nodes.join(degree(nodes, edges), ["graph_id", "node_id"]).join(components(nodes, edges), ["graph_id", "node_id"])
    # what a pair must fulfil is known of its points, so only those ends look around that may have one
    begins = about.where("degree = 1") if endpoints_only else about
    at = lambda df, size, name, spread="": _cells(df.select("graph_id", F.col("node_id").alias(name), F.col("degree").alias(f"d_{name}"), F.col("component").alias(f"c{name}"), "x", "y"), size, spread).withColumnsRenamed({"x": f"x{name}", "y": f"y{name}"})
    u, v = at(begins, gap, "u", "all").drop("own"), at(about, gap, "v")
    d2 = (F.col("xu") - F.col("xv")) ** 2 + (F.col("yu") - F.col("yv")) ** 2
    # a pair of two such ends is found from both
    once = (F.col("u") < F.col("v")) | (F.col("d_v") != 1) if endpoints_only else F.col("u") < F.col("v")
    found = u.join(v, ["graph_id", "cx", "cy"]).where((F.col("cu") != F.col("cv")) & once).withColumn("d2", d2).where(F.col("d2") <= gap * gap)
    first = F.col("u") < F.col("v")
    side = lambda a, b, name: F.when(first, F.col(a)).otherwise(F.col(b)).alias(name)
    return found.select("graph_id", side("u", "v", "a"), side("v", "u", "b"), "d2", side("cu", "cv", "ca"), side("cv", "cu", "cb"))


def _forest(pdf):
    import pandas as pd

    rows = list(pdf.itertuples())
    comp = {r.a: r.ca for r in rows} | {r.b: r.cb for r in rows}
    kept = K.spanning([(r.d2, r.a, r.b) for r in rows], comp)
    graph = rows[0].graph_id
    return pd.DataFrame([(graph, a, b, float(d) ** 0.5) for d, a, b in kept], columns=["graph_id", "src", "dst", "length"])


def heal(nodes: DataFrame, edges: DataFrame, gap: float = 40.0, endpoints_only: bool = True) -> DataFrame:
    """The bridges (graph_id, src, dst, length) of a minimum spanning forest between components, ties by (length, a, b)."""
    # of the pairs between two components only the least can be in the forest: one row per pair of components remains
    c = heal_candidates(nodes, edges, gap, endpoints_only)
    lo, hi = F.least("ca", "cb"), F.greatest("ca", "cb")
    least = c.groupBy("graph_id", lo.alias("lo"), hi.alias("hi")).agg(F.min(F.struct("d2", "a", "b", "ca", "cb")).alias("m")).select("graph_id", "m.*")
    return least.groupBy("graph_id").applyInPandas(_forest, f"graph_id {dict(nodes.dtypes)['graph_id']}, src long, dst long, length double")


def heal_summary(nodes: DataFrame, edges: DataFrame, bridges: DataFrame) -> DataFrame:
    """Components before and after, bridges and their length, by graph."""
    before = components(nodes, edges).groupBy("graph_id").agg(F.countDistinct("component").alias("components_before"))
    b = bridges.groupBy("graph_id").agg(F.count("*").alias("n_bridges"), F.sum("length").alias("bridge_length"))
    out = before.join(b, "graph_id", "left").fillna(0)
    return out.withColumn("components_after", F.col("components_before") - F.col("n_bridges"))


# --------------------------------------------------------------------------------------------------------- traversal


def _sources(nodes: DataFrame, edges: DataFrame, sources: DataFrame | None) -> DataFrame:
    """Packed graphs with the sources that a kernel call takes. A graph of many sources is cut into slices of them, never
    more than there are shuffle partitions: so often, not once for each CHUNK sources, its packed form is sent."""
    packed = pack(nodes, edges)
    if sources is None:
        packed = packed.withColumn("all", F.col("nodes"))
    else:
        packed = packed.join(sources.groupBy("graph_id").agg(F.array_sort(F.collect_set("node_id")).alias("all")), "graph_id")
    most = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = F.least(F.ceil(F.size("all") / CHUNK), F.lit(most)).cast("int")
    cut = packed.withColumn("n", n).withColumn("k", F.explode(F.sequence(F.lit(0), F.greatest(F.col("n") - 1, F.lit(0)))))
    own = F.filter("all", lambda x, i: F.pmod(i, F.greatest(F.col("n"), F.lit(1))) == F.col("k"))
    return cut.repartition("graph_id", "k").select("graph_id", "nodes", "edges", own.alias("sources"))


def _distances(batches):
    import pandas as pd

    for pdf in batches:
        out = []
        for r in pdf.itertuples():
            adj = K.adjacency(_triples(r), r.nodes)
            out += [(r.graph_id, s, t, d) for s in r.sources for t, d in K.distances(adj, s).items()]
        yield pd.DataFrame(out, columns=["graph_id", "source", "target", "distance"])


def shortest_distances(nodes: DataFrame, edges: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """(graph_id, source, target, distance) of all reachable pairs."""
    return _sources(nodes, edges, sources).mapInPandas(_distances, f"graph_id {dict(nodes.dtypes)['graph_id']}, source long, target long, distance double")


def _inverse(batches):
    import pandas as pd

    for pdf in batches:
        out = []
        for r in pdf.itertuples():
            adj = K.adjacency(_triples(r), r.nodes)
            out.append((r.graph_id, sum(1 / d for s in r.sources for d in K.distances(adj, s).values() if d > 0), len(r.sources)))
        yield pd.DataFrame(out, columns=["graph_id", "total", "n_sources"])


def efficiency(nodes: DataFrame, edges: DataFrame, universe: DataFrame | None = None, sources: DataFrame | None = None) -> DataFrame:
    """Global efficiency by graph; universe: (graph_id, n) in place of the node count in the denominator."""
    part = _sources(nodes, edges, sources).mapInPandas(_inverse, f"graph_id {dict(nodes.dtypes)['graph_id']}, total double, n_sources long")
    total = part.groupBy("graph_id").agg(F.sum("total").alias("total"), F.sum("n_sources").alias("k"))
    m = nodes.groupBy("graph_id").agg(F.count("*").alias("m"))
    out = (m.select("graph_id", "m", F.col("m").alias("n")) if universe is None else universe.select("graph_id", "n").join(m, "graph_id", "left").fillna(0, ["m"]))
    value = F.when((F.col("n") < 2) | F.col("total").isNull(), F.lit(0.0)).otherwise(F.col("total") * F.col("m") / F.col("k") / (F.col("n") * (F.col("n") - 1)))
    return out.join(total, "graph_id", "left").select("graph_id", value.alias("efficiency"))


def _dependencies(batches, edge: bool):
    import pandas as pd

    for pdf in batches:
        out = []
        for r in pdf.itertuples():
            adj = K.adjacency(_triples(r), r.nodes)
            total: dict = {}
            for s in r.sources:  # sums of a chunk are combined here, before the shuffle
                for key, v in K.dependencies(adj, s)[edge].items():
                    total[key] = total.get(key, 0.0) + v
            out += [(r.graph_id, *(key if edge else (key, key)), v) for key, v in total.items()]
        yield pd.DataFrame(out, columns=["graph_id", "a", "b", "v"])


def _between(nodes, edges, sources, edge):
    part = _sources(nodes, edges, sources).mapInPandas(partial(_dependencies, edge=edge), f"graph_id {dict(nodes.dtypes)['graph_id']}, a long, b long, v double")
    n = nodes.groupBy("graph_id").agg(F.count("*").alias("n"))
    if sources is not None:
        n = n.join(sources.groupBy("graph_id").agg(F.count("*").alias("k")), "graph_id")
    else:
        n = n.withColumn("k", F.col("n"))
    return part.groupBy("graph_id", "a", "b").agg(F.sum("v").alias("v")), n


def betweenness(nodes: DataFrame, edges: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """Normalised node betweenness; with sources, scaled up by their share."""
    v, n = _between(nodes, edges, sources, False)
    scale = F.when(F.col("n") > 2, F.col("n") / F.col("k") / ((F.col("n") - 1) * (F.col("n") - 2))).otherwise(0.0)
    all_nodes = nodes.select("graph_id", "node_id").join(n, "graph_id").join(v.select("graph_id", F.col("a").alias("node_id"), "v"), ["graph_id", "node_id"], "left")
    return all_nodes.select("graph_id", "node_id", (F.coalesce("v", F.lit(0.0)) * scale).alias("bc"))


def edge_betweenness(nodes: DataFrame, edges: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    v, n = _between(nodes, edges, sources, True)
    scale = F.col("n") / F.col("k") / (F.col("n") * (F.col("n") - 1))
    e = edges.select("graph_id", F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).where("src <> dst").distinct()
    v = v.withColumnsRenamed({"a": "src", "b": "dst"})
    return e.join(n, "graph_id").join(v, ["graph_id", "src", "dst"], "left").select("graph_id", "src", "dst", (F.coalesce("v", F.lit(0.0)) * scale).alias("bc"))


def critical(bc: DataFrame, top: int = 10) -> DataFrame:
    """Each graph's top nodes by betweenness, ties to the smaller id."""
    w = Window.partitionBy("graph_id").orderBy(F.desc("bc"), "node_id")
    return bc.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def sample_sources(nodes: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """k nodes of each graph by seeded hash."""
    w = Window.partitionBy("graph_id").orderBy(F.md5(F.concat_ws("|", F.lit(seed), "node_id")), "node_id")
    return nodes.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).drop("r")


def spaced_sources(nodes: DataFrame, k: int) -> DataFrame:
    """Up to k evenly spaced nodes of each graph, in id order: places floor(i (n - 1) / (k - 1))."""
    w = Window.partitionBy("graph_id")
    ranked = nodes.withColumn("r", F.row_number().over(w.orderBy("node_id")) - 1).withColumn("n", F.count("*").over(w))
    places = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.floor(i * (F.col("n") - 1) / F.lit(max(k - 1, 1))))
    return ranked.where((F.col("n") <= k) | F.array_contains(places, F.col("r").cast("long"))).drop("r", "n")


def _routes(batches):
    import pandas as pd

    for pdf in batches:
        out = []
        for r in pdf.itertuples():
            adj = K.adjacency(_triples(r), r.nodes)
            left = K.without(adj, r.gone if r.gone is not None else [])
            for t in r.trips:
                b, p = K.path(adj, t["source"], t["target"])
                a, q = K.path(left, t["source"], t["target"])
                out.append((r.graph_id, t["source"], t["target"], b, a, None if b in (0.0, K.INF) else (K.INF if a == K.INF else a / b), p, q))
        yield pd.DataFrame(out, columns=["graph_id", "source", "target", "before", "after", "ratio", "path_before", "path_after"])


def reroute(nodes: DataFrame, edges: DataFrame, trips: DataFrame, hit: DataFrame) -> DataFrame:
    """Shortest path of each (graph_id, source, target) before and after the loss of hit nodes; inf and null if cut off.

    A graph is sent once for each slice of its trips, and its adjacency is built once there."""
    gone = hit.groupBy("graph_id").agg(F.array_sort(F.collect_set("node_id")).alias("gone"))
    kind = dict(nodes.dtypes)["graph_id"]
    most = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slices = trips.groupBy("graph_id", F.pmod(F.xxhash64("source", "target"), F.lit(most)).alias("k")).agg(F.collect_list(F.struct("source", "target")).alias("trips"))
    rows = slices.join(pack(nodes, edges), "graph_id").join(gone, "graph_id", "left").repartition("graph_id", "k")
    return rows.mapInPandas(_routes, f"graph_id {kind}, source long, target long, before double, after double, ratio double, path_before array<long>, path_after array<long>")


def route_places(routes: DataFrame, nodes: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """routes with paths as arrays of places (x, y), in order; columns of nodes such as lon, lat serve as well."""
    at = nodes.select("graph_id", "node_id", F.struct(F.col(x).alias("x"), F.col(y).alias("y")).alias("place"))
    out = routes
    for side in ("before", "after"):
        steps = out.select("graph_id", "source", "target", F.posexplode(f"path_{side}").alias("i", "node_id")).join(at, ["graph_id", "node_id"])
        lines = steps.groupBy("graph_id", "source", "target").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "place"))), lambda s: s["place"]).alias(f"places_{side}"))
        out = out.join(lines, ["graph_id", "source", "target"], "left")
    return out


def _attacks(batches, k: int):
    import pandas as pd

    for pdf in batches:
        out = []
        for r in pdf.itertuples():
            adj = K.adjacency(_triples(r), r.nodes)
            e0 = K.efficiency(adj) if len(adj) >= k + 3 else 0.0
            if e0 <= 0:
                continue
            ri = [K.efficiency(K.without(adj, K.attack(adj, k, d)), len(adj)) / e0 for d in (False, True)]
            out.append((r.graph_id, len(adj), ri[0], ri[1], ri[1] < ri[0]))
        yield pd.DataFrame(out, columns=["graph_id", "n_nodes", "ri_static", "ri_dynamic", "dynamic_worse"])


def attacks(nodes: DataFrame, edges: DataFrame, k: int = 5) -> DataFrame:
    """Resilience after the k worst nodes go, ranked once or anew each time; graphs under k + 3 nodes or without paths are skipped."""
    return pack(nodes, edges).mapInPandas(partial(_attacks, k=k), f"graph_id {dict(nodes.dtypes)['graph_id']}, n_nodes long, ri_static double, ri_dynamic double, dynamic_worse boolean")


def _cuts(batches, gap: float, k: int, seed: int):
    import hashlib

    import pandas as pd

    for pdf in batches:
        out = []
        for r in pdf.itertuples():
            adj = K.adjacency(_triples(r), r.nodes)
            short = [e for e in K.bridges(adj) if adj[e[0]][e[1]] <= gap]
            short.sort(key=lambda e: (hashlib.md5(f"{seed}|{e[0]}|{e[1]}".encode()).hexdigest(), e))
            out += [(r.graph_id, a, b) for a, b in short[:k]]
        yield pd.DataFrame(out, columns=["graph_id", "src", "dst"])


def damage(nodes: DataFrame, edges: DataFrame, gap: float, k: int, seed: int = 42):
    """(nodes, edges) without up to k cut edges no longer than gap, and without nodes left bare. The cut edges are looked for
    when called, once for all uses of the graph that is left."""
    cut = pack(nodes, thinned(edges, 2)).mapInPandas(partial(_cuts, gap=gap, k=k, seed=seed), f"graph_id {dict(nodes.dtypes)['graph_id']}, src long, dst long").checkpoint()
    if cut.count() <= FEW_CUTS:  # so the edges needn't be shuffled to find them
        cut = F.broadcast(cut)
    lo_hi = edges.withColumn("lo", F.least("src", "dst")).withColumn("hi", F.greatest("src", "dst"))
    left = lo_hi.join(cut.withColumnsRenamed({"src": "lo", "dst": "hi"}), ["graph_id", "lo", "hi"], "left_anti").select(*edges.columns)
    used = left.select("graph_id", F.explode(F.array("src", "dst")).alias("node_id")).distinct()
    return nodes.join(used, ["graph_id", "node_id"], "left_semi"), left


def half_apls(a, b, snap: float, most: int) -> DataFrame:
    """(graph_id, total, n): agreement of path lengths from up to `most` evenly spaced nodes of each graph of a with those
    between their nearest nodes of b; a pair that b lacks counts 0."""
    match = nearest(a[0], b[0], snap)
    start = spaced_sources(a[0].select("graph_id", "node_id"), most)
    paths = shortest_distances(*a, start).where("distance > 0").select("graph_id", F.col("source").alias("s"), F.col("target").alias("t"), F.col("distance").alias("d"))
    at = lambda end, name: match.select("graph_id", F.col("a").alias(end), F.col("b").alias(name))
    asked = paths.join(at("s", "source"), ["graph_id", "s"]).join(at("t", "target"), ["graph_id", "t"])
    begins = match.join(start.select("graph_id", F.col("node_id").alias("a")), ["graph_id", "a"], "left_semi").where("b is not null").select("graph_id", F.col("b").alias("node_id")).distinct()
    other = shortest_distances(*b, begins).withColumnRenamed("distance", "e")
    score = F.when(F.col("e").isNull(), 0.0).otherwise(1 - F.least(F.lit(1.0), F.abs(F.col("d") - F.col("e")) / F.col("d")))
    return asked.join(other, ["graph_id", "source", "target"], "left").groupBy("graph_id").agg(F.sum(score).alias("total"), F.count("*").alias("n"))


def apls(a, b, snap: float | None = None, resolution: float = 0.5, most: int = 50) -> DataFrame:
    """Average path length similarity of graphs a = (nodes, edges) and b with equal graph_id: 0 where one has no nodes."""
    snap = max(4.0, 8 * resolution) if snap is None else snap
    ids = a[0].select("graph_id").unionByName(b[0].select("graph_id")).distinct()
    out = ids
    for name, one, two in (("ab", a, b), ("ba", b, a)):
        half = half_apls(one, two, snap, most).select("graph_id", (F.col("total") / F.col("n")).alias(name))
        out = out.join(half, "graph_id", "left")
    return out.select("graph_id", ((F.coalesce("ab", F.lit(0.0)) + F.coalesce("ba", F.lit(0.0))) / 2).alias("apls"))
