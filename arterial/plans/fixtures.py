"""Road-like inputs derived from the driver's tables, with the same derivations as SQL text for comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

TILE = 32


def table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _cells(spark, sf_dir, shift):
    e = table(spark, sf_dir, "events")
    minute = F.hour("ts") * 60 + F.minute("ts")
    row = F.pmod(F.col("user_id") + (F.pmod(F.col("event_id"), F.lit(2)) if shift else F.lit(0)), F.lit(TILE)).cast("int")
    n = e.groupBy(F.col("event_type").alias("tile_id"), row.alias("row"), F.floor(minute / 45).cast("int").alias("col")).agg(F.count("*").alias("n"))
    total = n.groupBy("tile_id").agg(F.sum("n").alias("total"))
    return n.join(total, "tile_id").where(F.col("n") * TILE * TILE * 4 > 5 * F.col("total")).select("tile_id", "row", "col")


def mask(spark, sf_dir):
    return _cells(spark, sf_dir, False)


def prediction(spark, sf_dir):
    return _cells(spark, sf_dir, True)


def occlusion(spark, sf_dir):
    tiles = mask(spark, sf_dir).select("tile_id").distinct()
    return tiles.withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(TILE - 1)))).withColumn("col", F.explode(F.sequence(F.lit(8), F.lit(15))))


def trade_graph(spark, sf_dir):
    """(nodes, edges) of nations that trade."""
    li, o, c, s = (table(spark, sf_dir, n) for n in ("lineitem", "orders", "customer", "supplier"))
    j = li.join(o, li.l_orderkey == o.o_orderkey).join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    a, b = F.col("c_nationkey").cast("long"), F.col("s_nationkey").cast("long")
    e = j.where(a != b).groupBy(F.least(a, b).alias("src"), F.greatest(a, b).alias("dst")).agg(F.count("*").alias("length"))
    e = e.select(F.lit("trade").alias("graph_id"), "src", "dst", F.col("length").cast("double").alias("length"))
    ids = e.select("graph_id", F.explode(F.array("src", "dst")).alias("node_id")).distinct()
    return ids.select("graph_id", "node_id", (F.col("node_id") % 5 * 10).cast("double").alias("x"), (F.floor(F.col("node_id") / 5) * 10).cast("double").alias("y")), e


def vector_graph(spark, sf_dir):
    """(nodes, edges): embeddings as places in the plane; near ones of one label are joined."""
    from arterial.operators.graph import pairs_within

    v = table(spark, sf_dir, "embeddings")
    at = lambda i: (F.col("embedding")[i].cast("double") * 1000).cast("long").cast("double")
    nodes = v.select(F.col("label").cast("string").alias("graph_id"), F.col("vec_id").cast("long").alias("node_id"), at(0).alias("x"), at(1).alias("y"))
    edges = pairs_within(nodes, 40.0).select("graph_id", F.col("a").alias("src"), F.col("b").alias("dst"), F.floor(F.sqrt("d2")).cast("double").alias("length"))
    return nodes, edges


def manifest(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").cast("string").alias("tile_id"), F.col("source").alias("place"), F.col("lang").alias("terrain"), (F.col("n_chars") / 40000.0).alias("road_frac"), F.lit("img").alias("image_path"))


def raster(spark, sf_dir):
    """Value raster over the vector graph: cells of 25 units, v = nodes in the cell."""
    nodes, _ = vector_graph(spark, sf_dir)
    return nodes.groupBy(F.floor((F.col("y") + 1000) / 25).cast("int").alias("row"), F.floor((F.col("x") + 1000) / 25).cast("int").alias("col")).agg(F.count("*").cast("double").alias("v"))


def _sql_cells(shift: str) -> str:
    return f"""SELECT tile_id, "row", col FROM (SELECT *, sum(n) OVER (PARTITION BY tile_id) AS total FROM (
SELECT event_type AS tile_id, CAST((user_id{shift}) % {TILE} AS INTEGER) AS "row", CAST((hour(ts) * 60 + minute(ts)) // 45 AS INTEGER) AS col, count(*) AS n FROM events GROUP BY 1, 2, 3))
WHERE n * {TILE * TILE * 4} > 5 * total"""


SQL = {
    "m": _sql_cells(""),
    "p": _sql_cells(" + event_id % 2"),
    "o": f"""SELECT tile_id, CAST(r AS INTEGER) AS "row", CAST(c AS INTEGER) AS col FROM (SELECT DISTINCT tile_id FROM m), range({TILE}) a(r), range(8, 16) b(c)""",
    "e": """SELECT least(c_nationkey, s_nationkey)::BIGINT AS src, greatest(c_nationkey, s_nationkey)::BIGINT AS dst, count(*)::DOUBLE AS length FROM lineitem JOIN orders ON l_orderkey = o_orderkey
JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey GROUP BY 1, 2""",
    "n": "SELECT DISTINCT u AS node_id FROM (SELECT src AS u FROM e UNION ALL SELECT dst FROM e)",
    "vn": "SELECT label::VARCHAR AS graph_id, vec_id::BIGINT AS node_id, trunc(embedding[1]::DOUBLE * 1000) AS x, trunc(embedding[2]::DOUBLE * 1000) AS y FROM embeddings",
    "ve": """SELECT a.graph_id, a.node_id AS src, b.node_id AS dst, floor(sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y))) AS length, (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y) AS d2 FROM vn a JOIN vn b ON a.graph_id = b.graph_id
AND a.node_id < b.node_id WHERE (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y) <= 1600""",
    "f": "SELECT doc_id::VARCHAR AS tile_id, source AS place, lang AS terrain, n_chars / 40000.0::DOUBLE AS road_frac FROM documents",
}


def with_ctes(names: str, body: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(f"{k} AS MATERIALIZED ({SQL[k]})" for k in names.split()) + "\n" + body
