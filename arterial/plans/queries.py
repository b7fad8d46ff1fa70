"""The engine's registered queries, and the same results as DuckDB SQL wherever SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from arterial.functions import scalars as S
from arterial.operators import graph as G, hazard as H, raster as R, resilience, tiles as T
from arterial.plans import fixtures as X
from arterial.plans.fixtures import TILE, with_ctes

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def big(c, name=None):
    return F.col(c).cast("long").alias(name or c)


def r6(c, name=None):
    return F.round(F.col(c), 6).alias(name or c)


# ------------------------------------------------------------------------------------------------- manifest and tiles


@query(with_ctes("f", "SELECT tile_id, place, terrain, round(road_frac, 6) AS road_frac FROM f WHERE road_frac >= 0.004"))
def manifest_density_filter(spark, d):
    return T.dense_enough(X.manifest(spark, d)).select("tile_id", "place", "terrain", r6("road_frac"))


_SPLIT = """s AS (SELECT *, row_number() OVER (PARTITION BY terrain ORDER BY md5(concat_ws('|', '42', tile_id)), tile_id) AS k, count(*) OVER (PARTITION BY terrain) AS n FROM f),
t AS (SELECT *, CASE WHEN k <= round_even(n * 0.7::DOUBLE, 0) THEN 'train' WHEN k <= round_even(n * 0.7::DOUBLE, 0) + round_even(n * 0.15::DOUBLE, 0) THEN 'val' ELSE 'test' END AS split FROM s)"""


@query(with_ctes("f", f", {_SPLIT} SELECT tile_id, terrain, split FROM t"))
def split_stratified(spark, d):
    return T.split(X.manifest(spark, d)).select("tile_id", "terrain", "split")


@query(with_ctes("f", f""", {_SPLIT} SELECT coalesce(terrain, 'All') AS terrain, count(*) FILTER (split = 'train')::BIGINT AS train, count(*) FILTER (split = 'val')::BIGINT AS val,
count(*) FILTER (split = 'test')::BIGINT AS test, count(*)::BIGINT AS "All" FROM t GROUP BY GROUPING SETS ((terrain), ())"""))
def split_crosstab(spark, d):
    return T.split_summary(T.split(X.manifest(spark, d))).select("terrain", big("train"), big("val"), big("test"), big("All"))


@query(with_ctes("f", """, u AS (SELECT *, 1 AS s FROM f UNION ALL SELECT tile_id, place, 'new', road_frac * 2, 2 FROM f WHERE tile_id::BIGINT % 3 = 0)
SELECT tile_id, terrain, round(road_frac, 6) AS road_frac FROM u QUALIFY row_number() OVER (PARTITION BY tile_id ORDER BY s DESC) = 1"""))
def manifest_keep_last(spark, d):
    m = X.manifest(spark, d).withColumn("ingest_seq", F.lit(1))
    new = m.where(F.col("tile_id").cast("long") % 3 == 0).withColumns({"terrain": F.lit("new"), "road_frac": F.col("road_frac") * 2, "ingest_seq": F.lit(2)})
    return T.keep_last(m.unionByName(new)).select("tile_id", "terrain", r6("road_frac"))


@query(with_ctes("f", "SELECT tile_id, round(road_frac, 6) AS road_frac FROM f ORDER BY f.road_frac DESC, tile_id LIMIT 25"))
def tiles_densest(spark, d):
    return T.densest(X.manifest(spark, d), 25).select("tile_id", r6("road_frac"))


@query(with_ctes("f", """, g AS (SELECT *, row_number() OVER (PARTITION BY place ORDER BY tile_id::BIGINT) AS k FROM f WHERE road_frac >= 0.02) SELECT place, tile_id FROM g WHERE k <= 5"""))
def first_tiles_per_place(spark, d):
    m = T.dense_enough(X.manifest(spark, d), 0.02).withColumns({"r": F.col("tile_id").cast("long"), "c": F.lit(0)})
    return T.first_per_place(m, 5).select("place", "tile_id")


@query(with_ctes("f", f""", {_SPLIT} SELECT terrain, true AS has_images, count(DISTINCT split) >= 3 AS all_splits, count(*)::BIGINT AS n_tiles FROM t GROUP BY terrain"""))
def manifest_gate(spark, d):
    m = T.split(X.manifest(spark, d)).withColumn("resolution_m", F.lit(0.5))
    return T.gate(m).select("terrain", "has_images", "all_splits", big("n_tiles"))


@query("""WITH p AS (SELECT p_partkey AS k, (p_size * 37 % 500 + 64)::INTEGER AS bands_h, (p_size * 53 % 700 + 64)::INTEGER AS w FROM part)
SELECT k, count(*)::BIGINT AS n_windows, max(y0)::BIGINT AS last_y, max(x0)::BIGINT AS last_x FROM (
SELECT k, y0, x0 FROM (SELECT k, bands_h, w, unnest(list_distinct(CASE WHEN bands_h <= 128 THEN [0] ELSE list_append(range(0, bands_h - 127, 96), bands_h - 128) END)) AS y0 FROM p),
LATERAL (SELECT unnest(list_distinct(CASE WHEN w <= 128 THEN [0] ELSE list_append(range(0, w - 127, 96), w - 128) END)) AS x0)) GROUP BY k""")
def window_origins(spark, d):
    p = X.table(spark, d, "part").select(F.col("p_partkey").alias("k"), (F.col("p_size") * 37 % 500 + 64).cast("int").alias("height"), (F.col("p_size") * 53 % 700 + 64).cast("int").alias("width"))
    w = T.windows(p, 128, T.tile_step(128, 0.25))
    return w.groupBy("k").agg(F.count("*").alias("n_windows"), F.max("y0").cast("long").alias("last_y"), F.max("x0").cast("long").alias("last_x"))


@query("""WITH p AS (SELECT n_name AS place, n_nationkey * 1000.0::DOUBLE AS west, 0.0::DOUBLE AS south, n_nationkey * 1000.0 + 400 + n_nationkey * 10 AS east, 300.0 + n_nationkey * 7 AS north FROM nation),
g AS (SELECT *, unnest(range(0, ceil((north - south) / 75.0)::BIGINT)) AS r FROM p), h AS (SELECT *, unnest(range(0, ceil((east - west) / 75.0)::BIGINT)) AS c FROM g)
SELECT place, format('{}_r{:03d}_c{:03d}', place, r, c) AS tile_id, round(west + c * 75.0, 6) AS west, round(north - r * 75.0, 6) AS north FROM h""")
def tile_grid(spark, d):
    k = F.col("n_nationkey")
    p = X.table(spark, d, "nation").select(F.col("n_name").alias("place"), (k * 1000.0).alias("west"), F.lit(0.0).alias("south"), (k * 1000.0 + 400 + k * 10).alias("east"), (300.0 + k * 7).alias("north"))
    return T.tile_grid(p, 100, 1.0, 0.25).select("place", "tile_id", r6("west"), r6("north"))


@query("""SELECT url, coalesce(list_filter(list_reverse(string_split(replace(regexp_replace(list_extract(string_split(url, '/'), -1), '\\.[^.]*$', ''), '-', '_'), '_')), lambda t: regexp_matches(lower(t), '^([0-9]|chip|img)'))[1],
regexp_replace(list_extract(string_split(url, '/'), -1), '\\.[^.]*$', '')) AS chip FROM pages""".replace("\\\\", "\\"))
def chip_ids(spark, d):
    return X.table(spark, d, "pages").select("url", S.chip_id(F.col("url")).alias("chip"))


@query("SELECT n_name, lower(replace(trim(string_split(' ' || n_name || ' road , x', ',')[1]), ' ', '_')) AS slug FROM nation")
def place_slugs(spark, d):
    return X.table(spark, d, "nation").select("n_name", S.slug(F.concat(F.lit(" "), "n_name", F.lit(" road , x"))).alias("slug"))


@query("""SELECT event_id, format('#{:02x}{:02x}{:02x}', greatest(trunc(60 + 175 * v), 0)::INTEGER, greatest(trunc(90 - 50 * v), 0)::INTEGER, greatest(trunc(210 - 170 * v), 0)::INTEGER) AS colour
FROM (SELECT event_id, value / 500.0 AS v FROM events)""")
def heat_colours(spark, d):
    return X.table(spark, d, "events").select("event_id", S.heat_colour(F.col("value") / 500.0).alias("colour"))


# ------------------------------------------------------------------------------------------------------------- rasters


@query(with_ctes("m", f"SELECT tile_id, round(count(*) / {TILE * TILE}.0::DOUBLE, 6) AS road_frac FROM m GROUP BY 1"))
def mask_density(spark, d):
    return R.density(X.mask(spark, d), TILE, TILE).select("tile_id", r6("road_frac"))


_ALIGNED = """a AS (SELECT tile_id, "row", col, max(t) AS t, max(p) AS p, max(o) AS o FROM (SELECT *, 1 AS t, 0 AS p, 0 AS o FROM m UNION ALL SELECT *, 0, 1, 0 FROM p UNION ALL SELECT *, 0, 0, 1 FROM o) GROUP BY ALL)"""
_RATIOS = """round(tp / (tp + fp + fn + 1e-7), 6) AS iou, round(2 * tp / (2 * tp + fp + fn + 1e-7), 6) AS dice, round(tp / (tp + fp + 1e-7), 6) AS "precision", round(tp / (tp + fn + 1e-7), 6) AS recall"""
_COUNTS = "sum(t * p)::BIGINT AS tp, sum((1 - t) * p)::BIGINT AS fp, sum(t * (1 - p))::BIGINT AS fn"


def _ratio_cols():
    return [big("tp"), big("fp"), big("fn"), r6("iou"), r6("dice"), r6("precision"), r6("recall")]



@query(with_ctes("m p o", f", {_ALIGNED} SELECT *, {_RATIOS} FROM (SELECT {_COUNTS} FROM a)"))
def mask_confusion(spark, d):
    return R.confusion(X.mask(spark, d), X.prediction(spark, d)).select(*_ratio_cols())


@query(with_ctes("m p o", f""", {_ALIGNED}, s AS (SELECT *, CASE WHEN length(tile_id) % 2 = 0 THEN 'even' ELSE 'odd' END AS terrain FROM a)
SELECT terrain, tp, fp, fn, {_RATIOS}, n_tiles FROM (SELECT terrain, {_COUNTS}, count(DISTINCT tile_id)::BIGINT AS n_tiles FROM s GROUP BY GROUPING SETS ((), (terrain)))"""))
def eval_by_terrain(spark, d):
    m, p = X.mask(spark, d), X.prediction(spark, d)
    tiles = m.select("tile_id").unionByName(p.select("tile_id")).distinct()
    strata = tiles.withColumn("terrain", F.when(F.length("tile_id") % 2 == 0, "even").otherwise("odd"))
    return R.by_stratum(m, p, strata).select("terrain", *_ratio_cols(), big("n_tiles"))


@query(with_ctes("m p o", f", {_ALIGNED} SELECT tile_id, sum(t * o)::BIGINT AS hidden, sum(t * o * p)::BIGINT AS recovered, round(sum(t * o * p) / nullif(sum(t * o), 0), 6) AS occlusion_recall FROM a GROUP BY 1"))
def occlusion_recall(spark, d):
    return R.occlusion_recall(X.mask(spark, d), X.prediction(spark, d), X.occlusion(spark, d)).select("tile_id", big("hidden"), big("recovered"), r6("occlusion_recall"))


def _component_sql(src: str) -> str:
    return f"""{src}w(tile_id, id, root) AS (SELECT tile_id, "row" * {TILE} + col, "row" * {TILE} + col FROM {src} UNION SELECT w.tile_id, x."row" * {TILE} + x.col, w.root FROM {src}w w JOIN {src} x ON x.tile_id = w.tile_id
AND abs(x."row" - w.id // {TILE}) <= 1 AND abs(x.col - w.id % {TILE}) <= 1), {src}c AS (SELECT tile_id, count(DISTINCT r)::BIGINT AS k FROM (SELECT tile_id, id, min(root) AS r FROM {src}w GROUP BY ALL) GROUP BY 1)"""


@query(with_ctes("m", f", {_component_sql('m')} SELECT tile_id, k AS n_components FROM mc", True))
def mask_components(spark, d):
    return R.n_components(X.mask(spark, d), TILE).select("tile_id", big("n_components"))


@query(with_ctes("m p", f", {_component_sql('m')}, {_component_sql('p')} SELECT tile_id, mc.k AS n_true, pc.k AS n_pred, round(mc.k / pc.k, 6) AS connectivity_ratio FROM mc JOIN pc USING (tile_id)", True))
def connectivity_ratio(spark, d):
    return R.connectivity_ratio(X.mask(spark, d), X.prediction(spark, d), TILE).select("tile_id", big("n_true"), big("n_pred"), r6("connectivity_ratio"))


_DENSE = f"""d0 AS (SELECT t.tile_id, CAST(r AS INTEGER) AS "row", CAST(c AS INTEGER) AS col, CASE WHEN m.tile_id IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS v FROM (SELECT DISTINCT tile_id FROM m) t, range({TILE}) a(r), range({TILE}) b(c)
LEFT JOIN m ON m.tile_id = t.tile_id AND m."row" = r AND m.col = c)"""


def _erode_sql(src):
    return f"""SELECT tile_id, "row", col, least(min(v) OVER (PARTITION BY tile_id, col ORDER BY "row" ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), min(v) OVER (PARTITION BY tile_id, "row" ORDER BY col ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)) AS v FROM {src}"""


def _dilate_sql(src):
    return f"""SELECT tile_id, "row", col, max(v) OVER (PARTITION BY tile_id, "row" ORDER BY col ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS v FROM (SELECT tile_id, "row", col, max(v) OVER (PARTITION BY tile_id, col ORDER BY "row" ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS v FROM {src})"""


def _pixels(spark, d):
    return R.dense(X.mask(spark, d), TILE, TILE)


@query(with_ctes("m", f", {_DENSE} {_erode_sql('d0')}"))
def morph_erode(spark, d):
    return R.erode(_pixels(spark, d))


@query(with_ctes("m", f", {_DENSE} {_dilate_sql('d0')}"))
def morph_dilate(spark, d):
    return R.dilate(_pixels(spark, d))


@query(with_ctes("m", f", {_DENSE}, e1 AS ({_erode_sql('d0')}) {_dilate_sql('e1')}"))
def morph_open(spark, d):
    return R.opened(_pixels(spark, d))


@query(with_ctes("m", f""", {_DENSE}, e1 AS ({_erode_sql('d0')}), o1 AS ({_dilate_sql('e1')}), e2 AS ({_erode_sql('e1')}), o2 AS ({_dilate_sql('e2')}),
s AS (SELECT d0.tile_id, d0."row", d0.col, greatest(d0.v - o1.v, 0) AS s, greatest(e1.v - o2.v, 0) AS q FROM d0 JOIN o1 USING (tile_id, "row", col) JOIN e1 USING (tile_id, "row", col) JOIN o2 USING (tile_id, "row", col))
SELECT tile_id, "row", col, round(s + greatest(q - s * q, 0), 6) AS s FROM s"""))
def soft_skeleton_one_round(spark, d):
    return R.soft_skeleton(_pixels(spark, d), 1).select("tile_id", "row", "col", r6("s"))


@query("""WITH v AS (SELECT event_id, event_type AS band, value AS v FROM events), q AS (SELECT band, quantile_cont(v, 0.02) AS lo, quantile_cont(v, 0.98) AS hi FROM v GROUP BY 1)
SELECT event_id, band, CAST(trunc(least(greatest((v - lo) / (CASE WHEN hi <= lo THEN 1 ELSE hi - lo END) * 255, 0), 255)) AS INTEGER) AS u8 FROM v JOIN q USING (band)""")
def percentile_stretch(spark, d):
    v = X.table(spark, d, "events").select("event_id", F.col("event_type").alias("band"), F.col("value").alias("v"))
    return R.stretch(v, ["band"]).select("event_id", "band", "u8")


@query("""WITH w AS (SELECT event_type AS tile_id, (event_id % 2 * 8)::INTEGER AS y0, 0 AS x0, (user_id % 16)::INTEGER AS r, ((hour(ts) * 60 + minute(ts)) // 90)::INTEGER AS c, avg(value) / 500 AS p FROM events GROUP BY ALL),
h AS (SELECT tile_id, y0 + r AS "row", x0 + c AS col, p, (0.5 - 0.5 * cos(2 * pi() * (r + 1) / 17)) * (0.5 - 0.5 * cos(2 * pi() * (c + 1) / 17)) AS k FROM w)
SELECT tile_id, "row", col, round(sum(p * k) / sum(k), 6) AS p FROM h GROUP BY ALL""")
def hann_blend(spark, d):
    e = X.table(spark, d, "events")
    minute = F.hour("ts") * 60 + F.minute("ts")
    w = e.groupBy(F.col("event_type").alias("tile_id"), (F.col("event_id") % 2 * 8).cast("int").alias("y0"), F.lit(0).alias("x0"), (F.col("user_id") % 16).cast("int").alias("r"), F.floor(minute / 90).cast("int").alias("c")).agg((F.avg("value") / 500).alias("p"))
    return R.blend(w, 16).select("tile_id", "row", "col", r6("p"))


@query("""SELECT label::VARCHAR AS tile_id, (vec_id % 10)::INTEGER AS "row", i::INTEGER AS col, round(avg(1 / (1 + exp(-embedding[i + 1]::DOUBLE))), 6) AS p, count(*)::BIGINT AS n_views FROM embeddings, range(8) t(i) GROUP BY 1, 2, 3""")
def tta_mean(spark, d):
    e = X.table(spark, d, "embeddings").select(F.col("label").cast("string").alias("tile_id"), (F.col("vec_id") % 10).cast("int").alias("row"), F.posexplode(F.slice("embedding", 1, 8)).alias("col", "z"))
    return R.tta_mean(e.withColumn("p", S.sigmoid(F.col("z").cast("double")))).select("tile_id", "row", "col", r6("p"), big("n_views"))


# -------------------------------------------------------------------------------------------------------------- graphs

_DEG = "g AS (SELECT vn.graph_id, vn.node_id, count(u)::BIGINT AS degree FROM vn LEFT JOIN (SELECT graph_id, src AS u FROM ve UNION ALL SELECT graph_id, dst FROM ve) x ON x.graph_id = vn.graph_id AND u = node_id GROUP BY 1, 2)"
_COMP = """w(graph_id, node_id, root) AS (SELECT graph_id, node_id, node_id FROM vn UNION SELECT w.graph_id, y.b, w.root FROM w JOIN (SELECT graph_id, src AS a, dst AS b FROM ve UNION ALL SELECT graph_id, dst, src FROM ve) y ON y.graph_id = w.graph_id AND y.a = w.node_id),
k AS (SELECT graph_id, node_id, min(root) AS component FROM w GROUP BY 1, 2)"""


@query(with_ctes("vn ve", f", {_DEG} SELECT * FROM g"))
def graph_degree(spark, d):
    return G.degree(*X.vector_graph(spark, d)).select("graph_id", "node_id", big("degree"))


@query(with_ctes("vn ve", f", {_COMP} SELECT graph_id, node_id, component FROM k", True))
def graph_components(spark, d):
    return G.components(*X.vector_graph(spark, d))


@query(with_ctes("vn ve", f""", {_DEG}, {_COMP} SELECT graph_id, n_nodes, n_isolated, coalesce(n_edges, 0)::BIGINT AS n_edges, n_components, coalesce(total_length, 0)::DOUBLE AS total_length FROM (SELECT graph_id, count(*)::BIGINT AS n_nodes,
count(*) FILTER (degree = 0)::BIGINT AS n_isolated FROM g GROUP BY 1) JOIN (SELECT graph_id, count(DISTINCT component)::BIGINT AS n_components FROM k GROUP BY 1) USING (graph_id) LEFT JOIN (SELECT graph_id, count(*) AS n_edges, sum(length) AS total_length FROM ve GROUP BY 1) USING (graph_id)""", True))
def graph_stats(spark, d):
    return G.stats(*X.vector_graph(spark, d)).select("graph_id", big("n_nodes"), big("n_isolated"), big("n_edges"), big("n_components"), F.col("total_length").cast("double").alias("total_length"))


@query(with_ctes("vn ve", f", {_COMP} SELECT graph_id, round(max(n) / sum(n), 6) AS lcc_fraction FROM (SELECT graph_id, component, count(*) AS n FROM k GROUP BY 1, 2) GROUP BY 1", True))
def largest_component(spark, d):
    return G.largest_component(*X.vector_graph(spark, d)).select("graph_id", r6("lcc_fraction"))


@query(with_ctes("vn ve", "SELECT graph_id, src AS a, dst AS b, d2 FROM ve"))
def spatial_pairs(spark, d):
    return G.pairs_within(X.vector_graph(spark, d)[0], 40.0)


_MATCH = """p AS (SELECT a.graph_id, a.node_id AS a, b.node_id AS b, (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y) AS d2 FROM vn a JOIN vn b ON a.graph_id = b.graph_id WHERE a.node_id % 2 = 0 AND b.node_id % 2 = 1 AND (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y) <= 3600),
q AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY graph_id, a ORDER BY d2, b) = 1)"""


@query(with_ctes("vn", f", {_MATCH} SELECT vn.graph_id, node_id AS a, b, d2 FROM vn LEFT JOIN q ON q.graph_id = vn.graph_id AND a = node_id WHERE node_id % 2 = 0"))
def nearest_match(spark, d):
    n = X.vector_graph(spark, d)[0]
    return G.nearest(n.where("node_id % 2 = 0"), n.where("node_id % 2 = 1"), 60.0)


@query(with_ctes("vn", "SELECT graph_id, node_id, (x - 10) * (x - 10) + (y + 5) * (y + 5) AS d2 FROM vn QUALIFY row_number() OVER (PARTITION BY graph_id ORDER BY (x - 10) * (x - 10) + (y + 5) * (y + 5), node_id) = 1"))
def nearest_to_click(spark, d):
    return G.nearest_to(X.vector_graph(spark, d)[0], 10.0, -5.0).select("graph_id", "node_id", "d2")


_CAND = f"""{_DEG}, {_COMP}, c AS (SELECT a.graph_id, a.node_id AS a, b.node_id AS b, (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y) AS d2, ka.component AS ca, kb.component AS cb FROM vn a JOIN vn b ON a.graph_id = b.graph_id AND a.node_id < b.node_id
JOIN k ka ON ka.graph_id = a.graph_id AND ka.node_id = a.node_id JOIN k kb ON kb.graph_id = b.graph_id AND kb.node_id = b.node_id JOIN g ga ON ga.graph_id = a.graph_id AND ga.node_id = a.node_id JOIN g gb ON gb.graph_id = b.graph_id AND gb.node_id = b.node_id
WHERE ka.component <> kb.component AND (ga.degree = 1 OR gb.degree = 1) AND (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y) <= 6400)"""


@query(with_ctes("vn ve", f", {_CAND} SELECT * FROM c", True))
def heal_candidates(spark, d):
    return G.heal_candidates(*X.vector_graph(spark, d), 80.0)


# every pair of components within reach is joined in the end, so the components after healing are those of edges and candidates
@query(with_ctes("vn ve", f""", {_CAND}, j(graph_id, r0, r) AS (SELECT DISTINCT graph_id, component, component FROM k UNION SELECT j.graph_id, j.r0, z.b FROM j JOIN (SELECT graph_id, ca AS a, cb AS b FROM c UNION SELECT graph_id, cb, ca FROM c) z ON z.graph_id = j.graph_id AND z.a = j.r),
m2 AS (SELECT graph_id, r0, min(r) AS lab FROM j GROUP BY 1, 2)
SELECT graph_id, count(*)::BIGINT AS components_before, count(DISTINCT lab)::BIGINT AS components_after, (count(*) - count(DISTINCT lab))::BIGINT AS n_bridges FROM m2 GROUP BY 1""", True))
def heal_summary(spark, d):
    n, e = X.vector_graph(spark, d)
    return G.heal_summary(n, e, G.heal(n, e, 80.0)).select("graph_id", big("components_before"), big("components_after"), big("n_bridges"))


@query(with_ctes("vn", "SELECT graph_id, node_id FROM vn WHERE x * x + y * y <= 250000"))
def hazard_radius(spark, d):
    return H.RadiusHazard((0.0, 0.0), 500.0).impacted(X.vector_graph(spark, d)[0])


@query(with_ctes("vn", "SELECT graph_id, node_id FROM vn WHERE y BETWEEN -50 AND 120"))
def hazard_band(spark, d):
    return H.BandHazard("y", -50.0, 120.0).impacted(X.vector_graph(spark, d)[0])


@query(with_ctes("vn", "SELECT graph_id, node_id FROM vn WHERE node_id IN (SELECT doc_id FROM documents)"))
def hazard_nodes(spark, d):
    n = X.vector_graph(spark, d)[0]
    listed = X.table(spark, d, "documents").select(F.col("doc_id").cast("long").alias("node_id"))
    ids = n.select("graph_id", "node_id").join(listed, "node_id", "left_semi").unionByName(listed.withColumn("graph_id", F.lit("none")))
    return H.NodeHazard(ids).impacted(n)


_RASTER = """c AS (SELECT floor((y + 1000) / 25)::INTEGER AS "row", floor((x + 1000) / 25)::INTEGER AS col, count(*)::DOUBLE AS v FROM vn GROUP BY 1, 2), a AS (SELECT graph_id, node_id, trunc((y + 1000) / 25)::INTEGER AS "row", trunc((x + 1000) / 25)::INTEGER AS col FROM vn)"""
_ON = """a."row" BETWEEN 0 AND 79 AND a.col BETWEEN 0 AND 79"""


@query(with_ctes("vn", f""", {_RASTER} SELECT graph_id, node_id FROM a JOIN c USING ("row", col) WHERE {_ON} AND v > 1.5"""))
def hazard_depth(spark, d):
    return H.RasterHazard(X.raster(spark, d), (0.04, 0, 40, 0, 0.04, 40), 80, 80, "depth", 1.5).impacted(X.vector_graph(spark, d)[0])


@query(with_ctes("vn", f""", {_RASTER} SELECT graph_id, node_id FROM a JOIN c USING ("row", col) WHERE {_ON} AND v <= 2 AND v <> 1"""))
def hazard_elevation(spark, d):
    return H.RasterHazard(X.raster(spark, d), (0.04, 0, 40, 0, 0.04, 40), 80, 80, "elevation", 2.0, nodata=1.0).impacted(X.vector_graph(spark, d)[0])


@query(with_ctes("vn ve", """, h AS (SELECT graph_id, node_id FROM vn WHERE y BETWEEN -50 AND 120) SELECT graph_id, src, dst, length FROM ve WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.graph_id = ve.graph_id AND (node_id = src OR node_id = dst))"""))
def ablated_edges(spark, d):
    n, e = X.vector_graph(spark, d)
    return G.ablate(n, e, H.BandHazard("y", -50.0, 120.0).impacted(n))[1].select("graph_id", "src", "dst", "length")


@query(with_ctes("vn", """, r AS (SELECT graph_id, node_id, row_number() OVER (PARTITION BY graph_id ORDER BY node_id) - 1 AS r, count(*) OVER (PARTITION BY graph_id) AS n FROM vn)
SELECT graph_id, node_id FROM r WHERE n <= 7 OR list_contains(list_transform(range(7), lambda i: (i * (n - 1)) // 6), r)"""))
def spaced_sources(spark, d):
    return G.spaced_sources(X.vector_graph(spark, d)[0], 7).select("graph_id", "node_id")


@query(with_ctes("vn", "SELECT graph_id, round(avg(x), 6) AS cx, round(avg(y), 6) AS cy, min(x) AS west, min(y) AS south, max(x) AS east, max(y) AS north FROM vn GROUP BY 1"))
def graph_extent(spark, d):
    n = X.vector_graph(spark, d)[0]
    a = n.groupBy("graph_id").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.min("x").alias("west"), F.min("y").alias("south"), F.max("x").alias("east"), F.max("y").alias("north"))
    return a.select("graph_id", r6("cx"), r6("cy"), "west", "south", "east", "north")


def _relax(edges: str, nodes: str, out: str, rounds: int = 12) -> str:
    u = f"{out}u AS MATERIALIZED (SELECT src AS a, dst AS b, length AS w FROM {edges} UNION ALL SELECT dst, src, length FROM {edges}), {out}0 AS MATERIALIZED (SELECT node_id AS s, node_id AS t, 0.0::DOUBLE AS d FROM {nodes})"
    for k in range(rounds):
        u += f", {out}{k + 1} AS MATERIALIZED (SELECT s, t, min(d) AS d FROM (SELECT * FROM {out}{k} UNION ALL SELECT s, b, d + w FROM {out}{k} JOIN {out}u ON a = t) GROUP BY 1, 2)"
    return u + f", {out} AS MATERIALIZED (SELECT * FROM {out}{rounds})"


@query(with_ctes("e n", f", {_relax('e', 'n', 'x')} SELECT s AS source, t AS target, d AS distance FROM x"))
def all_pairs_distance(spark, d):
    return G.shortest_distances(*X.trade_graph(spark, d)).select("source", "target", "distance")


@query(with_ctes("e n", f", {_relax('e', 'n', 'x')} SELECT round(sum(1 / d) / (max(m) * (max(m) - 1)), 9) AS efficiency FROM x, (SELECT count(*) AS m FROM n) WHERE d > 0"))
def global_efficiency(spark, d):
    return G.efficiency(*X.trade_graph(spark, d)).select(F.round("efficiency", 9).alias("efficiency"))


_LEFT = "h AS MATERIALIZED (SELECT node_id FROM n WHERE node_id % 5 = 2), ln AS MATERIALIZED (SELECT node_id FROM n WHERE node_id % 5 <> 2), le AS MATERIALIZED (SELECT * FROM e WHERE src % 5 <> 2 AND dst % 5 <> 2)"


@query(with_ctes("e n", f""", {_LEFT}, {_relax('e', 'n', 'x')}, {_relax('le', 'ln', 'y')}, m AS (SELECT count(*) AS m FROM n), b AS (SELECT sum(1 / d) / (max(m) * (max(m) - 1)) AS v FROM x, m WHERE d > 0),
a AS (SELECT coalesce(sum(1 / d) / (max(m) * (max(m) - 1)), 0) AS v FROM y, m WHERE d > 0), c AS (SELECT min(t) AS root, s FROM y GROUP BY s), z AS (SELECT root, count(*) AS k FROM c GROUP BY 1)
SELECT (SELECT m FROM m)::BIGINT AS n_nodes, (SELECT count(*) FROM h)::BIGINT AS n_impacted, round(b.v, 9) AS efficiency_before, round(a.v, 9) AS efficiency_after, round(a.v / b.v, 6) AS resilience_index, round(1 - a.v / b.v, 6) AS efficiency_drop,
(SELECT count(*) FROM z)::BIGINT AS components_after, (SELECT round(max(k) / sum(k), 6) FROM z) AS lcc_after FROM a, b"""))
def resilience_report(spark, d):
    n, e = X.trade_graph(spark, d)
    r = resilience.report(n, e, H.BandHazard("x", 20.0, 20.0))
    return r.select(big("n_nodes"), big("n_impacted"), F.round("efficiency_before", 9).alias("efficiency_before"), F.round("efficiency_after", 9).alias("efficiency_after"), r6("resilience_index"), r6("efficiency_drop"), big("components_after"), r6("lcc_after"))


@query(with_ctes("e n", f""", {_LEFT}, {_relax('e', 'n', 'x')}, {_relax('le', 'ln', 'y')}, q AS (SELECT a.node_id AS s, b.node_id AS t FROM n a, n b WHERE a.node_id < b.node_id AND a.node_id % 5 <> 2 AND b.node_id % 5 <> 2)
SELECT q.s AS source, q.t AS target, coalesce(x.d, 'inf'::DOUBLE) AS "before", coalesce(y.d, 'inf'::DOUBLE) AS "after", CASE WHEN x.d IS NULL OR x.d = 0 THEN NULL WHEN y.d IS NULL THEN 'inf'::DOUBLE ELSE round(y.d / x.d, 6) END AS ratio
FROM q LEFT JOIN x ON x.s = q.s AND x.t = q.t LEFT JOIN y ON y.s = q.s AND y.t = q.t"""))
def reroute_cost(spark, d):
    n, e = X.trade_graph(spark, d)
    kept = n.where("node_id % 5 <> 2").select("graph_id", "node_id")
    # the trips asked for, each pair of surviving nodes once
    trips = kept.withColumnRenamed("node_id", "source").join(kept.withColumnRenamed("node_id", "target"), "graph_id").where("source < target")
    r = G.reroute(n, e, trips, n.where("node_id % 5 = 2").select("graph_id", "node_id"))
    return r.select("source", "target", "before", "after", r6("ratio"))


def _sigma(rounds: int = 12) -> str:
    out = "p0 AS MATERIALIZED (SELECT node_id AS s, node_id AS v, 1.0::DOUBLE AS c FROM n)"
    for k in range(rounds):
        out += f", p{k + 1} AS MATERIALIZED (SELECT p.s, u.b AS v, sum(p.c) AS c FROM p{k} p JOIN xu u ON u.a = p.v JOIN x xs ON xs.s = p.s AND xs.t = p.v JOIN x xt ON xt.s = p.s AND xt.t = u.b WHERE xs.d + u.w = xt.d GROUP BY 1, 2)"
    return out + ", g AS MATERIALIZED (SELECT s, v, sum(c) AS c FROM (" + " UNION ALL ".join(f"SELECT * FROM p{k}" for k in range(rounds + 1)) + ") GROUP BY 1, 2)"


_BC = f"""{_relax('e', 'n', 'x')}, {_sigma()}, bc AS (SELECT v.node_id, coalesce(sum(a.c * b.c / t.c), 0) AS raw FROM n v LEFT JOIN x st ON st.s <> st.t AND st.s <> v.node_id AND st.t <> v.node_id LEFT JOIN x sv ON sv.s = st.s AND sv.t = v.node_id LEFT JOIN x vt ON vt.s = v.node_id AND vt.t = st.t
AND sv.d + vt.d = st.d LEFT JOIN g a ON a.s = st.s AND a.v = v.node_id LEFT JOIN g b ON vt.s IS NOT NULL AND b.s = v.node_id AND b.v = st.t LEFT JOIN g t ON t.s = st.s AND t.v = st.t GROUP BY 1), m AS (SELECT count(*) AS m FROM n)"""


@query(with_ctes("e n", f", {_BC} SELECT node_id, round(raw / ((m - 1) * (m - 2)), 6) AS bc FROM bc, m"))
def betweenness_node(spark, d):
    return G.betweenness(*X.trade_graph(spark, d)).select("node_id", r6("bc"))


@query(with_ctes("e n", f""", {_relax('e', 'n', 'x')}, {_sigma()}, m AS (SELECT count(*) AS m FROM n), eb AS (SELECT least(u.a, u.b) AS src, greatest(u.a, u.b) AS dst, sum(ga.c * gb.c / gt.c) AS raw FROM xu u JOIN x su ON su.t = u.a JOIN x vt ON vt.s = u.b JOIN x st ON st.s = su.s AND st.t = vt.t AND st.s <> st.t
JOIN g ga ON ga.s = su.s AND ga.v = u.a JOIN g gb ON gb.s = u.b AND gb.v = vt.t JOIN g gt ON gt.s = st.s AND gt.v = st.t WHERE su.d + u.w + vt.d = st.d GROUP BY 1, 2) SELECT e.src, e.dst, round(coalesce(raw, 0) / (m * (m - 1)), 6) AS bc FROM e LEFT JOIN eb USING (src, dst), m"""))
def betweenness_edge(spark, d):
    return G.edge_betweenness(*X.trade_graph(spark, d)).select("src", "dst", r6("bc"))


@query(with_ctes("e n", f", {_BC} SELECT node_id, row_number() OVER (ORDER BY round(raw / ((m - 1) * (m - 2)), 6) DESC, node_id)::BIGINT AS rank FROM bc, m QUALIFY rank <= 10"))
def critical_top(spark, d):
    bc = G.betweenness(*X.trade_graph(spark, d)).withColumn("bc", F.round("bc", 6))
    return G.critical(bc, 10).select("node_id", big("rank"))


# ------------------------------------------------------------------------------- results that SQL can't give, by kernels


@query()
def mask_graph_stats(spark, d):
    n, e = R.mask_to_graph(X.mask(spark, d), TILE)
    return G.stats(n, e).select("graph_id", big("n_nodes"), big("n_edges"), big("n_components"), r6("total_length"))


@query()
def graph_apls(spark, d):
    a = R.mask_to_graph(X.mask(spark, d), TILE)
    b = R.mask_to_graph(X.prediction(spark, d), TILE)
    return G.apls(a, b).select("graph_id", r6("apls"))


@query()
def static_and_dynamic_attack(spark, d):
    return G.attacks(*X.trade_graph(spark, d), 3).select("graph_id", big("n_nodes"), r6("ri_static"), r6("ri_dynamic"), "dynamic_worse")


@query()
def damaged_and_healed(spark, d):
    n, e = X.vector_graph(spark, d)
    n2, e2 = G.damage(n, e, 40.0, 3)
    return G.heal_summary(n2, e2, G.heal(n2, e2, 80.0)).select("graph_id", big("components_before"), big("components_after"), big("n_bridges"), r6("bridge_length"))


@query()
def tile_pipeline(spark, d):
    from arterial.plans.pipeline import tile_reports

    return tile_reports(X.mask(spark, d), TILE)
