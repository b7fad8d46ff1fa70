import numpy as np
import pytest
from pyspark.sql import functions as F

from arterial.functions import geodesy, scalars as S
from arterial.operators import graph as G, hazard as H, occlusion as O, raster as R, resilience, tiles as T
from arterial.plans.pipeline import as_json, healing_ablation, map_layers, tile_reports
from arterial.plans.predict import augmented, predict, predict_rasters, predicted_cells, prediction_files, probabilities, resized, stretched, window_starts
from arterial.sources import tables, tiff
from arterial.streaming import running

NODES, EDGES = "graph_id string, node_id long, x double, y double", "graph_id string, src long, dst long, length double"


def graph(spark, nodes, edges):
    return spark.createDataFrame([("g", i, float(x), float(y)) for i, x, y in nodes], NODES), spark.createDataFrame([("g", a, b, float(w)) for a, b, w in edges], EDGES)


def two_segments(spark, gap):
    return graph(spark, [(0, 0, 0), (1, 10, 0), (2, 10 + gap, 0), (3, 20 + gap, 0)], [(0, 1, 10), (2, 3, 10)])


@pytest.mark.parametrize(("gap", "want"), [(8, [(1, 2, 8.0)]), (100, [])])
def test_heal_bridges_small_gaps_only(spark, gap, want):
    assert [tuple(r)[1:] for r in G.heal(*two_segments(spark, gap)).collect()] == want


def test_heal_three_segments_and_summary(spark):
    n, e = graph(spark, [(0, 0, 0), (1, 10, 0), (2, 18, 0), (3, 28, 0), (4, 30, 0), (5, 40, 0)], [(0, 1, 10), (2, 3, 10), (4, 5, 10)])
    b = G.heal(n, e)
    s = G.heal_summary(n, e, b).first()
    assert (s.components_before, s.n_bridges, s.components_after) == (3, 2, 1)


def test_heal_of_connected_graph_does_nothing(spark):
    assert G.heal(*graph(spark, [(0, 0, 0), (1, 10, 0)], [(0, 1, 10)])).count() == 0


def test_large_components_equal_kernel(spark):
    n, e = graph(spark, [(i, i, 0) for i in range(12)], [(0, 5, 1), (5, 9, 1), (9, 2, 1), (3, 4, 1), (7, 8, 1), (8, 11, 1)])
    a = {r.node_id: r.component for r in G.components(n, e).collect()}
    assert a == {r.node_id: r.component for r in G.components_of_large(n, e).collect()} and a[2] == 0 and a[11] == 7


def grid3(spark):
    nodes = [(3 * i + j, j, i) for i in range(3) for j in range(3)]
    return graph(spark, nodes, [(a, a + 1, 1) for a in (0, 1, 3, 4, 6, 7)] + [(a, a + 3, 1) for a in range(6)])


def test_hazards(spark):
    n, e = grid3(spark)
    ids = lambda h: sorted(r.node_id for r in h.impacted(n).collect())
    assert ids(H.RadiusHazard((0.0, 0.0), 1.1)) == [0, 1, 3]
    assert ids(H.BandHazard("y", 0.0, 0.0)) == [0, 1, 2]
    assert ids(H.NodeHazard(spark.createDataFrame([("g", 4), ("g", 99)], "graph_id string, node_id long"))) == [4]
    with pytest.raises(ValueError):
        H.RasterHazard(n, (1, 0, 0, 0, 1, 0), 1, 1, "wind")


def test_raster_hazard_modes_and_missing_values(spark):
    n, _ = graph(spark, [(0, 0.5, 0.5), (1, 1.5, 0.5), (2, 500, 0.5), (3, -0.5, 0.5)], [])
    cells = spark.createDataFrame([(0, 0, -9999.0), (0, 1, 2.0)], "row int, col int, v double")
    hit = lambda **k: sorted(r.node_id for r in H.RasterHazard(cells, (1, 0, 0, 0, 1, 0), 1, 2, **k).impacted(n).collect())
    assert hit(mode="depth", threshold=0.3, nodata=-9999.0) == [1]
    assert hit(mode="elevation", threshold=5.0) == [0, 1, 3]  # a place up to one cell outside truncates to the border


def test_resilience_report_and_total_loss(spark):
    n, e = graph(spark, [(i, i, 0) for i in range(5)], [(i, i + 1, 1) for i in range(4)])
    r = resilience.report(n, e, H.RadiusHazard((2.0, 0.0), 0.1)).first()
    assert (r.n_impacted, r.components_after) == (1, 2) and 0 < r.resilience_index < 1
    r = resilience.report(n, e, H.RadiusHazard((2.0, 0.0), 100.0)).first()
    assert r.resilience_index == 0 and r.efficiency_drop == 1


def test_flood_and_reroute(spark):
    n, e = grid3(spark)
    rep, hit, bc = resilience.flood(n, e, spark.createDataFrame([("g", 4)], "graph_id string, node_id long"), 0.5)
    assert rep.first().n_impacted == 1 and bc.count() == 8
    trips = spark.createDataFrame([("g", 3, 5)], "graph_id string, source long, target long")
    r = G.reroute(n, e, trips, hit).first()
    assert (r.before, r.after, r.ratio) == (2.0, 4.0, 2.0) and r.path_before == [3, 4, 5] and len(r.path_after) == 5


def test_line_cut_gives_infinity(spark):
    n, e = graph(spark, [(i, i, 0) for i in range(5)], [(i, i + 1, 1) for i in range(4)])
    trips = spark.createDataFrame([("g", 0, 4)], "graph_id string, source long, target long")
    r = G.reroute(n, e, trips, n.where("node_id = 2")).first()
    assert (r.before, r.after, r.ratio, r.path_after) == (4.0, float("inf"), float("inf"), None)


def test_windows_and_grid(spark):
    df = spark.createDataFrame([(1024,), (1500,), (1000,), (512,), (300,)], "n int")
    got = [r[0] for r in df.select(T.starts("n", 512, 384)).collect()]
    assert got == [[0, 384, 512], [0, 384, 768, 988], [0, 384, 488], [0], [0]]
    assert T.inference_window(512, 0.25) == (512, 384) and window_starts(1300, 512, 256).tolist() == [0, 256, 512, 768, 788]
    p = spark.createDataFrame([("p", 0.0, 0.0, 1000.0, 1000.0)], "place string, west double, south double, east double, north double")
    assert T.tile_grid(p, 100, 1.0).count() == 100 and T.tile_grid(p, 100, 1.0, 0.5).count() > 100
    with pytest.raises(ValueError):
        T.tile_grid(p, 100, 1.0, 1.0)


def test_split_spans_every_stratum_and_is_stable(spark):
    m = spark.range(80).select(F.col("id").cast("string").alias("tile_id"), F.concat(F.lit("t"), (F.col("id") % 4).cast("string")).alias("terrain"))
    a = {r.tile_id: r.split for r in T.split(m).collect()}
    assert a == {r.tile_id: r.split for r in T.split(m.repartition(3)).collect()}
    assert {(r.train, r.val, r.test, r.All) for r in T.split_summary(T.split(m)).where("terrain <> 'All'").collect()} == {(14, 3, 3, 20)}
    assert T.split(m.withColumn("terrain", F.lit(None).cast("string"))).first().split == ""


def test_rasterise_finds_the_band(spark):
    tiles = spark.createDataFrame([("t", 0.0, 0.0, 100.0, 100.0, 100, 100)], "tile_id string, west double, south double, east double, north double, width int, height int")
    seg = spark.createDataFrame([("a", 0.0, 50.0, 100.0, 50.0), ("far", 900.0, 900.0, 950.0, 950.0)], "seg_id string, x0 double, y0 double, x1 double, y1 double")
    cells = T.rasterise(tiles, seg, 2.0)
    assert cells.select("col").distinct().count() == 100 and 300 <= cells.count() <= 700


def cells(spark, tile, points):
    return spark.createDataFrame([(tile, r, c) for r, c in points], "tile_id string, row int, col int")


def test_metrics_of_broken_and_missing_predictions(spark):
    band = [(r, c) for r in (31, 32, 33) for c in range(64)]
    whole, broken = cells(spark, "t", band), cells(spark, "t", [p for p in band if not 30 <= p[1] < 34])
    assert R.confusion(whole, whole).first().iou > 0.99
    assert R.cldice(whole, whole).first().cldice == pytest.approx(1, abs=1e-3)
    assert R.cldice(whole, broken).first().cldice < R.cldice(whole, whole).first().cldice
    assert R.connectivity_ratio(whole, broken, 64).first().connectivity_ratio == 0.5
    empty = whole.where("false")
    assert R.connectivity_ratio(whole, empty, 64).first().connectivity_ratio == 0
    occ = cells(spark, "t", [(r, c) for r in range(64) for c in range(20, 40)])
    r = R.occlusion_recall(whole, cells(spark, "t", [p for p in band if not 30 <= p[1] < 40]), occ).first()
    assert r.recovered * 2 == r.hidden


def test_soft_skeleton_kernel_equals_windows(spark):
    rng = np.random.default_rng(0)
    px = spark.createDataFrame([("t", r, c, float(v)) for (r, c), v in np.ndenumerate(rng.random((9, 9)))], "tile_id string, row int, col int, v double")
    a = {(r.row, r.col): r.s for r in R.soft_skeleton(px, 2).collect()}
    b = {(r.row, r.col): r.s for r in R.soft_skeleton_by_tile(px, 2).collect()}
    assert a.keys() == b.keys() and max(abs(a[k] - b[k]) for k in a) < 1e-12


def test_blend_of_a_constant_is_constant(spark):
    w = spark.createDataFrame([("t", y0, 0, r, c, 0.25) for y0 in (0, 4) for r in range(8) for c in range(8)], "tile_id string, y0 int, x0 int, r int, c int, p double")
    assert {round(r.p, 9) for r in R.blend(w, 8).collect()} == {0.25}
    p = predict(np.zeros((3, 90, 70), np.uint8), lambda x: np.zeros((len(x), *x.shape[2:])), 64, 0.25, views=True)
    assert p.shape == (90, 70) and np.allclose(p, 0.5)


def test_stretch_of_ramp_and_flat_band():
    u = stretched(np.arange(4096, dtype=np.uint16).reshape(1, 64, 64))
    assert u.min() == 0 and u.max() == 255
    assert np.isfinite(stretched(np.full((1, 4, 4), 700, np.uint16)).astype(float)).all()


def test_tiff_round_trip_and_errors(spark, tmp_path):
    a = np.random.default_rng(1).integers(0, 2, (1, 40, 30)).astype(np.uint8)
    r = tiff.decode(tiff.encode(tiff.Raster(a, (0.5, 0, 785000.0, 0, -0.5, 1437000.0), 32643, -9999.0)))
    assert (r.data == a).all() and r.transform[2] == 785000.0 and r.epsg == 32643 and r.nodata == -9999.0
    f = np.random.default_rng(2).random((3, 17, 23)).astype(np.float32)
    assert (tiff.decode(tiff.encode(tiff.Raster(f))).data == f).all()
    (tmp_path / "a.tif").write_bytes(tiff.encode(tiff.Raster(a)))
    (tmp_path / "b.tif").write_bytes(b"no tiff")
    got = tiff.read(spark, str(tmp_path))
    assert got.where("error is not null").count() == 1 and tiff.cells(got).count() == int(a.sum())


def test_graphml_round_trip(spark, tmp_path):
    (tmp_path / "g.graphml").write_text(tables.graphml([{"graph_id": "g", "node_id": 1, "x": 0.5}, {"graph_id": "g", "node_id": 2, "x": 1.5}], [{"graph_id": "g", "src": 1, "dst": 2, "length": 3.0, "healed": True}]))
    n, e = tables.read_graphml(spark, str(tmp_path / "g.graphml"))
    assert {r.node_id: r.attributes["x"] for r in n.collect()} == {"1": "0.5", "2": "1.5"}
    assert e.first().attributes == {"length": "3.0", "healed": "true"}


def test_dataset_layouts(spark):
    f = lambda *p: spark.createDataFrame([(x,) for x in p], "path string")
    assert tables.deepglobe_pairs(f("/d/1_sat.jpg", "/d/1_mask.png", "/d/2_sat.jpg")).count() == 1
    assert tables.folder_pairs(f("/i/a.png", "/i/b.JPG", "/i/c.txt"), f("/m/a.tif", "/m/B.png")).count() == 1
    found = f(*[f"/r/{s}{x}/{i}.png" for s in ("train", "val", "test") for x in ("", "_labels") for i in (1, 2)])
    assert tables.labelled_folder_pairs(found).count() == 6
    assert tables.chip_pairs(f("/x/RGB_img12.tif"), f("/y/roads_img12.geojson")).first().pair_id == "img12"


def test_segments_from_geojson(spark, tmp_path):
    (tmp_path / "a.geojson").write_text('{"features":[{"geometry":{"type":"LineString","coordinates":[[0,0],[1,1],[2,0]]}},{"geometry":{"type":"LineString","coordinates":[[5,5]]}}]}')
    assert tables.road_segments(spark, str(tmp_path / "a.geojson")).count() == 2


def test_manifest_and_config(spark, tmp_path):
    df = spark.createDataFrame([("a", 0.5)], "tile_id string, road_frac double")
    tables.write_manifest(df, str(tmp_path / "m"))
    r = tables.read_manifest(spark, str(tmp_path / "m")).first()
    assert (r.tile_id, r.road_frac, r.split, r.place, r.width) == ("a", 0.5, "", "", None)
    (tmp_path / "a.yaml").write_text("x: {y: 1, z: 2}")
    (tmp_path / "b.yaml").write_text("x: {y: 3}")
    assert tables.load_config(str(tmp_path / "a.yaml"), str(tmp_path / "b.yaml"), overrides=["x.z=9"]) == {"x": {"y": 3, "z": 9}}
    with pytest.raises(FileNotFoundError):
        tables.load_config(str(tmp_path / "none.yaml"))


def test_utm_round_trip_and_known_place():
    x, y = geodesy.to_utm([77.0], [13.0], 32643)
    lon, lat = geodesy.from_utm(x, y, 32643)
    assert abs(lon[0] - 77) < 1e-9 and abs(lat[0] - 13) < 1e-9
    x, y = geodesy.to_utm([75.0], [0.0], 32643)  # on the central meridian and the equator
    assert abs(x[0] - 500000) < 1e-6 and abs(y[0]) < 1e-6
    with pytest.raises(ValueError):
        geodesy.zone(3857)


def test_half_diagonal(spark):
    d = spark.range(1).select(S.half_diagonal_m(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))).first()[0]
    assert d == pytest.approx(110540 / 2)
    assert spark.range(1).select(S.fetch_radius(F.lit(250.0))).first()[0] == 387


def test_occlusion_invariants(spark):
    mask = np.zeros((128, 128), np.uint8); mask[58:70] = 1
    img, occ, hidden, share, counts = O.occlude(np.full((128, 128, 3), 100, np.uint8), mask, coverage=(0.4, 0.4), prob=1.0, seed=3)
    assert share >= 0.35 and (hidden <= (mask > 0)).all() and sum(counts.values()) > 0
    plain = np.full((128, 128, 3), 100, np.uint8)
    assert (O.occlude(plain, mask, prob=0.0)[0] == plain).all()
    t = spark.createDataFrame([("t", 128, 128, bytearray(mask.tobytes()))], "tile_id string, height int, width int, data binary")
    assert O.occlude_tiles(t, seed=1).first() == O.occlude_tiles(t, seed=1).first()


def test_flagship_report_layers_and_ablation(spark):
    pts = [(10, c) for c in range(30) if c not in (14, 15)] + [(r, 5) for r in range(4, 20)]
    c = cells(spark, "t", sorted(set(pts)))
    r = tile_reports(c, 32)
    row = r.first()
    assert not row.empty and row.n_bridges == 1 and 0 <= row.resilience_index <= 1 and len(row.critical_nodes) <= 5
    assert '"resilience_index"' in as_json(r).first().report
    h = healing_ablation(c, 32).first()
    assert h.after < h.before and h.lcc_after >= h.lcc_before
    n, e = R.mask_to_graph(c, 32)
    layers = map_layers(n, e.withColumn("healed", F.lit(False)), G.betweenness(n, e), n.limit(1))
    assert {x.layer for x in layers.collect()} == {"road", "node", "impacted"}


def test_stream_equals_batch(spark, tmp_path):
    px = spark.createDataFrame([("a", i % 2, i % 3 % 2) for i in range(40)], "terrain string, t int, p int")
    px.write.parquet(str(tmp_path / "in"))
    q = running.running_confusion(spark.readStream.schema(px.schema).parquet(str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("conf").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("conf").first() == running.running_confusion(px).first()
    m = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "tile_id string, road_frac double")
    m.write.parquet(str(tmp_path / "man"))
    running.upsert_manifest(spark.readStream.schema(m.schema).parquet(str(tmp_path / "man")), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out/v0")).count() == 2
