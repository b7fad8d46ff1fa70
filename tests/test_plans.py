"""Ingest, evaluation, prediction files, the command line, and plans that must scale."""

import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from arterial import cli
from arterial.functions import scalars as S
from arterial.operators import graph as G, hazard as H, kernels as K, occlusion as O, raster as R, resilience, tiles as T
from arterial.plans import evaluate as E, ingest, pipeline, predict as P
from arterial.schema import MANIFEST
from arterial.sources import tables, tiff
from arterial.streaming import running

NODES, EDGES = "graph_id string, node_id long, x double, y double", "graph_id string, src long, dst long, length double"
PLACE = (0.5, 0.0, 785000.0, 0.0, -0.5, 1437000.0)


def png(a: np.ndarray) -> bytes:
    """An 8-bit grey or colour PNG."""
    h, w = a.shape[:2]
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = b"".join(b"\0" + a[y].tobytes() for y in range(h))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2 if a.ndim == 3 else 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def road(h=128, w=128):
    rng = np.random.default_rng(0)
    mask = np.zeros((h, w), np.uint8)
    mask[h // 2 - 2 : h // 2 + 2] = 255
    return rng.integers(0, 256, (h, w, 3), dtype=np.uint8), mask


def bright(x):
    """A model that says road where the first channel is above its middle."""
    return np.where(x[:, 0] > 0, 9.0, -9.0)


def flat(x):
    return np.zeros((len(x), *x.shape[2:]))


def left(x):
    out = np.full((len(x), *x.shape[2:]), -9.0)
    out[..., : x.shape[3] // 2] = 9.0
    return out


def write_deepglobe(folder, n=2):
    for k in range(n):
        image, mask = road()
        (folder / f"{k}_{'SAT' if k else 'sat'}.png").write_bytes(png(image))
        (folder / f"{k}_mask.png").write_bytes(png(mask))
    (folder / "9_sat.png").write_bytes(png(road()[0]))  # without a mask


CONFIG = {"tile_size": 64, "overlap": 0.0, "min_road_frac": 0.001}


def test_ingest_of_png_pairs(spark, tmp_path):
    write_deepglobe(tmp_path)
    image, _ = road()
    pairs = tables.deepglobe_pairs(tables.files(spark, str(tmp_path)))
    dense = tables.images(spark, str(tmp_path))
    assert (np.frombuffer(dense.where(F.col("path").endswith("0_sat.png")).first().data, np.uint8).reshape(3, 128, 128) == image.transpose(2, 0, 1)).all()
    rows = ingest.ingest(spark, ingest.load_pairs(pairs, dense, dense), "deepglobe", "city", str(tmp_path / "out"), CONFIG)
    got = rows.orderBy("tile_id").collect()
    assert len(got) == 8 and rows.columns == [c.split()[0] for c in MANIFEST.split(", ")] and {r.split for r in got} <= {"train", "val", "test"}
    back = tiff.read(spark, str(tmp_path / "out" / "images")).orderBy("path").first()
    assert (np.frombuffer(back.data, np.uint8).reshape(3, 64, 64) == image[:64, :64].transpose(2, 0, 1)).all()
    assert tiff.read(spark, str(tmp_path / "out" / "masks")).count() == 8 and all(abs(r.road_frac - 2 / 64) < 1e-9 for r in got)
    again = ingest.append(rows, rows.limit(3).withColumn("terrain", F.lit("new")))
    assert again.count() == 8 and again.where("terrain = 'new'").count() == 3
    assert ingest.ingest(spark, ingest.load_pairs(pairs, dense, dense), "deepglobe", "city", str(tmp_path / "few"), CONFIG, limit=1).count() == 4


def test_pairs_that_do_not_fit_are_rejected_with_a_reason(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "b").mkdir()
    image, mask = road()
    for name, x, m in (("good", image, mask), ("grey", mask, mask), ("small", image, mask[:64]), ("blank", image, mask * 0)):
        (tmp_path / "a" / f"{name}.png").write_bytes(png(x))
        (tmp_path / "b" / f"{name}.png").write_bytes(png(m))
    (tmp_path / "a" / "broken.png").write_bytes(b"no image")
    (tmp_path / "b" / "broken.png").write_bytes(png(mask))
    at = lambda x: str(tmp_path / x)
    pairs = ingest.load_pairs(tables.folder_pairs(tables.files(spark, at("a")), tables.files(spark, at("b"))), tables.images(spark, at("a")), tables.images(spark, at("b")))
    cut = ingest.tiles(pairs, "folder", CONFIG).collect()
    why = {r.tile_id: r.error for r in cut if r.error}
    assert set(why) == {"folder_grey", "folder_small", "folder_broken"} and sum(r.error is None for r in cut) == 4


def test_georeferenced_pairs_keep_their_place_and_draw_roads(spark, tmp_path):
    image, _ = road(64, 64)
    (tmp_path / "img1.tif").write_bytes(tiff.encode(tiff.Raster(image.transpose(2, 0, 1), PLACE, 32643)))
    (tmp_path / "img2.tif").write_bytes(tiff.encode(tiff.Raster(image.transpose(2, 0, 1), (0.5, 0.0, 0.0, 0.0, -0.5, 99.0), 32643)))
    lines = {"features": [{"geometry": {"type": "MultiLineString", "coordinates": [[[785000, 1436990], [785032, 1436990]], [[785010, 1436970], [785010, 1437000]]]}}, {"geometry": {"type": "Point", "coordinates": [1, 2]}},
                          {"geometry": {"type": "LineString", "coordinates": [[785000, 1436980], [785020, 1436980], [785032, 1436980]]}}]}
    (tmp_path / "roads.geojson").write_text(json.dumps(lines))
    segments = tables.road_segments(spark, str(tmp_path / "roads.geojson"))
    assert sorted(r.seg_id for r in segments.collect()) == ["0_0", "0_1_0", "2_0", "2_1"]
    images = tiff.read(spark, str(tmp_path)).withColumn("pair_id", S.chip_id(F.col("path")))
    found = ingest.segments_by_footprint(images, segments)
    assert {(r.pair_id, r.seg_id) for r in found.collect()} == {("img1", s) for s in ("0_0", "0_1_0", "2_0", "2_1")}
    cut = {r.tile_id: r for r in ingest.tiles(ingest.rasterised_pairs(images, found), "geotiff-osm", {**CONFIG, "min_road_frac": 0.0}).collect()}
    assert cut["geotiff-osm_img2_r00000_c00000"].road_frac == 0
    tile = cut["geotiff-osm_img1_r00000_c00000"]
    assert tile.transform == list(PLACE) and tile.epsg == 32643 and tile.road_frac > 0.2
    assert tiff.decode(tile.mask).transform == PLACE and ingest.manifest(spark.createDataFrame([tile], ingest.TILES), "s", "t", "/x", 64).first().crs == "EPSG:32643"


def test_windows_of_a_tile_move_its_origin(spark, tmp_path):
    image, mask = road(96, 64)
    for name, a in (("i", image.transpose(2, 0, 1)), ("m", mask[None])):
        (tmp_path / f"{name}.tif").write_bytes(tiff.encode(tiff.Raster(a, PLACE, 32643)))
    raster = tiff.read(spark, str(tmp_path))
    pairs = spark.createDataFrame([("p", raster.where(F.col("path").endswith("i.tif")).first().path, raster.where(F.col("path").endswith("m.tif")).first().path)], "pair_id string, image_path string, mask_path string")
    cut = ingest.tiles(ingest.load_pairs(pairs, raster, raster), "s", CONFIG).orderBy("tile_id").collect()
    assert [r.transform[5] for r in cut] == [1437000.0, 1436984.0]


# ------------------------------------------------------------------------------------------------------- prediction


def test_prediction_reflects_small_images_and_blends_large_ones():
    image = np.arange(3 * 40 * 50, dtype=np.uint32).reshape(3, 40, 50).astype(np.uint8)
    seen = []
    P.predict(image, lambda x: seen.append(x) or flat(x), 64)
    assert seen[0].shape == (1, 3, 64, 64)
    back = (seen[0][0] * P.STD[:, None, None] + P.MEAN[:, None, None]) * 255
    assert np.allclose(back[:, 40], image[:, 38, list(range(50)) + list(range(48, 34, -1))], atol=0.01)  # the border itself isn't repeated
    assert np.allclose(P.predict(np.zeros((3, 5, 7), np.uint8), flat, 64), 0.5)  # a border wider than the image
    large = P.predict(np.zeros((3, 150, 130), np.uint8), left, 64, 0.25)
    assert large.shape == (150, 130) and large[:, :20].min() > 0.99 and large[:, -20:].max() < 0.01
    assert np.allclose(P.predict(np.zeros((3, 150, 130), np.uint8), flat, 64, 0.25, views=True), 0.5)


def test_views_are_turned_back_and_scales_resized():
    sizes = []
    p = P.probabilities(lambda x: sizes.append(x.shape[2:]) or left(x), np.zeros((3, 64, 96), np.float32), P.SCALES, True)
    assert set(sizes) == {(64, 64), (64, 96), (64, 128)} and len(sizes) == 9  # sides in multiples of 32, halves to even
    # left half, right half (flipped back) and left half again: two thirds against one
    assert abs(p[0, 0] - 2 / 3) < 0.02 and abs(p[0, -1] - 1 / 3) < 0.02
    a = np.random.default_rng(0).random((3, 10, 12))
    assert (P.resized(a, 10, 12) == a).all() and np.allclose(P.resized(np.ones((4, 4)), 9, 7), 1) and np.allclose(P.resized(a, 20, 24).mean(), a.mean(), atol=0.01)


def test_augmentation_keeps_image_and_mask_together():
    image, mask = road(32, 32)
    mask[3, 5] = 255
    image = np.repeat(mask[None], 3, 0)
    for seed in range(12):
        i, m = P.augmented(image, mask, seed)
        assert ((i[0] > 100) == (m > 0)).all() and m.sum() == mask.sum()


def test_prediction_files_and_rasters_with_too_few_bands(spark, tmp_path):
    image, _ = road(70, 80)
    four = np.concatenate((np.zeros((1, 70, 80), np.uint8), image.transpose(2, 0, 1)))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.tif").write_bytes(tiff.encode(tiff.Raster(four, PLACE, 32643)))
    (tmp_path / "in" / "b.tif").write_bytes(tiff.encode(tiff.Raster(four[:2], PLACE, 32643)))
    found = P.predict_rasters(tiff.read(spark, str(tmp_path / "in")), bright, 64, bands=(2, 3, 4))
    rows = {r.tile_id.rsplit("/", 1)[-1]: r for r in found.collect()}
    assert rows["b.tif"].p is None and "bands" in rows["b.tif"].error and rows["a.tif"].error is None
    tiff.save(P.prediction_files(found, 0.5, True), str(tmp_path / "out"))
    mask, prob = (tiff.decode((tmp_path / "out" / n).read_bytes()) for n in ("a.tif", "a_prob.tif"))
    assert mask.data.dtype == np.uint8 and prob.data.dtype == np.float32 and mask.transform == PLACE and mask.epsg == 32643
    assert (mask.data == (prob.data > 0.5)).all() and sorted(p.name for p in (tmp_path / "out").iterdir()) == ["a.tif", "a_prob.tif"]
    assert P.predicted_cells(found).count() == int(mask.data.sum())


# ------------------------------------------------------------------------------------------------------- evaluation


def test_evaluation_of_a_perfect_and_a_blind_model(spark, tmp_path):
    (tmp_path / "m").mkdir()
    (tmp_path / "i").mkdir()
    rows = []
    for k, terrain in enumerate(("a", "a", "b")):
        _, mask = road(64, 64)
        image = np.repeat(mask[None], 3, 0)
        at = []
        for folder, a in (("m", mask[None]), ("i", image)):
            p = tmp_path / folder / f"{k}.tif"
            p.write_bytes(tiff.encode(tiff.Raster(a)))
            at.append("file:" + str(p))
        rows.append((f"t{k}", terrain, at[0], at[1], "test" if k else "val"))
    manifest = spark.createDataFrame(rows, "tile_id string, terrain string, mask_path string, image_path string, split string")
    masks, images = tiff.read(spark, str(tmp_path / "m")), tiff.read(spark, str(tmp_path / "i"))
    good = E.evaluate(spark, manifest, masks, images, bright, 64, "test", folder=str(tmp_path / "out"), apls=True).collect()
    assert len(good) == 3 and {r.terrain for r in good} == {None, "a", "b"}
    for r in good:
        assert r.iou > 0.999 and r.cldice > 0.999 and r.connectivity_ratio == 1 and r.apls == 1 and 0 <= r.occlusion_recall <= 1
    assert [r.n_tiles for r in good if r.overall] == [2] and "all" in E.as_text(good)
    blind = E.evaluate(spark, manifest, masks, None, lambda x: np.full((len(x), *x.shape[2:]), -9.0), 64, None, dry_run=True).where("overall").first()
    assert blind.n_tiles == 3 and blind.iou == 0 and blind.recall == 0 and blind.cldice == 0 and blind.connectivity_ratio == 0 and blind.occlusion_recall == 0
    both = spark.createDataFrame([("x", True, 0.5, 0.4), ("y", True, 0.7, 0.2)], "model string, overall boolean, iou double, recall double")
    assert {(r.model, round(r.iou_below_best, 6), round(r.recall_below_best, 6)) for r in E.compared(both).collect()} == {("x", -0.2, 0.0), ("y", 0.0, -0.2)}


# -------------------------------------------------------------------------------------------------- graphs and hazards


def test_path_similarity_of_equal_cut_and_missing_graphs(spark):
    nodes = spark.createDataFrame([("g", i, 10.0 * i, 0.0) for i in range(3)], NODES)
    edges = spark.createDataFrame([("g", 0, 1, 10.0), ("g", 1, 2, 10.0)], EDGES)
    score = lambda b: G.apls((nodes, edges), b, 1.0).first().apls
    assert score((nodes, edges)) == 1
    assert 0 < score((nodes, edges.where("src = 0"))) < 1
    assert score((nodes.where("x > 99"), edges.where("src > 9"))) == 0


def test_fused_tile_reports_equal_the_operators(spark):
    rng = np.random.default_rng(4)
    cells = set()
    for t in range(3):
        for _ in range(6):
            r, c = rng.integers(2, 30, 2)
            cells |= {(f"t{t}", int(r), int(x)) for x in range(2, 30) if abs(x - c) > 2} | {(f"t{t}", int(y), int(c)) for y in range(3, 25)}
    table = spark.createDataFrame(sorted(cells), "tile_id string, row int, col int")
    fused = {r.graph_id: r for r in pipeline.tile_reports(table, 32).collect()}
    nodes, edges, bridges = pipeline.healed_graph(table, 32, max_gap=12.0)
    worst = G.critical(G.betweenness(nodes, edges), 5)
    center = worst.where("rank = 1").join(nodes, ["graph_id", "node_id"]).select("graph_id", F.col("x").alias("cx"), F.col("y").alias("cy"))
    apart = {r.graph_id: r for r in pipeline.tile_reports(table, 32, hazard=H.RadiusHazard(center, 5.0)).collect()}
    assert set(fused) == set(apart) == {"t0", "t1", "t2"}
    for k, a in apart.items():
        f = fused[k]
        assert (f.n_nodes, f.n_impacted, f.components_after, f.n_bridges, f.critical_nodes, f.empty) == (a.n_nodes, a.n_impacted, a.components_after, a.n_bridges, a.critical_nodes, a.empty)
        assert f.resilience_index == pytest.approx(a.resilience_index) and f.lcc_after == pytest.approx(a.lcc_after)
    mean = pipeline.healing_ablation(table, 32).first()
    assert mean.n_tiles == 3 and mean.after <= mean.before
    n, e = pipeline.tile_graph(table, 32, (1, 0, 785000, 0, -1, 1437000), 1.0, 32643)
    assert {"lon", "lat"} <= set(n.columns) and 70 < n.first().lon < 80 and "healed" in e.columns
    assert pipeline.attack_ablation(nodes, edges, 2).first().n_graphs == 3


def test_graphs_are_cut_into_no_more_slices_than_partitions(spark):
    n = spark.range(1000).select(F.lit("g").alias("graph_id"), F.col("id").alias("node_id"), F.col("id").cast("double").alias("x"), F.lit(0.0).alias("y"))
    e = spark.range(999).select(F.lit("g").alias("graph_id"), F.col("id").alias("src"), (F.col("id") + 1).alias("dst"), F.lit(1.0).alias("length"))
    rows = G._sources(n, e, None).collect()
    assert len(rows) <= int(spark.conf.get("spark.sql.shuffle.partitions")) and sorted(x for r in rows for x in r.sources) == list(range(1000))
    assert G.shortest_distances(n, e, n.where("node_id = 0")).agg(F.max("distance")).first()[0] == 999


def test_a_graph_beyond_the_bound_is_refused(spark, monkeypatch):
    monkeypatch.setattr(G, "MOST_NODES", 3)
    n = spark.createDataFrame([("g", i, 0.0, 0.0) for i in range(5)], NODES)
    e = spark.createDataFrame([("g", 0, 1, 1.0)], EDGES)
    with pytest.raises(Exception, match="more than 3 nodes"):
        G.components(n, e).collect()
    assert G.has_large(n, 4) and not G.has_large(n, 5) and {r.component for r in G.components(n, e, large=True).collect()} == {0, 2, 3, 4}


def test_pairs_meet_once_with_and_without_salts(spark):
    rng = np.random.default_rng(1)
    at = rng.uniform(-30, 30, (120, 2))
    at[5] = at[6]
    n = spark.createDataFrame([("g", i, float(x), float(y)) for i, (x, y) in enumerate(at)], NODES)
    want = {(i, j) for i in range(120) for j in range(i + 1, 120) if ((at[i] - at[j]) ** 2).sum() <= 49}
    for salts in (1, 4):
        rows = [(r.a, r.b) for r in G.pairs_within(n, 7.0, salts=salts).collect()]
        assert len(rows) == len(set(rows)) and set(rows) == want
    assert {(a, b) for _, a, b in K.near_pairs(dict(enumerate(map(tuple, at))), 7.0)} == want


def test_routes_have_places_and_are_drawn(spark):
    n = spark.createDataFrame([("g", i, float(i), 0.0) for i in range(4)], NODES)
    e = spark.createDataFrame([("g", 0, 1, 1.0), ("g", 1, 2, 1.0), ("g", 2, 3, 1.0), ("g", 0, 3, 9.0)], EDGES)
    trips = spark.createDataFrame([("g", 0, 3)], "graph_id string, source long, target long")
    routes = G.route_places(G.reroute(n, e, trips, n.where("node_id = 1")), n)
    r = routes.first()
    assert [p.x for p in r.places_before] == [0, 1, 2, 3] and [p.x for p in r.places_after] == [0, 3] and (r.before, r.after, r.ratio) == (3, 9, 3)
    layers = pipeline.map_layers(n, e.withColumn("healed", F.col("src") == 0), G.betweenness(n, e), n.where("node_id = 1"), routes, spark.createDataFrame([("g", 1.0, 0.0)], "graph_id string, cx double, cy double"), 0.5)
    assert {r.layer: r["count"] for r in layers.groupBy("layer").count().collect()} == {"healed": 2, "road": 2, "node": 3, "impacted": 1, "hazard": 1, "route_before": 1, "route_after": 1}


def test_resilience_report_samples_sources(spark):
    n = spark.createDataFrame([("g", i, float(i), 0.0) for i in range(9)], NODES)
    e = spark.createDataFrame([("g", i, i + 1, 1.0) for i in range(8)], EDGES)
    whole = resilience.report(n, e, n.where("node_id = 4")).first()
    some = resilience.report(n, e, n.where("node_id = 4"), 8).first()
    assert whole.components_after == 2 and whole.n_impacted == 1 and 0 < whole.resilience_index < 1 and abs(some.resilience_index - whole.resilience_index) < 0.3


def test_raster_hazard_of_a_file_in_other_coordinates(spark, tmp_path):
    from arterial.functions.geodesy import from_utm

    depth = np.array([[0, 0, 0.8], [0, -9999, 0.8]], np.float32)
    (tmp_path / "d.tif").write_bytes(tiff.encode(tiff.Raster(np.stack((depth * 0, depth)), (10.0, 0.0, 785000.0, 0.0, -10.0, 1437000.0), 32643, -9999.0)))
    places = [(0, 5, -5), (1, 25, -5), (2, 25, -15), (3, 15, -15), (4, 500, -5)]
    utm = spark.createDataFrame([("g", i, 785000.0 + x, 1437000.0 + y) for i, x, y in places], NODES)
    lonlat = spark.createDataFrame([("g", i, *map(float, from_utm(785000.0 + x, 1437000.0 + y, 32643))) for i, x, y in places], NODES)
    for nodes, code in ((utm, None), (utm, 32643), (lonlat, 4326)):
        (hazard,) = H.raster_hazards(spark, str(tmp_path), threshold=0.3, band=2, node_epsg=code)
        assert {r.node_id for r in hazard.impacted(nodes).collect()} == {1, 2}
    assert set(H.HAZARDS) == {"nodes", "radius", "band", "raster"}


# ------------------------------------------------------------------------------------------------ filters and streams


def test_split_equals_one_window_over_each_stratum(spark):
    from pyspark.sql.window import Window

    m = spark.range(5000).select(F.col("id").cast("string").alias("tile_id"), F.when(F.col("id") % 10 > 0, "a").when(F.col("id") % 20 > 0, "b").alias("terrain"))
    w = Window.partitionBy("terrain")
    k = F.row_number().over(w.orderBy(F.md5(F.concat_ws("|", F.lit("42"), "tile_id")), "tile_id"))
    a, b = F.bround(F.count("*").over(w) * 0.7), F.bround(F.count("*").over(w) * 0.15)
    want = m.withColumns({"k": k, "a": a, "b": b}).withColumn("split", F.when(F.col("terrain").isNull(), "").when(F.col("k") <= F.col("a"), "train").when(F.col("k") <= F.col("a") + F.col("b"), "val").otherwise("test"))
    assert T.split(m).select("tile_id", "split").exceptAll(want.select("tile_id", "split")).count() == 0 and T.split(m).count() == 5000
    assert {r.split for r in T.of_split(T.split(m), "val").collect()} == {"val"} and T.terrains(m).count() == 3


@pytest.mark.parametrize("kind", ["few", "float", "flat", "one"])
def test_percentiles_equal_sorting(spark, kind):
    rng = np.random.default_rng(2)
    v = {"few": rng.integers(0, 9, 501), "float": rng.normal(0, 5, 777), "flat": np.full(40, 7.0), "one": np.array([3.0])}[kind].astype(float)
    rows = spark.createDataFrame([("k", float(x)) for x in v] + [("k", None), ("k", float("nan")), ("j", 1.0), ("j", 2.0)], "band string, v double")
    got = {r.band: r.q for r in R.percentiles(rows, ["band"], [0.02, 0.5, 0.98, 1.0]).collect()}
    assert got["k"] == pytest.approx(np.percentile(v, [2, 50, 98, 100]).tolist()) and got["j"] == pytest.approx([1.02, 1.5, 1.98, 2.0])


def test_losses_by_name(spark):
    t = spark.createDataFrame([("t", r, c, float(r == 2)) for r in range(5) for c in range(5)], "tile_id string, row int, col int, v double")
    none = t.withColumn("v", F.lit(0.0))
    for name in R.LOSSES:
        assert R.loss(name, t, t).first().loss < 0.05 < 0.3 < R.loss(name, t, none).first().loss
    with pytest.raises(ValueError):
        R.loss("other", t, t)
    mixed = R.dice_cldice(t, none, 0.25).first()
    assert mixed.loss == pytest.approx(0.75 * mixed.dice_loss + 0.25 * mixed.cldice_loss)


def test_occluders_follow_weights_and_size():
    _, mask = road(256, 256)
    img = np.full((256, 256, 3), 100, np.uint8)
    only = O.occlude(img, mask, weights=(0, 0, 0, 1), prob=1.0, coverage=(0.5, 0.5), most=20, seed=1)
    assert only[4]["vehicle"] == sum(only[4].values()) > 0
    assert O.occlusion_options({"types": ["cloud"], "apply_prob": 0.2, "other": 1}) == {"kinds": ("cloud",), "prob": 0.2}
    with pytest.raises(ValueError):
        O.occlude(img, mask, kinds=("fog",), prob=1.0)
    with pytest.raises(ValueError):
        O.occlude(img[..., 0], mask)
    share = lambda n: O.occlude(np.zeros((n, n, 3), np.uint8), np.full((n, n), 1), ("tree_canopy",), (0.9, 0.9), 1.0, 1, 3)[1].sum()
    assert share(800) > 4 * share(200)


def test_clicks_and_their_reset(spark):
    c = spark.createDataFrame([("s", "flood", 1.0, 0.0, 1), ("s", "source", 2.0, 0.0, 2), ("s", "reset", 0.0, 0.0, 3), ("s", "source", 4.0, 0.0, 4), ("t", "target", 5.0, 0.0, 1)], "session string, mode string, x double, y double, at long")
    got = {(r.session, r.mode): r.place and r.place.x for r in running.last_clicks(c).collect()}
    assert got == {("s", "flood"): None, ("s", "source"): 4.0, ("t", "target"): 5.0}


def test_manifest_upsert_splits_anew_and_drops_old_versions(spark, tmp_path):
    schema = "tile_id string, terrain string, split string"
    for k in range(4):
        spark.createDataFrame([(f"t{i}", "a", "") for i in range(k * 5, k * 5 + 8)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        running.upsert_manifest(stream, str(tmp_path / "out"), str(tmp_path / "ck"), resplit=True).awaitTermination()
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["v2", "v3"]
    last = spark.read.parquet(str(tmp_path / "out" / "v3"))
    assert last.count() == 23 and {r["split"]: r["count"] for r in last.groupBy("split").count().collect()} == {"train": 16, "val": 3, "test": 4}


def test_reports_configuration_and_places(spark, tmp_path):
    tables.write_reports(spark.createDataFrame([("a", 1.0)], "model string, iou double"), str(tmp_path / "r"))
    assert tables.read_reports(spark, str(tmp_path / "r")).first().iou == 1.0
    (tmp_path / "p.yaml").write_text("places:\n- {name: X, terrain: t, point: [1.5, 2.5], dist_m: 300}\n- {name: Y, query: Somewhere}\n")
    assert [(r.place, r.lat, r.radius_m, r.query) for r in tables.places(spark, str(tmp_path / "p.yaml")).collect()] == [("X", 1.5, 300.0, None), ("Y", None, None, "Somewhere")]
    tables.save_config({"a": {"b": 1}}, str(tmp_path / "c.yaml"))
    assert tables.load_config(str(tmp_path / "c.yaml"), overrides=["a.c=[1, 2]"]) == {"a": {"b": 1, "c": [1, 2]}}
    assert tables.markdown([{"x": None, "y": 0.5}], ["x", "y"]).splitlines()[-1] == "| – | 0.500 |"


def test_command_line(spark, tmp_path):
    data, masks, out = tmp_path / "data", tmp_path / "out" / "masks", str(tmp_path / "out")
    data.mkdir()
    write_deepglobe(data)
    (tmp_path / "c.yaml").write_text("data: {tile_size: 64, overlap: 0.0, min_road_frac: 0.001}\n")
    run = lambda *a: cli.main([a[0], "--config", str(tmp_path / "c.yaml"), *a[1:]], spark)
    run("ingest", "--source", "deepglobe", "--root", str(data), "--out", out)
    assert tables.read_manifest(spark, f"{out}/manifest").count() == 8 and len(list(masks.iterdir())) == 8
    run("graph", "--masks", str(masks), "--out", str(tmp_path / "g"))
    assert tables.read_graphml(spark, str(tmp_path / "g"))[0].count() == 16
    run("run", "--masks", str(masks), "--out", str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).count() == 8
    run("predict", "--images", f"{out}/images", "--model", "tests.test_plans:bright", "--window", "64", "--out", str(tmp_path / "p"))
    assert len(list((tmp_path / "p").iterdir())) == 8
    run("evaluate", "--manifest", f"{out}/manifest", "--model", "tests.test_plans:bright", "--split", "train", "--out", str(tmp_path / "e"))
    assert tables.read_reports(spark, str(tmp_path / "e" / "report")).where("overall").count() == 1
    run("ablations", "--masks", str(masks), "--out", str(tmp_path / "a"))
    lines = {"features": [{"geometry": {"type": "LineString", "coordinates": [[0, 10], [100, 10]]}}]}
    (tmp_path / "l.geojson").write_text(json.dumps(lines))
    run("build", "--segments", str(tmp_path / "l.geojson"), "--bounds", "0", "0", "100", "64", "--set", "data.resolution_m=1.0", "--out", str(tmp_path / "b"))
    assert tables.read_manifest(spark, str(tmp_path / "b" / "manifest")).count() == 2
    with pytest.raises(SystemExit):
        run("ingest", "--source", "other", "--out", out)


# --------------------------------------------------------------------------------------- graphs of many edges, empty masks


def dense_places(folder):
    """A table of places: 90 of label 0 lie close, with 27 times as many pairs as nodes; labels 1 to 3 are sparse."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    rng = np.random.default_rng(5)
    at = np.concatenate((rng.normal(0, 0.03, (90, 2)), [[0.15, 0.05], [0.15, 0.085], [-0.15, 0.0], [-0.15, -0.035]], rng.normal(0, 0.12, (120, 2))))
    label = [0] * 94 + [1 + k % 3 for k in range(120)]
    order = rng.permutation(len(at))
    pq.write_table(pa.table({"vec_id": pa.array(np.arange(len(at))), "embedding": pa.array(at[order].tolist(), pa.list_(pa.float32())), "label": pa.array([label[i] for i in order])}), f"{folder}/embeddings.parquet")


def same_as_sql(spark, folder, name):
    """The query's rows and its SQL's, in one order."""
    import duckdb

    import __spark_entry__ as entry

    con = duckdb.connect()
    for file in folder.glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    df = entry.queries()[name](spark, str(folder))
    con.execute(entry.oracle_sql()[name])
    at = [[c[0] for c in con.description].index(c) for c in df.columns]
    order = lambda rows: sorted(rows, key=lambda r: [str(x) for x in r])
    got, want = order(tuple(r) for r in df.collect()), order(tuple(r[i] for i in at) for r in con.fetchall())
    assert got == want
    return got


@pytest.mark.parametrize("name", ["graph_components", "heal_bridges", "heal_lengths", "largest_component", "graph_stats", "heal_candidates", "heal_summary"])
def test_graphs_of_many_edges_equal_their_sql(spark, tmp_path, monkeypatch, name):
    monkeypatch.setattr(G, "MOST_NODES", 200)  # far fewer than the edges of label 0
    dense_places(tmp_path)
    assert len(same_as_sql(spark, tmp_path, name)) >= 2


def test_damage_of_a_graph_of_many_edges_cuts_what_the_whole_graph_would(spark, monkeypatch):
    monkeypatch.setattr(G, "MOST_NODES", 200)
    rng = np.random.default_rng(8)
    # dense knots, chains between them, and edges there twice, of which only the shorter counts
    edges = [(50 * k + int(a), 50 * k + int(b), 30.0) for k in range(2) for a, b in rng.integers(0, 30, (400, 2))]
    edges += [(k, k + 1, 10.0 + k % 40) for k in (*range(29, 50), *range(79, 95))] + [(40, 41, 90.0), (42, 41, 5.0), (85, 85, 1.0), (94, 96, 99.0)]
    n = spark.createDataFrame([("g", i, 0.0, 0.0) for i in range(97)], NODES)
    e = spark.createDataFrame([("g", *x) for x in edges], EDGES).repartition(4)
    whole = K.adjacency(edges, range(97))
    cut = {x for x in K.bridges(whole) if whole[x[0]][x[1]] <= 40.0}
    assert len(cut) > 20
    _, left = G.damage(n, e, 40.0, 1000)
    assert {(min(r.src, r.dst), max(r.src, r.dst)) for r in left.collect()} == {(min(x[:2]), max(x[:2])) for x in edges} - cut


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_damage_looks_for_cut_edges_once_and_shuffles_few_edges(spark):
    n, e = spark.createDataFrame([("g", i, 0.0, 0.0) for i in range(4)], NODES), spark.createDataFrame([("g", 0, 1, 9.0), ("g", 1, 2, 9.0), ("g", 1, 2, 8.0)], EDGES)
    kept, left = G.damage(n, e, 40.0, 1)
    # each use of what is left searched all edges anew
    assert not any("MapIn" in executed(df) for df in (kept, left))
    assert left.count() in (1, 2) and kept.count() == 2
    # all edges were summed by their ends, so all went through a shuffle
    assert "Aggregate" not in executed(G.thinned(e, 2))


def arrow_edges(rows, size):
    import pyarrow as pa

    kinds = [pa.string(), pa.int64(), pa.int64(), pa.float64()]
    for k in range(0, len(rows), size):
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows[k : k + size]], kind) for i, kind in enumerate(kinds)], ["graph_id", "src", "dst", "length"])


def thin(rows, size, forests):
    return [tuple(r.values()) for b in G._thinned(arrow_edges(rows, size), forests) for r in b.to_pylist()]


@pytest.mark.parametrize("forests", [1, 2])
def test_thinned_edges_hold_a_graph_as_all_do(forests):
    rng = np.random.default_rng(3)
    cuts = 0
    for _ in range(60):
        n = int(rng.integers(2, 30))
        rows = [("g", int(a), int(b), float(w)) for a, b, w in rng.integers(0, n, (int(rng.integers(0, 60)), 3))]
        rows += [("g", int(a), int(b), float(w)) for a, b, w in rng.integers(0, n // 2 + 1, (int(rng.integers(0, 120)), 3))]
        rows = [rows[i] for i in rng.permutation(len(rows))] + [("other", 0, 1, 1.0)]
        some = [r for k in range(3) for r in thin(rows[k::3], 9, forests)]
        got = [r[1:] for r in thin(some, 7, forests) if r[0] == "g"]
        edges = [r[1:] for r in rows if r[0] == "g"]
        assert len(got) <= forests * (n - 1) and K.labels(range(n), got) == K.labels(range(n), edges)
        if forests == 2:
            want = K.adjacency(edges)
            cuts += len(K.bridges(want))
            left = K.adjacency(got)
            assert [(e, left[e[0]][e[1]]) for e in K.bridges(left)] == [(e, want[e[0]][e[1]]) for e in K.bridges(want)]
    assert forests == 1 or cuts > 60


@pytest.mark.parametrize("forests", [1, 2])
def test_edges_within_a_tree_go_without_a_loop(forests, monkeypatch):
    calls = []
    link = K.Sets.link
    monkeypatch.setattr(K.Sets, "link", lambda self, a, b: calls.append(a) or link(self, a, b))
    rows = [("g", int(a), int(b), 1.0) for a, b in np.random.default_rng(4).integers(0, 40, (20_000, 2))]
    assert len(thin(rows, 500, forests)) == 39 * forests
    assert len(calls) < 3_000  # 20,000 at least before


def events(folder, kinds):
    """Events of types whose masks are empty ("flat"), or set in the truth or the prediction alone."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    rows = []
    for name, kind in kinds.items():
        for user in range(32):
            # a cell holds a quarter more events than the mean or is empty; the prediction's rows move by event_id % 2
            for slot in range(32):
                n = {"flat": 2, "both": 6 if user < 4 else 1, "truth": 3 if user % 4 < 2 else 1, "pred": 2}[kind]
                for k in range(n):
                    odd = k % 2 if kind != "pred" else int(user % 4 >= 2)
                    if kind == "truth":
                        odd = int(user % 4 == 0) if k else 0
                    rows.append((len(rows) * 2 + odd, 45 * 60 * slot, user, name))
    t = pa.table({"event_id": pa.array([r[0] for r in rows]), "ts": pa.array([1_700_006_400_000_000 + r[1] * 1_000_000 for r in rows], pa.timestamp("us")), "user_id": pa.array([r[2] for r in rows]), "event_type": pa.array([r[3] for r in rows])})
    pq.write_table(t, f"{folder}/events.parquet")


@pytest.mark.parametrize("kinds", [{"a": "flat", "bb": "flat"}, {"a": "flat", "bb": "pred", "ccc": "both"}, {"a": "truth", "bb": "both", "cccc": "pred"}])
@pytest.mark.parametrize("name", ["eval_by_terrain", "evaluation_report"])
def test_reports_of_empty_masks_equal_their_sql(spark, tmp_path, name, kinds):
    events(tmp_path, kinds)
    rows = same_as_sql(spark, tmp_path, name)
    assert sum(r[0] is None for r in rows) == 1
