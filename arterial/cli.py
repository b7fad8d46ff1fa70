"""Command line: python -m arterial.cli COMMAND ... Each command is a thin call of a plan."""

from __future__ import annotations

import argparse
import importlib


def _common(p: argparse.ArgumentParser) -> None:
    p.add_argument("--config", action="append", default=[], help="YAML files, merged from left to right")
    p.add_argument("--set", action="append", default=[], metavar="KEY.PATH=VALUE")
    p.add_argument("--master")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="arterial")
    sub = top.add_subparsers(dest="command", required=True)

    def command(name, text, *arguments):
        p = sub.add_parser(name, help=text)
        _common(p)
        for flags, options in arguments:
            p.add_argument(*flags, **options)

    out = (["--out"], {"required": True})
    masks = (["--masks"], {"required": True, "help": "folder of mask GeoTIFFs"})
    gap = (["--max-gap"], {"type": float, "default": 40.0})
    command("build", "tiles of places from a road table", (["--segments"], {"required": True, "help": "GeoJSON files"}), (["--bounds"], {"required": True, "type": float, "nargs": 4}), (["--place"], {"default": "place"}), out)
    command("ingest", "tiles and manifest of a dataset", (["--source"], {"required": True}), (["--root"], {}), (["--images"], {}), (["--masks"], {}), (["--terrain"], {"default": "unknown"}), (["--gsd"], {"type": float}),
            (["--limit"], {"type": int}), (["--append"], {"help": "manifest to append to"}), out)
    command("graph", "graphs of masks as GraphML", masks, (["--no-heal"], {"action": "store_true"}), gap, out)
    command("run", "masks to resilience reports", masks, (["--no-heal"], {"action": "store_true"}), gap, (["--top"], {"type": int, "default": 10}), (["--radius"], {"type": float, "default": 40.0}), out)
    command("predict", "prediction rasters of images", (["--images"], {"required": True}), (["--model"], {"required": True, "help": "module:function"}), (["--window"], {"type": int, "default": 512}),
            (["--overlap"], {"type": float, "default": 0.25}), (["--threshold"], {"type": float, "default": 0.5}), (["--bands"], {"type": int, "nargs": 3, "default": [1, 2, 3]}), (["--tta"], {"action": "store_true"}),
            (["--probabilities"], {"action": "store_true"}), out)
    command("evaluate", "measures of a model on a split", (["--manifest"], {"required": True}), (["--model"], {"required": True}), (["--split"], {"default": "test"}), (["--apls"], {"action": "store_true"}),
            (["--tta"], {"action": "store_true"}), (["--dry-run"], {"action": "store_true"}), (["--max-tiles"], {"type": int}), out)
    command("ablations", "healing and attack ablations", masks, gap, (["--k"], {"type": int, "default": 5}), out)
    return top


def _model(name: str):
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def _masks(spark, folder):
    from arterial.sources import tiff

    rasters = tiff.read(spark, folder)
    head = rasters.where("error is null").select("width", "transform").first()
    if head is None:
        raise SystemExit(f"no mask under {folder}")
    t = tuple(head["transform"]) if head["transform"] else None
    return tiff.cells(rasters), head["width"], t, abs(t[0]) if t else 1.0


def build(spark, a, config):
    from pyspark.sql import functions as F

    from arterial.operators import tiles as T
    from arterial.sources import tables

    d = {"tile_size": 512, "resolution_m": 0.5, "overlap": 0.25, "road_buffer_m": 4.0, **config.get("data", {})}
    place = spark.createDataFrame([(a.place, *a.bounds)], "place string, west double, south double, east double, north double")
    grid = T.tile_grid(place, d["tile_size"], d["resolution_m"], d["overlap"])
    cells = T.rasterise(grid, tables.road_segments(spark, a.segments).drop("place"), d["road_buffer_m"])
    cells.write.mode("overwrite").parquet(f"{a.out}/cells")
    share = spark.read.parquet(f"{a.out}/cells").groupBy("tile_id").agg((F.count("*") / F.lit(d["tile_size"] ** 2)).alias("road_frac"))
    rows = T.dense_enough(grid.join(share, "tile_id"), d.get("min_road_frac", 0.004)).withColumn("terrain", F.lit(a.place))
    tables.write_manifest(T.split(rows), f"{a.out}/manifest")


def ingest(spark, a, config):
    from arterial.plans import ingest as plan
    from arterial.sources import tables, tiff

    files = lambda root: tables.files(spark, root)
    dense = lambda root: tables.images(spark, root)
    if a.source == "deepglobe":
        pairs = plan.load_pairs(tables.deepglobe_pairs(files(a.root)), dense(a.root), dense(a.root))
    elif a.source == "massachusetts":
        raster = tiff.read(spark, a.root)
        pairs = plan.load_pairs(tables.labelled_folder_pairs(files(a.root)), raster, raster)
    elif a.source in ("folder", "opensatmap"):
        pairs = plan.load_pairs(tables.folder_pairs(files(a.images), files(a.masks)), dense(a.images), dense(a.masks))
    elif a.source in ("spacenet", "geotiff-osm", "cartosat"):
        from arterial.functions.scalars import chip_id
        from pyspark.sql import functions as F

        raster = tiff.read(spark, a.images or a.root).withColumn("pair_id", chip_id(F.col("path")))
        lines = tables.road_segments(spark, a.masks or a.root)
        lines = lines.withColumn("pair_id", chip_id(F.col("place"))) if a.source == "spacenet" else plan.segments_by_footprint(raster, lines)
        pairs = plan.rasterised_pairs(raster, lines)
    else:
        raise SystemExit(f"unknown source: {a.source!r}")
    rows = plan.ingest(spark, pairs, a.source, a.terrain, a.out, config.get("data", {}), a.gsd, a.limit)
    if a.append:
        rows = plan.append(tables.read_manifest(spark, a.append), rows)
    tables.write_manifest(rows, f"{a.out}/manifest")


def graph(spark, a, config):
    from pyspark.sql import functions as F

    from arterial.plans.pipeline import tile_graph
    from arterial.sources.tables import graphml
    from arterial.sources.tiff import save

    cells, width, t, resolution = _masks(spark, a.masks)
    nodes, edges = tile_graph(cells, width, t, resolution, None, not a.no_heal, a.max_gap)
    n = nodes.groupBy("graph_id").agg(F.collect_list(F.struct("node_id", "x", "y")).alias("n"))
    e = edges.groupBy("graph_id").agg(F.collect_list(F.struct("src", "dst", "length", "healed")).alias("e"))

    def written(batches):
        import pandas as pd

        for pdf in batches:
            rows = [(r.graph_id.rsplit("/", 1)[-1].rsplit(".", 1)[0] + ".graphml", graphml(r.n, r.e if r.e is not None else []).encode()) for r in pdf.itertuples()]
            yield pd.DataFrame(rows, columns=["name", "content"])

    save(n.join(e, "graph_id", "left").mapInPandas(written, "name string, content binary"), a.out)


def run(spark, a, config):
    from arterial.plans.pipeline import as_json, tile_reports

    cells, width, t, resolution = _masks(spark, a.masks)
    as_json(tile_reports(cells, width, t, resolution, not a.no_heal, a.max_gap, a.radius, a.top)).write.mode("overwrite").json(a.out)


def predict(spark, a, config):
    from arterial.plans import predict as plan
    from arterial.sources import tiff

    found = plan.predict_rasters(tiff.read(spark, a.images, recursive=False), _model(a.model), a.window, a.overlap, a.tta, bands=a.bands)
    tiff.save(plan.prediction_files(found, a.threshold, a.probabilities), a.out)


def evaluate(spark, a, config):
    from arterial.plans import evaluate as plan
    from arterial.sources import tables, tiff

    rows = tables.read_manifest(spark, a.manifest)
    folder = lambda c: sorted({r[0].rsplit("/", 1)[0] for r in rows.where(f"{c} <> ''").selectExpr(f"regexp_replace({c}, '[^/]*$', 'x') as p").distinct().collect()})
    width = rows.first()["width"]
    images = folder("image_path")
    got = plan.evaluate(spark, rows, tiff.read(spark, folder("mask_path")), tiff.read(spark, images) if images else None, _model(a.model), width, a.split, a.dry_run, a.max_tiles, a.out, views=a.tta, apls=a.apls)
    lines = got.collect()  # one row per terrain
    print(plan.as_text(lines))
    if not a.dry_run:
        tables.write_reports(spark.createDataFrame(lines, got.schema), f"{a.out}/report")


def ablations(spark, a, config):
    from arterial.plans import pipeline as plan
    from arterial.sources.tables import markdown

    cells, width, t, resolution = _masks(spark, a.masks)
    healing = plan.healing_ablation(cells, width, a.max_gap)
    attack = plan.attack_ablation(*plan.tile_graph(cells, width, t, resolution, None, True, a.max_gap), a.k)
    for name, table in (("healing", healing), ("attack", attack)):
        table.write.mode("overwrite").json(f"{a.out}/{name}")
        print(markdown(spark.read.schema(table.schema).json(f"{a.out}/{name}").collect(), table.columns))


def main(arguments=None, spark=None) -> None:
    from arterial.session import session
    from arterial.sources.tables import load_config

    a = parser().parse_args(arguments)
    globals()[a.command](spark or session(a.master), a, load_config(*a.config, overrides=a.set))


if __name__ == "__main__":
    main()
