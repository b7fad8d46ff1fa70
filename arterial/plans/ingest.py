"""Image and mask pairs to training tiles: decode, validate, cut windows out of pixels, keep those with enough road, write
rasters and manifest rows. One pass; a pair is one row, its windows are cut where it was decoded."""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import DataFrame, functions as F

from arterial.functions.scalars import plain_path
from arterial.operators.tiles import split, tile_step
from arterial.plans.predict import window_starts
from arterial.schema import MANIFEST

#: Metres a pixel of each source's imagery, where it isn't told.
GROUND = {"deepglobe": 0.5, "massachusetts": 1.0, "spacenet": 0.3, "opensatmap": 0.15, "folder": 0.5, "geotiff-osm": 0.5, "cartosat": 0.28}
TILES = "tile_id string, image binary, mask binary, transform array<double>, epsg int, road_frac double, error string"


def load_pairs(pairs: DataFrame, images: DataFrame, masks: DataFrame) -> DataFrame:
    """pairs (pair_id, image_path, mask_path) with their dense rasters (sources.tables.images or sources.tiff.read)."""
    place = [c if c in images.columns else F.lit(None).cast(t).alias(c) for c, t in (("transform", "array<double>"), ("epsg", "int"))]
    i = images.select(plain_path(F.col("path")).alias("image_path"), F.col("bands"), F.col("height"), F.col("width"), F.col("dtype"), F.col("data"), F.col("error"), *place)
    m = masks.select(plain_path(F.col("path")).alias("mask_path"), F.col("height").alias("mask_height"), F.col("width").alias("mask_width"), F.col("dtype").alias("mask_dtype"), F.col("data").alias("mask_data"), F.col("error").alias("mask_error"))
    names = {c: plain_path(F.col(c)) for c in ("image_path", "mask_path")}
    return pairs.withColumns(names).join(i, "image_path").join(m, "mask_path")


def segments_by_footprint(images: DataFrame, segments: DataFrame) -> DataFrame:
    """segments (seg_id, x0, y0, x1, y1) with the pair_id of each image whose footprint they meet; in the images' coordinates."""
    from arterial.operators.tiles import overlapping

    t = lambda k: F.col("transform")[k]
    footprint = images.where("error is null and transform is not null").select(
        F.col("pair_id").alias("tile_id"), t(2).alias("west"), (t(5) + t(4) * F.col("height")).alias("south"), (t(2) + t(0) * F.col("width")).alias("east"), t(5).alias("north"))
    bounds = {"xmin": F.least("x0", "x1"), "xmax": F.greatest("x0", "x1"), "ymin": F.least("y0", "y1"), "ymax": F.greatest("y0", "y1")}
    return overlapping(segments.withColumns(bounds), footprint).select(F.col("tile_id").alias("pair_id"), "seg_id", "x0", "y0", "x1", "y1")


def rasterised_pairs(images: DataFrame, segments: DataFrame, key: str = "pair_id", buffer: float = 2.0) -> DataFrame:
    """Geo-referenced rasters (of sources.tiff.read, with their pair's name) whose masks are drawn from segments (key, seg_id,
    x0, y0, x1, y1) in the rasters' coordinates. A raster without segments has an empty mask."""
    lines = segments.groupBy(key).agg(F.collect_list(F.array("x0", "y0", "x1", "y1")).alias("lines"))
    drawn = images.where(F.col("error").isNull() & F.col("transform").isNotNull()).join(lines, key, "left")
    mask = drawn.select(key, "transform", "height", "width", "lines").mapInPandas(partial(_drawn, key=key, buffer=buffer), f"{key} string, mask_data binary")
    out = images.join(mask, key)
    return out.withColumns({"image_path": F.col("path"), "mask_path": F.lit(""), "mask_height": F.col("height"), "mask_width": F.col("width"), "mask_dtype": F.lit("|u1"), "mask_error": F.lit(None).cast("string")}).withColumnRenamed(key, "pair_id")


def _drawn(batches, key, buffer):
    import pandas as pd

    from arterial.operators.kernels import segment_cover

    for pdf in batches:
        out = []
        for r in pdf.to_dict("records"):
            lines = [] if r["lines"] is None else [tuple(x) for x in r["lines"]]
            out.append((r[key], segment_cover((int(r["height"]), int(r["width"])), tuple(r["transform"]), lines, buffer).astype(np.uint8).tobytes()))
        yield pd.DataFrame(out, columns=[key, "mask_data"])


def _cut(batches, tile, step, least, source, gsd):
    import pandas as pd

    from arterial.sources.tiff import Raster, encode

    for pdf in batches:
        for r in pdf.to_dict("records"):
            name = f"{source}_{r['pair_id']}"
            why = r["error"] or r["mask_error"]
            if why is None and r["bands"] != 3:
                why = f"{r['bands']} bands, not 3"
            if why is None and (r["height"], r["width"]) != (r["mask_height"], r["mask_width"]):
                why = "image and mask differ in size"
            rows = []
            if why is None:
                h, w = int(r["height"]), int(r["width"])
                image = np.frombuffer(r["data"], r["dtype"]).reshape(3, h, w).astype(np.uint8)
                mask = np.frombuffer(r["mask_data"], r["mask_dtype"])[: h * w].reshape(h, w) > 0
                known = r["transform"] is not None
                # without geodesy a north-up grid of its own, its origin at the image's lower left
                a, b, c, d, e, f = r["transform"] if known else (gsd, 0.0, 0.0, 0.0, -gsd, h * gsd)
                epsg = int(r["epsg"]) if known and r["epsg"] == r["epsg"] and r["epsg"] is not None else None
                for y in window_starts(h, tile, step).tolist():
                    for x in window_starts(w, tile, step).tolist():
                        part = mask[y : y + tile, x : x + tile]
                        if part.mean() >= least:
                            at = (a, b, a * x + b * y + c, d, e, d * x + e * y + f)
                            rows.append((f"{name}_r{y:05d}_c{x:05d}", encode(Raster(np.ascontiguousarray(image[:, y : y + tile, x : x + tile]), at, epsg)),
                                         encode(Raster(part.astype(np.uint8)[None], at, epsg)), [float(v) for v in at], epsg, float(part.mean()), None))
            else:
                rows.append((name, None, None, None, None, None, why))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in TILES.split(", ")]).astype({"epsg": "Int32"})


def tiles(pairs: DataFrame, source: str, config: dict, gsd: float | None = None) -> DataFrame:
    """Tiles of loaded pairs, as encoded rasters; a pair that doesn't fit has its error instead."""
    size, overlap, least = int(config.get("tile_size", 512)), float(config.get("overlap", 0.25)), float(config.get("min_road_frac", 0.004))
    run = partial(_cut, tile=size, step=tile_step(size, overlap), least=least, source=source, gsd=float(gsd or GROUND.get(source, 0.5)))
    cols = ["pair_id", "bands", "height", "width", "dtype", "data", "error", "transform", "epsg", "mask_height", "mask_width", "mask_dtype", "mask_data", "mask_error"]
    return pairs.select(*cols).mapInPandas(run, TILES)


def manifest(cut: DataFrame, source: str, terrain: str, folder: str, size: int) -> DataFrame:
    """Manifest rows of tiles whose files lie under folder."""
    t = lambda k: F.col("transform")[k]
    return cut.where("error is null").select(
        "tile_id", F.lit(source).alias("place"), F.lit(terrain).alias("terrain"), F.concat(F.lit(f"{folder}/masks/"), "tile_id", F.lit(".tif")).alias("mask_path"),
        F.concat(F.lit(f"{folder}/images/"), "tile_id", F.lit(".tif")).alias("image_path"), F.when(F.col("epsg").isNotNull(), F.concat(F.lit("EPSG:"), F.col("epsg"))).otherwise("").alias("crs"),
        t(2).alias("west"), (t(5) + t(4) * size).alias("south"), (t(2) + t(0) * size).alias("east"), t(5).alias("north"), F.lit(size).alias("width"), F.lit(size).alias("height"),
        t(0).alias("resolution_m"), "road_frac", F.lit("").alias("split"))


def ingest(spark, pairs: DataFrame, source: str, terrain: str, folder: str, config: dict, gsd: float | None = None, limit: int | None = None) -> DataFrame:
    """Write the tiles of loaded pairs under folder (images/, masks/) and give the manifest with splits assigned."""
    from arterial.sources import tiff

    if limit is not None:
        pairs = pairs.orderBy("pair_id").limit(limit)
    cut = tiles(pairs, source, config, gsd)
    table = f"{folder}/tiles"
    cut.write.mode("overwrite").parquet(table)  # cut once: files and manifest both come from it
    cut = spark.read.schema(TILES).parquet(table)
    good = cut.where("error is null")
    for name, column in (("images", "image"), ("masks", "mask")):
        tiff.save(good.select(F.concat("tile_id", F.lit(".tif")).alias("name"), F.col(column).alias("content")), f"{folder}/{name}")
    rows = manifest(cut, source, terrain, folder, int(config.get("tile_size", 512)))
    return split(rows).select(*[c.split()[0] for c in MANIFEST.split(", ")])


def append(old: DataFrame, new: DataFrame) -> DataFrame:
    """Manifests joined: of a tile in both the new row stays; splits are assigned anew."""
    from arterial.operators.tiles import keep_last

    both = old.withColumn("ingest_seq", F.lit(0)).unionByName(new.withColumn("ingest_seq", F.lit(1)))
    return split(keep_last(both).drop("ingest_seq")).select(*old.columns)
