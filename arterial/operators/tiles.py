"""Tiling, filters, stratified splits and manifest upkeep."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window


def starts(size, tile: int, step: int):
    """Array of window starts along an extent (a column); the last window ends flush with it."""
    size = F.col(size) if isinstance(size, str) else size
    inner = F.sequence(F.lit(0), F.greatest(size - tile, F.lit(0)), F.lit(step))
    return F.when(size <= tile, F.array(F.lit(0))).otherwise(F.array_distinct(F.concat(inner, F.array((size - tile).cast("int")))))


def tile_step(tile: int, overlap: float) -> int:
    return max(1, int(tile * (1 - overlap)))


def inference_window(window: int, overlap: float) -> tuple[int, int]:
    """(window, stride): the window is a multiple of 32, at least 32; the stride rounds half to even."""
    win = max(32, window // 32 * 32)
    return win, max(1, round(win * (1 - overlap)))


def windows(images: DataFrame, tile: int, step: int) -> DataFrame:
    """images (width int, height int) exploded into y0, x0."""
    return images.withColumn("y0", F.explode(starts("height", tile, step))).withColumn("x0", F.explode(starts("width", tile, step)))


def tile_grid(places: DataFrame, tile_size: int, resolution: float, overlap: float = 0.0) -> DataFrame:
    """places (place, west, south, east, north) to a grid of tiles, rows from the north; the last may overhang."""
    if not 0 <= overlap < 1:
        raise ValueError("overlap must be in [0, 1)")
    extent = tile_size * resolution
    step = extent * (1 - overlap)

    def count(a, b):
        return F.greatest(F.ceil((F.col(b) - F.col(a)) / step).cast("int"), F.lit(0))

    def numbers(n):
        return F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")))

    g = places.withColumn("r", numbers(count("south", "north"))).withColumn("c", numbers(count("west", "east")))
    left, top = F.col("west") + F.col("c") * step, F.col("north") - F.col("r") * step
    return g.select("place", F.format_string("%s_r%03d_c%03d", "place", "r", "c").alias("tile_id"), "r", "c", left.alias("west"), (top - extent).alias("south"),
                    (left + extent).alias("east"), top.alias("north"), F.lit(tile_size).alias("width"), F.lit(tile_size).alias("height"), F.lit(float(resolution)).alias("resolution_m"))


def window_bounds(df: DataFrame, tile: int) -> DataFrame:
    """Bounds of windows (x0, y0) from a north-up parent transform (a, c, e, f)."""
    west, north = F.col("c") + F.col("a") * F.col("x0"), F.col("f") + F.col("e") * F.col("y0")
    return df.withColumns({"west": west, "north": north, "east": west + F.col("a") * tile, "south": north + F.col("e") * tile})


def overlapping(segments: DataFrame, tiles: DataFrame, cell: float | None = None) -> DataFrame:
    """Tiles with the segments (xmin, ymin, xmax, ymax) that their bounds meet, by cells of one size (the first tile's, if
    not given; any size is right). A pair is reported from the one cell that holds the lower left corner of what both share."""
    if cell is None:
        first = tiles.select(F.greatest(F.col("east") - F.col("west"), F.col("north") - F.col("south")).alias("size")).where("size > 0").first()
        cell = first["size"] if first else 1.0

    def cover(a, b):
        return F.sequence(F.floor(F.col(a) / cell), F.floor(F.col(b) / cell))

    s = segments.withColumn("gx", F.explode(cover("xmin", "xmax"))).withColumn("gy", F.explode(cover("ymin", "ymax")))
    t = tiles.withColumn("gx", F.explode(cover("west", "east"))).withColumn("gy", F.explode(cover("south", "north")))
    hit = t.join(s, ["gx", "gy"]).where("xmax >= west and xmin <= east and ymax >= south and ymin <= north")
    corner = (F.col("gx") == F.floor(F.greatest("west", "xmin") / cell)) & (F.col("gy") == F.floor(F.greatest("south", "ymin") / cell))
    return hit.where(corner).drop("gx", "gy")


def _covers(pdf, buffer: float):
    import numpy as np
    import pandas as pd

    from arterial.operators.kernels import segment_cover

    r = pdf.iloc[0]
    px = (r["east"] - r["west"]) / r["width"]
    m = segment_cover((int(r["height"]), int(r["width"])), (px, 0, r["west"], 0, -px, r["north"]), pdf[["x0", "y0", "x1", "y1"]].to_numpy(), buffer)
    at = np.argwhere(m)
    return pd.DataFrame({"tile_id": r["tile_id"], "row": at[:, 0].astype("int32"), "col": at[:, 1].astype("int32")})


def rasterise(tiles: DataFrame, segments: DataFrame, buffer: float) -> DataFrame:
    """Set cells of each tile within `buffer` of a segment (seg_id, x0, y0, x1, y1); every touched pixel counts."""
    s = segments.withColumns({"xmin": F.least("x0", "x1") - buffer, "xmax": F.greatest("x0", "x1") + buffer, "ymin": F.least("y0", "y1") - buffer, "ymax": F.greatest("y0", "y1") + buffer})
    return overlapping(s, tiles).groupBy("tile_id").applyInPandas(partial(_covers, buffer=buffer), "tile_id string, row int, col int")


def dense_enough(manifest: DataFrame, least: float = 0.004) -> DataFrame:
    return manifest.where(F.col("road_frac") >= least)


def of_split(manifest: DataFrame, split: str) -> DataFrame:
    return manifest.where(F.col("split") == split) if split else manifest


def valid_shapes(images: DataFrame):
    """(good, rejected) of rows (bands, height, width, mask_height, mask_width)."""
    ok = (F.col("bands") == 3) & (F.col("height") == F.col("mask_height")) & (F.col("width") == F.col("mask_width"))
    marked = images.withColumn("ok", F.coalesce(ok, F.lit(False)))
    return marked.where("ok").drop("ok"), marked.where("not ok").drop("ok")


def split(manifest: DataFrame, train: float = 0.7, val: float = 0.15, seed: int = 42, stratum: str = "terrain") -> DataFrame:
    """split column by rank of a seeded hash within the stratum; counts round half to even; a null stratum gets ''.

    Few strata hold all rows, so no task takes one whole: rows fall into slices of the hash's leading digits, a count per
    slice gives each its offset (two small aggregates), and ranks are taken within slices."""
    mark = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("tile_id").cast("string")))
    rows = manifest.withColumns({"_h": mark, "_s": F.substring(mark, 1, 3)})  # 4,096 slices of a stratum
    counts = rows.groupBy(stratum, "_s").agg(F.count("*").alias("_c"))
    w = Window.partitionBy(stratum)
    offsets = counts.withColumns({"_n": F.sum("_c").over(w), "_o": F.sum("_c").over(w.orderBy("_s")) - F.col("_c")}).select(F.col(stratum).alias("_t"), F.col("_s").alias("_u"), "_n", "_o")
    ranked = rows.withColumn("_k", F.row_number().over(Window.partitionBy(stratum, "_s").orderBy("_h", "tile_id")))
    joined = ranked.join(offsets, F.col(stratum).eqNullSafe(F.col("_t")) & (F.col("_s") == F.col("_u")))
    rank, a, b = F.col("_o") + F.col("_k"), F.bround(F.col("_n") * train), F.bround(F.col("_n") * val)
    name = F.when(F.col(stratum).isNull(), "").when(rank <= a, "train").when(rank <= a + b, "val").otherwise("test")
    return joined.withColumn("split", name).select(*[c for c in manifest.columns if c != "split"], "split")


def split_summary(manifest: DataFrame) -> DataFrame:
    """Tiles by terrain and split with margins ('All')."""
    cube = manifest.cube("terrain", "split").agg(F.count("*").alias("n"), F.grouping("terrain").alias("gt"), F.grouping("split").alias("gs"))
    named = cube.select(F.when(F.col("gt") == 1, "All").otherwise(F.col("terrain")).alias("terrain"), F.when(F.col("gs") == 1, "All").otherwise(F.col("split")).alias("split"), "n")
    return named.groupBy("terrain").pivot("split", ["train", "val", "test", "All"]).agg(F.sum("n")).fillna(0)


def keep_last(manifest: DataFrame, order: str = "ingest_seq") -> DataFrame:
    """The row of each tile_id with the largest sequence: one hash aggregate, no sort."""
    fields = [c for c in manifest.columns if c not in ("tile_id", order)]
    last = manifest.groupBy("tile_id").agg(F.max_by(F.struct(*fields, order), F.col(order)).alias("m"))
    return last.select("tile_id", "m.*").select(*manifest.columns)


def densest(manifest: DataFrame, n: int) -> DataFrame:
    return manifest.orderBy(F.desc("road_frac"), "tile_id").limit(n)


def first_per_place(tiles: DataFrame, n: int) -> DataFrame:
    """The first n tiles of each place in row-major order."""
    w = Window.partitionBy("place").orderBy("r", "c")
    return tiles.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n).drop("_k")


def gate(manifest: DataFrame, order: str = "tile_id") -> DataFrame:
    """By terrain: whether every tile has an image, whether all three splits occur, and the resolution of the first tile."""
    return manifest.groupBy("terrain").agg(F.bool_and(F.coalesce(F.col("image_path"), F.lit("")) != "").alias("has_images"), (F.size(F.array_distinct(F.collect_set("split"))) >= 3).alias("all_splits"),
                                           F.min_by("resolution_m", order).alias("resolution_m"), F.count("*").alias("n_tiles"))


def terrains(manifest: DataFrame) -> DataFrame:
    return manifest.select("terrain").distinct()
