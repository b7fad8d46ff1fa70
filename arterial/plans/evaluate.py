"""Evaluation of a model's masks: a clean pass, a pass over occluded images, topology and graphs, overall and by terrain."""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import DataFrame, functions as F

from arterial.functions.scalars import plain_path
from arterial.operators import graph as G, raster as R

#: Seeds of synthetic images and of occlusions, to which a tile's number is added.
IMAGE_SEED, OCCLUSION_SEED = 1000, 2000
PREDICTED = "tile_id string, kind string, row int, col int"
KINDS = ("truth", "clean", "occluded", "covered")


def load_tiles(manifest: DataFrame, masks: DataFrame, images: DataFrame | None = None, split: str | None = None, most: int | None = None) -> DataFrame:
    """(tile_id, terrain, number, height, width, mask, image) of a split's manifest rows, in order of tile_id. masks, images:
    dense rasters by path; a tile without an image gets a synthetic one by its number."""
    from pyspark.sql.window import Window

    rows = manifest.where(F.col("split") == split) if split else manifest
    if most is not None:
        rows = rows.orderBy("tile_id").limit(most)
    # numbers only seed noise: they need an order, not one of a large table's rows in one task
    rows = rows.withColumn("number", (F.row_number().over(Window.partitionBy("terrain").orderBy("tile_id")) - 1).cast("int"))
    m = masks.where("error is null").select(plain_path(F.col("path")).alias("mask_path"), "height", "width", F.col("dtype").alias("mask_dtype"), F.col("data").alias("mask"))
    out = rows.select("tile_id", "terrain", "number", plain_path(F.col("mask_path")).alias("mask_path"), plain_path(F.col("image_path")).alias("image_path")).join(m, "mask_path")
    if images is None:
        return out.withColumns({"bands": F.lit(None).cast("int"), "dtype": F.lit(None).cast("string"), "image": F.lit(None).cast("binary")})
    i = images.where("error is null").select(plain_path(F.col("path")).alias("image_path"), "bands", "dtype", F.col("data").alias("image"))
    return out.join(i, "image_path", "left")


def _passes(batches, model, threshold, occlusion, views, scales):
    import pandas as pd

    from arterial.operators.occlusion import occlude, synthesize
    from arterial.plans.predict import normalised, probabilities

    def ask(image):
        return probabilities(model, normalised(image.transpose(2, 0, 1)), *((scales, True) if views else ())) > threshold

    for pdf in batches:
        for r in pdf.to_dict("records"):
            mask = (np.frombuffer(r["mask"], r["mask_dtype"])[: r["height"] * r["width"]].reshape(r["height"], r["width"]) > 0).astype(np.uint8)
            if r["image"] is None:
                image = synthesize(mask, IMAGE_SEED + r["number"])
            else:
                image = np.frombuffer(r["image"], r["dtype"]).reshape(int(r["bands"]), *mask.shape)[:3].transpose(1, 2, 0).astype(np.uint8)
            hard, _, hidden, _, _ = occlude(image, mask, **{**occlusion, "prob": 1.0, "seed": OCCLUSION_SEED + r["number"]})
            found = []
            for kind, cells in zip(KINDS, (mask > 0, ask(image), ask(hard), hidden), strict=True):
                at = np.argwhere(cells).astype("int32")
                found.append(pd.DataFrame({"tile_id": r["tile_id"], "kind": kind, "row": at[:, 0], "col": at[:, 1]}))
            yield pd.concat(found)


def predicted(tiles: DataFrame, model, threshold: float = 0.5, occlusion: dict | None = None, views: bool = False, scales=(0.75, 1.0, 1.25)) -> DataFrame:
    """Set cells of each tile by kind: the truth, the prediction, the prediction under occlusion, and the road it covers."""
    run = partial(_passes, model=model, threshold=threshold, occlusion=occlusion or {}, views=views, scales=tuple(scales))
    return tiles.select("tile_id", "number", "height", "width", "mask", "mask_dtype", "bands", "dtype", "image").mapInPandas(run, PREDICTED)


def report(strata: DataFrame, truth: DataFrame, clean: DataFrame, occluded: DataFrame, covered: DataFrame, width: int, resolution: float = 0.5, topology: bool = True, apls: bool = False) -> DataFrame:
    """One row over all tiles (terrain is null) and one per terrain. Counts are summed before ratios are taken, clDice,
    connectivity and APLS are means over tiles; occlusion recall is null where no road was covered. Without tiles the overall
    row is there, its measures null. strata: (tile_id,
    terrain), which also names tiles whose masks are empty."""
    key = ["tile_id", "row", "col"]
    counts = R.aligned(truth, clean).groupBy("tile_id").agg(*R.confusion_columns())
    # road under occluders, and what the second pass still found of it
    hidden = covered.select(*key).join(truth.select(*key), key, "left_semi")
    found = hidden.join(occluded.select(*key, F.lit(1).alias("f")), key, "left").groupBy("tile_id").agg(F.count("*").alias("hidden"), F.count("f").alias("recovered"))
    per_tile = strata.join(counts, "tile_id", "left").join(found, "tile_id", "left").fillna(0, ["tp", "fp", "fn", "hidden", "recovered"])
    per_tile = per_tile.join(R.connectivity_ratio(truth, clean, width).select("tile_id", "connectivity_ratio"), "tile_id", "left").fillna(0.0, ["connectivity_ratio"])
    means = ["connectivity_ratio"]
    if topology:
        per_tile = per_tile.join(R.cldice(truth, clean).select("tile_id", "cldice"), "tile_id", "left").fillna(0.0, ["cldice"])
        means.append("cldice")
    if apls:
        graphs = [R.mask_to_graph(cells, width, None, resolution) for cells in (truth, clean)]
        score = G.apls(*graphs, resolution=resolution).withColumnRenamed("graph_id", "tile_id")
        both_empty = F.when(F.col("tp") + F.col("fp") + F.col("fn") == 0, 1.0).otherwise(0.0)
        per_tile = per_tile.join(score, "tile_id", "left").withColumn("apls", F.coalesce("apls", both_empty))
        means.append("apls")
    sums = [F.sum(c).alias(c) for c in ("tp", "fp", "fn", "hidden", "recovered")]
    out = R.overall_and_by("terrain", per_tile, *sums, *[F.avg(c).alias(c) for c in means])
    return R.ratios(out).withColumn("occlusion_recall", F.expr("recovered / nullif(hidden, 0)"))


def evaluate(spark, manifest: DataFrame, masks: DataFrame, images: DataFrame | None, model, width: int, split: str = "test", dry_run: bool = False, most: int | None = None, folder: str | None = None, **options) -> DataFrame:
    """The report of a model on a split; dry_run: eight tiles, and nothing is written. Predictions are written under folder,
    as the measures read them several times."""
    most = 8 if dry_run and most is None else most
    tiles = load_tiles(manifest, masks, images, split, most)
    passes = {k: options.pop(k) for k in ("threshold", "occlusion", "views", "scales") if k in options}
    cells = predicted(tiles, model, **passes)
    if folder and not dry_run:
        cells.write.mode("overwrite").partitionBy("kind").parquet(f"{folder}/cells")
        cells = spark.read.parquet(f"{folder}/cells")
    kinds = [cells.where(F.col("kind") == k).select("tile_id", "row", "col") for k in KINDS]
    return report(tiles.select("tile_id", "terrain"), *kinds, width, **options)


COLUMNS = ("iou", "dice", "cldice", "apls", "connectivity_ratio", "recall", "occlusion_recall")


def as_text(rows, name: str = "terrain") -> str:
    """Collected report rows (as many as terrains) as lines of a console."""
    show = lambda v: "    -" if v is None else f"{v:5.3f}"
    have = [c for c in COLUMNS if any(c in r.asDict() for r in rows)]
    lines = [f"{name:<14} {'n':>6} " + " ".join(f"{c[:10]:>10}" for c in have)]
    for r in sorted(rows, key=lambda r: (not r["overall"], r[name] or "")):
        lines.append(f"{'all' if r['overall'] else r[name] or '-':<14} {r['n_tiles']:>6} " + " ".join(f"{show(r[c]):>10}" for c in have))
    return "\n".join(lines)


def compared(reports: DataFrame) -> DataFrame:
    """Overall rows of several reports (model, ...), with each measure's difference from the best one."""
    top = reports.where("overall")
    have = [c for c in COLUMNS if c in reports.columns]
    best = top.agg(*[F.max(c).alias(f"best_{c}") for c in have])
    return top.join(F.broadcast(best)).select("model", *have, *[(F.col(c) - F.col(f"best_{c}")).alias(f"{c}_below_best") for c in have])
