"""Raster operators. Sparse masks are tables of set cells (tile_id, row, col); dense ones hold every pixel with its value."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

EPS = 1e-7


def density(cells: DataFrame, height: int, width: int) -> DataFrame:
    """Share of set pixels by tile."""
    return cells.groupBy("tile_id").agg((F.count("*") / F.lit(height * width)).alias("road_frac"))


def aligned(truth: DataFrame, pred: DataFrame, occluded: DataFrame | None = None) -> DataFrame:
    """Pixels set in either mask, with t, p (and o) as 0/1."""
    key = ["tile_id", "row", "col"]
    parts = [truth.select(*key, F.lit(1).alias("t"), F.lit(0).alias("p"), F.lit(0).alias("o")), pred.select(*key, F.lit(0).alias("t"), F.lit(1).alias("p"), F.lit(0).alias("o"))]
    if occluded is not None:
        parts.append(occluded.select(*key, F.lit(0).alias("t"), F.lit(0).alias("p"), F.lit(1).alias("o")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    # one shuffle for all masks, where a chain of outer joins would take one each
    return out.groupBy(*key).agg(F.max("t").alias("t"), F.max("p").alias("p"), F.max("o").alias("o"))


def confusion_columns():
    t, p = F.col("t"), F.col("p")
    return [F.sum(t * p).alias("tp"), F.sum((1 - t) * p).alias("fp"), F.sum(t * (1 - p)).alias("fn")]


def ratios(df: DataFrame) -> DataFrame:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return df.withColumns({"iou": tp / (tp + fp + fn + EPS), "dice": 2 * tp / (2 * tp + fp + fn + EPS), "precision": tp / (tp + fp + EPS), "recall": tp / (tp + fn + EPS)})


def confusion(truth: DataFrame, pred: DataFrame) -> DataFrame:
    """Micro-averaged counts and ratios over all tiles."""
    return ratios(aligned(truth, pred).agg(*confusion_columns()))


def occlusion_recall(truth: DataFrame, pred: DataFrame, occluded: DataFrame) -> DataFrame:
    """Road pixels under occlusion, those recovered, and their share (null if none), by tile."""
    a = aligned(truth, pred, occluded)
    hidden = F.sum(F.col("t") * F.col("o"))
    recovered = F.sum(F.col("t") * F.col("o") * F.col("p"))
    return a.groupBy("tile_id").agg(hidden.alias("hidden"), recovered.alias("recovered")).withColumn("occlusion_recall", F.expr("recovered / nullif(hidden, 0)"))


def overall_and_by(key: str, per_tile: DataFrame, *aggregates) -> DataFrame:
    """Aggregates over all rows (key is null, overall is true) and by key, with n_tiles. As in SQL, the overall row is there
    without any rows too, its sums null."""
    # grouping sets of no rows have no groups, so one row that counts as no tile is added
    rows = per_tile.withColumn("_tile", F.lit(1)).unionByName(per_tile.sparkSession.range(1).select(F.lit(None).cast("int").alias("_tile")), allowMissingColumns=True)
    out = rows.groupingSets([[], [key]], key).agg(*aggregates, F.count("_tile").alias("n_tiles"), (F.grouping(key) == 1).alias("overall"))
    return out.where("overall or n_tiles > 0")


def by_stratum(truth: DataFrame, pred: DataFrame, strata: DataFrame) -> DataFrame:
    """Confusion overall and by terrain in one pass; terrain is null in the overall row. strata: (tile_id, terrain)."""
    per_tile = aligned(truth, pred).groupBy("tile_id").agg(*confusion_columns()).join(strata, "tile_id")
    return ratios(overall_and_by("terrain", per_tile, *[F.sum(c).alias(c) for c in ("tp", "fp", "fn")]).drop("overall"))


def cell_graph(cells: DataFrame, width: int):
    """(nodes, edges) of set cells and their eight neighbours."""
    number = (F.col("row") * width + F.col("col")).cast("long")
    nodes = cells.select(F.col("tile_id").alias("graph_id"), number.alias("node_id"), F.col("col").cast("double").alias("x"), F.col("row").cast("double").alias("y"))
    ahead = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r, c in ((0, 1), (1, -1), (1, 0), (1, 1))])
    near = cells.withColumn("o", F.explode(ahead)).select("tile_id", number.alias("src"), (F.col("row") + F.col("o.r")).alias("row"), (F.col("col") + F.col("o.c")).alias("col"))
    edges = near.join(cells, ["tile_id", "row", "col"]).select(F.col("tile_id").alias("graph_id"), "src", number.alias("dst"), F.lit(1.0).alias("length"))
    return nodes, edges


def n_components(cells: DataFrame, width: int) -> DataFrame:
    from arterial.operators.graph import components

    nodes, edges = cell_graph(cells, width)
    return components(nodes, edges).groupBy(F.col("graph_id").alias("tile_id")).agg(F.countDistinct("component").alias("n_components"))


def connectivity_ratio(truth: DataFrame, pred: DataFrame, width: int) -> DataFrame:
    """Components of the truth over those of the prediction; 0 if the prediction is empty."""
    t = n_components(truth, width).withColumnRenamed("n_components", "n_true")
    p = n_components(pred, width).withColumnRenamed("n_components", "n_pred")
    both = t.join(p, "tile_id", "full_outer").fillna(0)
    return both.withColumn("connectivity_ratio", F.when(F.col("n_pred") == 0, F.lit(0.0)).otherwise(F.col("n_true") / F.col("n_pred")))


def dense(cells: DataFrame, height: int, width: int) -> DataFrame:
    """Every pixel of the tiles at hand, v = 1 where set."""
    grid = cells.select("tile_id").distinct().withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(height - 1)))).withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
    return grid.join(cells.select("tile_id", "row", "col", F.lit(1.0).alias("v")), ["tile_id", "row", "col"], "left").fillna(0.0, ["v"])


def _along(axis: str):
    other = "col" if axis == "row" else "row"
    return Window.partitionBy("tile_id", other).orderBy(axis).rowsBetween(-1, 1)


def erode(pixels: DataFrame) -> DataFrame:
    """Minimum over the cross of a pixel and its four neighbours; beyond the border nothing counts."""
    return pixels.select("tile_id", "row", "col", F.least(F.min("v").over(_along("row")), F.min("v").over(_along("col"))).alias("v"))


def dilate(pixels: DataFrame) -> DataFrame:
    """Maximum over the 3 x 3 square."""
    rows = pixels.select("tile_id", "row", "col", F.max("v").over(_along("row")).alias("v"))
    return rows.select("tile_id", "row", "col", F.max("v").over(_along("col")).alias("v"))


def opened(pixels: DataFrame) -> DataFrame:
    return dilate(erode(pixels))


def soft_skeleton(pixels: DataFrame, rounds: int = 10) -> DataFrame:
    """Residues of openings, accumulated; a checkpoint every third round keeps the plan short."""
    key = ["tile_id", "row", "col"]

    def residue(img):
        return img.join(opened(img).withColumnRenamed("v", "o"), key).select(*key, F.greatest(F.col("v") - F.col("o"), F.lit(0.0)).alias("s"))

    img, out = pixels, residue(pixels)
    for k in range(rounds):
        img = erode(img)
        step = residue(img).withColumnRenamed("s", "d")
        out = out.join(step, key).select(*key, (F.col("s") + F.greatest(F.col("d") - F.col("s") * F.col("d"), F.lit(0.0))).alias("s"))
        if k % 3 == 2 and k + 1 < rounds:
            img, out = img.checkpoint(), out.checkpoint()
    return out


def _soft(pdf, rounds: int):
    import numpy as np
    import pandas as pd

    from arterial.operators.kernels import soft_skeleton as kernel

    img = np.zeros((pdf["row"].max() + 1, pdf["col"].max() + 1))
    img[pdf["row"], pdf["col"]] = pdf["v"]
    s = kernel(img, rounds)
    return pd.DataFrame({"tile_id": pdf["tile_id"], "row": pdf["row"], "col": pdf["col"], "s": s[pdf["row"], pdf["col"]]})


def soft_skeleton_by_tile(pixels: DataFrame, rounds: int = 10) -> DataFrame:
    """The same as soft_skeleton(), one kernel call per tile."""
    return pixels.groupBy("tile_id").applyInPandas(partial(_soft, rounds=rounds), "tile_id string, row int, col int, s double")


def soft_cldice(truth: DataFrame, pred: DataFrame, rounds: int = 3, smooth: float = 1.0) -> DataFrame:
    """Value of the soft clDice loss by tile: 1 - 2 P S / (P + S), P and S of soft skeletons against the other mask."""
    key = ["tile_id", "row", "col"]
    t = truth.withColumnRenamed("v", "t").join(soft_skeleton_by_tile(truth, rounds).withColumnRenamed("s", "st"), key)
    p = pred.withColumnRenamed("v", "p").join(soft_skeleton_by_tile(pred, rounds).withColumnRenamed("s", "sp"), key)
    s = t.join(p, key).groupBy("tile_id").agg(
        ((F.sum(F.col("sp") * F.col("t")) + smooth) / (F.sum("sp") + smooth)).alias("tprec"), ((F.sum(F.col("st") * F.col("p")) + smooth) / (F.sum("st") + smooth)).alias("tsens"))
    return s.withColumn("loss", 1 - 2 * F.col("tprec") * F.col("tsens") / (F.col("tprec") + F.col("tsens")))


def dice_cldice(truth: DataFrame, pred: DataFrame, alpha: float = 0.5, rounds: int = 3, smooth: float = 1.0) -> DataFrame:
    """Value of the mixed loss by tile: (1 - alpha) soft Dice + alpha soft clDice."""
    key = ["tile_id", "row", "col"]
    t, p = truth.withColumnRenamed("v", "t"), pred.withColumnRenamed("v", "p")
    dice = t.join(p, key).groupBy("tile_id").agg((1 - (2 * F.sum(F.col("t") * F.col("p")) + smooth) / (F.sum("t") + F.sum("p") + smooth)).alias("dice_loss"))
    both = dice.join(soft_cldice(truth, pred, rounds, smooth).select("tile_id", F.col("loss").alias("cldice_loss")), "tile_id")
    return both.withColumn("loss", (1 - alpha) * F.col("dice_loss") + alpha * F.col("cldice_loss"))


def dice_focal(pixels: DataFrame, dice_w: float = 0.5, focal_w: float = 0.5, gamma: float = 2.0) -> DataFrame:
    """Value of the Dice and focal loss over pixels (tile_id, t, p)."""
    t, p = F.col("t").cast("double"), F.least(F.greatest(F.col("p"), F.lit(EPS)), F.lit(1 - EPS))
    focal = F.avg(-t * F.pow(1 - p, gamma) * F.log(p) - (1 - t) * F.pow(p, gamma) * F.log(1 - p))
    dice = 1 - (2 * F.sum(t * p) + EPS) / (F.sum(t) + F.sum(p) + EPS)
    return pixels.groupBy("tile_id").agg(dice.alias("dice_loss"), focal.alias("focal_loss")).withColumn("loss", dice_w * F.col("dice_loss") + focal_w * F.col("focal_loss"))


def percentiles(values: DataFrame, keys: list[str], shares: list[float]) -> DataFrame:
    """keys and q, the exact percentiles (linear between neighbours) of each key's v.

    Values are counted first; ranges of 1/256 of a key's span, with their counts, tell which hold the wanted ranks, and only
    values of those ranges are ordered. No task holds a whole key."""
    counts = values.where("v is not null and not isnan(v)").groupBy(*keys, F.col("v").cast("double").alias("v")).agg(F.count("*").alias("c"))
    span = counts.groupBy(*keys).agg(F.min("v").alias("_lo"), F.max("v").alias("_hi"), F.sum("c").alias("_n"))
    bins = F.when(F.col("_hi") > F.col("_lo"), F.least(F.floor((F.col("v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * 256), F.lit(255))).otherwise(0)
    binned = counts.join(span, keys).withColumn("_b", bins)
    w = Window.partitionBy(*keys).orderBy("_b")
    ranges = binned.groupBy(*keys, "_b").agg(F.sum("c").alias("_m")).withColumn("_before", F.sum("_m").over(w) - F.col("_m"))
    ranks = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(p).alias("p")) for i, p in enumerate(shares)]))
    place = F.col("r.p") * (F.col("_n") - 1)
    asked = span.withColumn("r", ranks).select(*keys, F.col("r.i").alias("_i"), F.floor(place).alias("_k"), (place - F.floor(place)).alias("_f"))
    # ranges that hold rank k or k + 1
    held = ranges.join(asked, keys).where("_before <= _k + 1 and _before + _m > _k")
    within = binned.join(held.select(*keys, "_b", "_i", "_k", "_f", "_before"), [*keys, "_b"])
    upto = F.sum("c").over(Window.partitionBy(*keys, "_i", "_b").orderBy("v")) + F.col("_before")
    near = within.withColumn("_to", upto).withColumn("_from", F.col("_to") - F.col("c"))
    low = F.max(F.when((F.col("_from") <= F.col("_k")) & (F.col("_to") > F.col("_k")), F.col("v")))
    high = F.max(F.when((F.col("_from") <= F.col("_k") + 1) & (F.col("_to") > F.col("_k") + 1), F.col("v")))
    one = near.groupBy(*keys, "_i").agg(low.alias("a"), high.alias("b"), F.first("_f").alias("f"))
    q = F.col("a") + F.when(F.col("f") > 0, F.col("f") * (F.col("b") - F.col("a"))).otherwise(0.0)
    return one.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", q.alias("q")))), lambda s: s["q"]).alias("q"))


def stretch(values: DataFrame, keys: list[str], low: float = 0.02, high: float = 0.98) -> DataFrame:
    """v of each key's band stretched to 0..255 between exact percentiles; a flat band spans one unit."""
    limits = percentiles(values, keys, [low, high])
    limits = limits.select(*keys, F.col("q")[0].alias("lo"), F.when(F.col("q")[1] <= F.col("q")[0], F.col("q")[0] + 1).otherwise(F.col("q")[1]).alias("hi"))
    u = F.least(F.greatest((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 255, F.lit(0.0)), F.lit(255.0)).cast("int")
    return values.join(limits, keys).withColumn("u8", u)


def hann(i, n: int):
    """Weight of place i (0-based column) in a window of n."""
    return 0.5 - 0.5 * F.cos(2 * F.pi() * (i + 1) / F.lit(n + 1))


def blend(windows: DataFrame, size: int) -> DataFrame:
    """Overlapping windows (tile_id, y0, x0, r, c, p) to pixels, weighted by Hann windows."""
    w = hann(F.col("r"), size) * hann(F.col("c"), size)
    a = windows.select("tile_id", (F.col("y0") + F.col("r")).alias("row"), (F.col("x0") + F.col("c")).alias("col"), "p", w.alias("w"))
    return a.groupBy("tile_id", "row", "col").agg((F.sum(F.col("p") * F.col("w")) / F.sum("w")).alias("p"))


def tta_mean(views: DataFrame) -> DataFrame:
    """Mean over the views (scales, flips) of each pixel."""
    return views.groupBy("tile_id", "row", "col").agg(F.avg("p").alias("p"), F.count("*").alias("n_views"))


def binarise(pixels: DataFrame, threshold: float = 0.5) -> DataFrame:
    return pixels.where(F.col("p") > threshold).select("tile_id", "row", "col")


def _skeletons(pdf):
    import numpy as np
    import pandas as pd

    from arterial.operators.kernels import thin

    m = np.zeros((pdf["row"].max() + 1, pdf["col"].max() + 1), bool)
    m[pdf["row"], pdf["col"]] = True
    at = np.argwhere(thin(m))
    return pd.DataFrame({"tile_id": pdf["tile_id"].iloc[0], "row": at[:, 0].astype("int32"), "col": at[:, 1].astype("int32")})


def skeletonise(cells: DataFrame) -> DataFrame:
    return cells.groupBy("tile_id").applyInPandas(_skeletons, "tile_id string, row int, col int")


def cldice(truth: DataFrame, pred: DataFrame) -> DataFrame:
    """clDice by tile: harmonic mean of the skeletons' shares inside the other mask; 0 if either is empty."""
    key = ["tile_id", "row", "col"]

    def share(skeleton, mask, name):
        hit = skeleton.join(mask.select(*key, F.lit(1).alias("i")), key, "left")
        return hit.groupBy("tile_id").agg((F.sum(F.coalesce("i", F.lit(0))) / F.count("*")).alias(name))

    p, s = share(skeletonise(pred), truth, "tprec"), share(skeletonise(truth), pred, "tsens")
    both = p.join(s, "tile_id", "full_outer").fillna(0.0)
    return both.withColumn("cldice", F.when(F.col("tprec") + F.col("tsens") == 0, F.lit(0.0)).otherwise(2 * F.col("tprec") * F.col("tsens") / (F.col("tprec") + F.col("tsens") + EPS)))


def _graphs(pdf, transform, resolution, simplify, merge_px, edges):
    import numpy as np
    import pandas as pd

    from arterial.operators.kernels import mask_graph

    tile = pdf["tile_id"].iloc[0]
    width = int(pdf["width"].iloc[0])
    m = np.zeros((int(pdf["row"].max()) + 1, width), bool)
    m[pdf["row"], pdf["col"]] = True
    adj, xy = mask_graph(m, transform, resolution, simplify, merge_px)
    rows = [(tile, "n", n, None, x, y, None) for n, (x, y) in sorted(xy.items())]
    rows += [(tile, "e", a, b, None, None, w) for a in sorted(adj) for b, w in sorted(adj[a].items()) if a <= b]
    return pd.DataFrame(rows, columns=["graph_id", "kind", "a", "b", "x", "y", "length"]).astype({"a": "Int64", "b": "Int64"})


def mask_to_graph(cells: DataFrame, width: int, transform=None, resolution: float = 1.0, simplify: bool = True, merge_px: float = 2.5):
    """(nodes, edges) of each tile's mask. Both come from one table of kernel results: materialise it where both are used often."""
    run = partial(_graphs, transform=transform, resolution=resolution, simplify=simplify, merge_px=merge_px, edges=True)
    both = cells.select("tile_id", "row", "col", F.lit(width).alias("width")).groupBy("tile_id").applyInPandas(run, "graph_id string, kind string, a long, b long, x double, y double, length double")
    nodes = both.where("kind = 'n'").select("graph_id", F.col("a").alias("node_id"), "x", "y")
    return nodes, both.where("kind = 'e'").select("graph_id", F.col("a").alias("src"), F.col("b").alias("dst"), "length")


#: Losses by name, as functions of dense truth and prediction (tile_id, row, col, v); own ones are added here.
LOSSES = {"soft_cldice": soft_cldice, "dice_cldice": dice_cldice,
          "dice_focal": lambda t, p, **o: dice_focal(t.withColumnRenamed("v", "t").join(p.withColumnRenamed("v", "p"), ["tile_id", "row", "col"]), **o)}


def loss(name: str, truth: DataFrame, pred: DataFrame, **options) -> DataFrame:
    if name not in LOSSES:
        raise ValueError(f"unknown loss {name!r}")
    return LOSSES[name](truth, pred, **options)
