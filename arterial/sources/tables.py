"""Manifests, reports, configuration, graph XML, and dataset layouts found by path."""

from __future__ import annotations

import os
import xml.etree.ElementTree as ET

from pyspark.sql import DataFrame, functions as F

from arterial.functions.scalars import chip_id, stem
from arterial.schema import MANIFEST


def read_manifest(spark, path: str) -> DataFrame:
    """A manifest CSV with fixed types; missing text is ''."""
    return spark.read.schema(MANIFEST).csv(path, header=True).fillna("")


def write_manifest(df: DataFrame, path: str, fmt: str = "csv") -> None:
    names = [c.split()[0] for c in MANIFEST.split(", ")]
    have = set(df.columns)
    w = df.select(*[F.col(n) if n in have else F.lit(None).cast("string").alias(n) for n in names]).write.mode("overwrite")
    w.option("header", True).csv(path) if fmt == "csv" else w.parquet(path)


def read_reports(spark, paths) -> DataFrame:
    """Evaluation reports as rows; files that don't exist are skipped."""
    return spark.read.option("multiLine", True).option("ignoreMissingFiles", True).json(paths)


def write_reports(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def load_config(*files: str, overrides=()) -> dict:
    """YAML files merged from left to right, then key.path=value overrides; a missing file is an error."""
    import yaml

    def merge(a, b):
        return {**a, **{k: merge(a[k], v) if isinstance(v, dict) and isinstance(a.get(k), dict) else v for k, v in b.items()}}

    out: dict = {}
    for f in files:
        if not os.path.exists(f):
            raise FileNotFoundError(f)
        with open(f) as fh:
            out = merge(out, yaml.safe_load(fh) or {})
    for o in overrides:
        key, _, value = o.partition("=")
        node = out
        *parents, last = key.split(".")
        for p in parents:
            node = node.setdefault(p, {})
        node[last] = yaml.safe_load(value)
    return out


def save_config(config: dict, path: str) -> None:
    import yaml

    with open(path, "w") as fh:
        yaml.safe_dump(config, fh, sort_keys=False)


IMAGES = r"(?i)\.(png|jpe?g|tiff?|bmp)$"


def files(spark, root: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length", "modificationTime")


def deepglobe_pairs(found: DataFrame) -> DataFrame:
    """(pair_id, image_path, mask_path) of <id>_sat.jpg|png with <id>_mask.png, in either case; images without a mask drop out."""
    sat = found.where(F.col("path").rlike(r"(?i)_sat\.(jpg|png)$")).select(F.regexp_replace("path", r"(?i)_sat\.(jpg|png)$", "").alias("base"), F.col("path").alias("image_path"))
    mask = found.where(F.col("path").rlike(r"(?i)_mask\.png$")).select(F.regexp_replace("path", r"(?i)_mask\.png$", "").alias("base"), F.col("path").alias("mask_path"))
    return sat.join(mask, "base").select(F.element_at(F.split("base", "/"), -1).alias("pair_id"), "image_path", "mask_path")


def folder_pairs(images: DataFrame, masks: DataFrame) -> DataFrame:
    """Images and masks with equal stems; of masks with one stem the last by path is taken."""
    i = images.where(F.col("path").rlike(IMAGES)).select(stem(F.col("path")).alias("pair_id"), F.col("path").alias("image_path"))
    m = masks.where(F.col("path").rlike(IMAGES)).groupBy(stem(F.col("path")).alias("pair_id")).agg(F.max("path").alias("mask_path"))
    return i.join(m, "pair_id")


def labelled_folder_pairs(found: DataFrame) -> DataFrame:
    """<x>/ beside <x>_labels/: pairs by folder and stem, named <x>_<stem>."""
    part = found.where(F.col("path").rlike(IMAGES)).select("path", F.element_at(F.split("path", "/"), -2).alias("folder"), F.regexp_replace("path", r"/[^/]*/[^/]*$", "").alias("parent"), stem(F.col("path")).alias("stem"))
    image = part.where(~F.col("folder").endswith("_labels")).withColumnRenamed("path", "image_path")
    label = part.where(F.col("folder").endswith("_labels")).withColumn("folder", F.regexp_replace("folder", "_labels$", ""))
    label = label.groupBy("parent", "folder", "stem").agg(F.max("path").alias("mask_path"))
    return image.join(label, ["parent", "folder", "stem"]).select(F.concat_ws("_", "folder", "stem").alias("pair_id"), "image_path", "mask_path")


def chip_pairs(images: DataFrame, labels: DataFrame) -> DataFrame:
    """Images and GeoJSON labels by chip id."""
    i = images.where(F.lower("path").rlike(r"\.tiff?$")).select(chip_id(F.col("path")).alias("pair_id"), F.col("path").alias("image_path"))
    v = labels.where(F.lower("path").rlike(r"\.geojson$")).groupBy(chip_id(F.col("path")).alias("pair_id")).agg(F.max("path").alias("label_path"))
    return i.join(v, "pair_id")


def road_segments(spark, geojson_path: str) -> DataFrame:
    """Segments (place, seg_id, x0, y0, x1, y1) of the line strings and multi-line strings of GeoJSON files; files without
    features give none."""
    # coordinates are as deep as the type says: they are read as text first
    raw = spark.read.option("multiLine", True).schema("features array<struct<geometry:struct<type:string,coordinates:string>>>").json(geojson_path).withColumn("place", F.col("_metadata.file_name"))
    found = raw.select("place", F.posexplode("features").alias("f", "feature")).select("place", "f", "feature.geometry.type", "feature.geometry.coordinates")
    one, many = F.from_json("coordinates", "array<array<double>>"), F.from_json("coordinates", "array<array<array<double>>>")
    lines = F.when(F.col("type") == "LineString", F.array(one)).when(F.col("type") == "MultiLineString", many)
    lines = found.withColumn("lines", lines).where("lines is not null").select("place", "f", F.posexplode("lines").alias("part", "p"))
    n = F.size("p")
    steps = lines.where(n > 1).select("place", "f", "part", "p", F.explode(F.sequence(F.lit(0), n - 2)).alias("k"))
    at = lambda i, j: F.get(F.get(F.col("p"), i), F.lit(j))
    name = F.concat_ws("_", "f", F.when(F.col("part") > 0, F.col("part")), "k")
    return steps.select("place", name.alias("seg_id"), at(F.col("k"), 0).alias("x0"), at(F.col("k"), 1).alias("y0"), at(F.col("k") + 1, 0).alias("x1"), at(F.col("k") + 1, 1).alias("y1"))


def places(spark, path: str) -> DataFrame:
    """The places of a YAML list: name and terrain, with a point and radius or a name to look up."""
    import yaml

    with open(path) as fh:
        rows = (yaml.safe_load(fh) or {}).get("places", [])
    point = lambda r, k: None if r.get("point") is None else float(r["point"][k])
    return spark.createDataFrame([(r.get("name"), r.get("terrain"), r.get("query"), point(r, 0), point(r, 1), None if r.get("dist_m") is None else float(r["dist_m"])) for r in rows],
                                 "place string, terrain string, query string, lat double, lon double, radius_m double")


def images(spark, path: str) -> DataFrame:
    """8-bit PNG, JPEG and BMP files as dense rasters (path, bands, height, width, dtype, data, error), bands in the order
    red, green, blue; files are decoded on the executors by Spark's image source."""
    raw = spark.read.format("image").option("dropInvalid", False).option("recursiveFileLookup", "true").load(path)
    # without a host, the binary source writes one slash where this one writes three
    raw = raw.select(F.regexp_replace("image.origin", "^([a-z0-9]+):///", "$1:/").alias("path"), "image.height", "image.width", "image.nChannels", "image.data")

    def planes(batches):
        import numpy as np
        import pandas as pd

        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                if r.height <= 0:
                    rows.append((r.path, None, None, None, None, None, "not an image"))
                    continue
                a = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.nChannels)
                a = a[..., 2::-1] if r.nChannels >= 3 else a  # stored blue first; alpha goes
                rows.append((r.path, a.shape[2], r.height, r.width, "|u1", np.ascontiguousarray(a.transpose(2, 0, 1)).tobytes(), None))
            yield pd.DataFrame(rows, columns=["path", "bands", "height", "width", "dtype", "data", "error"]).astype({c: "Int32" for c in ("bands", "height", "width")})

    return raw.mapInPandas(planes, "path string, bands int, height int, width int, dtype string, data binary, error string")


def find_root(root: str, wanted, depth: int = 4) -> str | None:
    """The first folder (breadth first, sorted) of which wanted(names of its entries) holds."""
    level = [root]
    for _ in range(depth + 1):
        below = []
        for d in level:
            try:
                names = sorted(os.listdir(d))
            except OSError:
                continue
            if wanted(names):
                return d
            below += [os.path.join(d, n) for n in names if os.path.isdir(os.path.join(d, n))]
        level = below
    return None


def graphml(nodes, edges) -> str:
    """One graph's rows as GraphML with scalar attributes."""
    def kind(v):
        return "boolean" if isinstance(v, bool) else "long" if isinstance(v, int) else "double" if isinstance(v, float) else "string"

    root = ET.Element("graphml", xmlns="http://graphml.graphdrawing.org/xmlns")
    keys: dict = {}

    def data(parent, scope, row, skip):
        for k, v in row.items():
            if k in skip or v is None or isinstance(v, (list, tuple, dict)):
                continue
            if (scope, k) not in keys:
                keys[scope, k] = f"d{len(keys)}"
                root.insert(len(keys) - 1, ET.Element("key", {"id": keys[scope, k], "for": scope, "attr.name": k, "attr.type": kind(v)}))
            ET.SubElement(parent, "data", key=keys[scope, k]).text = str(v).lower() if isinstance(v, bool) else str(v)

    g = ET.SubElement(root, "graph", edgedefault="undirected")
    for n in nodes:
        data(ET.SubElement(g, "node", id=str(n["node_id"])), "node", n, {"node_id", "graph_id"})
    for e in edges:
        data(ET.SubElement(g, "edge", source=str(e["src"]), target=str(e["dst"])), "edge", e, {"src", "dst", "graph_id"})
    return ET.tostring(root, encoding="unicode")


def read_graphml(spark, path: str):
    """(nodes, edges) of GraphML files, all values as strings in a map, ids as strings."""
    def rows(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for p, c in zip(pdf["path"], pdf["content"], strict=True):
                root = ET.fromstring(c)
                ns = root.tag.partition("}")[0] + "}" if root.tag.startswith("{") else ""
                names = {k.get("id"): k.get("attr.name") for k in root.iter(f"{ns}key")}
                for x in root.iter():
                    tag = x.tag.removeprefix(ns)
                    if tag in ("node", "edge"):
                        d = [(names.get(y.get("key"), y.get("key")), y.text) for y in x.findall(f"{ns}data")]
                        out.append((p, tag, x.get("id") if tag == "node" else x.get("source"), x.get("target"), dict(d)))
            yield pd.DataFrame(out, columns=["graph_id", "kind", "a", "b", "attributes"])

    both = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(rows, "graph_id string, kind string, a string, b string, attributes map<string,string>")
    return both.where("kind = 'node'").select("graph_id", F.col("a").alias("node_id"), "attributes"), both.where("kind = 'edge'").select("graph_id", F.col("a").alias("src"), F.col("b").alias("dst"), "attributes")


def markdown(rows, columns) -> str:
    """Collected report rows as a Markdown table."""
    show = lambda v: "–" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    return "\n".join(lines + ["| " + " | ".join(show(r[c]) for c in columns) + " |" for r in rows])
