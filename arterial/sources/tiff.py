"""GeoTIFF reading and writing for what the engine needs: strips or tiles, 8/16/32-bit integers and floats, no
compression, deflate, LZW or PackBits, horizontal predictor, north-up transforms, EPSG codes, a no-data value."""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass
from functools import partial

import numpy as np
from pyspark.sql import functions as F

_SIZE = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
_CODE = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d"}


@dataclass
class Raster:
    data: np.ndarray  # bands x rows x columns
    transform: tuple | None = None  # affine (a, b, c, d, e, f)
    epsg: int | None = None
    nodata: float | None = None


def _lzw(data: bytes) -> bytes:
    out, table, bits, width, prev = bytearray(), [], 0, 9, None
    acc = 0
    for byte in data:
        acc, bits = acc << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, acc = acc >> bits, acc & ((1 << bits) - 1)
        if code == 256:
            table, width, prev = [bytes([i]) for i in range(256)] + [b"", b""], 9, None
            continue
        if code == 257:
            break
        entry = table[code] if code < len(table) else prev + prev[:1]
        out += entry
        if prev is not None:
            table.append(prev + entry[:1])
        prev = entry
        width = 12 if len(table) >= 2047 else 11 if len(table) >= 1023 else 10 if len(table) >= 511 else 9
    return bytes(out)


def _packbits(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        n = data[i]
        i += 1
        if n < 128:
            out += data[i : i + n + 1]
            i += n + 1
        elif n > 128:
            out += data[i : i + 1] * (257 - n)
            i += 1
    return bytes(out)


def decode(raw: bytes) -> Raster:
    order = {b"II": "<", b"MM": ">"}.get(raw[:2])
    if order is None or struct.unpack_from(order + "H", raw, 2)[0] != 42:
        raise ValueError("not a classic TIFF")
    at = struct.unpack_from(order + "I", raw, 4)[0]
    tags = {}
    for k in range(struct.unpack_from(order + "H", raw, at)[0]):
        tag, kind, n = struct.unpack_from(order + "HHI", raw, at + 2 + 12 * k)
        size = _SIZE.get(kind, 1) * n
        where = at + 2 + 12 * k + 8
        if size > 4:
            where = struct.unpack_from(order + "I", raw, where)[0]
        if kind == 2:
            tags[tag] = raw[where : where + n].rstrip(b"\0").decode("ascii", "replace")
        elif kind in _CODE:
            tags[tag] = struct.unpack_from(f"{order}{n}{_CODE[kind]}", raw, where)
    one = lambda t, d: tags.get(t, (d,))[0]
    width, height, bands, packing, predictor = one(256, 0), one(257, 0), one(277, 1), one(259, 1), one(317, 1)
    kind = {1: "u", 2: "i", 3: "f"}[one(339, 1)]
    dtype = np.dtype(f"{order}{kind}{one(258, 8) // 8}")
    planar = one(284, 1) == 2
    tiled = 322 in tags
    bw, bh = (one(322, 0), one(323, 0)) if tiled else (width, min(one(278, height), height))
    offsets, counts = (tags[324], tags[325]) if tiled else (tags[273], tags[279])
    across, down = -(-width // bw), -(-height // bh)
    depth = 1 if planar else bands
    out = np.zeros((bands, height, width), dtype.newbyteorder("="))
    for k, (o, c) in enumerate(zip(offsets, counts, strict=True)):
        block = raw[o : o + c]
        block = {1: lambda b: b, 8: zlib.decompress, 32946: zlib.decompress, 5: _lzw, 32773: _packbits}[packing](block)
        plane, k = divmod(k, across * down)
        r, q = divmod(k, across)
        rows = bh if tiled else min(bh, height - r * bh)
        a = np.frombuffer(block, dtype, rows * bw * depth).reshape(rows, bw, depth)
        if predictor == 2:
            a = np.cumsum(a, axis=1, dtype=a.dtype)
        a = a[: height - r * bh, : width - q * bw].transpose(2, 0, 1)
        target = out[plane : plane + 1] if planar else out
        target[:, r * bh : r * bh + a.shape[1], q * bw : q * bw + a.shape[2]] = a
    transform = None
    if 34264 in tags:
        m = tags[34264]
        transform = (m[0], m[1], m[3], m[4], m[5], m[7])
    elif 33550 in tags and 33922 in tags:
        (sx, sy), tie = tags[33550][:2], tags[33922]
        transform = (sx, 0.0, tie[3] - tie[0] * sx, 0.0, -sy, tie[4] + tie[1] * sy)
    keys = tags.get(34735, ())
    geo = {keys[i]: keys[i + 3] for i in range(4, len(keys) - 3, 4) if keys[i + 1] == 0}
    text = tags.get(42113)
    return Raster(out, transform, geo.get(3072) or geo.get(2048), float(text) if text else None)


def encode(r: Raster) -> bytes:
    """A deflate-compressed, pixel-interleaved GeoTIFF in strips."""
    data = r.data if r.data.ndim == 3 else r.data[None]
    bands, height, width = data.shape
    kind = {"u": 1, "i": 2, "f": 3, "b": 1}[data.dtype.kind]
    data = data.astype("u1") if data.dtype.kind == "b" else data
    step = max(1, (1 << 16) // max(1, width * bands * data.itemsize))
    pixels = np.ascontiguousarray(data.transpose(1, 2, 0)).astype(data.dtype.newbyteorder("<"))
    strips = [zlib.compress(pixels[y : y + step].tobytes()) for y in range(0, height, step)]
    tags = [(256, "I", [width]), (257, "I", [height]), (258, "H", [data.itemsize * 8] * bands), (259, "H", [8]), (262, "H", [2 if bands == 3 else 1]), (273, "I", [0] * len(strips)),
            (277, "H", [bands]), (278, "I", [step]), (279, "I", [len(s) for s in strips]), (284, "H", [1]), (339, "H", [kind] * bands)]
    if r.transform:
        a, _, c, _, e, f = r.transform
        tags += [(33550, "d", [a, -e, 0.0]), (33922, "d", [0.0, 0.0, 0.0, c, f, 0.0])]
    if r.epsg:
        projected = r.epsg != 4326
        tags.append((34735, "H", [1, 1, 0, 3, 1024, 0, 1, 1 if projected else 2, 1025, 0, 1, 1, 3072 if projected else 2048, 0, 1, r.epsg]))
    if r.nodata is not None:
        tags.append((42113, "s", repr(float(r.nodata)).encode() + b"\0"))
    number = {"H": 3, "I": 4, "d": 12, "s": 2}
    body = 8 + 2 + 12 * len(tags) + 4
    pieces, entries, strip_at = [], [], None
    for tag, fmt, values in tags:
        raw = values if fmt == "s" else struct.pack(f"<{len(values)}{fmt}", *values)
        n = len(values)
        if len(raw) <= 4:
            place = None
        else:
            place = body
            body += len(raw) + len(raw) % 2
            pieces.append(raw + b"\0" * (len(raw) % 2))
        entries.append((tag, number[fmt], n, raw, place))
    first = body
    starts = np.cumsum([0] + [len(s) for s in strips])[:-1] + first
    head = b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", len(tags))
    out_pieces = {}
    k = 0
    for i, (tag, kind_no, n, raw, place) in enumerate(entries):
        if tag == 273:
            raw = struct.pack(f"<{n}I", *starts.tolist())
            if place is not None:
                pieces[k] = raw + b"\0" * (len(raw) % 2)
        k += place is not None
        head += struct.pack("<HHI", tag, kind_no, n) + (raw.ljust(4, b"\0") if place is None else struct.pack("<I", place))
    return head + b"\0\0\0\0" + b"".join(pieces) + b"".join(strips)


def _decoded(batches):
    import pandas as pd

    for pdf in batches:
        rows = []
        for path, content in zip(pdf["path"], pdf["content"], strict=True):
            try:
                r = decode(content)
            except (ValueError, KeyError, zlib.error, struct.error) as why:
                rows.append((path, None, None, None, None, None, None, None, None, str(why)))
                continue
            b, h, w = r.data.shape
            rows.append((path, b, h, w, r.data.dtype.str, np.ascontiguousarray(r.data).tobytes(), list(map(float, r.transform)) if r.transform else None, r.epsg, r.nodata, None))
        yield pd.DataFrame(rows, columns=["path", "bands", "height", "width", "dtype", "data", "transform", "epsg", "nodata", "error"]).astype({"bands": "Int32", "height": "Int32", "width": "Int32", "epsg": "Int32"})


def read(spark, paths, glob: str = "*.tif*", recursive: bool = True):
    """Dense rasters of files, one row each; a file that can't be read has its error instead."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower()).load(paths)
    return files.select("path", "content").mapInPandas(_decoded, "path string, bands int, height int, width int, dtype string, data binary, transform array<double>, epsg int, nodata double, error string")


def _unpacked(batches, band):
    import pandas as pd

    for pdf in batches:
        for r in pdf.itertuples():
            at = np.argwhere(np.frombuffer(r.data, r.dtype).reshape(r.bands, r.height, r.width)[band - 1] > 0)
            yield pd.DataFrame({"tile_id": r.path, "row": at[:, 0].astype("int32"), "col": at[:, 1].astype("int32")})


def _with_band(rasters, band: int):
    return rasters.where(F.col("error").isNull() & (F.col("bands") >= band)).select("path", "bands", "height", "width", "dtype", "data")


def cells(rasters, band: int = 1):
    """Set cells (value > 0 in the band, from 1) of dense rasters."""
    return _with_band(rasters, band).mapInPandas(partial(_unpacked, band=band), "tile_id string, row int, col int")


STRIP = 1 << 18  # values that one batch of values() holds


def _valued(batches, band):
    import pandas as pd

    for pdf in batches:
        for r in pdf.itertuples():
            a = np.frombuffer(r.data, r.dtype).reshape(r.bands, r.height, r.width)[band - 1]
            step = max(1, STRIP // max(1, r.width))
            for y in range(0, r.height, step):
                part = a[y : y + step]
                rows, cols = np.indices(part.shape, "int32")
                yield pd.DataFrame({"raster_id": r.path, "row": rows.ravel() + np.int32(y), "col": cols.ravel(), "v": part.ravel().astype(float)})


def values(rasters, band: int = 1):
    """(raster_id, row, col, v) of the band (from 1), in batches of some rows of pixels."""
    return _with_band(rasters, band).mapInPandas(partial(_valued, band=band), "raster_id string, row int, col int, v double")


def _saved(rows, folder):
    import os

    os.makedirs(folder, exist_ok=True)
    for r in rows:
        # written beside and renamed, so that a repeated task leaves whole files
        aside = os.path.join(folder, f".{r['name']}.{os.getpid()}")
        with open(aside, "wb") as f:
            f.write(r["content"])
        os.replace(aside, os.path.join(folder, r["name"]))


def save(files, folder: str) -> None:
    """Write (name, content) rows as files under a folder that all executors share."""
    files.select("name", "content").foreachPartition(partial(_saved, folder=folder.removeprefix("file://")))
