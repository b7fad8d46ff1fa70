"""Synthetic images and occlusions of dense tiles, one seeded kernel call per tile."""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np

#: Kinds of occluders, and what a scene has of each by default.
KINDS = ("tree_canopy", "building_shadow", "cloud", "vehicle")
CANOPY, VEHICLES = np.array([34, 72, 30]), np.array([[200, 200, 205], [30, 30, 35], [170, 30, 30], [40, 60, 140]])


def blur(a: np.ndarray, sigma: float) -> np.ndarray:
    """Separable Gaussian with reflected borders."""
    r = max(1, int(3 * sigma))
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    k /= k.sum()
    for axis in (0, 1):
        p = np.pad(a, [(r, r) if i == axis else (0, 0) for i in range(2)], mode="symmetric")
        a = sum(w * np.take(p, range(i, i + a.shape[axis]), axis=axis) for i, w in enumerate(k))
    return a


def synthesize(mask: np.ndarray, seed: int) -> np.ndarray:
    """A rows x columns x 3 pseudo-image: textured ground, grey roads, sensor noise."""
    rng = np.random.default_rng(seed)
    ground = np.stack([blur(rng.normal(m, 25, mask.shape), 3) for m in (95, 110, 75)], -1)
    road = blur((mask > 0).astype(float), 0.8)[..., None]
    img = ground * (1 - road) + 128 * road + rng.normal(0, 5, (*mask.shape, 3))
    return np.clip(img, 0, 255).astype(np.uint8)


def _turned(rows, cols, at, long: float, wide: float, turn: float) -> np.ndarray:
    """A rectangle around a place, `long` by `wide` pixels, turned."""
    u = (cols - at[1]) * np.cos(turn) + (rows - at[0]) * np.sin(turn)
    v = (rows - at[0]) * np.cos(turn) - (cols - at[1]) * np.sin(turn)
    return (np.abs(u) <= long / 2) & (np.abs(v) <= wide / 2)


def _leaves(img, at, rng, size, rows, cols):
    foot = np.zeros(rows.shape, bool)
    for _ in range(rng.integers(3, 7)):
        away = rng.integers(-size, size + 1, 2)
        foot |= (rows - at[0] - away[0]) ** 2 + (cols - at[1] - away[1]) ** 2 <= rng.integers(max(3, size // 2), size + 1) ** 2
    img[foot] = 0.12 * img[foot] + 0.88 * CANOPY
    return foot


def _shade(img, at, rng, size, rows, cols):
    foot = _turned(rows, cols, at, rng.integers(size, 3 * size + 1), rng.integers(max(2, size // 2), size + 1), rng.uniform(0, np.pi))
    img[foot] = img[foot] * 0.35
    return foot


def _veil(img, at, rng, size, rows, cols):
    wide = float(rng.integers(size, 2 * size + 1))
    veil = np.exp(-((rows - at[0]) ** 2 + (cols - at[1]) ** 2) / (2 * wide * wide)) * (0.6 + 0.8 * blur(rng.random(rows.shape), max(1.0, size / 2)))
    veil = veil.clip(0, 1)
    img[:] = img * (1 - veil[..., None]) + 245 * veil[..., None]
    return veil > 0.30


def _car(img, at, rng, size, rows, cols):
    foot = _turned(rows, cols, at, rng.integers(4, max(6, size // 2) + 1), rng.integers(3, max(5, size // 3) + 1), rng.uniform(0, np.pi))
    img[foot] = VEHICLES[rng.integers(len(VEHICLES))]
    return foot


#: Painters by kind; own kinds are added here. Each paints on the image around a place and gives its footprint.
PAINTERS = {"tree_canopy": _leaves, "building_shadow": _shade, "cloud": _veil, "vehicle": _car}


def paint(img: np.ndarray, kind: str, at, rng, size: int) -> np.ndarray:
    """Paint one occluder around a place, in place; its footprint."""
    if kind not in PAINTERS:
        raise ValueError(f"unknown kind {kind!r}")
    return PAINTERS[kind](img, at, rng, size, *np.indices(img.shape[:2]))


def occlude(img: np.ndarray, mask: np.ndarray, kinds=KINDS, coverage=(0.05, 0.30), prob: float = 0.5, most: int = 50, seed: int = 0, weights=None):
    """(image, occluded, hidden road, share of road hidden, counts by kind); the mask never changes. Occluders stand on road
    pixels, their size follows the image's, their kind the weights, until the drawn share of the road is hidden."""
    if img.ndim != 3 or img.shape[2] != 3:
        raise ValueError("an image has rows, columns and three bands")
    rng = np.random.default_rng(seed)
    out, occluded, counts = img.copy(), np.zeros(mask.shape, bool), dict.fromkeys(kinds, 0)
    road = np.argwhere(mask > 0)
    if len(road) and rng.random() < prob:
        share = np.full(len(kinds), 1.0) if weights is None else np.asarray(weights, float)
        goal, size = rng.uniform(*coverage), max(8, int(0.04 * max(mask.shape)))
        for _ in range(most):
            if (occluded & (mask > 0)).sum() >= goal * len(road):
                break
            kind = kinds[rng.choice(len(kinds), p=share / share.sum())]
            occluded |= paint(out, kind, road[rng.integers(len(road))], rng, max(5, int(size * rng.uniform(0.6, 1.6))))
            counts[kind] += 1
    hidden = occluded & (mask > 0)
    return out, occluded, hidden, float(hidden.sum() / max(1, len(road))), counts


def occlusion_options(config: dict) -> dict:
    """occlude()'s options of a configuration's data.occlusion node."""
    names = {"types": "kinds", "weights": "weights", "coverage_range": "coverage", "apply_prob": "prob", "max_occluders": "most"}
    return {names[k]: tuple(v) if isinstance(v, list) else v for k, v in config.items() if k in names and v is not None}


def tile_seed(tile_id: str, seed: int) -> int:
    return int.from_bytes(hashlib.md5(f"{seed}|{tile_id}".encode()).digest()[:6], "big")


def _run(batches, options):
    import pandas as pd

    for pdf in batches:
        rows = []
        for r in pdf.itertuples():
            mask = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width)
            s = tile_seed(r.tile_id, options["seed"])
            img, occ, hidden, share, counts = occlude(synthesize(mask, s), mask, **{**options, "seed": s})
            rows.append((r.tile_id, img.tobytes(), occ.astype(np.uint8).tobytes(), hidden.astype(np.uint8).tobytes(), share, sum(counts.values()), counts))
        yield pd.DataFrame(rows, columns=["tile_id", "image", "occluded", "hidden", "coverage", "n_occluders", "by_type"])


def occlude_tiles(tiles, **options):
    """tiles (tile_id, height, width, data) with synthetic images and occlusions; seeds depend on tile_id alone."""
    run = partial(_run, options={"seed": 0, **options})
    return tiles.select("tile_id", "height", "width", "data").mapInPandas(run, "tile_id string, image binary, occluded binary, hidden binary, coverage double, n_occluders int, by_type map<string,int>")
