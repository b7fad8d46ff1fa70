"""Transverse Mercator by Krueger's series (to the fourth power of n), for EPSG 4326 and UTM zones 326xx and 327xx."""

from __future__ import annotations

import numpy as np

A, FLAT = 6378137.0, 1 / 298.257223563
K0, E0 = 0.9996, 500000.0
N = FLAT / (2 - FLAT)
R = A / (1 + N) * (1 + N**2 / 4 + N**4 / 64)
ALPHA = (N / 2 - 2 * N**2 / 3 + 5 * N**3 / 16 + 41 * N**4 / 180, 13 * N**2 / 48 - 3 * N**3 / 5 + 557 * N**4 / 1440, 61 * N**3 / 240 - 103 * N**4 / 140, 49561 * N**4 / 161280)
BETA = (N / 2 - 2 * N**2 / 3 + 37 * N**3 / 96 - N**4 / 360, N**2 / 48 + N**3 / 15 - 437 * N**4 / 1440, 17 * N**3 / 480 - 37 * N**4 / 840, 4397 * N**4 / 161280)
DELTA = (2 * N - 2 * N**2 / 3 - 2 * N**3 + 116 * N**4 / 45, 7 * N**2 / 3 - 8 * N**3 / 5 - 227 * N**4 / 45, 56 * N**3 / 15 - 136 * N**4 / 35, 4279 * N**4 / 630)


def zone(epsg: int) -> tuple[float, float]:
    """(central meridian in degrees, false northing)."""
    south = epsg // 100 == 327
    if epsg // 100 not in (326, 327) or not 1 <= epsg % 100 <= 60:
        raise ValueError(f"EPSG:{epsg} isn't a UTM zone")
    return epsg % 100 * 6 - 183.0, 1e7 * south


def to_utm(lon, lat, epsg: int):
    lon0, north0 = zone(epsg)
    phi, lam = np.radians(np.asarray(lat, float)), np.radians(np.asarray(lon, float) - lon0)
    e = 2 * np.sqrt(N) / (1 + N)
    t = np.sinh(np.arctanh(np.sin(phi)) - e * np.arctanh(e * np.sin(phi)))
    xi, eta = np.arctan2(t, np.cos(lam)), np.arctanh(np.sin(lam) / np.sqrt(1 + t * t))
    x, y = eta.copy(), xi.copy()
    for j, a in enumerate(ALPHA, 1):
        x = x + a * np.cos(2 * j * xi) * np.sinh(2 * j * eta)
        y = y + a * np.sin(2 * j * xi) * np.cosh(2 * j * eta)
    return E0 + K0 * R * x, north0 + K0 * R * y


def from_utm(x, y, epsg: int):
    lon0, north0 = zone(epsg)
    xi, eta = (np.asarray(y, float) - north0) / (K0 * R), (np.asarray(x, float) - E0) / (K0 * R)
    u, v = xi.copy(), eta.copy()
    for j, b in enumerate(BETA, 1):
        u = u - b * np.sin(2 * j * xi) * np.cosh(2 * j * eta)
        v = v - b * np.cos(2 * j * xi) * np.sinh(2 * j * eta)
    chi = np.arcsin(np.sin(u) / np.cosh(v))
    phi = chi + sum(d * np.sin(2 * j * chi) for j, d in enumerate(DELTA, 1))
    return lon0 + np.degrees(np.arctan2(np.sinh(v), np.cos(u))), np.degrees(phi)


def reproject(x, y, source: int, target: int):
    lon, lat = (np.asarray(x, float), np.asarray(y, float)) if source == 4326 else from_utm(x, y, source)
    return (lon, lat) if target == 4326 else to_utm(lon, lat, target)


def _moved(batches, source, target):
    for pdf in batches:
        pdf["x2"], pdf["y2"] = reproject(pdf["x"].to_numpy(), pdf["y"].to_numpy(), source, target)
        yield pdf


def with_reprojected(df, source: int, target: int, names=("lon", "lat")):
    """df (x, y) with two more columns, by one Arrow pass."""
    from functools import partial

    ddl = ", ".join(f"`{n}` {t}" for n, t in df.dtypes)
    out = df.mapInPandas(partial(_moved, source=source, target=target), f"{ddl}, x2 double, y2 double")
    return out.withColumnsRenamed({"x2": names[0], "y2": names[1]})
