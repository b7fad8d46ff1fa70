"""Column functions: names, colours, affine maps, formats."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def stem(path) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def plain_path(path) -> Column:
    """A path as it is compared: without the scheme of local files, whose slashes readers write differently."""
    return F.regexp_replace(path, "^file:/+", "/")


def chip_id(name) -> Column:
    """The last '_' token ('-' counts as '_') that starts with a digit, chip or img; else the whole stem."""
    tokens = F.reverse(F.split(F.translate(stem(name), "-", "_"), "_"))
    return F.coalesce(F.get(F.filter(tokens, lambda t: F.lower(t).rlike("^([0-9]|chip|img)")), F.lit(0)), stem(name))


def slug(name) -> Column:
    """What is before the first comma, trimmed, lower case, with '_' for spaces."""
    return F.lower(F.replace(F.trim(F.element_at(F.split(name, ","), 1)), F.lit(" "), F.lit("_")))


def heat_colour(v) -> Column:
    """#rrggbb of a value in 0..1, from blue-grey to red."""
    part = lambda a, b: F.greatest((F.lit(a) + F.lit(b) * v).cast("int"), F.lit(0))
    return F.format_string("#%02x%02x%02x", part(60, 175), part(90, -50), part(210, -170))


def marker_radius(bc, top) -> Column:
    return 2 + 4 * F.when(top > 0, bc / top).otherwise(0.0)


def to_world(row, col, t) -> tuple[Column, Column]:
    """Centre of a pixel by affine t = (a, b, c, d, e, f)."""
    a, b, c, d, e, f = map(float, t)
    return a * (col + 0.5) + b * (row + 0.5) + c, d * (col + 0.5) + e * (row + 0.5) + f


def inverse_affine(t) -> tuple[float, ...]:
    a, b, c, d, e, f = map(float, t)
    det = a * e - b * d
    return e / det, -b / det, (b * f - c * e) / det, -d / det, a / det, (c * d - a * f) / det


def half_diagonal_m(west, south, east, north) -> Column:
    """Half the diagonal of bounds in degrees, in metres; the cosine of the latitude is at least 0.1."""
    lat = F.radians((south + north) / 2)
    dx, dy = (east - west) * 111320.0 * F.greatest(F.cos(lat), F.lit(0.1)), (north - south) * 110540.0
    return F.sqrt(dx * dx + dy * dy) / 2


def fetch_radius(r) -> Column:
    return (r * 1.15).cast("int") + 100


def sigmoid(x) -> Column:
    return 1 / (1 + F.exp(-x))


def or_infinity(v, fmt: str = "%.1f") -> Column:
    return F.when(v == float("inf"), F.lit("∞")).otherwise(F.format_string(fmt, v))
