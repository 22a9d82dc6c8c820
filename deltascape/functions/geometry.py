"""Geometry of axis-aligned boxes and map coordinates as Column expressions; all of it stays in code generation."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Radius of the sphere of web Mercator, a fixed value.
EARTH = 6378137.0


class Box:
    """A box from four columns, with its measures as expressions."""

    def __init__(self, x0, y0, x1, y1):
        self.x0, self.y0, self.x1, self.y1 = (F.col(v) if isinstance(v, str) else v for v in (x0, y0, x1, y1))

    @classmethod
    def of(cls, prefix: str = "") -> Box:
        """The box in columns <prefix>x0, <prefix>y0, <prefix>x1, <prefix>y1."""
        return cls(*(F.col(f"{prefix}{n}") for n in ("x0", "y0", "x1", "y1")))

    def area(self) -> Column:
        return (self.x1 - self.x0) * (self.y1 - self.y0)

    def distance(self, other: Box) -> Column:
        """Euclidean distance; 0 where the boxes touch or overlap."""
        dx = F.greatest(F.lit(0), other.x0 - self.x1, self.x0 - other.x1)
        dy = F.greatest(F.lit(0), other.y0 - self.y1, self.y0 - other.y1)
        return F.sqrt((dx * dx + dy * dy).cast("double"))

    def intersects(self, other: Box) -> Column:
        return (self.x0 <= other.x1) & (other.x0 <= self.x1) & (self.y0 <= other.y1) & (other.y0 <= self.y1)

    def within(self, other: Box, d: float) -> Column:
        """Whether the distance is at most d."""
        dx = F.greatest(F.lit(0), other.x0 - self.x1, self.x0 - other.x1)
        dy = F.greatest(F.lit(0), other.y0 - self.y1, self.y0 - other.y1)
        return dx * dx + dy * dy <= F.lit(d * d)

    def overlap(self, other: Box) -> Column:
        """Area of the intersection."""
        w = F.least(self.x1, other.x1) - F.greatest(self.x0, other.x0)
        h = F.least(self.y1, other.y1) - F.greatest(self.y0, other.y0)
        return F.when((w > 0) & (h > 0), w * h).otherwise(F.lit(0))

    def iou(self, other: Box) -> Column:
        both = self.overlap(other)
        union = self.area() + other.area() - both
        return F.when(union > 0, both / union).otherwise(0.0)

    def contains(self, x: Column, y: Column) -> Column:
        """Whether a point lies in the box, edges included."""
        return x.between(self.x0, self.x1) & y.between(self.y0, self.y1)


def mercator_x(lon: Column) -> Column:
    return F.lit(EARTH) * F.radians(lon)


def mercator_y(lat: Column) -> Column:
    return F.lit(EARTH) * F.ln(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2))


def longitude(x: Column) -> Column:
    return F.degrees(x / EARTH)


def latitude(y: Column) -> Column:
    return F.degrees(2 * F.atan(F.exp(y / EARTH)) - F.lit(math.pi / 2))


def shoelace(ring: Column) -> Column:
    """Area of a closed ring, an array of structs with x and y, whichever way it turns."""
    ahead = F.slice(ring, F.lit(2), F.size(ring) - 1)
    terms = F.zip_with(F.slice(ring, F.lit(1), F.size(ring) - 1), ahead, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
    return F.abs(F.aggregate(terms, F.lit(0.0), lambda s, t: s + t)) / 2


def tile_range(lon: Column, lat: Column, radius_m: Column | float, zoom: Column | int) -> dict[str, Column]:
    """First and last slippy-map tile in x and y within a ground radius of a point, and a tile's side in map metres.

    Map metres are wider than ground metres by the secant of the latitude; its cosine counts as 0.1 at least.
    """
    zoom = F.lit(zoom) if isinstance(zoom, int) else zoom
    radius = F.lit(float(radius_m)) if isinstance(radius_m, int | float) else radius_m
    tiles = F.pow(F.lit(2.0), zoom)
    half = F.lit(math.pi * EARTH)
    side = 2 * half / tiles
    reach = radius / F.greatest(F.cos(F.radians(lat)), F.lit(0.1))
    x, y = mercator_x(lon) + half, half - mercator_y(lat)
    inside = lambda v: F.greatest(F.lit(0.0), F.least(tiles - 1, F.floor(v / side))).cast("long")
    return {"x_start": inside(x - reach), "x_end": inside(x + reach), "y_start": inside(y - reach), "y_end": inside(y + reach), "side": side}


def pixel_size(a: Column, b: Column, d: Column, e: Column, projected: Column) -> Column:
    """Metres a pixel of an affine grid; 1 where the grid is not projected."""
    return F.when(projected, F.sqrt(F.abs(a * e - b * d))).otherwise(1.0)


def odd_kernel(size_m: Column, px: Column) -> Column:
    """The odd number of pixels nearest to a size, ties to even before it is made odd, 1 at least."""
    n = F.greatest(F.lit(1), F.bround(size_m / px).cast("int"))
    return n + (n + 1) % 2


def window_starts(length: Column, window: int, stride: int) -> Column:
    """Starts of windows that cover a length, the last one flush with its end."""
    last = F.greatest(length - window, F.lit(0))
    return F.array_distinct(F.concat(F.sequence(F.lit(0).cast("long"), last.cast("long"), F.lit(stride).cast("long")), F.array(last.cast("long"))))


def crop_window(x0: Column, y0: Column, x1: Column, y1: Column, origin_x: Column, origin_y: Column, px: Column, width: Column, height: Column, pad: int = 70) -> dict[str, Column]:
    """Pixel window of a map box on a north-up grid, padded and clamped to the image."""
    column, row = lambda x: F.floor((x - origin_x) / px), lambda y: F.floor((origin_y - y) / px)
    low, high = lambda v: F.greatest(F.lit(0), v - pad).cast("long"), lambda v, most: F.least(most, v + pad + 1).cast("long")
    return {"left": low(column(x0)), "top": low(row(y1)), "right": high(column(x1), width), "bottom": high(row(y0), height)}
