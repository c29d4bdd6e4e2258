"""Boxes as four scalar columns: overlap, distance and sizing expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Box:
    x0: Column
    y0: Column
    x1: Column
    y1: Column

    @staticmethod
    def of(prefix: str = "") -> Box:
        return Box(*(F.col(f"{prefix}{c}") for c in ("x0", "y0", "x1", "y1")))

    @property
    def area(self) -> Column:
        return (self.x1 - self.x0).cast("double") * (self.y1 - self.y0)


def intersection(a: Box, b: Box) -> Column:
    w = F.least(a.x1, b.x1) - F.greatest(a.x0, b.x0)
    h = F.least(a.y1, b.y1) - F.greatest(a.y0, b.y0)
    return F.when((w > 0) & (h > 0), w.cast("double") * h).otherwise(0.0)


def share(inner: Box, outer: Box) -> Column:
    """The part of ``inner``'s area that ``outer`` covers."""
    return F.when(inner.area > 0, intersection(inner, outer) / inner.area).otherwise(0.0)


def iou(a: Box, b: Box) -> Column:
    both = intersection(a, b)
    total = a.area + b.area - both
    return F.when(total > 0, both / total).otherwise(0.0)


def overlaps_y(a0: Column, a1: Column, b0: Column, b1: Column, threshold: float = 0.6) -> Column:
    """Vertical overlap over the smaller height exceeds the threshold."""
    height = F.least(a1 - a0, b1 - b0)
    return (height > 0) & (F.greatest(F.least(a1, b1) - F.greatest(a0, b0), F.lit(0)) > threshold * height)


def touches(a: Box, b: Box) -> Column:
    return ~((a.x1 <= b.x0) | (a.x0 >= b.x1) | (a.y1 <= b.y0) | (a.y0 >= b.y1))


def gap_between(a: Box, b: Box) -> Column:
    """Shortest distance of two boxes by edges and corners; 0 if neither side is apart."""
    dx = F.greatest(b.x0 - a.x1, a.x0 - b.x1, F.lit(0))
    dy = F.greatest(b.y0 - a.y1, a.y0 - b.y1, F.lit(0))
    return F.hypot(dx.cast("double"), dy.cast("double"))


def centre_distance(a: Box, b: Box) -> Column:
    return F.hypot((a.x0 + a.x1) / 2 - (b.x0 + b.x1) / 2, (a.y0 + a.y1) / 2 - (b.y0 + b.y1) / 2)


def per_mille(value: Column, size: Column) -> Column:
    """A coordinate in thousandths of the page, truncated."""
    return (value * 1000 / size).cast("int")


def raster_size(points: Column, other: Column, dpi: int = 200, longest: int = 3500) -> Column:
    """Pixels of a page side at ``dpi``, the longer side held to ``longest``, rounded up."""
    scale = F.least(F.lit(dpi / 72.0), F.lit(float(longest)) / F.greatest(points, other))
    return F.ceil(F.round(points * scale, 9)).cast("int")


def detector_side(side: Column, other: Column, limit: int = 960, step: int = 32) -> Column:
    """Side of a detector's input: long side at most ``limit``, half-even multiples of ``step``."""
    ratio = F.least(F.lit(1.0), F.lit(float(limit)) / F.greatest(side, other))
    return F.greatest(F.bround(F.floor(side * ratio) / step, 0) * step, F.lit(step)).cast("int")


def smart_resize(h: Column, w: Column, factor: int = 28, least: int = 56 * 56, most: int = 14 * 14 * 4 * 1280) -> tuple[Column, Column]:
    """(h, w) as half-even multiples of ``factor`` with an area in bounds; errors beyond an aspect of 200."""
    hd, wd = h.cast("double"), w.cast("double")
    near = lambda x: F.greatest(F.bround(x / factor, 0) * factor, F.lit(float(factor)))
    shrink, grow = F.sqrt(hd * wd / most), F.sqrt(F.lit(float(least)) / (hd * wd))
    area = near(hd) * near(wd)
    fit = lambda x: (
        F.when(F.greatest(hd, wd) / F.least(hd, wd) > 200, F.raise_error(F.lit("aspect ratio over 200")).cast("double"))
        .when(area > most, F.greatest(F.floor(x / shrink / factor) * factor, F.lit(factor)))
        .when(area < least, F.ceil(x * grow / factor) * factor)
        .otherwise(near(x))
        .cast("int")
    )
    return fit(hd), fit(wd)
