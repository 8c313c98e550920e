"""Box arithmetic as column expressions (pixel or normalised xyxy boxes)."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, functions as F


class Box(NamedTuple):
    x1: Column
    y1: Column
    x2: Column
    y2: Column


def box(prefix: str = "", alias: str | None = None) -> Box:
    """The box held in columns ``<prefix>x1 .. <prefix>y2`` of ``alias``."""
    head = f"{alias}." if alias else ""
    return Box(*(F.col(f"{head}{prefix}{c}") for c in ("x1", "y1", "x2", "y2")))


def width(b: Box) -> Column:
    return b.x2 - b.x1


def height(b: Box) -> Column:
    return b.y2 - b.y1


def area(b: Box) -> Column:
    return width(b) * height(b)


def center_x(b: Box) -> Column:
    return (b.x1 + b.x2) / F.lit(2.0)


def center_y(b: Box) -> Column:
    return (b.y1 + b.y2) / F.lit(2.0)


def to_xywh(b: Box) -> Column:
    """Center form."""
    return F.array(center_x(b), center_y(b), width(b), height(b))


def to_tlwh(b: Box) -> Column:
    """Top-left form."""
    return F.array(b.x1, b.y1, width(b), height(b))


def normalise(b: Box, frame_w: Column, frame_h: Column) -> Box:
    return Box(b.x1 / frame_w, b.y1 / frame_h, b.x2 / frame_w, b.y2 / frame_h)


def denormalise(b: Box, frame_w: Column, frame_h: Column) -> Box:
    """Back to whole pixels; fractions are cut off, not rounded."""
    return Box(*((v * side).cast("int") for v, side in zip(b, (frame_w, frame_h, frame_w, frame_h))))


def clip(b: Box, frame_w: Column, frame_h: Column) -> Box:
    """Whole-pixel crop window inside the frame."""
    return Box(
        F.greatest(F.lit(0), b.x1.cast("int")), F.greatest(F.lit(0), b.y1.cast("int")),
        F.least(frame_w, b.x2.cast("int")), F.least(frame_h, b.y2.cast("int")),
    )


def intersection(a: Box, b: Box) -> Column:
    zero = F.lit(0.0)
    return (F.greatest(zero, F.least(a.x2, b.x2) - F.greatest(a.x1, b.x1))
            * F.greatest(zero, F.least(a.y2, b.y2) - F.greatest(a.y1, b.y1)))


def _share(part: Column, whole: Column) -> Column:
    return F.when((part > 0) & (whole > 0), part / whole).otherwise(F.lit(0.0))


def iou(a: Box, b: Box) -> Column:
    shared = intersection(a, b)
    return _share(shared, area(a) + area(b) - shared)


def covered(a: Box, b: Box) -> Column:
    """Share of ``a`` that lies in ``b``; also the overlap of a zone ``b`` with a box ``a``."""
    return _share(intersection(a, b), area(a))


def smaller_covered(a: Box, b: Box) -> Column:
    """Containment of whichever box is smaller."""
    return F.greatest(covered(a, b), covered(b, a))
