"""Boxes. A box is four Columns x, y, w, h (top left) unless a name says otherwise."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Box(NamedTuple):
    x: Column
    y: Column
    w: Column
    h: Column

    def struct(self) -> Column:
        return F.struct(*[c.cast("double").alias(n) for n, c in zip("xywh", self)])


def of_array(c: Column) -> Box:
    """The box in an array; null entries or short arrays give nulls."""
    return Box(*[F.get(c, i) for i in range(4)])


def usable(b: Box) -> Column:
    """Four numbers and a positive size; never null."""
    return F.coalesce((b.w > 0) & (b.h > 0) & b.x.isNotNull() & b.y.isNotNull(), F.lit(False))


def corners(b: Box) -> Box:
    return Box(b.x, b.y, b.x + b.w, b.y + b.h)


def from_corners(b: Box) -> Box:
    return Box(b.x, b.y, b.w - b.x, b.h - b.y)


def out_of_bounds(b: Box, width: Column, height: Column) -> Column:
    return (b.x < 0) | (b.y < 0) | (b.x + b.w > width) | (b.y + b.h > height)


def iou(a: Box, b: Box) -> Column:
    """Shared area over joint area of two top-left boxes; 0 if the joint area isn't positive."""
    width = F.greatest(F.least(a.x + a.w, b.x + b.w) - F.greatest(a.x, b.x), F.lit(0.0))
    height = F.greatest(F.least(a.y + a.h, b.y + b.h) - F.greatest(a.y, b.y), F.lit(0.0))
    both = width * height
    joint = a.w * a.h + b.w * b.h - both
    return F.when(joint > 0, both / joint).otherwise(0.0)


def letterbox(width: Column, height: Column, to_w: int, to_h: int) -> tuple[Column, Column, Column]:
    """(scale, left, top) of an image fitted into to_w x to_h."""
    scale = F.least(F.lit(float(to_w)) / width, F.lit(float(to_h)) / height)
    left = F.floor((F.lit(to_w) - (width * scale).cast("int")) / 2)
    top = F.floor((F.lit(to_h) - (height * scale).cast("int")) / 2)
    return scale, left, top


def remapped(b: Box, scale: Column, left: Column, top: Column) -> Box:
    return Box(b.x * scale + left, b.y * scale + top, b.w * scale, b.h * scale)


def normalised_centre(b: Box, width: Column, height: Column) -> Box:
    """Centre and size as shares of the image, kept within 0 and 1."""
    clip = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    return Box(clip((b.x + b.w / 2) / width), clip((b.y + b.h / 2) / height), clip(b.w / width), clip(b.h / height))


def zoomed(b: Box, width: Column, height: Column, pad: float = 0.2, least: float = 50.0) -> Box:
    """The window around a box, padded on each side and cut at the image, as corners."""
    px, py = F.greatest(b.w * pad, F.lit(least)), F.greatest(b.h * pad, F.lit(least))
    return Box(F.greatest(b.x - px, F.lit(0.0)), F.greatest(b.y - py, F.lit(0.0)), F.least(b.x + b.w + px, width), F.least(b.y + b.h + py, height))


def nudged(b: Box, width: Column, height: Column, dx: Column, dy: Column, scale: Column) -> Box:
    """Shifted by shares of its own size, rescaled about its new centre (0.1 at least),
    kept within the image. Unusable boxes give nulls. Rounded half up to one place."""
    s = F.greatest(scale, F.lit(0.1))
    w, h = F.least(b.w * s, width.cast("double")), F.least(b.h * s, height.cast("double"))
    x = F.greatest(F.lit(0.0), F.least(b.x + b.w / 2 + dx * b.w - w / 2, width - w))
    y = F.greatest(F.lit(0.0), F.least(b.y + b.h / 2 + dy * b.h - h / 2, height - h))
    ok = usable(b)
    return Box(*[F.when(ok, F.round(c, 1)) for c in (x, y, w, h)])


def box_error(c: Column) -> Column:
    """Why an array is no usable box, null if it is one."""
    b = of_array(c)
    whole = F.coalesce(F.size(c) == 4, F.lit(False)) & b.x.isNotNull() & b.y.isNotNull() & b.w.isNotNull() & b.h.isNotNull()
    return F.when(~whole, "the box must be x, y, w, h").when((b.w <= 0) | (b.h <= 0), "width and height must be positive")


def mirrored(b: Box, width: Column, height: Column, quadrant: Column) -> Box:
    """The window across the vertical midline, within the jaw of the quadrant, as
    corners of whole pixels; nulls if nothing of it is left."""
    x, y, w, h = (c.cast("int") for c in b)
    middle = F.floor(height / 2).cast("int")
    upper = quadrant.isin(1, 2)
    x1, x2 = F.greatest(width - x - w, F.lit(0)), F.least(width - x, width)
    y1 = F.when(upper, F.greatest(y, F.lit(0))).otherwise(F.greatest(middle, y))
    y2 = F.when(upper, F.least(middle, y + h)).otherwise(F.least(height, y + h))
    ok = (x2 > x1) & (y2 > y1)
    return Box(*[F.when(ok, c) for c in (x1, y1, x2, y2)])


def flipped(b: Box, width: Column) -> Box:
    return Box(width - b.x - b.w, b.y, b.w, b.h)


def from_centre(b: Box, left: Column, top: Column, width: Column, height: Column, pad: float = 0.2) -> Box:
    """A detector's centre box as a padded top-left box of the whole image."""
    x = F.greatest(b.x - b.w / 2 + left - b.w * pad / 2, F.lit(0.0))
    y = F.greatest(b.y - b.h / 2 + top - b.h * pad / 2, F.lit(0.0))
    return Box(F.round(x, 1), F.round(y, 1), F.round(F.least(b.w * (1 + pad), width - x), 1), F.round(F.least(b.h * (1 + pad), height - y), 1))


def search_window(b: Box, width: Column, height: Column, times: float = 2.5) -> Box:
    """The area several times a hint's size, cut at the image, as corners; nulls if empty."""
    more = (times - 1) / 2
    x1, y1 = F.greatest(b.x - b.w * more, F.lit(0.0)), F.greatest(b.y - b.h * more, F.lit(0.0))
    x2, y2 = F.least(b.x + b.w * (1 + more), width.cast("double")), F.least(b.y + b.h * (1 + more), height.cast("double"))
    ok = (x2 > x1) & (y2 > y1)
    return Box(*[F.when(ok, c) for c in (x1, y1, x2, y2)])


def perturbation(roll: Column, size: Column, big: tuple[float, float, float] = (0.30, 0.45, 0.75), small: tuple[float, float, float] = (0.25, 0.12, 0.28)) -> tuple[Column, Column]:
    """(tier, shift) from two uniform numbers: with the first probability a big shift,
    with the next a small one, else none. The sign is that of the size's halves."""
    tier = F.when(roll < big[0], F.lit("big")).when(roll < big[0] + small[0], F.lit("small")).otherwise(F.lit("none"))
    along = F.abs(size * 2 - 1)
    sign = F.when(size < 0.5, -1.0).otherwise(1.0)
    shift = F.when(tier == "big", big[1] + (big[2] - big[1]) * along).when(tier == "small", small[1] + (small[2] - small[1]) * along).otherwise(0.0)
    return tier, shift * sign
