"""Box and point geometry as column expressions; nothing is rounded."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

def box(prefix: str = "") -> tuple[Column, Column, Column, Column]:
    """The four corner columns, of the table alias given."""
    at = f"{prefix}." if prefix else ""
    return tuple(F.col(f"{at}{c}") for c in ("x1", "y1", "x2", "y2"))  # type: ignore[return-value]


def area(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return (x2 - x1) * (y2 - y1)


def center(x1: Column, y1: Column, x2: Column, y2: Column) -> tuple[Column, Column]:
    return (x1 + x2) / 2, (y1 + y2) / 2


def bottom_center(x1: Column, y1: Column, x2: Column, y2: Column) -> tuple[Column, Column]:
    return (x1 + x2) / 2, y2


def xyxy_to_xywh(x1: Column, y1: Column, x2: Column, y2: Column) -> tuple[Column, ...]:
    return x1, y1, x2 - x1, y2 - y1


def xywh_to_xyxy(x: Column, y: Column, w: Column, h: Column) -> tuple[Column, ...]:
    return x, y, x + w, y + h


def yolo_to_xywh(xc: Column, yc: Column, w: Column, h: Column, width: Column, height: Column) -> tuple[Column, ...]:
    """Normalised centre and size to pixels of the corner and size; nothing is clipped."""
    return xc * width - w * width / 2, yc * height - h * height / 2, w * width, h * height


def scaled(x1: Column, y1: Column, x2: Column, y2: Column, factor: float) -> tuple[Column, ...]:
    cx, cy = center(x1, y1, x2, y2)
    rx, ry = (x2 - x1) * factor / 2, (y2 - y1) * factor / 2
    return cx - rx, cy - ry, cx + rx, cy + ry


def padded(x1: Column, y1: Column, x2: Column, y2: Column, px: float, py: float | None = None) -> tuple[Column, ...]:
    py = px if py is None else py
    return x1 - px, y1 - py, x2 + px, y2 + py


def clipped(x1: Column, y1: Column, x2: Column, y2: Column, width: float, height: float) -> tuple[Column, ...]:
    def within(v: Column, most: float) -> Column:
        return F.greatest(F.lit(0.0), F.least(v, F.lit(float(most))))

    return within(x1, width), within(y1, height), within(x2, width), within(y2, height)


def inside(px: Column, py: Column, target: tuple[Column, ...]) -> Column:
    """Whether a point is in a box, its border included."""
    x1, y1, x2, y2 = target
    return (x1 <= px) & (px <= x2) & (y1 <= py) & (py <= y2)


def intersection(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    w = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.greatest(F.lit(0.0), w) * F.greatest(F.lit(0.0), h)


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def iou(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    part = intersection(a, b)
    return _ratio(part, area(*a) + area(*b) - part)


def ios(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Intersection over the smaller of the two areas."""
    return _ratio(intersection(a, b), F.least(area(*a), area(*b)))


def projected(m: Column, x: Column, y: Column) -> tuple[Column, Column]:
    """A point through a 3 x 3 matrix held as an array of nine, row by row."""
    w = m[6] * x + m[7] * y + m[8]
    return (m[0] * x + m[1] * y + m[2]) / w, (m[3] * x + m[4] * y + m[5]) / w


def hex_channels(color: Column) -> tuple[Column, Column, Column]:
    """Red, green and blue of '#rrggbb'."""
    digits = F.replace(color, F.lit("#"), F.lit(""))
    return tuple(F.conv(F.substring(digits, at, 2), 16, 10).cast("int") for at in (1, 3, 5))  # type: ignore[return-value]
