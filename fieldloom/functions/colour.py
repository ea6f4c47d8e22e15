"""Colours: sRGB to CIELAB and their difference."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the D65 white point and the sRGB to XYZ matrix.
WHITE = (0.95047, 1.0, 1.08883)
XYZ = ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.0721750), (0.0193339, 0.1191920, 0.9503041))


def _linear(channel: Column) -> Column:
    c = channel / 255.0
    return F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, 2.4))


def _curve(t: Column) -> Column:
    return F.when(t > 0.008856, F.cbrt(t)).otherwise(7.787 * t + 16 / 116)


def lab(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    channels = [_linear(c) for c in (r, g, b)]
    x, y, z = (_curve(sum((m * c for m, c in zip(row, channels)), F.lit(0.0)) / w) for row, w in zip(XYZ, WHITE))
    return 116 * y - 16, 500 * (x - y), 200 * (y - z)


def difference(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Euclidean distance in CIELAB."""
    return F.sqrt(sum(((p - q) * (p - q) for p, q in zip(a, b)), F.lit(0.0)))


def excess_green(r: Column, g: Column, b: Column) -> Column:
    return 2 * g - r - b
