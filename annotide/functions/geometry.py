"""Vectors, angles, colours and hashes as column expressions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector is zero."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def distance(a: Column, b: Column) -> Column:
    square = lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))
    return F.sqrt(F.aggregate(F.zip_with(a, b, square), F.lit(0.0), lambda s, v: s + v))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def mask_iou(a: Column, b: Column, eps: float = 1e-7) -> Column:
    """Common by joint size of two flat 0/1 masks."""
    size = lambda m: F.aggregate(m, F.lit(0.0), lambda s, v: s + v)
    common = dot(a, b)
    return common / (size(a) + size(b) - common + eps)


def structural_similarity(a: Column, b: Column, span: float = 1.0) -> Column:
    """SSIM over one window: the whole of two equally long arrays of values that span ``span``."""
    n = F.size(a)
    mean = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double")) / n
    spread = lambda x, y: dot(x, y) / n - mean(x) * mean(y)
    c1, c2 = (0.01 * span) ** 2, (0.03 * span) ** 2
    light = (2 * mean(a) * mean(b) + c1) / (mean(a) * mean(a) + mean(b) * mean(b) + c1)
    return light * (2 * spread(a, b) + c2) / (spread(a, a) + spread(b, b) + c2)


def mirrored(image: Column, width: int) -> Column:
    """A flat image with left and right exchanged."""
    places = F.sequence(F.lit(0), F.size(image) - 1)
    return F.transform(places, lambda k: F.get(image, (k - k % width + (width - 1 - k % width)).cast("int")))


def quarter_turned(image: Column, width: int) -> Column:
    """A flat square image turned by a quarter, clockwise."""
    places = F.sequence(F.lit(0), F.size(image) - 1)
    return F.transform(places, lambda k: F.get(image, ((width - 1 - k % width) * width + F.floor(k / width)).cast("int")))


def phase_response(a: Column, b: Column, width: int) -> Column:
    """The height of the peak of the phase correlation of two flat images, 1 for one that is the other shifted around.

    0 for images of other sizes, or without any contrast.
    """

    def peak(x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for p, q in zip(x, y, strict=True):
            if p is None or q is None or len(p) != len(q) or not len(p) or len(p) % width:
                out.append(0.0)
                continue
            p, q = (np.asarray(v, float).reshape(-1, width) for v in (p, q))
            cross = np.fft.fft2(p - p.mean()) * np.conj(np.fft.fft2(q - q.mean()))
            size = np.abs(cross)
            strong = size > 1e-12 * max(size.max(), 1e-300)
            unit = np.where(strong, cross / np.where(strong, size, 1), 0)
            out.append(float(np.fft.ifft2(unit).real.max() * unit.size / max(1, strong.sum())))
        return pd.Series(out)

    return F.pandas_udf(peak, "double")(a, b)


def best_class(scores: Column) -> Column:
    """The class of the largest score and that score, as struct cls, conf; the first of equal ones."""
    top = F.array_max(scores)
    return F.struct((F.array_position(scores, top) - 1).cast("int").alias("cls"), top.cast("double").alias("conf"))


def surface_normal(a: Column, b: Column, c: Column, d: Column, resolution: float) -> Column:
    """The unit normal x, y, z of a 2 x 2 cell of heights (a b above c d)."""
    dx, dy = ((b + d) - (a + c)) / (2 * resolution), ((c + d) - (a + b)) / (2 * resolution)
    size = F.sqrt(dx * dx + dy * dy + 1.0)
    return F.array(-dx / size, -dy / size, 1.0 / size)


def lambert(normal: Column, azimuth: float, elevation: float) -> Column:
    """Brightness of a surface under light from an azimuth and an elevation in degrees; 0 in the shade."""
    a, e = math.radians(azimuth), math.radians(elevation)
    light = (math.cos(e) * math.sin(a), math.cos(e) * math.cos(a), math.sin(e))
    return F.greatest(F.lit(0.0), sum((F.get(normal, k) * v for k, v in enumerate(light)), F.lit(0.0)))


def luminance(r: Column, g: Column, b: Column) -> Column:
    """Relative luminance of 8-bit channels."""
    linear = lambda c: F.when(c / 255 <= 0.03928, c / 255 / 12.92).otherwise(F.pow((c / 255 + 0.055) / 1.055, 2.4))
    return 0.2126 * linear(r) + 0.7152 * linear(g) + 0.0722 * linear(b)


def panorama_pixel(x: Column, y: Column, z: Column, width: int, height: int) -> tuple[Column, Column]:
    """Pixel of a direction in an equirectangular image; the left edge is straight back."""
    radius = F.sqrt(x * x + y * y + z * z)
    column = F.floor((F.atan2(y, x) + math.pi) / (2 * math.pi) * width)
    row = F.floor((math.pi / 2 - F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), z / radius)))) / math.pi * height)
    return F.pmod(column, F.lit(width)), F.least(row, F.lit(height - 1))


def rotated(x: Column, y: Column, z: Column, roll: float, pitch: float, yaw: float) -> tuple[Column, Column, Column]:
    """A vector turned about x, then y, then z, by radians."""
    y, z = y * math.cos(roll) - z * math.sin(roll), y * math.sin(roll) + z * math.cos(roll)
    x, z = x * math.cos(pitch) + z * math.sin(pitch), z * math.cos(pitch) - x * math.sin(pitch)
    return x * math.cos(yaw) - y * math.sin(yaw), x * math.sin(yaw) + y * math.cos(yaw), z


def box_edges(low: tuple[Column, Column, Column], high: tuple[Column, Column, Column], points: int) -> Column:
    """Points on the twelve edges of a 3-D box, an array of structs."""
    share = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda k: k / max(1, points - 1))
    names = ("x", "y", "z")

    def along(axis: int, fixed: dict):
        def point(s: Column) -> Column:
            place = [low[a] + s * (high[a] - low[a]) if a == axis else fixed[a][a] for a in range(3)]
            return F.struct(*[c.cast("double").alias(n) for c, n in zip(place, names, strict=True)])

        return point

    edges = []
    for axis in range(3):
        others = [a for a in range(3) if a != axis]
        for corner in range(4):
            fixed = {others[0]: (low, high)[corner % 2], others[1]: (low, high)[corner // 2]}

            edges.append(F.transform(share, along(axis, fixed)))
    return F.flatten(F.array(*edges))
