"""Pixel measures on small previews as higher-order functions on an array of 8-bit grey values (row-major)."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from stillkeep.functions.expr import clamp01, linear_score, weighted_average
from stillkeep.settings import TechnicalSettings


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once for a row; written out, it would be computed wherever body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def luma_of(rgb: Column, pixels: Column) -> Column:
    """8-bit grey of RGB bytes: 0.299 R + 0.587 G + 0.114 B, rounded."""
    byte = lambda k: F.conv(F.hex(F.substring(rgb, k, F.lit(1))), 16, 10).cast("int")
    return F.transform(
        F.sequence(F.lit(0), pixels - 1),
        lambda i: F.floor(byte(i * 3 + 1) * 0.299 + byte(i * 3 + 2) * 0.587 + byte(i * 3 + 3) * 0.114 + 0.5).cast("int"),
    )


def _at(luma: Column, x: Column, y: Column, width: int, height: int) -> Column:
    """The value at a place; beyond a border the picture is mirrored without repeating the edge."""
    mirrored = lambda v, n: F.when(v < 0, -v).when(v >= n, 2 * n - 2 - v).otherwise(v)
    return F.get(luma, mirrored(y, height) * width + mirrored(x, width))


def _filtered(luma: Column, width: int, height: int, kernel: dict[tuple[int, int], int]) -> Column:
    def one(i: Column) -> Column:
        x, y = i % width, F.floor(i / width).cast("int")
        return sum((_at(luma, x + dx, y + dy, width, height) * k for (dx, dy), k in kernel.items()), F.lit(0))

    return F.transform(F.sequence(F.lit(0), F.lit(width * height - 1)), one)


LAPLACE = {(0, -1): 1, (0, 1): 1, (-1, 0): 1, (1, 0): 1, (0, 0): -4}
SOBEL_X = {(-1, -1): -1, (-1, 0): -2, (-1, 1): -1, (1, -1): 1, (1, 0): 2, (1, 1): 1}
SOBEL_Y = {(dy, dx): k for (dx, dy), k in SOBEL_X.items()}


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("bigint"), lambda s, v: s + v)


def _variance(values: Column) -> Column:
    """Population variance by integer sums."""

    def of(v: Column) -> Column:
        n = F.size(v)
        return (n * _sum(F.transform(v, lambda x: x * x)) - _sum(v) * _sum(v)) / (n * n).cast("double")

    return let(values, of)


def laplacian_variance(luma: Column, width: int, height: int) -> Column:
    """On grey in 0..255."""
    return let(luma, lambda g: _variance(_filtered(g, width, height, LAPLACE)))


def technical_measures(luma: Column, width: int, height: int, s: TechnicalSettings) -> dict[str, Column]:
    """The six measures and the global score of previews of one size."""
    n = width * height
    share = lambda test: F.size(F.filter(luma, test)) / F.lit(float(n))
    gx = _sum(F.transform(_filtered(luma, width, height, SOBEL_X), F.abs)) / F.lit(255.0 * n)
    gy = _sum(F.transform(_filtered(luma, width, height, SOBEL_Y), F.abs)) / F.lit(255.0 * n)

    def blurred(g: Column) -> Column:
        even = 1 - clamp01(F.try_divide(F.abs(g["x"] - g["y"]), g["x"] + g["y"]) / s.motion_blur_max_anisotropy)
        return F.when(g["x"] + g["y"] <= s.motion_blur_min_gradient, F.lit(0.0)).otherwise(even)

    out = {
        "sharpness": linear_score(
            laplacian_variance(luma, width, height) * (s.luma_scale / 255) ** 2, s.sharpness_min_variance, s.sharpness_good_variance
        ),
        "exposure": clamp01(1 - F.abs(_sum(luma) / F.lit(255.0 * n) - s.exposure_target) / s.exposure_max_deviation),
        "burned_pixels": 1 - clamp01(share(lambda v: v / 255 >= s.burned_pixel_threshold) / s.burned_pixels_max_fraction),
        "underexposed_pixels": 1 - clamp01(share(lambda v: v / 255 <= s.underexposed_pixel_threshold) / s.underexposed_pixels_max_fraction),
        "contrast": linear_score(F.sqrt(_variance(luma)) / 255, s.contrast_min_stddev, s.contrast_good_stddev),
        "motion_blur": let(F.struct(gx.alias("x"), gy.alias("y")), blurred),
    }
    out["global_score"] = weighted_average([(c, s.weights[k]) for k, c in out.items()])
    return out


def block_means(luma: Column, width: int, height: int, factor: int) -> Column:
    """The preview reduced by an integer factor: block means, rounded half up."""
    w, h = width // factor, height // factor

    def one(i: Column) -> Column:
        x, y = (i % w) * factor, F.floor(i / w).cast("int") * factor
        block = [F.get(luma, (y + dy) * width + x + dx) for dy in range(factor) for dx in range(factor)]
        return F.floor((sum(block[1:], block[0]) * 2 + factor**2) / F.lit(2.0 * factor**2)).cast("int")

    return F.transform(F.sequence(F.lit(0), F.lit(w * h - 1)), one)


def cosine_matrix(n: int) -> list[list[float]]:
    """The orthonormal DCT-II matrix."""
    return [[math.sqrt((1 if u == 0 else 2) / n) * math.cos(math.pi * (2 * x + 1) * u / (2 * n)) for x in range(n)] for u in range(n)]


def dct(luma: Column, n: int) -> Column:
    """Two-dimensional DCT-II of an n x n preview, row-major, as two passes with one matrix of literals."""
    return let(luma, lambda g: _dct(g, n))


def _dct(luma: Column, n: int) -> Column:
    m = F.array(*(F.lit(v) for row in cosine_matrix(n) for v in row))
    cells, steps = F.sequence(F.lit(0), F.lit(n * n - 1)), F.sequence(F.lit(0), F.lit(n - 1))
    zero = F.lit(0.0)
    # rows: out[y, u] = sum over x of luma[y, x] m[u, x]; then columns: out[v, u] = sum over y of rows[y, u] m[v, y]
    rows = F.transform(
        cells, lambda i: F.aggregate(steps, zero, lambda s, x: s + F.get(luma, F.floor(i / n).cast("int") * n + x) * F.get(m, (i % n) * n + x))
    )
    column = lambda r, i: F.aggregate(
        steps, zero, lambda s, y: s + F.get(r, y * n + i % n) * F.get(m, F.floor(i / n).cast("int") * n + y)
    )
    return let(rows, lambda r: F.transform(cells, lambda i: column(r, i)))


def phash_bits(coefficients: Column) -> Column:
    """Whether each coefficient exceeds the median of all but the first."""

    def of(c: Column) -> Column:
        n = F.size(c)
        rest, half = F.array_sort(F.slice(c, F.lit(2), n - 1)), F.floor((n - 1) / 2).cast("int")
        middle = lambda r: F.when((n - 1) % 2 == 1, F.get(r, half)).otherwise((F.get(r, half - 1) + F.get(r, half)) / 2)
        return let(F.coalesce(let(rest, middle), F.lit(0.0)), lambda median: F.transform(c, lambda x: x > median))

    return let(coefficients, of)


def packed(bits: Column) -> Column:
    """64 booleans as a bigint, the first in the lowest bit."""
    powers = F.array(*(F.lit((1 << k) - (1 << 64 if k == 63 else 0)).cast("bigint") for k in range(64)))
    zero = F.lit(0).cast("bigint")
    set_bits = F.zip_with(bits, powers, lambda b, p: F.when(b, p).otherwise(zero))
    return F.aggregate(set_bits, zero, lambda s, x: s.bitwiseOR(x))
