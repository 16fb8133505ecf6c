"""Affine maps between pixels and the world: six numbers, of which the first three give x from column and row, the others y."""

from __future__ import annotations

from pyspark.sql import Column

Affine = tuple[float, float, float, float, float, float]


def to_world(gt: Affine, col: Column | float, row: Column | float) -> tuple:
    return gt[0] + col * gt[1] + row * gt[2], gt[3] + col * gt[4] + row * gt[5]


def inverse(gt: Affine) -> Affine:
    """The map from world to pixels."""
    det = gt[1] * gt[5] - gt[2] * gt[4]
    if abs(det) < 1e-300:
        raise ValueError("GEOTRANSFORM_NOT_INVERTIBLE")
    a, b, d, e = gt[5] / det, -gt[2] / det, -gt[4] / det, gt[1] / det
    return -a * gt[0] - b * gt[3], a, b, -d * gt[0] - e * gt[3], d, e


def to_pixel(gt: Affine, x: Column | float, y: Column | float) -> tuple:
    return to_world(inverse(gt), x, y)


def part(gt: Affine, col: int, row: int) -> Affine:
    """The map of a window that begins at a column and row."""
    x, y = to_world(gt, col, row)
    return x, gt[1], gt[2], y, gt[4], gt[5]
