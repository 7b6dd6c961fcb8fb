"""The E8 lattice: nearest points, and the next nearest ones, of arrays of points."""

from __future__ import annotations

import numpy as np


def _even(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest point of D8 (whole numbers with an even sum), and the one beside it.

    Where rounding gives an odd sum, the coordinate with the largest error goes to its second
    whole number; the point beside it moves the coordinate with the next largest error instead,
    or where the sum is even, both.
    """
    near = np.rint(points)
    error = points - near
    step = np.where(error >= 0, 1.0, -1.0)
    order = np.argsort(-np.abs(error), axis=-1, kind="stable")
    rows = np.arange(len(points))
    odd = (near.sum(axis=-1) % 2 != 0)
    first, second = near.copy(), near.copy()
    a, b = order[:, 0], order[:, 1]
    first[rows[odd], a[odd]] += step[rows[odd], a[odd]]
    second[rows[odd], b[odd]] += step[rows[odd], b[odd]]
    second[rows[~odd], a[~odd]] += step[rows[~odd], a[~odd]]
    second[rows[~odd], b[~odd]] += step[rows[~odd], b[~odd]]
    return first, second


def nearest_points(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Four lattice points near each point, nearest first, and their squared distances.

    Points have eight coordinates; results have the shape (points, 4, 8), with every coordinate
    doubled so that it is a whole number. The first is the lattice point nearest of all.
    """
    a, b = _even(points)
    c, d = _even(points - 0.5)
    found = np.stack([a, b, c + 0.5, d + 0.5], axis=1)
    far = ((found - points[:, None, :]) ** 2).sum(axis=-1)
    order = np.argsort(far, axis=1, kind="stable")
    found = np.take_along_axis(found, order[:, :, None], axis=1)
    return (2 * found).astype(np.int64), np.take_along_axis(far, order, axis=1)
