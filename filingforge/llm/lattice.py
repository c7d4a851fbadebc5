"""The E8 lattice: nearest points, and the cells around a point. Arrays have eight numbers in the last axis."""

import itertools

import numpy as np


def shortest_vectors() -> np.ndarray:
    """The 240 lattice points nearest to the origin: to each of them a cell borders on the origin's cell."""
    whole = [np.eye(8)[i] * s + np.eye(8)[j] * t for i, j in itertools.combinations(range(8), 2) for s in (1, -1) for t in (1, -1)]
    halves = [h for h in itertools.product((0.5, -0.5), repeat=8) if sum(h) % 2 == 0]
    return np.array(whole + halves)


def _even_sum(x: np.ndarray) -> np.ndarray:
    """The nearest integer point of even sum: all coordinates rounded, and if their sum is odd, the one farthest off rounded the other way."""
    near = np.rint(x)
    off = x - near
    odd = near.sum(axis=-1) % 2 == 1
    worst = np.abs(off).argmax(axis=-1)[..., None]
    step = np.where(np.take_along_axis(off, worst, -1) >= 0, 1.0, -1.0) * odd[..., None]
    np.put_along_axis(near, worst, np.take_along_axis(near, worst, -1) + step, -1)
    return near


def nearest(x: np.ndarray) -> np.ndarray:
    """The nearest lattice point: E8 is the integer points of even sum and the same points moved by a half in every coordinate."""
    whole, halves = _even_sum(x), _even_sum(x - 0.5) + 0.5
    closer = ((x - whole) ** 2).sum(axis=-1) <= ((x - halves) ** 2).sum(axis=-1)
    return np.where(closer[..., None], whole, halves)
