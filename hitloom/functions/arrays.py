"""Geometry on numpy arrays, for the searches inside one event."""

from __future__ import annotations

import numpy as np


def material_way(a: np.ndarray, b: np.ndarray, inner: float) -> np.ndarray:
    """Length of the ways from ``a`` to ``b`` (..., 3) in the material around a hollow sphere, as :func:`geometry.shell_distance`."""
    step = b - a
    length = np.sqrt(np.einsum("...i,...i->...", step, step))
    middle = -np.einsum("...i,...i->...", a, step) / np.maximum(length, 1e-10)
    half = np.sqrt(np.maximum(middle**2 - np.einsum("...i,...i->...", a, a) + inner**2, 0))
    return length - np.maximum(0, np.minimum(length, middle + half) - np.maximum(0, middle - half))
