"""Orthogonal rotations, all of them seeded or fixed. A dimension's square is what is sent to the executors."""

from __future__ import annotations

import numpy as np

LARGEST = 4096


def identity(dim: int) -> np.ndarray:
    return np.eye(dim)


def hadamard(dim: int) -> np.ndarray:
    """(-1) to the number of bits that row and column share, over the root of dim, a power of two."""
    if dim & (dim - 1):
        raise ValueError("a power of two is needed")
    i = np.arange(dim)
    return np.where(np.bitwise_count(i[:, None] & i[None, :]) % 2, -1.0, 1.0) / np.sqrt(dim)


def random_orthogonal(dim: int, seed: int = 42) -> np.ndarray:
    """Q of a matrix of normal numbers."""
    if dim > LARGEST:
        raise ValueError(f"at most {LARGEST} dimensions")
    return np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))[0]


def fixed_bias(dim: int) -> np.ndarray:
    return np.full(dim, 0.5)


def random_bias(dim: int, seed: int = 42) -> np.ndarray:
    return np.random.default_rng(seed).random(dim)
