"""The registered distances on numpy arrays: one histogram against many, summed over bands. For tasks that hold whole blocks."""

from __future__ import annotations

import numpy as np

from bandwright.functions.distances import FLOOR, REGISTRY


def smooth(h: np.ndarray) -> np.ndarray:
    raised = np.maximum(0.0, FLOOR - h).sum(axis=-1, keepdims=True)
    return np.maximum(h, FLOOR) / (1 + raised)


def position(h: np.ndarray) -> np.ndarray:
    return np.arange(h.shape[-1]) / max(1, h.shape[-1] - 1)


def _half(a, b):
    return (a + b) / 2


#: a: bands x bins, b: rows x bands x bins; a value for each row and band.
BY_BAND = {
    "kl": lambda a, b: (a * np.log2(a / b)).sum(-1),
    "jeffreys": lambda a, b: ((a - b) * np.log2(a / b)).sum(-1),
    "expected_value": lambda a, b: np.abs((a * position(a)).sum(-1) - (b * position(b)).sum(-1)),
    "expected_diff": lambda a, b: (np.abs(a - b) * position(a)).sum(-1),
    "k": lambda a, b: (a * np.log(2 * a / (a + b))).sum(-1),
    "hellinger": lambda a, b: np.sqrt(np.maximum(0.0, 1 - np.sqrt(a * b).sum(-1))),
    "euclidean": lambda a, b: np.sqrt(((a - b) ** 2).sum(-1)),
    "jensen": lambda a, b: ((a * np.log(a) + b * np.log(b)) / 2 - _half(a, b) * np.log(_half(a, b))).sum(-1),
}


def prepared(h: np.ndarray, name: str) -> np.ndarray:
    return smooth(h) if REGISTRY[name][2] else h


def distances(a: np.ndarray, b: np.ndarray, name: str) -> np.ndarray:
    """Distance of one prepared histogram to each of many."""
    return BY_BAND[name](a, b).sum(axis=-1)
