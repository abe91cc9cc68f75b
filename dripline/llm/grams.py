"""Hashed character n-grams of whole texts, with numpy."""

from __future__ import annotations

import functools

import numpy as np

from dripline.llm.support import mix, powers

_BASE = np.uint64(0x100000001B3)
_SPACE = 0x20


@functools.cache
def letters() -> np.ndarray:
    """For every code point, whether it is a letter."""
    return np.array([chr(i).isalpha() for i in range(0x110000)], dtype=bool)


def code_points(text: str) -> np.ndarray:
    """The lower-cased text as code points; a lone surrogate counts as a question mark."""
    data = text.lower().encode("utf-32-le", "replace")
    return np.frombuffer(data, dtype=np.uint32) if data else np.zeros(0, np.uint32)


def letter_text(text: str) -> np.ndarray:
    """The letters of a lower-cased text, each run of other characters as one space, spaces around.

    Empty if there is no letter.
    """
    points = code_points(text)
    inside = letters()[points]
    if not inside.any():
        return np.zeros(0, np.uint32)
    points = np.where(inside, points, _SPACE).astype(np.uint32)
    keep = inside.copy()
    keep[1:] |= inside[:-1]  # the first space behind a letter stays
    points = points[keep]
    edge = np.array([_SPACE], dtype=np.uint32)
    tail = edge[: int(points[-1] != _SPACE)]
    return np.concatenate([edge, points, tail])


def gram_buckets(points: np.ndarray, sizes: tuple[int, ...], bits: int) -> np.ndarray:
    """The buckets (of 2 ** bits) of all n-grams of the given sizes, with repetition."""
    values = points.astype(np.uint64) + np.uint64(1)
    found = []
    sums = np.zeros(len(values), dtype=np.uint64)
    for i, factor in enumerate(powers(_BASE, max(sizes))):
        n = len(values) - i
        if n <= 0:
            break
        sums = sums[:n] + values[i:] * factor
        if i + 1 in sizes:
            found.append(mix(sums + np.uint64(i)) >> np.uint64(64 - bits))
    return np.concatenate(found).astype(np.int64) if found else np.zeros(0, np.int64)
