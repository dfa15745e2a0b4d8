"""Character sequences of a text as numbers."""

from __future__ import annotations

import numpy as np


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def gram_set(text: str) -> np.ndarray:
    """Sorted distinct 3-character sequences as numbers; a text of one or two characters is one sequence."""
    c = code_points(text)
    if len(c) == 0:
        return c
    if len(c) < 3:
        c = np.concatenate([np.zeros(3 - len(c), np.uint64), c])
    return np.unique((c[:-2] << np.uint64(42)) | (c[1:-1] << np.uint64(21)) | c[2:])


def gram_text(number: int) -> str:
    """The characters of a number from :func:`gram_set`."""
    parts = (number >> 42, (number >> 21) & 0x1FFFFF, number & 0x1FFFFF)
    return "".join(chr(p) for p in parts if p)
