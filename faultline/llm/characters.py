"""Classes of code points, and texts as arrays of them."""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

import numpy as np

LETTER, NUMBER, OTHER, SPACE = range(4)
# Code points with the Unicode property White_Space.
WHITE_SPACE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@cache
def classes() -> np.ndarray:
    """The class of every code point."""
    major = (unicodedata.category(chr(c))[0] for c in range(sys.maxunicode + 1))
    table = np.fromiter(({"L": LETTER, "N": NUMBER}.get(m, OTHER) for m in major), np.uint8)
    table[WHITE_SPACE] = SPACE
    return table


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes, the byte at which each begins, and the first of each text."""
    begins = np.flatnonzero((data & 0xC0) != 0x80)
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    return points, begins, np.searchsorted(begins, offsets)


@cache
def folded() -> np.ndarray:
    """Lower case of every letter where that is one code point; a space for all else."""
    table = np.arange(sys.maxunicode + 1, dtype=np.uint32)
    for c in np.flatnonzero(classes() == LETTER).tolist():
        low = chr(c).lower()
        if len(low) == 1:
            table[c] = ord(low)
    table[classes() != LETTER] = 32
    return table
