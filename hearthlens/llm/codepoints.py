"""Code points of text batches as numpy arrays, folded for character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np


@lru_cache(maxsize=2)
def fold_table(digits: bool) -> np.ndarray:
    """For each code point of the basic plane its lower-case letter (or digit),
    0 for anything else."""
    out = np.zeros(1 << 16, dtype=np.uint32)
    for i in range(1 << 16):
        c = chr(i)
        if c.isalpha() or (digits and c.isdigit()):
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


def fold(points: np.ndarray, digits: bool) -> np.ndarray:
    """Letters (and digits) lower-cased, the rest 0."""
    out = fold_table(digits)[np.minimum(points, 0xFFFF)]
    high = np.flatnonzero(points > 0xFFFF)
    if len(high):
        out[high] = [ord(c) if (c := chr(int(p))).isalpha() else 0 for p in points[high]]
    return out


def runs(texts: list[str | None], limit: int = 1 << 19) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) in runs of about ``limit`` code points; a longer text
    is a run of its own."""
    run, first, size = [], 0, 0
    for i, t in enumerate(texts):
        t = t or ""
        if run and size + len(t) > limit:
            yield first, run
            run, first, size = [], i, 0
        run.append(t)
        size += len(t) + 1
    if run:
        yield first, run


def points(run: list[str], digits: bool, gap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(folded code points, place of each in its run, start of each text).

    Runs of other characters become one 0; ``gap`` zeros follow each text.
    Starts has one entry more than there are texts."""
    sep = "\0" * gap
    raw = np.frombuffer((sep.join(run) + sep).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    f = fold(raw, digits)
    starts = np.cumsum([0] + [len(t) + gap for t in run])
    keep = f != 0
    keep[1:] |= f[:-1] != 0  # the first 0 after a letter stays
    for g in range(gap):
        keep[starts[1:] - 1 - g] = True  # and so do the gaps
    at = np.flatnonzero(keep)
    return f[at], at, np.searchsorted(at, starts)
