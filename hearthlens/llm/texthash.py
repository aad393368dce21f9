"""Vectorised text hashing inside Arrow batches (numpy, one pass over bytes).

Hashes are 64 bit; two different words or shingles share a hash with a chance
of about 2**-64 per pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
#: odd multipliers of the words of a shingle, by place
_PLACE = np.array([(0xD6E8FEB86659FD93 * (2 * k + 1) ** 5 | 1) & _MASK for k in range(16)], dtype=U)
#: A-Z to a-z, blanks (space, 0x09-0x0D) to 0, every other byte to itself + 1
_FOLD = np.arange(1, 257, dtype=np.uint16)
_FOLD[65:91] += 32
_FOLD[[32, 9, 10, 11, 12, 13]] = 0


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift, multiply)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@lru_cache(maxsize=3)
def _powers_to(bits: int) -> tuple[np.ndarray, np.ndarray]:
    n = 1 << bits
    inv = pow(_BASE, -1, 1 << 64)
    with np.errstate(over="ignore"):
        up, down = np.full(n, U(_BASE)), np.full(n, U(inv))
        up[0] = down[0] = U(1)
        return np.multiply.accumulate(up), np.multiply.accumulate(down)


def planes(x: np.ndarray) -> bytes:
    """Bytes by significance, so that small numbers compress well."""
    return x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes()


def unplanes(b: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(size, -1).T).view(dtype).ravel()


def pack_sorted(x: np.ndarray) -> bytes:
    """Ascending hashes as gaps in planes."""
    return planes(np.diff(x, prepend=U(0)))


def unpack_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(unplanes(b, U), dtype=U)


def text_chunks(texts: list[str | None], limit: int = 1 << 19) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, UTF-8 texts) in runs of about ``limit`` bytes; a longer
    text is a run of its own."""
    run, first, size = [], 0, 0
    for i, t in enumerate(texts):
        b = t.encode("utf-8", "surrogatepass") if t else b""
        if run and size + len(b) > limit:
            yield first, run
            run, first, size = [], i, 0
        run.append(b)
        size += len(b) + 1
    if run:
        yield first, run


def word_hashes(run: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, offsets): words between ASCII blanks with A-Z
    lower-cased; words of text i are ``hashes[offsets[i]:offsets[i + 1]]``."""
    buf = np.frombuffer(b" ".join(run) + b" ", dtype=np.uint8)
    v = _FOLD[buf]
    word = v != 0
    edge = np.flatnonzero(word[1:] != word[:-1]) + 1
    if word[0]:
        edge = np.concatenate([[0], edge])
    s, e = edge[0::2], edge[1::2]
    up, down = _powers_to(max(20, int(len(buf)).bit_length()))
    acc = np.zeros(len(buf) + 1, dtype=U)
    np.cumsum(v.astype(U) * up[: len(buf)], out=acc[1:])
    h = mix((acc[e] - acc[s]) * down[s] + U(0x51ED270B) * (e - s).astype(U))
    starts = np.cumsum([0] + [len(b) + 1 for b in run])
    return h, np.searchsorted(s, starts)


def shingle_sets(run: list[bytes], k: int = 5) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its k-word shingles; with
    fewer words the whole sequence is one, without words there is none."""
    h, off = word_hashes(run)
    n = len(h)
    if n >= k:
        roll = h[: n - k + 1] * _PLACE[0]
        for j in range(1, k):
            roll = roll + h[j : n - k + 1 + j] * _PLACE[j]
        roll = mix(roll)
    else:
        roll = np.zeros(0, dtype=U)
    for i in range(len(run)):
        a, b = off[i], off[i + 1]
        if b - a >= k:
            x = np.sort(roll[a : b - k + 1])
            yield x[np.concatenate([[True], x[1:] != x[:-1]])]
        elif b > a:
            short = (h[a:b] * _PLACE[: b - a]).sum(dtype=U, keepdims=True)
            yield mix(short + np.array([b - a], dtype=U) * U(0xA24BAED4963EE407))
        else:
            yield np.zeros(0, dtype=U)
