"""Vectorised hashing of words and shingles over the UTF-8 bytes of many texts."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

U = np.uint64
#: A-z for A-Z, and the bytes that end words (space, tab to carriage return).
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)
#: Bytes hashed at once, for arrays that stay in the processor's cache.
CHUNK = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """Splitmix's finaliser: a bijection of 64-bit words."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, BASE, dtype=U), np.full(n, BASE_INVERSE, dtype=U)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _sized(n: int) -> int:
    size = CHUNK * 2
    while size < n:
        size *= 2
    return size


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts (A-Z lowered, ASCII white space between),
    and the offsets at which each text's words begin, with the end appended."""
    data = b" ".join([*texts, b""]).translate(LOWER)
    raw = np.frombuffer(data, dtype=np.uint8)
    ends_at = np.cumsum([len(t) + 1 for t in texts])
    if not len(raw):
        return np.zeros(0, dtype=U), np.zeros(len(texts) + 1, dtype=np.int64)
    inside = np.zeros(len(raw) + 2, dtype=np.int8)
    inside[1:-1] = ~SPACE[raw]
    turn = np.flatnonzero(np.diff(inside))
    starts, ends = turn[0::2], turn[1::2]
    up, down = _powers(_sized(len(raw)))
    sums = np.zeros(len(raw) + 1, dtype=U)
    np.cumsum((raw.astype(U) + U(1)) * up[: len(raw)], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * down[starts])
    bounds = np.zeros(len(texts) + 1, dtype=np.int64)
    bounds[1:] = np.searchsorted(starts, ends_at, side="left")
    return hashes, bounds


_STEP = [U(pow(0xD6E8FEB86659FD93, k + 1, 1 << 64)) for k in range(64)]


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text: runs of ``width`` words, or with
    fewer words the whole sequence as one; none without words."""
    out: list[np.ndarray] = []
    part: list[bytes] = []
    size = 0
    for text in [*texts, None]:
        if part and (text is None or size + len(text) > CHUNK):
            out += _shingle_sets(part, width)
            part, size = [], 0
        if text is not None:
            part.append(text)
            size += len(text) + 1
    return out


def _shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    words, bounds = word_hashes(texts)
    n = len(words) - width + 1
    runs = np.zeros(max(n, 0), dtype=U)
    for k in range(width if n > 0 else 0):
        runs += words[k : k + n] * _STEP[k]
    runs = mix(runs)
    sets = []
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if hi - lo >= width:
            own = np.sort(runs[lo : hi - width + 1])
            keep = np.empty(len(own), dtype=bool)
            keep[0] = True
            np.not_equal(own[1:], own[:-1], out=keep[1:])
            sets.append(own[keep])
        elif hi > lo:
            whole = (words[lo:hi] * np.array(_STEP[: hi - lo], dtype=U)).sum(dtype=U) + U(hi - lo)
            sets.append(mix(np.array([whole], dtype=U)))
        else:
            sets.append(np.zeros(0, dtype=U))
    return sets
