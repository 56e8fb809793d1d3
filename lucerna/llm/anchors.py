"""Content-defined anchors: of every window of ``length`` bytes, the same inner string whatever stands around it.

The anchor of a window is its ``gram``-byte string of least hash, the leftmost of equals, so equal windows have equal
anchors at equal offsets. Each anchor owns a run of windows; their bytes together are a unit.
"""

from __future__ import annotations

import numpy as np

#: Bytes of an anchor.
GRAM = 48
_SEED = 23
_ODD = 0x2545F4914F6CDD1D | 1
_PIECE = 1 << 20


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_ODD, _PIECE + 4096), _powers(pow(_ODD, -1, 1 << 64), _PIECE + 4096)
_CODES = np.random.default_rng(_SEED).integers(1, 2**63, (2, 256), dtype=np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ h >> np.uint64(31)
    h = h * np.uint64(0x9FB21C651E98DF25)
    return h ^ h >> np.uint64(28)


def prefix_sums(codes: np.ndarray, which: int = 0) -> np.ndarray:
    """Running polynomial sums of at most ``_PIECE + 4095`` bytes."""
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(_CODES[which][codes] * _UP[: len(codes)], out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of byte spans, equal for equal strings wherever they stand."""
    return _mixed((sums[ends] - sums[starts]) * _DOWN[starts])


def depth_keys(part: bytes, side: int) -> np.ndarray:
    """A key for each beginning of a short string (the empty one first), of its bytes, its length and the side."""
    sums = prefix_sums(np.frombuffer(part, np.uint8), side)
    return _mixed(sums + (np.arange(len(sums), dtype=np.uint64) * np.uint64(2) + np.uint64(side)) * np.uint64(_ODD)) | np.uint64(1)


def _running_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` consecutive values, by doubling."""
    span, out = 1, x
    while span * 2 <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    rest = width - span
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def owners(codes: np.ndarray, length: int, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor's place, hash, first window, last window) for each anchor that owns windows of one piece of text."""
    sums = prefix_sums(codes)
    n_grams = len(codes) - gram + 1
    at = np.arange(n_grams)
    h = span_hashes(sums, at, at + gram)
    width = length - gram + 1
    # leftmost of equals: the place breaks ties, in the low bits' stead
    best = _running_min(h, width)
    candidates = np.flatnonzero(_anchors(h, best, width))
    # the owner of window i is the first candidate at or after i whose hash is best[i]
    i = np.arange(len(best))
    owner = candidates[np.searchsorted(candidates, i)]
    wrong = h[owner] != best
    while wrong.any():
        nxt = np.searchsorted(candidates, owner[wrong], side="right")
        owner[wrong] = candidates[nxt]
        wrong[wrong] = h[owner[wrong]] != best[wrong]
    edge = np.flatnonzero(np.diff(owner, prepend=-1))
    last = np.append(edge[1:], len(owner)) - 1
    return owner[edge], h[owner[edge]], edge, last


def _anchors(h: np.ndarray, best: np.ndarray, width: int) -> np.ndarray:
    """Places whose hash is the least of some window that holds them."""
    pad = np.concatenate((np.zeros(width - 1, h.dtype), best, np.zeros(width - 1, h.dtype)))
    most = ~_running_min(~pad, width)  # greatest of the minima of all windows around a place
    return h == most


def units(raw: bytes, length: int, gram: int = GRAM) -> list[tuple[np.ndarray, ...]]:
    """(hash of anchor, hash of unit, place) of a whole text, as three arrays; see ``place_of``.

    Long texts are worked through in overlapping pieces; a window's owner doesn't depend on the piece.
    """
    codes, found = np.frombuffer(raw, np.uint8), []
    for begin in range(0, max(1, len(codes) - length + 1), _PIECE):
        piece = codes[begin : begin + _PIECE + length - 1]
        if len(piece) < length:
            continue
        place, h, first, last = owners(piece, length, gram)
        sums = prefix_sums(piece, 1)
        # the anchor's offset is part of what makes units equal
        unit = span_hashes(sums, first, last + length) ^ _mixed((place - first).astype(np.uint64) + np.uint64(77))
        found.append((h, unit, place_of(first + begin, place + begin, last + begin)))
    return [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.zeros(0, np.uint64)] * 2 + [np.zeros(0, np.int64)]


#: Bits of each of the two offsets in a place.
_OFFSET = 10


def place_of(first: np.ndarray, anchor: np.ndarray, last: np.ndarray) -> np.ndarray:
    """First window, bytes from there to the anchor, and windows less one, in one number."""
    return (first << 2 * _OFFSET) + (anchor - first << _OFFSET) + (last - first)


def unpacked_place(place: int) -> tuple[int, int, int]:
    return place >> 2 * _OFFSET, place >> _OFFSET & (1 << _OFFSET) - 1, place & (1 << _OFFSET) - 1
