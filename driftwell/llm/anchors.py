"""Anchors: of every window of a sequence, the smallest hash of the shorter runs in it.

Equal windows have equal anchors, and neighbouring windows mostly share theirs, so a repeated window is found by
comparing a few per cent of the positions.
"""

from __future__ import annotations

import numpy as np

from .textwords import ODD, mix

_POWERS: dict[str, np.ndarray] = {}


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each run of width values."""
    have, reach = values, 1
    while reach * 2 <= width:
        have = np.minimum(have[:-reach], have[reach:])
        reach *= 2
    return np.minimum(have[: len(values) - width + 1], have[width - reach :]) if reach < width else have


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "p" not in _POWERS or len(_POWERS["p"]) < n:
        size = max(n, 1 << 16)
        inverse = np.uint64(pow(int(ODD), -1, 1 << 64))
        for name, base in (("p", ODD), ("i", inverse)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _POWERS[name] = np.multiply.accumulate(x)
    return _POWERS["p"][:n], _POWERS["i"][:n]


#: Each byte stands for a random-looking 64-bit number.
BYTE = mix(np.arange(1, 257, dtype=np.uint64) * ODD)


def run_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of size bytes, by prefix sums of a polynomial."""
    n = len(data)
    if n < size:
        return np.empty(0, np.uint64)
    power, inverse = _powers(n + 1)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum(BYTE[data] * power[:n], out=sums[1:])
    return mix((sums[size:] - sums[:-size]) * inverse[: n - size + 1])


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each of the given spans of bytes, which also tells their lengths apart."""
    power, inverse = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE[data] * power[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * ODD)


def anchors(run: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For hashes of runs: each window's anchor (windows hold width runs), and the anchors at their places, in order."""
    least = sliding_min(run, width)
    # A run is some window's smallest if the largest minimum of the windows around it is its own hash.
    padded = np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)])
    around = ~sliding_min(~padded, width)
    return least, run[around == run]


def value_runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of runs of equal values."""
    cuts = np.flatnonzero(values[1:] != values[:-1]) + 1
    return np.concatenate([[0], cuts]), np.concatenate([cuts, [len(values)]])


def spans(starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal covered stretches of windows of one length that begin at the ascending starts."""
    if not len(starts):
        return starts, starts
    cut = np.flatnonzero(starts[1:] > starts[:-1] + length) + 1
    return starts[np.concatenate([[0], cut])], starts[np.concatenate([cut - 1, [len(starts) - 1]])] + length
