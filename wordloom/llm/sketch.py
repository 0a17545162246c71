"""Fast similarity sketching: a MinHash-like sketch whose every coordinate is filled.

Round r < t throws each element into one of t bins with a hash of its own; round r >= t throws all
elements into bin r - t. A bin keeps its least (round, value); once a round leaves no bin empty,
no later round can change anything and the sketch ends. So at most 2t rounds fill all t
coordinates, and agreement of two sketches estimates Jaccard similarity with concentration like
that of t independent hashes, at about one hash per element where a set is large.
"""

from __future__ import annotations

import math

import numpy as np

from .wordsets import mix

_U = np.uint64


def sketch(values: np.ndarray, t: int, seed: int = 1) -> np.ndarray:
    """The t coordinates (64 bits each) of a non-empty set of 64-bit values.

    Rounds of a small set are hashed together: those after the deciding one can't win a bin."""
    full = np.full(t, np.iinfo(np.uint64).max, dtype=_U)
    want = t * (math.log(t) + 3)
    r = 0
    while True:
        more = min(2 * t - r, max(1, round(want / len(values))))
        rounds = np.arange(r, r + more, dtype=_U)[:, None]
        x = mix(values[None, :] ^ mix(rounds + _U(seed * 1_000_003)))
        bins = ((x >> _U(40)) * _U(t) >> _U(24)).astype(np.int64)
        if r + more > t:
            late = rounds[:, 0] >= t
            bins[late] = (rounds[late] - _U(t)).astype(np.int64)
        # the round stands above 48 bits of value: an earlier round always wins
        np.minimum.at(full, bins.ravel(), ((rounds << _U(48)) | (x * _U(0x9E3779B97F4A7C15) >> _U(16))).ravel())
        r += more
        if r == 2 * t or int(full.max()) >> 48 < r:
            return full


def band_shape(threshold: float, rows: int, miss: float) -> int:
    """Bands of ``rows`` coordinates that leave a pair at the threshold unfound with probability ``miss`` at most."""
    return math.ceil(math.log(miss) / math.log1p(-(threshold**rows)))


def bands(coordinates: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit key per band; the band's number is part of the key."""
    grid = coordinates[: len(coordinates) // rows * rows].reshape(-1, rows)
    acc = mix(np.arange(1, len(grid) + 1, dtype=_U) * _U(0xD1B54A32D192ED03))
    for j in range(rows):
        acc = mix(acc * _U(0x2545F4914F6CDD1D) + grid[:, j])
    return acc.view(np.int64)
