"""SuperMinHash signatures and band keys, vectorised over the elements of many sets."""

from __future__ import annotations

import numpy as np

from .common import GOLDEN, mix, multipliers

LOW = np.uint64(0xFFFFFFFF)
HALF = np.uint64(32)


def superminhash(elements: np.ndarray, starts: np.ndarray, m: int) -> np.ndarray:
    """m-value signatures of sets; set i has the 64-bit hashes elements[starts[i]:starts[i+1]].

    Each element shuffles the slots 0..m-1 step by step; at step j it offers j plus a fraction to the slot that the shuffle
    puts at j, and a slot keeps its least offer (whole part in the high 32 bits). All slots of an element are distinct, which
    makes the slots' values correlated and the estimate's variance lower than that of independent hashes. After step j no later
    offer can be below j + 1, so a set stops once all of its slots hold less. Empty sets keep the greatest value everywhere.
    """
    n_sets = len(starts) - 1
    signature = np.full((n_sets, m), np.iinfo(np.uint64).max, dtype=np.uint64)
    flat = signature.reshape(-1)
    owner = np.repeat(np.arange(n_sets), np.diff(starts))
    order = None
    steps = GOLDEN * np.arange(1, m + 1, dtype=np.uint64)
    for j in range(m):
        if not len(elements):
            break
        random = mix(elements + steps[j])
        at = j + ((random & LOW) % np.uint64(m - j)).astype(np.int64)
        if order is None:
            slot = at
        else:
            rows = np.arange(len(elements))
            slot = order[rows, at].astype(np.int64)
            order[rows, at] = order[:, j]
            order[:, j] = slot
        np.minimum.at(flat, owner * m + slot, (np.uint64(j) << HALF) | (random >> HALF))
        open_sets = (signature.max(axis=1) >> HALF) > np.uint64(j)
        stays = open_sets[owner]
        if order is None:
            elements, owner, at = elements[stays], owner[stays], at[stays]
            order = np.tile(np.arange(m, dtype=np.uint16), (len(elements), 1))
            rows = np.arange(len(elements))
            order[rows, at] = 0
            order[:, 0] = at
        elif not stays.all():
            elements, owner, order = elements[stays], owner[stays], order[stays]
    return signature


def minhash(elements: np.ndarray, width: int, at: np.ndarray, m: int) -> np.ndarray:
    """m plain MinHash values of each window elements[a:a+width], a in at."""
    out = np.empty((len(at), m), dtype=np.uint64)
    windows = at[:, None] + np.arange(width)
    for k, odd in enumerate(multipliers(m)):
        out[:, k] = (mix(elements * odd))[windows].min(axis=1)
    return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key of each band of `rows` values; the band's number is part of the key."""
    values = signature[:, : bands * rows].reshape(len(signature), bands, rows)
    total = np.zeros((len(signature), bands), dtype=np.uint64)
    for k, odd in enumerate(multipliers(rows)):
        total += mix(values[:, :, k]) * odd
    return mix(total + GOLDEN * np.arange(1, bands + 1, dtype=np.uint64))
