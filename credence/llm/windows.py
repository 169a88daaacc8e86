"""Anchors of sliding windows: which place of a window stands for it, the same in every equal window.

A window of `width` units holds width - size + 1 grams of `size` units. The gram with the least
hash (leftmost of equals) is its anchor. Equal windows have equal anchors at equal offsets, so a
window whose anchor gram occurs nowhere else is unique, and only about two in
width - size + 2 places need to be compared across documents. Successive windows with one anchor form a run.
"""

from __future__ import annotations

import numpy as np

from credence.llm.textkit import BASE, BYTE_VALUE, INVERSE, STRETCH, U64, mix, powers

PLACE_BITS = 26


def least_places(hashes: np.ndarray, width: int) -> np.ndarray:
    """For each window of `width` successive hashes, the place of the least (leftmost of equals), blockwise."""
    count = hashes.size - width + 1
    if count <= 0:
        return np.zeros(0, np.int64)
    if hashes.size >= 1 << PLACE_BITS:
        half = max(width, 1 << (PLACE_BITS - 1))
        pieces = [least_places(hashes[at : at + half + width - 1], width) + at for at in range(0, count, half)]
        return np.concatenate(pieces)
    low = U64((1 << PLACE_BITS) - 1)
    packed = (hashes & ~low) | np.arange(hashes.size, dtype=U64)
    blocks = -(-hashes.size // width)
    grid = np.full(blocks * width, ~U64(0))
    grid[: hashes.size] = packed
    grid = grid.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    behind = np.minimum.accumulate(grid, axis=1).ravel()
    return (np.minimum(ahead[:count], behind[width - 1 : width - 1 + count]) & low).astype(np.int64)


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """Hash of `size` successive bytes from each place on, a stretch at a time.

    It chooses anchors only: grams that collide cost a comparison and change no result.
    """
    count = max(0, data.size - size + 1)
    hashes = np.empty(count, U64)
    step = STRETCH - size
    for at in range(0, count, step):
        own = data[at : at + step + size - 1]
        sums = np.zeros(own.size + 1, U64)
        np.cumsum(BYTE_VALUE[own] * powers(BASE)[: own.size], out=sums[1:])
        here = own.size - size + 1
        hashes[at : at + here] = mix((sums[size:] - sums[:here]) * powers(INVERSE)[:here])
    return hashes


def window_runs(grams: np.ndarray, bounds: np.ndarray, width: int, size: int):
    """Runs of windows lying within one text each.

    `grams` has the gram hash of each place of all texts in a row, `bounds` where texts begin.
    Returns, per run: text, first window's place, number of windows, anchor hash.
    """
    places = least_places(grams, width - size + 1)
    lengths = np.diff(bounds)
    owner = np.repeat(np.arange(lengths.size), lengths)[: places.size]
    inside = np.arange(places.size) + width <= bounds[owner + 1] if places.size else np.zeros(0, bool)
    if not inside.any():
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, U64)
    valid = np.flatnonzero(inside)
    fresh = np.ones(valid.size, bool)
    fresh[1:] = (places[valid[1:]] != places[valid[:-1]]) | (owner[valid[1:]] != owner[valid[:-1]])
    heads = np.flatnonzero(fresh)
    starts = valid[heads]
    return owner[starts], starts, np.diff(np.append(heads, valid.size)), grams[places[starts]]
