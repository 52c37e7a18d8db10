"""Axoplasmic reticula: dark spots closed off by light rings, slice by slice.

Every seed is judged on the input, so the painted set doesn't depend on the order of seeds. Blocks with a halo as wide as the
largest ring hold all that their seeds see; rings are offsets into the block, looked at from the inside out, and a seed drops out at the ring that closes it.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from voxloom.operators import blocks

# Fixed values of the detector.
DARK, LIGHT, RINGS, SPARE, KEEP = 45, 87, 16, 5, (2, 15)


def ring(r: int) -> list[tuple[int, int]]:
    """(dy, dx) of ring r about a seed: its centre lies one down and one right; the first row and
    each (r + 2)th are whole, others have their two ends."""
    return [(k + 1 - r, c + 1 - r) for k in range(2 * r + 1) for c in (range(2 * r + 1) if k % (r + 2) == 0 else (0, 2 * r))]


#: How far the largest ring reaches.
HALO = RINGS + 1


def _seen(v: np.ndarray, there: np.ndarray, y: np.ndarray, x: np.ndarray, r: int, dark: int, light: int) -> tuple[np.ndarray, ...]:
    """(n, n_light, black, rows, columns) of ring ``r`` about seeds: counts for each, and which cells are dark."""
    dy, dx = np.array(ring(r)).T
    yy, xx = y[:, None] + dy, x[:, None] + dx
    met, near = there[yy, xx], v[yy, xx]
    black = met & (near < np.floor(dark + r * 0.5))
    return met.sum(1), (met & ~black & (near > light)).sum(1), black, yy, xx


def _seeds(v: np.ndarray, there: np.ndarray, dark: int) -> tuple[np.ndarray, np.ndarray]:
    own = np.zeros_like(there)
    blocks.inner(own, HALO)[:] = blocks.inner(there & (v < dark), HALO)
    return np.nonzero(own)


def rings(voxels: DataFrame, value: str = "v", dark: int = DARK, light: int = LIGHT) -> DataFrame:
    """(sz, sy, sx, r, n, n_light, n_black): what each seed sees in each ring inside the slice."""

    def look(values, there, corner):
        y, x = _seeds(values[0], there, dark)
        out = []
        for r in range(1, RINGS + 1):
            n, n_light, black, *_ = _seen(values[0], there, y, x, r, dark, light)
            m = n > 0
            out.append((y[m] + corner[1], x[m] + corner[2], np.full(m.sum(), r), n[m], n_light[m], black.sum(1)[m]))
        cols = [np.concatenate(c) for c in zip(*out, strict=True)]
        return [np.full(len(cols[0]), corner[0]), *cols]

    return blocks.on_slices(voxels, [value], HALO, look, "sz int, sy int, sx int, r int, n bigint, n_light bigint, n_black bigint")


def detect(voxels: DataFrame, value: str = "v", dark: int = DARK, light: int = LIGHT) -> DataFrame:
    """(z, y, x) painted: the seed and the dark voxels of its rings up to the one that closes it."""

    def paint(values, there, corner):
        v = values[0]
        y, x = _seeds(v, there, dark)
        stop = np.zeros(len(y), np.int64)
        left = np.arange(len(y))
        for r in range(1, KEEP[1] + 1):
            n, n_light, *_ = _seen(v, there, y[left], x[left], r, dark, light)
            closed = (n > 0) & (n_light >= n - SPARE)
            stop[left[closed]] = r
            left = left[~closed]
        kept = stop >= KEEP[0]
        y, x, stop = y[kept], x[kept], stop[kept]
        painted = np.zeros_like(there)
        painted[y, x] = True
        for r in range(1, KEEP[1] + 1):
            m = stop >= r
            _, _, black, yy, xx = _seen(v, there, y[m], x[m], r, dark, light)
            painted[yy[black], xx[black]] = True
        py, px = np.nonzero(painted)
        return [np.full(len(py), corner[0]), py + corner[1], px + corner[2]]

    # Seeds paint cells of other blocks as well.
    return blocks.on_slices(voxels, [value], HALO, paint, "z int, y int, x int").distinct()
