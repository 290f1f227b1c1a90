"""Moments of a wide sliding frame over the rows of one chunk, in numpy.

A frame of ``width`` rows is the tail of one block of that length and the head
of the next, so two cumulative passes over the blocks give every frame.  Each
part is measured from a value inside it, which keeps sums of squares small.
"""

from __future__ import annotations

import numpy as np


def _heads(x: np.ndarray) -> tuple[np.ndarray, ...]:
    """n, mean, m2, lo and hi from the start of each block; blocks run along axis 1."""
    known = np.isfinite(x)
    first = np.argmax(known, axis=1)[:, None, :]
    origin = np.nan_to_num(np.take_along_axis(x, first, axis=1))
    gap = np.where(known, x - origin, 0.0)
    n = np.cumsum(known, axis=1)
    total, squares = np.cumsum(gap, axis=1), np.cumsum(gap * gap, axis=1)
    some = np.maximum(n, 1)
    lo = np.minimum.accumulate(np.where(known, x, np.inf), axis=1)
    hi = np.maximum.accumulate(np.where(known, x, -np.inf), axis=1)
    return n, origin + total / some, np.maximum(squares - total * total / some, 0.0), lo, hi


def previous_moments(values: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Known values among the ``width`` rows before each row, their mean and deviation.

    ``values`` has rows along axis 0 and columns along axis 1; NaN is unknown.
    """
    rows, columns = values.shape
    blocks = -(-rows // width)
    padded = np.full((blocks * width, columns), np.nan)
    padded[:rows] = np.where(np.isfinite(values), values, np.nan)
    shaped = padded.reshape(blocks, width, columns)

    def flat(a: np.ndarray) -> np.ndarray:
        return a.reshape(blocks * width, columns)[:rows]

    heads = [flat(a) for a in _heads(shaped)]
    tails = [flat(a[:, ::-1]) for a in _heads(shaped[:, ::-1])]

    # the frame of row i ends with row i - 1 and starts with row i - width
    i = np.arange(rows)
    end, start = np.maximum(i - 1, 0), np.maximum(i - width, 0)
    has_head = (i > 0)[:, None]
    has_tail = ((i >= width) & (i % width != 0))[:, None]
    nh, mh, qh, lh, hh = (a[end] for a in heads)
    nt, mt, qt, lt, ht = (a[start] for a in tails)
    nh, nt = np.where(has_head, nh, 0), np.where(has_tail, nt, 0)
    n = nh + nt
    some = np.maximum(n, 1)
    gap = mh - mt
    mean = np.where(nt == 0, mh, np.where(nh == 0, mt, mt + gap * nh / some))
    m2 = np.where(nt == 0, qh, np.where(nh == 0, qt, qh + qt + gap * gap * nh * nt / some))
    lo = np.minimum(np.where(nh > 0, lh, np.inf), np.where(nt > 0, lt, np.inf))
    hi = np.maximum(np.where(nh > 0, hh, -np.inf), np.where(nt > 0, ht, -np.inf))
    same = lo == hi
    return n, np.where(same, lo, mean), np.where(same, 0.0, np.sqrt(m2 / some))
