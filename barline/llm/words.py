"""Words of many texts at once, as numpy arrays over the bytes of a block."""

from __future__ import annotations

import numpy as np

from .tables import BLOCK_BYTES

#: White space: blank and the five control characters from tab to carriage return.
WHITE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
#: Kinds of bytes: 0 white space, 1 anything else.
BLANK_CUT = np.where(WHITE, 0, 1).astype(np.uint8)
#: Kinds of bytes: 0 white space, 1 letters and digits with all of UTF-8 beyond ASCII, 2 signs.
SIGN_CUT = np.array([0 if WHITE[b] else 1 if b >= 128 or chr(b).isalnum() else 2 for b in range(256)], np.uint8)
#: Kinds of bytes: 0 signs and white space, 1 letters and digits with all of UTF-8 beyond ASCII.
LETTER_CUT = np.where(SIGN_CUT == 1, 1, 0).astype(np.uint8)


def mixed(x: np.ndarray) -> np.ndarray:
    """Each number scrambled over all 64 bits."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_OF_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def find_words(raw: np.ndarray, offsets: np.ndarray, cut: np.ndarray = BLANK_CUT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each run of bytes of one kind, and the row that holds it."""
    if not len(raw):
        none = np.zeros(0, np.int64)
        return none, none, none
    kind = cut[raw]
    edge = np.ones(len(raw) + 1, bool)
    edge[1:-1] = kind[1:] != kind[:-1]
    edge[offsets] = True
    at = np.flatnonzero(edge)
    solid = kind[at[:-1]] > 0
    starts, ends = at[:-1][solid], at[1:][solid]
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def places(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The positions of all ranges one after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


def hash_words(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words, the same in every block."""
    sizes = ends - starts
    out = np.zeros(len(starts), np.uint64)
    if not len(starts):
        return out
    of_place = mixed(np.arange(1, sizes.max() + 1, dtype=np.uint64)) | np.uint64(1)
    total = np.concatenate([[0], np.cumsum(sizes)])
    first = 0
    while first < len(starts):  # a part of the words at a time bounds the memory
        last = max(first + 1, int(np.searchsorted(total, total[first] + BLOCK_BYTES, "right")) - 1)
        own = sizes[first:last]
        at = total[first:last] - total[first]
        within = np.arange(total[last] - total[first]) - np.repeat(at, own)
        out[first:last] = np.add.reduceat(_OF_BYTE[raw[within + np.repeat(starts[first:last], own)]] * of_place[within], at)
        first = last
    return mixed(out + sizes.astype(np.uint64))


def joined_hash(*parts: np.ndarray) -> np.ndarray:
    """One hash of the words that stand in the same place of the given arrays, in this order."""
    out = np.full(len(parts[0]), len(parts), np.uint64)
    for part in parts:
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + part)
    return out
