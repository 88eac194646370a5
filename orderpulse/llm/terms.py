"""Words of a slice of texts as an Arrow array, cut on the UTF-8 bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


class Cut:
    """Maximal runs of the marked bytes, A-Z lower-cased first; no run crosses two texts.

    ``words`` holds them in order and ``row`` the text of each. Bytes from 0x80 on
    must all be marked or all not.
    """

    def __init__(self, raw: np.ndarray, offs: np.ndarray, marked: np.ndarray):
        lower = np.arange(256, dtype=np.uint8)
        lower[65:91] += 32
        raw = lower[raw]
        solid = marked[raw]
        edge = np.zeros(len(raw) + 1, bool)
        edge[offs] = True
        first = solid.copy()
        if len(raw):
            first[1:] &= ~solid[:-1] | edge[1:-1]
        starts = np.flatnonzero(first)
        self.row = np.searchsorted(offs, starts, "right") - 1
        before = np.concatenate([[0], np.cumsum(solid)])
        at = np.append(before[starts], before[-1]).astype(np.int64)
        self.words = pa.LargeStringArray.from_buffers(
            len(starts), pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(raw[solid])))


def encode(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Code of each word and the distinct words."""
    d = words.dictionary_encode()
    return d.indices.to_numpy().astype(np.int64), d.dictionary
