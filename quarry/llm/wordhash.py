"""64-bit hashes of words and word shingles with numpy, equal in every process."""

from __future__ import annotations

import numpy as np

from quarry.llm.common import mix64

_P = np.uint64(0x9E3779B97F4A7C15)
_POW = np.cumprod(np.full(4096, _P, np.uint64), dtype=np.uint64)
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
SEGMENT = 1 << 22


def word_hashes(text: str) -> np.ndarray:
    """One hash per word: runs of ASCII letters, digits and all characters beyond ASCII, lower case."""
    data = np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8)
    out, at = [], 0
    while at < len(data):
        end = min(len(data), at + SEGMENT)
        while end < len(data) and _WORD[data[end]]:  # segments end at a word's end
            end += 1
        part = data[at:end]
        inside = _WORD[part]
        edge = np.diff(inside.astype(np.int8), prepend=0)
        starts = np.flatnonzero(edge == 1)
        if len(starts):
            at_word = np.cumsum(inside)  # 1-based place among word bytes
            where = np.flatnonzero(inside)
            first = at_word[starts] - 1
            lengths = np.diff(np.append(first, len(where)))
            place = np.arange(len(where)) - np.repeat(first, lengths)
            v = (part[where].astype(np.uint64) + np.uint64(1)) * _POW[place & 4095]
            out.append(mix64(np.add.reduceat(v, first) + lengths.astype(np.uint64)))
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingles(text: str | None, n: int = 5) -> np.ndarray:
    """Hashes of all runs of n words; a text of fewer words is one shingle, a text without words none."""
    w = word_hashes(text) if text else np.zeros(0, np.uint64)
    if not len(w):
        return w
    n = min(n, len(w))
    h = np.zeros(len(w) - n + 1, np.uint64)
    for i in range(n):
        h = h * _P + w[i : len(w) - n + 1 + i]
    return mix64(h + np.uint64(n))
