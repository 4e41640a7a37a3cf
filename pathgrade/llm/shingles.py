"""Sets of word shingles as 64-bit numbers, a column of texts at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text whose words are hashed at once; a longer text is cut at white space.
SEGMENT = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_FACTORS = np.array([0xD6E8FEB86659FD93, 0xA5A3564E27F88B1B, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_VALUE = mix(_LOWER + np.uint64(1))


class _Powers:
    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, SEGMENT)
            inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
            with np.errstate(over="ignore"):
                self.up = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n - 1, _BASE)]))
                self.down = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n - 1, inverse)]))
        return self.up, self.down


_powers = _Powers()


def _words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words in some bytes, A-Z in lower case, and where the words start."""
    space = _SPACE[data]
    edge = np.diff(space.astype(np.int8), prepend=1, append=1)
    first, last = np.flatnonzero(edge[:-1] == -1), np.flatnonzero(edge == 1)
    if not len(first):
        return np.zeros(0, np.uint64), first
    if space[0]:
        last = last[last > first[0]]
    up, down = _powers.to(len(data) + 1)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(_VALUE[data] * up[: len(data)])])
    return mix((sums[last] - sums[first]) * down[first] + (last - first).astype(np.uint64)), first


def word_hashes(texts: pa.Array) -> Iterator[np.ndarray]:
    """Of each text the hashes of its words `[^\\x20\\x09-\\x0D]+`, in order."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    k = 0
    while k < len(texts):
        to = max(k + 1, int(np.searchsorted(at, at[k] + SEGMENT, "right")) - 1)
        if to == k + 1:  # one text, in segments that end at white space
            parts, a, end = [], int(at[k]), int(at[k + 1])
            while a < end:
                b = min(a + SEGMENT, end)
                while b < end:
                    back = np.flatnonzero(_SPACE[data[a:b]])
                    if len(back):
                        b = a + int(back[-1]) + 1
                        break
                    b = min(b + SEGMENT, end)
                parts.append(_words(data[a:b])[0])
                a = b
            yield np.concatenate([*parts, np.zeros(0, np.uint64)])
        else:  # several texts, with a space between them
            piece = data[at[k] : at[to]]
            bounds = at[k : to + 1] - at[k]
            wide = np.insert(piece, bounds[1:-1], 32)
            hashes, first = _words(wide)
            cut = np.searchsorted(first, bounds + np.arange(len(bounds)))
            cut[-1] = len(first)
            for i in range(to - k):
                yield hashes[cut[i] : cut[i + 1]]
        k = to


def shingle_set(words: np.ndarray, size: int = 4) -> np.ndarray:
    """Distinct shingles of so many words, sorted; a text of fewer words is one shingle, one without words none."""
    n = len(words)
    if not n:
        return words
    m = min(n, size)
    total = np.zeros(n - m + 1, np.uint64)
    for k in range(m):
        total += words[k : n - m + 1 + k] * _FACTORS[k % 4] * np.uint64(2 * (k // 4) + 1)
    return np.unique(mix(total + np.uint64(m if m < size else 0)))
