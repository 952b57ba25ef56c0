"""Hashes of the words of many texts at once, on the bytes of an Arrow column.

Words are runs of bytes other than space and U+0009 to U+000D, with A-Z lower-cased; as these
are all ASCII, no character of UTF-8 is cut. Hashes have 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Of shapes: letters are a, capitals A, digits 0, other signs stay.
SHAPE = np.arange(256, dtype=np.uint8)
SHAPE[65:91], SHAPE[97:123], SHAPE[128:], SHAPE[48:58] = 65, 97, 97, 48
_CODES = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
#: Texts are hashed in groups of about so many bytes.
TOGETHER_BYTES = 1 << 20


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers_to(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(max(n, TOGETHER_BYTES), base, np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps)
    return _powers


def run_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The hash of each run codes[start:end]; it doesn't depend on where the run stands."""
    up, down = _powers_to(len(codes))
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(_CODES[codes] * up[: len(codes)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts])


class Words:
    """The words of some texts: ``doc`` has the text of each word, ``starts`` and ``ends`` its bytes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.n_docs = data, len(offsets) - 1
        inside = ~SEPARATOR[data]
        edges = offsets[1:-1]
        edges = edges[(edges > 0) & (edges < len(data))]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        first[edges] = inside[edges]
        last[edges - 1] = inside[edges - 1]
        self.first, self.inside = first, inside
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.doc = np.searchsorted(offsets, self.starts, "right") - 1

    def hashes(self) -> np.ndarray:
        return run_hashes(LOWER[self.data], self.starts, self.ends) if len(self.starts) else np.zeros(0, np.uint64)

    def shape_hashes(self) -> np.ndarray:
        """Hashes of the words' shapes, in which a run of equal signs counts as one."""
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        shape = SHAPE[self.data]
        kept = self.inside.copy()
        kept[1:] &= self.first[1:] | (shape[1:] != shape[:-1])
        at = np.concatenate([[0], np.cumsum(kept)])
        return run_hashes(shape[kept], at[self.starts], at[self.ends])


def word_groups(texts: pa.Array) -> Iterator[tuple[int, Words]]:
    """(number of the first text, its group's words), group by group; a null counts as empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + TOGETHER_BYTES, "right")) - 1)
        yield at, Words(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        at = to


def n_grams(hashes: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of each n consecutive words of one text."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, doc.dtype)
    total = np.zeros(m, np.uint64)
    for i in range(n):
        total = mixed(total + hashes[i : i + m] + np.uint64(i + 1))
    same = doc[:m] == doc[n - 1 :]
    return total[same], doc[:m][same]
