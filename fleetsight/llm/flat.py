"""Many texts as one flat byte array: token spans, hashes of spans and of windows of tokens.

Python tasks hand their texts over in chunks of about ``CHUNK_BYTES``, so that memory is bounded by
the longest single text, and work on whole arrays instead of on words.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

CHUNK_BYTES = 1 << 20

_rng = np.random.Generator(np.random.PCG64(20240229))
# Odd random weights: place in the token, place in the window.
_PLACE = _rng.integers(0, 1 << 63, 1 << 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_WINDOW = _rng.integers(0, 1 << 63, (2, 64), dtype=np.uint64) * np.uint64(2) + np.uint64(1)

# ASCII white space: blank, and tab to carriage return.
IS_BLANK = np.zeros(256, dtype=bool)
IS_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def mix(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit depends on every input bit."""
    x = values ^ (values >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chunks(texts: Sequence[str | None], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """(position of the first text, texts in UTF-8): consecutive texts of about ``limit`` bytes in all."""
    start, held, size = 0, [], 0
    for place, text in enumerate(texts):
        data = text.encode() if text else b""
        held.append(data)
        size += len(data)
        if size >= limit:
            yield start, held
            start, held, size = place + 1, [], 0
    if held:
        yield start, held


class Flat:
    """Texts laid out one after the other, each followed by a line feed that belongs to no token."""

    def __init__(self, texts: list[bytes]) -> None:
        self.data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
        lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1
        self.ends = np.cumsum(lengths)
        self.starts = self.ends - lengths

    def runs(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the maximal stretches where ``inside`` holds."""
        edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
        return edge[0::2], edge[1::2]

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        return self.runs(~IS_BLANK[self.data])

    def first_of(self, starts: np.ndarray) -> np.ndarray:
        """Per text, the number of the first token at or after its start; one more entry for the end."""
        return np.searchsorted(starts, np.append(self.starts, self.data.size))

    def hashes(self, starts: np.ndarray, ends: np.ndarray, data: np.ndarray | None = None) -> np.ndarray:
        """One 64-bit hash per span; equal bytes give equal hashes."""
        return span_hashes(self.data if data is None else data, starts, ends)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of every span of ``data``: its bytes are read eight at a time, mixed by place and added up."""
    if not starts.size:
        return np.zeros(0, dtype=np.uint64)
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    eights = np.ndarray((padded.size - 7,), dtype="<u8", buffer=padded, strides=(1,))
    lengths = ends - starts
    counts = (lengths + 7) >> 3
    offset = np.cumsum(counts) - counts
    place = np.arange(int(counts.sum())) - np.repeat(offset, counts)
    loaded = eights[np.repeat(starts, counts) + 8 * place]
    left = np.minimum(np.repeat(lengths, counts) - 8 * place, 8)
    loaded &= np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - left.astype(np.uint64) * np.uint64(8))
    weight = _PLACE[place & 0xFFFF] + (place >> 16).astype(np.uint64)
    return mix(np.add.reduceat(mix(loaded ^ weight), offset) + lengths.astype(np.uint64))


def distinct(keys: np.ndarray) -> np.ndarray:
    """The different keys in order; sorting is faster here than hashing."""
    keys = np.sort(keys)
    new = np.ones(keys.size, dtype=bool)
    new[1:] = keys[1:] != keys[:-1]
    return keys[new]


def member(keys: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which keys are among the ordered ones, by binary search."""
    if not ordered.size:
        return np.zeros(keys.size, dtype=bool)
    return ordered[np.minimum(np.searchsorted(ordered, keys), ordered.size - 1)] == keys


def window_hashes(tokens: np.ndarray, size: int, second: bool = False) -> np.ndarray:
    """Hash of every window of ``size`` consecutive tokens; shorter by ``size - 1`` than the input."""
    n = tokens.size - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    weights = _WINDOW[int(second)]
    total = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        total += tokens[k : k + n] * weights[k]
    return mix(total)


def window_hashes_at(tokens: np.ndarray, starts: np.ndarray, size: int, second: bool = False) -> np.ndarray:
    """The same hashes, of the windows at ``starts`` only."""
    weights = _WINDOW[int(second)]
    total = np.zeros(starts.size, dtype=np.uint64)
    for k in range(size):
        total += tokens[starts + k] * weights[k]
    return mix(total)


def whole_windows(first: np.ndarray, count: int, size: int) -> np.ndarray:
    """Which of the ``count`` window starts lie in one text; ``first`` as from ``Flat.first_of``."""
    inside = np.ones(max(count, 0), dtype=bool)
    for back in range(1, size):
        cut = first[1:-1] - back
        inside[cut[(cut >= 0) & (cut < count)]] = False
    return inside
