"""Vectorised word hashing over the UTF-8 bytes of Arrow string columns.

A word is a maximal run of bytes outside 0x20 and 0x09-0x0D, which in UTF-8 is the same as ``[^\\x20\\x09-\\x0D]+`` on code
points. A-Z are lower-cased and nothing else. Word hashes are polynomial over uint64, then mixed to full avalanche.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A word's bytes as they are, and with A-Z lower-cased; none is 0, so that lengths tell.
SAME = np.arange(1, 257, dtype=np.uint64)
LOWER = SAME.copy()
LOWER[65:91] += 32
#: For terms: every ASCII byte that is no letter or digit parts words.
SIGNS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_BASE = 0x9E3779B97F4A7C15 | 1
_powers: dict[str, np.ndarray] = {}
CHUNK_BYTES = 1 << 20


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection on uint64 that spreads every input bit over all output bits."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def constants(n: int, seed: int) -> np.ndarray:
    """``n`` odd 64-bit multipliers."""
    return mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019) + np.uint64(seed)) | np.uint64(1)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers["up"]) < n:
        size = max(n, CHUNK_BYTES + 1)
        up, down = np.full(size, _BASE, np.uint64), np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _powers["up"], _powers["down"] = np.cumprod(up), np.cumprod(down)
    return _powers["up"], _powers["down"]


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) pieces of whole texts, about ``limit`` bytes each; null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    first = 0
    while first < len(column):
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1)
        end = min(end, len(column))
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def word_bounds(buf: np.ndarray, offsets: np.ndarray, parts: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of each word; ``parts`` marks the bytes that part words, and a text's end parts them too."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    solid = ~parts[buf]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    before[0], before[1:] = True, ~solid[:-1]
    after = np.empty(n, bool)
    after[-1], after[:-1] = True, ~solid[1:]
    return np.flatnonzero(solid & (before | edge[:-1])), np.flatnonzero(solid & (after | edge[1:])) + 1


def span_hashes(buf: np.ndarray, spans: list[tuple[np.ndarray, np.ndarray]], letters: np.ndarray = LOWER) -> list[np.ndarray]:
    """For each (starts, ends) the hashes of those byte spans."""
    n = len(buf)
    up, down = powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(letters[buf] * up[:n], out=sums[1:])
    return [mix64((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64) * np.uint64(0xA0761D6478BD642F)) for a, b in spans]


def owners(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The text that each start lies in."""
    return np.searchsorted(offsets[1:], starts, side="right")


def word_hashes(buf: np.ndarray, offsets: np.ndarray, letters: np.ndarray = LOWER) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word and the number of words of each text."""
    starts, ends = word_bounds(buf, offsets)
    counts = np.bincount(owners(starts, offsets), minlength=len(offsets) - 1)
    return (span_hashes(buf, [(starts, ends)], letters)[0] if len(buf) else np.zeros(0, np.uint64)), counts


def shingle_hashes(buf: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``width``-word shingles of each text, in text order, and their number. A text of fewer words, but one at
    least, has its whole sequence as its only shingle."""
    words, counts = word_hashes(buf, offsets)
    by = constants(width + 1, 77)
    last = np.cumsum(counts)
    first = last - counts
    usual = np.maximum(counts - width + 1, 0)
    total = usual + ((counts > 0) & (counts < width))
    out = np.zeros(int(total.sum()), np.uint64)
    begin = np.cumsum(total) - total
    if len(words) >= width:
        rolled = np.zeros(len(words) - width + 1, np.uint64)
        for j in range(width):
            rolled += words[j : j + len(rolled)] * by[j]
        inside = np.repeat(first - (np.cumsum(usual) - usual), usual) + np.arange(int(usual.sum()))
        place = np.repeat(begin - (np.cumsum(usual) - usual), usual) + np.arange(int(usual.sum()))
        out[place] = mix64(rolled[inside])
    for d in np.flatnonzero((counts > 0) & (counts < width)):
        own = words[first[d] : last[d]]
        out[begin[d] : begin[d] + 1] = mix64((own * by[: len(own)]).sum(dtype=np.uint64, keepdims=True) + by[width:] * np.uint64(len(own)))
    return out, total
