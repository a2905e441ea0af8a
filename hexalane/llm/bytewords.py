"""Vectorised word scanning over Arrow text columns.

All helpers work on the UTF-8 bytes of a block of texts at once, so that a task
spends its time in numpy rather than in a Python loop over words.  Blocks are
bounded in bytes, not in rows; a single text longer than the bound forms a block
of its own and is still scanned whole.
"""

import numpy as np
import pyarrow as pa

#: Bytes that separate words under the contracts' ``[^\x20\x09-\x0D]+``.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Bytes that separate words for the text classifiers: all ASCII but letters and digits.
NON_WORD = np.ones(256, bool)
NON_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
SAME = np.arange(256, dtype=np.uint64)
LOWER = SAME.copy()
LOWER[0x41:0x5B] += 32

BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
BLOCK = 1 << 19


def mix(h: np.ndarray) -> np.ndarray:
    """The public splitmix64 finaliser, a bijection of 64-bit words."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Powers:
    """Powers of the hash base and of its inverse, grown on demand and reused between blocks."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int):
        if len(self.up) < n:
            size = max(n, BLOCK + (1 << 16))
            up, down = np.full(size, BASE), np.full(size, INVERSE)
            up[0] = down[0] = 1
            self.up, self.down = np.multiply.accumulate(up), np.multiply.accumulate(down)
        return self.up[:n], self.down[:n]


def text_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string column; nulls count as empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    return np.frombuffer(data, np.uint8, int(offsets[-1] - offsets[0]), int(offsets[0])), offsets - offsets[0]


def tidy(run):
    """A ``mapInArrow`` function that hands memory back when its task ends: Python workers are reused, and their Arrow pool keeps freed pages."""

    def wrapped(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()

    return wrapped


def blocks(offsets: np.ndarray, limit: int = BLOCK):
    """Ranges of rows whose texts hold about ``limit`` bytes together; at least one row each."""
    row, n = 0, len(offsets) - 1
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1
        end = min(max(end, row + 1), n)
        yield row, end
        row = end


class Words:
    """Words of a block of texts: byte spans, the first word of each text, and the hash of any byte span."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, powers: Powers, separators=SPACE, fold=SAME):
        self.data, self.offsets = data, offsets
        n = len(data)
        inside = ~separators[data] if n else np.zeros(0, bool)
        head = np.zeros(n + 1, bool)
        head[offsets] = True
        first, last = inside.copy(), inside.copy()
        if n:
            first[1:] &= ~inside[:-1] | head[1:n]
            last[:-1] &= ~inside[1:] | head[1:n]
        self.inside = inside
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        #: words of text i are first[i] to first[i + 1]
        self.first = np.searchsorted(self.start, offsets)
        up, self.down = powers.get(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((fold[data] + np.uint64(1)) * up[:n], out=self.sums[1:])

    def span_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])

    def hashes(self) -> np.ndarray:
        return self.span_hash(self.start, self.end)


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` words; runs across texts are for the caller to leave out."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(width):
        out = out * BASE + hashes[j : j + n]
    return mix(out)


def shingle_sets(words: Words, width: int):
    """Sorted distinct shingle hashes of each text; a text of fewer words gives its whole sequence, one without words none."""
    h = words.hashes()
    w = windows(h, width)
    for a, b in zip(words.first[:-1], words.first[1:]):
        if b - a >= width:
            yield np.unique(w[a : b - width + 1])
        elif b > a:
            short = np.array([b - a], np.uint64)
            for j in range(a, b):
                short = mix(short * BASE + h[j : j + 1])
            yield short
        else:
            yield np.zeros(0, np.uint64)
