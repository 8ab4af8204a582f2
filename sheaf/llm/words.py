"""Vectorised word, gram and hash passes over batches of texts.

Every function here works on the raw UTF-8 buffer of an Arrow string column, so
a word costs a few numpy passes and never a Python object.  Texts are taken in
pieces of bounded size; one text longer than a piece forms a piece of its own.
"""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 1 << 20

_U = np.uint64
_GOLDEN = 0x9E3779B97F4A7C15
_GRAM_BASE = 0xA0761D6478BD642F
_MASK = (1 << 64) - 1
#: Masks that leave so many low bytes.
_FILLED = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Separators of "space words" [^\x20\x09-\x0D]+ and of "letter words" [^\x00-\x2F\x3A-\x60\x7B-\x7F]+.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
NOT_ALNUM = np.zeros(256, dtype=bool)
NOT_ALNUM[:0x80] = True
NOT_ALNUM[0x30:0x3A] = False
NOT_ALNUM[0x61:0x7B] = False


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective finaliser of 64-bit values (splitmix64)."""
    z = x + _U((seed * _GOLDEN + _GOLDEN) & _MASK)
    z ^= z >> _U(30)
    z *= _U(0xBF58476D1CE4E5B9)
    z ^= z >> _U(27)
    z *= _U(0x94D049BB133111EB)
    z ^= z >> _U(31)
    return z


class Lanes:
    """Byte ranges of ``data`` as runs of 8-byte numbers, the last of each filled up with zeros; a range of no bytes is one zero."""

    def __init__(self, data: np.ndarray, start: np.ndarray, length: np.ndarray):
        self.length = length
        self.many = np.maximum((length + 7) >> 3, 1)
        self.first = np.cumsum(self.many) - self.many
        total = int(self.many.sum())
        self.place = np.arange(total) - np.repeat(self.first, self.many)
        inside = self.place << 3
        at = np.repeat(start, self.many) + inside
        words = np.zeros((len(data) >> 3) + 3, _U)
        words.view(np.uint8)[: len(data)] = data
        low, shift = at >> 3, ((at & 7) << 3).astype(_U)
        value = words[low] >> shift
        value |= (words[low + 1] << _U(1)) << (_U(63) - shift)
        value &= _FILLED[np.minimum(np.repeat(length, self.many) - inside, 8)]
        self.value = value

    @classmethod
    def of(cls, value: np.ndarray, first: np.ndarray, length: np.ndarray) -> Lanes:
        """Lanes made before: those of a range lie from ``first`` on.  To be compared with, not to be hashed."""
        lanes = cls.__new__(cls)
        lanes.value, lanes.first, lanes.length = value, first, length
        return lanes

    def taken(self, some: np.ndarray) -> Lanes:
        """Copies of some ranges."""
        many = self.many[some]
        ends = np.cumsum(many)
        at = np.repeat(self.first[some] - ends + many, many) + np.arange(int(ends[-1]))
        return Lanes.of(self.value[at], ends - many, self.length[some])

    def hash(self, seed: int = 0) -> np.ndarray:
        """A 64-bit hash of each range.  Each lane is mixed with its place before the sum, so no pattern of bytes cancels out."""
        value = mix(self.value ^ mix(self.place.astype(_U), 77 + seed))
        if len(self.many) < len(value):
            value = np.add.reduceat(value, self.first)
        return mix(value + self.length.astype(_U) * _U(_GOLDEN))

    def same(self, other: Lanes, which: np.ndarray) -> np.ndarray:
        """Whether each range has the very bytes of range ``which`` of ``other``."""
        out = self.length == other.length[which]
        own = np.repeat(out, self.many)
        at = (np.repeat(other.first[which], self.many) + self.place)[own]
        differ = np.flatnonzero(own)[self.value[own] != other.value[at]]
        out[np.searchsorted(self.first, differ, side="right") - 1] = False
        return out


def pieces(batch: pa.RecordBatch, text: str = "text", limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``limit`` bytes of text, or of one row."""
    if not batch.num_rows:
        return
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        done = int(size[at - 1]) if at else 0
        end = max(at + 1, int(np.searchsorted(size, done + limit, side="right")))
        yield batch.slice(at, end - at)
        at = end


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts together, and the n + 1 offsets of the texts in them; a null text is empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, dtype=np.uint8)[offsets[0] : offsets[-1]] if body is not None and len(body) else np.empty(0, np.uint8)
    return data, offsets - offsets[0]


class Words:
    """The words of a piece: byte ranges ``start``/``end``, document index ``doc``, words of each document ``counts`` with ``first`` their offsets."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACE):
        self.data, self.offsets = data, offsets
        inside = ~separators[data]
        n = len(data)
        before, after = np.empty(n, bool), np.empty(n, bool)
        if n:
            before[0], after[-1] = False, False
            before[1:], after[:-1] = inside[:-1], inside[1:]
            cut = offsets[1:-1]
            before[cut[cut < n]] = False
            after[cut[cut > 0] - 1] = False
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.inside = inside
        self.first = np.searchsorted(self.start, offsets)
        self.counts = np.diff(self.first)
        self._hash = None

    def __len__(self) -> int:
        return len(self.start)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def lanes(self, some: np.ndarray | slice = slice(None)) -> Lanes:
        return Lanes(self.data, self.start[some], self.end[some] - self.start[some])

    @property
    def hash(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        if self._hash is None:
            self._hash = self.lanes().hash() if len(self.start) else np.empty(0, np.uint64)
        return self._hash


def of_column(column: pa.Array, separators: np.ndarray = SPACE, lower: bool = False) -> Words:
    data, offsets = raw(column)
    return Words(LOWER[data] if lower else data, offsets, separators)


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """The hash of the ``k`` values from each place on, len(h) - k + 1 of them, by doubling; each joint is mixed."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    joined = lambda x, y, size: mix(x, size) * _U(_GRAM_BASE) + y
    out, done, block, size, rest = None, 0, h, 1, k
    while rest:
        if rest & 1:
            part = block[done : done + n]
            out = part.copy() if out is None else joined(out, part, done)
            done += size
        rest >>= 1
        if rest:
            block = joined(block[: len(block) - size], block[size:], size)
            size *= 2
    return mix(out, k)


def doc_grams(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first word of each run of ``k`` words that lies within one document."""
    g = grams(words.hash, k)
    if not len(g):
        return g, np.empty(0, np.int64)
    doc = words.doc
    at = np.flatnonzero(doc[: len(g)] == doc[k - 1 :])
    return g[at], at


def distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values and, as int32, the number of each element's value; ``np.unique`` would hold three times as much."""
    order = np.argsort(x)
    found = x[order]
    new = np.empty(len(x), bool)
    new[:1] = True
    np.not_equal(found[1:], found[:-1], out=new[1:])
    which = np.empty(len(x), np.int32)
    which[order] = np.cumsum(new, dtype=np.int32) - 1
    return found[new], which


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def trimmed() -> None:
    """Gives free memory of this worker back, which would else stay with it while it waits for its next task."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        return


def lean(f: Callable) -> Callable:
    """A batch function that gives its memory back when it ends."""

    @functools.wraps(f)
    def run(*args, **named):
        try:
            yield from f(*args, **named)
        finally:
            trimmed()

    return run


def group(f: Callable[..., pa.Table], *args) -> Callable[[pa.Table], pa.Table]:
    """A function of one group, for ``applyInArrow``, that gives its memory back after a large one."""

    def run(table: pa.Table) -> pa.Table:
        out, large = f(table, *args), table.nbytes > 1 << 20
        del table
        if large:
            trimmed()
        return out

    return run
