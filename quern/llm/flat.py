"""Arrow text columns as flat byte arrays: words, their hashes and shingles, for use inside tasks.

A batch of texts is one byte array with row bounds. Words are found and hashed with array operations
over all bytes, so the cost per text is small and the whole text is always read. Word bounds only ever
depend on ASCII bytes, so UTF-8 need not be decoded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once: a batch is cut at row ends, a longer text is hashed piece by piece.
PIECE_BYTES = 2 << 20
_HASH_STEP = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1
_CACHE: dict = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the public splitmix64 constants)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not _CACHE:
        inverse = pow(_BASE, -1, 1 << 64)
        for name, base in (("up", _BASE), ("down", inverse)):
            steps = np.full(_HASH_STEP + 1, base, np.uint64)
            steps[0] = 1
            _CACHE[name] = np.multiply.accumulate(steps)
        _CACHE["bytes"] = mix(np.arange(1, 257, dtype=np.uint64))
    return _CACHE["up"], _CACHE["down"], _CACHE["bytes"]


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z as a-z; all other bytes stay."""
    return data + ((data - np.uint8(65) < 26).view(np.uint8) << np.uint8(5))


WORD_BREAK = np.zeros(256, bool)
WORD_BREAK[[0x20, *range(0x09, 0x0E)]] = True


def column(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and the bounds of its rows; a null counts as an empty text."""
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    values = values.cast(pa.large_string()).fill_null("")
    if not len(values):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bounds = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
    data = np.frombuffer(values.buffers()[2], np.uint8) if values.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


def pieces(batches, text: str, size: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows of about `size` bytes of text; a single longer text stays one run."""
    for batch in batches:
        _, bounds = column(batch.column(batch.schema.get_field_index(text)))
        row = 0
        while row < batch.num_rows:
            end = int(np.searchsorted(bounds, bounds[row] + size, side="right")) - 1
            end = min(batch.num_rows, max(end, row + 1))
            yield batch.slice(row, end - row)
            row = end


def word_spans(data: np.ndarray, bounds: np.ndarray, is_break: np.ndarray = WORD_BREAK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each row the number of words before it (one more than rows)."""
    inside = ~is_break[data]
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(bounds), np.int64)
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:]
    edges = bounds[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    opens[edges] = inside[edges]
    closes[edges - 1] = inside[edges - 1]
    starts = np.flatnonzero(opens)
    return starts, np.flatnonzero(closes) + 1, np.searchsorted(starts, bounds)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes; equal bytes give equal hashes wherever they stand."""
    up, down, table = _powers()
    out = np.zeros(len(starts), np.uint64)
    first = 0
    while first < len(starts):
        base = int(starts[first])
        last = max(first + 1, int(np.searchsorted(ends, base + _HASH_STEP, side="right")))
        stop = int(ends[last - 1])
        if stop - base > _HASH_STEP:  # one span longer than the table of powers
            digest = np.uint64(0)
            for at in range(base, stop, _HASH_STEP):
                part = table[data[at : min(stop, at + _HASH_STEP)]]
                digest = mix(np.array([digest ^ (part * up[: len(part)]).sum(dtype=np.uint64)]))[0]
            out[first] = digest
        else:
            sums = np.zeros(stop - base + 1, np.uint64)
            np.cumsum(table[data[base:stop]] * up[: stop - base], out=sums[1:])
            at = starts[first:last] - base
            out[first:last] = (sums[ends[first:last] - base] - sums[at]) * down[at]
        first = last
    return mix(out ^ (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


#: The bits of the first bytes of a word of eight, by their number.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Longer spans are hashed by span_hashes.
_SHORT = 64


def short_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Other 64-bit hashes of the spans' bytes, read eight at a time; faster than span_hashes where most spans are words."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eights = np.ndarray(len(data) + 1, np.uint64, padded, strides=(1,))
    lengths = ends - starts
    out = mix((eights[starts] & _FIRST[np.minimum(lengths, 8)]) + lengths.view(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    rest = np.flatnonzero((lengths > 8) & (lengths <= _SHORT))
    for step in range(8, _SHORT, 8):
        out[rest] = mix(out[rest] * np.uint64(_BASE) + (eights[starts[rest] + step] & _FIRST[np.minimum(lengths[rest] - step, 8)]))
        rest = rest[lengths[rest] > step + 8]
    long = np.flatnonzero(lengths > _SHORT)
    if len(long):
        out[long] = span_hashes(data, starts[long], ends[long])
    return out


def span_hashes_at(data: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """span_hashes of spans that all have the same small size and may overlap."""
    up, _, table = _powers()
    out = np.zeros(len(starts), np.uint64)
    for k in range(size):
        out += table[data[starts + k]] * up[k]
    return mix(out ^ np.uint64((size * 0xD6E8FEB86659FD93) & (1 << 64) - 1))


def run_hashes(words: np.ndarray, counts: np.ndarray, size: int, short: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `size` words within rows, and the number of runs before each row.

    counts: words before each row. With short, a row of fewer words (but one) has one run of them all.
    """
    lengths = np.diff(counts)
    total = len(words)
    runs = np.zeros(max(0, total - size + 1), np.uint64)
    for k in range(size):
        runs = mix(runs * np.uint64(_BASE) + words[k : total - size + 1 + k]) if total >= size else runs
    number = np.maximum(lengths - size + 1, 0)
    if short:
        few = (lengths > 0) & (lengths < size)
        number = number + few
    before = np.concatenate([[0], np.cumsum(number)])
    rows = np.repeat(np.arange(len(lengths)), number)
    starts = counts[rows] + (np.arange(before[-1]) - before[rows])
    if not short or not few.any():
        return runs[starts], before
    out = np.zeros(before[-1], np.uint64)
    whole = ~few[rows]
    out[whole] = runs[starts[whole]]
    for row in np.flatnonzero(few):
        digest = np.full(1, lengths[row], np.uint64)
        for word in words[counts[row] : counts[row + 1]]:
            digest = mix(digest * np.uint64(_BASE) + word)
        out[before[row]] = digest[0]
    return out, before


def sort_in_rows(values: np.ndarray, before: np.ndarray) -> np.ndarray:
    """The values of each row in rising order."""
    values = values.copy()
    for row in np.flatnonzero(np.diff(before) > 1):
        values[before[row] : before[row + 1]].sort()
    return values


def distinct_in_rows(values: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of each row in rising order, and the number of them before each row."""
    values = sort_in_rows(values, before)
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    firsts = before[:-1]
    new[firsts[firsts < len(values)]] = True
    return values[new], np.concatenate([[0], np.cumsum(new)])[before]


def row_sums(values: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Sum of the values of each row."""
    sums = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])
    return sums[before[1:]] - sums[before[:-1]]


def lookup(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where each wanted value stands in the sorted keys, or -1."""
    if not len(keys):
        return np.full(len(wanted), -1, np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


class Places:
    """lookup() for keys that are searched many times: a table of slots leads most values to the one key they can equal.

    keys: sorted and distinct, int64. The table has at most SLOT_BITS bits; where keys share a slot, they are searched.
    """

    SLOT_BITS = 22

    def __init__(self, keys: np.ndarray):
        self.keys, every = keys, np.arange(len(keys), dtype=np.int32)
        bits = min(self.SLOT_BITS, max(1, (4 * len(keys)).bit_length()))
        self.shift = np.uint64(64 - bits)
        self.table = np.full(1 << bits, -1, np.int32)
        slots = self._slots(keys)
        self.table[slots] = every
        self.table[slots[self.table[slots] != every]] = -2

    def _slots(self, values: np.ndarray) -> np.ndarray:
        return ((values.view(np.uint64) * np.uint64(_BASE)) >> self.shift).view(np.int64)

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """Where each wanted value stands in the keys, or -1."""
        if not len(self.keys):
            return np.full(len(wanted), -1, np.int64)
        at = self.table[self._slots(wanted)]
        shared = np.flatnonzero(at == -2)
        at[self.keys[np.maximum(at, 0)] != wanted] = -1
        if len(shared):
            at[shared] = lookup(self.keys, wanted[shared])
        return at.astype(np.int64)


def signed(values: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(values).view(np.int64)
