"""Vectorised token arithmetic over Arrow batches: byte and word tokens, window hashes, sliding minima, covered spans.

Everything works on the flat bytes of many documents at once; `bounds` marks where each document begins and ends.
Hashes are 64 bit; where two hashes are compared together, a false match needs both to collide.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; bounds a task's memory whatever a batch holds.
CHUNK = 1 << 18

_RANDOM = np.random.Generator(np.random.PCG64(20240229))
BYTE_VALUE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _RANDOM.integers(1, 2**63, 1024, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FACTORS = [np.uint64(int(x) * 2 + 1) for x in _RANDOM.integers(2**61, 2**62, 64)]
WHITE = np.zeros(256, bool)
WHITE[[0x20, 9, 10, 11, 12, 13]] = True


def flat(column) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, null as empty, and the n + 1 offsets of its values."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def sliced(batch: pa.RecordBatch, text: str, size: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about `size` bytes of text each; one document stays in one part."""
    if not len(batch):
        return
    column = batch.column(batch.schema.get_field_index(text))
    length = np.asarray(pc.fill_null(pc.binary_length(column), 0), np.int64)
    part = (np.cumsum(length) - length) // size
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(batch)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield batch.slice(a, b - a)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over all 64 bits."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(32)
    return x


def words(data: np.ndarray, bounds: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every maximal run of non-separators within a document, and the first word per document."""
    inside = ~separator[data]
    before = np.empty_like(inside)
    if len(inside):
        before[0] = False
        before[1:] = inside[:-1]
    cut = bounds[1:-1]
    cut = cut[cut < len(data)]
    before[cut] = False
    start = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    if len(inside):
        after[-1] = False
        after[:-1] = inside[1:]
    cut = cut[cut > 0]
    after[cut - 1] = False
    end = np.flatnonzero(inside & ~after) + 1
    return start, end, np.searchsorted(start, bounds)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, separator: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes and their places."""
    if not len(start):
        return np.zeros(0, np.uint64)
    place = _origin(start, len(data))
    np.subtract(np.arange(len(data), dtype=place.dtype), place, out=place)
    value = BYTE_VALUE[data]
    if place.max() >= len(_PLACE):
        value ^= (place >> 10).astype(np.uint64) * _FACTORS[3]
    value *= _PLACE[place & 1023]
    value[separator[data]] = 0
    summed = np.add.reduceat(value, start)
    return mixed(summed ^ ((end - start).astype(np.uint64) * _FACTORS[0]))


def _origin(start: np.ndarray, n: int) -> np.ndarray:
    """For every byte where its word began, in the smallest type that holds it."""
    origin = np.zeros(n, np.int32 if n < 2**31 else np.int64)
    origin[start] = np.diff(start, prepend=0)
    return np.cumsum(origin, out=origin)


def grams(token: np.ndarray, length: int) -> np.ndarray:
    """Hash of every run of `length` tokens (len - length + 1 values), by doubling as in most-significant-digit passes."""
    n = len(token) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    done, have, power, width, level = None, 0, token, 1, 0
    rest = length
    while rest:
        if rest & 1:
            piece = power[have : have + n]
            done = piece.copy() if done is None else done * _FACTORS[10 + level] + piece
            have += width
        rest >>= 1
        if rest:
            power = power[:-width] * _FACTORS[20 + level] + power[width:]
            power ^= power >> np.uint64(29)
            width *= 2
            level += 1
    return done


def sliding(x: np.ndarray, width: int, op) -> np.ndarray:
    """op (np.minimum or np.maximum) over every run of `width` values."""
    out, have = x, 1
    while have * 2 <= width:
        out = op(out[:-have], out[have:])
        have *= 2
    if have < width:
        out = op(out[: len(x) - width + 1], out[width - have :])
    return out


def anchors(gram: np.ndarray, width: int) -> np.ndarray:
    """Places of the grams that are smallest in some run of `width` grams (all ties): every run holds one.

    With fewer grams than `width` there is no full run and no anchor.
    """
    if len(gram) < width:
        return np.zeros(0, np.int64)
    low = sliding(gram, width, np.minimum)
    pad = np.zeros(width - 1, np.uint64)
    best = sliding(np.concatenate([pad, low, pad]), width, np.maximum)
    return np.flatnonzero(best == gram)
