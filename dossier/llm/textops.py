"""Words of whole texts as numpy arrays.

A batch of texts is one byte buffer; words are pairs of offsets into it, and a word stands for its
64-bit hash. Everything is a few numpy passes over the buffer, so no Python object is made per word.
Word hashes are polynomial with a final mix; equal words have equal hashes, unequal ones collide
with a chance of about 2**-64 a pair.
"""

import numpy as np
from pyspark.sql import types as T

SLICE_BYTES = 2_000_000  # of text that is worked on at once; a longer text is worked on alone
_U = np.uint64
_BASE, _STEP = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93  # odd, so that they have inverses
_LETTER = np.random.default_rng(20240101).integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)

SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers = {}


def _power(base, n):
    """base**0 .. base**(n-1) and the inverse powers, modulo 2**64; kept per worker and grown by doubling."""
    if base not in _powers or len(_powers[base][0]) < n:
        size = max(1 << 16, 1 << int(n - 1).bit_length()) if n else 1

        def row(b):
            out = np.full(size, b, np.uint64)
            out[0] = 1
            return np.cumprod(out, dtype=np.uint64)

        _powers[base] = row(base), row(pow(base, -1, 2**64))
    return _powers[base][0][:n], _powers[base][1][:n]


def mix(x):
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    return x


class Words:
    """Words of some texts: bytes ``start[i]:end[i]`` of ``data``; text k has words ``first[k]:first[k+1]``."""

    def __init__(self, array, lower=False, gaps=SPACE):
        data, offsets, present = buffers(array)
        self.data = LOWER[data] if lower else data
        n = len(data)
        inside = np.zeros(n + 2, bool)
        inside[1:-1] = ~gaps[data]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        self.start = np.flatnonzero(inside[1:] & (~inside[:-1] | edge))
        self.end = np.flatnonzero(inside[:-1] & (~inside[1:] | edge))
        self.first = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.first)
        self.offsets, self.present = offsets, present

    def __len__(self):
        return len(self.start)

    def hashes(self, most=None):
        """A hash for each word, or for its first ``most`` bytes."""
        end = self.end if most is None else np.minimum(self.end, self.start + most)
        up, down = _power(_BASE, len(self.data))
        sums = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(_LETTER[self.data] * up, out=sums[1:])
        out = sums[end]
        out -= sums[self.start]
        if len(out):
            out *= down[self.start]
        return mix(out + (end - self.start).astype(np.uint64) * _U(_STEP))

    def text_of(self):
        """The index of the text of each word."""
        return np.repeat(np.arange(len(self.count)), self.count)

    def fits(self, size):
        """For each word, whether ``size`` words start there in its text."""
        return np.arange(len(self)) + size <= np.repeat(self.first[1:], self.count)


def windows(hashes, size, step=_STEP):
    """A hash for each ``size`` consecutive values; entry i covers i..i+size-1. Use a second ``step`` for a second hash."""
    n = len(hashes)
    if n < size:
        return np.zeros(0, np.uint64)
    up, down = _power(step, n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * up, out=sums[1:])
    return mix((sums[size:] - sums[: n + 1 - size]) * down[: n + 1 - size])


def buffers(array):
    """Bytes, offsets and presence of a string array; a null is an empty text."""
    import pyarrow as pa

    if not pa.types.is_large_string(array.type):
        array = array.cast(pa.large_string())
    present = np.ones(len(array), bool) if array.null_count == 0 else np.asarray(array.is_valid())
    if array.null_count:
        array = array.fill_null("")
    if len(array) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64), present
    _, offsets, data = array.buffers()
    offsets = np.frombuffer(offsets, np.int64)[array.offset : array.offset + len(array) + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0], present


def widened(schema, added):
    """The fields of a schema that are not among the added ones (DDL; in any letter case), and the schema of both, for a map over batches."""
    new = T._parse_datatype_string(added)
    names = {n.lower() for n in new.names}
    rest = [T.StructField(f.name, f.dataType) for f in schema if f.name.lower() not in names]
    return [f.name for f in rest], T.StructType([*rest, *new])


def slices(batch, column="text", most=SLICE_BYTES):
    """Cuts a record batch into runs of rows of at most ``most`` bytes of text, or of one row."""
    import pyarrow.compute as pc

    if batch.num_rows == 0:
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch[column]), 0)).astype(np.int64)
    begin, held = 0, 0
    for i, size in enumerate(sizes):
        if i > begin and held + size > most:
            yield batch.slice(begin, i - begin)
            begin, held = i, 0
        held += size
    yield batch.slice(begin)
