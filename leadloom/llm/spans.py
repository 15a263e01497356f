"""Words of Arrow text columns as byte ranges and 64-bit hashes, computed with numpy.

UTF-8 lets word rules over ASCII work on bytes: every byte of a longer character is 0x80 or
more and belongs to a word. A word's hash is a polynomial over random values of its bytes,
read off prefix sums, so that a batch takes a few passes over its bytes whatever the words
are. All arithmetic wraps at 64 bits.
"""

import numpy as np
import pyarrow as pa

PIECE = 1 << 18  # bytes that are worked on at once: arrays of eight bytes for each are made of them
_U = np.uint64


def mix(x):
    """The splitmix64 finaliser: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def _byte_table(keep):
    table = np.zeros(256, dtype=bool)
    table[[b for b in range(256) if keep(b)]] = True
    return table


#: Words between white space, and words of letters, digits and non-ASCII characters.
BETWEEN_SPACES = _byte_table(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
LETTERS_AND_DIGITS = _byte_table(lambda b: b >= 0x80 or chr(b).isalnum())
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_VALUES = mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))
_LOWERED = _VALUES[LOWER]
_BASE = 0x9E3779B97F4A7C15 | 1
_powers = [np.ones(1, _U), np.ones(1, _U)]


def _power_tables(n):
    """Powers of the base and of its inverse, at least n of each."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            values = np.full(size, _U(base), _U)
            values[0] = 1
            with np.errstate(over="ignore"):
                _powers[k] = np.cumprod(values, dtype=_U)
    return _powers


def text_column(column):
    """(bytes, offsets) of an Arrow string column; NULL is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null("")
    _, places, data = column.buffers()
    offsets = np.frombuffer(places, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), offsets
    return np.frombuffer(data, np.uint8), offsets


def slices(data, offsets, size=PIECE):
    """Runs of whole texts of at most ``size`` bytes, or one longer text: (first, bytes, offsets)."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1
        last = min(max(last, first + 1), n)
        low = offsets[first]
        yield first, data[low : offsets[last]], offsets[first : last + 1] - low
        first = last


def word_ranges(data, offsets, inside):
    """(starts, ends, bounds): byte ranges of all words, and the number of words before each text."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    word = inside[data]
    starts, ends = word.copy(), word.copy()
    starts[1:] &= ~word[:-1]
    ends[:-1] &= ~word[1:]
    filled = offsets[:-1][offsets[1:] > offsets[:-1]]
    starts[filled] = word[filled]
    last = offsets[1:][offsets[1:] > offsets[:-1]] - 1
    ends[last] = word[last]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hashes(data, starts, ends, lower=True):
    """A 64-bit hash of each byte range; ranges are in ascending order and may touch."""
    out = np.empty(len(starts), _U)
    values, i = _LOWERED if lower else _VALUES, 0
    with np.errstate(over="ignore"):
        while i < len(starts):
            low = starts[i]
            j = max(int(np.searchsorted(ends, low + PIECE, "right")), i + 1)
            n = int(ends[j - 1] - low)
            power, inverse = _power_tables(n + 1)
            sums = np.zeros(n + 1, _U)
            np.cumsum(values[data[low : low + n]] * power[:n], out=sums[1:])
            s, e = starts[i:j] - low, ends[i:j] - low
            out[i:j] = mix((sums[e] - sums[s]) * inverse[s] + (e - s).astype(_U))
            i = j
    return out


def shingles(words, bounds, size):
    """(hashes, bounds) of runs of ``size`` words; a shorter text, unless it is empty, is one run."""
    counts = np.diff(bounds)
    n = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    out_bounds = np.concatenate(([0], np.cumsum(n)))
    out = np.empty(out_bounds[-1], _U)
    text = np.repeat(np.arange(len(counts)), n)
    place = bounds[text] + np.arange(len(out)) - out_bounds[text]
    length = np.minimum(counts, size)[text]
    with np.errstate(over="ignore"):
        for width in np.unique(length):
            chosen = np.flatnonzero(length == width)
            value = np.full(len(chosen), _U(width))
            for k in range(width):
                value = value * _U(0xD6E8FEB86659FD93) + words[place[chosen] + k]
            out[chosen] = mix(value)
    return out, out_bounds
