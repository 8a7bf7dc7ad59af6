"""Vectorised text kernels over the byte buffers of Arrow string columns.

A column's bytes lie one text after another, so words, hashes and shingles of
many texts come from a few numpy passes and no Python loop over words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240229))
#: A random 64-bit value for each byte; FOLD gives A-Z the values of a-z.
BYTE = _rng.integers(0, 2**64, 256, dtype=U)
FOLD = BYTE.copy()
FOLD[65:91] = BYTE[97:123]
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 2**64)
#: Bytes that are hashed in one pass.
BLOCK = 1 << 20
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_STOP = np.zeros(256, bool)
_STOP[list(b'.,!?;:*$&%#()"')] = True
_PRINT = np.zeros(256, bool)
_PRINT[0x21:0x7F] = True
_tables: dict[str, np.ndarray] = {}


def _powers(name: str, base: int, n: int) -> np.ndarray:
    have = _tables.get(name)
    if have is None or len(have) < n:
        size = max(n, BLOCK + 1)
        have = np.full(size, base, U)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= 4 * BLOCK:
            _tables[name] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit over all 64 bits."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def hash_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = BYTE) -> np.ndarray:
    """A 64-bit hash of buf[start:end] for sorted spans that don't overlap."""
    out = np.empty(len(starts), U)
    i = 0
    while i < len(starts):
        base = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, base + BLOCK, "right")))
        n = int(ends[j - 1] - base)
        sums = np.zeros(n + 1, U)
        np.cumsum(table[buf[base : base + n]] * _powers("up", _BASE, n), out=sums[1:])
        s, e = starts[i:j] - base, ends[i:j] - base
        out[i:j] = mix((sums[e] - sums[s]) * _powers("down", _BASE_INV, n + 1)[s] + (e - s).astype(U) * U(0xD6E8FEB86659FD93))
        i = j
    return out


def words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, words in each text) of words [^\\x20\\x09-\\x0D]+."""
    n = len(buf)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets) - 1, np.int64)
    solid = ~SPACE[buf]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = solid[:-1]
    starts = np.flatnonzero(solid & (~before | edge[:n]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = solid[1:]
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offsets))


def safe_cuts(buf: np.ndarray, first: int) -> np.ndarray:
    """Places in buf[first:] where a text can be cut and encoded in parts.

    A part starts at white space after a character that isn't, or at one of a
    few ASCII marks after an ASCII letter. Pre-tokenizers that split into runs
    of letters, digits, marks and white space, with at most a leading space,
    never join across such a place, and no special token holds one.
    """
    lo = max(first, 2)
    cur, prev, prev2 = buf[lo:], buf[lo - 1 : -1], buf[lo - 2 : -2]
    plain = _PRINT[prev] | ((prev >= 0x80) & (prev2 == 0xC3))
    return np.flatnonzero((SPACE[cur] & plain) | (_STOP[cur] & _LETTER[prev])) + lo


def parts(buf: np.ndarray, offsets: np.ndarray, block: int = 2 * BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of (starts, ends, text number) of parts, balanced by bytes and in order.

    A long text goes over many blocks, each ending at a safe place, so memory
    follows the block and not the text.
    """
    at, total, size = 0, len(buf), block
    heads = offsets[:-1][np.diff(offsets) > 0]
    while at < total:
        end = min(total, at + size)
        cuts = safe_cuts(buf[:end], at) if end - at > 2 or at else np.zeros(0, np.int64)
        own = heads[np.searchsorted(heads, at) : np.searchsorted(heads, end)]
        # Places are marked and found in order; np.union1d hashes them, which took a third of a tokenizer's time.
        marked = np.zeros(end - at, bool)
        marked[0] = True
        marked[cuts[cuts > at] - at] = True
        marked[own - at] = True
        starts = np.flatnonzero(marked) + at
        if end < total:
            if len(starts) == 1:
                size *= 2
                continue
            starts, end = starts[:-1], int(starts[-1])
        size = block
        yield starts, np.append(starts[1:], end), np.searchsorted(offsets, starts, "right") - 1
        at = end


def shingles(buf: np.ndarray, offsets: np.ndarray, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """(text number, sorted distinct 64-bit hashes of its word shingles), letters A-Z folded.

    With fewer words than width the whole sequence is one shingle; without
    words there is none.
    """
    first = 0
    while first < len(offsets) - 1:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + BLOCK, "right")) - 1)
        own = offsets[first : last + 1] - offsets[first]
        some = buf[offsets[first] : offsets[last]]
        starts, ends, counts = words(some, own)
        h = hash_spans(some, starts, ends, FOLD)
        at = np.concatenate([[0], np.cumsum(counts)])
        if len(h) >= width:
            n = len(h) - width + 1
            wide = np.full(n, width, U)
            for j in range(width):
                wide += h[j : j + n] * U(((2 * j + 3) * 0xA24BAED4963EE407) % 2**64 | 1)
            wide = mix(wide)
        for k in np.flatnonzero(counts):
            c = int(counts[k])
            if c >= width:
                values = np.unique(wide[at[k] : at[k] + c - width + 1])
            else:
                acc = np.array([c], U)
                for x in h[at[k] : at[k + 1]]:
                    acc = mix(acc * U(0xFF51AFD7ED558CCD) + x)
                values = acc
            yield first + int(k), values
        first = last
