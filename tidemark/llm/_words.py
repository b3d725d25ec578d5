"""Word and shingle hashes of whole Arrow batches, in NumPy over the texts' bytes.

Texts are cut into pieces of half a MB, between documents or, in a very long one, at a separator; what is held beside
the texts is a few arrays of a piece's length and eight bytes a word. Each word is hashed alike wherever it is cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 1 << 19
U64 = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """The finishing step of SplitMix64."""
    x = x + U64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def odd_constants(n: int, seed: int) -> np.ndarray:
    return mix64(np.arange(n, dtype=U64) + U64(seed) * U64(1_000_003)) | U64(1)


def separators(*spans: tuple[int, int]) -> np.ndarray:
    """A table by byte of what stands between words, from inclusive ranges."""
    table = np.zeros(256, bool)
    for lo, hi in spans:
        table[lo : hi + 1] = True
    return table


#: White space of the ASCII table.
BLANKS = separators((0x20, 0x20), (0x09, 0x0D))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = mix64(np.arange(256, dtype=U64))[_LOWER]
_BASE = U64(0x5851F42D4C957F2D)
_INVERSE = U64(pow(int(_BASE), -1, 1 << 64))
_powers: dict[int, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    """base**0 to base**n modulo 2**64; kept for pieces of the usual size."""
    key = int(base)
    if key not in _powers or len(_powers[key]) <= n:
        table = np.full(max(n, PIECE_BYTES) + 1, base, U64)
        table[0] = 1
        _powers[key] = np.multiply.accumulate(table)
    return _powers[key][: n + 1]


def _hash_piece(data: np.ndarray, cuts: np.ndarray, blank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each word in `data`: its hash after lower-casing A-Z, and its start. No word crosses `cuts`."""
    word = ~blank[data]
    before = np.empty_like(word)
    before[0], before[1:] = False, word[:-1]
    before[cuts[cuts < len(data)]] = False
    starts = np.flatnonzero(word & ~before)
    if not len(starts):
        return np.empty(0, U64), starts
    after = np.empty_like(word)
    after[-1], after[:-1] = False, word[1:]
    after[cuts[(cuts > 0) & (cuts <= len(data))] - 1] = False
    ends = np.flatnonzero(word & ~after) + 1
    total = np.empty(len(data) + 1, U64)
    total[0] = 0
    np.cumsum(_BYTE[data] * _power(_BASE, len(data) - 1), out=total[1:])
    return mix64((total[ends] - total[starts]) * _power(_INVERSE, len(data))[starts] + (ends - starts).astype(U64)), starts


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, nulls as empty, and each text's offsets into them."""
    column = pc.fill_null(column, "")
    if pa.types.is_large_string(column.type):
        width, kind = np.int64, column.type
    else:
        width, kind = np.int32, pa.string()
    column = column.cast(kind)
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def word_batches(column: pa.Array, blank: np.ndarray = BLANKS, docs_bytes: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, hashes, counts): word hashes of the texts first to last-1, in order, and words per text."""
    data, offs = text_bytes(column)
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + docs_bytes, "right")) - 1)
        a, b = int(offs[lo]), int(offs[hi])
        hashes, places, at = [], [], a
        while at < b:
            end = min(b, at + PIECE_BYTES)
            if end < b:  # only inside one long text: go on to the next separator
                while end < b:
                    stop = np.flatnonzero(blank[data[end : min(b, end + PIECE_BYTES)]])
                    if len(stop):
                        end += int(stop[0])
                        break
                    end = min(b, end + PIECE_BYTES)
            h, s = _hash_piece(data[at:end], offs[lo : hi + 1] - at if hi - lo > 1 else np.array([0], np.int64), blank)
            hashes.append(h)
            places.append(s + at)
            at = end
        h = np.concatenate(hashes) if hashes else np.empty(0, U64)
        s = np.concatenate(places) if places else np.empty(0, np.int64)
        counts = np.diff(np.searchsorted(s, offs[lo : hi + 1]))
        yield lo, hi, h, counts
        lo = hi


def shingles(hashes: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's k-word runs, in order, and their number per text; a shorter text's words are one run."""
    factor = odd_constants(k, 7)
    ends = np.cumsum(counts)
    starts = ends - counts
    n = len(hashes)
    if not n:
        return np.empty(0, U64), np.zeros(len(counts), np.int64)
    full = np.zeros(n, bool)
    runs = np.maximum(counts - k + 1, 0)
    short = (counts > 0) & (counts < k)
    number = runs + short
    # A run's place is its first word's; those of full runs fill a text but for its last k-1 words.
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts[runs > 0], 1)
    np.add.at(edge, (starts + runs)[runs > 0], -1)
    full = np.cumsum(edge[:-1]) > 0
    out = np.zeros(n, U64)
    if n >= k:
        total = hashes[: n - k + 1] * factor[0]
        for j in range(1, k):
            total = total + hashes[j : n - k + 1 + j] * factor[j]
        out[: n - k + 1] = mix64(total)
    for i in np.flatnonzero(short):
        s, c = starts[i], counts[i]
        out[s] = mix64(np.sum(hashes[s : s + c] * factor[:c], keepdims=True) + U64(c))[0]
        full[s] = True
    return out[full], number
