"""Words and rolling hashes of whole Arrow batches, in NumPy.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D; these bytes never occur
inside a multi-byte UTF-8 character, so bytes and code points give the same words.  All
hashes are polynomial (Rabin-Karp) hashes modulo 2**64 with an odd base: a prefix sum of
``value * base**i`` yields the hash of every substring by one subtraction and one
multiplication with the inverse power.  Word hashes pass through a finaliser before they
enter the window polynomial, so that all 64 bits count.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Odd multipliers of the byte and the window polynomial (arbitrary, fixed for reproducible hashes).
BYTE_BASE, WINDOW_BASE, SECOND_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F
#: Text is hashed in pieces of about this many bytes, so that the working arrays stay small, and a longer document in sections of so many.
PIECE_BYTES, SECTION_BYTES = 1 << 20, 1 << 22

_SEPARATORS = np.zeros(256, bool)
_SEPARATORS[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection of 64-bit integers."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BYTE_VALUES = mix(np.arange(1, 257, dtype=U64) * U64(BYTE_BASE))


class Powers:
    """``base**i`` and its inverse modulo 2**64, kept and extended as longer texts come."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, U64)

    def need(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = 1 << (n - 1).bit_length()
            self.up, self.down = (np.concatenate([np.ones(1, U64), np.multiply.accumulate(np.full(n - 1, b, U64))]) for b in (self.base, self.inverse))
        return self.up[:n], self.down[:n]


@dataclass
class Words:
    """Words of a run of documents: ``data[start:end]`` each; document d has words ``offsets[d]:offsets[d + 1]``."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    offsets: np.ndarray


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and document offsets of a string column, without copying the text; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = pc.fill_null(column, "")
    _, at, data = column.buffers()
    wide = np.int64 if pa.types.is_large_string(column.type) else np.int32
    at = np.frombuffer(at, wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def pieces(data: np.ndarray, at: np.ndarray, limit: int = PIECE_BYTES):
    """(first document, last document + 1) so that each run holds about ``limit`` bytes; a longer document stands alone."""
    first = 0
    while first < len(at) - 1:
        last = max(first + 1, int(np.searchsorted(at, at[first] + limit, "right")) - 1)
        yield first, last
        first = last


def find_words(data: np.ndarray, at: np.ndarray) -> Words:
    inside = ~_SEPARATORS[data]
    begins, finishes = inside.copy(), inside.copy()
    if len(data):
        begins[1:] &= ~inside[:-1]
        finishes[:-1] &= ~inside[1:]
        full = at[:-1] < at[1:]
        first, last = at[:-1][full], at[1:][full] - 1
        begins[first], finishes[last] = inside[first], inside[last]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(finishes) + 1
    return Words(data, starts, ends, np.searchsorted(starts, at))


def word_hashes(words: Words, powers: Powers, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each word's bytes, A-Z as a-z if ``lower``."""
    found = np.zeros(len(words.starts), U64)
    # Block by block, so that one word of very many bytes takes no more memory than many words: a word's hash adds up over the blocks it spans.
    for at in range(0, len(words.data), SECTION_BYTES):
        data = words.data[at : at + SECTION_BYTES]
        up, down = powers.need(len(data) + 1)
        total = np.zeros(len(data) + 1, U64)
        np.cumsum(_BYTE_VALUES[_LOWER[data] if lower else data] * up[: len(data)], out=total[1:])
        a, z = np.searchsorted(words.ends, at, "right"), np.searchsorted(words.starts, at + len(data))
        starts, ends = np.maximum(words.starts[a:z], at) - at, np.minimum(words.ends[a:z], at + len(data)) - at
        part = (total[ends] - total[starts]) * down[starts]
        if z > a and words.starts[a] < at:
            part[:1] *= np.array([pow(powers.base, int(at - words.starts[a]), 1 << 64)], U64)
        found[a:z] += part
    return mix(found + (words.ends - words.starts).astype(U64) * U64(SECOND_BASE))


def hashed_pieces(data: np.ndarray, at: np.ndarray, width: int, powers: Powers, lower: bool = False):
    """Word hashes piece by piece, for windows of ``width`` words: (first document, last + 1, word offsets, hashes, words before, whether the documents end here).

    A long document comes in sections that begin with the last ``width - 1`` words of the one before, so each window lies in one section.
    """
    for first, last in pieces(data, at):
        begin, end = int(at[first]), int(at[last])
        if last - first > 1 or end - begin <= SECTION_BYTES:
            words = find_words(data[begin:end], at[first : last + 1] - begin)
            yield first, last, words.offsets, word_hashes(words, powers, lower), 0, True
            continue
        kept, before = np.zeros(0, U64), 0
        while begin < end:
            stop = _next_separator(data, min(begin + SECTION_BYTES, end), end)
            words = find_words(data[begin:stop], np.array([0, stop - begin]))
            hashes = np.concatenate([kept, word_hashes(words, powers, lower)])
            yield first, last, np.array([0, len(hashes)]), hashes, before, stop == end
            kept = hashes[max(0, len(hashes) - width + 1) :]
            before, begin = before + len(hashes) - len(kept), stop


def _next_separator(data: np.ndarray, start: int, end: int) -> int:
    for at in range(start, end, PIECE_BYTES):
        found = np.flatnonzero(_SEPARATORS[data[at : min(at + PIECE_BYTES, end)]])
        if len(found):
            return at + int(found[0])
    return end


def window_hashes(hashes: np.ndarray, width: int, powers: Powers) -> np.ndarray:
    """Hash of every run of ``width`` successive word hashes (across documents as well)."""
    if len(hashes) < width:
        return np.zeros(0, U64)
    up, down = powers.need(len(hashes) + 1)
    total = np.zeros(len(hashes) + 1, U64)
    np.cumsum(hashes * up[: len(hashes)], out=total[1:])
    return mix((total[width:] - total[:-width]) * down[: len(hashes) - width + 1])


def window_starts(offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """First word of each window that lies in one document, and that document's number."""
    counts = np.maximum(np.diff(offsets) - width + 1, 0)
    document = np.repeat(np.arange(len(counts)), counts)
    before = np.cumsum(counts) - counts
    return np.arange(len(document)) - before[document] + offsets[:-1][document], document


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` successive values, by doubling."""
    if len(values) < width:
        return values[:0]
    done, out = 1, values
    while 2 * done <= width:
        out = np.minimum(out[:-done], out[done:])
        done *= 2
    rest = width - done
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out
