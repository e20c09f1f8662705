"""Vectorised word and shingle hashing over Arrow text columns.

A word is a run of letters, marks, numbers (Unicode categories L, M, N) and ``_``, in lower case; everything else separates. Of a run
of more than 64 KB each 64 KB are a word. Hashes are polynomial over bytes modulo 2**64, finished by a mixer. Rows are taken in pieces
of bounded bytes, and a row above that bound in parts that carry the words before them over the cut, so that the memory of
a task follows neither the batch size nor, but for 8 bytes a word where all hashes are wanted, the length of a text.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_R = 0x9E3779B97F4A7C15
_RI = pow(_R, -1, 2**64)
_TAB = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), 95, *range(97, 123), *range(128, 256)]] = True
_C = np.random.default_rng(7).integers(1, 2**63, 64, dtype=np.uint64) * U(2) + U(1)
_POW: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    return x


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept and grown by doubling."""
    have = _POW.get(base)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << int(n - 1).bit_length())
        have = np.full(size, base, np.uint64)
        have[0] = 1
        _POW[base] = have = np.multiply.accumulate(have)
    return have[:n]


def pieces(column: pa.Array, most_bytes: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most_bytes`` each, or of one row."""
    length = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    at = 0
    ends = np.cumsum(length)
    while at < len(length):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + most_bytes, side="right")))
        yield at, to
        at = to


def raw(column: pa.Array, lower: bool = True, stop: str | None = " ") -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the rows; null is empty. Each row is followed by ``stop``."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if lower:
        column = pc.utf8_lower(column)
    if stop is not None:
        column = pc.binary_join_element_wise(column, pa.scalar("", pa.large_string()), pa.scalar(stop, pa.large_string()))
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


_IN_WORD: dict[int, bool] = {}


def _in_word(point: int) -> bool:
    got = _IN_WORD.get(point)
    if got is None:
        _IN_WORD[point] = got = point <= 0x10FFFF and unicodedata.category(chr(point))[0] in "LMN"
    return got


def word_bytes(data: np.ndarray) -> np.ndarray:
    """Whether each byte of UTF-8 text belongs to a word."""
    out = _WORD[data]
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        first = data[lead].astype(np.uint32)
        size = 2 + (first >= 0xE0) + (first >= 0xF0)
        whole = lead + size <= len(data)  # a character that is cut off belongs to the word
        lead, first, size = lead[whole], first[whole], size[whole]
        point = first & np.array([0, 0, 0x1F, 0x0F, 0x07], np.uint32)[size]
        for k in (1, 2, 3):
            more = size > k
            point[more] = (point[more] << np.uint32(6)) | (data[lead[more] + k] & np.uint32(0x3F))
        each, where = np.unique(point, return_inverse=True)
        no = ~np.array([_in_word(p) for p in each.tolist()], bool)[where]
        for k in range(4):
            out[lead[no & (size > k)] + k] = False
    return out


def prefix(data: np.ndarray) -> np.ndarray:
    h = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TAB[data] * powers(_R, len(data)), out=h[1:])
    return h


def ranges(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the byte ranges."""
    return mix((h[end] - h[start]) * powers(_RI, len(h))[start])


#: Bytes of the longest word, and of a part of a long row.
LONGEST, PART = 1 << 16, 1 << 20
#: Hashes of words that are carried over the cut of a long row.
CARRY = 64


def _cut_back(data: np.ndarray, at: int) -> int:
    """The start of the character at ``at``."""
    while at and at < len(data) and data[at] & 0xC0 == 0x80:
        at -= 1
    return at


class Words:
    """Words of some rows: ``start``, ``end`` (byte places), ``first`` (word number of each row's first word, and the total).

    Where the rows are one part of a long row, ``head`` and ``tail`` tell whether it is the first and the last part, ``before`` has the
    hashes of up to CARRY words before it, and ``n_before`` is their whole number.
    """

    head = tail = True
    n_before = 0
    before = np.zeros(0, np.uint64)

    def __init__(self, column: pa.Array | None = None, data: np.ndarray | None = None):
        """From a column, or from a part of one lowered text."""
        if data is None:
            self.data, self.offs = raw(column)
        else:
            self.data, self.offs = data, np.array([0, len(data)])
        is_word = word_bytes(self.data)
        edge = np.flatnonzero(is_word[1:] != is_word[:-1]) + 1 if len(is_word) else np.zeros(0, np.int64)
        if len(is_word) and is_word[0]:
            edge = np.concatenate([[0], edge])
        if len(edge) % 2:
            edge = np.append(edge, len(is_word))
        self.start, self.end = edge[0::2], edge[1::2]
        if len(edge) and (self.end - self.start).max() > LONGEST:
            self._split()
        self.first = np.searchsorted(self.start, self.offs)
        self.h = prefix(self.data)
        self.hash = ranges(self.h, self.start, self.end)

    def _split(self) -> None:
        start, end = [], []
        for a, b in zip(self.start.tolist(), self.end.tolist(), strict=True):
            while b - a > LONGEST:
                cut = _cut_back(self.data, a + LONGEST)
                start.append(a)
                end.append(cut)
                a = cut
            start.append(a)
            end.append(b)
        self.start, self.end = np.array(start), np.array(end)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def shingles(self, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the shingles in order, and each row's first. A row of fewer than k words has one, of all its words; a row of no words none.

        Of a part of a long row, those that end in it.
        """
        if not (self.head and self.tail):
            words = np.concatenate([self.before[max(0, len(self.before) - k + 1) :], self.hash])
            if self.n_before + len(self.hash) < k:
                g = _shingle(np.concatenate([words, np.zeros(k, np.uint64)]), np.arange(int(self.tail and len(words) > 0)), k)
            else:
                g = _shingle(words, np.arange(max(0, len(words) - k + 1)), k)
            return g, np.array([0, len(g)])
        n = self.counts()
        number = np.where(n >= k, n - k + 1, np.minimum(n, 1))
        first = np.concatenate([[0], np.cumsum(number)])
        at = np.arange(first[-1]) - np.repeat(first[:-1] - self.first[:-1], number)
        last = np.repeat(self.first[1:], number)
        padded = np.concatenate([self.hash, np.zeros(k, np.uint64)])
        g = padded[at] * _C[0]
        for j in range(1, k):
            g += np.where(at + j < last, padded[at + j], U(0)) * _C[j]
        return mix(g), first

    def sums(self, salt: int) -> np.ndarray:
        """Of each row the sum that its ``signature`` is made of; of a part of a long row, what it adds."""
        w = mix(self.hash + U(salt * 2 + 1)) * powers(_R, len(self.hash))
        h = np.zeros(len(w) + 1, np.uint64)
        np.cumsum(w, out=h[1:])
        out = (h[self.first[1:]] - h[self.first[:-1]]) * powers(_RI, len(h) + 1)[self.first[:-1]]
        return out * U(pow(_R, self.n_before, 2**64)) if self.n_before else out


def _shingle(words: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    g = words[at] * _C[0]
    for j in range(1, k):
        g += words[at + j] * _C[j]
    return mix(g)


class Hashes:
    """Word hashes of all rows, 8 bytes a word; the hashing of bytes takes many times the room of its result and goes part by part."""

    def __init__(self, column: pa.Array):
        hashes, counts = [np.zeros(0, np.uint64)], np.zeros(len(column), np.int64)
        for a, b, words in word_parts(column):
            hashes.append(words.hash)
            counts[a:b] += words.counts()
        self.hash = np.concatenate(hashes)
        self.first = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """As those of ``Words``."""
        n = self.counts()
        number = np.where(n >= k, n - k + 1, np.minimum(n, 1))
        first = np.concatenate([[0], np.cumsum(number)])
        out = np.empty(first[-1], np.uint64)
        m = max(0, len(self.hash) - k + 1)
        run = self.hash[:m] * _C[0]  # of k words from each place, over the ends of rows
        for j in range(1, k):
            run += self.hash[j : j + m] * _C[j]
        run = mix(run)
        full = n >= k
        if full.all() and len(n) == 1:
            return run, first
        keep = np.zeros(m + 1, np.int64)
        np.add.at(keep, self.first[:-1][full], 1)
        np.add.at(keep, self.first[1:][full] - k + 1, -1)
        out[np.repeat(full, number)] = run[np.cumsum(keep[:-1]) > 0]
        for r in np.flatnonzero(~full & (n > 0)).tolist():
            out[first[r]] = _shingle(np.concatenate([self.hash[self.first[r] : self.first[r + 1]], np.zeros(k, np.uint64)]), np.arange(1), k)[0]
        return out, first


def signature(sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A hash of each row's word sequence."""
    return mix(sums + counts.astype(np.uint64))


def word_parts(column: pa.Array, most: int = 1_000_000) -> Iterator[tuple[int, int, Words]]:
    """(from, to, words) of rows in pieces of at most ``most`` bytes; a longer row comes in parts, one after another."""
    for a, b in pieces(column, most):
        part = column.slice(a, b - a)
        if b - a > 1 or (pc.binary_length(part)[0].as_py() or 0) <= PART:
            yield a, b, Words(part)
            continue
        data, _ = raw(part)
        before, n_before, at = Words.before, 0, 0
        while at < len(data):
            end = _part_end(data, at)
            words = Words(data=data[at:end])
            words.head, words.tail, words.before, words.n_before = at == 0, end == len(data), before, n_before
            yield a, b, words
            before, n_before, at = np.concatenate([before, words.hash])[-CARRY:], n_before + len(words.hash), end


def _part_end(data: np.ndarray, at: int) -> int:
    """Where a part that starts at ``at`` ends: behind an ASCII separator, or within a run of more than LONGEST bytes at the cut of one of its words."""
    target = at + PART
    if target >= len(data):
        return len(data)
    gap = np.flatnonzero(~_WORD[data[target - LONGEST : target]])
    if len(gap):
        return target - LONGEST + int(gap[-1]) + 1
    inside = np.flatnonzero(~word_bytes(data[at:target]))
    run = at + int(inside[-1]) + 1 if len(inside) else at
    run = max(run, at)
    if run > target - LONGEST:
        return run
    while (cut := _cut_back(data, run + LONGEST)) <= target:
        run = cut
    return run


def at_least(values: np.ndarray, first: np.ndarray, ufunc=np.minimum, empty=np.uint64(0)) -> np.ndarray:
    """``ufunc.reduceat`` that gives ``empty`` for rows without values."""
    out = np.full(len(first) - 1, empty, values.dtype)
    full = first[1:] > first[:-1]
    if full.any():
        out[full] = ufunc.reduceat(values, first[:-1][full])
    return out
