"""Words of whole Arrow text columns as 64-bit hashes, computed with numpy.

A word is a run of bytes between separator bytes of the UTF-8 text; A-Z are read as a-z.
Hashes depend on the word's bytes alone, so they agree between tasks and machines.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_PIECE = 1 << 19

# Fixed values: \x20 and \x09-\x0D.
WHITE = np.isin(np.arange(256), [0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])
# Every ASCII byte that is neither a letter nor a digit.
NOT_WORD = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, _PIECE + 4096)
        for at, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[at] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the offsets of each; null counts as empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    body = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return body, at - at[0]


def hash_words(texts: pa.Array, separators: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and where each text's words begin (one entry more than texts)."""
    body, offsets = text_bytes(texts)
    n = len(body)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    breaks = separators[body]
    starts = ~breaks
    starts[1:] &= breaks[:-1]
    ends = ~breaks
    ends[:-1] &= breaks[1:]
    inner = offsets[(offsets > 0) & (offsets < n)]
    starts[inner] = ~breaks[inner]
    ends[inner - 1] = ~breaks[inner - 1]
    first, last = np.flatnonzero(starts), np.flatnonzero(ends)
    hashes = np.empty(len(first), np.uint64)
    done = 0
    while done < len(first):  # pieces of whole words, so that the tables stay small
        begin = first[done]
        upto = max(done + 1, int(np.searchsorted(last, begin + _PIECE)))
        stop = last[upto - 1] + 1
        power, inverse = _power_tables(int(stop - begin))
        total = np.zeros(stop - begin + 1, np.uint64)
        values = _LOWER[body[begin:stop]].astype(np.uint64)
        values += np.uint64(1)
        values *= power[: stop - begin]
        np.cumsum(values, out=total[1:])
        at = first[done:upto] - begin
        hashes[done:upto] = (total[last[done:upto] + 1 - begin] - total[at]) * inverse[at]
        done = upto
    return mix(hashes), np.searchsorted(first, offsets)


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of a text's word n-grams; a shorter text counts as one n-gram."""
    n = len(words)
    if n == 0:
        return words
    length = min(n, size)
    total = np.full(n - length + 1, np.uint64(length), np.uint64)
    for i in range(length):
        total *= _BASE
        total += words[i : n - length + 1 + i]
    total = np.sort(mix(total))
    return total[np.concatenate(([True], total[1:] != total[:-1]))]


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each holds about ``limit`` bytes of text, or one longer text."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        total = np.cumsum(lengths)
        begin = 0
        while begin < batch.num_rows:
            base = total[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(total, base + limit, "right")))
            yield batch.slice(begin, end - begin)
            begin = end
    pa.default_memory_pool().release_unused()  # workers live on between stages
