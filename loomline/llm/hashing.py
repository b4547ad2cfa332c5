"""Word hashes, word shingles and the fixed-size frequency sketch.

Texts are turned into NumPy arrays of 64-bit word hashes one Arrow batch at a
time, so everything after the tokenizer is vectorised over the whole batch.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

#: Runs of letters of any script, digits and underscores.
WORD = re.compile(r"\w+")
#: The sketch has 2**LEAST_BITS to 2**MOST_BITS one-byte counters: 16 MB at most, whatever the corpus holds.
LEAST_BITS, MOST_BITS = 16, 24
#: Counters travel in blocks of this many.
BLOCK = 4096
#: A worker forgets its word hashes beyond this many different words.
CACHE_WORDS = 1_000_000

_U = np.uint64


class WordHashes(dict):
    """Word -> 64-bit hash, computed once per word and worker."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


HASHES = WordHashes()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


def words_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words of all texts, number of words of each text)."""
    get, find = HASHES.__getitem__, WORD.findall
    parts, counts = [], np.zeros(len(texts), dtype=np.int64)
    for i, text in enumerate(texts):
        found = find(text)
        counts[i] = len(found)
        parts.extend(map(get, found))
    return np.array(parts, dtype=np.uint64), counts


def shingles_of(words: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-word sequences that lie inside one text; their number per text."""
    sizes = np.maximum(counts - (n - 1), 0)
    if not sizes.sum():
        return np.zeros(0, dtype=np.uint64), sizes
    m = len(words) - (n - 1)
    with np.errstate(over="ignore"):
        h = words[:m].copy()
        for j in range(1, n):
            h = h * _U(0x9E3779B97F4A7C15) + words[j : m + j]
        h = mix(h)
    doc = np.repeat(np.arange(len(counts)), counts)
    inside = doc[:m] == doc[n - 1 :]
    return h[inside], sizes


def starts_of(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(sizes)[:-1])) if len(sizes) else np.zeros(0, dtype=np.int64)


def record_text(prompt: str | None, code: str | None) -> str:
    """The record of a problem: prompt, a blank, code; null reads as empty; lower case."""
    return f"{prompt or ''} {code or ''}".lower()


def slices(texts: list[str], most_chars: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of a batch whose texts together stay near most_chars, so that long texts don't fill memory."""
    first = size = 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= most_chars:
            yield first, i + 1
            first, size = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def sketch_bits(rows: int, per_row: int = 32) -> int:
    return min(MOST_BITS, max(LEAST_BITS, int(np.ceil(np.log2(max(rows, 1) * per_row)))))


def pack_counts(counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Blocks of a task's counters as rows (block, counts); blocks of zeros are left out."""
    blocks = counts.reshape(-1, BLOCK)
    keep = np.flatnonzero(blocks.any(axis=1))
    for i in range(0, len(keep), 64):
        part = keep[i : i + 64]
        yield pa.RecordBatch.from_arrays(
            [pa.array(part, pa.int32()), pa.array([blocks[b].astype("<u4").tobytes() for b in part], pa.binary())],
            names=["block", "counts"],
        )


def frequency_code(total: np.ndarray) -> np.ndarray:
    """One byte per counter: c stands for about 2**((c - 1) / 6) occurrences, 0 for none.

    A sketch has 2**bits such bytes, at most 16 MB, whatever the size of the corpus, so it may be collected and broadcast.
    """
    return np.where(total > 0, np.round(6 * np.log2(np.maximum(total, 1))) + 1, 0).astype(np.uint8)


def occurrences(codes: np.ndarray) -> np.ndarray:
    return np.where(codes > 0, np.exp2((codes.astype(np.float32) - 1) / 6), 0).astype(np.float32)


def mean_load(codes: np.ndarray) -> float:
    """Occurrences per counter: the level below which the sketch can't tell rare from unique."""
    return float(occurrences(codes).mean(dtype=np.float64))


def slots(h: np.ndarray, bits: int) -> np.ndarray:
    return (h & _U((1 << bits) - 1)).astype(np.int64)


def bitmap(ids: DataFrame, bits: int = 23) -> np.ndarray:
    """A fixed-size (1 MB) bit set that holds at least the given ids; only filters ahead of an exact join."""
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << bits, dtype=bool)
        for batch in batches:
            seen[slots(mix(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)), bits)] = True
        packed = np.packbits(seen).reshape(-1, BLOCK)
        keep = np.flatnonzero(packed.any(axis=1))
        if len(keep):
            yield pa.RecordBatch.from_arrays([pa.array(keep, pa.int32()), pa.array([packed[b].tobytes() for b in keep], pa.binary())], names=["block", "bits"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                part = np.frombuffer(raw, dtype=np.uint8)
                both[b] = both[b] | part if b in both else part
        if both:
            yield pa.RecordBatch.from_arrays([pa.array(list(both), pa.int32()), pa.array([v.tobytes() for v in both.values()], pa.binary())], names=["block", "bits"])

    out = np.zeros((1 << bits) // 8, dtype=np.uint8)
    for row in ids.mapInArrow(mark, "block int, bits binary").repartition("block").mapInArrow(merge, "block int, bits binary").collect():
        out[row.block * BLOCK : (row.block + 1) * BLOCK] = np.frombuffer(row.bits, dtype=np.uint8)
    return out


def in_bitmap(ids: np.ndarray, packed: np.ndarray) -> np.ndarray:
    at = slots(mix(ids.astype(np.int64).view(np.uint64)), int(np.log2(len(packed) * 8)))
    return (packed[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1


def list_array(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(values))
