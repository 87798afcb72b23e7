"""Whole texts as flat numpy arrays: words, word hashes and shingles of a chunk of documents at once.

Everything here runs inside Arrow tasks on one chunk of rows; a chunk holds about a megabyte of text (or one longer text).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_powers: dict[str, np.ndarray] = {"up": np.ones(1, U), "down": np.ones(1, U)}

#: Bytes of a word: ASCII letters and digits, and every byte of a longer UTF-8 sequence.
WORD_BYTES = np.zeros(256, bool)
WORD_BYTES[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
#: Bytes that part the tokens of the language model: space and \\t to \\r.
SPACE_BYTES = np.zeros(256, bool)
SPACE_BYTES[[32, *range(9, 14)]] = True
_ASCII_LOWER = np.arange(256, dtype=np.uint8)
_ASCII_LOWER[65:91] += 32
_BYTE_CODES = (np.arange(1, 257, dtype=U) * U(0xBF58476D1CE4E5B9)) ^ U(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit values, so that close inputs give unrelated outputs."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse, modulo 2**64."""
    if len(_powers["up"]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, U(base))
            steps[0] = U(1)
            _powers[name] = np.cumprod(steps, dtype=U)
    return _powers["up"][:n], _powers["down"][:n]


def prefix_sums(buf: np.ndarray) -> np.ndarray:
    """Karp-Rabin prefix sums: the hash of any byte range is a difference times an inverse power."""
    up, _ = powers(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, U)
    np.cumsum(_BYTE_CODES[buf] * up[:-1], dtype=U, out=sums[1:])
    return sums


def range_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    _, down = powers(len(sums))
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U))


def packed(column: pa.Array, lower: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offset of each row; a null is an empty text."""
    column = column.fill_null("").cast(pa.large_string())
    if lower == "utf8":
        column = pc.utf8_lower(column)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    buf = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    return (_ASCII_LOWER[buf] if lower == "ascii" else buf), offs - (offs[0] if len(offs) else 0)


def chunks(batch: pa.RecordBatch, name: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about `limit` bytes of text each; a longer text is a slice of its own."""
    if not batch.num_rows:
        return
    ends = np.cumsum(pc.binary_length(batch.column(batch.schema.get_field_index(name)).fill_null("")).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    at = 0
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield batch.slice(at, to - at)
        at = to


def words(buf: np.ndarray, offs: np.ndarray, is_word: np.ndarray = WORD_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, their byte starts and ends, and for each document the index of its first word (with a last entry)."""
    inside = is_word[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[offs] = True
    before = np.zeros(len(buf), bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.zeros(len(buf), bool)
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    hashes = range_hashes(prefix_sums(buf), starts, ends)
    return hashes, starts, ends, np.searchsorted(starts, offs)


def shingles(hashes: np.ndarray, first: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of n successive words, the word each begins at, and each document's first shingle.

    A document of fewer words than n (but at least one) has one shingle: all its words.
    """
    size = len(hashes)
    length = np.diff(first)
    end = np.repeat(first[1:], length)
    at = np.arange(size)
    total = np.zeros(size, U)
    for j in range(n):
        part = np.zeros(size, U)
        part[: size - j or None] = hashes[j:] * U((2 * j + 1) * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF | 1)
        total += np.where(at + j < end, part, U(0))
        total = (total << U(7)) ^ (total >> U(57)) ^ total
    keep = (at + n <= end) | ((np.repeat(length, length) < n) & (at == np.repeat(first[:-1], length)))
    return mix(total[keep]), at[keep], np.concatenate([[0], np.cumsum(keep)])[first]


def text_batches(batches: Iterator[pa.RecordBatch], name: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from chunks(batch, name, limit)


def own_column(frame, stem: str) -> str:
    """A column name that the frame doesn't have."""
    taken = {c.lower() for c in frame.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem
