"""Words of Arrow text columns, without a Python loop over words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

PIECE_BYTES = 4 << 20
PIECE_ROWS = 4096


def pieces(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds at most ``most`` bytes of text (one
    longer text stands alone) and ``PIECE_ROWS`` rows: bounds what a task
    holds besides the batch."""
    for b in batches:
        size = pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(size)
        at = 0
        while at < b.num_rows:
            done = ends[at - 1] if at else 0
            to = min(at + PIECE_ROWS, max(at + 1, int(np.searchsorted(ends, done + most, side="right"))), b.num_rows)
            yield b.slice(at, to - at)
            at = to


def split(texts: pa.Array, lower: bool = True) -> tuple[pa.Array, np.ndarray]:
    """(words, offsets): the runs of other than ASCII white space of all texts
    and where each text's words begin (one more entry for the end); A-Z are
    lower-cased.  Null has no words."""
    texts = pc.fill_null(texts, "")
    if lower:
        texts = pc.ascii_lower(texts)
    lists = pc.ascii_split_whitespace(texts)
    flat, ends = lists.flatten(), np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))])
    real = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    if not real.all():  # blanks at the ends of a text leave empty strings
        ends = np.concatenate([[0], np.cumsum(real)])[ends]
        flat = flat.filter(pa.array(real))
    return flat, ends.astype(np.int64)


def listed(words: pa.Array) -> list[bytes]:
    """A binary array without nulls as a list, cut from one bytes object (``to_pylist`` makes a scalar of each)."""
    if not len(words):
        return []
    ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset:words.offset + len(words) + 1].tolist()
    data = bytes(words.buffers()[2] or b"")
    return [data[a:b] for a, b in zip(ends, ends[1:])]


def coded(flat: pa.Array) -> tuple[np.ndarray, list[bytes]]:
    """(codes, distinct words as bytes)."""
    d = flat.cast(pa.binary()).dictionary_encode() if len(flat) else pa.array([], pa.binary()).dictionary_encode()
    return d.indices.to_numpy(zero_copy_only=False).astype(np.int64), listed(d.dictionary)


def word_hashes(distinct: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w) for w in distinct), np.uint64, len(distinct))


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the constants are those of splitmix64)."""
    h = h.copy()
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def windows(h: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, starts): the hash of every run of ``width`` words that lies in
    one text, and the index of its first word."""
    if len(h) < width:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    n = len(h) - width + 1
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out += mixed(h[k:k + n] + np.uint64(0x9E3779B97F4A7C15 * (k + 1) % (1 << 64)))
    ends = np.repeat(offsets[1:], np.diff(offsets))  # of each word's text
    starts = np.flatnonzero(np.arange(n) + width <= ends[:n])
    return mixed(out[starts]), starts
