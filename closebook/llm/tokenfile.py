"""Token ids in files of directly addressable codes.

An id is cut into chunks of 8, 4 and 4 bits, lowest first.  Level 0 holds the
first chunk of every id; a continuation bitmap says which ids go on, and level
1 holds the next chunk of only those, and so on.  The chunk of id i at the
next level stands at rank(i), the number of continuation bits before i, which
a rank directory (one count per 512 bits) gives with one popcount: any id is
read without decoding others.

A file is a Parquet part whose rows are segments of at most
``SEGMENT`` ids of whole documents (one longer document stands alone): part,
segment number, first id position in the part, the documents' ids and lengths,
and the coded ids.  Segments follow each other in ascending doc_id order.

Defined results.  Null or empty text: only the end id.  Repeated rows: one
entry each, equal ids ordered by text.  Null doc_id: first.  Empty table: no
segments.  Strings of special tokens in a text are ordinary text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from closebook.llm.arrow_words import listed, pieces
from closebook.llm.common import bucket_count, stored

WIDTHS = (8, 4, 4)
RANK_BITS = 512
SEGMENT = 1 << 19
END_ID = 2
CACHE = 600_000
AT_ONCE = 1000
MAX_BROADCAST_PARTS = 1_000_000
MAGIC = b"DAC1"


def packed(values: np.ndarray, width: int) -> bytes:
    """Chunks of 8 or 4 bits as bytes."""
    v = values.astype(np.uint8)
    if width == 8:
        return v.tobytes()
    if len(v) % 2:
        v = np.append(v, np.uint8(0))
    return (v[0::2] | (v[1::2] << 4)).tobytes()


def encode_ids(ids: np.ndarray, widths: tuple[int, ...] = WIDTHS) -> bytes:
    """Header (level sizes), then per level the chunks, the bitmap and its
    rank directory (none of both at the last level)."""
    rest = ids.astype(np.uint32)
    parts, sizes = [], []
    for k, width in enumerate(widths):
        sizes.append(len(rest))
        parts.append(packed(rest & np.uint32((1 << width) - 1), width))
        rest = rest >> np.uint32(width)
        if k < len(widths) - 1:
            on = rest > 0
            bits = np.packbits(on, bitorder="little")
            per = np.add.reduceat(on, np.arange(0, len(on), RANK_BITS), dtype=np.uint32) if len(on) else np.zeros(0, np.uint32)
            parts += [bits.tobytes(), (np.cumsum(per, dtype=np.uint32) - per).tobytes()]
            rest = rest[on]
        elif rest.any():
            raise ValueError("an id needs more bits than the levels have")
    return MAGIC + np.array(sizes, "<u4").tobytes() + b"".join(parts)


class TokenCodes:
    """Reads one coded segment; ``get`` touches one chunk a level."""

    def __init__(self, blob: bytes, widths: tuple[int, ...] = WIDTHS):
        if blob[:4] != MAGIC:
            raise ValueError("no such file format")
        self.widths = widths
        sizes = np.frombuffer(blob, "<u4", len(widths), 4).astype(int)
        at = 4 + 4 * len(widths)
        self.levels = []
        for k, (width, n) in enumerate(zip(widths, sizes)):
            size = n if width == 8 else (n + 1) // 2
            chunk, at = np.frombuffer(blob, np.uint8, size, at), at + size
            bits = rank = None
            if k < len(widths) - 1:
                bits, at = np.frombuffer(blob, np.uint8, (n + 7) // 8, at), at + (n + 7) // 8
                blocks = -(-n // RANK_BITS)
                rank, at = np.frombuffer(blob, "<u4", blocks, at), at + 4 * blocks
            self.levels.append((width, chunk, bits, rank))
        self.n = int(sizes[0])

    def get(self, i: int) -> int:
        value = shift = 0
        for width, chunk, bits, rank in self.levels:
            c = int(chunk[i]) if width == 8 else (int(chunk[i // 2]) >> (4 * (i % 2))) & 15
            value |= c << shift
            shift += width
            if bits is None or not bits[i // 8] >> (i % 8) & 1:
                break
            block = i // RANK_BITS
            run = bits[block * RANK_BITS // 8:i // 8]
            i = int(rank[block]) + int(np.bitwise_count(run).sum()) + int(bits[i // 8] & ((1 << (i % 8)) - 1)).bit_count()
        return value

    def read(self, lo: int, hi: int) -> np.ndarray:
        """ids lo … hi-1: at each level one contiguous range."""
        out = np.zeros(hi - lo, np.uint32)
        where, shift = np.arange(hi - lo), 0
        for width, chunk, bits, rank in self.levels:
            if width == 8:
                c = chunk[lo:hi]
            else:
                both = chunk[lo // 2:(hi + 1) // 2]
                c = np.stack([both & 15, both >> 4], 1).reshape(-1)[lo % 2:lo % 2 + hi - lo]
            out[where] |= c.astype(np.uint32) << np.uint32(shift)
            shift += width
            if bits is None or hi == lo:
                break
            on = np.unpackbits(bits[lo // 8:(hi + 7) // 8], bitorder="little")[lo % 8:lo % 8 + hi - lo].astype(bool)
            where = where[on]
            block = lo // RANK_BITS
            start = int(rank[block]) + int(np.unpackbits(bits[block * RANK_BITS // 8:(lo + 7) // 8], bitorder="little")[:lo - block * RANK_BITS].sum())
            lo, hi = start, start + len(where)
        return out


def kinds_of_bytes() -> np.ndarray:
    """1: white space, 2: a control character that some count as such, 4: an
    ASCII letter, 8: a comma or full stop, 16: may be the last byte of a longer
    white space character, 32: may be its first; 0: none of these."""
    kinds = np.zeros(256, np.uint8)
    kinds[[9, 10, 11, 12, 13, 32]] = 1
    kinds[28:32] = 2
    kinds[[*range(65, 91), *range(97, 123)]] = 4
    kinds[[44, 46]] = 8
    kinds[[*range(0x80, 0x8B), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF]] = 16
    kinds[[0xC2, 0xE1, 0xE2, 0xE3]] = 32
    return kinds


KINDS = kinds_of_bytes()


def parts_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(parts as bytes, number of parts of each text): cut where the
    pre-tokeniser always cuts: before white space that follows another
    character, behind a newline between two such, and before a comma or full
    stop that ends a word.  Null is cut like the empty text."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
    size = int(offsets[-1] - offsets[0])
    if not size:
        return pa.array([], pa.binary()), np.zeros(len(texts), np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0]:offsets[-1]]
    offsets = offsets.astype(np.int64) - offsets[0]
    starts = offsets[:-1][np.diff(offsets) > 0]
    kind = KINDS[data]
    space = kind == 1
    before = lambda x, k=1: np.concatenate([np.zeros(k, x.dtype), x[:-k]])[:size]
    last, lead = data >= 0xC0, kind == 32
    doubtful = (kind == 16) & (before(lead) | (before(lead, 2) & ~before(last)))
    solid = ~(space | (kind == 2) | doubtful)  # ends a character that is no white space
    solid_before = before(solid)
    solid_before[starts] = False
    cut = space & solid_before
    cut[starts] = True
    cut[1:] |= (data[:-1] == 10) & cut[:-1] & ~(space | (kind == 2) | lead)[1:]
    letter = kind == 4
    letter[1:] |= (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)
    ends = np.concatenate([space[1:], [True]])
    ends[starts[1:] - 1] = True
    cut |= (kind == 8) & before(letter) & solid_before & ends
    at = np.flatnonzero(cut)
    parts = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(np.append(at, size).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])
    return parts, np.diff(np.searchsorted(at, offsets))


class Pieces:
    """ids of texts through the tokenizers library, each distinct piece
    between blanks encoded once while the cache lasts.

    The byte-level pre-tokeniser cuts a text at the places of ``parts_of``
    too, and what it cuts is encoded independently, so the ids are those of
    the whole text.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        self.bytes_of = np.zeros(self.tok.get_vocab_size(), np.int64)  # a letter of a byte-level token is a byte
        for token, i in self.tok.get_vocab().items():
            self.bytes_of[i] = len(token)
        self.forget()

    def forget(self) -> None:
        self.cache: dict[bytes, int] = {}
        self.pool = np.zeros(0, np.uint32)  # the ids of all parts seen, end to end
        self.size = np.zeros(0, np.int64)

    def _each(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the parts, number of ids of each), a part by itself."""
        ids = [e.ids for e in self.tok.encode_batch_fast([p.decode() for p in parts], add_special_tokens=False)]
        n = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter((i for x in ids for i in x), np.uint32, int(n.sum())), n

    def _joined(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The same of parts that are a blank and a word: encoded end to end,
        as the library's cost of a call is that of many words, and taken apart
        by the bytes that every id stands for."""
        text = b"".join(parts).decode()
        if len(text.split()) == len(parts):  # no other white space
            ids = np.array(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.cumsum(self.bytes_of[ids])
            stops = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))
            upto = np.searchsorted(ends, stops, side="right")
            if len(ids) and ends[-1] == stops[-1] and (upto > 0).all() and (ends[upto - 1] == stops).all():  # else it changes texts
                return ids, np.diff(upto, prepend=0)
        return self._each(parts)

    def ids_of(self, parts: list[bytes], joined: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """The same, ``AT_ONCE`` parts at a time: what the library returns is
        some hundred bytes a token.  ``joined``: all are a blank and a word."""
        got = [(self._joined if joined else self._each)(parts[k:k + AT_ONCE]) for k in range(0, len(parts), AT_ONCE)]
        return np.concatenate([np.zeros(0, np.uint32), *(ids for ids, _ in got)]), np.concatenate([np.zeros(0, np.int64), *(n for _, n in got)])

    def _codes(self, parts: list[bytes]) -> np.ndarray:
        """Places of distinct parts in the cache."""
        get = self.cache.get
        words, rest = [], []
        for p in parts:
            if p not in self.cache:
                (words if p[0] == 32 and p.split() == [p[1:]] else rest).append(p)
        for some, joined in ((words, True), (rest, False)):
            if some:
                ids, n = self.ids_of(some, joined)
                self.cache.update(zip(some, range(len(self.size), len(self.size) + len(some))))
                self.pool = np.concatenate([self.pool, ids])
                self.size = np.concatenate([self.size, n])
        return np.fromiter(map(get, parts), np.int64, len(parts))

    def encode(self, texts: pa.Array | list[str], end: int = END_ID) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each with the end id; number of ids of each)."""
        if len(self.cache) > CACHE:
            self.forget()
        parts, n_parts = parts_of(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))
        distinct = parts.dictionary_encode()
        codes = self._codes(listed(distinct.dictionary))[distinct.indices.to_numpy(zero_copy_only=False)]
        size, pool = self.size, self.pool
        begin = np.cumsum(size) - size
        n = size[codes]
        at = np.cumsum(n) - n
        flat = pool[np.arange(n.sum()) - np.repeat(at - begin[codes], n)]
        bounds = np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], np.cumsum(n_parts)])]
        counts = np.diff(bounds)
        out = np.insert(flat, bounds[1:], np.uint32(end))
        return out, counts + 1


def worker_pieces(path: str) -> Pieces:
    """The encoder of this worker process: its cache outlasts a task.  It hangs
    on the interpreter, as functions sent by value get new globals in each task."""
    import sys

    held = sys.__dict__.setdefault("_token_pieces", {})
    if path not in held:
        held[path] = Pieces(path)
    return held[path]


SEGMENTS = "part int, segment int, first long, n_ids long, doc_ids binary, null_ids binary, n_tokens binary, codes binary"


def write(docs: DataFrame, tokenizer: str, kind: str = "token-files") -> DataFrame:
    """Encode all documents into segments in ascending doc_id order, written
    to the shared folder; returns the table of segments."""
    rows = docs.count()
    d = docs.select("doc_id", "text")
    parts = bucket_count(rows, 8_000)
    d = d.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        names = [x.split()[0] for x in SEGMENTS.split(", ")]
        part, number, first = TaskContext.get().partitionId(), 0, 0
        pieces_ = worker_pieces(tokenizer)
        for b in pieces(batches, most=4 << 20):
            ids, n = pieces_.encode(b.column("text"))
            keys = b.column("doc_id")
            doc = keys.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8")
            missing = keys.is_null().to_numpy(zero_copy_only=False)
            ends = np.cumsum(n)
            lo = 0
            while lo < len(n):
                start = int(ends[lo - 1]) if lo else 0
                hi = max(lo + 1, int(np.searchsorted(ends, start + SEGMENT, side="right")))
                stop = int(ends[hi - 1])
                row = [part, number, first, stop - start, doc[lo:hi].tobytes(), np.packbits(missing[lo:hi]).tobytes(),
                       n[lo:hi].astype("<u4").tobytes(), encode_ids(ids[start:stop])]
                kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64()] + [pa.binary()] * 4
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names)
                number, first, lo = number + 1, first + stop - start, hi

    return stored(d.mapInArrow(run, SEGMENTS), kind)


def part_starts(segments: DataFrame) -> DataFrame:
    """(part, start): ids in all parts before; one row per part."""
    totals = segments.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))


def read_back(segments: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""
    starts = stored(part_starts(segments), "part-starts")  # two numbers a part
    if starts.count() <= MAX_BROADCAST_PARTS:  # else the segments shuffle
        starts = F.broadcast(starts)
    rows = segments.join(starts, "part").select((F.col("start") + F.col("first")).alias("at"), "doc_ids", "null_ids", "n_tokens", "codes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                at, docs_, nulls, n, codes = (b.column(k)[r].as_py() for k in range(5))
                doc, n = np.frombuffer(docs_, "<i8"), np.frombuffer(n, "<u4").astype(np.int64)
                missing = np.unpackbits(np.frombuffer(nulls, np.uint8))[:len(doc)].astype(bool)
                reader = TokenCodes(codes)
                ids = reader.read(0, reader.n)
                ends = np.cumsum(n)
                crc = [zlib.crc32(ids[e - k:e].astype("<u4").tobytes()) for e, k in zip(ends, n)]
                yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64(), mask=missing), pa.array(at + ends - n), pa.array(n), pa.array(crc, pa.int64())],
                                                 ["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
