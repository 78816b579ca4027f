"""Language identification by prediction by partial matching.

For each language a tree of byte contexts up to ``order`` bytes is counted.
In a context that was seen n times with d different next bytes, a seen byte
with count c costs -log2(c / (n + d)); any other byte first pays the escape
-log2(d / (n + d)) and is then coded in the context one byte shorter, without
the bytes that the longer context knows (exclusion).  Below order 0 all bytes
left are equally likely, so every byte string has a finite code length and the
lengths are those of a proper distribution.  The statistics are frozen after
training: a text's code length is a plain sum over its positions, and the
language with the shortest code wins.

The classifier is fitted on a bounded sample of labelled rows
(``train_bytes`` per language, whole texts chosen by a hash); prediction
covers every byte of every text.

Defined results.  Null text or no letter: ``und``, score 0.  Empty table: no
rows.  No labelled row at all: ``und``.  Ties in code length: the first
language in code point order.  Repeated rows: one result each.  Extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from closebook.llm.arrow_words import pieces

ORDER = 3
TRAIN_BYTES = 3_000_000
SPAN = 1 << 20
UND = "und"


def folded(raw: bytes) -> bytes:
    """The bytes the model codes: lower-cased A-Z, a blank first."""
    return b" " + raw.lower()


def count_grams(batches: Iterator[pa.RecordBatch], order: int = ORDER) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n) of each batch: grams of order + 1 bytes as one integer."""
    for b in pieces(batches):
        by: dict[str, list[bytes]] = {}
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
            by.setdefault(lang, []).append(b" " * order + folded(text.encode()))
        for lang, texts in by.items():
            code = np.frombuffer(b"".join(texts), np.uint8).astype(np.int64)
            gram = np.zeros(max(0, len(code) - order), np.int64)
            for k in range(order + 1):
                gram = gram * 256 + code[k:k + len(gram)]
            grams, n = np.unique(gram, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams)), pa.array(grams), pa.array(n)], ["lang", "gram", "n"])


class ContextTrees:
    """Frozen code lengths of all languages: ``bits[ctx, byte, language]``.

    Contexts are walked from the empty one: ``child[ctx, byte]`` is the
    context that ends in ``byte``, so at each position one lookup gives the
    code lengths and one the next context.
    """

    def __init__(self, rows: list[tuple[str, int, int]], order: int = ORDER):
        self.order = order
        self.langs = sorted({r[0] for r in rows})
        lang = {x: i for i, x in enumerate(self.langs)}
        grams = np.array([r[1] for r in rows], np.int64)
        which = np.array([lang[r[0]] for r in rows], np.int64)
        n = np.array([r[2] for r in rows], np.float64)
        used = np.unique(np.concatenate([(grams >> (8 * k)) & 255 for k in range(order + 1)]))
        self.symbol = np.full(256, len(used), np.int64)  # bytes never seen share one class
        self.symbol[used] = np.arange(len(used))
        a, unseen = len(used) + 1, 256 - len(used)
        parts = [self.symbol[(grams >> (8 * k)) & 255] for k in range(order, -1, -1)]  # oldest first
        size = np.ones(a)
        size[-1] = max(unseen, 1)
        if not unseen:
            size[-1] = 0
        uniform = size / 256
        n_langs = len(self.langs)
        dist = np.repeat(uniform[None, :, None], n_langs, 2)  # of the context below order 0
        keys = np.zeros(1, np.int64)  # codes of the contexts of the level, sorted
        self.keys, self.bits = [], []
        for k in range(order + 1):
            ctx = np.zeros(len(grams), np.int64)
            for p in parts[order - k:order]:
                ctx = ctx * a + p
            level, at = np.unique(ctx, return_inverse=True)
            c = np.zeros((len(level), a, n_langs))
            np.add.at(c, (at, parts[order], which), n)
            # the parent of a context drops its oldest byte
            parent = np.searchsorted(keys, level % max(1, a ** (k - 1))) if k else np.zeros(1, np.int64)
            below = dist[parent]
            seen = c > 0
            total, kinds = c.sum(1, keepdims=True), seen.sum(1, keepdims=True)
            free = np.where(seen, 0, below).sum(1, keepdims=True)
            room = free > 1e-12
            escape = np.where(room, kinds / np.maximum(total + kinds, 1), 0)
            lower = np.where(seen, 0, below) / np.where(room, free, 1)
            known = c / np.maximum(np.where(room, total + kinds, total), 1)
            dist = np.where(total > 0, np.where(seen, known, escape * lower), below)
            keys = level
            self.keys.append(level)
            # a byte of the unseen class has its share of the class
            self.bits.append((-np.log2(np.maximum(dist / np.where(size > 0, size, 1)[None, :, None], 1e-300))).astype(np.float32))
        self.a = a
        # context ids over all levels; the walk takes the longest known context
        self.base = np.concatenate([[0], np.cumsum([len(x) for x in self.keys])])
        self.table = np.concatenate(self.bits).reshape(-1, n_langs)
        del self.bits
        dense = np.zeros(a ** order, np.int32)  # longest known context of each `order` symbols
        every = np.arange(a ** order, dtype=np.int64)
        for k in range(order + 1):
            tail = every % (a ** k)
            at = np.minimum(np.searchsorted(self.keys[k], tail), len(self.keys[k]) - 1)
            dense = np.where(self.keys[k][at] == tail, self.base[k] + at, dense).astype(np.int32)
        self.context = dense

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        """Code length in bits of each text under each language."""
        out = np.zeros((len(texts), len(self.langs)))
        lead = b" " * self.order
        at = 0
        while at < len(texts):  # some texts at a time, or a part of a long one
            to, size = at, 0
            while to < len(texts) and (to == at or size + len(texts[to]) <= SPAN):
                size += len(texts[to]) + self.order
                to += 1
            if to == at + 1 and size > 2 * SPAN:
                raw = lead + texts[at]
                for s in range(0, len(texts[at]), SPAN):
                    out[at] += self._sum(raw[s:s + SPAN + self.order], np.array([0]))[0]
            else:
                joined = b"".join(lead + t for t in texts[at:to])
                starts = np.concatenate([[0], np.cumsum([len(t) + self.order for t in texts[at:to]])[:-1]])
                out[at:to] = self._sum(joined, starts)
            at = to
        return out

    def _sum(self, joined: bytes, starts: np.ndarray) -> np.ndarray:
        s = self.symbol[np.frombuffer(joined, np.uint8)]
        m = len(s) - self.order
        ctx = np.zeros(m, np.int64)
        for k in range(self.order):
            ctx *= self.a
            ctx += s[k:k + m]
        cost = self.table[self.context[ctx] * np.int64(self.a) + s[self.order:]]
        for x in starts[1:]:  # the lead of the next text is not coded
            cost[x - self.order:x] = 0
        return np.add.reduceat(cost, np.minimum(starts, m - 1), axis=0, dtype=np.float64)


def train(labelled: DataFrame, order: int = ORDER, train_bytes: int = TRAIN_BYTES) -> ContextTrees | None:
    """Trees from (text, lang) rows; at most about ``train_bytes`` bytes of
    each language are counted, chosen by a hash of the text."""
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang")
    sizes = {r[0]: r[1] for r in rows.groupBy("lang").agg(F.sum(F.octet_length("text"))).collect()}
    if not sizes:
        return None
    share = F.lit(0.0)
    for lang, total in sizes.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, train_bytes / max(1, total)))).otherwise(share)
    sample = rows.where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < share * (1 << 20))
    grams = sample.mapInArrow(lambda it: count_grams(it, order), "lang string, gram long, n long")
    counts = grams.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    cols = [counts.column(c).to_pylist() for c in ("lang", "gram", "n")]
    if not cols[0]:
        return None
    return ContextTrees(list(zip(*cols)), order)


def predict(docs: DataFrame, trees: ContextTrees | None, keep: list[str]) -> DataFrame:
    """``keep`` columns, lang_pred and score of every row of ``docs``."""
    rows = docs.select(*keep, "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("_letters"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema)
    model = docs.sparkSession.sparkContext.broadcast(vars(trees) if trees else None)  # arrays only

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = None
        if model.value is not None:
            t = ContextTrees.__new__(ContextTrees)
            t.__dict__.update(model.value)
        for b in pieces(batches):
            letters = b.column("_letters").to_numpy(zero_copy_only=False).astype(bool)
            pred, value = np.full(b.num_rows, UND, object), np.zeros(b.num_rows)
            if t is not None and letters.any():
                at = np.flatnonzero(letters)
                raw = b.column("text").cast(pa.binary()).take(pa.array(at)).to_pylist()
                bits = t.lengths([folded(x) for x in raw])
                best = bits.argmin(1)
                least = bits.min(1, keepdims=True)
                pred[at] = np.array(t.langs, object)[best]
                value[at] = 1 / np.exp2(-np.minimum(bits - least, 1000)).sum(1)
            yield pa.RecordBatch.from_arrays([b.column(c) for c in keep] + [pa.array(pred.tolist(), pa.string()), pa.array(value)],
                                             [*keep, "lang_pred", "score"])

    return rows.mapInArrow(score, schema + ", lang_pred string, score double")


def in_fold(id_col: str, n: int) -> Column:
    """Whether crc32 of the id as text leaves no remainder by ``n``."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % n == 0, F.lit(False))


def identify(docs: DataFrame, order: int = ORDER, train_bytes: int = TRAIN_BYTES) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learns from the rows not held out."""
    d = docs.select("doc_id", "text", "lang", in_fold("doc_id", 5).alias("held_out"))
    trees = train(d.where(~F.col("held_out")), order, train_bytes)
    return predict(d, trees, ["doc_id", "held_out"])
