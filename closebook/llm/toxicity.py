"""Toxicity by a classifier chain.

The categories of the label table are predicted one after the other
(``low_quality``, then ``toxic``).  Each link is a linear model over selected
word and word-part features; a later link also gets the logits of the
earlier categories.  In training those are out-of-fold predictions, so a later
model learns from probabilities as unsure as it will meet.

Features are hashed words and the 3 to 7 byte beginnings and ends of words
(lower-cased A-Z, outer ASCII punctuation stripped), summed by strength, and
three dense figures (length, distinct share, share of words with symbols).  On a bounded sample of
labelled rows (``MAX_ROWS``) features are ranked by how surely they go with
the category, and the best ``FEATURES`` enter the model as log(1 + count).
Scoring covers every word of every text.

Defined results.  Null or empty text: no features, the chain's bare
intercepts decide.  No labels, or one class only: probability of that class
from the labels' mean, nothing rejected without a positive label.  Label rows
without a document or with null labels are ignored; a document labelled twice
counts twice.  Repeated rows: one result each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from closebook.llm.arrow_words import coded, mixed, pieces, split, word_hashes
from closebook.llm.common import stored

BITS = 21
MAX_ROWS = 6_000
FEATURES = 2_000
FOLDS = 5
PARTS = range(3, 8)
CATEGORIES = ("low_quality", "toxic")
THRESHOLD = 0.5
LEAST_Z = 4.0
OUTER = ".,;:!?\"'()[]"
SYMBOLS = "[#*$%&|<>]"


def word_features(distinct: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(word, feature) pairs of the distinct words: the word, and its
    beginnings and ends of 3 to 7 bytes where it is longer."""
    trimmed = pc.utf8_trim(pa.array(distinct, pa.binary()).cast(pa.string()), characters=OUTER).cast(pa.binary())
    n = pc.binary_length(trimmed).to_numpy(zero_copy_only=False).astype(np.int64)
    data = np.frombuffer(b"".join(trimmed.to_pylist()) + b"\0" * 8, np.uint8).astype(np.uint64)
    end = np.cumsum(n)
    words, feats = [np.arange(len(n))], [word_hashes(trimmed.to_pylist())]
    for k in PARTS:
        at = np.flatnonzero(n > k)
        for side, first in ((1, end[at] - n[at]), (2, end[at] - k)):
            code = np.full(len(at), side * 8 + k, np.uint64)
            for j in range(k):
                code = (code << np.uint64(8)) | data[first + j]
            words.append(at)
            feats.append(mixed(code * np.uint64(0x9E3779B97F4A7C15)))
    return np.concatenate(words), (np.concatenate(feats) >> np.uint64(64 - BITS)).astype(np.int64)


def document_features(texts: pa.Array, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature, count) triples, only features in the sorted ``wanted``
    if given; and the dense figures of each text."""
    flat, offsets = split(texts)
    codes, distinct = coded(flat)
    n = np.diff(offsets)
    doc = np.repeat(np.arange(len(n)), n)
    pair, times = np.unique(doc * np.int64(len(distinct) + 1) + codes, return_counts=True)
    doc, code = pair // (len(distinct) + 1), pair % (len(distinct) + 1)
    odd = pc.match_substring_regex(pa.array(distinct, pa.binary()).cast(pa.string()), SYMBOLS).to_numpy(zero_copy_only=False).astype(bool) if distinct else np.zeros(0, bool)
    many = np.maximum(n, 1)
    dense = np.stack([np.log1p(n), np.bincount(doc, minlength=len(n)) / many,
                      np.bincount(doc, weights=times * odd[code], minlength=len(n)) / many], 1)
    word, feature = word_features(distinct)
    if wanted is not None:
        at = np.minimum(np.searchsorted(wanted, feature), max(0, len(wanted) - 1))
        hit = wanted[at] == feature if len(wanted) else np.zeros(len(feature), bool)
        word, feature = word[hit], feature[hit]
    order = np.argsort(word, kind="stable")
    feature = feature[order]
    per = np.bincount(word, minlength=len(distinct))
    first = np.cumsum(per) - per
    some = per[code] > 0
    doc, code, times = doc[some], code[some], times[some]
    k = per[code]
    at = np.repeat(first[code] - (np.cumsum(k) - k), k) + np.arange(k.sum())
    pair, where = np.unique(np.repeat(doc, k) * np.int64(1 << BITS) + feature[at], return_inverse=True)
    return pair >> BITS, pair & ((1 << BITS) - 1), np.bincount(where, weights=np.repeat(times, k), minlength=len(pair)), dense


class Logistic:
    """Weighted L2 logistic regression by Newton steps on a dense matrix."""

    def __init__(self, l2: float = 1.0, steps: int = 25):
        self.l2, self.steps = l2, steps

    def fit(self, x: np.ndarray, y: np.ndarray) -> "Logistic":
        x1 = np.hstack([x, np.ones((len(x), 1))])
        w = np.zeros(x1.shape[1])
        prior = min(max(y.mean(), 1e-4), 1 - 1e-4) if len(y) else 0.5
        w[-1] = np.log(prior / (1 - prior))
        reg = np.full(len(w), self.l2)
        reg[-1] = 1e-6
        if 0 < y.sum() < len(y):
            for _ in range(self.steps):
                p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
                grad = x1.T @ (p - y) + reg * w
                hess = (x1 * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x1 + np.diag(reg)
                step = np.linalg.solve(hess, grad)
                w -= step
                if np.abs(step).max() < 1e-5:
                    break
        self.w = w
        return self

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(x @ self.w[:-1] + self.w[-1], -15, 15)


def summary(rows: np.ndarray, cols: np.ndarray, count: np.ndarray, n: int, groups: np.ndarray, width: int) -> np.ndarray:
    """Dense features of ``n`` texts: log(1 + count) summed over each of the
    ``width`` strength groups of features."""
    x = np.zeros((n, width))
    np.add.at(x, (rows, groups[cols]), np.log1p(count))
    return x


GROUPS = 24


class Chain:
    """Fitted links: per category the wanted features, their strength groups
    and a linear model over them, the dense figures and the earlier logits."""

    def __init__(self, links: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        self.links = links

    @staticmethod
    def select(feature: np.ndarray, pos: np.ndarray, n: np.ndarray, base: float, features: int) -> tuple[np.ndarray, np.ndarray]:
        """(sorted features, strength group of each): those that go with
        positive texts most surely.  feature: ascending; pos, n: positive and
        all texts of each."""
        base = min(max(base, 1e-4), 1 - 1e-4)
        share = (pos + 2 * base) / (n + 2)
        odds = np.log(share / (1 - share)) - np.log(base / (1 - base))
        z = (pos - n * base) / np.sqrt(n * base * (1 - base) + 1)
        strong = np.flatnonzero((z > LEAST_Z) & (odds > 1.5))
        top = np.sort(strong[np.argsort(-z[strong], kind="stable")[:features]])
        return feature[top], np.clip(((odds[top] - 1.5) * 3).astype(int), 0, GROUPS - 1)

    @classmethod
    def fit(cls, rows: np.ndarray, feats: np.ndarray, count: np.ndarray, dense: np.ndarray, labels: np.ndarray, folds: np.ndarray,
            chosen: dict[tuple[int, int | None], tuple[np.ndarray, np.ndarray]]) -> "Chain":
        """Links from (text, feature, count) triples of the chosen features;
        ``chosen``: by category and the fold left out (None: none is)."""
        links, before = [], np.zeros((len(labels), 0))
        for c in range(labels.shape[1]):
            y = labels[:, c].astype(float)
            out = np.zeros(len(y))
            for f in [*range(FOLDS), None]:  # None: the final model
                held = folds == f if f is not None else np.zeros(len(y), bool)
                if held.all() or f is not None and not held.any():
                    continue
                x = np.hstack([cls.inputs(rows, feats, count, len(y), *chosen[c, f]), dense, before])
                model = Logistic().fit(x[~held], y[~held])
                if f is not None:
                    out[held] = model.logit(x[held])
            before = np.hstack([before, out[:, None]])
            links.append((*chosen[c, None], model.w))
        return cls(links)

    @staticmethod
    def inputs(rows: np.ndarray, feats: np.ndarray, count: np.ndarray, n: int, wanted: np.ndarray, groups: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(wanted, feats), max(0, len(wanted) - 1))
        hit = wanted[at] == feats if len(wanted) else np.zeros(len(feats), bool)
        return summary(rows[hit], at[hit], count[hit], n, groups, GROUPS)

    def predict(self, texts: pa.Array) -> np.ndarray:
        """Probability of every category for every text."""
        every = np.unique(np.concatenate([x[0] for x in self.links]))
        rows, feats, count, dense = document_features(texts, every)
        before = np.zeros((len(texts), 0))
        for wanted, groups, w in self.links:
            x = np.hstack([self.inputs(rows, feats, count, len(texts), wanted, groups), dense, before])
            m = Logistic()
            m.w = w
            before = np.hstack([before, m.logit(x)[:, None]])
        return 1 / (1 + np.exp(-before))


def sampled(docs: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame | None:
    """doc_id, fold, low, toxic, text_hash and whole text of at most about
    ``max_rows`` labelled documents, taken by a hash of the id."""
    l = labels.where("quality IS NOT NULL AND toxic IS NOT NULL").select("doc_id", "quality", "toxic")
    n = l.count()
    if not n:
        return None
    l = l.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < min(1.0, max_rows / n) * (1 << 20))
    rows = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(l, "doc_id")
    return stored(rows.select("doc_id", F.pmod("doc_id", F.lit(FOLDS)).cast("int").alias("fold"), (F.col("quality") == 0).alias("low"),
                              (F.col("toxic") == 1).alias("toxic"), F.xxhash64("text").alias("text_hash"), "text"), "toxicity-sample")


def feature_counts(sample: DataFrame) -> DataFrame:
    """feature, n0 … (texts of each fold), p0_0 … (positive texts of each
    category and fold); one row a feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            fold, low, toxic = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("fold", "low", "toxic"))
            rows, feats, _, _ = document_features(b.column("text"))
            kind, n = np.unique(feats * (4 * FOLDS) + (fold * 4 + low * 2 + toxic)[rows], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(kind // (4 * FOLDS)), pa.array(kind // 4 % FOLDS), pa.array(kind // 2 % 2 == 1), pa.array(kind % 2 == 1), pa.array(n)],
                                             ["feature", "fold", "low", "toxic", "n"])

    each = sample.mapInArrow(run, "feature long, fold long, low boolean, toxic boolean, n long")
    total = lambda use, name: F.coalesce(F.sum(F.when(use, F.col("n"))), F.lit(0)).alias(name)
    return each.groupBy("feature").agg(
        *[total(F.col("fold") == f, f"n{f}") for f in range(FOLDS)],
        *[total((F.col("fold") == f) & F.col(name), f"p{c}_{f}") for c, name in enumerate(("low", "toxic")) for f in range(FOLDS)])


def sample_features(sample: DataFrame, every: np.ndarray) -> DataFrame:
    """A row a text of the sample: labels, fold, the wanted features with
    their counts, the dense figures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            rows, feats, count, dense = document_features(b.column("text"), every)
            ends = np.searchsorted(rows, np.arange(b.num_rows + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int64))) for x in (feats, count)]
            flat = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * dense.shape[1]), pa.array(dense.reshape(-1)))
            names = ["doc_id", "text_hash", "fold", "low", "toxic"]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), *lists, flat], [*names, "feats", "counts", "dense"])

    return sample.mapInArrow(run, "doc_id long, text_hash long, fold int, low boolean, toxic boolean, feats array<long>, counts array<long>, dense array<double>")


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, features: int = FEATURES) -> Chain | None:
    """A chain fitted on at most about ``max_rows`` labelled documents; whole
    texts.

    Tasks read the texts and count features; the driver gets the counts of the
    features that may be chosen (at most 2^``BITS`` rows) and, of every text,
    the chosen features (at most ``features`` a category and fold), no texts.
    """
    sample = sampled(docs, labels, max_rows)
    if sample is None:
        return None
    rows = [r.asDict() for r in sample.groupBy("fold", "low", "toxic").count().collect()]
    if not rows:
        return None
    base = {}
    for c, name in enumerate(("low", "toxic")):
        for f in [*range(FOLDS), None]:
            left = [r for r in rows if r["fold"] != f]
            base[c, f] = sum(r["count"] * r[name] for r in left) / max(1, sum(r["count"] for r in left))
    every_n, maybe = "+".join(f"n{g}" for g in range(FOLDS)), []
    for (c, f), p in base.items():
        less_n, less_p = (f"- n{f}", f"- p{c}_{f}") if f is not None else ("", "")
        n, pos = f"({every_n} {less_n})", f"({'+'.join(f'p{c}_{g}' for g in range(FOLDS))} {less_p})"
        p = min(max(p, 1e-4), 1 - 1e-4)
        maybe.append(f"{pos} - {n} * {p!r}D > {LEAST_Z - 0.1}D * sqrt({n} * {p * (1 - p)!r}D + 1)")
    table = feature_counts(sample).where(" OR ".join(maybe)).orderBy("feature").toArrow()
    column = lambda name: table.column(name).to_numpy().astype(np.int64)
    feature, ns = column("feature"), [column(f"n{f}") for f in range(FOLDS)]
    chosen = {}
    for (c, f), p in base.items():
        ps = [column(f"p{c}_{g}") for g in range(FOLDS)]
        chosen[c, f] = Chain.select(feature, sum(ps) - (ps[f] if f is not None else 0), sum(ns) - (ns[f] if f is not None else 0), p, features)
    every = np.unique(np.concatenate([x[0] for x in chosen.values()]))
    got = sample_features(sample, every).orderBy("doc_id", "text_hash").toArrow().combine_chunks()
    flat = lambda name: got.column(name).combine_chunks().flatten().to_numpy() if got.num_rows else np.zeros(0)
    sizes = pc.list_value_length(got.column("feats")).to_numpy()
    y = np.stack([got.column(c).to_numpy().astype(bool) for c in ("low", "toxic")], 1)
    return Chain.fit(np.repeat(np.arange(got.num_rows), sizes), flat("feats"), flat("counts").astype(float), flat("dense").reshape(got.num_rows, -1),
                     y, got.column("fold").to_numpy(), chosen)


def classify(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, p_low_quality, p_toxic and the verdict of every document."""
    chain = train(docs, labels, max_rows)
    model = docs.sparkSession.sparkContext.broadcast(chain.links if chain else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links = model.value
        for b in pieces(batches):
            p = Chain(links).predict(b.column("text")) if links else np.zeros((b.num_rows, 2))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(p[:, 0]), pa.array(p[:, 1]), pa.array(p[:, 1] > threshold)],
                                             ["doc_id", "p_low_quality", "p_toxic", "rejected"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, p_low_quality double, p_toxic double, rejected boolean")


def remove_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rejected documents; all columns pass through."""
    chain = train(docs, labels)
    if chain is None:
        return docs
    model = docs.sparkSession.sparkContext.broadcast(chain.links)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = Chain(model.value)
        for b in pieces(batches):
            yield b.filter(pa.array(c.predict(b.column("text"))[:, 1] <= threshold))

    return docs.mapInArrow(run, docs.schema)
