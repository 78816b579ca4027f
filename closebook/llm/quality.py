"""Quality rules, lines first.

Every line of a text is judged by rules of its own; lines that fail are
removed, and a document that loses more than ``max_lost`` of its words is
rejected.  Line rules: punctuation (too many symbol characters for its words,
or a line of several words that neither ends nor pauses like prose),
navigation (bars or arrows between items, or a bare run of short capitalised
items), boilerplate (licence, cookie and script notices), and repetition (a
line equal to an earlier one).  Document-level base figures are counted
exactly over the whole text.

Defined results.  Null or empty text: no words, base failed, not kept, cleaned
text empty.  Blank lines are dropped without being counted as lost.  Repeated
rows: each is judged.  Empty table: no rows.  Extra columns pass through
``clean`` unchanged.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from closebook.llm.arrow_words import coded, pieces, split, windows, word_hashes

WIDTH = 8
MAX_LOST = 0.5
#: Fixed value: the symbol characters of the contract.
SYMBOLS = re.compile(r"[#*$%&|<>]")
SYMBOL_SHARE = 0.3
NAVIGATION = re.compile(r"\s[|»›•>]\s")
BOILERPLATE = re.compile(r"all rights reserved|licen[sc]ed? under|terms of (?:use|service)|privacy policy|cookies?\b|"
                         r"javascript|copyright|©|subscribe|sign up|log ?in|click here", re.I)
STOPS = tuple(".!?…:;\"'”’»)]")


def line_failure(line: str, n_words: int, repeated: bool) -> str | None:
    """The first rule a line breaks, or None."""
    if repeated:
        return "repeated"
    if len(SYMBOLS.findall(line)) > SYMBOL_SHARE * n_words:
        return "punctuation"
    if len(NAVIGATION.findall(line)) >= 3:
        return "navigation"
    if n_words <= 30 and BOILERPLATE.search(line):
        return "boilerplate"
    if n_words >= 4 and not line.rstrip().endswith(STOPS) and "," not in line and "." not in line:
        return "navigation" if all(w[:1].isupper() for w in line.split()) else None
    return None


def judge(text: str) -> tuple[int, int, int, str]:
    """(duplicate lines, words in failed lines, symbols, cleaned text)."""
    seen: set[str] = set()
    kept, dup, lost = [], 0, 0
    for line in text.split("\n"):
        n = len(line.encode().split())
        if not n:
            continue
        repeated = line in seen
        seen.add(line)
        dup += repeated
        if line_failure(line, n, repeated):
            lost += n
        else:
            kept.append(line)
    return dup, lost, len(SYMBOLS.findall(text)), "\n".join(kept)


def repeat_words(flat: pa.Array, offsets: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """Words of each text that lie in a window of ``width`` words which the
    text holds twice or more."""
    codes, distinct = coded(flat)
    h, starts = windows(word_hashes(distinct)[codes], offsets, width)
    out = np.zeros(len(offsets) - 1, np.int64)
    if not len(h):
        return out
    doc = np.searchsorted(offsets, starts, side="right") - 1
    again = np.zeros(len(h), bool)
    edges = np.searchsorted(doc, np.arange(len(offsets)))
    for a, b in zip(edges[:-1], edges[1:]):
        if b - a > 1:
            part = h[a:b]
            order = np.argsort(part)
            same = part[order[1:]] == part[order[:-1]]
            if same.any():
                again[a + order[1:][same]] = True
                again[a + order[:-1][same]] = True
    cover = np.zeros(len(codes) + 1, np.int64)
    np.add.at(cover, starts[again], 1)
    np.add.at(cover, starts[again] + width, -1)
    inside = np.concatenate([[0], np.cumsum(np.cumsum(cover[:-1]) > 0)])
    return inside[offsets[1:]] - inside[offsets[:-1]]


def assess(docs: DataFrame, max_lost: float = MAX_LOST, texts: bool = False) -> DataFrame:
    """doc_id with the base figures and the verdict, and with ``texts`` the
    cleaned text of every document."""
    schema = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
              "base_failed boolean, kept boolean, n_lost_words long")
    names = [x.split()[0] for x in schema.split(", ")] + ["cleaned"] * texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            flat, offsets = split(b.column("text"), lower=False)
            n = np.diff(offsets)
            chars = np.concatenate([[0], np.cumsum(pa.compute.utf8_length(flat).to_numpy(zero_copy_only=False))]) if len(flat) else np.zeros(1, np.int64)
            rep = repeat_words(flat, offsets)
            rows = [judge(t or "") for t in b.column("text").to_pylist()]
            dup, lost, symbols = (np.array([r[k] for r in rows], np.int64) for k in range(3))
            failed = (n < 20) | (100 * rep > 30 * n)
            kept = ~failed & (lost <= max_lost * n)
            cols = [b.column("doc_id"), n, chars[offsets[1:]] - chars[offsets[:-1]], symbols, dup, rep, failed, kept, lost]
            cols += [[r[3] for r in rows]] * texts
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in cols], names)

    return docs.select("doc_id", "text").mapInArrow(run, schema + ", cleaned string" * texts)


def clean(docs: DataFrame, max_lost: float = MAX_LOST) -> DataFrame:
    """``docs`` with the failed lines removed, without the rejected documents."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            flat, offsets = split(b.column("text"), lower=False)
            n, rep = np.diff(offsets), repeat_words(flat, offsets)
            rows = [judge(t or "") for t in b.column("text").to_pylist()]
            lost = np.array([r[1] for r in rows], np.int64)
            kept = (n >= 20) & (100 * rep <= 30 * n) & (lost <= max_lost * n)
            cleaned = pa.array([r[3] for r in rows], pa.string())
            yield pa.RecordBatch.from_arrays([cleaned if c == "text" else b.column(c) for c in names], names).filter(pa.array(kept))

    return docs.mapInArrow(run, docs.schema)
