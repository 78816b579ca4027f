"""License scan, Merkle manifest and hard negatives against brute force on
small tables with nulls, ties, repeated rows, long texts and clashing columns."""

import hashlib
import math
import random
import re
import zlib

import pytest

from closebook.llm import licenses, merkle, negatives
from closebook.llm.license_rules import AFTER, BEFORE, RULES

R = random.Random(11)
DOCS = "doc_id long, text string, lang string, source string, n_chars long, w string, found string, base string, g string, pos long"
CLASH = ("x", "x", "x", "x", 7)


# ------------------------------------------------------------------ licenses

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
FILLER = ["mit", "liebe", "license", "été", "the", "version", "by", "cc", "apache", "gnu", "copyright", "2"]
LICENSED = [
    "Licensed under the Apache License, Version 2.0 (the License)", "Released under the MIT License.", "(C) CC-BY-NC 4.0",
    "under the GNU General Public License, version 3 or later", "SPDX-License-Identifier: GPL-2.0-only",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
    "files (the Software), to deal in the Software without restriction", "CC, by", "cc  BY apache LICENSE mit license", "GNU GPL v3", "the CC0",
    "Copyright (c) 2019 Jo Doe. All rights reserved.", "no license is granted", "placed in the public domain",
]
TEXTS = [None, "", " \n", "nothing to see", *LICENSED, *LICENSED[:2],
         " ".join(R.choice([*FILLER, *LICENSED]) for _ in range(4000)), *[" ".join(R.choice([*FILLER, *LICENSED]) for _ in range(60)) for _ in range(20)]]


def brute_scan(text, rules=RULES):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    by = {}
    for r in rules:
        by.setdefault(r.keyword, []).append(r)
    found = []
    for i, x in enumerate(w):
        head, tail = f" {' '.join(w[max(0, i - BEFORE):i])} ", f" {' '.join(w[i + 1:i + 1 + AFTER])} "
        for r in by.get(x, []):
            a, b = re.search(r.before, head), re.search(r.after, tail)
            if a and b:
                found.append((i - a[1].count(" "), i + 1 + b[1].count(" "), r))
    kept = [d for d in found if not any(e is not d and e[0] <= d[0] and e[1] >= d[1] and
            (e[2].priority, e[1] - e[0], -e[2].rule) > (d[2].priority, d[1] - d[0], -d[2].rule) for e in found)]
    base = [d for d in found if d[2].base]
    labels = lambda ds: ",".join(sorted({d[2].label for d in ds}))
    return (len(w), len(base), min((d[0] for d in base), default=None), max((d[0] for d in base), default=None),
            labels(base), labels([*base, *kept]), max((d[2].score for d in kept), default=0.0), len(kept))


def test_licenses_against_brute_force(spark):
    rows = [(i if i != 5 else None, t, "en", "s", 1, *CLASH) for i, t in enumerate(TEXTS)]
    rows.append(rows[8])  # a repeated row
    got = licenses.report(spark.createDataFrame(rows, DOCS)).collect()
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted([(r[0], *brute_scan(r[1])) for r in rows], key=key)
    assert licenses.report(spark.createDataFrame([], DOCS)).count() == 0


def test_base_places_by_plain_search(spark):
    got = {r.doc_id: r for r in licenses.report(spark.createDataFrame([(i, t, "", "", 1, *CLASH) for i, t in enumerate(TEXTS)], DOCS)).collect()}
    phrases = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
    for i, t in enumerate(TEXTS):
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        at = [(k, label) for p, label in phrases.items() for k in range(len(w)) if w[k:k + len(p.split())] == p.split()]
        assert got[i].n_base == len(at) and got[i].base_labels == ",".join(sorted({x[1] for x in at}))
        if at:
            assert (got[i].first_word, got[i].last_word) == (min(at)[0], max(at)[0])


def test_every_signature_is_found_in_its_own_words():
    assert len(RULES) > 200 and len({r.rule for r in RULES}) == len(RULES)
    for r in RULES:
        for side in (r.before, r.after):
            re.compile(side)
        assert r.keyword == r.keyword.lower() and WORD.fullmatch(r.keyword)


def test_suppression_by_level_and_containment(spark):
    text = "Released under the MIT License. Permission is hereby granted, free of charge, to any person obtaining a copy"
    row = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [(d.label, d.start, -d.neg_end) for d in row.kept] == [("mit", 0, 5), ("mit", 5, 18)]
    assert len(row.found) > len(row.kept)


# -------------------------------------------------------------------- merkle

def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(r, more=0):
    i, t, lang, source, n = r[:5]
    n = None if n is None else n + more
    return sha(*["-" if x is None else f"{len(str(x).encode())}:{x}" for x in (i, source, lang, n, t)])


def brute_tree(leaves, fanout):
    """Root, and for every leaf the runs on its way as (before, after)."""
    paths, level, at = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(level) > 1:
        runs = [level[i:i + fanout] for i in range(0, len(level), fanout)]
        for p, i in zip(paths, at, strict=True):
            run = runs[i // fanout]
            p.append((run[:i % fanout], run[i % fanout + 1:]))
        level, at = [sha(*r) for r in runs], [i // fanout for i in at]
    return level[0], paths


def brute_manifest(rows, fanout=2):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: brute_tree([leaf_of(r) for r in sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))], fanout) for g in order}
    root, upper = brute_tree([trees[g][0] for g in order], fanout)
    out = []
    for k, g in enumerate(order):
        ordered = sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        for r, path in zip(ordered, trees[g][1], strict=True):
            steps = [*path, *upper[k]]
            h = leaf_of(r, r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0)
            for a, b in steps:
                h = sha(*a, h, *b)
            out.append((r[0], leaf_of(r), trees[g][0], root, sha(*[x for a, b in steps for x in [*a, *b]]), h, h == root))
    return out


def doc_rows(n):
    rows = [(i, [None, "", "straße", "word " * 40000][min(i % 9, 3)] if i % 9 < 4 else f"text {i % 5}", ["en", "de", None, "zz", "é"][min(i % 11, 4)],
             [None, "s"][i % 2], None if i % 5 == 0 else i, *CLASH) for i in range(n)]
    rows += [(None, "t", "en", "s", 3, *CLASH), (None, None, "en", None, None, *CLASH), (3, "other", "en", "s", 4, *CLASH)]
    return rows + [rows[4], rows[4], (99, "lone", "a", "s", 1, *CLASH)]


KEY = lambda r: tuple((x is None, x or 0) for x in r)


def test_merkle_against_brute_force(spark):
    rows = doc_rows(150)
    got = merkle.report(spark.createDataFrame(rows, DOCS).repartition(5)).collect()
    assert sorted(map(tuple, got), key=KEY) == sorted(brute_manifest(rows), key=KEY)


@pytest.mark.parametrize("rows", [[], [(1, "a", None, "s", 1, *CLASH)], [(7, "a", "en", "s", 1, *CLASH)] * 3])
def test_merkle_of_few_rows(spark, rows):
    got = merkle.report(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted(map(tuple, got)) == sorted(brute_manifest(rows) if rows else [])


def test_merkle_over_several_rounds_and_wider_runs(spark):
    rows = doc_rows(130)
    for fanout, block_levels in ((2, 1), (3, 2)):
        m = merkle.manifest(spark.createDataFrame(rows, DOCS), fanout=fanout, block_levels=block_levels).collect()
        want = {(w[0], w[1]): w for w in brute_manifest(rows, fanout)}
        assert len(m) == len(rows)
        for r in m:
            w = want[r.doc_id, r.leaf]
            assert (r.subroot, r.root, r.folded_root) == (w[2], w[3], w[3])
            assert merkle.folded(r.leaf, r.proof) == r.root
            if rows.count(next(x for x in rows if x[0] == r.doc_id and leaf_of(x) == r.leaf)) == 1:
                assert merkle.proof_digest(r.proof) == w[4]


# ----------------------------------------------------------------- negatives

VECS = "vec_id long, embedding array<float>, label int, row string, dims int, place string, a long"


def brute_negatives(rows):
    kept = []
    for k, (i, v, label, *_) in enumerate(rows):
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        label = (label + 1) % 10 if i is not None and i % 7 == 0 else label
        kept.append((k, i, label, [math.floor(256 * x) for x in v]))
    out, last = [], lambda i: (i is None, i or 0)
    for k, i, label, v in kept:
        if i is None or i % 100:
            continue
        scored = [(sum(a * b for a, b in zip(v, u)), j, m) for n, j, m, u in kept if n != k and len(u) == len(v)]
        scored.sort(key=lambda s: (-s[0], last(s[1])))
        for ps, pid, _ in [s for s in scored if s[2] == label][:5]:
            near = [s for s in scored if s[2] != label and 30 * ps <= 100 * s[0] <= 90 * ps][:10]
            clip = lambda x: min(max(x, -2 ** 63), 2 ** 63 - 1)
            out += [(i, pid, r + 1, nid, clip(ps), clip(ns)) for r, (ns, nid, _) in enumerate(near)]
    return out


def as32(x):
    import numpy as np
    return float(np.float32(x))


def vector_rows(n, dims, scale=1.0, seed=1):
    r = random.Random(seed)
    base = [[r.gauss(0.05, 0.3) for _ in range(dims)] for _ in range(12)]
    return [(i, [as32(scale * (x + r.gauss(0, 0.1))) for x in base[r.randrange(12)]], r.randrange(10), "x", 1, "x", 1) for i in range(n)]


@pytest.mark.parametrize("scale", [1.0, 3e4, 1e9, 1e18])
def test_negatives_against_brute_force(spark, scale):
    rows = vector_rows(350, 8, scale)
    v = rows[100][1]
    rows += [(1000 + i, v, [3, 4][i % 2], "x", 1, "x", 1) for i in range(40)]  # ties
    rows += [rows[200], rows[200], (None, v, 5, "x", 1, "x", 1), (7, None, 1, "x", 1, "x", 1), (500, v, None, "x", 1, "x", 1),
             (600, [1.0, None] * 4, 1, "x", 1, "x", 1), (700, [float("nan")] * 8, 1, "x", 1, "x", 1), (800, [float("inf")] * 8, 2, "x", 1, "x", 1),
             (900, v[:5], 2, "x", 1, "x", 1), (901, v[:5], 2, "x", 1, "x", 1), (902, v[:5], 3, "x", 1, "x", 1), (1100, [], 1, "x", 1, "x", 1), (1101, [], 1, "x", 1, "x", 1),
             (1102, [], 2, "x", 1, "x", 1), (1200, [0.0] * 8, 4, "x", 1, "x", 1)]
    got = negatives.report(spark.createDataFrame(rows, VECS).repartition(3)).collect()
    assert sorted(map(tuple, got), key=KEY) == sorted(brute_negatives(rows), key=KEY)


def test_negatives_over_many_chunks(spark):
    from pyspark.sql import functions as F

    rows = vector_rows(400, 6, seed=3)
    q = negatives.quantised(spark.createDataFrame(rows, VECS))
    q = q.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    got = negatives.mine(q, F.col("vec_id") % 100 == 0, chunks=(60, 2)).collect()
    assert sorted(map(tuple, got)) == sorted(brute_negatives(rows))
    assert negatives.report(spark.createDataFrame([], VECS)).count() == 0


def test_packed_products_are_exact():
    import numpy as np

    r = random.Random(5)
    for bits in (6, 12, 20, 28, 40, 90):
        top = 1 << bits
        rows = [[r.randint(-top, top) for _ in range(7)] for _ in range(50)]
        matrix = np.array(rows, dtype=np.int64 if bits < 29 else object)
        anchors = [[r.randint(-top, top) for _ in range(7)] for _ in range(5)]
        pack = negatives.Pack(matrix, max(abs(x) for a in anchors for x in a))
        for a in anchors:
            assert [int(x) for x in pack.products(a)] == [sum(x * y for x, y in zip(a, c)) for c in rows]
