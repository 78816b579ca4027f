"""The operators against brute force on small tables with nulls, empty and
repeated texts, and extra columns."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from closebook.llm import chat, decontam, langid, lm, mixing, parity_join, quality, sharding, tokenfile, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, extra string"
R = random.Random(4)
WORDS = ["stone", "river", "Bird", "green", "tall", "run,", "sky.", "été", "größe", "42", "a", "b"]


def sentence(n):
    return " ".join(R.choice(WORDS) for _ in range(n))


BASE = [sentence(R.randint(5, 80)) for _ in range(40)]
NEAR = [t.replace("stone", "rock", 1) for t in BASE[:10]]
TEXTS = [None, "", "  \n ", "one", "two words", "two words", *BASE, *NEAR, *BASE[:5], sentence(3000)]
ROWS = [(i, t, ["en", "de", None][i % 3], ["s1", "s2", None, "s3"][i % 4], len(t or ""), "x") for i, t in enumerate(TEXTS)]
ROWS.append(ROWS[10])  # a repeated row


def words(t):
    return (t or "").encode().lower().split()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_sharding(docs, none):
    rows = sharding.shard_documents(docs, 4).collect()
    assert len(rows) == len(ROWS)
    text = {r[0]: (r[1] or "").encode() for r in ROWS}
    by = collections.defaultdict(list)
    for r in rows:
        assert r.size == len(text[r.doc_id]) + 1 and r.text_crc32 == zlib.crc32(text[r.doc_id])
        by[r.shard].append(r)
    assert all(sorted(r.slot for r in x) == list(range(len(x))) for x in by.values())
    assert sharding.shard_documents(none, 4).count() == 0


def test_rebalance_moves_only_into_new_shards():
    weights = {v: 10 + v % 7 for v in range(sharding.N_SLOTS)}
    first = sharding.first_map(weights, 8)
    grown = sharding.rebalanced(first, weights, 9)
    was, now = {r[1]: r[2] for r in first}, {r[1]: r[2] for r in grown}
    assert all(now[v] in (was[v], 8) for v in was) and grown[0][0] == 1
    load = collections.Counter()
    for v, s in now.items():
        load[s] += weights[v]
    assert max(load.values()) < 1.05 * min(load.values())


def brute_components(rows):
    sets = {}
    for i, t, *_ in rows:
        w = words(t)
        sets[i] = frozenset(tuple(w[k:k + 4]) for k in range(len(w) - 3)) if len(w) >= 4 else frozenset([tuple(w)] if w else [])
    root = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for i in sets:
            for j in sets:
                x, y = sets[i], sets[j]
                if i != j and x and 100 * len(x & y) >= 85 * len(x | y) and root[i] != root[j]:
                    root[i] = root[j] = min(root[i], root[j])
                    changed = True
    return sets, root


def test_near_duplicates(docs, none):
    sets, root = brute_components(ROWS)
    got = parity_join.near_duplicates(docs).collect()
    assert len(got) == len(ROWS)
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == {(i, len(sets[i]), root[i]) for i in sets}
    assert parity_join.near_duplicates(none).count() == 0
    kept = parity_join.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(root.values()))


def test_near_duplicates_without_ids_or_with_one_id_for_several_texts(spark):
    """Links go through texts without an id, and by text, not by id."""
    base = [f"w{k}" for k in range(120)]
    step = lambda n: " ".join([f"x{k}" for k in range(n)] + base[n:])  # noqa: E731  near step(n + 6), not step(n + 12)
    lone, other = " ".join(f"y{k}" for k in range(90)), " ".join(f"z{k}" for k in range(90))
    rows = [(7, step(0)), (None, step(6)), (3, step(12)), (None, lone), (None, lone + " more"),
            (5, other), (5, "nothing like it in any other row"), (9, other + " more"), (None, None), (4, "")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    text = collections.Counter((r.doc_id, r.component_id) for r in parity_join.near_duplicates(d).collect())
    assert text == collections.Counter([(7, 3), (None, 3), (3, 3), (None, None), (None, None), (5, 5), (5, 5), (9, 5), (None, None), (4, 4)])
    kept = [tuple(r) for r in parity_join.deduplicate(d).collect()]
    assert len(kept) == 6 and sum(t in (lone, lone + " more") for _, t in kept) == 1
    assert {(3, step(12)), (5, other), (5, "nothing like it in any other row"), (None, None), (4, "")} <= set(kept)


def test_sketch_bounds_the_difference_and_blocks_agree():
    g = np.random.default_rng(1)
    for n in (1, 2, 5, 7, 30, 200, 900):
        a = g.integers(0, 1 << 63, n).astype(np.uint64)
        gone = int(parity_join.most_different(np.array(2 * n))) // 2
        b = np.concatenate([a[gone:], g.integers(0, 1 << 63, gone).astype(np.uint64)])
        h, off = np.concatenate([np.sort(a), np.sort(b)]), np.array([0, n, 2 * n])
        if 100 * (n - gone) >= 85 * (n + gone):
            key, owner = parity_join.block_keys(h, off)
            assert set(key[owner == 0].tolist()) & set(key[owner == 1].tolist())
        w = parity_join.set_figures(h, off)[2]
        assert np.bitwise_count(w[0] ^ w[1]).sum() <= 2 * gone


def test_mixing(docs, none):
    got = mixing.mix_report(docs).collect()
    again = mixing.mix_report(docs).collect()
    key = lambda r: (r.doc_id, r.size, r.taken)
    assert len(got) == len(ROWS) and sorted(map(key, got)) == sorted(map(key, again))
    size, taken, target = collections.Counter(), collections.Counter(), {}
    text = {r[0]: r[1] for r in ROWS}
    for r in got:
        assert r["size"] == len((text[r.doc_id] or "").encode().split()) and 0 <= r.taken <= 2 * r["size"]
        size[r.source] += r["size"]
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert abs(sum(target.values()) - 1.5 * sum(size.values())) < 1e-6
    assert all(target[s] <= 2 * size[s] + 1e-9 and abs(taken[s] - target[s]) <= mixing.BLOCK for s in size)
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns
    assert sum(len(r.text.encode().split()) for r in mixed.collect()) == sum(taken.values())
    assert mixing.mix_report(none).count() == 0


def test_permutation_is_a_bijection(spark):
    from pyspark.sql import functions as F

    for n in (1, 2, 7, 100):
        col = mixing.permuted(F.col("id"), F.lit(n).cast("long"), [F.lit(3)])
        assert sorted(r[0] for r in spark.range(n).select(col).collect()) == list(range(n))


def test_chat(spark):
    rows = [(1, 0, "user", "hi \\ <|end|>"), (1, 1, "assistant", None), (1, 2, "assistant", "</s>[INST] ok [/INST]"),
            (2, 0, "a\nb", "x"), (2, None, None, "last"), (2, 0, "a\nb", "x"), (None, 3, "assistant", "é" * 50)]
    conv = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.read_back(chat.format_log(chat.events_of(conv))).collect()}
    assert len(got) == 3
    for c in (1, 2, None):
        mine = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is None, r[1] or 0, r[2] or "", r[3] or ""))
        turns = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in mine)
        loss = "".join(r[3] or "" for r in mine if r[2] == "assistant")
        assert got[c].n_turns == len(mine) and got[c].turns_sha256 == hashlib.sha256(turns.encode()).hexdigest()
        assert got[c].loss_chars == len(loss) and got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    log = [(5, 0, "m", 0, "start", "user", None), (5, 0, "m", 1, "delta", None, "wro"), (5, 0, "m", 1, "delta", None, "wro"),
           (5, 0, "m", 2, "regenerate", None, None), (5, 0, "m", 3, "delta", None, "a"), (5, 0, "m", 4, "delta", None, "b"),
           (5, 1, "n", 1, "delta", None, "draft"), (5, 1, "n", 2, "edit", None, "final"), (5, 1, "n", 0, "start", "assistant", None)]
    text = chat.format_log(spark.createDataFrame(log, chat.EVENTS)).first().formatted
    assert chat.parsed(text) == [("user", "ab"), ("assistant", "final")]


def test_chat_long_conversation_leaves_in_rows(spark):
    """No row and no task holds a whole long conversation."""
    rows = [(c, i % 200 if i % 7 else None, ["user", "assistant"][i % 2], f"{i % 90} <|end|> \\ " + "é\n" * 400) for c in (7, None) for i in range(400)]
    rows += [(9, 0, "user", "short")]
    conv = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.format_log(chat.events_of(conv)).cache()
    parts = collections.Counter(r.conv_id for r in out.collect())
    assert parts[7] > 3 and parts[None] > 3 and parts[9] == 1
    assert max(len(r.formatted) for r in out.collect()) <= 2 * chat.CHUNK_CHARS
    got = {r.conv_id: r for r in chat.read_back(out).collect()}
    assert len(got) == 3
    for c in (7, None, 9):
        mine = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is None, r[1] or 0, r[2], r[3]))
        whole = "".join(r.formatted for r in sorted(out.collect(), key=lambda r: (r.part, r.piece)) if r.conv_id == c)
        assert chat.parsed(whole) == [r[2:] for r in mine] and got[c].formatted_chars == len(whole)
        turns, loss = "".join(f"{r[2]}\n{r[3]}\n" for r in mine), "".join(r[3] for r in mine if r[2] == "assistant")
        assert got[c].n_turns == len(mine) and got[c].turns_sha256 == hashlib.sha256(turns.encode()).hexdigest()
        assert got[c].loss_chars == len(loss) and got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


def test_escape_round_trip():
    for t in ("", "\\", "<|", "[INST", "[/INST]<s>", "a\\<|end|>\nb", "<<SYS>>\\\\"):
        assert chat.unescape(chat.escape(t)) == t and not chat.CONTROL.search(chat.escape(t))


def test_quality(docs, none):
    got = {r.doc_id: r for r in quality.assess(docs).collect()}
    for i, t, *_ in ROWS:
        t = t or ""
        w = t.encode().split()
        n = collections.Counter(tuple(w[k:k + 8]) for k in range(len(w) - 7))
        cover = {j for k in range(len(w) - 7) if n[tuple(w[k:k + 8])] > 1 for j in range(k, k + 8)}
        failed = len(w) < 20 or 100 * len(cover) > 30 * len(w)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_repeat_words, r.base_failed) == (
            len(w), sum(len(x.decode()) for x in w), len(re.findall(r"[#*$%&|<>]", t)), len(cover), failed)
        assert not (failed and r.kept)
    assert quality.assess(none).count() == 0
    assert quality.line_failure("Home | News | Mail | Sport", 7, False) and quality.line_failure("All rights reserved.", 3, False)
    assert quality.line_failure("The bird sat on the wall.", 6, False) is None


def test_codes_give_random_access():
    g = np.random.default_rng(2)
    for n in (0, 1, 511, 512, 513, 5000):
        ids = np.minimum(g.pareto(0.4, n) * 50, 50256).astype(np.uint32)
        codes = tokenfile.TokenCodes(tokenfile.encode_ids(ids))
        assert (codes.read(0, n) == ids).all()
        for i in g.integers(0, n, 40) if n else []:
            assert codes.get(int(i)) == ids[i]
            assert (codes.read(int(i), n) == ids[int(i):]).all()


def test_token_files(docs, none):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    got = sorted(tokenfile.read_back(tokenfile.write(docs, path)).collect())
    at, want = 0, []
    for i, t, *_ in sorted(ROWS, key=lambda r: r[0]):
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert [tuple(r) for r in got] == sorted(want)
    assert tokenfile.read_back(tokenfile.write(none, path)).count() == 0


def test_decontamination(docs, none, spark):
    items = [(1, BASE[0]), (2, "two words"), (3, None), (4, "!!"), (2, "two words")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    split = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower())
    grams = collections.defaultdict(set)
    for i, t in items:
        w = split(t)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            grams[tuple(w[k:k + n])].add(str(i))
    got = {r.doc_id: r for r in decontam.report(docs, bench).collect()}
    for i, t, *_ in ROWS:
        w, hit, found = split(t), set(), set()
        for n in {len(g) for g in grams}:
            for k in range(len(w) - n + 1):
                if tuple(w[k:k + n]) in grams:
                    hit |= set(range(k, k + n))
                    found |= grams[tuple(w[k:k + n])]
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        assert (got[i].n_words, got[i].n_hit, got[i].n_items, got[i].items_sha256) == (len(w), len(hit), len(found), sha)
    clean = decontam.remove_documents(docs, bench)
    assert clean.columns == docs.columns and not {r.doc_id for r in clean.collect()} & {i for i, r in got.items() if r.contaminated}
    assert decontam.report(none, bench).count() == 0 and decontam.report(docs, bench.limit(0)).where("contaminated").count() == 0


def test_code_lengths_are_those_of_a_distribution():
    text = b"abracadabra abrakadabra"
    g = collections.Counter(tuple(text[i:i + 4]) for i in range(len(text) - 3))
    rows = [("x", int.from_bytes(bytes(k), "big"), n) for k, n in g.items()]
    trees = langid.ContextTrees(rows)
    for head in (b"abr", b"zzz", b"a z"):
        one = trees.lengths([head])[0, 0]
        both = np.array([trees.lengths([head + bytes([b])])[0, 0] for b in range(256)])
        assert abs(np.exp2(one - both).sum() - 1) < 1e-3


def test_language_and_scores(docs, none, spark):
    data = "/root/testdata/sf0.001/documents.parquet"
    real = spark.read.parquet(data)
    got = langid.identify(real).join(real.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.95
    out = {r.doc_id: r for r in langid.identify(docs).collect()}
    assert out[0].lang_pred == out[1].lang_pred == out[2].lang_pred == "und" and all(0 <= r.score <= 1 for r in out.values())
    assert langid.identify(none).count() == 0


def test_toxicity(spark, docs):
    sf = "/root/testdata/sf0.01"
    real, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.classify(real, labels).join(labels, "doc_id").collect()
    assert np.mean([r.rejected for r in got if r.toxic]) > 0.6 and np.mean([r.rejected for r in got if not r.toxic]) < 0.01
    bare = labels.limit(0)
    assert toxicity.remove_toxic(docs, bare).count() == len(ROWS)
    assert toxicity.classify(docs, bare).where("rejected").count() == 0


def test_lm(docs, none):
    P = pytest.importorskip("public_tokenizers")
    path = P.path("byte_bpe_50k.json")
    got = {r.doc_id: r for r in lm.score(docs, path).collect()}
    end = object()
    tokens = [(i, [*words(t), end]) for i, t, *_ in ROWS]
    c = collections.Counter(w for i, ws in tokens if zlib.crc32(str(i).encode()) % 10 for w in ws)
    n, kinds = sum(c.values()), len(c)
    for i, ws in tokens:
        base = sum(np.log10((c[w] + 0.1) / (n + 0.1 * (kinds + 1))) for w in ws)
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(ws), sum(c[w] > 0 for w in ws), n)
        assert abs(got[i].base_score - base) < 1e-6 * max(1, abs(base)) and got[i].score < 0
    assert lm.score(none, path).count() == 0
    held = docs.where("crc32(cast(cast(doc_id AS string) AS binary)) % 10 = 0").cache()  # nothing to learn from
    alone = lm.score(held, path).collect()
    assert len(alone) == held.count() and all(r.train_tokens == r.n_known == 0 and r.score < 0 for r in alone)
    assert lm.score(docs.drop("lang"), path).count() == len(ROWS)


def test_lm_attention_learns_from_all_texts(spark):
    """Almost no text is in the sample, so what the model knows of order comes
    from the passes over all texts, each symbol once a target."""
    from pyspark.sql import functions as F

    from closebook.llm.attention import Attention

    P = pytest.importorskip("public_tokenizers")
    path = P.path("byte_bpe_50k.json")
    cycle = ["stone", "river", "green", "tall", "bird", "sky", "run", "blue"]
    rows = [(i, " ".join(cycle[(i + k) % 8] for k in range(400))) for i in range(1700)]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("grp", F.lit(0)).repartition(3)
    total = sum(len(t) for _, t in rows)
    assert total > 3 << 20
    counts = lm.word_counts(d, [0]).cache()
    model = lm.trained(d, counts, path, 1, total)
    encode, end = lm.subwords(path)
    flat, offsets = lm.split(lm.pa.array([rows[3][1]]))
    codes, distinct = lm.coded(flat)
    y, _, starts = lm.stream(codes, offsets, *encode(distinct), end)
    fresh = Attention(lm.subword_counts(counts, path))
    assert model.score(y, starts).mean() > fresh.score(y, starts).mean() + 0.5
    one, other = fresh.copy(), fresh.copy()
    used = one.sweep(y, starts)
    assert used["E"].sum() == len(y) and np.array_equal(fresh.p["E"], other.p["E"])
    other.move(2.0 * one.moved(fresh, used))  # two tasks that took the same steps
    assert all(np.allclose(one.p[k], other.p[k], atol=1e-4) for k in one.p)


def test_lm_learns_the_groups(spark):
    """Texts of two labels with words of their own: a held-out text's own
    words tell its group, so it costs less than without labels."""
    P = pytest.importorskip("public_tokenizers")
    path = P.path("byte_bpe_50k.json")
    kinds = {"en": ["stone", "river", "green"], "de": ["Vogel", "gross", "blau"]}
    rows = [(i, " ".join(R.choice(kinds[g]) for _ in range(40)), g) for i in range(200) for g in [["en", "de"][i % 2]]]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    total = lambda df: sum(r.score for r in lm.score(df, path).collect() if r.held_out)
    base = sum(r.base_score for r in lm.score(d, path).collect() if r.held_out)
    assert total(d) > total(d.drop("lang")) and total(d) > base


def test_missing_words_are_encoded_end_to_end():
    """New words reach the library as one text, not one by one, with the ids of whole texts."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    words = [f"{a}{b}{c}" for a in ("zor", "émil", "語", "Qx", "don't", "3,5") for b in ("", "ple", "ß", "𝄞x") for c in ("", "ing", "-7", "<|s|>")]
    texts = [" ".join(words), "\n".join(words) + " ", "a b 　c  d\te " + ", ".join(words) + ".", "", " lead", "x \n\ny", "</s> <s> é"]
    pieces, asked = tokenfile.Pieces(path), []

    class Watched:
        def encode_batch_fast(self, batch, **kw):
            asked.extend(batch)
            return whole.encode_batch_fast(batch, **kw)

    whole = pieces.tok
    pieces.tok = Watched()
    ids, n = pieces.encode(texts)
    want = [[*e.ids, tokenfile.END_ID] for e in whole.encode_batch_fast(texts, add_special_tokens=False)]
    assert ids.tolist() == [i for x in want for i in x] and n.tolist() == [len(x) for x in want]
    asked.clear()
    pieces.forget()
    ids, n = pieces.encode(texts[:1])
    assert ids.tolist() == want[0] and len(asked) <= 3 < len(words)


def test_texts_with_uneven_white_space_are_cut_into_words():
    """Whatever stands around a word, the parts are short and the ids those of the whole text."""
    import public_tokenizers

    pieces, g = tokenfile.Pieces(public_tokenizers.path("byte_bpe_50k.json")), random.Random(3)
    odd = [" ", " ", "\n", "\t", "\r", "\x1c", "\x00", "\x85", "\xa0", " ", "　", "a", "The", "é", "ß", "×", "à", "語", "あ", "​", "𝄞", "́",
           "12", ",", ".", "'s", "'", "-", "<|endoftext|>"]
    texts = ["".join(g.choice(odd) for _ in range(g.randint(0, 30))) for _ in range(4000)] + [None, ""]
    ids, n = pieces.encode(texts)
    want = [[*e.ids, tokenfile.END_ID] for e in pieces.tok.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]
    assert ids.tolist() == [i for x in want for i in x] and n.tolist() == [len(x) for x in want]
    pieces.forget()
    pieces.encode(["stone  river, green \n tall.  bird " * 50])
    assert max(map(len, pieces.cache)) < 20 and len(pieces.cache) < 12
    sliced = tokenfile.pa.array(["left out", None, "one, two\n\nthree", ""]).slice(1)
    parts, count = tokenfile.parts_of(sliced)
    assert parts.to_pylist() == [b"one", b",", b" two", b"\n\nthree"] and count.tolist() == [0, 4, 0]


def test_lm_words_reach_the_tokenizer_in_slices(monkeypatch):
    """What the library returns is far larger than the words: never for all words of a chunk at once."""
    import public_tokenizers
    import tokenizers

    path, most = public_tokenizers.path("byte_bpe_50k.json"), []

    class Watched:
        def __init__(self, tok):
            self.__dict__["tok"] = tok

        def __getattr__(self, name):
            return getattr(self.tok, name)

        def encode_batch_fast(self, batch, **kw):
            out = self.tok.encode_batch_fast(batch, **kw)
            most.append(sum(len(e.ids) for e in out))
            return out

    class Files:
        from_file = staticmethod(lambda p, real=tokenizers.Tokenizer: Watched(real.from_file(p)))

    whole = tokenizers.Tokenizer.from_file(path)
    whole.encode_special_tokens = True
    monkeypatch.setattr(tokenizers, "Tokenizer", Files)
    some = [f"{a}{k}{b}".encode() for k in range(3000) for a, b in (("zor", "ple"), ("été", ""), ("x　", "y"))]
    ids, n = lm.subwords(path)[0](some)
    want = [e.ids for e in whole.encode_batch_fast([" " + w.decode() for w in some], add_special_tokens=False)]
    assert ids.tolist() == [i for x in want for i in x] and n.tolist() == [len(x) for x in want]
    assert len(most) > 3 and max(most) < len(ids) / 3


def test_lm_step_adds_up_repeated_symbols():
    from closebook.llm import attention

    g = np.random.default_rng(7)
    for top in (40, 70_000):
        index, rows = g.integers(0, top, 500), g.standard_normal((500, 16)).astype(np.float32)
        at, total = attention.summed(index, np.ascontiguousarray(rows.T))
        plain = np.zeros((top, 16))
        np.add.at(plain, index, rows)
        assert at.tolist() == sorted(set(index.tolist())) and np.allclose(total, plain[at], atol=1e-5)
        assert np.allclose(attention.row_sums(index, rows.T, top), plain, atol=1e-5)


def test_lm_step_follows_the_gradient():
    """The step of every weight against differences of the loss."""
    from closebook.llm.attention import STRIDE, Attention

    g = np.random.default_rng(3)
    counts = g.integers(1, 50, 60).astype(float)
    model = Attention(counts)
    x, text = g.integers(0, 60, (6, 2 * STRIDE)), np.cumsum(g.random((6, 2 * STRIDE)) < 0.08, 1)
    y = g.integers(0, 60, (6, STRIDE))
    y[-1, -4:] = -1
    new = model.copy()
    new._step(x, text, y, 0.2)
    for name, w in model.p.items():
        grad = np.sqrt(np.maximum(new.seen[name].astype(float) - model.seen[name], 0)) * np.sign(w - new.p[name])
        for at in np.argsort(-np.abs(grad), axis=None)[[0, 1, 2, -1]]:
            loss = []
            for eps in (0.01, -0.01):
                other = model.copy()
                other.p[name].flat[at] += eps
                loss.append(other._step(x, text, y, 0.2))
            assert abs((loss[0] - loss[1]) / 0.02 - grad.flat[at]) < 2e-3 + 0.02 * abs(grad.flat[at]), name


def test_lm_scores_are_a_distribution():
    """Over all next symbols the probabilities sum to one, in a text of its own and behind another one."""
    from closebook.llm.attention import Attention

    g = np.random.default_rng(4)
    model = Attention(g.integers(1, 50, 60).astype(float))
    old = g.integers(0, 60, 48)  # whole strides, so that both texts lie alike
    model.sweep(np.tile(old, 30), np.arange(0, 1440, 48))
    last = [model.score(np.append(old, k), np.array([0]))[-1] for k in range(60)]
    assert abs(np.exp(np.array(last, float)).sum() - 1) < 1e-4
    both = model.score(np.concatenate([old, old]), np.array([0, 48]))
    assert np.allclose(both[:48], both[48:], atol=1e-4)


def test_lm_words_are_encoded_with_their_counts(spark):
    """Scoring gets the ids by the join with the counts; only words that no
    training text has go to the tokenizer there."""
    from pyspark.sql import functions as F

    P = pytest.importorskip("public_tokenizers")
    path = P.path("byte_bpe_50k.json")
    d = spark.createDataFrame([(1, "Grün grün zorple zorple x"), (2, "x ünïcôdé"), (3, None), (4, "")], "doc_id long, text string").withColumn("grp", F.lit(0))
    counts = lm.with_ids(lm.word_counts(d, [0]), path)
    got = {bytes(r.word): (r.c, list(r.by), np.frombuffer(r.ids, "<u2").tolist()) for r in counts.collect()}
    assert {w: v[0] for w, v in got.items()} == {"grün".encode(): 2, b"zorple": 2, b"x": 2, "ünïcôdé".encode(): 1, b"": 4}
    encode, size = lm.subwords(path)
    assert all(v[2] == (encode([w])[0].tolist() if w else []) and v[1] == [v[0]] for w, v in got.items())
    assert np.array_equal(lm.subword_counts(counts, path), lm.subword_counts(lm.word_counts(d, [0]), path))
    for top in (9, 70_000):
        column = lm.pa.array([np.array(v, lm.id_type(top)).tobytes() for v in ([7], [], [8, top])], lm.pa.binary())
        ids, n = lm.taken(*lm.numbers(column.slice(1), top), np.array([1, 0]))
        assert ids.tolist() == [8, top] and n.tolist() == [2, 0]


def test_lm_remembers_a_bounded_number_of_words(monkeypatch):
    P = pytest.importorskip("public_tokenizers")
    path = P.path("byte_bpe_50k.json")
    monkeypatch.setattr(lm, "KEPT", 5)
    known, plain = lm.Remembering(path), lm.subwords(path)[0]
    for some in (["zorple", "été", "a"], ["a", "grün", "zorple", "été", "blau", "rot"], ["rot", "a", "x"], []):
        some = [w.encode() for w in some]
        (ids, n), (want, m) = known(some), plain(some)
        assert ids.tolist() == want.tolist() and n.tolist() == m.tolist()
    assert len(known.row) == len(known.n) == 5 and len(known.ids) == known.n.sum()


def test_lm_chunks_are_scored_in_tasks_of_their_own(docs):
    """No task gets several chunks while others get none."""
    P = pytest.importorskip("public_tokenizers")
    assert lm.score(docs, P.path("byte_bpe_50k.json")).rdd.getNumPartitions() == 12
