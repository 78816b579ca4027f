"""N-gram Jaccard join by parity sketches.

A document's set holds the hashes of its distinct ``width``-word shingles.
Cut the hash space into k equal ranges; in each range (a block) the set's
parity vector over the hash bits is kept as the XOR fingerprint of its
members.  One shingle more or less changes one block only, so at most
|A xor B| blocks of two sets differ.  100 |A and B| >= 85 |A or B| bounds
|A xor B| by d = 15 (|A| + |B|) / 185; with k = d + 1 + s blocks at least
s + 1 agree (pigeonhole).  Each set is a key under all its blocks but the s
that hold the fewest shingles (ties by block number): among s + 1 agreeing
blocks the fullest is skipped by neither side, so no linked pair is lost, and
blocks too empty to tell sets apart are not keys.

Sets of near sizes only can link: sizes are cut into bands, with keys for the
pairs inside a band and keys for the pairs across each band edge.

Candidates are verified exactly.  Equal sets are one class, so copies cost
one set.  Members of a key are first compared with the member that shares the
most keys; where the links found leave a key's members in several components,
their pairs across components are compared by 1,024-bit parity sketches, whose
Hamming distance bounds |A xor B| from below, in blocks of bounded size, and
what passes is verified too.  So the components are those of all links.

Hot keys: tasks combine their own keys before the shuffle and send one member
a key; members then travel as rows of joins that adaptive execution may split.

Defined results.  Null, empty or blank text: empty set, linked with nothing,
its own component.  Fewer than ``width`` words: one shingle, the whole
sequence.  Repeated rows: equal sets, linked.  Null ids: linked like others,
never the smallest; a component without ids has a null name.  An id of several
texts: each text is a document; components with the same lowest id share that name.
Empty table: no rows.  Extra columns are ignored (``deduplicate`` keeps them).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from closebook.llm.arrow_words import coded, mixed, pieces, split, windows, word_hashes
from closebook.llm.common import stored
from closebook.llm.components import components

WIDTH = 4
SHARE = 85  # percent
SKETCH_BITS = 1024
BUCKET_BYTES = 8 << 20
FLUSH = 400_000
BLOCK_MEMBERS = 2048
MAX_BROADCAST_IDS = 2_000_000


def band_edges(most: int = 1 << 40) -> np.ndarray:
    """Sizes at which bands begin; each is more than 100/85 times the last."""
    edges = [1]
    while edges[-1] < most:
        edges.append(max(edges[-1] + 1, edges[-1] * 3 // 2))
    return np.array(edges, np.int64)


def most_different(total: np.ndarray, share: int = SHARE) -> np.ndarray:
    """Greatest |A xor B| of two linked sets with |A| + |B| = total."""
    return (100 - share) * total // (100 + share)


def families(n: np.ndarray, share: int = SHARE) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(sets, family, differences) three times: pairs inside a band, across
    its lower edge, across its upper edge; ``n``: set sizes (not 0)."""
    edges = band_edges()
    band = np.searchsorted(edges, n, side="right") - 1
    lo, hi = edges[band], edges[band + 1]
    every = np.arange(len(n))
    across = lambda edge: most_different(edge - 1 + 100 * (edge - 1) // share, share)
    low, high = share * n <= 100 * (lo - 1), 100 * n >= share * hi
    return [(every, 2 * band, most_different(2 * (hi - 1), share)), (every[low], 2 * band[low] + 1, across(lo)[low]),
            (every[high], 2 * band[high] + 3, across(hi)[high])]


def shingle_sets(texts: pa.Array, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): the sorted distinct shingle hashes of every text."""
    flat, offsets = split(texts)
    codes, distinct = coded(flat)
    wh = word_hashes(distinct)[codes]
    h, starts = windows(wh, offsets, width)
    doc = np.searchsorted(offsets, starts, side="right") - 1
    n = np.diff(offsets)
    short = np.flatnonzero((n > 0) & (n < width))
    one = np.array([mixed(np.array([sum(int(x) * (2 * j + 3) for j, x in enumerate(wh[offsets[d]:offsets[d] + n[d]])) * 2654435761 + int(n[d]) & ((1 << 64) - 1)], np.uint64))[0]
                    for d in short], np.uint64)
    h, doc = np.concatenate([h, one]), np.concatenate([doc, short])
    if len(short):
        order = np.argsort(doc, kind="stable")
        h, doc = h[order], doc[order]
    edges = np.searchsorted(doc, np.arange(len(n) + 1))
    for a, b in zip(edges[:-1], edges[1:]):
        h[a:b].sort()
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[first], np.concatenate([[0], np.cumsum(first)])[edges]


def block_keys(h: np.ndarray, offsets: np.ndarray, share: int = SHARE) -> tuple[np.ndarray, np.ndarray]:
    """(key, set) pairs: every set under the blocks that it does not skip."""
    n = np.diff(offsets)
    some = np.flatnonzero(n)
    print_ = mixed(h ^ np.uint64(0x5851F42D4C957F2D))
    keys, sets = [], []
    for at, family, d in families(n[some], share):
        if not len(at):
            continue
        at = some[at]
        spare = np.where(d > 0, (d + 5) // 5, 0)
        k = d + 1 + spare
        size = n[at]
        idx = np.repeat(offsets[at] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        owner = np.repeat(np.arange(len(at)), size)
        block = ((h[idx] >> np.uint64(32)) * k[owner].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        new = np.ones(len(idx), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (block[1:] != block[:-1])
        begin = np.flatnonzero(new)
        x = np.bitwise_xor.reduceat(print_[idx], begin)
        o, b, c = owner[begin], block[begin], np.diff(np.append(begin, len(idx)))
        order = np.lexsort((b, c, o))
        o, b, x = o[order], b[order], x[order]
        full = np.bincount(o, minlength=len(at))
        empty = k - full
        rank = np.arange(len(o)) - np.repeat(np.cumsum(full) - full, full)
        use = rank + empty[o] >= spare[o]
        o_, b_, x_ = [o[use]], [b[use]], [x[use]]
        for q in np.flatnonzero(empty > spare):  # more empty blocks than may be skipped
            left = np.setdiff1d(np.arange(k[q]), b[o == q])[spare[q]:]
            o_.append(np.full(len(left), q))
            b_.append(left)
            x_.append(np.zeros(len(left), np.uint64))
        o, b, x = np.concatenate(o_), np.concatenate(b_), np.concatenate(x_)
        place = (family[o].astype(np.uint64) << np.uint64(40)) + b.astype(np.uint64)
        keys.append(mixed(x + mixed(place + np.uint64(0x9E3779B97F4A7C15))))
        sets.append(at[o])
    return (np.concatenate(keys), np.concatenate(sets)) if keys else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def set_figures(h: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two 64-bit set hashes and the parity sketch (16 words) of each set."""
    n = np.diff(offsets)
    a, b = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
    some = np.flatnonzero(n)
    if len(some):
        a[some] = np.add.reduceat(mixed(h + np.uint64(1)), offsets[some])
        b[some] = np.bitwise_xor.reduceat(mixed(h + np.uint64(2)), offsets[some])
    owner = np.repeat(np.arange(len(n)), n)
    bits = np.bincount(owner * SKETCH_BITS + (h & np.uint64(SKETCH_BITS - 1)).astype(np.int64), minlength=len(n) * SKETCH_BITS) & 1
    words = np.packbits(bits.astype(np.uint8).reshape(len(n), SKETCH_BITS), axis=1, bitorder="little").view(np.uint64)
    return mixed(a + n.astype(np.uint64)), b, words


def combined(key: np.ndarray, sid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (key, set) sorted by key, and which keys have several sets."""
    order = np.lexsort((sid, key))
    key, sid = key[order], sid[order]
    keep = np.ones(len(key), bool)
    keep[1:] = (key[1:] != key[:-1]) | (sid[1:] != sid[:-1])
    key, sid = key[keep], sid[keep]
    shared = np.zeros(len(key), bool)
    same = key[1:] == key[:-1]
    shared[1:] |= same
    shared[:-1] |= same
    return key, sid, shared


RAW = "bucket int, doc_id long, text_hash long, n int, sid long, sid2 long, sketch array<long>, keys binary, sids binary, done boolean"
RAW_FIELDS = pa.schema([("bucket", pa.int32()), ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n", pa.int32()), ("sid", pa.int64()), ("sid2", pa.int64()),
                        ("sketch", pa.list_(pa.int64())), ("keys", pa.binary()), ("sids", pa.binary()), ("done", pa.bool_())])
FOUND = "doc_id long, text_hash long, n int, sid long, sid2 long, sketch array<long>, key long"
FOUND_FIELDS = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n", pa.int32()), ("sid", pa.int64()), ("sid2", pa.int64()), ("sketch", pa.list_(pa.int64())), ("key", pa.int64())])


def columns(fields: pa.Schema, rows: int, **given) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([given[f.name] if isinstance(given.get(f.name), pa.Array) else
                                       pa.nulls(rows, f.type) if f.name not in given else pa.array(given[f.name], f.type) for f in fields], schema=fields)


def signed(a: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(a).view(np.int64)


def sketched(docs: DataFrame, width: int = WIDTH, share: int = SHARE) -> DataFrame:
    """The documents' figures (rows with doc_id or n) and the members of all
    keys that hold several sets (rows with key), written to the shared folder.

    One pass over the texts and one shuffle: key rows of a task are packed by
    bucket of the key space, and a bucket is small by construction.
    """
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = int(max(8, total // BUCKET_BYTES))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            key, sid, shared = combined(*(np.concatenate(x) for x in zip(*held)))
            held.clear()
            first = np.ones(len(key), bool)
            first[1:] = key[1:] != key[:-1]
            for done, use in ((False, first), (True, shared)):
                k, s = key[use], sid[use]
                bucket = (k >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
                edges = np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))
                at = np.flatnonzero(np.diff(edges))
                yield columns(RAW_FIELDS, len(at), bucket=at, keys=[k[edges[i]:edges[i + 1]].tobytes() for i in at],
                              sids=[s[edges[i]:edges[i + 1]].tobytes() for i in at], done=[done] * len(at))

        for b in pieces(batches):
            h, offsets = shingle_sets(b.column("text"), width)
            sid, sid2, words = set_figures(h, offsets)
            rows = np.arange(b.num_rows)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * 16), pa.array(signed(words).reshape(-1)))
            yield columns(RAW_FIELDS, b.num_rows, bucket=(signed(sid) + rows) % buckets, doc_id=b.column("doc_id"), text_hash=b.column("text_hash"), n=np.diff(offsets),
                          sid=signed(sid), sid2=signed(sid2), sketch=flat)
            key, owner = block_keys(h, offsets, share)
            held.append((key, sid[owner]))
            if sum(len(x[0]) for x in held) > FLUSH:
                yield from flush()
        if held:
            yield from flush()

    def meet(table: pa.Table) -> pa.Table:
        packed = table.column("keys").is_valid()
        docs_ = table.filter(pa.compute.invert(packed)).combine_chunks()
        rest = table.filter(packed)
        done = rest.column("done").to_numpy(zero_copy_only=False).astype(bool)
        join = lambda name, use: np.frombuffer(b"".join(x for x, u in zip(rest.column(name).to_pylist(), use) if u), np.uint64)
        key, sid, shared = combined(join("keys", ~done), join("sids", ~done))
        key = np.concatenate([key[shared], join("keys", done)])
        sid = np.concatenate([sid[shared], join("sids", done)])
        members = columns(FOUND_FIELDS, len(key), sid=signed(sid), key=signed(key))
        own = docs_.select(["doc_id", "text_hash", "n", "sid", "sid2", "sketch"]).append_column("key", pa.nulls(docs_.num_rows, pa.int64()))
        return pa.concat_tables([own.cast(FOUND_FIELDS), pa.Table.from_batches([members])])

    raw = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text").mapInArrow(sketch, RAW)
    return stored(raw.groupBy("bucket").applyInArrow(meet, FOUND), "sketches")


def linked(docs: DataFrame, pairs: DataFrame, width: int, share: int) -> DataFrame:
    """The pairs (a, b of class representatives) whose sets truly link."""
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            h, offsets = shingle_sets(b.column("text"), width)
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(signed(h)))
            yield pa.RecordBatch.from_arrays([b.column("id"), lists], ["id", "s"])

    ids = stored(ids, "linked-ids")  # 8 bytes a row
    if ids.count() <= MAX_BROADCAST_IDS:  # else the texts shuffle
        ids = F.broadcast(ids)
    texts = docs.select(F.xxhash64("text").alias("id"), "text").join(ids, "id", "left_semi")
    s = stored(texts.mapInArrow(sets, "id long, s array<long>").dropDuplicates(["id"]), "sets")
    both = (pairs.join(s.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
            .join(s.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a"))
    common = F.size(F.array_intersect("sa", "sb"))
    true = 100 * common >= share * (F.size("sa") + F.size("sb") - common)
    return stored(both.where(true).select(F.col("a").alias("u"), F.col("b").alias("v")), "links")


def possible(pairs: DataFrame, classes: DataFrame, share: int) -> DataFrame:
    """Pairs of classes that sizes and sketches do not rule out."""
    side = lambda c: classes.select(F.col("rep").alias(c), F.col("n").alias("n" + c), F.col("sketch").alias("s" + c))
    j = pairs.join(side("a"), "a").join(side("b"), "b")
    apart = F.aggregate(F.zip_with("sa", "sb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x.cast("int"))
    return j.where((F.least("na", "nb") * 100 >= F.greatest("na", "nb") * share)
                   & (apart <= F.expr(f"({100 - share} * (na + nb)) div {100 + share}"))).select("a", "b")


def cross_pairs(members: DataFrame, labels: DataFrame, classes: DataFrame, share: int) -> DataFrame:
    """Pairs that share a key but no component and that the sketches allow.

    Keys with members of one component are done.  The members of the others
    meet in blocks of ``BLOCK_MEMBERS`` or fewer, pairs of blocks at a time.
    """
    m = members.join(classes.select("rep", "n", "sketch"), "rep").join(labels, F.col("rep") == F.col("u"), "left")
    m = m.select("key", "rep", "n", "sketch", F.coalesce("root", "rep").alias("root"))
    open_ = m.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi")
    m = m.join(open_.select("key", F.ceil(F.col("size") / BLOCK_MEMBERS).cast("int").alias("blocks")), "key")
    own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    m = m.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    m = m.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "rep", "n", "sketch", "root")

    def meet(table: pa.Table) -> pa.Table:
        n, rep, root, own_ = (table.column(c).to_numpy().astype(np.int64) for c in ("n", "rep", "root", "own"))
        sk = table.column("sketch").combine_chunks().flatten().to_numpy().reshape(len(n), -1).view(np.uint64)
        one_block = table.column("i")[0].as_py() == table.column("j")[0].as_py()
        a, b = [], []
        values, count = np.unique(root, return_counts=True)
        largest = values[count.argmax()]
        for x in np.flatnonzero(root != largest) if one_block else range(len(n)):
            y = root != root[x]
            y &= (rep > rep[x]) | (root == largest) if one_block else (own_ > own_[x])
            y &= (np.minimum(n, n[x]) * 100 >= np.maximum(n, n[x]) * share)
            y = np.flatnonzero(y)
            apart = np.bitwise_count(sk[y] ^ sk[x]).sum(1, dtype=np.int64)
            y = y[apart <= most_different(n[y] + n[x], share)]
            a += np.minimum(rep[y], rep[x]).tolist()
            b += np.maximum(rep[y], rep[x]).tolist()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return m.groupBy("key", "i", "j").applyInArrow(meet, "a long, b long").distinct()


def clustered(docs: DataFrame, width: int = WIDTH, share: int = SHARE) -> DataFrame:
    """doc_id, text_hash, n and root of every row of ``docs``; root names the
    component and is null for empty sets.  Classes of equal sets go by the
    lowest hash of their texts, so ids need not be there nor be unique."""
    found = sketched(docs, width, share)
    rows = found.where("key IS NULL").select("doc_id", "text_hash", "n", "sid", "sid2")
    classes = stored(found.where("key IS NULL AND n > 0").groupBy("sid", "sid2", "n")
                     .agg(F.min("text_hash").alias("rep"), F.any_value("sketch").alias("sketch")), "classes")
    members = stored(found.where("key IS NOT NULL").select("key", "sid").distinct()
                     .join(classes.select("sid", "rep"), "sid").select("key", "rep"), "members")
    weight = members.groupBy("rep").agg(F.count(F.lit(1)).alias("keys"))
    centre = (members.join(weight, "rep").groupBy("key").agg(F.max(F.struct("keys", F.bitwise_not("rep").alias("low"))).alias("c"))
              .select("key", F.bitwise_not("c.low").alias("centre")))
    stars = (members.join(centre, "key").where("rep <> centre")
             .select(F.least("rep", "centre").alias("a"), F.greatest("rep", "centre").alias("b")).distinct())
    tried = stored(possible(stars, classes, share), "pairs")
    links = linked(docs, tried, width, share)
    labels = components(links)
    more = stored(cross_pairs(members, labels, classes, share).join(tried, ["a", "b"], "left_anti"), "pairs")
    if more.limit(1).count():
        labels = components(links.unionByName(linked(docs, more, width, share)))
    r, c = rows.alias("r"), classes.select("sid", "sid2", "n", "rep").alias("c")
    on = (F.col("r.sid") == F.col("c.sid")) & (F.col("r.sid2") == F.col("c.sid2")) & (F.col("r.n") == F.col("c.n")) & (F.col("r.n") > 0)
    out = r.join(c, on, "left").join(labels, F.col("rep") == F.col("u"), "left")
    return out.select("r.doc_id", "r.text_hash", "r.n", F.coalesce("root", "rep").alias("root"))


def near_duplicates(docs: DataFrame, width: int = WIDTH, share: int = SHARE) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs``."""
    found = stored(clustered(docs, width, share), "clusters")
    names = found.where("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("lowest"))
    return found.join(names, "root", "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"),
                                                    F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("lowest")).alias("component_id"))


def deduplicate(docs: DataFrame, width: int = WIDTH, share: int = SHARE) -> DataFrame:
    """``docs`` with one document of each component: the one of lowest id
    (of that id's texts in it the one of lowest hash, once); a component
    without ids keeps one text; rows of empty sets stay, once an id and text."""
    found = stored(clustered(docs, width, share), "clusters")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash"))
    first = (found.where("root IS NOT NULL").groupBy("root").agg(best.alias("k")).select("k.doc_id", "k.text_hash")
             .unionByName(found.where("root IS NULL").select("doc_id", "text_hash").distinct()).alias("k"))
    kept = docs.alias("d").join(first, (F.xxhash64("d.text") == F.col("k.text_hash")) & F.col("d.doc_id").eqNullSafe(F.col("k.doc_id")), "left_semi")
    return kept.dropDuplicates(["doc_id", "text"])
