"""Benchmark decontamination [native].

All windows of ``width`` words of the benchmark items are hashed into an index
(one row per distinct window, with the items that hold it).  Every window of
every document is hashed, looked up, verified word by word, and the hits are
folded into covered word spans per document.

The index is broadcast only after its size is checked against
``MAX_BROADCAST_BYTES``; beyond, the same join shuffles.

Defined results.  Null or empty text: no words, no hits.  An item of fewer
words than ``width`` is one window of its own length; an item without words
has none.  Repeated documents: each row is judged.  Items repeated under one
id count once.  Null item ids are left out of the item list but their windows
hit.  Empty benchmark: no document is hit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from closebook.llm.common import ascii_lower, stored

WIDTH = 10
MAX_BROADCAST_BYTES = 128 << 20
#: Fixed value: what is no word, once A-Z are lower-cased.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), GAP), "")


def gram_hash(w: Column, first: Column, n: Column, width: int) -> Column:
    """Hash of the ``n`` words (at most ``width``) of ``w`` from position
    ``first`` (0-based); word by word, so it stays in generated code."""
    return F.xxhash64(*[F.when(n > k, F.get(w, first + k)) for k in range(width)])


def window_index(benchmark: DataFrame, width: int = WIDTH, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(n, h, gram, items): the distinct windows with their length, hash,
    words and sorted item ids."""
    w = benchmark.select(F.col(id_col).cast("string").alias("item"), words(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    w = w.withColumn("n", F.least(F.size("w"), F.lit(width)))
    w = w.withColumn("i", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("n") + 1)))
    w = w.withColumn("gram", F.slice("w", F.col("i"), F.col("n")))
    return (w.groupBy("n", "gram").agg(F.sort_array(F.collect_set("item")).alias("items"))
            .withColumn("h", gram_hash(F.col("gram"), F.lit(0), F.col("n"), width)))


def scanned(docs: DataFrame, index: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, copies, n_words, spans, items) of every distinct
    document: its rows, its words, the windows of the index that it holds as
    sorted spans (start, end) of word positions, and their items.

    One pass: position 0 of a text stands for the document itself, each later
    one for the windows that begin there.  Texts are not copied to positions:
    the join keeps the position only, and reads the words where a hash agrees.
    """
    index = stored(index, "window-index")
    lengths = sorted((r[0] for r in index.select("n").distinct().collect()), reverse=True) or [width]  # at most `width` numbers
    size = F.octet_length(F.concat_ws(" ", "gram")) + F.octet_length(F.concat_ws(",", "items")) + 16 * (F.size("gram") + F.size("items") + 4)
    small = (index.agg(F.sum(size.cast("long"))).first()[0] or 0) <= MAX_BROADCAST_BYTES
    known = index.select(F.col("h").alias("known_h"), "gram", "items")
    d = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_hash"), words(F.col(text_col)).alias("w"))
    d = d.withColumn("i", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("w") - lengths[-1] + 1))))
    d = d.withColumn("n", F.lit(lengths[0]))
    if len(lengths) > 1:
        d = d.withColumn("n", F.explode(F.array(*[F.lit(n) for n in lengths])))
        d = d.where(F.when(F.col("i") == 0, F.col("n") == lengths[0]).otherwise(F.col("i") + F.col("n") - 1 <= F.size("w")))
    own = F.slice("w", F.col("i"), F.col("n"))
    d = d.withColumn("h", F.when(F.col("i") > 0, gram_hash(F.col("w"), F.col("i") - 1, F.col("n"), width)))
    n_words = F.when(F.col("i") == 0, F.size("w"))
    if small:
        known = F.broadcast(known)
        d = d.withColumn("n_words", n_words)
    else:  # the rows shuffle: with the words of their window, not with the text
        d = d.select("doc_id", "text_hash", "i", "n", "h", n_words.alias("n_words"), F.when(F.col("i") > 0, own).alias("own"))
        own = F.col("own")
    # A hash that agrees is no hit yet: the words must.
    j = d.join(known, (F.col("h") == F.col("known_h")) & F.when(F.col("i") > 0, own == F.col("gram")), "left")
    j = j.where((F.col("i") == 0) | F.col("items").isNotNull())
    span = F.when(F.col("i") > 0, F.struct((F.col("i") - 1).alias("lo"), (F.col("i") - 1 + F.col("n")).alias("hi")))
    return j.groupBy("doc_id", "text_hash").agg(
        F.count("n_words").alias("copies"), F.max("n_words").cast("long").alias("n_words"),
        F.sort_array(F.collect_set(span)).alias("spans"), F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))


def covered(spans: Column) -> Column:
    """Sorted spans folded into disjoint ones."""
    empty = F.array().cast("array<struct<lo:int,hi:int>>")

    def fold(done, s):
        last = F.element_at(done, -1)
        joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last["lo"].alias("lo"), F.greatest(last["hi"], s["hi"]).alias("hi"))))
        return F.when((F.size(done) > 0) & (F.get(done, F.size(done) - 1)["hi"] >= s["lo"]), joined).otherwise(F.concat(done, F.array(s)))

    return F.aggregate(spans, empty, fold)


def find_hits(docs: DataFrame, index: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, spans, items): the documents that hold windows of
    the index, as sorted disjoint spans (start, end) of word positions."""
    hit = scanned(docs, index, width, id_col, text_col).where(F.size("spans") > 0)
    return hit.select("doc_id", "text_hash", covered(F.col("spans")).alias("spans"), "items")


def with_hits(docs: DataFrame, hits: DataFrame) -> DataFrame:
    """``docs`` with the columns _spans and _items (null where clean)."""
    d, h = docs.withColumn("_text_hash", F.xxhash64("text")).alias("d"), hits.alias("h")
    on = F.col("d.doc_id").eqNullSafe(F.col("h.doc_id")) & F.col("d._text_hash").eqNullSafe(F.col("h.text_hash"))
    return d.join(h, on, "left").select("d.*", F.col("h.spans").alias("_spans"), F.col("h.items").alias("_items")).drop("_text_hash")


def report(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """One row per document: words, words hit, items found, verdict."""
    d = scanned(docs, window_index(benchmark, width), width)
    n_hit = F.aggregate(covered(F.col("spans")), F.lit(0).cast("long"), lambda a, s: a + s["hi"] - s["lo"])
    d = d.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                 F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), "copies")
    d = d.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))  # repeated rows: each one
    return d.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", (F.col("n_hit") > 0).alias("contaminated"))


def remove_documents(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """``docs`` without the contaminated ones."""
    return with_hits(docs, find_hits(docs, window_index(benchmark, width), width)).where(F.col("_spans").isNull()).select(*docs.columns)


def remove_spans(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """``docs`` where contaminated texts lose the words hit; what is left of
    such a text is its lower-cased other words, joined by blanks."""
    d = with_hits(docs, find_hits(docs, window_index(benchmark, width), width))
    kept = F.filter(words(F.col("text")), lambda w, i: ~F.exists("_spans", lambda s: (s["lo"] <= i) & (i < s["hi"])))
    text = F.when(F.col("_spans").isNull(), F.col("text")).otherwise(F.concat_ws(" ", kept))
    return d.select(*[text.alias(c) if c == "text" else F.col(c) for c in docs.columns])
