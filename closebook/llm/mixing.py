"""Mixing sources to target weights [native].

Each source's documents, in a fixed pseudorandom order, are packed end to end
into blocks of ``block`` words.  A source gets as many output slots as its
target has blocks.  Every slot is dealt to an output shard by a hash, so the
source counts of each shard are one multinomial draw given the sources'
totals; slot j of a source maps to the block ``perm_epoch(j mod n)`` through a
swap-or-not permutation of the block indices, and blocks are joined by index.
A full pass over a source is one epoch; at most two epochs are ever used.

Defined results.  Null or empty text: size 0, nothing taken.  Null source:
its own source, last in order.  Sources without words: target 0.  Repeated
rows: each is a document of its own.  Empty table: no rows.  Weights repeat
in the code point order of the sources.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from closebook.llm.common import SPACE, WORD, bucket_count, stored, with_prefix

WEIGHTS = (5, 2, 1)
BLOCK = 128
ROUNDS = 16
SHARD_BLOCKS = 1024
MAX_TASKS = 10_000


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, text_hash, size): size counts the words of the text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", "source", F.xxhash64("text").alias("text_hash"),
                       F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"))


def source_targets(sizes: DataFrame, share: float = 1.5, cap: float = 2.0,
                   weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, weight, target): weights by code point order,
    ``share`` of all words split by weight, no target above ``cap`` times its
    source; the excess goes to the others by weight.

    Closed form of the repeated resharing: sources by rising cap/weight are
    capped from the front, and the level is the first at which the next
    source's cap is no longer reached.  One row per source.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                        ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    w = by_source.withColumn("weight", pick)
    up = Window.partitionBy(F.lit(0)).orderBy(F.col("source_size") / F.col("weight"),
                                              F.col("source").asc_nulls_last())
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    after = up.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = up.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    w = (w.withColumn("_all", F.sum("source_size").over(whole) * F.lit(share))
          .withColumn("_capped", F.coalesce(F.sum("source_size").over(before), F.lit(0)) * F.lit(cap))
          .withColumn("_level", (F.col("_all") - F.col("_capped")) / F.sum("weight").over(after))
          .withColumn("_free", F.col("source_size") * F.lit(cap) >= F.col("_level") * F.col("weight")))
    level = F.min(F.when(F.col("_free"), F.struct(F.row_number().over(up).alias("n"), "_level"))).over(whole)
    w = w.withColumn("_level", level["_level"])
    target = F.least(F.col("source_size") * F.lit(cap), F.col("_level") * F.col("weight"))
    return w.select("source", "source_size", "weight",
                    F.coalesce(target, F.col("source_size") * F.lit(cap)).alias("target"))


def permuted(index: Column, n: Column, keys: list[Column], rounds: int = ROUNDS) -> Column:
    """The image of ``index`` (0 … n-1) under a keyed swap-or-not permutation
    of 0 … n-1; ``keys`` select the permutation.

    Round r pairs x with (k_r - x) mod n and swaps the two or not by one bit
    of a hash of the pair's greater member, hence every round is a bijection.
    """

    def turn(x, r):
        other = F.pmod(F.pmod(F.xxhash64(r, *keys), n) - x, n)
        return F.when(F.xxhash64(r + rounds, *keys, F.greatest(other, x)) % 2 == 0, other).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), index, turn)


def draw_slots(targets: DataFrame, block: int = BLOCK, seed: int = 7, shard_blocks: int = SHARD_BLOCKS) -> DataFrame:
    """(source, epoch, block, take, out_shard): every slot of the mixture.

    ``take`` is the number of words used of the block: all of them, but for
    the last slot of a source, which ends where the target ends.  A source's
    slots are made in pieces of 8,192, so that a large source is not made by
    one task.
    """
    piece = 8192
    words = F.round("target").cast("long")
    t = targets.where("source_size > 0").select(
        "source", "source_size", F.ceil(F.col("source_size") / block).cast("long").alias("n_blocks"), words.alias("_words"))
    t = t.withColumn("_full", F.least(F.expr("_words div source_size"), F.lit(2)))
    t = t.withColumn("_rest", F.when(F.col("_full") < 2, F.col("_words") - F.col("_full") * F.col("source_size")).otherwise(F.lit(0)))
    t = t.withColumn("_slots", F.col("_full") * F.col("n_blocks") + F.ceil(F.col("_rest") / block).cast("long")).where("_slots > 0")
    total = Window.partitionBy(F.lit(0))
    t = t.withColumn("_shards", F.ceil(F.sum("_slots").over(total) / shard_blocks).cast("long"))
    t = t.withColumn("_piece", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(_slots - 1) div {piece}"))))
    n = t.count()  # pieces, not slots: the number of tasks that make them
    t = t.repartition(max(1, min(n, MAX_TASKS)), F.col("source"), F.col("_piece"))
    t = t.withColumn("_j", F.explode(F.sequence(F.col("_piece") * piece,
                                                F.least(F.col("_slots"), (F.col("_piece") + 1) * piece) - 1)))
    t = t.withColumn("epoch", F.expr("_j div n_blocks").cast("int")).withColumn("block", F.col("_j") % F.col("n_blocks"))
    last = (F.col("_j") == F.col("_slots") - 1) & (F.col("_rest") > 0)
    t = t.withColumn("take", F.when(last, F.col("_rest") - (F.ceil(F.col("_rest") / block) - 1) * block).otherwise(F.lit(block)).cast("long"))
    t = t.withColumn("out_shard", F.pmod(F.xxhash64(F.lit(seed), "source", "_j"), F.col("_shards")))
    image = permuted(F.col("block"), F.col("n_blocks"), [F.lit(seed), F.col("source"), F.col("epoch")])
    return t.select("source", "epoch", image.alias("block"), "take", "out_shard")


def pack(sizes: DataFrame, block: int = BLOCK) -> DataFrame:
    """(doc_id, source, text_hash, size, at, block, lo, first, words): the
    part of each document that lies in each block of its source."""
    rows = sizes.count()
    nb = bucket_count(rows, 2_000)
    mixed = F.xxhash64(F.lit(11), F.col("doc_id"), F.col("text_hash"))
    s = sizes.withColumn("_bucket", F.pmod(mixed, F.lit(nb)))
    s = with_prefix(s, ["source"], "_bucket", [mixed, F.col("doc_id"), F.col("text_hash"), F.col("size")],
                    F.col("size"), "at").drop("_bucket").where("size > 0")
    s = s.withColumn("block", F.explode(F.sequence(F.expr(f"at div {block}"), F.expr(f"(at + size - 1) div {block}"))))
    lo = F.greatest(F.col("at"), F.col("block") * block)
    hi = F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * block)
    return s.select("*", (lo - F.col("block") * block).alias("lo"), (lo - F.col("at")).alias("first"), (hi - lo).alias("words"))


def drawn_spans(sizes: DataFrame, targets: DataFrame, block: int = BLOCK, seed: int = 7) -> DataFrame:
    """(doc_id, source, text_hash, size, at, epoch, out_shard, first, words):
    the word spans of documents that the mixture takes."""
    # Both sides grow with the words; the planner takes the slots, made from a
    # row per source, for small and must not broadcast them.
    p, d = pack(sizes, block).alias("p"), draw_slots(targets, block, seed).hint("shuffle_merge").alias("d")
    used = F.least(F.col("p.words"), F.greatest(F.lit(0), F.col("d.take") - F.col("p.lo")))
    return (p.join(d, F.col("p.source").eqNullSafe(F.col("d.source")) & (F.col("p.block") == F.col("d.block")))
            .select("p.doc_id", "p.source", "p.text_hash", "p.size", "p.at", "d.epoch", "d.out_shard", "p.first",
                    used.alias("words")).where("words > 0"))


def mix_report(docs: DataFrame, block: int = BLOCK, seed: int = 7) -> DataFrame:
    """One row per document: its words, its source's size and target, the
    words that the mixture takes of it."""
    sizes = stored(sized(docs), "mix-sizes")
    targets = stored(source_targets(sizes), "mix-targets")
    key = ["doc_id", "source", "text_hash", "size"]
    spans = drawn_spans(sizes, targets, block, seed).groupBy(*key).agg(F.sum("words").alias("_taken"))
    copies = sizes.groupBy(*key).agg(F.count(F.lit(1)).alias("_copies"))
    same = [F.col(f"s.{k}").eqNullSafe(F.col(f"k.{k}")) for k in key]
    # Repeated rows share the words taken of them: the first ones get the odd words.
    taken = (copies.alias("s").join(spans.alias("k"), same, "left")
             .select("s.*", F.coalesce("_taken", F.lit(0)).cast("long").alias("_taken"))
             .withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_copies") - 1)))
             .withColumn("taken", F.expr("_taken div _copies + if(_copy < _taken % _copies, 1, 0)")))
    out = taken.alias("a").join(F.broadcast(targets).alias("t") if targets.count() <= 100_000 else targets.alias("t"),
                                F.col("a.source").eqNullSafe(F.col("t.source")))
    return out.select("a.doc_id", "a.size", "t.source_size", "t.target", "a.taken", "a.source", "t.weight")


def mix_documents(docs: DataFrame, block: int = BLOCK, seed: int = 7) -> DataFrame:
    """The mixture as documents: one row per document and epoch with the
    words taken of it (the text itself where all are taken, else the taken
    words joined by blanks); columns of ``docs``, ``n_chars`` made anew."""
    sizes = stored(sized(docs), "mix-sizes")
    targets = stored(source_targets(sizes), "mix-targets")
    key = ["doc_id", "source", "text_hash", "size"]
    spans = (drawn_spans(sizes, targets, block, seed).groupBy(*key, "at", "epoch")
             .agg(F.sort_array(F.collect_list(F.struct("first", "words"))).alias("_spans"), F.sum("words").alias("_taken")))
    # The rank pairs the copies of a repeated row with their own spans.
    each = Window.partitionBy("doc_id", "source", "text_hash")
    spans = spans.withColumn("_copy", F.dense_rank().over(each.orderBy("at")))
    d = docs.withColumn("text_hash", F.xxhash64("text")).withColumn("_copy", F.row_number().over(each.orderBy(F.lit(0))))
    on = [F.col(f"d.{k}").eqNullSafe(F.col(f"s.{k}")) for k in ("doc_id", "source", "text_hash", "_copy")]
    both = d.alias("d").join(spans.alias("s"), on)
    words = F.filter(F.split(F.col("d.text"), SPACE), lambda w: w != "")
    cut = F.concat_ws(" ", F.flatten(F.transform(F.col("s._spans"), lambda s: F.slice(words, (s["first"] + 1).cast("int"), s["words"].cast("int")))))
    text = F.when(F.col("s._taken") == F.col("s.size"), F.col("d.text")).otherwise(cut)
    picked = {"text": text, "n_chars": F.char_length(text).cast("long")}
    return both.select(*[picked.get(c, F.col(f"d.{c}")).alias(c) for c in docs.columns])
