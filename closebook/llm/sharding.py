"""Sharding by fixed virtual slots [native].

Every record is hashed by its id into one of ``n_slots`` virtual slots that
never change.  The bytes of each slot are summed, and a slot-to-shard map —
a table of ``n_slots`` rows per version — says which shard holds a slot.
Rebalancing or growing writes a new version that moves as few slots as it can.

Law: ``bytes`` — the map is fitted to the slots' bytes, largest slot first to
the lightest shard, so the shards' bytes are near equal.

Defined results.  Null text: no bytes, size 1, checksum 0.  Empty text: size
1.  Null id: hashed like a value, all such rows share a slot.  Repeated rows:
each has its own position.  Empty table: no rows, and every slot weighs 0.
Extra columns are ignored (the operator picks the two columns it needs).
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from closebook.llm.common import bucket_count, stored, with_prefix

N_SLOTS = 4096
MAP_SCHEMA = "version int, virtual_slot int, shard int, moved_from int"


def assign_slots(docs: DataFrame, n_slots: int = N_SLOTS, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, virtual_slot) of every record."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
        F.pmod(F.xxhash64(F.col(id_col)), F.lit(n_slots)).cast("int").alias("virtual_slot"))


def slot_bytes(slotted: DataFrame) -> dict[int, int]:
    """Bytes by slot: at most ``n_slots`` rows reach the driver, at any input size."""
    return {r[0]: r[1] for r in slotted.groupBy("virtual_slot").agg(F.sum("size")).collect()}


def first_map(weights: dict[int, int], n_shards: int, n_slots: int = N_SLOTS) -> list[tuple]:
    """Version 0: slots by falling bytes, each to the shard with the fewest bytes."""
    heap = [(0, s) for s in range(n_shards)]
    out = []
    for slot in sorted(range(n_slots), key=lambda v: (-weights.get(v, 0), v)):
        load, shard = heapq.heappop(heap)
        out.append((0, slot, shard, None))
        heapq.heappush(heap, (load + weights.get(slot, 0), shard))
    return sorted(out, key=lambda r: r[1])


def rebalanced(rows: list[tuple], weights: dict[int, int], n_shards: int, slack: float = 0.01) -> list[tuple]:
    """The next version of a map: slots leave shards above the mean by more
    than ``slack`` for the lightest shard, others stay where they are.

    With a greater ``n_shards`` the new shards are empty and receive; slots of
    shards that no longer exist move as well.
    """
    version = max(r[0] for r in rows) + 1
    held: dict[int, list[int]] = {s: [] for s in range(n_shards)}
    homeless = []
    for _, slot, shard, _ in rows:
        (held[shard] if shard in held else homeless).append(slot)
    was = {slot: shard for _, slot, shard, _ in rows}
    load = {s: sum(weights.get(v, 0) for v in slots) for s, slots in held.items()}
    mean = sum(weights.values()) / n_shards
    for s, slots in held.items():
        if load[s] <= mean * (1 + slack):
            continue
        for slot in sorted(slots, key=lambda v: (-weights.get(v, 0), v)):
            w = weights.get(slot, 0)
            if w and load[s] - w >= mean:
                homeless.append(slot)
                load[s] -= w
    left = set(homeless)
    now = {slot: s for s, slots in held.items() for slot in slots if slot not in left}
    heap = [(load[s], s) for s in held]
    heapq.heapify(heap)
    for slot in sorted(left, key=lambda v: (-weights.get(v, 0), v)):
        lightest, s = heapq.heappop(heap)
        now[slot] = s
        heapq.heappush(heap, (lightest + weights.get(slot, 0), s))
    return [(version, v, s, was[v] if was[v] != s else None) for v, s in sorted(now.items())]


def save_map(spark: SparkSession, rows: list[tuple], path: str) -> DataFrame:
    """Append one version to the stored map table; returns that version."""
    df = spark.createDataFrame(rows, MAP_SCHEMA).coalesce(1)
    df.write.mode("append").parquet(path)
    return load_map(spark, path, rows[0][0])


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    table = spark.read.schema(MAP_SCHEMA).parquet(path)
    if version is None:
        version = table.agg(F.max("version")).first()[0]
    return table.where(F.col("version") == version)


def place(slotted: DataFrame, slot_map: DataFrame, per_bucket: int = 20_000) -> DataFrame:
    """Shard of every record and its gapless position ``slot`` in the shard.

    The map has one row per virtual slot (a fixed number), hence the
    broadcast.  Positions are counted inside (virtual slot, sub-bucket) groups
    of about ``per_bucket`` rows or fewer and shifted by the counts before.
    """
    rows = slotted.count()
    subs = bucket_count(rows, per_bucket * N_SLOTS)
    placed = slotted.join(F.broadcast(slot_map.select("virtual_slot", "shard")), "virtual_slot")
    placed = placed.withColumn("_bucket", F.col("virtual_slot").cast("long") * subs
                               + F.pmod(F.xxhash64("text_crc32", "doc_id"), F.lit(subs)))
    return with_prefix(placed, ["shard"], "_bucket", [F.col("doc_id"), F.col("text_crc32")],
                       F.lit(1), "slot").drop("_bucket")


def shard_documents(docs: DataFrame, n_shards: int = 16, n_slots: int = N_SLOTS,
                    map_path: str | None = None) -> DataFrame:
    """All records with size, checksum, virtual slot, shard and position.

    The text is read once; what follows works on four short columns that are
    written to the shared folder.
    """
    from closebook.llm.common import shared_dir

    slotted = stored(assign_slots(docs, n_slots), "slots")
    rows = first_map(slot_bytes(slotted), n_shards, n_slots)
    slot_map = save_map(docs.sparkSession, rows, map_path or shared_dir(docs.sparkSession, "slot-map"))
    return place(slotted, slot_map)
