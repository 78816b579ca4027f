"""Merkle dataset manifest by time-forward processing.

Every row is a leaf: the SHA-256 of its column values.  The leaves of a group
(``lang``) ascend by id; runs of ``FANOUT`` consecutive nodes become their
parent until one node, the subroot, remains.  The subroots, in the order of
their groups, make the root the same way.

Time-forward processing: a node's label is (level, index), children come before
their parents, and a priority queue ordered by label delivers the digests of
children to the parent, which sends its own digest on.  The queue is external:
the labels are dealt in blocks of ``FANOUT ** BLOCK_LEVELS`` consecutive nodes,
Spark's sorted, spilling shuffle carries the digests from one block of levels to
the next, and inside a block a heap of at most that many entries does the same.
The reversed sweep walks the same blocks from the root down: a queue of falling
labels delivers to every node the siblings of all its ancestors (its proof
suffix), so a leaf gets its proof with one row per block moved.

No task holds more than one block.  Rounds grow with the logarithm of the rows.

Defined results.  Null values: ``-`` in the leaf; a null group is the first
group; a null id comes first in its group.  Rows of one group and id are ordered
by their leaf, so repeated rows are leaves side by side.  Empty text: ``0:``.
Empty table: no rows, no root.  A lone leaf is its subroot, a lone subroot the
root; its proof is the digest of nothing.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from closebook.llm.common import stored

FANOUT = 2
#: Levels of the tree that one block spans: 256 leaves.
BLOCK_LEVELS = 8
LEAF_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value: Column) -> Column:
    """A value as the leaf holds it: UTF-8 byte count, colon, value; ``-`` if null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(columns: list[Column]) -> Column:
    return F.sha2(F.concat(*[field(c) for c in columns]).cast("binary"), 256)


def group_key(group: Column) -> Column:
    """A key that is never null and sorts like the group: null first, then UTF-8 bytewise."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))


def with_positions(leaves: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``leaves`` with ``pos``, the rank in the group.

    Rows are dealt by ranges of (group, order), so a group of any share spans
    many tasks; positions inside a range come from a window over (range,
    group), and the counts of the ranges before are added.
    """
    dealt = stored(leaves.repartitionByRange(*[F.col(c) for c in [group, *order]]).withColumn("_part", F.spark_partition_id()), "merkle-leaves")
    sizes = dealt.groupBy(group, "_part").agg(F.count("*").alias("_n"))
    starts = sizes.select(group, "_part", F.coalesce(F.sum("_n").over(
        Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy(group, "_part").orderBy(*order)) - 1
    return (dealt.withColumn("_inside", inside).join(starts, [group, "_part"])
            .withColumn("pos", (F.col("_inside") + F.col("_start")).cast("long")).drop("_inside", "_start", "_part"))


def levels_of(n: int, fanout: int = FANOUT) -> int:
    """Levels above the leaves of a tree of ``n`` leaves."""
    levels = 0
    while n > 1:
        n, levels = -(-n // fanout), levels + 1
    return levels


def sweep_up(digests: list[str], levels: int, fanout: int = FANOUT) -> list[list[str]]:
    """The nodes of a block, level by level, by time-forward processing: the
    queue hands out messages (label of the parent, place, digest) by rising
    label, and a parent is done once no message for it is left."""
    nodes: list[list[str]] = [digests]
    if not levels:
        return nodes
    queue = [(1, i // fanout, i, d) for i, d in enumerate(digests)]  # sorted, hence a heap
    while queue:
        level, index = queue[0][:2]
        parts = []
        while queue and queue[0][:2] == (level, index):
            parts.append(heapq.heappop(queue)[3])
        own = digest(*parts)
        if len(nodes) == level:
            nodes.append([])
        nodes[level].append(own)
        if level < levels:
            heapq.heappush(queue, (level + 1, index // fanout, index, own))
    return nodes


def sweep_down(nodes: list[list[str]], suffix: list[str], fanout: int = FANOUT) -> list[list[str]]:
    """The proof of every leaf of a block.  The queue hands out suffixes by
    falling label; a node passes its own on to its children, each with the
    other digests of their run in front.  A step of a proof is one text: the
    digests of the run from left to right, a dot for the node itself."""
    proofs: list[list[str]] = [[] for _ in nodes[0]]
    queue = [(-(len(nodes) - 1), 0, suffix)]
    while queue:
        level, index, own = heapq.heappop(queue)
        level, index = -level, -index
        if level == 0:
            proofs[index] = own
            continue
        run = range(index * fanout, min((index + 1) * fanout, len(nodes[level - 1])))
        for child in run:
            step = "".join("." if i == child else nodes[level - 1][i] for i in run)
            heapq.heappush(queue, (-(level - 1), -child, [step, *own]))
    return proofs


def proof_digest(proof: list[str]) -> str:
    """H of all sibling digests of a proof, from the leaf to the root."""
    return digest(*[step.replace(".", "") for step in proof])


def folded(leaf: str, proof: list[str]) -> str:
    """The root that a leaf and a proof give."""
    for step in proof:
        leaf = digest(step.replace(".", leaf))
    return leaf


_NODE = "g string, pos long, digest string"
_SUFFIX = "g string, pos long, suffix array<string>"


def _ordered(table: pa.Table) -> tuple[str, int, int, pa.Table]:
    """Group, levels above the block's own level, block number and rows in order."""
    table = table.sort_by("pos")
    return table["g"][0].as_py(), table["levels"][0].as_py(), table["block"][0].as_py(), table


def _raise(fanout: int) -> Callable[[pa.Table], pa.Table]:
    def up(table: pa.Table) -> pa.Table:
        g, levels, block, rows = _ordered(table)
        top = sweep_up(rows["digest"].to_pylist(), levels, fanout)[-1][0]
        return pa.table({"g": [g], "pos": pa.array([block], pa.int64()), "digest": [top]})

    return up


def _lower(fanout: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def down(table: pa.Table, suffix: pa.Table) -> pa.Table:
        g, levels, _, rows = _ordered(table)
        nodes = sweep_up(rows["digest"].to_pylist(), levels, fanout)
        proofs = sweep_down(nodes, suffix["suffix"][0].as_py(), fanout)
        return pa.table({"g": [g] * len(rows), "pos": rows["pos"], "suffix": pa.array(proofs, pa.list_(pa.string()))})

    return down


def _blocks(nodes: DataFrame, counts: DataFrame, done: int, block_levels: int, fanout: int) -> DataFrame:
    """Nodes of level ``done`` with their block and the levels that it spans;
    ``counts`` has one row per group."""
    left = F.greatest(F.least(F.col("top") - done, F.lit(block_levels)), F.lit(0)).cast("int")
    return (nodes.join(counts.select("g", "top"), "g").withColumn("levels", left).drop("top")
            .withColumn("block", F.expr(f"pos div {fanout ** block_levels}")))


class Tree:
    """The rounds of all groups: ``nodes[r]`` holds the nodes at level
    ``r * block_levels``; a group that is done keeps its subroot through the
    later rounds."""

    def __init__(self, leaves: DataFrame, fanout: int = FANOUT, block_levels: int = BLOCK_LEVELS):
        self.fanout, self.block_levels = fanout, block_levels
        top = F.udf(lambda n: levels_of(n, fanout), "int")  # once per group
        self.counts = stored(leaves.groupBy("g").agg(F.count("*").alias("n")).withColumn("top", top("n")), "merkle-counts")
        most = self.counts.agg(F.max("top")).first()[0] or 0
        self.rounds = max(1, -(-most // block_levels))
        self.nodes = [leaves]
        for r in range(self.rounds):
            self.nodes.append(stored(self.blocks(r).groupBy("g", "block").applyInArrow(_raise(fanout), _NODE), "merkle-nodes"))

    def blocks(self, r: int) -> DataFrame:
        return _blocks(self.nodes[r].select("g", "pos", "digest"), self.counts, r * self.block_levels, self.block_levels, self.fanout)

    def top(self) -> DataFrame:
        """(g, digest): one row per group."""
        return self.nodes[-1].select("g", "digest")

    def suffixes(self, of_top: DataFrame) -> DataFrame:
        """(g, block, suffix) of the lowest blocks, from the suffix of every group."""
        suffix = of_top.select("g", F.lit(0).cast("long").alias("block"), "suffix")
        for r in range(self.rounds - 1, 0, -1):
            grouped = self.blocks(r).groupBy("g", "block")
            suffix = stored(grouped.cogroup(suffix.groupBy("g", "block")).applyInArrow(_lower(self.fanout), _SUFFIX)
                            .withColumnRenamed("pos", "block"), "merkle-suffixes")
        return suffix


_PROVEN = ("doc_id long, g string, pos long, leaf string, subroot string, root string, proof array<string>, "
           "folded_root string")


def manifest(docs: DataFrame, tampered: Column | None = None, columns: tuple[str, ...] = LEAF_COLUMNS, id_col: str = "doc_id",
             group_col: str = "lang", changed: dict[str, Column] | None = None, fanout: int = FANOUT,
             block_levels: int = BLOCK_LEVELS) -> DataFrame:
    """One row per row of ``docs``: id, group key, position, leaf, subroot, root,
    proof (a text per level, a dot where the node itself goes) and the root that
    the row at hand folds to with its proof.

    ``tampered`` and ``changed`` (column -> its value at hand) describe rows whose
    content is checked against the manifest of ``docs``; without them every row
    is checked as it is.
    """
    own = [F.col(c) for c in columns]
    leaf = leaf_digest(own)
    seen = F.lit(None).cast("string")
    if tampered is not None:
        seen = F.when(tampered, leaf_digest([(changed or {}).get(c, F.col(c)) for c in columns]))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), group_key(F.col(group_col)).alias("g"),
                       leaf.alias("digest"), seen.alias("seen"))
    rows = stored(with_positions(rows, "g", ["doc_id", "digest"]), "merkle-positions")
    tree = Tree(rows, fanout, block_levels)
    roots = stored(with_positions(tree.top().withColumn("of", F.col("g")).withColumn("g", F.lit("")), "g", ["of"]), "merkle-subroots")
    upper = Tree(roots, fanout, block_levels)
    proven = upper.blocks(0).groupBy("g", "block").cogroup(
        upper.suffixes(upper.top().select("g", F.array().cast("array<string>").alias("suffix"))).groupBy("g", "block")).applyInArrow(
            _lower(fanout), _SUFFIX)
    root = upper.top().select(F.col("digest").alias("root"))
    of_top = stored(roots.join(proven.select("pos", "suffix"), "pos").join(F.broadcast(root))  # one row
                    .select(F.col("of").alias("g"), "suffix", F.col("digest").alias("subroot"), "root"), "merkle-tops")

    def prove(table: pa.Table, suffix: pa.Table) -> pa.Table:
        g, levels, _, part = _ordered(table)
        digests, top = part["digest"].to_pylist(), (part["subroot"][0], part["root"][0])
        proofs = sweep_down(sweep_up(digests, levels, fanout), suffix["suffix"][0].as_py(), fanout)
        at_hand = [s or d for s, d in zip(part["seen"].to_pylist(), digests, strict=True)]
        n = len(part)
        return pa.table({"doc_id": part["doc_id"], "g": [g] * n, "pos": part["pos"], "leaf": digests, "subroot": pa.repeat(top[0], n),
                         "root": pa.repeat(top[1], n), "proof": pa.array(proofs, pa.list_(pa.string())),
                         "folded_root": [folded(x, p) for x, p in zip(at_hand, proofs, strict=True)]})

    low = _blocks(rows, tree.counts, 0, block_levels, fanout).join(of_top.select("g", "subroot", "root"), "g")
    return low.groupBy("g", "block").cogroup(tree.suffixes(of_top).groupBy("g", "block")).applyInArrow(prove, _PROVEN)


def report(docs: DataFrame) -> DataFrame:
    """Proofs of all rows, with n_chars changed on the rows whose id's CRC32 is
    divisible by 7."""
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    m = manifest(docs, tampered, changed={"n_chars": F.col("n_chars") + 1})
    steps = F.transform("proof", lambda s: F.replace(s, F.lit("."), F.lit("")))
    return m.select("doc_id", "leaf", "subroot", "root", F.sha2(F.array_join(steps, "").cast("binary"), 256).alias("proof_sha256"),
                    "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


#: ``report`` as DuckDB SQL: the levels by recursion over all nodes.
ORACLE = r"""WITH RECURSIVE
crc AS (SELECT doc_id, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: ascii(ch)::BIGINT)),
  lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: xor(a >> 1, 3988292384 * (a & 1)))), 4294967295) % 7 = 0 AS tampered
  FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL) i),
f AS (SELECT row_number() OVER () AS rid, doc_id, '' || coalesce('=' || lang, '') AS g, n_chars,
  coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
  coalesce(strlen(text) || ':' || text, '-') AS tail FROM documents),
l AS MATERIALIZED (SELECT rid, f.doc_id, g, sha256(head || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || tail) AS leaf,
  sha256(head || coalesce(strlen(CAST(n_chars + CASE WHEN tampered THEN 1 ELSE 0 END AS VARCHAR)) || ':' || (n_chars + CASE WHEN tampered THEN 1 ELSE 0 END), '-') || tail) AS seen
  FROM f LEFT JOIN (SELECT doc_id AS crc_id, tampered FROM crc) c ON f.doc_id = crc_id),
p AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM l),
t(g, lvl, pos, h, n) AS (SELECT g, 0, pos, leaf, count(*) OVER (PARTITION BY g) FROM p
  UNION ALL SELECT g, lvl + 1, pos // 2, h, n FROM (
    SELECT g, lvl, pos, sha256(h || CASE WHEN pos + 1 < n THEN coalesce(lead(h) OVER (PARTITION BY g, lvl ORDER BY pos), '') ELSE '' END) AS h, (n + 1) // 2 AS n, n AS was FROM t WHERE n > 1) x
  WHERE pos % 2 = 0),
s AS MATERIALIZED (SELECT g, h AS subroot, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n FROM t WHERE n = 1),
u(lvl, pos, h, n) AS (SELECT 0, pos, subroot, n FROM s
  UNION ALL SELECT lvl + 1, pos // 2, h, n FROM (
    SELECT lvl, pos, sha256(h || CASE WHEN pos + 1 < n THEN coalesce(lead(h) OVER (PARTITION BY lvl ORDER BY pos), '') ELSE '' END) AS h, (n + 1) // 2 AS n FROM u WHERE n > 1) x
  WHERE pos % 2 = 0),
a AS (SELECT rid, p.g, t.lvl, p.pos // (1::BIGINT << t.lvl) AS k, t.h AS sib FROM p JOIN t ON t.g = p.g AND t.n > 1
    AND t.pos = xor(p.pos // (1::BIGINT << t.lvl), 1)
  UNION ALL SELECT rid, p.g, 1000 + u.lvl, s.pos // (1::BIGINT << u.lvl), u.h FROM p JOIN s USING (g) JOIN u ON u.n > 1
    AND u.pos = xor(s.pos // (1::BIGINT << u.lvl), 1)),
steps AS (SELECT rid, p.pos, s.pos AS spos, t.lvl FROM p JOIN s USING (g) JOIN (SELECT DISTINCT g, lvl FROM t WHERE n > 1) t ON t.g = p.g
  UNION ALL SELECT rid, p.pos, s.pos, 1000 + lvl FROM p JOIN s USING (g) CROSS JOIN (SELECT DISTINCT lvl FROM u WHERE n > 1) u),
path AS MATERIALIZED (SELECT steps.rid, list(coalesce(sib, '') ORDER BY steps.lvl) AS sibs,
  list((CASE WHEN steps.lvl < 1000 THEN steps.pos // (1::BIGINT << steps.lvl) ELSE spos // (1::BIGINT << (steps.lvl - 1000)) END) % 2 = 1 ORDER BY steps.lvl) AS is_right
  FROM steps LEFT JOIN a ON a.rid = steps.rid AND a.lvl = steps.lvl GROUP BY steps.rid),
r AS (SELECT p.doc_id, p.leaf, s.subroot, (SELECT h FROM u WHERE n = 1) AS root, sha256(coalesce(array_to_string(sibs, ''), '')) AS proof_sha256,
  list_reduce(list_concat([seen], list_transform(range(1, coalesce(len(sibs), 0) + 1), lambda i: CASE WHEN is_right[i] THEN 'R' ELSE 'L' END || sibs[i])),
    lambda h, x: CASE WHEN x[1] = 'R' THEN sha256(x[2:] || h) ELSE sha256(h || x[2:]) END) AS folded_root
  FROM p JOIN s USING (g) LEFT JOIN path USING (rid))
SELECT *, folded_root = root AS verified FROM r"""
