"""Hard-negative mining with Kronecker-packed integer products.

Vectors are quantised to integers.  The components that many candidates have in
one dimension are biased to be non-negative and packed into the fields of one
wide integer; an anchor multiplies each of these integers once by its own biased
component and adds the products up.  Every field then holds the exact inner
product of one candidate, plus the biases, which are taken off again.  Field
widths follow from the largest components at hand, so no field runs over.

The anchors are a stated query set against all rows.  Both sides are dealt in
chunks of bounded size, and a task holds one chunk of each:

1. positives: the products of anchors and rows of the same label, best ``n_pos``;
2. negatives: the products of anchors and rows of other labels that lie in the
   window of one of the anchor's positives, best ``n_neg`` of each.

Each task keeps its own best rows, and ranks over the tasks follow with a limit
before the shuffle.  Every pair is multiplied once, in one of the two passes.

Defined results.  Rows with a null label, a null vector or a null or non-finite
component take no part.  Vectors of different lengths have no product, so they
are compared within their length only; vectors without components all score 0.
Null ids are no anchors and come last among ties.  Rows that repeat an id are
rows of their own: each is an anchor or candidate, never of itself.  Empty
table: no rows.  Extra columns are ignored.  Scores that do not fit 64 bits are
compared exactly and reported as the nearest 64-bit value.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from closebook.llm.common import bucket_count, stored

SCALE = 256
N_POS, N_NEG = 5, 10
#: Share of the positive's score, in per cent, that a negative's score has to lie in.
WINDOW = (30, 90)
CANDIDATES, ANCHORS = 2048, 1024
_INT64 = (-(1 << 63), (1 << 63) - 1)


def quantised(embeddings: DataFrame, scale: int = SCALE, id_col: str = "vec_id", vec_col: str = "embedding",
              label_col: str = "label") -> DataFrame:
    """(row, vec_id, label, vec, dims): the rows that take part; components are
    whole doubles, exact whatever their size."""
    v = F.col(vec_col)
    finite = F.forall(v, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))

    def whole(x):
        scaled = x.cast("double") * scale
        return F.when(F.abs(scaled) < 2.0 ** 53, F.floor(scaled).cast("double")).otherwise(scaled)  # larger doubles are whole

    return (embeddings.where(F.col(label_col).isNotNull() & v.isNotNull() & finite)
            .select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"),
                    F.transform(v, whole).alias("vec"),
                    F.size(v).alias("dims")))


class Pack:
    """Candidates of one label as one wide integer per dimension.

    ``matrix`` is (candidates, dims) of int64, or of Python integers where
    components are larger than that.
    """

    def __init__(self, matrix: np.ndarray, most: int):
        """``most``: the largest component of any anchor, by absolute value."""
        self.n, self.dims = matrix.shape
        self.bias = int(np.abs(matrix).max()) if matrix.size else 0
        self.anchor_bias = most
        bits = (self.dims * 4 * (self.bias or 1) * (most or 1)).bit_length()
        self.width = 4 if bits <= 32 else 8 * -(-bits // 64)  # bytes of a field
        self.sums = matrix.sum(axis=1)
        biased = matrix + self.bias
        if self.width <= 8:
            fields = np.ascontiguousarray(biased.T.astype("<u4" if self.width == 4 else "<u8"))
            self.wide = [int.from_bytes(row.tobytes(), "little") for row in fields]
        else:
            self.wide = [int.from_bytes(b"".join(int(x).to_bytes(self.width, "little") for x in column), "little") for column in biased.T]

    def products(self, anchor: list[int]) -> np.ndarray:
        """The exact inner product of ``anchor`` and every candidate."""
        shift, total = self.anchor_bias, 0
        for wide, a in zip(self.wide, anchor, strict=True):
            total += wide * (a + shift)
        raw = total.to_bytes(self.n * self.width, "little")
        # sum (a + s)(c + b) = sum ac + b * sum a + s * sum c + dims * s * b
        rest = self.bias * sum(anchor) + self.dims * shift * self.bias
        if self.width <= 8:
            fields = np.frombuffer(raw, "<u4" if self.width == 4 else "<u8").astype(np.int64)
            return fields - shift * self.sums - rest
        w = self.width
        fields = np.array([int.from_bytes(raw[i * w:(i + 1) * w], "little") for i in range(self.n)], dtype=object)
        return fields - shift * self.sums - rest


def best(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores, ties by place."""
    if len(scores) > 4 * k:
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    else:
        at = np.arange(len(scores))
    return at[np.argsort(-scores[at], kind="stable")[:k]]


def _matrix(table: pa.Table, dims: int) -> np.ndarray:
    flat = table["vec"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(table), dims)
    if flat.size and np.abs(flat).max() * max(dims, 1) ** 0.5 >= 2.0 ** 29:  # products might leave 62 bits
        return np.array([[int(x) for x in row] for row in flat], dtype=object).reshape(len(table), dims)
    return flat.astype(np.int64)


class Cell:
    """A chunk of anchors and a chunk of candidates of one length; candidates
    in packs, each in the order of their ids (null ids last)."""

    def __init__(self, candidates: pa.Table, anchors: pa.Table, by_label: bool):
        dims = anchors["dims"][0].as_py()
        order = [("vec_id", "ascending"), ("row", "ascending")]
        candidates = candidates.sort_by([("label", "ascending"), *order] if by_label else order)
        self.ids, self.rows = candidates["vec_id"].combine_chunks(), candidates["row"].to_numpy()
        self.labels = candidates["label"].to_numpy()
        self.vectors = [[int(x) for x in v] for v in _matrix(anchors, dims).tolist()]
        most = max((abs(x) for v in self.vectors for x in v), default=0)
        matrix = _matrix(candidates, dims)
        if most >= 1 << 29:
            matrix = matrix.astype(object)
        edges = [0, *(np.flatnonzero(np.diff(self.labels)) + 1).tolist(), len(matrix)] if by_label else [0, len(matrix)]
        self.packs = {int(self.labels[lo]): (lo, Pack(matrix[lo:hi], most)) for lo, hi in zip(edges, edges[1:], strict=False)}

    def found(self, schema: pa.Schema, keys: list[tuple], at: list[np.ndarray], scores: list[np.ndarray]) -> pa.Table:
        """A table of the rows ``at`` with their scores, one key for each array."""
        if not at:
            return schema.empty_table()
        place, score, sizes = np.concatenate(at), np.concatenate(scores), [len(x) for x in at]
        fits = score.dtype != object
        columns = {name: np.repeat([k[i] for k in keys], sizes) for i, name in enumerate(schema.names[:len(keys[0])])}
        columns |= {"id": self.ids.take(pa.array(place)), "row": self.rows[place]}
        columns["exact"] = pa.nulls(len(score), pa.string()) if fits else pa.array(
            [None if _INT64[0] <= x <= _INT64[1] else str(x) for x in score], pa.string())
        columns["score"] = score if fits else [min(max(int(x), _INT64[0]), _INT64[1]) for x in score]
        return pa.table({f.name: pa.array(columns[f.name], f.type) if not isinstance(columns[f.name], pa.Array) else columns[f.name] for f in schema})


_FOUND = [("id", pa.int64()), ("row", pa.int64()), ("exact", pa.string()), ("score", pa.int64())]
_POSITIVE = pa.schema([("anchor", pa.int64()), *_FOUND])
_POSITIVE_DDL = "anchor long, id long, row long, exact string, score long"
_NEGATIVE = pa.schema([("anchor", pa.int64()), ("place", pa.int32()), *_FOUND])
_NEGATIVE_DDL = "anchor long, place int, id long, row long, exact string, score long"


def _positives(n_pos: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def find(candidates: pa.Table, anchors: pa.Table) -> pa.Table:
        if not len(candidates) or not len(anchors):
            return _POSITIVE.empty_table()
        cell = Cell(candidates, anchors, by_label=True)
        keys, places, values = [], [], []
        for row, label, vector in zip(anchors["row"].to_pylist(), anchors["label"].to_pylist(), cell.vectors, strict=True):
            if label not in cell.packs:
                continue
            lo, pack = cell.packs[label]
            scores = pack.products(vector)
            at = best(scores, n_pos + 1)
            at = at[cell.rows[lo + at] != row][:n_pos]
            keys.append((row,))
            places.append(lo + at)
            values.append(scores[at])
        return cell.found(_POSITIVE, keys, places, values)

    return find


def _negatives(n_neg: int, window: tuple[int, int]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    low, high = window

    def find(candidates: pa.Table, anchors: pa.Table) -> pa.Table:
        if not len(candidates) or not len(anchors):
            return _NEGATIVE.empty_table()
        cell = Cell(candidates, anchors, by_label=False)
        (_, pack), = cell.packs.values()
        keys, places, values = [], [], []
        for row, label, positives, vector in zip(anchors["row"].to_pylist(), anchors["label"].to_pylist(),
                                                 anchors["positives"].to_pylist(), cell.vectors, strict=True):
            bounds = [(p["place"], int(p["exact"] or p["score"])) for p in positives]
            bounds = [(place, -(-low * s // 100), high * s // 100) for place, s in bounds]  # least and greatest score allowed
            bounds = [b for b in bounds if b[1] <= b[2]]
            if not bounds:
                continue
            scores = pack.products(vector)
            near = np.flatnonzero((cell.labels != label) & (scores >= min(b[1] for b in bounds)) & (scores <= max(b[2] for b in bounds)))
            inside = scores[near]
            for place, least, most in bounds:
                fit = np.flatnonzero((inside >= least) & (inside <= most))
                at = near[fit[best(inside[fit], n_neg)]]
                keys.append((row, place))
                places.append(at)
                values.append(scores[at])
        return cell.found(_NEGATIVE, keys, places, values)

    return find


def _ranked(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The best ``k`` rows per key.  A score beyond 64 bits has its digits in
    ``exact``: longer positive (negative) numbers are higher (lower)."""
    size, sign = F.length("exact"), F.when(F.col("score") > 0, 1).otherwise(-1)
    beyond = F.coalesce(size * sign, F.lit(0)).desc()
    digits = [F.when(F.col("score") > 0, F.col("exact")).desc_nulls_last(), F.when(F.col("score") < 0, F.col("exact")).asc_nulls_first()]
    order = [F.col("score").desc(), beyond, *digits, F.col("id").asc_nulls_last()]
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return found.withColumn("place_", place).where(F.col("place_") <= k)


def _cells(rows: DataFrame, anchors: DataFrame, sides: tuple[int, int], chunks: tuple[int, int],
           fn: Callable[[pa.Table, pa.Table], pa.Table], ddl: str) -> DataFrame:
    """``fn`` over all cells: candidates are copied once per anchor chunk, and
    anchors once per candidate chunk."""
    n_cand, n_anch = bucket_count(sides[0], chunks[0]), bucket_count(sides[1], chunks[1])
    c = rows.withColumn("c", F.pmod(F.xxhash64("row"), F.lit(n_cand))).withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(n_anch - 1))))
    q = anchors.withColumn("a", F.pmod(F.xxhash64("row"), F.lit(n_anch)).cast("int")).withColumn(
        "c", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_cand - 1).cast("long"))))
    keys = ["dims", "a", "c"]
    return c.groupBy(*keys).cogroup(q.groupBy(*keys)).applyInArrow(fn, ddl)


def mine(rows: DataFrame, is_anchor, n_pos: int = N_POS, n_neg: int = N_NEG, window: tuple[int, int] = WINDOW,
         chunks: tuple[int, int] = (CANDIDATES, ANCHORS)) -> DataFrame:
    """Hard negatives of the anchors among ``rows`` (of ``quantised``).

    ``is_anchor`` is a condition over the rows.  One row per anchor, positive and
    negative; ``rank`` counts from 1 among the negatives of a positive.
    """
    rows = stored(rows, "vectors")
    anchors = rows.where(is_anchor)
    sides = (rows.count(), anchors.count())
    found = stored(_cells(rows, anchors, sides, chunks, _positives(n_pos), _POSITIVE_DDL), "positives")
    positives = stored(_ranked(found, ["anchor"], n_pos).withColumn("place", F.col("place_").cast("int")).drop("place_"), "best-positives")
    # at most n_pos entries per anchor
    lists = positives.groupBy("anchor").agg(F.collect_list(F.struct("place", "exact", "score")).alias("positives"))
    with_pos = stored(anchors.join(lists.withColumnRenamed("anchor", "row"), "row"), "anchors")
    found = stored(_cells(rows, with_pos, sides, chunks, _negatives(n_neg, window), _NEGATIVE_DDL), "negatives")
    top = _ranked(found, ["anchor", "place"], n_neg)
    ids = anchors.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    p = positives.select("anchor", "place", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return (top.select("anchor", "place", F.col("place_").cast("int").alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
            .join(p, ["anchor", "place"]).join(ids, "anchor")
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))


def report(embeddings: DataFrame) -> DataFrame:
    """Anchors: ids divisible by 100; labels of ids divisible by 7 move on by one."""
    rows = quantised(embeddings)
    moved = F.when(F.col("vec_id") % 7 == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label"))
    return mine(rows.withColumn("label", moved), F.coalesce(F.col("vec_id") % 100 == 0, F.lit(False)))


#: ``report`` as DuckDB SQL: all products of anchors and rows.
ORACLE = """WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id,
  CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.r, a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
  CAST(coalesce(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])), 0) AS BIGINT) AS score
  FROM v a, v b WHERE a.vec_id % 100 = 0 AND a.r <> b.r AND len(a.q) = len(b.q)),
p AS (SELECT r, anchor_id, id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY r ORDER BY score DESC, id NULLS LAST) AS place
  FROM s WHERE same QUALIFY place <= 5)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY p.r, p.place ORDER BY s.score DESC, s.id NULLS LAST) AS INTEGER) AS rank,
  s.id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.r = p.r AND NOT s.same AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
QUALIFY rank <= 10"""
