"""Connected components of a link table, by alternating large-star and
small-star steps (Kiveris et al., 2014).

Each step is a group-by with a minimum and a join: no neighbourhood and no
component is ever gathered in one place.  Every round is written to the shared
folder, and ends when a round changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from closebook.llm.common import stored


def _lowest(sym: DataFrame) -> DataFrame:
    return sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    sym = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return sym.join(_lowest(sym), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = _lowest(down)
    far = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return far.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame, most: int = 60) -> DataFrame:
    """(u, root) of every linked node: root is the lowest node that links reach."""
    edges = stored(links.select("u", "v").where("u <> v").distinct(), "links")
    was = _state(edges)
    for _ in range(most):
        if not was[0]:
            break
        edges = stored(_small_star(_large_star(edges)), "links")
        now = _state(edges)
        if now == was:
            break
        was = now
    else:
        raise RuntimeError(f"components did not settle in {most} rounds")
    star = edges.select("u", F.col("v").alias("root"))
    return star.unionByName(star.select(F.col("root").alias("u"), "root").distinct())
