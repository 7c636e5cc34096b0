"""Connected components by alternating large and small stars (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeweave.llm.common import forget, materialize


def _with_least(edges: DataFrame) -> DataFrame:
    """edges(u, v) with m, the least of u and all its v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return edges.join(least, "u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    starred = _with_least(down)
    return starred.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()


def components(edges: DataFrame, label: str = "components", rounds: int = 60) -> DataFrame:
    """u, v: each node that has an edge to another (columns u, v), and the least node it is connected with; the least itself has no row.

    Edges stay distributed; each round is written to the shared folder, so its lineage ends there.
    """
    known = materialize(edges.where("u <> v").select("u", "v").distinct(), label)
    state = None
    for _ in range(rounds):
        before, known = known, materialize(_small_star(_large_star(known)), label)
        forget(before)
        now = known.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == state:
            return known
        state = tuple(now)
    raise RuntimeError("components did not settle")
