"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clientlens.llm.common import written


def _stars(links: DataFrame, large: bool) -> DataFrame:
    """Tie every vertex's larger (or smaller) neighbours to its smallest neighbour."""
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if large:
        near = both
        kept = F.col("b") > F.col("a")
    else:
        near = both.where("b < a")
        kept = F.lit(True)
    least = near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    tied = near.join(least, "a").where(kept & (F.col("b") != F.col("m"))).select(F.col("b").alias("a"), F.col("m").alias("b"))
    if not large:
        tied = tied.union(least.select("a", F.col("m").alias("b")))
    return tied.where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(a, root) for every vertex of the links (a, b): root is the smallest vertex reachable.

    Alternating large-star and small-star steps; the number of rounds grows with
    the logarithm of the longest chain. Each round is written to the shared
    folder, so nothing is recomputed after a lost executor.
    """
    now = written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                  .where("a <> b").distinct(), "links")
    seen = None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(state) == seen or not state[0]:
            break
        seen = tuple(state)
        now = written(_stars(_stars(now, large=True), large=False), "links")
    return now.select("a", F.col("b").alias("root")).union(now.select(F.col("b").alias("a"), F.col("b").alias("root"))).distinct()
