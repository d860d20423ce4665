"""Neighbourhoods and paths over an edge table (src, rel, dst).

Each hop is one join of a set of distinct nodes with the edges; paths are only
spelled out along edges that lie on a shortest one. A hub's edges are split by
AQE's skew join, because the frontier side has one row per node. The edges of a
search are derived and written once, however many hops read them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clientlens.common import small_side
from clientlens.session import cut_lineage

DEFAULT_HOPS = 2


def _level(nodes: DataFrame) -> tuple[DataFrame, int]:
    """A level of the search, written out, and its number of nodes."""
    written = cut_lineage(nodes)
    return written, written.count()


def _step(frontier: DataFrame, size: int, edges: DataFrame) -> DataFrame:
    """Distinct nodes one edge away from the frontier (column ``id``).

    A frontier counted as small is broadcast, so the edges are not shuffled.
    """
    known = small_side(frontier.select(F.col("id").alias("src")), size)
    return edges.join(known, "src", "left_semi").select(F.col("dst").alias("id")).distinct()


def reached_nodes(edges: DataFrame, seeds: DataFrame, max_hops: int = DEFAULT_HOPS) -> tuple[DataFrame, int]:
    """(id, hop) of every node within ``max_hops`` of a seed at its least distance, and their number."""
    frontier, size = _level(seeds.select("id").distinct())
    seen, total = frontier.withColumn("hop", F.lit(0)), size
    for hop in range(1, max_hops + 1):
        known = small_side(seen.select("id"), total)
        frontier, size = _level(_step(frontier, size, edges).join(known, "id", "left_anti"))
        if not size:
            break
        seen, total = seen.unionByName(frontier.withColumn("hop", F.lit(hop))), total + size
    return seen, total


def entity_neighbourhood(nodes: DataFrame, edges: DataFrame, seeds: DataFrame,
                         max_hops: int = DEFAULT_HOPS) -> DataFrame:
    """Entities within ``max_hops`` of the seeds, one row per relationship.

    Relationships stay in rows (null where an entity has none): a hub's list
    could not be held in one.
    """
    edges = cut_lineage(edges.select("src", "rel", "dst"))
    near, total = reached_nodes(edges, seeds, max_hops)
    near = small_side(near, total)
    described = nodes.join(near, "id")
    links = edges.select(F.col("src").alias("id"), F.col("rel").alias("relationship"), F.col("dst").alias("target"))
    links = links.join(near.select("id"), "id", "left_semi").distinct()
    # Entities with and without links are joined apart, so that a hub's links may be split.
    linked = links.join(small_side(described, total), "id")
    alone = described.join(links.select("id").distinct(), "id", "left_anti")
    return linked.unionByName(alone, allowMissingColumns=True).select(
        "id", "type", "properties", "hop", "relationship", "target")


def find_entities(nodes: DataFrame, entity_type: str, query: str) -> DataFrame:
    """Seeds: entities of a type whose name holds the query, ignoring case."""
    return nodes.where((F.col("type") == entity_type)
                       & F.contains(F.lower(F.col("properties")["name"]), F.lit(query.lower()))).select("id")


def find_paths(edges: DataFrame, source: str, target: str, relationship_types: Sequence[str] | None = None,
               max_hops: int = 4) -> DataFrame:
    """All shortest paths from source to target: length, nodes, relationships.

    Levels are searched forward until the target appears, then walked back from
    it, so only edges on a shortest path are ever combined.
    """
    spark = edges.sparkSession
    if relationship_types:
        edges = edges.where(F.col("rel").isin(list(relationship_types)))
    edges = cut_lineage(edges.select("src", "rel", "dst"))
    start = spark.range(1).select(F.lit(source).alias("id"))
    levels = [(start, 1)]
    seen, total = start, 1
    found = source == target
    for _ in range(max_hops):
        if found:
            break
        frontier, size = _level(_step(*levels[-1], edges).join(small_side(seen, total), "id", "left_anti"))
        if not size:
            break
        levels.append((frontier, size))
        seen, total = seen.unionByName(frontier), total + size
        found = not frontier.where(F.col("id") == target).isEmpty()
    paths = spark.range(1 if found else 0).select(
        F.lit(target).alias("head"), F.array(F.lit(target)).alias("nodes"), F.array().cast("array<string>").alias("relationships"))
    if found and source != target:
        # Backwards, each level is cut down to the nodes that lead to the target.
        heads, width = start.select(F.lit(target).alias("id")), 1
        kept = []
        for level, size in reversed(levels[:-1]):
            hops = cut_lineage(
                edges.join(small_side(heads.select(F.col("id").alias("dst")), width), "dst", "left_semi")
                .join(small_side(level.select(F.col("id").alias("src")), size), "src", "left_semi").distinct())
            kept.append(hops)
            heads = hops.select(F.col("src").alias("id")).distinct()
            width = hops.count()
        paths = kept[0].select(F.col("src").alias("head"), F.array("src", "dst").alias("nodes"),
                               F.array("rel").alias("relationships"))
        for hops in kept[1:]:
            paths = (hops.join(paths, hops["dst"] == paths["head"]).select(
                F.col("src").alias("head"),
                F.concat(F.array("src"), "nodes").alias("nodes"),
                F.concat(F.array("rel"), "relationships").alias("relationships")))
    return paths.select(F.size("relationships").alias("length"), "nodes", "relationships")
