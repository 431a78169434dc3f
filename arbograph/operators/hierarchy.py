"""Walks up and down the section tree, level by level."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbograph.graph import DocumentGraph
from arbograph.session import materialise

#: Levels between looks for cycles.
LOOK = 16


class CycleError(ValueError):
    """A walk comes back to a node."""


def _goes_round(out: DataFrame) -> bool:
    """Whether a walk is longer than the nodes that its start reaches are many, as only a cycle lets it be."""
    reached = out.groupBy("start").agg(F.max("level").alias("l"), F.count_distinct("node").alias("n"))
    return not reached.filter("l > n").isEmpty()


def walks(edges: DataFrame, starts: DataFrame | None = None, nocycle: bool = False, look: int = LOOK) -> DataFrame:
    """(start, node, level) for every downward path of ``edges`` (parent, child); one row a path.

    Each level is one equi-join of the last level's ends with the edges, and is
    written before the next, so plans stay flat and lost executors lose no
    level.  A cycle raises, or with ``nocycle`` a path ends before it repeats a
    node.  Trees may have any depth.
    """
    first = edges if starts is None else edges.join(starts.select(F.col("start").alias("parent")).distinct(), "parent", "left_semi")
    front = first.select(F.col("parent").alias("start"), F.col("child").alias("node"), F.lit(1).alias("level"))
    if nocycle:
        front = front.filter("start <> node").withColumn("path", F.array("start", "node"))
    front = materialise(front, "level")
    out, level = front, 1
    while not front.isEmpty():
        if not nocycle and level % look == 0 and _goes_round(out):
            raise CycleError("a walk comes back to a node")
        level += 1
        front = front.withColumnRenamed("node", "parent").join(edges, "parent").withColumn("level", F.lit(level)).withColumnRenamed("child", "node")
        if nocycle:
            front = front.filter(~F.array_contains("path", F.col("node"))).withColumn("path", F.concat("path", F.array("node")))
        front = materialise(front.select(out.columns), "level")
        out = out.unionByName(front)
    return out.select("start", "node", "level")


def _edges(g: DocumentGraph) -> DataFrame:
    return g["section_hierarchy"].select(F.col("parent_id").alias("parent"), F.col("child_id").alias("child"))


def _titled(g: DocumentGraph, rows: DataFrame) -> DataFrame:
    named = g["sections"].select(F.col("section_id").alias("node"), "title", "depth_level")
    return rows.join(named, "node").select(F.col("start"), F.col("node").alias("section_id"), "title", "depth_level", F.col("level").alias("tree_level"))


def section_descendants(g: DocumentGraph, starts: DataFrame | None = None, nocycle: bool = False) -> DataFrame:
    """(start, section_id, title, depth_level, tree_level) below every section or those of ``starts`` (start)."""
    return _titled(g, walks(_edges(g), starts, nocycle))


def section_ancestors(g: DocumentGraph, starts: DataFrame | None = None, nocycle: bool = False) -> DataFrame:
    """As ``section_descendants``, upwards; the largest tree_level is the root."""
    up = _edges(g).select(F.col("child").alias("parent"), F.col("parent").alias("child"))
    return _titled(g, walks(up, starts, nocycle))


def section_subtree_by_title(g: DocumentGraph, titles: DataFrame) -> DataFrame:
    """Descendants of the section with the smallest id among those of each ``title``."""
    first = g["sections"].join(titles.select("title").distinct(), "title").groupBy("title").agg(F.min("section_id").alias("start"))
    found = section_descendants(g, first.select("start"))
    return first.join(found.withColumnRenamed("title", "child_title"), "start").select(
        F.col("title").alias("root_title"), F.col("section_id").alias("child_section_id"), "child_title", F.col("depth_level").alias("child_depth"), "tree_level"
    )
