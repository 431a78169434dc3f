"""The graph as nodes and edges, and parts of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbograph.graph import DocumentGraph
from arbograph.operators.reads import contains


def _id(prefix: str, column: str) -> Column:
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def _or(column: str, default: Column) -> Column:
    return F.coalesce(F.nullif(F.col(column), F.lit("")), default)


def graph_nodes(g: DocumentGraph) -> DataFrame:
    none = F.lit(None).cast("string")
    docs = g["documents"].select(_id("doc_", "doc_id").alias("id"), F.lit("document").alias("type"), F.col("doc_name").alias("label"), "doc_group", F.when(F.col("doc_group").isNotNull(), F.coalesce("doc_version", F.lit(1))).alias("doc_version"))
    secs = g["sections"].select(_id("sec_", "section_id").alias("id"), F.lit("section").alias("type"), _or("title", _id("Section ", "section_id")).alias("label"), none.alias("doc_group"), F.lit(None).cast("int").alias("doc_version"))
    ents = g["entities"].select(_id("ent_", "entity_id").alias("id"), F.lit("entity").alias("type"), F.col("name").alias("label"), none.alias("doc_group"), F.lit(None).cast("int").alias("doc_version"))
    return docs.unionByName(secs).unionByName(ents)


def graph_edges(g: DocumentGraph) -> DataFrame:
    contains_ = g["sections"].select(_id("doc_", "doc_id").alias("source"), _id("sec_", "section_id").alias("target"), F.lit("contains").alias("type"))
    parents = g["section_hierarchy"].select(_id("sec_", "parent_id").alias("source"), _id("sec_", "child_id").alias("target"), F.lit("parent_of").alias("type"))
    mentions = g["section_entities"].select(_id("sec_", "section_id").alias("source"), _id("ent_", "entity_id").alias("target"), F.lower(_or("relevance", F.lit("mentions"))).alias("type"))
    related = g["entity_relationships"].select(_id("ent_", "source_entity").alias("source"), _id("ent_", "target_entity").alias("target"), F.lower(_or("relationship", F.lit("related_to"))).alias("type"))
    return contains_.unionByName(parents).unionByName(mentions).unionByName(related)


def node_connections(g: DocumentGraph) -> DataFrame:
    """Neighbours of every node in both directions."""
    e = graph_edges(g)
    return e.select(F.col("source").alias("id"), F.col("target").alias("neighbor"), "type", F.lit("out").alias("direction")).unionByName(
        e.select(F.col("target").alias("id"), F.col("source").alias("neighbor"), "type", F.lit("in").alias("direction"))
    )


def induced_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges both of whose ends are among ``nodes`` (id)."""
    ids = nodes.select("id").distinct()
    return edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi").select("source", "target", "type")


def search_subgraph(g: DocumentGraph, text: str) -> DataFrame:
    """Edges between nodes whose labels contain ``text``."""
    return induced_edges(graph_edges(g), graph_nodes(g).filter(contains("label", text)))


def path_subgraph(g: DocumentGraph, steps: DataFrame) -> DataFrame:
    """Edges between the nodes of traversal ``steps`` (node_type, node_id)."""
    prefix = F.when(F.col("node_type") == "section", "sec_").when(F.col("node_type") == "entity", "ent_").otherwise("doc_")
    return induced_edges(graph_edges(g), steps.select(F.concat(prefix, F.col("node_id").cast("string")).alias("id")))


def node_type_counts(g: DocumentGraph) -> DataFrame:
    return graph_nodes(g).groupBy("type").agg(F.count("*").alias("n"))


def write_graph(g: DocumentGraph, path: str) -> None:
    """Nodes and edges as JSON, a row a line, in a folder each; keys that are null are left out."""
    graph_nodes(g).write.json(f"{path}/nodes")
    graph_edges(g).write.json(f"{path}/edges")
