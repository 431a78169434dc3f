"""Scans and joins over the graph, for all keys at once; a key's rows are a filter away."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arbograph.graph import DocumentGraph


#: Patterns that are matched in one pass at most.
MAX_QUERIES = 10_000


def contains(column: Column | str, text: Column | str) -> Column:
    """Case-insensitive LIKE '%text%': the wildcards % and _ within the text keep their meaning."""
    column = F.col(column) if isinstance(column, str) else column
    text = F.lit(text) if isinstance(text, str) else text
    return F.like(F.lower(column), F.concat(F.lit("%"), F.lower(text), F.lit("%")))


def all_documents(g: DocumentGraph) -> DataFrame:
    return g["documents"].orderBy("doc_id")


def document_sections(g: DocumentGraph) -> DataFrame:
    """Every document's sections with their place in the document."""
    place = Window.partitionBy("doc_id").orderBy(F.col("start_index").asc_nulls_last(), "section_id")
    return g["sections"].withColumn("ord", F.row_number().over(place))


def sections_by_ids(g: DocumentGraph, ids: DataFrame) -> DataFrame:
    """Sections with their documents for the distinct ids of ``ids`` (section_id)."""
    wanted = ids.select("section_id").filter("section_id is not null")
    return (
        g["sections"].join(wanted, "section_id", "left_semi")
        .join(g["documents"].select("doc_id", "doc_name"), "doc_id")
        .select("section_id", "title", "summary", "text_content", "depth_level", "start_index", "end_index", "doc_id", "doc_name")
    )


def section_children(g: DocumentGraph) -> DataFrame:
    edges = g["section_hierarchy"].select("parent_id", F.col("child_id").alias("section_id"))
    place = Window.partitionBy("parent_id").orderBy(F.col("start_index").asc_nulls_last(), "section_id")
    return g["sections"].join(edges, "section_id").withColumn("ord", F.row_number().over(place))


def section_entities(g: DocumentGraph) -> DataFrame:
    return (
        g["section_entities"].select("section_id", "entity_id", "relevance")
        .join(g["entities"].select("entity_id", "name", "entity_type", "description"), "entity_id")
        .select("section_id", "entity_id", "name", "entity_type", "description", "relevance")
    )


def all_entities(g: DocumentGraph) -> DataFrame:
    return g["entities"].select("entity_id", "name", "entity_type", "description", "canonical_id", "first_seen_doc", "last_seen_doc").orderBy("entity_id")


def asked_patterns(names: DataFrame) -> DataFrame:
    """The distinct queries, sent to every task: patterns with wildcards meet names by no key."""
    asked = names.select("query").distinct()
    if asked.limit(MAX_QUERIES + 1).count() > MAX_QUERIES:
        raise ValueError(f"more than {MAX_QUERIES} queries by pattern at once; resolve literal names by key instead")
    return F.broadcast(asked)


def entity_sections(g: DocumentGraph, names: DataFrame, limit: int = 10) -> DataFrame:
    """For each ``query`` of ``names``, the first sections that mention an entity whose name contains it."""
    found = g["entities"].select("entity_id", "name").join(asked_patterns(names), contains("name", F.col("query")))
    rows = (
        found.select("query", "entity_id").join(g["section_entities"].select("section_id", "entity_id", "relevance"), "entity_id")
        .join(g["sections"].select("section_id", "doc_id", "title", "depth_level", "start_index"), "section_id")
    )
    order = Window.partitionBy("query").orderBy(F.col("start_index").asc_nulls_last(), "section_id", "entity_id")
    top = rows.withColumn("ord", F.row_number().over(order)).filter(F.col("ord") <= limit)
    return top.join(g["documents"].select("doc_id", "doc_name"), "doc_id").select("query", "ord", "section_id", "entity_id", "title", "depth_level", "relevance", "start_index", "doc_id", "doc_name")


def related_entities(g: DocumentGraph, names: DataFrame, limit: int = 20) -> DataFrame:
    """For each ``query``, the first targets of edges from entities whose name contains it."""
    found = g["entities"].select(F.col("entity_id").alias("source_entity"), "name").join(asked_patterns(names), contains("name", F.col("query")))
    rows = (
        found.select("query", "source_entity").join(g["entity_relationships"].select("source_entity", F.col("target_entity").alias("entity_id"), "relationship"), "source_entity")
        .join(g["entities"].select("entity_id", "name", "entity_type", "description"), "entity_id")
    )
    order = Window.partitionBy("query").orderBy("name", "entity_id", "source_entity", "relationship")
    return rows.withColumn("ord", F.row_number().over(order)).filter(F.col("ord") <= limit).select("query", "ord", "entity_id", "name", "entity_type", "description", "relationship")


def entity_sections_of(g: DocumentGraph, query: str, limit: int = 10) -> DataFrame:
    """As ``entity_sections``, in their order, for one query: its pattern filters the scan of entities, and a sort with a limit takes the first."""
    found = g["entities"].filter(contains("name", query)).select("entity_id")
    rows = (
        found.join(g["section_entities"].select("section_id", "entity_id", "relevance"), "entity_id")
        .join(g["sections"].select("section_id", "doc_id", "title", "depth_level", "start_index"), "section_id")
        .join(g["documents"].select("doc_id", "doc_name"), "doc_id")
    )
    return rows.orderBy(F.col("start_index").asc_nulls_last(), "section_id", "entity_id").limit(limit).select("section_id", "entity_id", "title", "depth_level", "relevance", "start_index", "doc_id", "doc_name")


def related_entities_of(g: DocumentGraph, query: str, limit: int = 20) -> DataFrame:
    """As ``related_entities``, in their order, for one query."""
    found = g["entities"].filter(contains("name", query)).select(F.col("entity_id").alias("source_entity"))
    rows = (
        found.join(g["entity_relationships"].select("source_entity", F.col("target_entity").alias("entity_id"), "relationship"), "source_entity")
        .join(g["entities"].select("entity_id", "name", "entity_type", "description"), "entity_id")
    )
    return rows.orderBy("name", "entity_id", "source_entity", "relationship").limit(limit).select("entity_id", "name", "entity_type", "description", "relationship")


def doc_entities(g: DocumentGraph) -> DataFrame:
    pairs = g["section_entities"].select("section_id", "entity_id").join(g["sections"].select("section_id", "doc_id"), "section_id").select("doc_id", "entity_id").distinct()
    return pairs.join(g["entities"].select("entity_id", "name", "entity_type"), "entity_id").select("doc_id", "entity_id", "name", "entity_type")


def shared_section_text(g: DocumentGraph, pairs: DataFrame, limit: int = 3) -> DataFrame:
    """For each pair (entity1_id, entity2_id), the texts of the first sections that mention both."""
    m = g["section_entities"].select("section_id", "entity_id").distinct()
    both = (
        pairs.select("entity1_id", "entity2_id").distinct()
        .join(m.withColumnRenamed("entity_id", "entity1_id"), "entity1_id")
        .join(m.withColumnRenamed("entity_id", "entity2_id"), ["entity2_id", "section_id"])
    )
    order = Window.partitionBy("entity1_id", "entity2_id").orderBy("section_id")
    first = both.withColumn("ord", F.row_number().over(order)).filter(F.col("ord") <= limit)
    texts = first.join(g["sections"].select("section_id", "text_content"), "section_id")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("text_content").isNotNull(), F.struct("ord", "text_content")))), lambda x: x["text_content"]), "\n\n")
    return texts.groupBy("entity1_id", "entity2_id").agg(joined.alias("text"))


def title_search(g: DocumentGraph, concepts: list[str]) -> DataFrame:
    """Sections whose title contains one of the words literally, in the order of documents and pages."""
    hit = F.exists(F.array(*(F.lit(c.lower()) for c in concepts)), lambda c: F.contains(F.lower(F.coalesce("title", F.lit(""))), c)) if concepts else F.lit(False)
    return g["sections"].filter(hit).join(g["documents"].select("doc_id", "doc_name"), "doc_id").select("section_id", "doc_id", "doc_name", "title", "start_index", "depth_level")


def graph_stats(g: DocumentGraph) -> DataFrame:
    """Rows of each table of vertices and edges."""
    kinds = {"documents": "vertex", "sections": "vertex", "entities": "vertex", "sessions": "vertex", "turns": "vertex", "section_hierarchy": "edge", "section_entities": "edge", "entity_relationships": "edge", "turn_entities": "edge", "turn_sections": "edge"}
    out = None
    for table, kind in kinds.items():
        row = g[table].agg(F.count("*").alias("n")).select(F.lit(table).alias("label"), F.lit(kind).alias("kind"), "n")
        out = row if out is None else out.unionByName(row)
    return out


def top_level_sections(g: DocumentGraph) -> DataFrame:
    return g["sections"].filter("depth_level = 0 and title is not null").select("section_id", "doc_id", "title")
