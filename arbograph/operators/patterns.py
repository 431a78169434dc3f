"""Graph patterns: paths of labelled vertices and edges, compiled to equi-joins."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arbograph.graph import DocumentGraph
from arbograph.operators.reads import asked_patterns, contains
from arbograph.schema import EDGES, VERTICES


@dataclass(frozen=True)
class Step:
    """One edge of a path and the vertex it leads to."""

    edge: str
    label: str
    vertex: str
    vertex_label: str
    outward: bool
    where: Column | None = None


@dataclass(frozen=True)
class Pattern:
    """``match('e', 'entity').out('r', 'related_to', 'x', 'entity').rows(graph)``.

    Columns of the result are named ``name.column`` with a dot replaced by
    ``_``: ``e_name``, ``r_relationship``.  Conditions see the element's own
    columns and reach its scan; ``rows`` keeps only the columns asked for, so
    scans read no others.
    """

    start: str
    start_label: str
    where: Column | None = None
    steps: tuple[Step, ...] = ()

    def out(self, edge: str, label: str, vertex: str, vertex_label: str, where: Column | None = None) -> Pattern:
        return self._with(Step(edge, label, vertex, vertex_label, True, where))

    def into(self, edge: str, label: str, vertex: str, vertex_label: str, where: Column | None = None) -> Pattern:
        return self._with(Step(edge, label, vertex, vertex_label, False, where))

    def _with(self, step: Step) -> Pattern:
        source, target = EDGES[step.label].source[1], EDGES[step.label].target[1]
        here = self.steps[-1].vertex_label if self.steps else self.start_label
        if (here, step.vertex_label) != ((source, target) if step.outward else (target, source)):
            raise ValueError(f"{step.label} does not lead from {here} to {step.vertex_label}")
        return Pattern(self.start, self.start_label, self.where, (*self.steps, step))

    def rows(self, g: DocumentGraph, columns: dict[str, str]) -> DataFrame:
        """``columns``: name in the result -> 'element.column'."""
        def vertex(name: str, label: str, where: Column | None) -> DataFrame:
            table = g[VERTICES[label].table]
            table = table if where is None else table.filter(where)
            return table.select(*(F.col(c).alias(f"{name}_{c}") for c in table.columns))

        df, here, label = vertex(self.start, self.start_label, self.where), self.start, self.start_label
        for s in self.steps:
            e = EDGES[s.label]
            near, far = (e.source[0], e.target[0]) if s.outward else (e.target[0], e.source[0])
            edges = g[e.table]
            edges = edges.select(*(F.col(c).alias(f"{s.edge}_{c}") for c in edges.columns))
            df = df.join(edges, F.col(f"{here}_{VERTICES[label].key}") == F.col(f"{s.edge}_{near}"))
            df = df.join(vertex(s.vertex, s.vertex_label, s.where), F.col(f"{s.edge}_{far}") == F.col(f"{s.vertex}_{VERTICES[s.vertex_label].key}"))
            here, label = s.vertex, s.vertex_label
        return df.select(*(F.col(source.replace(".", "_", 1)).alias(name) for name, source in columns.items()))


def match(vertex: str, label: str, where: Column | None = None) -> Pattern:
    return Pattern(vertex, label, where)


def entity_sections(g: DocumentGraph, where: Column | None = None) -> DataFrame:
    """(section)-[mentions]->(entity)"""
    return match("e", "entity", where).into("m", "mentions", "s", "section").rows(
        g, {"section_id": "s.section_id", "section_title": "s.title", "depth_level": "s.depth_level", "relevance": "m.relevance", "entity_id": "e.entity_id", "entity_name": "e.name", "entity_type": "e.entity_type"}
    )


def entity_sections_with_documents(g: DocumentGraph, where: Column | None = None) -> DataFrame:
    """(document)-[contains]->(section)-[mentions]->(entity)"""
    return match("d", "document").out("c", "contains", "s", "section").out("m", "mentions", "e", "entity", where).rows(
        g, {"doc_name": "d.doc_name", "section_id": "s.section_id", "section_title": "s.title", "entity_name": "e.name", "relevance": "m.relevance"}
    )


def related_entities(g: DocumentGraph, where: Column | None = None) -> DataFrame:
    """(entity)-[related_to]->(entity)"""
    return match("a", "entity", where).out("r", "related_to", "b", "entity").rows(
        g, {"source_id": "a.entity_id", "source_name": "a.name", "relationship": "r.relationship", "related_id": "b.entity_id", "related_name": "b.name", "related_type": "b.entity_type"}
    )


def hierarchy_pairs(g: DocumentGraph) -> DataFrame:
    return match("p", "section").out("h", "parent_of", "c", "section").rows(
        g, {"parent_id": "p.section_id", "parent_title": "p.title", "child_id": "c.section_id", "child_title": "c.title"}
    )


def entity_neighborhood(g: DocumentGraph, entities: DataFrame | None = None) -> DataFrame:
    """Entities that share a section, for each of ``entities`` (entity_id) or for all.

    The edges meet on the section before any vertex is joined; seeds restrict
    one side first, so a section with many mentions is expanded for them only.
    """
    m = g["section_entities"].select("section_id", "entity_id", "relevance")
    seeds = m if entities is None else m.join(entities.select("entity_id").distinct(), "entity_id", "left_semi")
    pairs = seeds.join(m.select("section_id", F.col("entity_id").alias("co_entity_id")), "section_id").filter("co_entity_id <> entity_id")
    named = g["entities"].select(F.col("entity_id").alias("co_entity_id"), F.col("name").alias("co_entity_name"), F.col("entity_type").alias("co_entity_type"))
    return (
        pairs.join(named, "co_entity_id").join(g["sections"].select("section_id", "title", "depth_level"), "section_id")
        .select("entity_id", "section_id", "title", "depth_level", "relevance", "co_entity_id", "co_entity_name", "co_entity_type")
    )


def neighborhood_sections(g: DocumentGraph, entities: DataFrame | None = None) -> DataFrame:
    """Each entity's sections that mention another entity too, once each."""
    m = g["section_entities"].select("section_id", "entity_id", "relevance")
    seeds = m if entities is None else m.join(entities.select("entity_id").distinct(), "entity_id", "left_semi")
    shared = m.groupBy("section_id").agg(F.min("entity_id").alias("a"), F.max("entity_id").alias("b")).filter("a < b").select("section_id")
    found = seeds.groupBy("entity_id", "section_id").agg(F.min("relevance").alias("relevance")).join(shared, "section_id", "left_semi")
    return found.join(g["sections"].select("section_id", "title", "depth_level"), "section_id").select("entity_id", "section_id", "title", "depth_level", "relevance")


def neighborhood_entities(g: DocumentGraph, entities: DataFrame | None = None) -> DataFrame:
    """Each entity's co-mentioned entities, once each."""
    m = g["section_entities"].select("section_id", "entity_id").distinct()
    seeds = m if entities is None else m.join(entities.select("entity_id").distinct(), "entity_id", "left_semi")
    pairs = seeds.join(m.select("section_id", F.col("entity_id").alias("co_entity_id")), "section_id").filter("co_entity_id <> entity_id").select("entity_id", "co_entity_id").distinct()
    named = g["entities"].select(F.col("entity_id").alias("co_entity_id"), "name", "entity_type")
    return pairs.join(named, "co_entity_id").select("entity_id", "co_entity_id", "name", "entity_type")


PATH = ("source_id", "source_name", "mid_id", "mid_name", "mid_type", "r1_type", "target_id", "target_name", "r2_type")


def entity_paths(g: DocumentGraph, ends: DataFrame | None = None) -> DataFrame:
    """Paths of two directed edges, all or those between the ``ends`` (source_id, target_id).

    Ends restrict both edges before they meet.
    """
    r, e = g["entity_relationships"], g["entities"]
    first = r.select(F.col("source_entity").alias("source_id"), F.col("target_entity").alias("mid_id"), F.col("relationship").alias("r1_type"))
    second = r.select(F.col("source_entity").alias("mid_id"), F.col("target_entity").alias("target_id"), F.col("relationship").alias("r2_type"))
    if ends is not None:
        ends = ends.select("source_id", "target_id").distinct()
        first = first.join(ends.select("source_id").distinct(), "source_id", "left_semi")
        second = second.join(ends.select("target_id").distinct(), "target_id", "left_semi")
    paths = first.join(second, "mid_id")
    if ends is not None:
        paths = paths.join(ends, ["source_id", "target_id"], "left_semi")
    named = lambda p, *more: e.select(F.col("entity_id").alias(f"{p}_id"), F.col("name").alias(f"{p}_name"), *(F.col("entity_type").alias(m) for m in more))
    return paths.join(named("source"), "source_id").join(named("mid", "mid_type"), "mid_id").join(named("target"), "target_id").select(*PATH)


def entity_paths_by_name(g: DocumentGraph, pairs: DataFrame, limit: int | None = 10) -> DataFrame:
    """The first ``limit`` paths for each of ``pairs`` (source_query, target_query), between entities whose names contain the queries."""
    pairs = pairs.select("source_query", "target_query").distinct()
    named = g["entities"].select("entity_id", "name")
    ends = {}
    for end in ("source", "target"):
        asked = asked_patterns(pairs.select(F.col(f"{end}_query").alias("query")))
        ends[end] = named.join(asked, contains("name", F.col("query"))).select(F.col("query").alias(f"{end}_query"), F.col("entity_id").alias(f"{end}_id"), F.col("name").alias(f"{end}_name")).distinct()
    r = g["entity_relationships"].select(F.col("source_entity").alias("source_id"), F.col("target_entity").alias("mid_id"))
    s = g["entity_relationships"].select(F.col("source_entity").alias("mid_id"), F.col("target_entity").alias("target_id"))
    # ids that meet over some middle, so that pairs of ends aren't formed
    met = r.join(ends["source"].select("source_id").distinct(), "source_id", "left_semi").join(s.join(ends["target"].select("target_id").distinct(), "target_id", "left_semi"), "mid_id")
    # by name too: an id that several entities have leads to all their names
    hits = entity_paths(g, met).join(ends["source"], ["source_id", "source_name"]).join(ends["target"], ["target_id", "target_name"]).join(pairs, ["source_query", "target_query"])
    order = Window.partitionBy("source_query", "target_query").orderBy("source_id", "mid_id", "target_id", "r1_type", "r2_type", "source_name", "mid_name", "target_name", "mid_type")
    return hits.withColumn("ord", F.row_number().over(order)).filter(F.lit(True) if limit is None else F.col("ord") <= limit).select("source_query", "target_query", "ord", *PATH)


def multi_hop_entities(g: DocumentGraph, max_hops: int = 2, entities: DataFrame | None = None) -> DataFrame:
    """Entities reached over 1 to ``max_hops`` directed edges, with each number of hops and last relationship.

    One hop keeps loops; further hops leave out the start.  Walks are reduced
    to distinct (start, end) after each hop, so cycles don't multiply rows.
    """
    r = g["entity_relationships"].select("source_entity", "target_entity", "relationship")
    if entities is not None:
        start = r.join(entities.select(F.col("entity_id").alias("source_entity")).distinct(), "source_entity", "left_semi")
    else:
        start = r
    hop = start.select(F.col("source_entity").alias("start_id"), F.col("target_entity").alias("entity_id"), "relationship", F.lit(1).alias("hops")).distinct()
    out, front = hop, hop
    for k in range(2, max_hops + 1):
        reached = front.select("start_id", F.col("entity_id").alias("source_entity")).distinct()
        front = reached.join(r, "source_entity").select("start_id", F.col("target_entity").alias("entity_id"), "relationship", F.lit(k).alias("hops")).distinct()
        out = out.unionByName(front.filter("entity_id <> start_id"))
    return out.join(g["entities"].select("entity_id", "name", "entity_type"), "entity_id").select("start_id", "entity_id", "name", "entity_type", "relationship", "hops")


def typed_relationships(g: DocumentGraph, entity_type: str) -> DataFrame:
    """Edges between entities of a type and any others."""
    return match("a", "entity", F.col("entity_type") == entity_type).out("r", "related_to", "b", "entity").rows(
        g, {"source_name": "a.name", "relationship": "r.relationship", "target_name": "b.name", "target_type": "b.entity_type"}
    )


def most_mentioned(g: DocumentGraph, limit: int = 15) -> DataFrame:
    counts = g["section_entities"].groupBy("entity_id").agg(F.count("*").alias("mention_count"))
    return counts.join(g["entities"].select("entity_id", "name", "entity_type"), "entity_id").orderBy(F.desc("mention_count"), "entity_id").limit(limit).select("entity_id", "name", "entity_type", "mention_count")


def session_entities(g: DocumentGraph) -> DataFrame:
    """(session)-[has_turn]->(turn)-[turn_entity]->(entity)"""
    return match("t", "turn").out("x", "turn_entity", "e", "entity").rows(
        g, {"session_id": "t.session_id", "turn_id": "t.turn_id", "turn_number": "t.turn_number", "role": "x.role", "entity_id": "e.entity_id", "name": "e.name", "entity_type": "e.entity_type"}
    )
