"""The property graph's tables: five kinds of vertices, seven of edges."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

SCHEMAS: dict[str, str] = {
    "documents": "doc_id long, doc_name string, doc_description string, source_path string, created_at timestamp, doc_version int, doc_group string",
    "sections": "section_id long, doc_id long, node_id string, title string, summary string, text_content string, start_index int, end_index int, depth_level int",
    "entities": "entity_id long, name string, entity_type string, description string, name_embedding array<float>, canonical_id long, first_seen_doc long, last_seen_doc long",
    "sessions": "session_id long, started_at timestamp, title string, metadata string",
    "turns": "turn_id long, session_id long, turn_number int, question string, answer string, intent string, created_at timestamp",
    "section_hierarchy": "edge_id long, parent_id long, child_id long",
    "section_entities": "edge_id long, section_id long, entity_id long, relevance string",
    "entity_relationships": "edge_id long, source_entity long, target_entity long, relationship string, edge_source string, confidence decimal(3,2)",
    "turn_entities": "edge_id long, turn_id long, entity_id long, role string",
    "turn_sections": "edge_id long, turn_id long, section_id long, rank_score double",
    "temporal_edges": "edge_id long, source_doc_id long, target_doc_id long, entity_id long, change_type string, old_value string, new_value string, confidence decimal(3,2)",
    "entity_aliases": "edge_id long, canonical_id long, alias_id long, similarity decimal(5,4), confirmed int",
}


def struct(table: str) -> T.StructType:
    return T.StructType.fromDDL(SCHEMAS[table])


@dataclass(frozen=True)
class Vertex:
    table: str
    key: str


@dataclass(frozen=True)
class Edge:
    table: str
    source: tuple[str, str]
    target: tuple[str, str]


#: Labels of the graph; an edge names its end columns with the labels they point to.
VERTICES = {
    "document": Vertex("documents", "doc_id"),
    "section": Vertex("sections", "section_id"),
    "entity": Vertex("entities", "entity_id"),
    "session": Vertex("sessions", "session_id"),
    "turn": Vertex("turns", "turn_id"),
}
EDGES = {
    "parent_of": Edge("section_hierarchy", ("parent_id", "section"), ("child_id", "section")),
    "mentions": Edge("section_entities", ("section_id", "section"), ("entity_id", "entity")),
    "related_to": Edge("entity_relationships", ("source_entity", "entity"), ("target_entity", "entity")),
    "turn_entity": Edge("turn_entities", ("turn_id", "turn"), ("entity_id", "entity")),
    "turn_section": Edge("turn_sections", ("turn_id", "turn"), ("section_id", "section")),
    "changed_in": Edge("temporal_edges", ("source_doc_id", "document"), ("target_doc_id", "document")),
    "alias_of": Edge("entity_aliases", ("canonical_id", "entity"), ("alias_id", "entity")),
    "contains": Edge("sections", ("doc_id", "document"), ("section_id", "section")),
    "has_turn": Edge("turns", ("session_id", "session"), ("turn_id", "turn")),
}

# Vocabularies.
ENTITY_TYPES = ("PERSON", "ORGANIZATION", "TECHNOLOGY", "CONCEPT", "LOCATION", "EVENT", "METRIC")
RELEVANCES = ("DEFINES", "DISCUSSES", "MENTIONS")
INTENTS = ("LOOKUP", "RELATIONSHIP", "EXPLORATION", "COMPARISON", "HIERARCHICAL", "TEMPORAL")
