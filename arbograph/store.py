"""A facade for single look-ups: each method filters the set-based operator before it runs.

Reads return DataFrames in the order that their names promise; writes replace
the store's graph.  Filters on keys reach the scans, so a look-up reads only
what its key selects.  A row that is added or changed is a small file beside its
table, whatever the table's size; reads put the last versions in the place of rows,
and after some hundred such files the table is written anew to another folder.
Frames that were read before go on showing the table as it was.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from arbograph.graph import DocumentGraph
from arbograph.operators import enrichment, hierarchy, patterns, reads, sessions, temporal, vectors, views, writes
from arbograph.session import shared_dir

#: Rows that are added to or changed in a table as files of their own before it is written again.
FILES = 256


class DocumentStore:
    def __init__(self, graph: DocumentGraph, small: bool = False) -> None:
        """``small``: tables are stored as one file each, for graphs that are written row by row."""
        self.graph, self.small = graph, small
        self.paths: dict[str, str] = {}
        self.files: dict[str, int] = {}
        self.changed: dict[str, int] = {}

    @property
    def spark(self) -> SparkSession:
        return self.graph.spark

    def _frame(self, rows: list[tuple], schema: str) -> DataFrame:
        return self.spark.createDataFrame(rows, schema)

    def _ids(self, name: str, *values) -> DataFrame:
        return self._frame([(int(v),) for v in values], f"{name} long")

    # reads

    def get_all_documents(self) -> DataFrame:
        return reads.all_documents(self.graph)

    def get_document_sections(self, doc_id: int) -> DataFrame:
        return self.graph["sections"].filter(F.col("doc_id") == doc_id).orderBy(F.col("start_index").asc_nulls_last(), "section_id")

    def get_sections_by_ids(self, section_ids: Iterable[int]) -> DataFrame:
        return reads.sections_by_ids(self.graph, self._ids("section_id", *dict.fromkeys(i for i in section_ids if i is not None)))

    def get_section_children(self, section_id: int) -> DataFrame:
        g = self.graph.with_table("section_hierarchy", self.graph["section_hierarchy"].filter(F.col("parent_id") == section_id))
        return reads.section_children(g).orderBy("ord")

    def get_section_entities(self, section_id: int) -> DataFrame:
        g = self.graph.with_table("section_entities", self.graph["section_entities"].filter(F.col("section_id") == section_id))
        return reads.section_entities(g).orderBy("name", "entity_id")

    def get_all_entities(self) -> DataFrame:
        return reads.all_entities(self.graph)

    def find_similar_entities(self, embedding: list[float], entity_type: str, threshold: float, exclude_id: int | None = None) -> DataFrame:
        probe = self._frame([(exclude_id or -1, entity_type, [float(x) for x in embedding])], "entity_id long, entity_type string, name_embedding array<double>")
        entities = self.graph["entities"].filter(F.col("entity_type") == entity_type)
        found = vectors.similar_entities(entities, probe, threshold)
        return found.join(entities.select("entity_id", "name"), "entity_id").select("entity_id", "name", "entity_type", "distance").orderBy("distance", "entity_id")

    def get_entity_sections(self, entity_name: str) -> DataFrame:
        return reads.entity_sections_of(self.graph, entity_name)

    def get_related_entities(self, entity_name: str) -> DataFrame:
        return reads.related_entities_of(self.graph, entity_name)

    def get_full_graph_data(self) -> tuple[DataFrame, DataFrame]:
        return views.graph_nodes(self.graph), views.graph_edges(self.graph)

    def get_versioned_graph_data(self, doc_group: str, version: int) -> tuple[DataFrame, DataFrame]:
        status = temporal.versioned_entity_nodes(self.graph).filter((F.col("doc_group") == doc_group) & (F.col("doc_version") == version)).select("id", "temporal_status")
        return views.graph_nodes(self.graph).join(status, "id", "left"), views.graph_edges(self.graph)

    def graph_query_entity_sections(self, entity_name: str) -> DataFrame:
        return patterns.entity_sections(self.graph, F.col("name") == entity_name).orderBy("section_id")

    def graph_query_related_entities(self, entity_name: str) -> DataFrame:
        return patterns.related_entities(self.graph, F.col("name") == entity_name).orderBy("related_name")

    def graph_query_section_children(self, section_title: str) -> DataFrame:
        return hierarchy.section_subtree_by_title(self.graph, self._frame([(section_title,)], "title string")).orderBy("child_depth", "child_section_id")

    def traverse_entity_neighborhood(self, entity_id: int) -> dict[str, DataFrame]:
        seeds = self._ids("entity_id", entity_id)
        return {
            "rows": patterns.entity_neighborhood(self.graph, seeds),
            "sections": patterns.neighborhood_sections(self.graph, seeds),
            "entities": patterns.neighborhood_entities(self.graph, seeds),
        }

    def traverse_section_ancestors(self, section_id: int) -> DataFrame:
        return hierarchy.section_ancestors(self.graph, self._ids("start", section_id)).orderBy(F.desc("tree_level"), "section_id")

    def traverse_section_descendants(self, section_id: int) -> DataFrame:
        return hierarchy.section_descendants(self.graph, self._ids("start", section_id)).orderBy("tree_level", "section_id")

    def find_entity_paths(self, source_name: str, target_name: str) -> DataFrame:
        pair = self._frame([(source_name, target_name)], "source_query string, target_query string")
        return patterns.entity_paths_by_name(self.graph, pair).orderBy("ord")

    def get_multi_hop_entities(self, entity_id: int, max_hops: int = 2) -> DataFrame:
        return patterns.multi_hop_entities(self.graph, max_hops, self._ids("entity_id", entity_id)).orderBy("hops", "entity_id")

    def get_isolated_entities(self, min_mentions: int = 2) -> DataFrame:
        return enrichment.isolated_entities(self.graph, min_mentions).orderBy(F.desc("mention_count"), "entity_id")

    def get_cooccurring_pairs(self, min_shared: int = 2) -> DataFrame:
        return enrichment.cooccurring_pairs(self.graph, min_shared).orderBy(F.desc("shared_sections"), "entity1_id", "entity2_id")

    def get_shared_section_text(self, entity1_id: int, entity2_id: int) -> str:
        row = reads.shared_section_text(self.graph, self._frame([(entity1_id, entity2_id)], "entity1_id long, entity2_id long")).first()
        return row["text"] if row else ""

    def get_previous_version(self, doc_group: str, current_version: int) -> DataFrame:
        hit = (F.col("doc_group") == doc_group) & (F.col("doc_version") == current_version - 1)
        return self.graph["documents"].filter(hit).select("doc_id", "doc_name", "doc_version").limit(1)

    def get_doc_entities(self, doc_id: int) -> DataFrame:
        g = self.graph.with_table("sections", self.graph["sections"].filter(F.col("doc_id") == doc_id))
        return reads.doc_entities(g).drop("doc_id").orderBy("name", "entity_id")

    def get_temporal_changes(self, doc_group: str, version_from: int, version_to: int) -> DataFrame:
        hit = (F.col("doc_group") == doc_group) & (F.col("version_from") == version_from) & (F.col("version_to") == version_to)
        return temporal.temporal_changes(self.graph).filter(hit).orderBy("change_type", F.col("name").asc_nulls_last(), "edge_id")

    def compute_temporal_diff(self, doc_id: int) -> DataFrame:
        return temporal.temporal_diff(self.graph).filter(F.col("target_doc_id") == doc_id)

    def get_session_context(self, session_id: int) -> dict[str, list]:
        """Of the latest turn: primary entities (entity_id, name, entity_type) and section ids, best first."""
        g = self.graph.with_table("turns", self.graph["turns"].filter(F.col("session_id") == session_id))
        last = sessions.latest_turns(g)
        primary = last.join(g["turn_entities"].filter("role = 'PRIMARY'"), "turn_id").join(g["entities"], "entity_id").select("entity_id", "name", "entity_type").orderBy("name", "entity_id")
        used = last.join(g["turn_sections"], "turn_id").orderBy(F.col("rank_score").desc_nulls_first(), "section_id").select("section_id")
        return {"primary_entities": [r.asDict() for r in primary.collect()], "previous_sections": [r[0] for r in used.collect()]}

    def list_sessions(self) -> DataFrame:
        return sessions.list_sessions(self.graph)

    def get_session_turns(self, session_id: int) -> DataFrame:
        return self.graph["turns"].filter(F.col("session_id") == session_id).orderBy(F.col("turn_number").asc_nulls_last(), "turn_id")

    # writes

    def _stored(self, table: str) -> None:
        """Keeps a table in a folder of its own, and writes it anew once ``FILES`` rows were added or changed.

        A new folder gets all that is in force; readers of the old one go on with what they have.
        """
        if table not in self.paths or self.files[table] >= FILES:
            held = self.graph[table]
            folder = f"{shared_dir(self.spark)}/{table}-{uuid.uuid4().hex}"
            (held.coalesce(1) if self.small else held).write.parquet(f"{folder}/rows")
            self.paths[table], self.files[table], self.changed[table] = folder, 0, 0
            self._show(table, held.schema)

    def _show(self, table: str, schema: StructType) -> None:
        """The table as it is: its rows, of which changed ones give way to their last version."""
        rows = self.spark.read.schema(schema).parquet(f"{self.paths[table]}/rows")
        if self.changed[table]:
            key = schema[0].name
            changes = self.spark.read.schema(StructType(schema.fields[:]).add("_version", IntegerType())).parquet(f"{self.paths[table]}/changes")
            last = changes.groupBy(key).agg(F.max_by(F.struct(*schema.names), "_version").alias("_row")).select("_row.*")
            # one row an update since the table was written, FILES at most
            rows = rows.join(F.broadcast(last.select(key)), key, "left_anti").select(*schema.names).unionByName(last)
        self.graph = self.graph.with_table(table, rows)

    def _insert(self, table: str, key: str, write, row: tuple, schema: str) -> int:
        """One row as a further file of the table, and its id."""
        self._stored(table)
        held = self.graph[table]
        last = held.orderBy(F.desc_nulls_last(key)).limit(1)  # all that a new id depends on
        before = held.agg(F.max(key)).first()[0] or 0
        new = write(self.graph.with_table(table, last), self._frame([row], schema))[table].filter(F.col(key) > before).coalesce(1)
        new.write.mode("append").parquet(f"{self.paths[table]}/rows")
        self.files[table] += 1
        self._show(table, held.schema)
        return before + 1

    def _update(self, table: str, write, row: tuple, schema: str) -> None:
        """One row changed: its new version is a further file of the table's changes."""
        self._stored(table)
        held = self.graph[table]
        one = held.filter(F.col(held.columns[0]) == row[0])
        new = write(self.graph.with_table(table, one), self._frame([row], schema))[table]
        new.withColumn("_version", F.lit(self.changed[table])).coalesce(1).write.mode("append").parquet(f"{self.paths[table]}/changes")
        self.files[table] += 1
        self.changed[table] += 1
        self._show(table, held.schema)

    def _new(self, table: str, key: str, write, row: dict, schema: str) -> int:
        return self._insert(table, key, write, tuple(row.values()), schema)

    def insert_document(self, doc_name, doc_description=None, source_path=None, doc_group=None, doc_version=1) -> int:
        row = {"doc_name": doc_name, "doc_description": doc_description, "source_path": source_path, "doc_group": doc_group, "doc_version": doc_version}
        return self._new("documents", "doc_id", writes.insert_documents, row, "doc_name string, doc_description string, source_path string, doc_group string, doc_version int")

    def insert_section(self, doc_id, node_id=None, title=None, summary=None, text_content=None, start_index=None, end_index=None, depth_level=0) -> int:
        row = {"doc_id": doc_id, "node_id": node_id, "title": title, "summary": summary or None, "text_content": text_content or None, "start_index": start_index, "end_index": end_index, "depth_level": depth_level}
        return self._new("sections", "section_id", writes.insert_sections, row, "doc_id long, node_id string, title string, summary string, text_content string, start_index int, end_index int, depth_level int")

    def upsert_entity(self, name, entity_type, description=None) -> int:
        hit = (F.col("name") == name) & F.col("entity_type").eqNullSafe(F.lit(entity_type))
        known = self.graph["entities"].filter(hit).agg(F.min("entity_id")).first()[0]
        if known is not None:
            return known
        return self._new("entities", "entity_id", writes.upsert_entities, {"name": name, "entity_type": entity_type, "description": description}, "name string, entity_type string, description string")

    def insert_hierarchy_edge(self, parent_id, child_id) -> None:
        self._insert("section_hierarchy", "edge_id", writes.insert_hierarchy_edges, (parent_id, child_id), "parent_id long, child_id long")

    def insert_mention_edge(self, section_id, entity_id, relevance="MENTIONS") -> None:
        self._insert("section_entities", "edge_id", writes.insert_mention_edges, (section_id, entity_id, relevance), "section_id long, entity_id long, relevance string")

    def insert_entity_relationship(self, source_id, target_id, relationship="RELATED_TO") -> None:
        self._insert("entity_relationships", "edge_id", writes.insert_entity_relationships, (source_id, target_id, relationship), "source_entity long, target_entity long, relationship string")

    def insert_enriched_relationship(self, source_id, target_id, relationship, confidence=0.8) -> None:
        self._insert("entity_relationships", "edge_id", writes.insert_enriched_relationships, (source_id, target_id, relationship, confidence), "source_entity long, target_entity long, relationship string, confidence double")

    def insert_entity_alias(self, canonical_id, alias_id, similarity, confirmed=0) -> None:
        self._insert("entity_aliases", "edge_id", writes.insert_entity_aliases, (canonical_id, alias_id, similarity, confirmed), "canonical_id long, alias_id long, similarity double, confirmed int")

    def update_entity_canonical(self, entity_id, canonical_id) -> None:
        self._update("entities", writes.update_entity_canonical, (entity_id, canonical_id), "entity_id long, canonical_id long")

    def update_entity_embedding(self, entity_id, embedding) -> None:
        self._update("entities", writes.update_entity_embedding, (entity_id, [float(x) for x in embedding]), "entity_id long, name_embedding array<float>")

    def insert_temporal_edge(self, source_doc_id, target_doc_id, entity_id, change_type, old_value=None, new_value=None, confidence=1.0) -> None:
        row = (source_doc_id, target_doc_id, entity_id, change_type, old_value, new_value, confidence)
        self._insert("temporal_edges", "edge_id", writes.insert_temporal_edges, row, "source_doc_id long, target_doc_id long, entity_id long, change_type string, old_value string, new_value string, confidence double")

    def create_session(self, title=None, metadata=None) -> int:
        return self._new("sessions", "session_id", writes.create_sessions, {"title": title, "metadata": metadata}, "title string, metadata string")

    def create_turn(self, session_id, turn_number, question, intent=None) -> int:
        row = {"session_id": session_id, "turn_number": turn_number, "question": question, "intent": intent}
        return self._new("turns", "turn_id", writes.create_turns, row, "session_id long, turn_number int, question string, intent string")

    def update_turn_answer(self, turn_id, answer) -> None:
        self._update("turns", writes.update_turn_answer, (turn_id, answer), "turn_id long, answer string")

    def insert_turn_entity(self, turn_id, entity_id, role="REFERENCED") -> None:
        self._insert("turn_entities", "edge_id", writes.insert_turn_entities, (turn_id, entity_id, role), "turn_id long, entity_id long, role string")

    def insert_turn_section(self, turn_id, section_id, rank_score=None) -> None:
        self._insert("turn_sections", "edge_id", writes.insert_turn_sections, (turn_id, section_id, rank_score), "turn_id long, section_id long, rank_score double")
