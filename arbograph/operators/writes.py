"""Writes: each takes rows and gives a graph with other tables; ids follow a stable order of the new rows.

Tables are immutable, so an update is a join with the changed values, and a
graph is stored by ``DocumentGraph.write`` to a folder of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arbograph.graph import DocumentGraph, conform
from arbograph.runlog import counted
from arbograph.schema import SCHEMAS


def allocate_ids(existing: DataFrame, rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``rows`` with ids that follow the largest of ``existing``, in ``order``.

    New rows are ranked within parts by a hash of their order and the parts'
    sizes added up, so no single task sees all of them.  The largest id is read
    at once: were it part of the plan, each write would double the plan.
    """
    spark = rows.sparkSession
    start = existing.agg(F.max(key)).first()[0] or 0
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parted = rows.withColumn("_h", F.xxhash64(*order)).withColumn("_p", F.pmod("_h", F.lit(n)))
    sizes = parted.groupBy("_p").count()
    before = sizes.select("_p", F.coalesce(F.sum("count").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # n rows
    place = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    out = parted.join(F.broadcast(before), "_p").withColumn(key, F.lit(start) + F.col("_before") + place)
    return out.drop("_h", "_p", "_before")


def _append(g: DocumentGraph, table: str, rows: DataFrame, key: str, order: list[str], defaults: dict | None = None) -> DocumentGraph:
    for name, value in (defaults or {}).items():
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(value))
        else:
            rows = rows.withColumn(name, F.coalesce(F.col(name), F.lit(value)))
    new = allocate_ids(g[table], rows.drop(key) if key in rows.columns else rows, key, order)
    return g.with_table(table, g[table].unionByName(counted(conform(new, table), "rows_out")))


def insert_documents(g, rows):
    """(doc_name, doc_description, source_path[, doc_group, doc_version]); version 1 by default, stamped now."""
    return _append(g, "documents", rows.withColumn("created_at", F.current_timestamp()), "doc_id", ["doc_name"], {"doc_version": 1})


def insert_sections(g, rows):
    """Titles are cut after 4000 characters; the empty string is null, as for all texts."""
    title = F.substring(F.coalesce("title", F.lit("")), 1, 4000)
    rows = rows.withColumn("title", F.nullif(title, F.lit("")))
    return _append(g, "sections", rows, "section_id", ["doc_id", "start_index", "title"], {"depth_level": 0})


def upsert_entities(g, rows):
    """(name, entity_type, description): new (name, type) pairs, exact and with their first description, are added."""
    first = rows.withColumn("_o", F.monotonically_increasing_id() if "ord" not in rows.columns else F.col("ord"))
    distinct = first.groupBy("name", "entity_type").agg(F.min_by("description", "_o").alias("description"))
    known = g["entities"].select("name", "entity_type")
    same = (F.col("n.name") == F.col("k.name")) & F.col("n.entity_type").eqNullSafe(F.col("k.entity_type"))
    new = distinct.alias("n").join(known.alias("k"), same, "left_anti")
    return _append(g, "entities", new, "entity_id", ["name", "entity_type"])


def insert_hierarchy_edges(g, rows):
    return _append(g, "section_hierarchy", rows, "edge_id", ["parent_id", "child_id"])


def insert_mention_edges(g, rows):
    return _append(g, "section_entities", rows, "edge_id", ["section_id", "entity_id"], {"relevance": "MENTIONS"})


def insert_entity_relationships(g, rows):
    return _append(g, "entity_relationships", rows, "edge_id", ["source_entity", "target_entity"], {"relationship": "RELATED_TO", "edge_source": "EXTRACTION", "confidence": 1.0})


def insert_enriched_relationships(g, rows):
    return _append(g, "entity_relationships", rows.withColumn("edge_source", F.lit("ENRICHMENT")), "edge_id", ["source_entity", "target_entity"], {"confidence": 0.8})


def insert_entity_aliases(g, rows):
    return _append(g, "entity_aliases", rows, "edge_id", ["canonical_id", "alias_id"], {"confirmed": 0})


def insert_temporal_edges(g, rows):
    return _append(g, "temporal_edges", rows, "edge_id", ["source_doc_id", "target_doc_id", "entity_id", "change_type"], {"confidence": 1.0})


def create_sessions(g, rows):
    return _append(g, "sessions", rows.withColumn("started_at", F.current_timestamp()), "session_id", ["title"])


def create_turns(g, rows):
    return _append(g, "turns", rows.withColumn("created_at", F.current_timestamp()), "turn_id", ["session_id", "turn_number"])


def insert_turn_entities(g, rows):
    return _append(g, "turn_entities", rows, "edge_id", ["turn_id", "entity_id"], {"role": "REFERENCED"})


def insert_turn_sections(g, rows):
    return _append(g, "turn_sections", rows, "edge_id", ["turn_id", "section_id"])


def _update(g: DocumentGraph, table: str, rows: DataFrame, key: str, column: str) -> DocumentGraph:
    """Sets ``column`` where ``rows`` (key, column) has the key; of several values the largest."""
    values = rows.groupBy(key).agg(F.max(column).alias("_new"), F.lit(True).alias("_hit"))
    kind = dict(g[table].dtypes)[column]
    changed = g[table].join(values, key, "left").withColumn(column, F.when(F.col("_hit"), F.col("_new").cast(kind)).otherwise(F.col(column)))
    return g.with_table(table, conform(changed, table))


def update_entity_canonical(g, rows):
    return _update(g, "entities", rows, "entity_id", "canonical_id")


def update_entity_embedding(g, rows):
    return _update(g, "entities", rows.withColumn("name_embedding", F.col("name_embedding").cast("array<float>")), "entity_id", "name_embedding")


def update_turn_answer(g, rows):
    return _update(g, "turns", rows, "turn_id", "answer")


def empty_graph(spark) -> DocumentGraph:
    return DocumentGraph(spark, {name: spark.createDataFrame([], ddl) for name, ddl in SCHEMAS.items()})
