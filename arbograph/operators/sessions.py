"""Sessions, their turns, and the context that the latest turn leaves."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arbograph.graph import DocumentGraph
from arbograph.operators.reads import all_entities


def list_sessions(g: DocumentGraph) -> DataFrame:
    return g["sessions"].orderBy(F.col("started_at").desc_nulls_first(), "session_id")


def session_turns(g: DocumentGraph) -> DataFrame:
    place = Window.partitionBy("session_id").orderBy(F.col("turn_number").asc_nulls_last(), "turn_id")
    return g["turns"].withColumn("ord", F.row_number().over(place))


def turn_numbers(turns: DataFrame) -> DataFrame:
    """Numbers turns (session_id, turn_id) of each session from 1."""
    return turns.withColumn("turn_number", F.row_number().over(Window.partitionBy("session_id").orderBy("turn_id")))


def latest_turns(g: DocumentGraph) -> DataFrame:
    return g["turns"].filter("turn_number is not null").groupBy("session_id").agg(F.max_by("turn_id", F.struct("turn_number", -F.col("turn_id"))).alias("turn_id"))


def session_context(g: DocumentGraph) -> DataFrame:
    """Of each session's latest turn the primary entities, by name, and the sections, best first."""
    last = latest_turns(g)
    named = g["entities"].select("entity_id", "name")
    primary = last.join(g["turn_entities"].filter("role = 'PRIMARY'").select("turn_id", "entity_id"), "turn_id").join(named, "entity_id")
    primary = primary.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("name", "entity_id"))).alias("p"))
    used = last.join(g["turn_sections"].select("turn_id", "section_id", "rank_score"), "turn_id")
    used = used.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("rank_score")).alias("r"), "section_id"))).alias("s"))
    text = lambda a, f: F.coalesce(F.array_join(F.transform(a, lambda x: x[f].cast("string")), ","), F.lit(""))
    return last.join(primary, "session_id", "left").join(used, "session_id", "left").select("session_id", "turn_id", text("p", "name").alias("primary_entities"), text("s", "section_id").alias("previous_sections"))


def session_supplement(g: DocumentGraph, resolved: DataFrame) -> DataFrame:
    """Primary entities of the latest turn whose names ``resolved`` (session_id, name) lacks, ignoring case."""
    last = latest_turns(g).join(g["turn_entities"].filter("role = 'PRIMARY'").select("turn_id", "entity_id"), "turn_id")
    names = last.join(all_entities(g).select("entity_id", "name"), "entity_id").select("session_id", "entity_id", "name", F.lower("name").alias("key"))
    known = resolved.select("session_id", F.lower("name").alias("key")).distinct()
    return names.join(known, ["session_id", "key"], "left_anti").select("session_id", "entity_id", "name")


def turn_entity_roles(found: DataFrame) -> DataFrame:
    """Of (turn_id, entity_id, role, ord) one row an entity: PRIMARY before REFERENCED; ids 0 and null are skipped."""
    rank = F.when(F.col("role") == "PRIMARY", 0).otherwise(1)
    first = Window.partitionBy("turn_id", "entity_id").orderBy(rank, "ord")
    return found.filter("entity_id <> 0").withColumn("k", F.row_number().over(first)).filter("k = 1").select("turn_id", "entity_id", "role")


def turn_section_rank(found: DataFrame) -> DataFrame:
    """rank_score 1.0, 0.9, ... of (turn_id, section_id, ord) by place; below zero from the twelfth on."""
    place = F.row_number().over(Window.partitionBy("turn_id").orderBy("ord", "section_id"))
    return found.withColumn("rank_score", F.round(1.0 - 0.1 * (place - 1), 6)).filter("section_id <> 0").select("turn_id", "section_id", "rank_score")
