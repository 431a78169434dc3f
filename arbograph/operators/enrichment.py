"""What the graph lacks: entities and pairs without relationships, and the parsing of proposed ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arbograph.graph import DocumentGraph

# Relationship types in the order in which an answer is searched for them.
RELATIONSHIP_TYPES = (
    "RELATED_TO", "PART_OF", "USED_BY", "DEPENDS_ON", "COMPETES_WITH", "DERIVED_FROM",
    "LEADS", "EMPLOYED_BY", "INVESTED_IN", "REGULATES", "ACQUIRED",
)


#: Mentions of a section whose pairs one task builds; of larger sections every pair of such blocks is a task's.
BLOCK = 2_048


def isolated_entities(g: DocumentGraph, min_mentions: int = 2) -> DataFrame:
    """Entities with mentions but no relationship: an anti-join with all ends, mentions counted before it."""
    r = g["entity_relationships"]
    ends = r.select(F.col("source_entity").alias("entity_id")).union(r.select("target_entity"))
    counts = g["section_entities"].groupBy("entity_id").agg(F.count("*").alias("mention_count")).filter(F.col("mention_count") >= min_mentions)
    alone = counts.join(ends.distinct(), "entity_id", "left_anti")
    return alone.join(g["entities"].select("entity_id", "name", "entity_type"), "entity_id").select("entity_id", "name", "entity_type", "mention_count")


def cooccurring_pairs(g: DocumentGraph, min_shared: int = 2) -> DataFrame:
    """Pairs of entities that share sections and have no relationship in either direction.

    Pairs are counted by section id alone; names are joined to the few that
    pass.  The edges' two directions are folded into one key.  A section with many
    mentions is cut into blocks by a hash of their entities, and blocks meet in pairs.
    """
    m = g["section_entities"].select("section_id", "entity_id").distinct()
    # of the sections with more mentions than a block, how many blocks they have
    cut = g["section_entities"].groupBy("section_id").agg(F.ceil(F.count("*") / BLOCK).alias("blocks")).filter("blocks > 1")
    m = m.join(cut, "section_id", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own, every = F.pmod(F.xxhash64("entity_id"), F.col("blocks")), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    pairs = (
        m.select("section_id", F.col("entity_id").alias("entity1_id"), own.alias("block1"), every.alias("block2"))
        .join(m.select("section_id", F.col("entity_id").alias("entity2_id"), every.alias("block1"), own.alias("block2")), ["section_id", "block1", "block2"])
        .filter("entity1_id < entity2_id").groupBy("entity1_id", "entity2_id").agg(F.count("*").alias("shared_sections"))
        .filter(F.col("shared_sections") >= min_shared)
    )
    r = g["entity_relationships"]
    linked = r.select(F.least("source_entity", "target_entity").alias("entity1_id"), F.greatest("source_entity", "target_entity").alias("entity2_id")).distinct()
    found = pairs.join(linked, ["entity1_id", "entity2_id"], "left_anti")
    for k in (1, 2):
        named = g["entities"].select(F.col("entity_id").alias(f"entity{k}_id"), F.col("name").alias(f"entity{k}_name"), F.col("entity_type").alias(f"entity{k}_type"))
        found = found.join(named, f"entity{k}_id")
    return found.select("entity1_id", "entity1_name", "entity1_type", "entity2_id", "entity2_name", "entity2_type", "shared_sections")


def parse_relationship(answer: Column) -> Column:
    """The first type, in their fixed order, that an answer contains; null for none."""
    upper = F.upper(F.trim(answer))
    return F.when(upper == "NONE", None).otherwise(F.get(F.filter(F.array(*map(F.lit, RELATIONSHIP_TYPES)), lambda t: F.contains(upper, t)), F.lit(0)))


def enrichment_stats(g: DocumentGraph) -> DataFrame:
    """Edges by relationship and where they come from."""
    return g["entity_relationships"].groupBy("relationship", F.coalesce("edge_source", F.lit("EXTRACTION")).alias("edge_source")).agg(F.count("*").alias("n"))


def entity_type_distribution(g: DocumentGraph) -> DataFrame:
    return g["entities"].groupBy("entity_type").agg(F.count("*").alias("n"))


def entities_by_type_sample(g: DocumentGraph, size: int = 5) -> DataFrame:
    """The first names of each type, and how many more there are; no group is collected whole."""
    place = Window.partitionBy("entity_type").orderBy("name", "entity_id")
    ranked = g["entities"].withColumn("k", F.row_number().over(place)).filter(F.col("k") <= size)
    names = ranked.groupBy("entity_type").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "name"))), lambda x: x["name"]), ", ").alias("names"))
    return names.join(entity_type_distribution(g), "entity_type").select("entity_type", "names", F.greatest(F.col("n") - size, F.lit(0)).alias("more"))


def doc_group_versions(g: DocumentGraph) -> DataFrame:
    return g["documents"].filter("doc_group is not null").groupBy("doc_group").agg(F.array_join(F.transform(F.sort_array(F.collect_set("doc_version")), lambda x: x.cast("string")), ",").alias("versions"))
