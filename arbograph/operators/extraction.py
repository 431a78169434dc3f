"""Steps that ask a language model, with the checks before and after it; prompts are columns, answers are parsed as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbograph.functions import models
from arbograph.functions.text import empty_as_null, page_tag, physical_index, repaired_json
from arbograph.graph import DocumentGraph
from arbograph.operators import enrichment, prompts, reads, retrieval
from arbograph.operators.prompts import prompt as _prompt
from arbograph.operators.structure import page_groups
from arbograph.schema import ENTITY_TYPES, INTENTS, RELEVANCES

MAX_QUESTION, MAX_TEXT, MAX_SHARED, MAX_NAMES = 5000, 4000, 2000, 50


def classify_intents(questions: DataFrame, client: models.Client) -> DataFrame:
    """(question_id, question) with intent and entities; unknown intents and failures explore without entities."""
    task = f"Name the intent of the question, one of {', '.join(INTENTS)}, and the entities in it, as JSON with the keys intent and entities."
    rows = models.answers(questions, _prompt(task, F.substring("question", 1, MAX_QUESTION)), client)
    read = F.from_json(repaired_json(F.col("answer")), "intent string, entities array<string>")
    intent = F.upper(read["intent"])
    return rows.select(*questions.columns, F.when(intent.isin(*INTENTS), intent).otherwise("EXPLORATION").alias("intent"), F.coalesce(read["entities"], F.array().cast("array<string>")).alias("entities"))


ENTITIES = "array<struct<name:string,type:string,relevance:string>>"
_KINDS = f"type (one of {', '.join(ENTITY_TYPES)}) and relevance (one of {', '.join(RELEVANCES)})"


def extract_entities(sections: DataFrame, client: models.Client, max_chars: int = MAX_TEXT, size: int = 1, whole: bool = False) -> DataFrame:
    """(section_id, name, type, relevance) that a model finds in each section's summary or text.

    With ``size`` > 1 so many sections of a document are sent in one prompt, and
    those that its answer leaves out, or with ``whole`` all of these, are asked for
    one by one.
    """
    task = f"List the entities in the text as a JSON array of objects with name, {_KINDS}."
    text = F.substring(F.coalesce(empty_as_null(F.col("summary")), F.col("text_content"), F.lit("")), 1, max_chars)
    if size == 1:
        rows = models.answers(sections.select("section_id", text.alias("text")).filter("text <> ''"), _prompt(task, F.col("text")), client)
        found = rows.select("section_id", repaired_json(F.col("answer")).alias("value"))
    else:
        many = f"List the entities in each of these sections as a JSON array of objects with section_index and entities, an array of objects with name, {_KINDS}."
        rows = sections.select("section_id", "doc_id", F.coalesce("title", F.lit("")).alias("title"), text.alias("text"))
        found = prompts.batched(rows, client, many, _prompt(task, F.col("text")), ["title", "text"], "section_index", "entities", size, whole=whole)
    entities = F.coalesce(F.from_json("value", ENTITIES), F.array().cast(ENTITIES))
    return retrieval.validate_entities(found.select("section_id", entities.alias("entities")))


def extract_relationships(entities: DataFrame, client: models.Client) -> DataFrame:
    """(doc_id, source, target, relationship) among each document's first entities (doc_id, name, type, ord)."""
    listed = entities.withColumn("k", F.row_number().over(_by_document())).filter(F.col("k") <= MAX_NAMES)
    names = listed.groupBy("doc_id").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "name", "type"))), lambda x: F.concat(x["name"], F.lit(" ("), x["type"], F.lit(")"))), "\n").alias("names"))
    task = f"Name relationships between these entities as a JSON array of objects with source, target and relationship, one of {', '.join(enrichment.RELATIONSHIP_TYPES[:6])}."
    rows = models.answers(names.filter("n >= 2").select("doc_id", "names"), _prompt(task, F.col("names")), client)
    found = rows.select("doc_id", F.explode(F.from_json(repaired_json(F.col("answer")), "array<struct<source:string,target:string,relationship:string>>")).alias("r"))
    return retrieval.validate_relationships(found.select("doc_id", "r.source", "r.target", F.upper(F.trim("r.relationship")).alias("relationship")))


def _by_document():
    from pyspark.sql import Window

    return Window.partitionBy("doc_id").orderBy("ord", "name", "type")


def enrich(g: DocumentGraph, client: models.Client, min_shared: int = 2, limit: int | None = 50) -> DataFrame:
    """(source_entity, target_entity, relationship, confidence) that a model sees for co-occurring pairs.

    The pairs that share most sections come first; each is shown with at most
    three sections' texts.
    """
    pairs = enrichment.cooccurring_pairs(g, min_shared)
    if limit is not None:
        pairs = pairs.orderBy(F.desc("shared_sections"), "entity1_id", "entity2_id").limit(limit)
    texts = reads.shared_section_text(g, pairs)
    shown = pairs.join(texts, ["entity1_id", "entity2_id"], "left").select("entity1_id", "entity2_id", "entity1_name", "entity2_name", F.substring(F.coalesce("text", F.lit("")), 1, MAX_SHARED).alias("text"))
    task = f"Which relationship holds between the two entities in the text? Answer with one of {', '.join(enrichment.RELATIONSHIP_TYPES)} or NONE."
    rows = models.answers(shown, _prompt(task, F.concat("entity1_name", F.lit(" / "), "entity2_name"), F.col("text")), client, default="NONE")
    found = rows.withColumn("relationship", enrichment.parse_relationship(F.col("answer"))).filter("relationship is not null")
    return found.select(F.col("entity1_id").alias("source_entity"), F.col("entity2_id").alias("target_entity"), "relationship", F.lit(0.8).alias("confidence"))


def confirm(candidates: DataFrame, names: DataFrame, client: models.Client) -> DataFrame:
    """(probe_id, entity_id) of candidates in doubt that a model takes for the same entity."""
    named = lambda key, as_: names.select(F.col("entity_id").alias(key), F.col("name").alias(as_))
    rows = candidates.select("probe_id", "entity_id").join(named("probe_id", "a"), "probe_id").join(named("entity_id", "b"), "entity_id")
    answered = models.answers(rows, _prompt("Are these the same entity? Answer YES or NO.", F.col("a"), F.col("b")), client)
    return answered.filter(F.contains(F.upper("answer"), F.lit("YES"))).select("probe_id", "entity_id")


def extract_contents(pages: DataFrame, client: models.Client, max_tokens: int = 20_000) -> DataFrame:
    """A table of contents (doc_id, ord, structure, title, physical_index) from groups of tagged pages, in their order.

    Documents without any entry get one section a page.
    """
    groups = page_groups(pages, max_tokens)
    rows = groups.select("doc_id", "group_no", F.explode(F.sequence("first_page", "last_page")).alias("page_no")).join(pages.select("doc_id", "page_no", "text"), ["doc_id", "page_no"])
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_no", page_tag(F.col("page_no"), F.col("text")).alias("text")))), lambda x: x["text"]), "\n")
    shown = rows.groupBy("doc_id", "group_no").agg(text.alias("text"))
    task = "List the sections of the text as a JSON array of objects with structure (like 1.2), title and physical_index (the tag of the page where it starts)."
    answered = models.answers(shown, _prompt(task, F.col("text")), client)
    entries = answered.select("doc_id", "group_no", F.posexplode(F.from_json(repaired_json(F.col("answer")), "array<struct<structure:string,title:string,physical_index:string>>")).alias("k", "e"))
    entries = entries.select("doc_id", (F.col("group_no") * 100_000 + F.col("k")).alias("ord"), "e.structure", "e.title", physical_index(F.col("e.physical_index")).alias("physical_index")).filter("title is not null")
    none = pages.join(entries.select("doc_id").distinct(), "doc_id", "left_anti")
    fallback = none.select("doc_id", F.col("page_no").alias("ord"), F.col("page_no").cast("string").alias("structure"), F.concat(F.lit("Page "), "page_no").alias("title"), F.col("page_no").cast("int").alias("physical_index"))
    return entries.unionByName(fallback)
