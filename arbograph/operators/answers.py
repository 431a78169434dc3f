"""From questions to answers: what each intent reads, what is tried when it finds nothing, and what a turn leaves behind.

Questions are (question_id, question, intent) and their names (question_id,
ord, name); all go through one plan.  A question without names and one without
sections end early, with a line that says so.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arbograph.functions import models
from arbograph.functions.text import empty_as_null, estimated_tokens
from arbograph.graph import DocumentGraph, conform
from arbograph.operators import hierarchy, patterns, retrieval, sessions, writes
from arbograph.session import materialise

# Answers to questions that end early, and lines of a context; {} is a value's place.
NO_NAMES = "I could not extract any concepts from the question. Please rephrase."
NO_SECTIONS = "No relevant information found in the knowledge graph for the given question. Try rephrasing or using different terms."
FAILED = "An error occurred while the answer was made."
CONCEPTS, CONCEPT, RELATED = "## Related Concepts\n", "- **{}** ({}) — _{}_", "RELATED_TO"

#: Sections of a name in the first fallback, characters of a question, of a session's title, and tokens kept free for concepts.
FALLBACK_SECTIONS, QUESTION_CHARS, TITLE_CHARS, SPARE = 10, 5_000, 100, 200
CONTEXT_TOKENS = 12_000

HIT = ("question_id", "step", "entity_ord", "top", "level", "section_id", "relevance")


def _hierarchical(intent: str = "intent"):
    return F.coalesce(F.col(intent) == "HIERARCHICAL", F.lit(False))


def intent_sections(g: DocumentGraph, resolved: DataFrame) -> DataFrame:
    """Sections that each intent reads: neighbourhoods, or mentioning sections with all below them."""
    near = resolved.filter(~_hierarchical()).select("question_id", "ord", "entity_id")
    near = near.join(patterns.neighborhood_sections(g, near.select("entity_id")), "entity_id").select(
        "question_id", F.lit(1).alias("step"), F.col("ord").alias("entity_ord"), F.col("section_id").alias("top"), F.lit(0).alias("level"), "section_id", "relevance"
    )
    m = g["section_entities"].groupBy("entity_id", "section_id").agg(F.min("relevance").alias("relevance"))
    own = resolved.filter(_hierarchical()).select("question_id", "ord", "entity_id").join(m, "entity_id").select(
        "question_id", F.lit(1).alias("step"), F.col("ord").alias("entity_ord"), F.col("section_id").alias("top"), F.lit(0).alias("level"), "section_id", "relevance"
    )
    below = hierarchy.section_descendants(g, own.select(F.col("section_id").alias("start"))).select(F.col("start").alias("top"), F.col("section_id").alias("child"), "tree_level")
    lower = own.join(below, "top").select("question_id", "step", "entity_ord", "top", F.col("tree_level").alias("level"), F.col("child").alias("section_id"), F.lit(None).cast("string").alias("relevance"))
    return near.unionByName(own).unionByName(lower)


def _without(questions: DataFrame, hits: DataFrame) -> DataFrame:
    return questions.join(hits.select("question_id").distinct(), "question_id", "left_anti")


def named_sections(g: DocumentGraph, resolved: DataFrame, limit: int = FALLBACK_SECTIONS) -> DataFrame:
    """The first sections that mention an entity whose name contains a resolved one's."""
    keyed = resolved.select("question_id", "ord", F.lower("entity_name").alias("key"))
    same = retrieval.containing(g["entities"].select("entity_id", F.lower("name").alias("low")), keyed.select("key").distinct())
    rows = same.join(g["section_entities"].select("entity_id", "section_id", "relevance"), "entity_id").join(g["sections"].select("section_id", "start_index"), "section_id")
    order = Window.partitionBy("key").orderBy(F.col("start_index").asc_nulls_last(), "section_id", "entity_id")
    first = rows.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= limit)
    return keyed.join(first, "key").select(
        "question_id", F.lit(2).alias("step"), F.col("ord").alias("entity_ord"), F.col("k").cast("long").alias("top"), F.lit(0).alias("level"), "section_id", "relevance"
    )


def titled_sections(g: DocumentGraph, names: DataFrame) -> DataFrame:
    """Sections whose titles contain one of a question's names, in the order of documents and pages."""
    s = g["sections"].select("section_id", "doc_id", "start_index", F.lower("title").alias("low")).filter("low is not null")
    keyed = names.select("question_id", F.lower("name").alias("key")).filter("key is not null")
    titles = s.groupBy("low").agg(F.min("section_id").alias("entity_id"))
    met = retrieval.containing(titles, keyed.select("key").distinct()).join(titles, "entity_id").select("key", "low")
    found = keyed.join(met, "key").select("question_id", "low").distinct().join(s, "low")
    place = F.row_number().over(Window.partitionBy("question_id").orderBy("doc_id", F.col("start_index").asc_nulls_last(), "section_id"))
    return found.select("question_id", F.lit(3).alias("step"), F.lit(0).alias("entity_ord"), place.cast("long").alias("top"), F.lit(0).alias("level"), "section_id", F.lit(None).cast("string").alias("relevance"))


def section_hits(g: DocumentGraph, questions: DataFrame, names: DataFrame, resolved: DataFrame) -> DataFrame:
    """(question_id, ord, section_id, title, relevance, step) of every question, each section once.

    ``step`` says what found it: 1 the intent, 2 sections of entities with such
    names, for questions that have none yet, 3 titles, for those that still
    have none.  ``resolved`` are names with their entities and the intent.
    """
    resolved = materialise(resolved, "resolved")  # every step reads it
    hits = materialise(intent_sections(g, resolved).select(*HIT), "hits")
    more = materialise(named_sections(g, _without(resolved, hits)).select(*HIT), "hits")
    hits = hits.unionByName(more)
    left = _without(names.join(questions.select("question_id"), "question_id", "left_semi"), hits)
    hits = hits.unionByName(materialise(titled_sections(g, left).select(*HIT), "hits"))
    order = F.struct("entity_ord", "top", "level", F.coalesce("relevance", F.lit("")))
    first = hits.groupBy("question_id", "section_id").agg(F.min(F.struct(order.alias("o"), "relevance", "step")).alias("f"))
    place = Window.partitionBy("question_id").orderBy("f.o", "section_id")
    first = first.withColumn("ord", F.row_number().over(place))
    return first.join(g["sections"].select("section_id", "title"), "section_id").select("question_id", "ord", "section_id", "title", "f.relevance", "f.step")


def related_entities(g: DocumentGraph, resolved: DataFrame) -> DataFrame:
    """(question_id, ord, entity_id, name, entity_type, relationship) that the questions' entities lead to, each once.

    Co-mentioned ones for all intents but HIERARCHICAL, and for EXPLORATION
    (TEMPORAL and unknown intents too) those one and two relationships away.
    """
    own = resolved.filter(~_hierarchical()).select("question_id", F.col("ord").alias("entity_ord"), "entity_id", "intent")
    near = own.join(patterns.neighborhood_entities(g, own.select("entity_id")), "entity_id").select(
        "question_id", F.struct("entity_ord", F.lit(0).alias("hops"), F.col("co_entity_id").alias("id"), F.lit("").alias("r")).alias("ord"), F.col("co_entity_id").alias("entity_id"), "name", "entity_type", F.lit(RELATED).alias("relationship")
    )
    far = own.filter(~F.coalesce(F.col("intent").isin("LOOKUP", "COMPARISON", "RELATIONSHIP"), F.lit(False))).select("question_id", "entity_ord", F.col("entity_id").alias("start_id"))
    far = far.join(patterns.multi_hop_entities(g, 2, far.select(F.col("start_id").alias("entity_id"))), "start_id").select(
        "question_id", F.struct("entity_ord", "hops", F.col("entity_id").alias("id"), F.coalesce("relationship", F.lit("")).alias("r")).alias("ord"), "entity_id", "name", "entity_type", F.coalesce("relationship", F.lit(RELATED)).alias("relationship")
    )
    found = retrieval.dedupe_related(near.unionByName(far))
    return found.withColumn("ord", F.row_number().over(Window.partitionBy("question_id").orderBy("ord")))


def concepts_part(g: DocumentGraph, related: DataFrame, parts: DataFrame, budget: int = CONTEXT_TOKENS) -> DataFrame:
    """(question_id, ord, text): related entities after the sections ``parts``, while the budget isn't used up and some is to spare."""
    used = parts.groupBy("question_id").agg((F.lit(8) + F.sum(F.coalesce("tokens", F.lit(0)))).alias("used")).filter(F.col("used") < budget - SPARE)
    before, between, after, end = CONCEPT.split("{}")
    entry = F.concat(F.lit(before), F.coalesce("name", F.lit("")), F.lit(between), F.coalesce("entity_type", F.lit("")), F.lit(after), "relationship", F.lit(end))
    described = related.join(g["entities"].select("entity_id", "description"), "entity_id", "left")
    rows = described.join(used, "question_id").withColumn("text", F.concat(entry, F.when(empty_as_null(F.col("description")).isNotNull(), F.concat(F.lit(": "), "description")).otherwise("")))
    order = Window.partitionBy("question_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.col("used") + F.coalesce(F.sum(estimated_tokens(F.col("text"))).over(order), F.lit(0))).filter(F.col("before") < budget)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"])
    return rows.groupBy("question_id").agg(F.concat(F.lit(CONCEPTS + "\n"), F.array_join(lines, "\n"), F.lit("\n")).alias("text")).select("question_id", F.lit(2**31 - 1).alias("ord"), "text")


@dataclass(frozen=True)
class Answers:
    """What questions led to: their entities, sections with texts, related entities, and answers (question_id, question, intent, outcome, answer)."""

    resolved: DataFrame
    sections: DataFrame
    related: DataFrame
    answers: DataFrame


def answer(g: DocumentGraph, questions: DataFrame, names: DataFrame, client=None, budget: int = CONTEXT_TOKENS, extra: DataFrame | None = None) -> Answers:
    """The whole path for a batch of questions; ``extra`` are entities (question_id, ord, name) known from before.

    ``outcome`` is answered, no names or no sections.
    """
    questions = questions.select("question_id", F.substring(F.coalesce("question", F.lit("")), 1, QUESTION_CHARS).alias("question"), "intent")
    names = names.select("question_id", "ord", "name").filter("name is not null and name <> ''")
    asked = questions.join(names.select("question_id").distinct().withColumn("named", F.lit(True)), "question_id", "left")
    known = names if extra is None else names.unionByName(extra.join(names.select("question_id").distinct(), "question_id", "left_semi"))
    resolved = materialise(retrieval.resolve_entity_names(g, known).join(questions.select("question_id", "intent"), "question_id"), "resolved")
    hits = section_hits(g, questions, names, resolved)
    full = materialise(retrieval.hydrate_sections(g, hits.drop("step")), "sections")
    related = materialise(related_entities(g, resolved), "related")
    parts = retrieval.context_budget(full, budget).select("question_id", "ord", "text", "tokens")
    texts = retrieval.context(parts.drop("tokens").unionByName(concepts_part(g, related, parts, budget)))
    found = full.select("question_id").distinct().withColumn("found", F.lit(True))
    asked = asked.join(found, "question_id", "left").join(texts, "question_id", "left")
    outcome = F.when(F.col("named").isNull(), "no names").when(F.col("found").isNull(), "no sections").otherwise("answered")
    asked = asked.select("question_id", "question", "intent", outcome.alias("outcome"), "context")
    told = models.answers(asked.filter("outcome = 'answered'"), F.concat("question", F.lit("\n\n"), F.coalesce("context", F.lit(""))), client or models.FirstSentence(), default=FAILED)
    early = asked.filter("outcome <> 'answered'").withColumn("answer", F.when(F.col("outcome") == "no names", NO_NAMES).otherwise(NO_SECTIONS))
    columns = ["question_id", "question", "intent", "outcome", "answer"]
    return Answers(resolved, full, related, told.select(columns).unionByName(early.select(columns)))


def ask(g: DocumentGraph, questions: DataFrame, names: DataFrame, client=None, budget: int = CONTEXT_TOKENS) -> tuple[DocumentGraph, Answers, DataFrame]:
    """Questions with a ``session_id`` (null for a new session) as turns of their sessions.

    Entities of a session's latest turn join those of the question; sessions,
    turns, their entities with roles, sections with ranks, and answers are
    added to the graph.  Questions of one session in one batch follow each
    other by question_id and all see the turn before the batch.  Gives the
    graph, the answers, and each question's session and turn.
    """
    own = questions.select("question_id", "session_id", F.substring(F.coalesce("question", F.lit("")), 1, QUESTION_CHARS).alias("question"), "intent")
    new = writes.allocate_ids(g["sessions"], own.filter("session_id is null").select("question_id", F.substring("question", 1, TITLE_CHARS).alias("title")), "session_id", ["title", "question_id"])
    new = materialise(new.withColumn("started_at", F.current_timestamp()), "sessions")
    before = g
    g = g.with_table("sessions", g["sessions"].unionByName(conform(new, "sessions")))
    own = own.filter("session_id is not null").unionByName(own.drop("session_id").join(new.select("question_id", "session_id"), "question_id").select(own.columns))
    had = before["turns"].groupBy("session_id").agg(F.count("*").alias("had"))
    place = F.row_number().over(Window.partitionBy("session_id").orderBy("question_id"))
    turns = own.join(had, "session_id", "left").withColumn("turn_number", (F.coalesce("had", F.lit(0)) + place).cast("int")).withColumn("created_at", F.current_timestamp())
    turns = materialise(writes.allocate_ids(before["turns"], turns, "turn_id", ["session_id", "turn_number"]), "turns")

    first = retrieval.resolve_entity_names(before, names.join(turns.select("question_id"), "question_id", "left_semi"))
    resolved = first.join(turns.select("question_id", "session_id"), "question_id").select(F.col("question_id").alias("session_id"), F.col("entity_name").alias("name"))
    latest = sessions.latest_turns(before).join(turns.select("question_id", "session_id"), "session_id").select("question_id", "turn_id")
    primary = latest.join(before["turn_entities"].filter("role = 'PRIMARY'").select("turn_id", "entity_id"), "turn_id").join(before["entities"].select("entity_id", "name"), "entity_id")
    known = resolved.select(F.col("session_id").alias("question_id"), F.lower("name").alias("key")).distinct()
    extra = primary.withColumn("key", F.lower("name")).join(known, ["question_id", "key"], "left_anti")
    extra = extra.select("question_id", (F.lit(10**6) + F.row_number().over(Window.partitionBy("question_id").orderBy("name", "entity_id"))).alias("ord"), "name")

    found = answer(before, turns.select("question_id", "question", "intent"), names, client, budget, materialise(extra, "extra"))
    told = materialise(found.answers, "answers")
    found = Answers(found.resolved, found.sections, found.related, told)
    ids = turns.select("question_id", "session_id", "turn_id", "turn_number")
    rows = turns.drop("answer").join(told.select("question_id", "answer"), "question_id")
    g = g.with_table("turns", before["turns"].unionByName(conform(rows, "turns")))
    done = told.filter("outcome = 'answered'").join(ids.select("question_id", "turn_id"), "question_id").select("question_id", "turn_id")
    roles = done.join(found.resolved.select("question_id", "ord", "entity_id"), "question_id").select("turn_id", "entity_id", F.lit("PRIMARY").alias("role"), "ord")
    roles = roles.unionByName(done.join(found.related, "question_id").select("turn_id", "entity_id", F.lit("REFERENCED").alias("role"), "ord"))
    g = writes.insert_turn_entities(g, materialise(sessions.turn_entity_roles(roles), "roles"))
    used = sessions.turn_section_rank(done.join(found.sections.select("question_id", "section_id", "ord"), "question_id").select("turn_id", "section_id", "ord"))
    return writes.insert_turn_sections(g, materialise(used, "ranks")), found, ids
