"""From questions to contexts: all questions in one plan, keyed by question_id."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arbograph.functions.text import empty_as_null, estimated_tokens, without_type_suffix
from arbograph.graph import DocumentGraph
from arbograph.operators import hierarchy, patterns
from arbograph.operators.reads import sections_by_ids
from arbograph.session import materialise

# Lines of a context, and reasons of traversal steps; {} is a name's place.
HEADING, UNTITLED, UNKNOWN = "## Relevant Document Sections\n\n", "Untitled", "Unknown"
TITLE, DOCUMENT, DEPTH, RELEVANCE, CUT = "### {}", "**Document:** {}", " | **Depth:** {}", "**Relevance:** {}", "\n[...truncated...]\n"
MENTIONED, COMPARED, REACHED = "Section mentions entity '{}'", "Comparison context for '{}'", "Multi-hop entity from '{}'"
BETWEEN, BELOW = "Path from '{}' to '{}'", "Descendant of section '{}'"

STEP = ("question_id", "entity_ord", "row_ord", "node_type", "node_id", "node_label", "edge_label", "edge_direction", "reason")


#: Runs of characters of keys that are sent to the tasks at most.
SENT_RUNS = 100_000
#: Characters of keys that are sent to the tasks with their rarest runs at most.
SENT_CHARS = 4_000_000


def _gram(text: Column, n: int):
    return lambda i: F.substring(text, i, F.lit(n))


def _grams(text: Column, sizes: tuple[int, ...]) -> Column:
    """Distinct runs of characters of the given lengths."""
    parts = [F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), _gram(text, n)) for n in sizes]
    return F.array_distinct(F.flatten(F.array(*(F.when(F.length(text) >= n, p).otherwise(F.array().cast("array<string>")) for n, p in zip(sizes, parts, strict=True)))))


def containing(names: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, entity_id, entity_name) for all names that contain a key; both in lower case.

    A key is met through its rarest run of three characters, or as a whole if it is
    shorter, by equality, so only names that share it are compared.  Of the names
    only runs that some key has leave the scan, where so many keys' runs can be
    sent to the tasks; where the keys can, no run leaves it. The names' runs are
    never sent, which Spark would do by the size of the names' files.
    """
    own = keys.filter("key <> ''").select("key", F.explode(F.when(F.length("key") >= 3, _grams(F.col("key"), (3,))).otherwise(F.array("key"))).alias("gram"))
    own = materialise(own, "grams")
    asked = own.select("gram").distinct()
    sizes = sorted(r[0] for r in own.select(F.length("gram")).distinct().collect())  # of 1, 2 and 3
    if not sizes:
        return names.select(F.col("low").alias("key"), "entity_id").filter("false")
    runs = names.select("entity_id", "low", F.explode(_grams(F.col("low"), tuple(sizes))).alias("gram"))
    if asked.limit(SENT_RUNS + 1).count() <= SENT_RUNS:
        asked = F.broadcast(asked)
    runs = runs.join(asked, "gram", "left_semi")
    counted = runs.groupBy("gram").agg(F.count("*").alias("n"))
    rarest = own.join(counted, "gram").groupBy("key").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"))
    if own.select("key").distinct().agg(F.sum(F.length("key"))).first()[0] <= SENT_CHARS:
        rarest = F.broadcast(rarest)
    else:
        runs = runs.hint("merge")
    return rarest.join(runs, "gram").filter(F.contains("low", "key")).select("key", "entity_id").distinct()


def resolve_entity_names(g: DocumentGraph, names: DataFrame) -> DataFrame:
    """For each (question_id, ord, name) the entity with the smallest id whose name contains it, ignoring case."""
    keyed = names.withColumn("key", F.lower("name"))
    e = g["entities"].select("entity_id", F.col("name").alias("entity_name"), "entity_type")
    hits = containing(e.select("entity_id", F.lower("entity_name").alias("low")), keyed.select("key").distinct())
    first = hits.groupBy("key").agg(F.min("entity_id").alias("entity_id")).join(e, "entity_id")
    return keyed.join(first, "key").select("question_id", "ord", "name", "entity_id", "entity_name", "entity_type")


def resolve_relationship_endpoints(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Ids for (ord, source, target, relationship): names as they are, lower-cased, and without a type in brackets.

    ``entities`` are (entity_id, name, ord); of several with a key the first
    counts.  Relations with an unknown end are left out.
    """
    forms = lambda c: F.array_distinct(F.array(F.col(c), F.lower(c), without_type_suffix(F.col(c)), F.lower(without_type_suffix(F.col(c)))))
    table = entities.select("entity_id", "ord", F.explode(forms("name")).alias("key")).groupBy("key").agg(F.min_by("entity_id", F.struct("ord", "entity_id")).alias("id"))
    out = relations
    for end in ("source", "target"):
        keys = out.select("ord", F.posexplode(forms(end)).alias("k", "key")).join(table, "key")
        first = keys.groupBy("ord").agg(F.min_by("id", "k").alias(f"{end}_id"))
        out = out.join(first, "ord")
    return out.select("ord", "source_id", "target_id", "relationship")


def _mention_steps(g: DocumentGraph, resolved: DataFrame, reason: Column) -> DataFrame:
    """Sections of each resolved entity's neighbourhood as traversal steps."""
    ids = resolved.select("entity_id").distinct()
    found = patterns.neighborhood_sections(g, ids)
    return resolved.join(found, "entity_id").select(
        "question_id", F.col("ord").alias("entity_ord"), F.col("section_id").alias("row_ord"), F.lit("section").alias("node_type"), F.col("section_id").alias("node_id"),
        F.coalesce("title", F.lit("")).alias("node_label"), F.lit("mentions").alias("edge_label"), F.lit("inbound").alias("edge_direction"), reason.alias("reason"),
    )


def _filled(template: str, *values: Column | str) -> Column:
    """The template with its places filled in."""
    parts = template.split("{}")
    columns = [F.lit(parts[0])]
    for value, rest in zip(values, parts[1:], strict=True):
        columns += [F.col(value) if isinstance(value, str) else value, F.lit(rest)]
    return F.concat(*columns)


def intent_lookup(g: DocumentGraph, resolved: DataFrame) -> DataFrame:
    return first_steps(_mention_steps(g, resolved, _filled(MENTIONED, "entity_name")))


def intent_comparison(g: DocumentGraph, resolved: DataFrame) -> DataFrame:
    return first_steps(_mention_steps(g, resolved, _filled(COMPARED, "entity_name")))


def intent_exploration(g: DocumentGraph, resolved: DataFrame) -> DataFrame:
    """Neighbourhoods, and entities one and two relationships away."""
    near = _mention_steps(g, resolved, _filled(MENTIONED, "entity_name"))
    hops = patterns.multi_hop_entities(g, 2, resolved.select("entity_id")).withColumnRenamed("entity_id", "node_id").withColumnRenamed("start_id", "entity_id")
    far = resolved.select("question_id", "ord", "entity_id", "entity_name").join(hops.select("entity_id", "node_id", "name", "relationship", "hops"), "entity_id").select(
        "question_id", F.col("ord").alias("entity_ord"), (F.col("node_id") + F.col("hops") * 10**12).alias("row_ord"), F.lit("entity").alias("node_type"), "node_id",
        F.col("name").alias("node_label"), F.col("relationship").alias("edge_label"), F.lit("outbound").alias("edge_direction"), _filled(REACHED, "entity_name").alias("reason"),
    )
    return first_steps(near.unionByName(far))


def intent_relationship(g: DocumentGraph, resolved: DataFrame) -> DataFrame:
    """Middle entities of two-edge paths between consecutive entities of a question."""
    following = resolved.select("question_id", (F.col("ord") - 1).alias("ord"), F.col("entity_id").alias("target_id"), F.col("entity_name").alias("to_name"))
    pairs = resolved.join(following, ["question_id", "ord"])
    pairs = pairs.withColumnRenamed("entity_id", "source_id")
    paths = patterns.entity_paths(g, pairs).select("source_id", "target_id", "mid_id", "mid_name", "r1_type")
    return first_steps(pairs.join(paths, ["source_id", "target_id"]).select(
        "question_id", F.col("ord").alias("entity_ord"), F.col("mid_id").alias("row_ord"), F.lit("entity").alias("node_type"), F.col("mid_id").alias("node_id"),
        F.col("mid_name").alias("node_label"), F.col("r1_type").alias("edge_label"), F.lit("outbound").alias("edge_direction"),
        _filled(BETWEEN, "entity_name", "to_name").alias("reason"),
    ))


def intent_hierarchical(g: DocumentGraph, resolved: DataFrame) -> DataFrame:
    """Sections that mention an entity, with all sections below them."""
    m = g["section_entities"].select("entity_id", "section_id").distinct()
    own = resolved.join(m, "entity_id").join(g["sections"].select("section_id", "title"), "section_id")
    below = hierarchy.section_descendants(g, own.select(F.col("section_id").alias("start"))).select(F.col("start").alias("top"), "section_id", "title")
    steps = own.select("question_id", "ord", F.col("section_id").alias("top"), F.col("title").alias("top_title")).join(below, "top")
    return first_steps(steps.select(
        "question_id", F.col("ord").alias("entity_ord"), F.col("section_id").alias("row_ord"), F.lit("section").alias("node_type"), F.col("section_id").alias("node_id"),
        "title", F.lit("parent_of").alias("edge_label"), F.lit("outbound").alias("edge_direction"), _filled(BELOW, "top_title").alias("reason"),
    ).withColumnRenamed("title", "node_label"))


def first_steps(steps: DataFrame) -> DataFrame:
    """Of each question's steps to a section only the first."""
    order = Window.partitionBy("question_id", "node_type", "node_id").orderBy("entity_ord", "row_ord", "reason")
    return steps.withColumn("k", F.row_number().over(order)).filter("node_type <> 'section' or k = 1").select(*STEP)


def traversal_path(steps: DataFrame) -> DataFrame:
    """Steps numbered in the order of discovery."""
    order = Window.partitionBy("question_id").orderBy("entity_ord", "row_ord", "edge_label", "reason")
    return steps.withColumn("step_number", F.row_number().over(order)).drop("entity_ord", "row_ord")


def dispatch(g: DocumentGraph, resolved: DataFrame) -> DataFrame:
    """Steps for questions of all intents (column ``intent``), one branch each; TEMPORAL and unknown ones explore."""
    strategies = {"LOOKUP": intent_lookup, "COMPARISON": intent_comparison, "RELATIONSHIP": intent_relationship, "HIERARCHICAL": intent_hierarchical}
    out = intent_exploration(g, resolved.filter(~F.coalesce(F.col("intent").isin(*strategies), F.lit(False))))
    for name, run in strategies.items():
        out = out.unionByName(run(g, resolved.filter(F.col("intent") == name)))
    return traversal_path(out)


def hydrate_sections(g: DocumentGraph, hits: DataFrame) -> DataFrame:
    """Hits (question_id, ord, section_id, title, relevance) with texts and documents; a hit's own values win unless empty."""
    full = sections_by_ids(g, hits).select("section_id", F.col("title").alias("full_title"), "summary", "text_content", "depth_level", "start_index", "doc_name")
    return hits.join(full, "section_id", "left").select(
        "question_id", "ord", "section_id", F.coalesce(empty_as_null(F.col("title")), "full_title").alias("title"), "relevance", "summary", "text_content", "depth_level", "start_index", "doc_name"
    )


def dedupe_related(related: DataFrame) -> DataFrame:
    """First of each question's related entities by id, or by name, type and relationship where there is none."""
    key = F.coalesce(F.col("entity_id").cast("string"), F.concat_ws("\x1f", F.lit("n"), F.coalesce("name", F.lit("")), F.coalesce("entity_type", F.lit("")), F.coalesce("relationship", F.lit("RELATED_TO"))))
    order = Window.partitionBy("question_id", "_key").orderBy("ord")
    return related.withColumn("_key", key).withColumn("_k", F.row_number().over(order)).filter("_k = 1").drop("_key", "_k")


def context_budget(sections: DataFrame, budget: int = 12_000, count: Callable[[Column], Column] = estimated_tokens) -> DataFrame:
    """The sections that fit a question's budget in their order, as texts, and the first that doesn't, cut.

    A section is cut to three characters for each remaining token if more than
    200 tokens remain.  Running totals replace the loop: once one section does
    not fit, no later total does.
    """
    header = 8  # tokens of the heading line
    body = F.coalesce(empty_as_null(F.col("text_content")), empty_as_null(F.col("summary")), F.lit(""))
    title, doc = F.coalesce(empty_as_null(F.col("title")), F.lit(UNTITLED)), F.coalesce("doc_name", F.lit(UNKNOWN))
    lines = F.array(
        _filled(TITLE, title),
        F.concat(_filled(DOCUMENT, doc), _filled(DEPTH, F.coalesce("depth_level", F.lit(0)).cast("string"))),
        F.when(F.coalesce("relevance", F.lit("")) != "", _filled(RELEVANCE, "relevance")),
        F.when(body != "", F.concat(F.lit("\n"), body)),
        F.lit(""),
    )
    order = Window.partitionBy("question_id").orderBy("ord")
    s = sections.withColumn("text", F.array_join(F.filter(lines, lambda x: x.isNotNull()), "\n")).withColumn("body", body)
    s = s.withColumn("tokens", count(F.col("text")))
    s = s.withColumn("used", F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0)) + header)
    s = s.withColumn("remaining", budget - (F.col("used") - F.col("tokens")))
    s = s.withColumn("fits", F.col("used") <= budget)
    s = s.withColumn("first_over", ~F.col("fits") & F.coalesce(F.lag("fits").over(order), F.lit(True)))
    cut = F.concat(_filled(TITLE, title), F.lit("\n"), _filled(DOCUMENT, doc), F.lit("\n\n"), F.expr("substring(body, 1, cast(remaining * 3 as int))"), F.lit(CUT))
    kept = s.filter("fits or (first_over and remaining > 200)")
    return kept.select("question_id", "ord", "section_id", F.when(F.col("fits"), F.col("text")).otherwise(cut).alias("text"), F.when(F.col("fits"), F.col("tokens")).alias("tokens"), (~F.col("fits")).alias("truncated"))


def context(parts: DataFrame) -> DataFrame:
    """One Markdown text a question."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), "\n")
    return parts.groupBy("question_id").agg(F.concat(F.lit(HEADING), text).alias("context"))


def answer_sources(sections: DataFrame) -> DataFrame:
    """Distinct (title, doc_name) of each question in their order, with names for missing ones."""
    named = sections.withColumn("title", F.coalesce(empty_as_null(F.col("title")), F.lit(UNTITLED))).withColumn("doc_name", F.coalesce("doc_name", F.lit(UNKNOWN)))
    return named.groupBy("question_id", "title", "doc_name").agg(F.min("ord").alias("ord"))


def validate_entities(found: DataFrame) -> DataFrame:
    """Of (section_id, entities array of name, type, relevance) the rows with a name and a type, trimmed and in upper case."""
    e = found.select("section_id", F.explode("entities").alias("e"))
    name, kind = F.trim(F.coalesce("e.name", F.lit(""))), F.upper(F.trim(F.coalesce("e.type", F.lit(""))))
    return e.filter((name != "") & (kind != "")).select("section_id", name.alias("name"), kind.alias("type"), F.upper(F.coalesce(empty_as_null(F.trim("e.relevance")), F.lit("MENTIONS"))).alias("relevance"))


def validate_relationships(found: DataFrame) -> DataFrame:
    filled = [F.coalesce(F.col(c), F.lit("")) != "" for c in ("source", "target", "relationship")]
    return found.filter(filled[0] & filled[1] & filled[2])


def extract_entities(sections: DataFrame, terms: DataFrame, max_chars: int = 4000) -> DataFrame:
    """Entities by a dictionary: single-word ``terms`` (name, type) that a section's summary or text holds.

    Words are exploded and joined on equality, so the dictionary may be large.
    """
    text = F.substring(F.coalesce(empty_as_null(F.col("summary")), F.col("text_content"), F.lit("")), 1, max_chars)
    words = sections.select("section_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"(\w+)"), F.lit(1)))).alias("key"))
    return words.join(terms.select(F.lower("name").alias("key"), "name", "type").dropDuplicates(["key"]), "key").select("section_id", "name", "type", F.lit("MENTIONS").alias("relevance"))


def structured_retrieve(sections: DataFrame, related: DataFrame) -> DataFrame:
    """One JSON object a question: its sections, with summaries cut to 200 characters, and related entities."""
    s = sections.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("ord", "title", "doc_name", F.substring("summary", 1, 200).alias("summary")))).alias("s"))
    r = related.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("name", "entity_type", "relationship"))).alias("related"))
    return s.join(r, "question_id", "left").select("question_id", F.to_json(F.struct(F.transform("s", lambda x: x.dropFields("ord")).alias("sections"), F.coalesce("related", F.array()).alias("related"))).alias("result"))
