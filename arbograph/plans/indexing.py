"""From documents to a graph: sections, tree, entities, mentions, relationships and changes, in batches of documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbograph.functions import models
from arbograph.graph import DocumentGraph
from arbograph.operators import contents, extraction, prompts, retrieval, structure, summaries, temporal, vectors, writes
from arbograph.operators import markdown as md
from arbograph.runlog import RunLog, counted
from arbograph.session import materialise

Extractor = Callable[[DataFrame], DataFrame]


def _stored(g: DocumentGraph, *tables: str) -> DocumentGraph:
    for t in tables:
        g = g.with_table(t, materialise(g[t], t))
    return g


def _log(g: DocumentGraph, log: RunLog | None) -> RunLog:
    return log if log is not None else RunLog(g.spark, None)


def _add_documents(g: DocumentGraph, documents: DataFrame, log: RunLog) -> tuple[DocumentGraph, DataFrame]:
    """The graph with (doc_name, doc_group, doc_version[, source_path]) and their ids by key."""
    before = g["documents"].agg(F.max("doc_id")).first()[0] or 0
    with log.step("documents"):
        g = _stored(writes.insert_documents(g, documents.select(*(c for c in ("doc_name", "doc_group", "doc_version", "source_path") if c in documents.columns))), "documents")
    return g, g["documents"].filter(F.col("doc_id") > before).select("doc_id", "doc_name", "doc_version")


def _add_sections(g: DocumentGraph, nodes: DataFrame, log: RunLog, summarise: models.Client | None = None, size: int = 1) -> tuple[DocumentGraph, DataFrame]:
    """Nodes (doc_id, ord, parent_ord, depth, title, text, start_index, end_index) as sections with their tree, and with summaries if there is a model for them."""
    with log.step("nodes") as stored:
        nodes = materialise(counted(nodes, "rows_out"), "nodes")
    if summarise is None:
        nodes = nodes.withColumn("summary", F.lit(None).cast("string"))
    else:
        with log.step("summaries", rows_in=stored["rows_out"]):
            made = materialise(counted(summaries.summarised(nodes, summarise, size=size), "rows_out", F.col("how") == "failed"), "summarised")
        nodes = nodes.join(made.select("doc_id", "ord", "summary"), ["doc_id", "ord"])
    rows = structure.node_ids(nodes)
    columns = rows.select("doc_id", "node_id", "title", F.col("text").alias("text_content"), "summary", "start_index", "end_index", F.col("depth").alias("depth_level"))
    with log.step("sections", rows_in=stored["rows_out"]):
        g = _stored(writes.insert_sections(g, columns), "sections")
    new = g["sections"].select("section_id", "doc_id", "node_id").join(rows.select("doc_id", "node_id", "ord", "parent_ord"), ["doc_id", "node_id"])
    parents = new.select("doc_id", F.col("ord").alias("parent_ord"), F.col("section_id").alias("parent_id"))
    edges = new.join(parents, ["doc_id", "parent_ord"]).select("parent_id", F.col("section_id").alias("child_id"))
    with log.step("section_hierarchy"):
        g = _stored(writes.insert_hierarchy_edges(g, edges), "section_hierarchy")
    return g, new.select("doc_id", "section_id")


def _add_entities(g: DocumentGraph, new: DataFrame, extract: Extractor, client: models.Client | None, log: RunLog) -> DocumentGraph:
    sections = g["sections"].join(new.select("section_id"), "section_id", "left_semi")
    with log.step("mentions_found") as mentions:
        found = materialise(counted(extract(sections), "rows_out"), "found")
    with log.step("entities", rows_in=mentions["rows_out"]):  # rejected: those known by name and type already
        g = _stored(writes.upsert_entities(g, found.select("name", F.col("type").alias("entity_type"), F.lit(None).cast("string").alias("description"))), "entities")
    ids = g["entities"].select("entity_id", "name", F.col("entity_type").alias("type"))
    with log.step("section_entities", rows_in=mentions["rows_out"]):
        g = _stored(writes.insert_mention_edges(g, found.join(ids, ["name", "type"]).select("section_id", "entity_id", "relevance")), "section_entities")
    if client is None:
        return g
    by_doc = found.join(new, "section_id").groupBy("doc_id", "name", "type").agg(F.min("section_id").alias("ord"))
    # stored, as it is joined several times and a model is to be asked once
    with log.step("relationships_found") as proposed:
        related = extraction.extract_relationships(by_doc, client).withColumn("ord", F.xxhash64("doc_id", "source", "target", "relationship")).dropDuplicates(["ord"])
        related = materialise(counted(related, "rows_out"), "related")
    named = ids.select("entity_id", "name", F.col("entity_id").alias("ord"))
    edges = retrieval.resolve_relationship_endpoints(named, related.select("ord", "source", "target", "relationship"))
    with log.step("entity_relationships", rows_in=proposed["rows_out"]):  # rejected: those with an end that no entity is called by
        return _stored(writes.insert_entity_relationships(g, edges.select(F.col("source_id").alias("source_entity"), F.col("target_id").alias("target_entity"), "relationship")), "entity_relationships")


def _add_changes(g: DocumentGraph, documents: DataFrame, log: RunLog) -> DocumentGraph:
    found = temporal.temporal_diff(g).join(documents.select(F.col("doc_id").alias("target_doc_id")), "target_doc_id", "left_semi")
    with log.step("temporal_edges"):
        return _stored(writes.insert_temporal_edges(g, found.drop("name", "entity_type")), "temporal_edges")


def _markdown_nodes(texts: DataFrame, least_tokens: int | None) -> DataFrame:
    """Sections of (doc_id, text) with parents, depths and first lines; small ones are merged if ``least_tokens`` is given."""
    sections = md.md_sections(texts)
    if least_tokens is not None:
        lines = sections.select("doc_id", "ord", "line_num")
        sections = md.md_thinning(sections, least_tokens).join(lines, ["doc_id", "ord"])
    return structure.section_depth(md.md_tree(sections)).select("doc_id", "ord", "parent_ord", "depth", "title", "text", "line_num")


def index_markdown(g: DocumentGraph, documents: DataFrame, extract: Extractor, client: models.Client | None = None, least_tokens: int | None = None, summarise: models.Client | None = None, size: int = 1, log: RunLog | None = None) -> DocumentGraph:
    """Markdown documents (doc_name, doc_group, doc_version, text) added to a graph.

    ``extract`` gives (section_id, name, type, relevance) for sections; with a
    client relationships are asked for too, with ``summarise`` summaries, ``size`` to
    a prompt.  Small sections are merged if ``least_tokens`` is given.  ``log`` gets a
    row a step.
    """
    log = _log(g, log)
    g, ids = _add_documents(g, documents, log)
    texts = documents.join(ids, ["doc_name", "doc_version"]).select("doc_id", "text")
    nodes = _markdown_nodes(texts, least_tokens).withColumnRenamed("line_num", "start_index").withColumn("end_index", F.lit(None).cast("int"))
    g, new = _add_sections(g, nodes, log, summarise, size)
    return _add_changes(_add_entities(g, new, extract, client, log), ids, log)


DESCRIBE = "Say in one sentence what the document with this structure is about, and what tells it from others. Answer with this sentence only."


def markdown_structures(
    documents: DataFrame, least_tokens: int | None = None, summarise: models.Client | None = None, short: int = summaries.SHORT, size: int = 1, node_ids: bool = True, text: bool = False, describe: models.Client | None = None
) -> DataFrame:
    """doc_id, doc_name and a nested JSON structure of Markdown documents (doc_id, doc_name, text), without a graph.

    A node has its title and first line and, where asked for, its id, its text and
    its summary, which is a prefix summary if other nodes are below it; ``describe``
    adds a description of the document, told from titles and summaries.

    Defined results: a document without headings, or without a text, has an empty
    structure; a model that fails leaves an empty summary, or no description.
    """
    nodes = materialise(structure.node_ids(_markdown_nodes(documents.select("doc_id", "text"), least_tokens)), "nodes")
    if summarise is not None:
        made = summaries.summarised(nodes, summarise, short=short, size=size).select("doc_id", "ord", F.col("summary").alias("_summary"))
        above = nodes.filter("parent_ord is not null").select("doc_id", F.col("parent_ord").alias("ord"), F.lit(True).alias("_above")).distinct()
        own = F.coalesce("_above", F.lit(False))
        nodes = nodes.join(made, ["doc_id", "ord"]).join(above, ["doc_id", "ord"], "left")
        nodes = materialise(nodes.withColumns({"summary": F.when(~own, F.col("_summary")), "prefix_summary": F.when(own, F.col("_summary"))}).drop("_summary", "_above"), "nodes")
    keys = tuple(k for k in structure.KEYS if (k != "node_id" or node_ids) and (k != "text" or text))
    trees = documents.select("doc_id", "doc_name").join(structure.nested_json(nodes, keys), "doc_id", "left").withColumn("json", F.coalesce("json", F.lit('{"structure":[]}')))
    head = ["doc_name"]
    if describe is not None:
        untold = materialise(trees.drop("json").join(structure.nested_json(nodes, tuple(k for k in keys if k != "text")), "doc_id"), "untold")
        told = models.replies(untold, prompts.prompt(DESCRIBE, F.col("json")), describe).select("doc_id", F.trim("answer").alias("doc_description"))
        trees = trees.join(materialise(told, "described"), "doc_id", "left")
        head.append("doc_description")
    own = F.to_json(F.struct(*head))
    start = F.concat(F.substring(own, F.lit(1), F.length(own) - 1), F.when(own == "{}", "").otherwise(","))
    return trees.select("doc_id", "doc_name", F.concat(start, F.substring("json", 2, 2**31 - 1)).alias("json"))


def index_pages(g: DocumentGraph, documents: DataFrame, pages: DataFrame, extract: Extractor, client: models.Client, verify: bool = False, summarise: models.Client | None = None, size: int = 1, log: RunLog | None = None) -> DocumentGraph:
    """Paged documents: (doc_name, doc_group, doc_version) and (doc_name, page_no, text, tokens), their contents asked for.

    With ``verify`` contents are found by the first of three ways whose entries
    stand a check, and sections that begin their page end the one before.
    ``log`` gets a row a step.
    """
    log = _log(g, log)
    g, ids = _add_documents(g, documents, log)
    with log.step("pages"):
        own = materialise(counted(pages.join(ids.select("doc_id", "doc_name"), "doc_name").select("doc_id", "page_no", "text", "tokens"), "rows_out"), "pages")
    totals = structure.document_totals(own)
    with log.step("contents"):
        if verify:
            found = structure.toc_preface(contents.verified_contents(own, client).entries)
            toc = materialise(counted(contents.starting_pages(found, own, client), "rows_out"), "contents")
        else:  # rejected: entries without a page of their document
            checked = structure.toc_validate(extraction.extract_contents(own, client), totals)
            toc = structure.toc_preface(materialise(counted(checked, "rows_in", F.col("physical_index").isNull()), "contents").filter("physical_index is not null"))
    spans = materialise(structure.section_spans(toc, totals), "spans")
    tree = structure.section_depth(structure.toc_parents(spans).select("doc_id", "ord", "parent_ord", "title"))
    texts = structure.section_text(spans, own)
    nodes = tree.join(spans.select("doc_id", "ord", "start_index", "end_index"), ["doc_id", "ord"]).join(texts, ["doc_id", "ord"], "left")
    g, new = _add_sections(g, nodes, log, summarise, size)
    return _add_changes(_add_entities(g, new, extract, client, log), ids, log)


def resolve_entities(g: DocumentGraph, embedder: models.Embedder, client: models.Client | None = None, auto: float = 0.15, ask: float = 0.3, log: RunLog | None = None) -> DocumentGraph:
    """Embeds the names of entities without a vector, and links each to the nearest accepted earlier entity of its type."""
    missing = g["entities"].filter("name_embedding is null").select("entity_id", "name")
    log = _log(g, log)
    with log.step("embeddings") as embedded:
        made = materialise(counted(models.embeddings(missing, "name", embedder, "name_embedding"), "rows_out"), "embedded")
    g = _stored(writes.update_entity_embedding(g, made.select("entity_id", "name_embedding")), "entities")
    probes = g["entities"].join(made.select("entity_id"), "entity_id", "left_semi")
    near = materialise(vectors.similar_entities(g["entities"], probes, ask, earlier=True), "near")
    confirmed = None if client is None else extraction.confirm(near.filter(F.col("distance") >= auto), g["entities"].select("entity_id", "name"), client)
    with log.step("entity_aliases", rows_in=embedded["rows_out"]):  # rejected: entities that stay their own
        aliases = materialise(counted(vectors.entity_aliases(near, confirmed, auto, ask), "rows_out"), "aliases")
    g = writes.insert_entity_aliases(g, aliases)
    return _stored(writes.update_entity_canonical(g, aliases.select(F.col("alias_id").alias("entity_id"), "canonical_id")), "entity_aliases", "entities")


def enrich(g: DocumentGraph, client: models.Client, min_shared: int = 2, limit: int | None = 50, log: RunLog | None = None) -> DocumentGraph:
    with _log(g, log).step("enrichment"):
        return _stored(writes.insert_enriched_relationships(g, extraction.enrich(g, client, min_shared, limit)), "entity_relationships")
