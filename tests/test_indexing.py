"""Documents indexed into a graph, enriched and resolved, with scripted models."""

import json

import pytest

from arbograph.functions import models
from arbograph.graph import DocumentGraph
from arbograph.operators import extraction, retrieval, structure
from arbograph.plans import indexing
from arbograph.store import DocumentStore

V1 = "# Report\nAcme makes a Bolt.\n## Risks\nNothing."
V2 = "# Report\nAcme makes bolts.\n## Risks\nBetacorp competes with Acme.\n### Detail\nBetacorp again.\n## Outlook\nAcme"


def scripted():
    """A model of a class that is sent by value."""

    class Scripted:
        """Answers by what a prompt asks for."""

        def chat(self, prompt):
            if prompt.startswith("Name relationships"):
                return '```json\n[{"source": "Acme (ORGANIZATION)", "target": "betacorp", "relationship": "competes_with"}, {"source": "Acme", "target": "Nobody", "relationship": "X"}, {"source": ""}]\n```'
            if prompt.startswith("Which relationship"):
                return "Surely PART_OF."
            if prompt.startswith("Name the intent"):
                if "fail" in prompt:
                    raise OSError
                return json.dumps({"intent": "lookup", "entities": ["Acme"]}) if "What is" in prompt else '{"intent": "WHIM"}'
            if prompt.startswith("List the sections"):
                return '[{"structure": "1", "title": "Start", "physical_index": "<physical_index_2>"}, {"structure": "1.1", "title": "More", "physical_index": "3"}, {"structure": "2", "title": "Gone", "physical_index": "99"}]'
            if prompt.startswith("Are these"):
                return "Yes."
            if prompt.startswith("List the entities"):
                return '[{"name": " Acme ", "type": "organization", "relevance": "defines"}, {"name": "", "type": "X"}, {"name": "Y", "type": null}]'
            return "done"

    return Scripted()


def dictionary(spark):
    terms = spark.createDataFrame([("Acme", "ORGANIZATION"), ("Betacorp", "ORGANIZATION"), ("Bolt", "PRODUCT")], "name string, type string")
    return lambda sections: retrieval.extract_entities(sections, terms)


@pytest.fixture(scope="module")
def indexed(spark):
    docs = spark.createDataFrame([("a.md", "g", 1, V1), ("b.md", "g", 2, V2)], "doc_name string, doc_group string, doc_version int, text string")
    return indexing.index_markdown(DocumentGraph(spark), docs, dictionary(spark), scripted())


def test_sections_form_the_tree(indexed):
    s = DocumentStore(indexed)
    v2 = indexed["documents"].filter("doc_version = 2").first().doc_id
    rows = {r.title: r for r in s.get_document_sections(v2).collect()}
    assert {t: r.depth_level for t, r in rows.items()} == {"Report": 0, "Risks": 1, "Detail": 2, "Outlook": 1}
    assert [r.title for r in s.traverse_section_descendants(rows["Report"].section_id).collect()] in (["Outlook", "Risks", "Detail"], ["Risks", "Outlook", "Detail"])
    assert rows["Risks"].text_content == "## Risks\nBetacorp competes with Acme."


def test_entities_relations_and_changes(indexed):
    names = {r.name: r.entity_id for r in indexed["entities"].collect()}
    assert set(names) == {"Acme", "Betacorp", "Bolt"}
    edges = {(r.source_entity, r.target_entity, r.relationship) for r in indexed["entity_relationships"].collect()}
    assert edges == {(names["Acme"], names["Betacorp"], "COMPETES_WITH")}
    changes = {(r.entity_id, r.change_type) for r in indexed["temporal_edges"].collect()}
    assert changes == {(names["Acme"], "STABLE"), (names["Betacorp"], "APPEARED"), (names["Bolt"], "DISAPPEARED")}


def test_thinned_documents_have_fewer_sections(spark):
    docs = spark.createDataFrame([("b.md", "g", 2, V2)], "doc_name string, doc_group string, doc_version int, text string")
    g = indexing.index_markdown(DocumentGraph(spark), docs, dictionary(spark), None, 1000)
    assert [(r.title, r.depth_level) for r in g["sections"].collect()] == [("Report", 0)]


def test_pages_are_cut_by_the_contents(spark):
    docs = spark.createDataFrame([("p.pdf", None, 1)], "doc_name string, doc_group string, doc_version int")
    pages = spark.createDataFrame([("p.pdf", k, f"page {k} on Acme. ", 5) for k in range(1, 6)], "doc_name string, page_no int, text string, tokens long")
    g = indexing.index_pages(DocumentGraph(spark), docs, pages, dictionary(spark), scripted())
    rows = [(r.title, r.start_index, r.end_index, r.depth_level) for r in g["sections"].orderBy("node_id").collect()]
    assert rows == [("Preface", 1, 2, 0), ("Start", 2, 3, 0), ("More", 3, 5, 1)]


def test_documents_without_contents_get_a_section_a_page(spark):
    class Silent:
        def chat(self, prompt):
            return "I cannot say."

    pages = spark.createDataFrame([(1, 1, "a", 1), (1, 2, "b", 1)], "doc_id long, page_no int, text string, tokens long")
    rows = extraction.extract_contents(pages, Silent()).orderBy("ord").collect()
    assert [(r.title, r.physical_index) for r in rows] == [("Page 1", 1), ("Page 2", 2)]
    assert structure.fallback_structure(pages).count() == 2


def test_model_steps(spark):
    q = spark.createDataFrame([(1, "What is Acme?"), (2, "Hm"), (3, "fail")], "question_id long, question string")
    found = {r.question_id: (r.intent, r.entities) for r in extraction.classify_intents(q, scripted()).collect()}
    assert found == {1: ("LOOKUP", ["Acme"]), 2: ("EXPLORATION", []), 3: ("EXPLORATION", [])}
    sections = spark.createDataFrame([(1, "", "text"), (2, None, None)], "section_id long, summary string, text_content string")
    assert [tuple(r) for r in extraction.extract_entities(sections, scripted()).collect()] == [(1, "Acme", "ORGANIZATION", "DEFINES")]


def test_enrichment_and_resolution(spark, indexed):
    g = indexing.enrich(indexed, scripted(), min_shared=1)
    new = [r for r in g["entity_relationships"].collect() if r.edge_source == "ENRICHMENT"]
    assert new and all(r.relationship == "PART_OF" and float(r.confidence) == 0.8 for r in new)
    docs = spark.createDataFrame([("c.md", None, 1, "# X\nacme")], "doc_name string, doc_group string, doc_version int, text string")
    lower = spark.createDataFrame([("acme", "ORGANIZATION")], "name string, type string")
    g = indexing.index_markdown(indexed, docs, lambda s: retrieval.extract_entities(s, lower))
    g = indexing.resolve_entities(g, models.HashEmbedder(16))
    names = {r.name: r for r in g["entities"].collect()}
    assert names["acme"].canonical_id == names["Acme"].entity_id
    assert [(float(r.similarity), r.confirmed) for r in g["entity_aliases"].collect()] == [(1.0, 0)]


def test_names_and_prompts_are_bounded(spark):
    rows = [(1, f"n{k:03}", "T", k) for k in range(80)]
    seen = []

    class Count:
        def chat(self, prompt):
            return json.dumps([{"source": "n000", "target": str(prompt.count("(T)")), "relationship": "uses"}])

    found = extraction.extract_relationships(spark.createDataFrame(rows, "doc_id long, name string, type string, ord long"), Count()).collect()
    assert [(r.target, r.relationship) for r in found] == [("50", "USES")] and not seen
