"""A small graph of two versions of a report, written and read through the store."""

import pytest

from arbograph.graph import DocumentGraph
from arbograph.operators import hierarchy
from arbograph.store import DocumentStore


def values(df, *columns):
    return [tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in df.collect()]


@pytest.fixture(scope="module")
def seeded(spark, tmp_path_factory):
    s = DocumentStore(DocumentGraph(spark), small=True)
    x = {}
    x["v1"] = s.insert_document("report-2025.pdf", doc_group="report", doc_version=1)
    x["v2"] = s.insert_document("report-2026.pdf", doc_group="report", doc_version=2)
    for key, doc, title, start, depth in (
        ("old", "v1", "Prior Root", 0, 0), ("root", "v2", "Main Root", 0, 0), ("risk", "v2", "Risk Factors", 51, 1),
        ("supply", "v2", "Supply Chain", 121, 1), ("chips", "v2", "Semiconductors", 201, 2),
    ):
        x[key] = s.insert_section(x[doc], key, title, None, f"text of {key}", start, start + 49, depth)
    for key, name, kind in (
        ("apple", "Apple Inc.", "ORGANIZATION"), ("apple2", "Apple Incorporated", "ORGANIZATION"), ("iphone", "iPhone", "PRODUCT"),
        ("qualcomm", "Qualcomm", "ORGANIZATION"), ("china", "China", "LOCATION"), ("foxconn", "Foxconn", "ORGANIZATION"), ("cook", "Tim Cook", "PERSON"),
    ):
        x[key] = s.upsert_entity(name, kind)
    for a, b in (("root", "risk"), ("root", "supply"), ("risk", "chips")):
        s.insert_hierarchy_edge(x[a], x[b])
    for sec, relevance, names in (("risk", "MENTIONS", ("apple", "qualcomm", "china", "foxconn")), ("supply", "DISCUSSES", ("apple", "iphone", "china", "foxconn")), ("chips", "DEFINES", ("iphone", "qualcomm"))):
        for n in names:
            s.insert_mention_edge(x[sec], x[n], relevance)
    s.insert_entity_relationship(x["apple"], x["iphone"], "PRODUCES")
    s.insert_entity_relationship(x["iphone"], x["qualcomm"], "USES")
    s.insert_enriched_relationship(x["cook"], x["apple"], "LEADS", 0.83)
    s.insert_temporal_edge(x["v1"], x["v2"], x["apple"], "STABLE", "Apple", "Apple Inc.", 0.95)
    s.insert_entity_alias(x["apple"], x["apple2"], 0.985, 1)
    s.update_entity_canonical(x["apple2"], x["apple"])
    for n in ("apple", "apple2"):
        s.update_entity_embedding(x[n], [0.1] * 16)
    x["session"] = s.create_session("talk", '{"a": 1}')
    x["turn"] = s.create_turn(x["session"], 1, "What about Apple?", "LOOKUP")
    s.update_turn_answer(x["turn"], "It is mentioned.")
    s.insert_turn_entity(x["turn"], x["apple"], "PRIMARY")
    s.insert_turn_entity(x["turn"], x["china"])
    s.insert_turn_section(x["turn"], x["risk"], 0.9)
    s.insert_turn_section(x["turn"], x["supply"], 1.0)
    s.graph.write(str(folder := tmp_path_factory.mktemp("g") / "all"))
    s.graph = DocumentGraph.read(spark, str(folder))
    return s, x


def test_ids_follow_each_other_and_upserts_find_known_pairs(seeded):
    s, x = seeded
    assert [x[k] for k in ("apple", "apple2", "iphone")] == [1, 2, 3]
    assert s.upsert_entity("Apple Inc.", "ORGANIZATION") == x["apple"]
    assert s.get_all_entities().count() == 7


def test_scans(seeded):
    s, x = seeded
    assert values(s.get_all_documents(), "doc_id") == [x["v1"], x["v2"]]
    assert values(s.get_document_sections(x["v2"]), "title") == ["Main Root", "Risk Factors", "Supply Chain", "Semiconductors"]
    assert values(s.get_section_children(x["root"]), "title") == ["Risk Factors", "Supply Chain"]
    assert values(s.get_section_entities(x["risk"]), "name") == ["Apple Inc.", "China", "Foxconn", "Qualcomm"]
    assert s.get_sections_by_ids([x["risk"], x["risk"], None]).count() == 1
    assert s.get_sections_by_ids([]).count() == 0


def test_searches_by_name(seeded):
    s, x = seeded
    assert values(s.get_entity_sections("apple"), "title") == ["Risk Factors", "Supply Chain"]
    assert values(s.get_related_entities("Apple"), "name") == ["iPhone"]
    assert values(s.get_entity_sections("a_ple"), "title") == ["Risk Factors", "Supply Chain"]
    assert values(s.graph_query_entity_sections("Apple Inc."), "section_title") == ["Risk Factors", "Supply Chain"]
    assert s.graph_query_entity_sections("apple").count() == 0
    assert values(s.graph_query_related_entities("iPhone"), "related_name") == ["Qualcomm"]


def test_traversals(seeded):
    s, x = seeded
    near = s.traverse_entity_neighborhood(x["apple"])
    assert set(values(near["entities"], "name")) == {"iPhone", "Qualcomm", "China", "Foxconn"}
    assert set(values(near["sections"], "title")) == {"Risk Factors", "Supply Chain"}
    assert near["rows"].count() == 6
    assert values(s.traverse_section_ancestors(x["chips"]), "title") == ["Main Root", "Risk Factors"]
    assert values(s.traverse_section_descendants(x["root"]), "title", "tree_level") == [("Risk Factors", 1), ("Supply Chain", 1), ("Semiconductors", 2)]
    assert values(s.graph_query_section_children("Main Root"), "child_title") == ["Risk Factors", "Supply Chain", "Semiconductors"]
    assert values(s.find_entity_paths("apple", "qualcomm"), "source_name", "mid_name", "target_name") == [("Apple Inc.", "iPhone", "Qualcomm")]
    assert values(s.get_multi_hop_entities(x["apple"]), "name", "hops") == [("iPhone", 1), ("Qualcomm", 2)]


def test_enrichment(seeded):
    s, x = seeded
    assert set(values(s.get_isolated_entities(), "name")) == {"China", "Foxconn"}
    assert ("China", "Foxconn") in values(s.get_cooccurring_pairs(), "entity1_name", "entity2_name")
    assert s.get_shared_section_text(x["apple"], x["china"]) == "text of risk\n\ntext of supply"
    assert s.get_shared_section_text(x["cook"], x["china"]) == ""


def test_versions(seeded):
    s, x = seeded
    assert values(s.get_previous_version("report", 2), "doc_id") == [x["v1"]]
    assert s.get_previous_version("report", 1).count() == 0
    assert values(s.get_doc_entities(x["v2"]), "name") == ["Apple Inc.", "China", "Foxconn", "Qualcomm", "iPhone"]
    assert values(s.get_temporal_changes("report", 1, 2), "change_type", "old_value") == [("STABLE", "Apple")]
    assert set(values(s.compute_temporal_diff(x["v2"]), "change_type")) == {"APPEARED"}
    nodes, _ = s.get_versioned_graph_data("report", 2)
    assert values(nodes.filter("temporal_status is not null"), "label") == ["Apple Inc."]


def test_sessions(seeded):
    s, x = seeded
    context = s.get_session_context(x["session"])
    assert [e["name"] for e in context["primary_entities"]] == ["Apple Inc."]
    assert context["previous_sections"] == [x["supply"], x["risk"]]
    assert s.get_session_context(99) == {"primary_entities": [], "previous_sections": []}
    assert values(s.get_session_turns(x["session"]), "answer") == ["It is mentioned."]
    assert s.list_sessions().count() == 1


def test_vectors(seeded):
    s, x = seeded
    assert values(s.find_similar_entities([0.1] * 16, "ORGANIZATION", 0.01, x["apple"]), "name") == ["Apple Incorporated"]
    assert s.find_similar_entities([0.1] * 16, "PERSON", 0.01).count() == 0


def test_whole_graph(seeded):
    s, x = seeded
    nodes, edges = s.get_full_graph_data()
    assert nodes.count() == 2 + 5 + 7
    assert edges.count() == 5 + 3 + 10 + 3


def test_cycles_raise_unless_told_otherwise(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "parent long, child long")
    with pytest.raises(hierarchy.CycleError):
        hierarchy.walks(edges).count()
    with pytest.raises(hierarchy.CycleError):  # a start outside the cycle
        hierarchy.walks(edges.union(spark.createDataFrame([(9, 1)], edges.schema)), spark.createDataFrame([(9,)], "start long"), look=3).count()
    assert hierarchy.walks(edges, nocycle=True).count() == 6


def test_deep_trees_are_no_cycles(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)], "parent long, child long")
    assert hierarchy.walks(edges, spark.createDataFrame([(0,)], "start long"), look=5).count() == 40


def test_empty_graph(spark):
    s = DocumentStore(DocumentGraph(spark))
    assert s.get_all_documents().count() == 0
    assert s.get_cooccurring_pairs().count() == 0
    assert s.traverse_section_descendants(1).count() == 0
    assert s.get_full_graph_data()[1].count() == 0


def test_updates_write_their_row_only(spark, monkeypatch):
    from pathlib import Path

    from arbograph import store as module
    from arbograph.graph import DocumentGraph

    monkeypatch.setattr(module, "FILES", 5)
    size = {}
    for n in (50, 20_000):
        entities = spark.range(1, n + 1).selectExpr("id as entity_id", "concat('name ', id) as name", "'T' as entity_type")
        s = DocumentStore(DocumentGraph.from_tables(spark, {"entities": entities}), small=True)
        s.update_entity_canonical(7, 3)
        folder = Path(s.paths["entities"])
        size[n] = sum(f.stat().st_size for f in folder.glob("changes/*.parquet"))
        before, rows = s.graph["entities"], sorted(f.name for f in folder.glob("rows/*.parquet"))
        s.update_entity_canonical(7, 4)
        s.update_entity_embedding(8, [1.0, 2.0])
        s.update_entity_canonical(99_999, 1)  # nobody
        assert rows == sorted(f.name for f in folder.glob("rows/*.parquet"))
        named = lambda df, k: df.filter(f"entity_id = {k}").first()
        assert named(s.graph["entities"], 7).canonical_id == 4 and named(before, 7).canonical_id == 3
        assert named(s.graph["entities"], 8).name_embedding == [1.0, 2.0] and s.graph["entities"].count() == n
        assert s.upsert_entity("new one", "T") == n + 1
        held = s.graph["entities"]
        s.update_entity_canonical(n + 1, 7)  # the sixth: the table is written anew
        assert s.paths["entities"] != str(folder) and s.changed["entities"] == 1
        assert named(held, n + 1).canonical_id is None and held.count() == n + 1 and named(held, 7).canonical_id == 4
        assert named(s.graph["entities"], n + 1).canonical_id == 7 and named(s.graph["entities"], 7).canonical_id == 4 and s.graph["entities"].count() == n + 1
    assert size[20_000] < 1.2 * size[50]
