"""Questions end to end: every intent, what is tried after it, contexts, and the turns that are left."""

import pytest
from pyspark.sql import functions as F

from arbograph.graph import DocumentGraph
from arbograph.operators import answers, patterns


def client(chat):
    """Of a class of its own, which is sent along."""

    class Client:
        def chat(self, prompt):
            return chat(prompt)

    return Client()


#: A service that can't be reached, and a client that is wrong itself.
ECHO, BROKEN, WRONG = client(lambda prompt: prompt), client(lambda prompt: open("/no/such/service")), client(lambda prompt: 1 / 0)


@pytest.fixture(scope="module")
def graph(spark):
    rows = {
        "documents": ([(1, "report.pdf")], "doc_id long, doc_name string"),
        "sections": (
            [(k, 1, t, k, d, f"Text of {t}.") for k, t, d in [(1, "Overview", 0), (2, "Suppliers", 1), (3, "Risks", 1), (4, "Details", 2), (5, "Delta alone", 1), (6, "Markets", 0)]],
            "section_id long, doc_id long, title string, start_index int, depth_level int, text_content string",
        ),
        "section_hierarchy": ([(1, 2), (1, 3), (3, 4)], "parent_id long, child_id long"),
        "entities": (
            [(k, n, "ORGANIZATION", d) for k, n, d in [(1, "Acme", "Makes bolts"), (2, "Beta", None), (3, "Ceta", ""), (4, "Delta", None), (5, "Eta", None)]],
            "entity_id long, name string, entity_type string, description string",
        ),
        "section_entities": ([(1, 1, "DEFINES"), (2, 1, "MENTIONS"), (2, 3, "DISCUSSES"), (3, 2, "MENTIONS"), (3, 3, "MENTIONS"), (5, 4, "MENTIONS")], "section_id long, entity_id long, relevance string"),
        "entity_relationships": ([(1, 2, "SUPPLIES"), (2, 3, "OWNS"), (3, 5, "PART_OF")], "source_entity long, target_entity long, relationship string"),
    }
    return DocumentGraph.from_tables(spark, {name: spark.createDataFrame(*table) for name, table in rows.items()})


def asked(spark, *cases):
    """Questions 1, 2, ... of (intent, names), with their sessions if there are any."""
    questions = spark.createDataFrame([(k, f"Question {k}?", c[0], c[2] if len(c) > 2 else None) for k, c in enumerate(cases, 1)], "question_id long, question string, intent string, session_id long")
    names = spark.createDataFrame([(k, i, n) for k, c in enumerate(cases, 1) for i, n in enumerate(c[1], 1)], "question_id long, ord int, name string")
    return questions, names


def sections_of(found):
    out = {}
    for r in found.sections.orderBy("question_id", "ord").collect():
        out.setdefault(r.question_id, []).append(r.section_id)
    return out


def test_every_intent_reads_its_sections(spark, graph):
    intents = ["LOOKUP", "RELATIONSHIP", "EXPLORATION", "COMPARISON", "TEMPORAL", None]
    found = answers.answer(graph, *asked(spark, *((i, ["acme", "ceta"]) for i in intents), ("HIERARCHICAL", ["acme"]), ("HIERARCHICAL", ["ceta"])), ECHO)
    # Acme shares section 2 with Ceta, which shares section 3 with Beta
    assert sections_of(found) == {k: [2, 3] for k in range(1, 7)} | {7: [1, 2, 3, 4], 8: [2, 3, 4]}
    text = {r.question_id: (r.outcome, r.answer) for r in found.answers.collect()}
    assert all(o == "answered" for o, _ in text.values())
    assert "### Suppliers\n**Document:** report.pdf | **Depth:** 1\n**Relevance:** MENTIONS\n\nText of Suppliers." in text[2][1]
    assert "### Overview" in text[7][1] and "### Details" in text[7][1] and answers.CONCEPTS not in text[7][1]


def test_related_entities_of_the_intents(spark, graph):
    found = answers.answer(graph, *asked(spark, ("LOOKUP", ["acme"]), ("EXPLORATION", ["acme"]), ("RELATIONSHIP", ["acme", "ceta"]), ("HIERARCHICAL", ["acme"])), ECHO)
    related = {}
    for r in found.related.orderBy("question_id", "ord").collect():
        related.setdefault(r.question_id, []).append((r.name, r.relationship))
    assert related == {1: [("Ceta", "RELATED_TO")], 2: [("Ceta", "RELATED_TO"), ("Beta", "SUPPLIES")], 3: [("Ceta", "RELATED_TO"), ("Acme", "RELATED_TO"), ("Beta", "RELATED_TO")]}
    text = {r.question_id: r.answer for r in found.answers.collect()}
    assert text[3].endswith("## Related Concepts\n\n- **Ceta** (ORGANIZATION) — _RELATED_TO_\n- **Acme** (ORGANIZATION) — _RELATED_TO_: Makes bolts\n- **Beta** (ORGANIZATION) — _RELATED_TO_\n")


def test_fallbacks_and_early_ends(spark, graph):
    found = answers.answer(graph, *asked(spark, ("LOOKUP", ["delta"]), ("LOOKUP", ["eta"]), ("COMPARISON", ["market", "risk"]), ("LOOKUP", ["nobody"]), ("LOOKUP", []), ("HIERARCHICAL", ["eta"]), ("LOOKUP", ["%"])), ECHO)
    # Delta shares no section; "eta" is first found in Beta; markets and risks are titles only
    assert sections_of(found) == {1: [5], 2: [3], 3: [3, 6], 6: [3, 4]}
    outcome = {r.question_id: (r.outcome, r.answer) for r in found.answers.collect()}
    assert outcome[4] == ("no sections", answers.NO_SECTIONS) and outcome[5] == ("no names", answers.NO_NAMES) and outcome[7][0] == "no sections"
    assert {k for k, (o, _) in outcome.items() if o == "answered"} == {1, 2, 3, 6}


def test_a_budget_cuts_sections_and_concepts(spark, graph):
    long = graph.with_table("sections", graph["sections"].withColumn("text_content", F.repeat(F.lit("word "), 400)))
    case = asked(spark, ("LOOKUP", ["ceta"]))
    text = {b: answers.answer(long, *case, ECHO, b).answers.first()["answer"] for b in (3_000, 800, 1_030)}
    assert text[3_000].count("###") == 2 and answers.CONCEPTS in text[3_000]
    assert text[800].count("###") == 2 and "[...truncated...]" in text[800] and answers.CONCEPTS in text[800]
    assert text[1_030].count("###") == 2 or answers.CONCEPTS not in text[1_030]


def test_a_client_that_fails(spark, graph):
    assert answers.answer(graph, *asked(spark, ("LOOKUP", ["acme"])), BROKEN).answers.first()["answer"] == answers.FAILED
    with pytest.raises(Exception, match="ZeroDivisionError"):
        answers.answer(graph, *asked(spark, ("LOOKUP", ["acme"])), WRONG).answers.collect()


def test_no_questions(spark, graph):
    g, found, turns = answers.ask(graph, *asked(spark, ("LOOKUP", ["acme"])), ECHO)
    none = asked(spark, ("LOOKUP", ["acme"]))
    none = none[0].filter("false"), none[1].filter("false")
    assert answers.answer(graph, *none, ECHO).answers.count() == 0
    assert answers.ask(g, *none, ECHO)[0]["turns"].count() == 1


def test_turns_are_kept_and_their_entities_go_on(spark, graph):
    g, found, turns = answers.ask(graph, *asked(spark, ("LOOKUP", ["acme"]), ("LOOKUP", [])), ECHO)
    assert g["sessions"].count() == 2 and {r.title for r in g["sessions"].collect()} == {"Question 1?", "Question 2?"}
    kept = {r.question: r for r in g["turns"].collect()}
    first = kept["Question 1?"]
    assert (first.turn_number, first.intent) == (1, "LOOKUP") and "### Suppliers" in first.answer and kept["Question 2?"].answer == answers.NO_NAMES
    roles = {(r.turn_id, r.entity_id): r.role for r in g["turn_entities"].collect()}
    assert roles == {(first.turn_id, 1): "PRIMARY", (first.turn_id, 3): "REFERENCED"}
    assert [(r.turn_id, r.section_id, r.rank_score) for r in g["turn_sections"].collect()] == [(first.turn_id, 2, 1.0)]

    # a second question of the session also asks about Acme, a new session doesn't
    g2, found, turns = answers.ask(g, *asked(spark, ("COMPARISON", ["beta"], first.session_id), ("COMPARISON", ["beta"])), ECHO)
    assert sections_of(found) == {1: [3, 2], 2: [3]}
    assert {(r.question_id, r.turn_number) for r in turns.collect()} == {(1, 2), (2, 1)}
    assert g2["sessions"].count() == 3 and g2["turns"].count() == 4
    latest = {(r.entity_id, r.role) for r in g2["turn_entities"].filter(F.col("turn_id") == turns.filter("question_id = 1").first()["turn_id"]).collect()}
    assert {(1, "PRIMARY"), (2, "PRIMARY"), (3, "REFERENCED")} == latest


def test_paths_by_ids_and_by_names(spark, graph):
    ends = spark.createDataFrame([(1, 3), (2, 5), (1, 5)], "source_id long, target_id long")
    paths = {(r.source_name, r.mid_name, r.target_name) for r in patterns.entity_paths(graph, ends).collect()}
    assert paths == {("Acme", "Beta", "Ceta"), ("Beta", "Ceta", "Eta")}
    pairs = spark.createDataFrame([("ac%e", "cet"), ("eta", "ETA"), ("none", "eta")], "source_query string, target_query string")
    by_name = {(r.source_query, r.source_name, r.target_name) for r in patterns.entity_paths_by_name(graph, pairs).collect()}
    assert by_name == {("ac%e", "Acme", "Ceta"), ("eta", "Beta", "Eta")}


def test_paths_by_names_of_entities_that_share_an_id(spark):
    rows = {
        "entities": ([(1, "Acme", "X"), (1, "Other", "X"), (2, "Mid", "X"), (2, "Also", "X"), (3, "Ceta", "X"), (3, "Ceta", "X"), (3, "Zeta", "X")], "entity_id long, name string, entity_type string"),
        "entity_relationships": ([(1, 2, "SUPPLIES"), (2, 3, "OWNS")], "source_entity long, target_entity long, relationship string"),
    }
    g = DocumentGraph.from_tables(spark, {name: spark.createDataFrame(*table) for name, table in rows.items()})
    pairs = spark.createDataFrame([("acme", "ceta")], "source_query string, target_query string")
    found = [(r.ord, r.source_name, r.mid_name, r.target_name) for r in patterns.entity_paths_by_name(g, pairs).orderBy("ord").collect()]
    assert found == [(1, "Acme", "Also", "Ceta"), (2, "Acme", "Also", "Ceta"), (3, "Acme", "Mid", "Ceta"), (4, "Acme", "Mid", "Ceta")]
