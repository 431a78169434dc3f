"""Prompts of several rows and summaries from the leaves up, with scripted models."""

import json

import pytest

from arbograph.functions import models
from arbograph.graph import DocumentGraph
from arbograph.operators import extraction, prompts, summaries
from arbograph.plans import indexing

SECTIONS = "section_id long, doc_id long, title string, summary string, text_content string"


def faulty(lose=(), fail=()):
    """Answers for many sections, some of which it drops, repeats or invents; alone it names the text's first word."""

    class Faulty:
        def chat(self, prompt):
            task, *parts = prompt.split("\n\n")
            if "section_index" not in task:
                if parts[0] in fail:
                    raise models.ModelError("none")
                return json.dumps([{"name": f"alone {parts[0]}", "type": "x"}])
            rows = json.loads(parts[0])
            if any(r["text"].startswith("whole") for r in rows):
                return "I cannot."
            entity = lambda r, t: [{"name": f"{t} {r['title']} {r['section_index']}", "type": "x", "relevance": "defines"}]
            out = [{"section_index": r["section_index"], "entities": entity(r, "first")} for r in rows if r["section_index"] not in lose]
            out += [{"section_index": str(r["section_index"]), "entities": entity(r, "last")} for r in rows if r["section_index"] == 0]
            out += [{"section_index": 77, "entities": [{"name": "invented", "type": "x"}]}, {"section_index": None}, {"entities": []}, 5, "x"]
            return "```json\n" + json.dumps(out) + "\n```"

    return Faulty()


def test_no_section_is_lost(spark):
    rows = [(k, 1 + k // 8, f"t{k}", None, f"text{k}") for k in range(16)]
    rows[2] = (2, 1, "t2", "", "")
    rows[4] = (4, 1, None, "short", "long")
    rows[13] = (13, 2, "t13", None, "whole13")
    sections = spark.createDataFrame(rows, SECTIONS)
    found = {}
    for r in extraction.extract_entities(sections, faulty(lose=(1,), fail=("text6",)), size=5).collect():
        found.setdefault(r.section_id, []).append((r.name, r.type, r.relevance))
    told = lambda word, k, place: [(f"{word} t{k} {place}", "X", "DEFINES")]
    alone = lambda k, text=None: [(f"alone {text or f'text{k}'}", "X", "MENTIONS")]
    # documents begin with section 0 and 8; the prompt of 13 to 15 is answered with no array
    expected = {0: told("last", 0, 0), 1: alone(1), 3: told("first", 3, 3), 5: told("last", 5, 0), 7: told("first", 7, 2), 8: told("last", 8, 0), 9: alone(9), 10: told("first", 10, 2), 11: told("first", 11, 3), 12: told("first", 12, 4), 13: alone(13, "whole13"), 14: alone(14), 15: alone(15)}
    expected[4] = [("first  4", "X", "DEFINES")]
    assert found == expected  # 2 has no text, 6 failed alone
    whole = {r.section_id: r.name for r in extraction.extract_entities(sections, faulty(lose=(1,), fail=("text6",)), size=5, whole=True).collect()}
    assert whole[0] == "alone text0" and whole[3] == "alone text3" and whole[4] == "alone short"


def test_places_are_dealt_in_the_order_of_keys_within_runs(spark, monkeypatch):
    monkeypatch.setattr(prompts, "RUN", 10)
    rows = spark.createDataFrame([(k, 1) for k in (0, 1, 2, 9, 10, 11, 35)] + [(k, 2) for k in (1, 5)], "section_id long, doc_id long")
    found = {(r.doc_id, r.section_id): (r.run, r.batch, r.place) for r in prompts.dealt(rows, "section_id", "doc_id", 2).collect()}
    assert found == {(1, 0): (0, 0, 0), (1, 1): (0, 0, 1), (1, 2): (0, 1, 0), (1, 9): (0, 1, 1), (1, 10): (1, 0, 0), (1, 11): (1, 0, 1), (1, 35): (3, 0, 0), (2, 1): (0, 0, 0), (2, 5): (0, 0, 1)}


def test_empty_tables(spark):
    none = spark.createDataFrame([], SECTIONS)
    assert extraction.extract_entities(none, faulty(), size=5).count() == 0
    assert summaries.summarised(spark.createDataFrame([], "doc_id long, ord int, parent_ord int, depth int, title string, text string"), faulty()).count() == 0


def recording(path):
    class Recording:
        """Writes down what it is asked, in order, and answers with the titles it has seen below."""

        def chat(self, prompt):
            import json
            import re
            import time

            from arbograph.functions import models
            from arbograph.operators import summaries

            task, *parts = prompt.split("\n\n")
            rows = [{"index": 0, "title": parts[0], "text": "\n\n".join(parts[1:])}] if task == summaries.ONE else json.loads(parts[0])
            with open(path, "a") as f:
                for r in rows:
                    f.write(json.dumps([time.time_ns(), r["title"], task == summaries.ONE]) + "\n")
            if any(r["title"] == "down" for r in rows):
                raise models.ModelError("down")
            said = [f" of {r['title']}({','.join(re.findall(r'(?m)^- (.*): ', r['text']))}) " for r in rows]
            if task == summaries.ONE:
                return said[0]
            return json.dumps([{"index": r["index"], "summary": s} for r, s in zip(rows, said) if r["title"] != "lost"])

    return Recording()


LONG = "word " * 200
NODES = [
    (1, 1, None, 0, "root", "short root"), (1, 2, 1, 1, "a", LONG), (1, 3, 1, 1, "b", ""), (1, 4, 3, 2, "b1", "tiny"), (1, 5, 3, 2, "b2", LONG), (1, 6, 3, 2, "b3", None), (1, 7, 1, 1, "c", "small"),
    (2, 1, None, 0, "down", LONG), (2, 2, None, 0, "lost", LONG), (3, 1, None, 0, "empty", ""), (3, 2, 1, 1, "e1", ""),
]


@pytest.mark.parametrize("size", [1, 3])
def test_parents_see_their_children_s_summaries(spark, tmp_path, size):
    nodes = spark.createDataFrame(NODES, "doc_id long, ord int, parent_ord int, depth int, title string, text string").repartition(3)
    path = str(tmp_path / "asked")
    open(path, "w").close()
    found = {(r.doc_id, r.ord): (r.summary, r.how) for r in summaries.summarised(nodes, recording(path), size=size).collect()}
    many = "alone" if size == 1 else "together"
    assert found == {
        (1, 1): ("of root(a,b,c)", many), (1, 2): ("of a()", many), (1, 3): ("of b(b1,b2)", many), (1, 4): ("tiny", "own"), (1, 5): ("of b2()", many), (1, 6): ("", "empty"), (1, 7): ("small", "own"),
        (2, 1): ("", "failed"), (2, 2): ("of lost()", "alone"), (3, 1): ("", "empty"), (3, 2): ("", "empty"),
    }
    asked = [json.loads(line) for line in open(path)]
    when = {title: t for t, title, _ in sorted(asked)}
    assert when["b2"] < when["b"] < when["root"] and when["a"] < when["root"]
    assert not {"b1", "c", "b3", "empty", "e1"} & set(when)


def test_children_s_lines_stay_within_a_budget(spark, monkeypatch):
    monkeypatch.setattr(summaries, "CHILDREN_TOKENS", 10)
    nodes = spark.createDataFrame([(1, 0, None, 0, "top", LONG)] + [(1, k, 0, 1, f"n{k}", "x" * 20) for k in range(1, 9)], "doc_id long, ord int, parent_ord int, depth int, title string, text string")

    class Count:
        def chat(self, prompt):
            return str(prompt.count("\n- ") + 0)

    found = {r.ord: r.summary for r in summaries.summarised(nodes, Count()).collect()}
    assert found[0] == "2" and found[3] == "x" * 20


def test_indexed_sections_have_summaries(spark):
    docs = spark.createDataFrame([("a.md", "g", 1, "# A\n" + LONG + "\n## B\nshort\n# C\nalso short")], "doc_name string, doc_group string, doc_version int, text string")
    none = lambda s: s.select("section_id", "title", "title", "title").toDF("section_id", "name", "type", "relevance").filter("false")

    class First:
        def chat(self, prompt):
            return "sum" + str(prompt.count("- B: ## B"))

    g = indexing.index_markdown(DocumentGraph(spark), docs, none, summarise=First(), size=1)
    assert {r.title: r.summary for r in g["sections"].collect()} == {"A": "sum1", "B": "## B\nshort", "C": "# C\nalso short"}
