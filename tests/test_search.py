"""Conditions compiled and refused, descriptions, and walks down trees against full scans."""

import json
import random

import pytest

from arbograph.functions import models
from arbograph.operators import search

COLUMNS = {"lang": "string", "n_chars": "long", "made": "date", "rate": "double", "odd name": "string"}


def condition(column, comparison, value):
    return {"column": column, "comparison": comparison, "value": value}


@pytest.fixture(scope="module")
def documents(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "d")
    rows = [(k, "en de fr".split()[k % 3] if k % 7 else None, 100 * k, k / 10, f"x{k}'; drop") for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, n_chars long, rate double, `odd name` string")
    df.selectExpr("*", "date_add(date'2024-01-01', cast(doc_id as int)) as made").write.parquet(path)
    return spark.read.parquet(path)


CASES = [
    ([condition("lang", "=", "en")], lambda k: k % 3 == 0 and k % 7),
    ([condition("lang", "!=", "en"), condition("n_chars", ">=", 2000)], lambda k: k % 3 and k % 7 and k >= 20),
    ([condition("lang", "in", ["de", "fr"]), condition("n_chars", "<", 700)], lambda k: k % 3 and k % 7 and k < 7),
    ([condition("made", "<=", "2024-01-05")], lambda k: k <= 4),
    ([condition("rate", ">", 3)], lambda k: k > 30),
    ([condition("odd name", "starts with", "x1"), condition("odd name", "contains", "'; drop")], lambda k: str(k).startswith("1")),
    ([condition("lang", "=", "' or 1=1 --")], lambda k: False),
]


def test_conditions_are_typed_predicates(documents):
    compiled = {i: search.predicate(json.dumps(c), COLUMNS) for i, (c, _) in enumerate(CASES)}
    found = {(r.question_id, r.doc_id) for r in search.by_metadata(documents, compiled).collect()}
    assert found == {(i, k) for i, (_, holds) in enumerate(CASES) for k in range(40) if holds(k)}


def test_predicates_reach_the_scan(documents):
    found = search.by_metadata(documents, {1: search.predicate(json.dumps(CASES[1][0]), COLUMNS)})
    plan = found._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters") :].split("]")[0]
    assert "GreaterThanOrEqual(n_chars,2000)" in pushed and "EqualTo(lang,en)" in pushed
    read = plan[plan.index("ReadSchema") :]
    assert "rate" not in read and "made" not in read


HOSTILE = [
    "doc_id = 1 or 1 = 1", "[]", "{}", "null", "[1]", '[{"column": "lang"}]', "not json", "[" * 5000,
    json.dumps([condition("text", "=", "x")]), json.dumps([condition("lang` = 'x' or `lang", "=", "x")]), json.dumps([condition("lang", "= 'x' or", "x")]), json.dumps([condition("lang", "=", 1)]),
    json.dumps([condition("n_chars", "=", "1 or 1=1")]), json.dumps([condition("n_chars", "=", True)]), json.dumps([condition("n_chars", "contains", 1)]), json.dumps([condition("n_chars", "=", 2**63)]),
    json.dumps([condition("made", "=", "today")]), json.dumps([condition("lang", "in", [])]), json.dumps([condition("lang", "in", "en")]), json.dumps([condition("lang", "in", ["a", {}])]), json.dumps([condition("lang", "=", None)]),
    json.dumps([condition("lang", "=", "x") | {"sql": "drop"}]), json.dumps([condition("lang", "=", "x")] * 51), json.dumps([condition(["lang"], "=", "x")]),
]


@pytest.mark.parametrize("answer", HOSTILE)
def test_other_answers_are_refused(answer):
    with pytest.raises(search.Refused):
        search.predicate(answer, COLUMNS)


def test_a_model_s_conditions(documents):
    class Reads:
        def chat(self, prompt):
            assert "n_chars (long)" in prompt and prompt.endswith("long English texts")
            return models.Reply("```json\n" + json.dumps([condition("lang", "=", "en"), condition("n_chars", ">", 3000)]) + "\n```")

    found = search.by_metadata(documents, {5: search.ask_predicate("long English texts", Reads(), COLUMNS)})
    assert sorted(r.doc_id for r in found.collect()) == [33, 36, 39]


def test_descriptions(spark):
    rows = [(k, f"n{k}", "about bolts" if k % 4 == 0 else "about nuts" if k % 4 < 3 else None) for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, doc_name string, doc_description string")
    questions = spark.createDataFrame([(1, "bolts"), (2, "nuts")], "question_id long, question string")

    class Judge:
        def chat(self, prompt):
            parts = prompt.split("\n\n")
            if prompt.startswith("May this"):
                return json.dumps(parts[1] in parts[3])
            return json.dumps([{"index": r["index"], "relevant": parts[1] in r["text"]} for r in json.loads(parts[2]) if r["index"] != 1])

    found = {(r.question_id, r.doc_id) for r in search.by_description(docs, questions, Judge(), 7).collect()}
    assert found == {(1 if k % 4 == 0 else 2, k) for k in range(30) if k % 4 < 3}
    assert search.by_description(docs, questions.filter("false"), Judge()).count() == 0


def trees(seed, docs):
    rng, rows, best = random.Random(seed), [], {}
    for doc in range(docs):
        parents = {0: None}
        for k in range(1, rng.randint(2, 60)):
            parents[k] = rng.choice([None, *parents]) if rng.random() < 0.9 else None
        own = {k: rng.random() for k in parents}
        under = dict(own)
        for k in sorted(parents, reverse=True):
            if parents[k] is not None:
                under[parents[k]] = max(under[parents[k]], under[k])
        leaves = {k for k in parents if k not in parents.values()}
        rows += [(doc, k, p, f"{own[k] if k in leaves else 0}", f"{under[k]}") for k, p in parents.items()]
        best[doc] = under
    return rows, best


@pytest.mark.parametrize("width", [1, 3])
def test_an_exact_score_finds_what_a_full_scan_finds(spark, width):
    rows, under = trees(2, 25)
    nodes = spark.createDataFrame(rows, "doc_id long, ord int, parent_ord int, title string, summary string")
    asked = spark.createDataFrame([(q, d, "?") for d in range(25) for q in (1, 2)], "question_id long, doc_id long, question string")
    found, rounds = search.tree_search(nodes, asked, lambda f: f.selectExpr("*", "cast(summary as double) as score"), width, width)
    got = {}
    for r in found.orderBy("question_id", "doc_id", "rank").collect():
        got.setdefault((r.question_id, r.doc_id), []).append((r.score, r.ord))
    for d, scores in under.items():
        full = sorted(((s, k) for k, s in scores.items()), key=lambda x: (-x[0], x[1]))[:width]
        assert got[1, d] == got[2, d] == full
    counts = {r.depth: r.scored for r in rounds.collect()}
    assert sum(counts.values()) < 2 * len(rows) and counts[0] == 2 * sum(r[2] is None for r in rows)


def test_a_model_scores_many_nodes_at_once(spark):
    rows, under = trees(9, 4)
    nodes = spark.createDataFrame(rows, "doc_id long, ord int, parent_ord int, title string, summary string")
    asked = spark.createDataFrame([(7, d, "q?") for d in range(4)], "question_id long, doc_id long, question string")

    class Reader:
        def chat(self, prompt):
            task, *parts = prompt.split("\n\n")
            assert parts[0] == "prefer leaves"
            if task == search.ONE_NODE:
                return parts[2].split("\n")[-1]
            listed = json.loads(parts[1])
            return json.dumps([{"index": r["index"], "score": float(r["text"].split("\n")[-1])} for r in listed if r["index"] != 2])

    found, _ = search.tree_search(nodes, asked, search.model_scores(Reader(), 4, "prefer leaves"), 2, 1)
    assert {r.doc_id: r.score for r in found.collect()} == {d: max(s.values()) for d, s in under.items()}


def test_nothing_to_search(spark):
    nodes = spark.createDataFrame([], "doc_id long, ord int, parent_ord int, title string, summary string")
    asked = spark.createDataFrame([(1, 1, "?")], "question_id long, doc_id long, question string")
    found, rounds = search.tree_search(nodes, asked, lambda f: f.selectExpr("*", "1.0D as score"))
    assert found.count() == 0 and rounds.count() == 0
