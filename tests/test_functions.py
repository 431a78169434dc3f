"""Column expressions, sequential algorithms and models, against plain Python."""

import collections
import itertools
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from arbograph.functions import models, text
from arbograph.operators import enrichment, markdown, patterns, retrieval, structure, vectors
from arbograph.sources import documents as source


def one(spark, value, expression, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expression(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize("given, wanted", [("<physical_index_5>", 5), ("physical_index_12", 12), ("7", 7), ("page seven", None), (None, None)])
def test_physical_index(spark, given, wanted):
    assert one(spark, given, text.physical_index) == wanted


@pytest.mark.parametrize("given, wanted", [("1.2.3", "1.2"), ("1", None), ("4.10", "4")])
def test_parent_code(spark, given, wanted):
    assert one(spark, given, text.parent_code) == wanted


@pytest.mark.parametrize("given, wanted", [("Acme (ORGANIZATION)", "Acme"), ("Acme", "Acme"), ("A (b) (C)", "A (b)")])
def test_type_suffix(spark, given, wanted):
    assert one(spark, given, text.without_type_suffix) == wanted


@pytest.mark.parametrize("given, wanted", [("Intro.......5", "Intro: 5"), ("Intro . . . . . . 5", "Intro :  5"), ("e.g. this", "e.g. this")])
def test_dot_leaders(spark, given, wanted):
    assert one(spark, given, text.without_dot_leaders).replace("  ", " ") == wanted.replace("  ", " ")


@pytest.mark.parametrize("given, wanted", [("x", (-1, -1)), ("<start_index_3>a<start_index_9>", (3, 9))])
def test_page_tags(spark, given, wanted):
    assert tuple(one(spark, given, text.tagged_pages)) == wanted


@pytest.mark.parametrize("given, wanted", [("a<physical_index_1>x\ny<physical_index_1>b<physical_index_2>z<physical_index_2>", "ab<physical_index_2>z<physical_index_2>"), ("none", "none")])
def test_first_block_goes(spark, given, wanted):
    assert one(spark, given, text.without_first_block) == wanted


def test_large_sections_are_split(spark):
    spans = spark.createDataFrame([(1, 1, "A", 1, 9), (1, 2, "B", 10, 12)], "doc_id long, ord int, title string, start_index int, end_index int")
    parts = spark.createDataFrame([(1, 1, 1, "A1", 3, 5), (1, 1, 2, "A2", 6, 9)], "doc_id long, ord int, part int, title string, start_index int, end_index int")
    assert [(r.title, r.start_index, r.end_index) for r in structure.split_large(spans, parts).orderBy("ord", "part").collect()] == [("A", 1, 3), ("A1", 3, 5), ("A2", 6, 9), ("B", 10, 12)]
    pages = spark.createDataFrame([(1, 1, "x", 1), (1, 2, "y", 1)], "doc_id long, page_no int, text string, tokens long")
    assert structure.labelled_text(spans.limit(1).withColumn("end_index", F.lit(1)), pages).first().text == "<physical_index_1>\nx\n<physical_index_1>\n"
    assert [r.ord for r in structure.sampled(spans, 1).collect()] == [r.ord for r in structure.sampled(spans, 1).collect()]


def test_zero_padding_keeps_long_numbers(spark):
    assert one(spark, 7, text.zero_padded, "int") == "0007"
    assert one(spark, 12345, text.zero_padded, "int") == "12345"


@pytest.mark.parametrize("given, wanted", [('```json\n{"a": None,}\n```', '{"a": null}'), ("[1, 2,]", "[1, 2]"), ("no json", None)])
def test_repaired_json(spark, given, wanted):
    assert one(spark, given, text.repaired_json) == wanted


@pytest.mark.parametrize("given, wanted", [("LEADS, surely", "LEADS"), ("leads or part_of", "PART_OF"), ("NONE", None), ("nothing", None)])
def test_parse_relationship(spark, given, wanted):
    assert one(spark, given, enrichment.parse_relationship) == wanted


@pytest.mark.parametrize("given, wanted", [(0.149, "auto"), (0.15, "llm"), (0.299, "llm"), (0.3, "reject")])
def test_resolution_bounds(spark, given, wanted):
    assert one(spark, given, vectors.resolution_action, "double") == wanted


@pytest.mark.parametrize("given, wanted", [("Compare A and B", "COMPARISON"), ("What is A?", "LOOKUP"), ("Tell me more", "EXPLORATION"), (None, "EXPLORATION"), ("How are A and B related?", "RELATIONSHIP"), ("What changed?", "TEMPORAL")])
def test_intents(spark, given, wanted):
    assert one(spark, given, models.intent) == wanted


def test_group_pages_covers_all_pages_within_bounds():
    rng = random.Random(3)
    for _ in range(200):
        tokens = [rng.randint(1, 60) for _ in range(rng.randint(1, 40))]
        groups = structure.group_pages(tokens, 100)
        assert groups[0][0] == 0 and groups[-1][1] == len(tokens) - 1
        assert all(b[0] in (a[1], a[1] + 1) for a, b in zip(groups, groups[1:]))
        if sum(tokens) <= 100:
            assert len(groups) == 1
    assert structure.group_pages([], 100) == []


def test_page_groups_of_many_documents_in_batches(spark):
    rng = random.Random(5)
    docs = {d: [rng.randrange(60) for _ in range(rng.choice([1, 2, 5, 30]))] for d in [*range(40), None]}
    rows = [(d, k, t) for d, tokens in docs.items() for k, t in enumerate(tokens, 1)]
    rng.shuffle(rows)
    pages = spark.createDataFrame(rows, "doc_id long, page_no int, tokens long")
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "7")
        for limit in (50, 200, 10**6):
            found = structure.page_groups(pages, limit)
            expected = [(d, k, a + 1, b + 1, sum(t[a : b + 1])) for d, t in docs.items() for k, (a, b) in enumerate(structure.group_pages(t, limit))]
            assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, expected))
    finally:
        spark.conf.set(key, before)
    assert "FlatMapGroups" not in found._jdf.queryExecution().toString()  # a call a document takes milliseconds each


def test_thinning_merges_what_is_below(spark):
    rng = random.Random(4)
    rows = []
    for doc in range(60):
        level = 1
        for k in range(1, rng.randint(2, 14)):
            rows.append((doc, k, level, f"t{k}", f"{'#' * level} t{k}" + " word" * rng.choice((0, 1, 5, 40)) + rng.choice(("", "\n", " \n\n"))))
            level = rng.randint(1, min(level + 1, 6))
    sections = spark.createDataFrame(rows, "doc_id long, ord int, level int, title string, text string")
    total = {(r.doc_id, r.ord): r.tokens for r in markdown.md_subtree_tokens(sections).collect()}

    def merged(doc, own):
        """By recursion: what a node and the nodes below it become."""
        node, inside = own[0], []
        for row in own[1:]:
            if row[2] <= inside[-1][0][2] if inside else True:
                inside.append([row])
            else:
                inside[-1].append(row)
        kept = [x for part in inside for x in merged(doc, part)]
        if total[doc, node[1]] >= 20:
            return [(node[1], node[4], total[doc, node[1]]), *kept]
        text = node[4]
        for _, part, _ in kept:
            text += ("" if text.endswith("\n") else "\n\n") + part
        return [(node[1], text, -(-len(text) // 4) if kept else total[doc, node[1]])]

    expected = set()
    for doc in range(60):
        own, roots = [r for r in rows if r[0] == doc], []
        for row in own:
            if roots and row[2] > roots[-1][0][2]:
                roots[-1].append(row)
            else:
                roots.append([row])
        expected |= {(doc, *x) for part in roots for x in merged(doc, part)}
    assert {(r.doc_id, r.ord, r.text, r.tokens) for r in markdown.md_thinning(sections, 20).collect()} == expected


def test_markdown_headings_and_fences(spark):
    docs = spark.createDataFrame([(1, "lost\n# A\nx\n```\n# no\n```\n  ## B\n### C"), (2, ""), (3, None)], "doc_id long, text string")
    assert [(r.line_num, r.title) for r in markdown.md_headings(docs).orderBy("line_num").collect()] == [(2, "A"), (7, "B"), (8, "C")]
    sections = markdown.md_sections(docs).orderBy("ord").collect()
    assert [(r.level, r.title) for r in sections] == [(1, "A"), (3, "C")]
    assert sections[0].text == "# A\nx\n```\n# no\n```\n  ## B"


def test_toc_decisions(spark):
    first, second, third = structure.WAYS
    rows = [(1.0, first, "accept"), (0.7, first, "fix"), (0.6, first, second), (0.0, second, third), (0.99, third, "fix"), (0.6, third, "failed"), (1.0, third, "accept")]
    found = spark.createDataFrame(rows, "a double, w string, d string").withColumn("is", structure.toc_decision(F.col("a"), F.col("w"))).collect()
    assert all(r["is"] == r.d for r in found)


def test_context_cuts_the_first_section_that_does_not_fit(spark):
    rows = [(1, k, k, f"T{k}", "", None, "x" * 5000, 0, 1, "d") for k in range(1, 4)]
    sections = spark.createDataFrame(rows, "question_id long, ord int, section_id long, title string, relevance string, summary string, text_content string, depth_level int, start_index int, doc_name string")
    parts = retrieval.context_budget(sections, 3000).orderBy("ord").collect()
    assert [(r.ord, r.truncated) for r in parts] == [(1, False), (2, False), (3, True)]
    assert "[...truncated...]" in parts[2].text and len(parts[2].text) < 3000 * 3


def test_patterns_check_their_labels():
    with pytest.raises(ValueError):
        patterns.match("e", "entity").out("m", "mentions", "s", "section")


def test_clients_are_called_again_and_failures_have_a_default(spark):
    class Flaky:
        calls = 0

        def chat(self, prompt):
            self.calls += 1
            if self.calls < 3:
                raise OSError("no")
            return "yes"

    waits = []
    assert models.Retrying(Flaky(), 5, waits.append).chat("?") == "yes" and waits == [2.0, 4.0]
    with pytest.raises(models.ModelError):
        models.Retrying(Flaky(), 2, waits.append).chat("?")
    rows = spark.createDataFrame([("a. b",), (None,)], "t string")
    assert [r.answer for r in models.answers(rows, F.col("t"), models.FirstSentence(), default="-").collect()] == ["a", "-"]


def test_embeddings_are_unit_vectors(spark):
    rows = models.embeddings(spark.createDataFrame([("red bolt",), (None,)], "t string"), "t", models.HashEmbedder(8)).collect()
    assert abs(sum(x * x for x in rows[0].embedding) - 1) < 1e-6 and not any(rows[1].embedding)


def test_sources(spark, tmp_path):
    (tmp_path / "a.md").write_text("# A\ntext")
    assert [(r.doc_name, r.text) for r in source.read_markdown(spark, str(tmp_path / "a.md")).collect()] == [("a.md", "# A\ntext")]
    (tmp_path / "b.pdf").write_bytes(b"one\x0ctwo")
    pages = source.read_pages(spark, str(tmp_path), lambda data: data.decode().split("\x0c")).orderBy("page_no").collect()
    assert [(r.doc_name, r.page_no, r.text) for r in pages] == [("b.pdf", 1, "one"), ("b.pdf", 2, "two")]
    with pytest.raises(FileNotFoundError):
        source.read_pages(spark, str(tmp_path / "none"), None)
    with pytest.raises(ValueError):
        source.read_pages(spark, str(tmp_path / "a.md"), None)
    (tmp_path / "c.PDF").write_bytes(b"three")
    assert [r.text for r in source.read_pages(spark, str(tmp_path / "c.PDF"), lambda data: [data.decode()]).collect()] == ["three"]


def test_structures_survive_a_round_trip(spark, tmp_path):
    tree = spark.createDataFrame([(1, 1, None, "A", "0000", 1, 5), (1, 2, 1, "B", "0001", 2, 3), (1, 3, 2, "C", "0002", 3, 3), (1, 4, None, "D", "0003", 5, 9)], "doc_id long, ord int, parent_ord int, title string, node_id string, start_index int, end_index int")
    source.write_structures(structure.nested_json(tree), str(tmp_path / "s"))
    back = structure.flatten_tree(source.read_structures(spark, str(tmp_path / "s" / "*.txt"))).orderBy("ord").collect()
    assert [(r.depth, r.title, r.node_id, r.end_index) for r in back] == [(0, "A", "0000", 5), (1, "B", "0001", 3), (2, "C", "0002", 3), (0, "D", "0003", 9)]


def test_structures_are_built_from_the_leaves_up(spark):
    rng = random.Random(8)
    rows, expected = [], {}
    for doc in range(30):
        nodes, roots = {}, []
        for k in range(rng.randint(1, 25)):
            parent = rng.choice([None, *nodes, k - 1 if k else None, 999]) if nodes else None
            own = {"title": rng.choice(('a "quoted" \\ title', "é漢\n", "")), "node_id": f"{k:04}", "start_index": k, "summary": rng.choice((None, "s,}", ""))}
            rows.append((doc, k, parent, own["title"], own["node_id"], k, own["summary"]))
            nodes[k] = {c: v for c, v in own.items() if v is not None}
            (nodes[parent].setdefault("nodes", []) if parent in nodes else roots).append(nodes[k])
        expected[doc] = {"structure": roots}
    tree = spark.createDataFrame(rng.sample(rows, len(rows)), "doc_id long, ord int, parent_ord int, title string, node_id string, start_index int, summary string")
    found = {r.doc_id: json.loads(r.json) for r in structure.nested_json(tree).collect()}
    assert found == expected
    assert list(found[0]["structure"][0])[:3] == ["title", "node_id", "start_index"]
    few = {r.doc_id: r.json for r in structure.nested_json(tree, ("node_id", "title")).collect()}
    assert few[0].startswith('{"structure":[{"node_id":"0000","title":') and "summary" not in few[0]
    assert structure.nested_json(tree.filter("false")).count() == 0
    chain = spark.range(40).select(F.lit(1).cast("long").alias("doc_id"), F.col("id").cast("int").alias("ord"), (F.nullif("id", F.lit(0)) - 1).cast("int").alias("parent_ord"), F.concat(F.lit("n"), "id").alias("title"))
    deep = json.loads(structure.nested_json(chain).first().json)["structure"]
    for k in range(40):
        assert deep[0]["title"] == f"n{k}"
        deep = deep[0].get("nodes")
    assert deep is None
    with pytest.raises(ValueError):
        structure.nested_json(tree, ("title", "other"))


def test_deep_structures_are_flattened_to_their_leaves(spark):
    nested = {"title": "n30"}
    for k in range(29, -1, -1):
        nested = {"title": f"n{k}", "nodes": [nested]}
    rows = structure.flatten_tree(spark.createDataFrame([(1, json.dumps({"structure": [nested]})), (2, "{}"), (3, None)], "doc_id long, json string")).collect()
    assert sorted((r.depth, r.title) for r in rows) == [(k, f"n{k}") for k in range(31)]


def test_vectors_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 6))
    x[7] = 0
    df = spark.createDataFrame([(k, "ab"[k % 3 > 0], v.tolist()) for k, v in enumerate(x)] + [(900, None, [1.0] * 6), (901, "a", None), (902, "a", [1.0])], "entity_id long, entity_type string, name_embedding array<double>")
    top = lambda: sorted((r.probe_id, r.id, r.score, r.ord) for r in vectors.cosine_topk(df.selectExpr("entity_id as id", "name_embedding as vector").filter("id < 900"), df.selectExpr("entity_id as id", "name_embedding as vector").filter("id % 9 = 0 and id < 900"), 4).collect())
    near = lambda e: sorted((r.probe_id, r.entity_id, r.distance, r.ord) for r in vectors.similar_entities(df, df, 0.8, 3, e).collect())
    whole = top(), near(False), near(True)
    u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    for probe in (0, 9, 18):
        score = (u @ u[probe]).round(6)
        assert [i for p, i, _, _ in sorted(whole[0], key=lambda r: r[3]) if p == probe] == np.lexsort((np.arange(300), -score))[:4].tolist()
    assert all(i < p for p, i, _, _ in whole[2]) and all(i != p and (i % 3 > 0) == (p % 3 > 0) and d < 0.8 for p, i, d, _ in whole[1])
    expected = sum(min(3, int(((np.round(1 - (u @ u[p]).round(6), 6) < 0.8) & ((np.arange(300) % 3 > 0) == (p % 3 > 0)) & (np.arange(300) < p)).sum())) for p in range(300))
    assert len(whole[2]) == expected
    monkeypatch.setattr(vectors, "ROWS", 37)
    monkeypatch.setattr(vectors, "PROBES", 11)
    monkeypatch.setattr(vectors, "AT_ONCE", 4)
    assert (top(), near(False), near(True)) == whole


def test_config():
    assert source.load_config({"query": {"hops": 3}}, {"ARBOGRAPH_QUERY_BUDGET": "9"})["query"] == {"budget": 9, "hops": 3}
    with pytest.raises(ValueError):
        source.load_config({"query": {"hop": 3}}, {})


def test_resolved_names_take_the_smallest_id(spark):
    names = spark.createDataFrame([(2, "big apple"), (1, "apple pie"), (3, "pear")], "entity_id long, low string")
    keys = spark.createDataFrame([("apple",), ("ear",), ("a",), ("zzz",)], "key string")
    found = {(r.key, r.entity_id) for r in retrieval.containing(names, keys).collect()}
    assert found == {("apple", 1), ("apple", 2), ("ear", 3), ("a", 1), ("a", 2), ("a", 3)}


@pytest.mark.parametrize("block", [1, 3, 2_048])
def test_pairs_of_sections_with_many_mentions(spark, monkeypatch, block):
    from arbograph.graph import DocumentGraph

    monkeypatch.setattr(enrichment, "BLOCK", block)
    rng = random.Random(block)
    mentions = [(1, e) for e in range(20)] * 2 + [(rng.randrange(2, 8), rng.randrange(20)) for _ in range(40)] + [(9, 3)]
    edges = [(rng.randrange(20), rng.randrange(20)) for _ in range(20)]
    g = DocumentGraph(spark, {
        "section_entities": spark.createDataFrame([*mentions, (None, 1), (1, None)], "section_id long, entity_id long"),
        "entity_relationships": spark.createDataFrame(edges, "source_entity long, target_entity long"),
        "entities": spark.createDataFrame([(e, f"e{e}", "X") for e in range(20)], "entity_id long, name string, entity_type string"),
    })
    expected = collections.Counter()
    for section in {s for s, _ in mentions}:
        expected.update(itertools.combinations(sorted({e for s, e in mentions if s == section}), 2))
    linked = {tuple(sorted(x)) for x in edges}
    found = {(r.entity1_id, r.entity2_id): r.shared_sections for r in enrichment.cooccurring_pairs(g).collect()}
    assert found == {pair: n for pair, n in expected.items() if n >= 2 and pair not in linked}


def test_blocks_behind_a_probe_are_left_out(spark, monkeypatch):
    monkeypatch.setattr(vectors, "ROWS", 20)
    monkeypatch.setattr(vectors, "PROBES", 20)
    ids = [*range(100), *range(5_000, 5_100), *range(90_000, 99_000, 90), -7, None]
    rows = spark.createDataFrame([(i, "a", 2, [1.0, 0.0]) for i in ids] + [(1, "b", 2, [1.0, 0.0])], "id long, key string, size int, vector array<double>")
    held, sent = (list(map(tuple, x.select(*vectors.BLOCKS, "id").collect())) for x in vectors._ranges(rows, rows))
    sizes = collections.Counter(x[:4] for x in held)
    assert max(sizes.values()) <= 20 and {x[:4] for x in sent} == set(sizes)
    n = len({x[3] for x in sent if x[0] == "a"})  # rows and probes have the same blocks
    assert 0 < len(sizes) <= n * (n + 1) / 2
    # each pair with a smaller id meets once
    by_block = collections.defaultdict(list)
    for *block, i in held:
        by_block[tuple(block)].append(i)
    met = collections.Counter((i, p) for *block, p in sent for i in by_block[tuple(block)] if i < p)
    own = sorted(i for i in ids if i is not None)
    assert met == collections.Counter(itertools.combinations(own, 2))
    assert vectors._ranges(rows.filter("key = 'b'"), rows) == (None, None)
