import json
from pathlib import Path

import pytest

from arbograph import __main__ as cli
from arbograph.plans import indexing
from arbograph.runlog import RunLog
from arbograph.session import materialise, scratch, shared_dir


def test_a_graph_is_made_indexed_and_asked(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(cli, "local_session", lambda: spark)
    graph = str(tmp_path / "graph")
    (tmp_path / "a.md").write_text("# Report\nAcme makes bolts. And more.")
    (tmp_path / "terms.csv").write_text("Acme,ORGANIZATION\nbolts,PRODUCT\n")
    with pytest.raises(SystemExit):
        cli.main(["stats", "--graph", graph])
    cli.main(["init", "--graph", graph])
    cli.main(["index", "--graph", graph, "--markdown", str(tmp_path / "a.md"), "--terms", str(tmp_path / "terms.csv"), "--log", str(tmp_path / "log")])
    assert "sections" in {r.step for r in RunLog.read(spark, str(tmp_path / "log")).collect()}
    cli.main(["query", "--graph", graph, "What is Acme?", "--entity", "acme", "--keep"])
    cli.main(["query", "--graph", graph, "What else?", "--entity", "bolts", "--session", "1"])
    cli.main(["sessions", "--graph", graph])
    cli.main(["enrich", "--graph", graph, "--dry-run"])
    cli.main(["stats", "--graph", graph])
    cli.main(["export", "--graph", graph, "--out", str(tmp_path / "json")])
    lines = {k: [json.loads(x) for f in (tmp_path / "json" / k).glob("part-*") for x in f.read_text().splitlines()] for k in ("nodes", "edges")}
    assert {"id": "doc_1", "type": "document", "label": "a.md"}.items() <= next(x for x in lines["nodes"] if x["type"] == "document").items()
    assert {(x["source"], x["target"], x["type"]) for x in lines["edges"]} >= {("doc_1", "sec_1", "contains"), ("sec_1", "ent_1", "mentions")}
    said = capsys.readouterr().out
    assert "Acme makes bolts" in said and "section_entities" in said and "session 1 in" in said and "What is Acme?" in said


LONG = "Many words stand here. " * 60


def test_markdown_files_to_structures(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(cli, "local_session", lambda: spark)
    (tmp_path / "a.md").write_text(f"# One\n{LONG}\n## Two\nShort.\n```\n# none\n```\n## Three\n")
    (tmp_path / "b.md").write_text("No heading")
    before = set(Path(shared_dir(spark).removeprefix("file:")).iterdir())
    cli.main(["structure", "--markdown", str(tmp_path / "*.md"), "--out", str(tmp_path / "out"), "--summaries", "--description"])
    assert set(Path(shared_dir(spark).removeprefix("file:")).iterdir()) == before
    found = {x["doc_name"]: x for f in (tmp_path / "out").glob("part-*") for x in map(json.loads, f.read_text().splitlines())}
    assert found["b.md"] == {"doc_name": "b.md", "structure": []}
    one = found["a.md"]["structure"][0]
    assert list(found["a.md"]) == ["doc_name", "doc_description", "structure"]
    assert list(one) == ["title", "node_id", "prefix_summary", "line_num", "nodes"] and one["prefix_summary"]
    assert [(n["title"], n["node_id"], n["line_num"]) for n in (one, *one["nodes"])] == [("One", "0000", 1), ("Two", "0001", 3), ("Three", "0002", 8)]
    assert one["nodes"][0]["summary"].startswith("## Two\nShort.") and "prefix_summary" not in one["nodes"][0]


def test_structures_with_texts_and_merged(spark):
    docs = spark.createDataFrame([(1, "x", "# A\nb\n## C\nd"), (2, None, None), (3, "", "")], "doc_id long, doc_name string, text string")
    found = {r.doc_id: json.loads(r.json) for r in indexing.markdown_structures(docs, node_ids=False, text=True).collect()}
    assert found[1]["structure"] == [{"title": "A", "text": "# A\nb", "line_num": 1, "nodes": [{"title": "C", "text": "## C\nd", "line_num": 3}]}]
    assert found[2] == {"structure": []} and found[3] == {"doc_name": "", "structure": []}
    merged = {r.doc_id: json.loads(r.json) for r in indexing.markdown_structures(docs, least_tokens=100).collect()}
    assert [n["title"] for n in merged[1]["structure"]] == ["A"] and "nodes" not in merged[1]["structure"][0]
    assert indexing.markdown_structures(docs.filter("false")).count() == 0


def test_stored_steps_go_with_their_block(spark):
    kept = materialise(spark.range(3), "kept")
    with pytest.raises(ValueError):
        with scratch(spark):
            outer = materialise(spark.range(3), "outer")
            with scratch(spark):
                inner = Path(materialise(spark.range(3), "inner").inputFiles()[0].removeprefix("file:")).parent
            assert not inner.exists() and outer.count() == 3
            folder = Path(outer.inputFiles()[0].removeprefix("file:")).parent
            raise ValueError
    assert not folder.exists() and kept.count() == 3
