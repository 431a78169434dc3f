"""Command line: ``python -m arbograph init|index|query|sessions|enrich|stats|export|structure``.

A graph lives in numbered folders below ``--graph``; every command that writes
reads the latest and writes the next.  Models are named as ``module:attribute``.
``structure`` needs no graph: it writes nested JSON structures of Markdown files.
Tables that a command stores on its way are removed when it ends.
"""

from __future__ import annotations

import argparse
import importlib
import os

from pyspark.sql import functions as F

from arbograph.functions import models
from arbograph.graph import DocumentGraph
from arbograph.operators import answers, reads, retrieval, sessions, summaries, views, writes
from arbograph.plans import indexing
from arbograph.runlog import RunLog
from arbograph.session import local_session, scratch
from arbograph.sources import documents as source


def _versions(folder: str) -> list[int]:
    return sorted(int(n) for n in os.listdir(folder) if n.isdigit()) if os.path.isdir(folder) else []


def _load(spark, folder: str) -> DocumentGraph:
    found = _versions(folder)
    if not found:
        raise SystemExit(f"no graph in {folder}; run init first")
    return DocumentGraph.read(spark, f"{folder}/{found[-1]}")


def _save(g: DocumentGraph, folder: str) -> str:
    path = f"{folder}/{(_versions(folder) or [0])[-1] + 1}"
    g.write(path)
    return path


def _model(name: str | None, default):
    if name is None:
        return default
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)()


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="arbograph", description=__doc__.splitlines()[0])
    commands = parser.add_subparsers(dest="command", required=True)
    for name, about in (("init", "an empty graph"), ("index", "Markdown files"), ("query", "answer a question"), ("enrich", "ask for missing relationships"), ("sessions", "list conversations"), ("stats", "rows of each table"), ("export", "nodes and edges as JSON"), ("structure", "nested JSON of Markdown files")):
        c = commands.add_parser(name, help=about)
        if name != "structure":
            c.add_argument("--graph", required=True)
        c.add_argument("--model", help="a client, as module:attribute")
        if name == "index":
            c.add_argument("--markdown", required=True, help="files or a pattern")
            c.add_argument("--log", help="a folder for a row of JSON a step")
            c.add_argument("--group")
            c.add_argument("--version", type=int, default=1)
            c.add_argument("--terms", help="a CSV file of name,type")
        if name == "query":
            c.add_argument("question")
            c.add_argument("--entity", action="append", default=[])
            c.add_argument("--session", type=int, help="go on with a session; else a new one is begun")
            c.add_argument("--keep", action="store_true", help="store the session with its turn")
        if name == "enrich":
            c.add_argument("--min-shared", type=int, default=2)
            c.add_argument("--limit", type=int, default=50)
            c.add_argument("--dry-run", action="store_true")
        if name in ("export", "structure"):
            c.add_argument("--out", required=True, help="a new folder")
        if name == "structure":
            c.add_argument("--markdown", required=True, help="files or a pattern")
            c.add_argument("--least-tokens", type=int, help="merge smaller sections")
            c.add_argument("--summaries", action="store_true")
            c.add_argument("--summary-tokens", type=int, default=summaries.SHORT, help="texts with fewer are their own summaries")
            c.add_argument("--description", action="store_true")
            c.add_argument("--text", action="store_true")
            c.add_argument("--no-node-ids", action="store_true")
    a = parser.parse_args(args)
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    with scratch(spark):
        _run(spark, a)


def _run(spark, a: argparse.Namespace) -> None:
    if a.command == "init":
        print(_save(writes.empty_graph(spark), a.graph))
        return
    if a.command == "structure":
        client = _model(a.model, models.FirstSentence())
        found = indexing.markdown_structures(
            source.read_markdown(spark, a.markdown), a.least_tokens, client if a.summaries else None, a.summary_tokens,
            node_ids=not a.no_node_ids, text=a.text, describe=client if a.description else None,
        )
        source.write_structures(found, a.out)
        print(a.out)
        return
    g = _load(spark, a.graph)
    if a.command == "stats":
        reads.graph_stats(g).show(truncate=False)
    elif a.command == "index":
        docs = source.read_markdown(spark, a.markdown).select("doc_name", F.lit(a.group).cast("string").alias("doc_group"), F.lit(a.version).alias("doc_version"), "text")
        client = _model(a.model, None)
        if a.terms:
            terms = spark.read.csv(a.terms, schema="name string, type string")
            extract = lambda s: retrieval.extract_entities(s, terms)
        else:
            from arbograph.operators import extraction

            extract = lambda s: extraction.extract_entities(s, client or models.FirstSentence())
        print(_save(indexing.index_markdown(g, docs, extract, client, log=RunLog(spark, a.log)), a.graph))
    elif a.command == "export":
        views.write_graph(g, a.out)
        print(a.out)
    elif a.command == "query":
        question = spark.createDataFrame([(1, a.question)], "question_id long, question string").withColumn("intent", models.intent(F.col("question")))
        names = spark.createDataFrame([(1, k, n) for k, n in enumerate(a.entity, 1)], "question_id long, ord int, name string")
        question = question.withColumn("session_id", F.lit(a.session).cast("long"))
        g, found, turns = answers.ask(g, question, names, _model(a.model, models.FirstSentence()))
        print(found.answers.first()["answer"])
        if a.keep:
            print(f"session {turns.first()['session_id']} in {_save(g, a.graph)}")
    elif a.command == "sessions":
        sessions.list_sessions(g).select("session_id", "title", "started_at").show(truncate=False)
    elif a.command == "enrich":
        from arbograph.operators import extraction

        client = _model(a.model, models.FirstSentence())
        if a.dry_run:
            extraction.enrich(g, client, a.min_shared, a.limit).groupBy("relationship").count().show()
        else:
            print(_save(indexing.enrich(g, client, a.min_shared, a.limit), a.graph))


if __name__ == "__main__":
    main()
