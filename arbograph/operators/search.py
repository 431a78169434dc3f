"""Documents found by metadata or by their descriptions, and sections by a walk down their trees.

A model never writes queries: what it answers is read as conditions on allowed
columns, with values of their types, which become typed predicates of one scan.
Anything else is refused.

A search down a tree scores the children of the best nodes so far, level by level
over all pairs of a question and a document, and goes on below the best ``width`` of
each; every round is stored.  With scores that are never below those of what lies
under a node, it finds the best that a look at all nodes finds.
"""

from __future__ import annotations

import datetime
import json
import re
from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arbograph.functions import models
from arbograph.operators import prompts
from arbograph.session import materialise

#: Questions whose predicates one scan decides, and conditions and values of each.
MAX_QUESTIONS, MAX_CONDITIONS, MAX_VALUES = 1_000, 50, 1_000


class Refused(ValueError):
    """An answer that is no list of allowed conditions."""


def _typed(value: object, kind: str) -> object:
    if kind == "string" and isinstance(value, str):
        return value
    if kind in ("int", "long") and isinstance(value, int) and not isinstance(value, bool) and -(2**63) <= value < 2**63:
        return value
    if kind == "double" and isinstance(value, int | float) and not isinstance(value, bool):
        return float(value)
    if kind == "date" and isinstance(value, str):
        try:
            return datetime.date.fromisoformat(value)
        except ValueError as e:
            raise Refused(f"{value!r} is no date") from e
    raise Refused(f"{value!r} is no {kind}")


_COMPARE: dict[str, Callable[[Column, Column], Column]] = {
    "=": lambda c, v: c == v, "!=": lambda c, v: c != v, "<": lambda c, v: c < v, "<=": lambda c, v: c <= v, ">": lambda c, v: c > v, ">=": lambda c, v: c >= v,
    "starts with": lambda c, v: c.startswith(v), "contains": lambda c, v: F.contains(c, v),
}


def predicate(answer: str, allowed: Mapping[str, str]) -> Column:
    """A JSON array of objects with column, comparison and value, all of which are to hold; ``allowed`` has the columns' types.

    ``in`` takes an array of values; null columns hold no condition.
    """
    fenced = re.search(r"(?s)```json\s*(.*?)```", answer)
    try:
        found = json.loads(fenced[1] if fenced else answer)
    except (ValueError, RecursionError) as e:
        raise Refused("the answer is no JSON") from e
    if not isinstance(found, list) or not 1 <= len(found) <= MAX_CONDITIONS:
        raise Refused("the answer is no list of conditions")
    out = []
    for x in found:
        if not isinstance(x, dict) or set(x) != {"column", "comparison", "value"} or not isinstance(x["column"], str) or not isinstance(x["comparison"], str):
            raise Refused(f"{x!r} is no condition")
        kind = allowed.get(x["column"])
        if kind is None:
            raise Refused(f"{x['column']!r} is no column to search by")
        column = F.col(f"`{x['column']}`")
        if x["comparison"] == "in":
            if not isinstance(x["value"], list) or not 1 <= len(x["value"]) <= MAX_VALUES:
                raise Refused("in takes some values")
            out.append(column.isin([_typed(v, kind) for v in x["value"]]))
        elif x["comparison"] in _COMPARE and (kind == "string" or " " not in x["comparison"] and x["comparison"] != "contains"):
            out.append(_COMPARE[x["comparison"]](column, F.lit(_typed(x["value"], kind))))
        else:
            raise Refused(f"{x['comparison']!r} is no comparison of a {kind}")
    return reduce(lambda a, b: a & b, out)


def ask_predicate(question: str, client: models.Client, allowed: Mapping[str, str]) -> Column:
    """The conditions that a model reads out of a question."""
    columns = ", ".join(f"{c} ({t})" for c, t in allowed.items())
    told = client.chat(f"Which documents does the question ask for? Answer as a JSON array of objects with column, comparison and value. Columns: {columns}. Comparisons: in, {', '.join(_COMPARE)}.\n\n{question}")
    return predicate(told.text if isinstance(told, models.Reply) else told, allowed)


def by_metadata(documents: DataFrame, predicates: Mapping[int, Column], columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """question_id and ``columns`` of the documents that each question's predicate holds for, in one scan that gets their alternative."""
    if not 1 <= len(predicates) <= MAX_QUESTIONS:
        raise ValueError(f"from 1 to {MAX_QUESTIONS} questions at a time")
    hits = F.array_compact(F.array(*(F.when(p, F.lit(q).cast("long")) for q, p in predicates.items())))
    kept = documents.filter(reduce(lambda a, b: a | b, predicates.values()))
    return kept.select(*columns, F.explode(hits).alias("question_id")).select("question_id", *columns)


DESCRIBED = "Which of these documents may hold what the question asks for? Answer as a JSON array of objects with index and relevant, true or false."
ONE_DOCUMENT = "May this document hold what the question asks for? Answer with true or false as JSON."


def by_description(documents: DataFrame, questions: DataFrame, client: models.Client, size: int = 20) -> DataFrame:
    """(question_id, doc_id) of documents (doc_id, doc_name, doc_description) that a model takes for relevant, many to a prompt.

    Every question meets every document by its name and description, so questions are few; documents without a description aren't asked about.
    """
    described = documents.select(F.col("doc_id").alias("key"), F.coalesce("doc_name", F.lit("")).alias("doc_name"), F.col("doc_description").alias("text")).filter("text <> ''")
    told = None
    for q in questions.select("question_id", "question").limit(MAX_QUESTIONS + 1).collect():
        rows = described.withColumn("doc_id", F.lit(0))
        single = prompts.prompt(ONE_DOCUMENT, F.lit(q["question"]), F.col("doc_name"), F.col("text"))
        got = prompts.batched(rows, client, f"{DESCRIBED}\n\n{q['question']}", single, ["doc_name", "text"], "index", "relevant", size, key="key")
        got = got.filter(F.lower("value") == "true").select(F.lit(q["question_id"]).cast("long").alias("question_id"), F.col("key").alias("doc_id"))
        told = got if told is None else told.unionByName(got)
    return told if told is not None else documents.select(F.lit(0).cast("long").alias("question_id"), "doc_id").filter("false")


NODES = "How well may each of these sections, with all below it, answer the question? Answer as a JSON array of objects with index and score, from 0 to 1."
ONE_NODE = "How well may this section, with all below it, answer the question? Answer with a score from 0 to 1 only."


def model_scores(client: models.Client, size: int = 10, preference: str = "") -> Callable[[DataFrame], DataFrame]:
    """A scorer for ``tree_search`` that asks a model, ``size`` nodes to a prompt; ``preference`` is what is known of where answers stand."""
    known = f"\n\n{preference}" if preference else ""

    def score(frontier: DataFrame) -> DataFrame:
        rows = frontier.withColumn("pair", F.concat_ws(":", "question_id", "doc_id")).withColumn("text", F.concat_ws("\n", "title", "summary"))
        single = prompts.prompt(ONE_NODE + known, F.col("question"), F.col("text"))
        got = prompts.batched(rows.select("pair", "ord", "question", "text"), client, NODES + known, single, ["question", "text"], "index", "score", size, key="ord", group="pair")
        value = F.col("value").try_cast("double")
        got = got.select("pair", "ord", F.when(value.between(0, 1), value).alias("score"))
        return rows.join(got, ["pair", "ord"], "left").select(*frontier.columns, "score")

    return score


def tree_search(nodes: DataFrame, asked: DataFrame, score: Callable[[DataFrame], DataFrame], width: int = 3, keep: int = 5) -> tuple[DataFrame, DataFrame]:
    """The best ``keep`` nodes of each pair, and how many nodes each round scored.

    ``nodes`` are (doc_id, ord, parent_ord, title, summary), ``asked`` are (question_id,
    doc_id, question), and ``score`` adds a score to such rows, null for nodes of
    no use, below which nothing is looked for.  Equal scores go by ord.
    """
    pair = ("question_id", "doc_id")
    ranked = lambda df, n: df.withColumn("rank", F.row_number().over(Window.partitionBy(*pair).orderBy(F.desc("score"), "ord"))).filter(F.col("rank") <= n)
    own = nodes.select("doc_id", "ord", "parent_ord", "title", "summary")
    frontier = asked.select(*pair, "question").join(own.filter("parent_ord is null"), "doc_id")
    found, depth = None, 0
    while True:
        scored = materialise(score(frontier.select(*pair, "question", "ord", "title", "summary")).withColumn("depth", F.lit(depth)), "scored")
        found = scored if found is None else found.unionByName(scored)
        if scored.isEmpty():
            break
        best = ranked(scored.filter("score is not null"), width).select(*pair, "question", F.col("ord").alias("parent_ord"))
        frontier = best.join(own, ["doc_id", "parent_ord"])
        depth += 1
    rounds = found.groupBy("depth").agg(F.count("*").alias("scored"))
    return ranked(found.filter("score is not null"), keep).select(*pair, "rank", "ord", "depth", "score"), rounds
