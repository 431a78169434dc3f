"""Summaries of section trees from the leaves up, level by level over all documents.

A wave takes the nodes of one depth, deepest first.  What a node shows of itself is
its text and, below it, the summaries of its children in their order, which the
wave before has stored.  Short leaves are their own summaries and cost no call.
Nodes can be sent several to a prompt; those that an answer leaves out are asked
for alone.

Defined results: a node without text and without children's summaries has the
empty summary; a model that fails leaves the empty summary; children's lines that
begin beyond the budget of their parent's prompt are left out of it; trees may
have any depth, and documents any mix of depths.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arbograph.functions import models
from arbograph.functions.text import estimated_tokens, truncated_to_tokens
from arbograph.operators import prompts
from arbograph.session import materialise

#: Texts of so few tokens are their own summaries.
SHORT = 200
#: Tokens of a node's text in its prompt, and of its children's lines.
TEXT_TOKENS, CHILDREN_TOKENS = 10_000, 4_000

ONE = "Say in short what the main points of this section are. Answer with this description only."
MANY = "Say in short what the main points of each of these sections are, as a JSON array of objects with index and summary."


def _below(done: DataFrame) -> DataFrame:
    """doc_id, parent_ord and the lines of each parent's children, in order, as far as the budget goes."""
    lines = done.filter("parent_ord is not null and summary <> ''").select("doc_id", "parent_ord", "ord", F.concat(F.lit("- "), F.coalesce("title", F.lit("")), F.lit(": "), "summary").alias("line"))
    before = Window.partitionBy("doc_id", "parent_ord").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    lines = lines.withColumn("used", F.coalesce(F.sum(estimated_tokens(F.col("line"))).over(before), F.lit(0))).filter(F.col("used") < CHILDREN_TOKENS)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "line"))), lambda x: x["line"]), "\n")
    return lines.groupBy("doc_id", "parent_ord").agg(text.alias("below"))


def summarised(nodes: DataFrame, client: models.Client, short: int = SHORT, size: int = 1, count: Callable[[Column], Column] = estimated_tokens) -> DataFrame:
    """doc_id, ord, summary and how it came about: own, together, alone, failed or empty; nodes are (doc_id, ord, parent_ord, depth, title, text)."""
    columns = ["doc_id", "ord", "parent_ord", "title", "summary", "how"]
    deepest = nodes.agg(F.max("depth")).first()[0]
    found, level = None, None
    for depth in range(deepest if deepest is not None else 0, -1, -1):
        mine = nodes.filter(F.col("depth") == depth).select("doc_id", "ord", "parent_ord", "title", F.coalesce("text", F.lit("")).alias("own"))
        if level is None:
            mine = mine.withColumn("below", F.lit(None).cast("string"))
        else:
            mine = mine.join(_below(level).withColumnRenamed("parent_ord", "ord"), ["doc_id", "ord"], "left")
        level = materialise(_level(mine, client, short, size, count).select(*columns), "summaries")
        found = level if found is None else found.unionByName(level)
    return found.select("doc_id", "ord", "summary", "how")


def _level(mine: DataFrame, client: models.Client, short: int, size: int, count: Callable[[Column], Column]) -> DataFrame:
    own, below = F.col("own"), F.col("below")
    mine = mine.withColumn("tokens", count(own))
    is_own = below.isNull() & (F.col("tokens") < short)
    told = mine.filter(is_own).select("*", own.alias("summary"), F.when(own == "", "empty").otherwise("own").alias("how"))
    shown = F.concat_ws("\n\n", F.nullif(truncated_to_tokens(own, TEXT_TOKENS), F.lit("")), below)
    asked = mine.filter(~is_own).withColumn("text", shown)
    single = _prompt(F.col("title"), F.col("text"))
    if size == 1:
        rows = models.replies(asked, single, client).select("*", F.lit(prompts.ALONE).alias("got"), F.col("answer").alias("value"))
    else:
        sent = asked.select("doc_id", "ord", F.coalesce("title", F.lit("")).alias("title"), "text")
        got = prompts.batched(sent, client, MANY, single, ["title", "text"], "index", "summary", size, key="ord", plain=True)
        rows = asked.join(got.withColumnRenamed("how", "got"), ["doc_id", "ord"])
    failed = F.col("value").isNull()
    rows = rows.select(*mine.columns, F.coalesce(F.trim("value"), F.lit("")).alias("summary"), F.when(failed, "failed").otherwise(F.col("got")).alias("how"))
    return told.unionByName(rows)


def _prompt(title: Column, text: Column) -> Column:
    return prompts.prompt(ONE, F.coalesce(title, F.lit("")), text)
