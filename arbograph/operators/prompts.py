"""Prompts that hold several rows, whose answers are told apart by index and asked for again one by one where they lack one.

Rows are dealt into prompts of ``size`` in the order of their keys, within a group
and a run of ``RUN`` keys, so that no group, however large, is numbered in one
task.  A prompt holds a JSON array of its rows, each with its place; the answer
is a JSON array of objects with this place and a value.  Of several objects for one
place the last counts, places that were not sent are left out, and an answer
that is no array answers none.  Rows whose place is missing are asked for
alone, by a prompt of their own; with ``whole`` all rows of their prompt are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arbograph.functions import models
from arbograph.functions.text import repaired_json
from arbograph.session import materialise

#: Width of a run of keys.
RUN = 4_096
#: How a row got its value.
TOGETHER, ALONE, EMPTY = "together", "alone", "empty"


def prompt(task: str, *parts: Column) -> Column:
    return F.concat_ws("\n\n", F.lit(task), *parts)


def dealt(rows: DataFrame, key: str, group: str, size: int) -> DataFrame:
    """``rows`` with run, batch and place, from 0."""
    runs = rows.withColumn("run", F.floor(F.col(key) / RUN))
    k = F.row_number().over(Window.partitionBy(group, "run").orderBy(key)) - 1
    return runs.withColumns({"batch": F.floor(k / size).cast("int"), "place": (k % size).cast("int")})


def batched(rows: DataFrame, client: models.Client, task: str, single: Column, fields: list[str], index: str, value: str, size: int = 5, key: str = "section_id", group: str = "doc_id", whole: bool = False, plain: bool = False) -> DataFrame:
    """group, key, the JSON of each row's value (null where nothing was told), how it was got, and the answer's status.

    ``rows`` has key, unique in its group, group, text and ``fields``; a row with an empty text keeps
    its place and isn't sent.  ``task`` stands before the array, and ``single``
    is the prompt of a row that is asked for alone, whose answer is JSON unless it
    is ``plain``.
    """
    at = [group, "run", "batch"]
    sent = dealt(rows, key, group, size).withColumn("single", single)
    sent = materialise(sent.select(*at, key, "place", "text", "single", F.struct(F.col("place").alias(index), *fields).alias("row")), "dealt")
    empty = F.coalesce(F.col("text"), F.lit("")) == ""
    asked = sent.filter(~empty)
    listed = F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("place", "row"))), lambda x: x["row"]))
    told = models.replies(asked.groupBy(*at).agg(listed.alias("rows")), prompt(task, F.col("rows")), client)
    told = materialise(told.select(*at, "answer", "status"), "told")
    items = told.select(*at, F.posexplode(F.from_json(repaired_json(F.col("answer")), "array<string>")).alias("k", "item"))
    items = items.withColumn("item", F.from_json("item", f"`{index}` string, `{value}` string"))
    items = items.select(*at, F.col(f"item.`{index}`").try_cast("int").alias("place"), F.col(f"item.`{value}`").alias("value"), "k").filter("place is not null")
    items = items.groupBy(*at, "place").agg(F.max_by(F.struct("value"), "k").alias("found"))
    both = asked.join(items, [*at, "place"], "left")
    missing = F.col("found").isNull()
    if whole:
        missing = F.max(missing.cast("int")).over(Window.partitionBy(*at)) == 1
    both = materialise(both.withColumn("missing", missing).select(group, key, "single", "found", "missing"), "scattered")
    columns = lambda df, value, how, status: df.select(group, key, value.alias("value"), F.lit(how).alias("how"), status.alias("status"))
    alone = models.replies(both.filter("missing").select(group, key, "single"), F.col("single"), client)
    alone = materialise(columns(alone, F.col("answer") if plain else repaired_json(F.col("answer")), ALONE, F.col("status")), "alone")
    none, finished = F.lit(None).cast("string"), F.lit(models.FINISHED)
    return columns(both.filter("not missing"), F.col("found.value"), TOGETHER, finished).unionByName(alone).unionByName(columns(sent.filter(empty), none, EMPTY, finished))
