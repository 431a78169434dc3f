"""What each filter removes in every order of five filters, by look-up of the first failure.

A text fails some of the filters A to E, which makes one of 32 masks.  A table
of 32 masks by 120 orders, made once, holds the step at which a mask falls in
an order.  Tasks index it with the masks of their rows, count removals by order,
step and label in one array for each part, and the arrays are summed; all other
figures follow from these sums.

Filters A to D are judged where the text is read, and only a digest of the
text leaves the scan.  Equal texts are first counted within each part and label,
so many copies of a text are few rows when the smallest doc_id among them is
found.

Defined results: a null text is empty, a null ``lang`` is the part of the empty
string; a null doc_id is neither smaller nor larger than others and has no
label; rows that repeat a doc_id and its text count each and aren't copies of
each other; a document is good, or toxic, if any of its labels says so; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
#: Steps of an order; the last is that of texts which no filter removes.
STEPS = len(FILTERS) + 1
#: Neither, good, toxic, both.
LABELS = 4
#: Rows that are spread over all orders at a time, and parts whose arrays a task holds at most.
SLICE_ROWS, HELD_PARTS = 1_000, 256
WHITE = " \t\n\x0b\f\r"
SALTS = 1_024


def first_failures() -> np.ndarray:
    """The step, from 0, at which mask m falls in order o; ``STEPS - 1`` where it doesn't.  Bit k of a mask: filter k fails."""
    table = np.full((1 << len(FILTERS), len(ORDERS)), STEPS - 1, np.int64)
    for mask in range(len(table)):
        for o, order in enumerate(ORDERS):
            for step, name in enumerate(order):
                if mask >> FILTERS.index(name) & 1:
                    table[mask, o] = step
                    break
    return table


def _bits(*failing: Column) -> Column:
    return sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(failing)), F.lit(0))


def masks(docs: DataFrame) -> DataFrame:
    """doc_id, part, digest of the text and mask of filters A to D."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    bare = F.btrim("text", F.lit(WHITE))
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))
    rows = rows.withColumn("words", words)
    rows = rows.withColumn("n", F.size("words"))
    failing = _bits(
        F.col("n") < 100,
        100 * F.size(F.array_distinct("words")) < 80 * F.col("n"),
        100 * F.length(F.regexp_replace("text", "[^A-Z]+", "")) > 10 * F.length("text"),
        F.col("text").rlike("[#$%&*|]"),
    )
    return rows.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), failing.alias("mask"))


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``rows`` with ``label``: 1 for quality 1 and 2 for toxic 1, added up."""
    said = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0))
    known = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg((said("quality") + 2 * said("toxic")).alias("label"))
    known = known.filter("label > 0").withColumn("none", F.lit(0))
    # rows without an id are spread over keys that no label has
    none = F.when(F.col("doc_id").isNull(), 1 + F.pmod(F.xxhash64("digest"), F.lit(SALTS))).otherwise(0).cast("int")
    rows = rows.withColumns({"id": F.coalesce("doc_id", F.lit(0)), "none": none})
    return rows.join(known, ["id", "none"], "left").withColumn("label", F.coalesce("label", F.lit(0)))


def cells(rows: DataFrame) -> DataFrame:
    """part, mask of all filters, label and n, from rows of ``labelled``: a row for each text, part, label and fate at least."""
    alike = ["digest", "mask", "part", "label"]
    # one row an id, without an exchange where labels were joined by exchange
    rows = rows.groupBy("id", "none", "doc_id", *alike).agg(F.count("*").alias("n"))
    groups = rows.groupBy(*alike).agg(
        F.sum("n").alias("n"),
        F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("first"),
        F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("without_id"),
    )
    groups = groups.withColumn("smallest", F.min("first.doc_id").over(Window.partitionBy("digest")))
    kept = F.col("without_id") + F.when(F.col("first.doc_id") == F.col("smallest"), F.col("first.n")).otherwise(0)
    copied = F.lit(1 << FILTERS.index("E"))
    fates = F.array(F.struct(F.col("mask").alias("mask"), kept.alias("n")), F.struct((F.col("mask") + copied).alias("mask"), (F.col("n") - kept).alias("n")))
    return groups.select("part", "label", F.explode(fates).alias("x")).select("part", F.col("x.mask").cast("int").alias("mask"), F.col("label").cast("int").alias("label"), F.col("x.n").alias("n")).filter("n > 0")


def removals(found: DataFrame) -> DataFrame:
    """part, o, step and label, all numbered from 0, with n: how many fall there."""
    size = len(ORDERS) * STEPS * LABELS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, orders, held = first_failures(), np.arange(len(ORDERS)), {}

        def emit() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.list_(pa.int64()))], ["part", "removed"])
            held.clear()
            return out

        for batch in batches:
            for low in range(0, batch.num_rows, SLICE_ROWS):
                rows = batch.slice(low, SLICE_ROWS)
                parts = rows.column(0).dictionary_encode()
                part, mask, label, n = (np.asarray(c) for c in (parts.indices, *rows.columns[1:]))
                at = ((part[:, None].astype(np.int64) * len(ORDERS) + orders) * STEPS + table[mask]) * LABELS + label[:, None]
                sums = np.bincount(at.ravel(), np.repeat(n, len(ORDERS)), len(parts.dictionary) * size).astype(np.int64)
                for name, row in zip(parts.dictionary.to_pylist(), sums.reshape(-1, size)):
                    held[name] = held[name] + row if name in held else row
                if len(held) > HELD_PARTS:
                    yield emit()
        if held:
            yield emit()

    partial = found.select("part", "mask", "label", "n").mapInArrow(run, "part string, removed array<long>")
    summed = partial.select("part", F.posexplode("removed").alias("at", "n")).groupBy("part", "at").agg(F.sum("n").alias("n"))
    digit = lambda below, base: F.floor(F.col("at") / below) % base
    return summed.select("part", digit(STEPS * LABELS, len(ORDERS)).cast("int").alias("o"), digit(LABELS, STEPS).cast("int").alias("step"), digit(1, LABELS).cast("int").alias("label"), "n")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each part, order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley."""
    found = removals(cells(labelled(masks(docs), labels)))
    of = lambda bit: F.sum(F.when(F.col("label").bitwiseAND(bit) > 0, F.col("n")).otherwise(0))
    steps = found.groupBy("part", "o", "step").agg(F.sum("n").alias("removed"), of(1).alias("good_lost"), of(2).alias("toxic_lost"))
    later = Window.partitionBy("part", "o").orderBy("step").rowsBetween(1, Window.unboundedFollowing)
    steps = steps.withColumn("kept", F.sum("removed").over(later)).filter(F.col("step") < STEPS - 1)
    names = F.array(*(F.lit(o) for o in ORDERS))
    steps = steps.withColumn("filter_order", F.get(names, F.col("o"))).withColumn("filter", F.substr("filter_order", F.col("step") + 1, F.lit(1)))
    same = Window.partitionBy("part", "filter")
    at = lambda step: F.max(F.when(F.col("step") == step, F.col("removed"))).over(same)
    # at the first step a filter removes all that fail it, at the last those that fail it only
    steps = steps.withColumns({"fails": at(0), "unique_fails": at(STEPS - 2), "shapley": F.sum("removed").over(same)})
    return steps.select(
        "part", "filter_order", (F.col("step") + 1).alias("step"), "kept", "removed", (F.col("fails") - F.col("removed")).alias("redundant"),
        "unique_fails", "good_lost", "toxic_lost", "shapley",
    )


ORACLE_SQL = r"""
with texts as (
  select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t,
    [w for w in string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+') if w <> ''] as words
  from documents
), judged as (
  select doc_id, part,
    case when len(words) < 100 then 'A' else '' end
    || case when 100 * len(list_distinct(words)) < 80 * len(words) then 'B' else '' end
    || case when 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) then 'C' else '' end
    || case when regexp_matches(t, '[#$%&*|]') then 'D' else '' end
    || case when doc_id > min(doc_id) over (partition by t) then 'E' else '' end as failing
  from texts
), marked as (
  select part, failing, count(*) as n,
    count(*) filter (where doc_id in (select doc_id from labels where quality = 1)) as good,
    count(*) filter (where doc_id in (select doc_id from labels where toxic = 1)) as toxic
  from judged group by part, failing
), names(c) as (values ('A'), ('B'), ('C'), ('D'), ('E')), orders as (
  select a.c || b.c || c.c || d.c || e.c as filter_order from names a, names b, names c, names d, names e
  where len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5
), fates as (
  select part, filter_order, failing, n, good, toxic,
    coalesce(list_min([strpos(filter_order, f) for f in string_split(failing, '') if f <> '']), 6) as falls
  from marked cross join orders
), steps as (
  select part, filter_order, s as step, filter_order[s] as filter,
    cast(sum(n) filter (where falls > s) as bigint) as kept,
    cast(sum(n) filter (where falls = s) as bigint) as removed,
    cast(sum(n) filter (where falls < s and contains(failing, filter_order[s])) as bigint) as redundant,
    cast(sum(n) filter (where failing = filter_order[s]) as bigint) as unique_fails,
    cast(sum(good) filter (where falls = s) as bigint) as good_lost,
    cast(sum(toxic) filter (where falls = s) as bigint) as toxic_lost
  from fates cross join (select cast(unnest(range(1, 6)) as integer) as s) group by part, filter_order, s
)
select part, filter_order, step, coalesce(kept, 0) as kept, coalesce(removed, 0) as removed, coalesce(redundant, 0) as redundant,
  coalesce(unique_fails, 0) as unique_fails, coalesce(good_lost, 0) as good_lost, coalesce(toxic_lost, 0) as toxic_lost,
  cast(sum(coalesce(removed, 0)) over (partition by part, filter) as bigint) as shapley
from steps
"""
