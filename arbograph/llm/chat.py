"""Chat formatting: cumulative snapshots collapse to maximal conversations, which are rendered.

A log may hold a conversation several times, each time a few turns longer.
Every turn gets a hash of its position, role and text, and every prefix of a
conversation the combination of its turns' hashes, two 64-bit numbers.  A
conversation whose whole hash is that of another's proper prefix is a snapshot;
an anti-join with the distinct prefixes leaves the others, and of equal
conversations the one with the smallest id stays for all.

Positions and prefix hashes are taken in two steps, within runs of turns and
over a conversation's runs, so that one very long conversation is spread over
tasks until it is rendered; only turns with one number, or without any, are
ordered together.  Both are stored once and read by the later steps.

Defined results: turns are ordered by turn, role and text, null turns last;
null roles and texts count as empty; rows without a conv_id take no part; rows
that repeat a turn are turns of their own; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arbograph.session import materialise

#: Turns of a run.
RUN_TURNS = 256


def positions(conversations: DataFrame) -> DataFrame:
    """conv_id, k (from 1), role, text, run and the turn's hash (x, y) of every turn."""
    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.coalesce(F.col("turn").cast("long"), F.lit(2**63 - 1)).alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).filter("conv_id is not null")
    turns = turns.withColumn("run", F.floor(F.col("turn") / RUN_TURNS))
    before = Window.partitionBy("conv_id").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = turns.groupBy("conv_id", "run").count().select("conv_id", "run", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("conv_id", "run").orderBy("turn", "role", "text")
    placed = turns.join(runs, ["conv_id", "run"]).select(
        "conv_id", "run", (F.row_number().over(inside) + F.col("before")).cast("long").alias("k"), "role", "text"
    )
    return placed.select("*", F.xxhash64("k", "role", "text").alias("x"), F.xxhash64(F.lit("y"), "text", "k", "role").alias("y"))


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, k and the hash (x, y) of the first k turns, for every k."""
    hashed = turns.select("conv_id", "run", "k", "x", "y")
    before = Window.partitionBy("conv_id").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = hashed.groupBy("conv_id", "run").agg(F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"))
    runs = runs.select("conv_id", "run", *(F.coalesce(F.bit_xor(c).over(before), F.lit(0).cast("long")).alias(f"{c}0") for c in "xy"))
    inside = Window.partitionBy("conv_id", "run").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    return hashed.join(runs, ["conv_id", "run"]).select(
        "conv_id", "k", *(F.bit_xor(c).over(inside).bitwiseXOR(F.col(f"{c}0")).alias(c) for c in "xy")
    )


def maximal(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns and copies (equal conversations) of every conversation that prefixes no longer one."""
    rows = materialise(prefixes(turns), "prefixes")
    lengths = turns.groupBy(F.col("conv_id").alias("c")).agg(F.max("k").alias("n_turns"))
    rows = rows.join(lengths, F.col("conv_id") == F.col("c")).drop("c")
    whole = rows.filter("k = n_turns").groupBy("k", "x", "y").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("copies"))
    proper = rows.filter("k < n_turns").select("k", "x", "y").distinct()
    return whole.join(proper, ["k", "x", "y"], "left_anti").select("conv_id", F.col("k").alias("n_turns"), "copies")


def render(turns: DataFrame, kept: DataFrame) -> DataFrame:
    """The kept conversations as one text each."""
    line = lambda t: F.concat(F.lit("<|"), t["role"], F.lit("|>\n"), t["text"], F.lit("<|end|>\n"))
    texts = (
        turns.join(kept.select("conv_id"), "conv_id", "left_semi")
        .groupBy("conv_id")
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "role", "text"))), line), "").alias("text"))
    )
    return kept.join(texts, "conv_id")


def format_conversations(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, copies and text of every maximal conversation."""
    turns = materialise(positions(conversations), "turns")  # read by every later step
    return render(turns, maximal(turns)).select("conv_id", "n_turns", "copies", "text")


ORACLE_SQL = """
with turns as (
  select conv_id, coalesce(role, '') as role, coalesce(text, '') as text, turn
  from conversations where conv_id is not null
), whole as materialized (
  select conv_id, list(struct_pack(role := role, text := text) order by turn nulls last, role, text) as l,
    string_agg('<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10), '' order by turn nulls last, role, text) as text
  from turns group by conv_id
), distinct_ones as (
  select l, min(conv_id) as conv_id, count(*) as copies, min(text) as text from whole group by l
)
select d.conv_id, cast(len(d.l) as bigint) as n_turns, d.copies, d.text
from distinct_ones d
where not exists (select 1 from whole w where len(w.l) > len(d.l) and w.l[1:len(d.l)] = d.l)
"""
