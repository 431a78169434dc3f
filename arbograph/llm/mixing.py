"""Mixing sources to target weights by Pfair scheduling, in DataFrame functions only.

A source's documents, in the order of doc_id, are dealt into blocks of
``block_chars`` characters.  Weights become whole quanta a of ``QUANTA``; block r
of a source may run from slot floor(r QUANTA / a) and must have run by slot
ceil((r + 1) QUANTA / a).  Earliest-deadline-first gives each slot to a source, so
at any time a source is less than one block ahead of or behind its share.  Every
document is kept: slots of sources that have run out stay empty and the others
go on in their proportions.

Slots are scheduled in windows, each on its own, so in as many tasks as there
are windows.  Where a window ends, some sources are in the middle of a block's
time, and a window must know which of these blocks the one before it has run.
That follows without the windows before: a schedule that starts one window
earlier, where of the blocks that are due on both sides those with the earliest
deadlines count as run, misses no deadline later on, and every count that it
reaches one window on can be reached by any schedule that holds the deadlines.  So
a first run over each window gives the counts at its end, and a second one, from
the counts at its start to those at its end, its slots.  Windows are longer than
two blocks' time of the smallest weight, so that no block is due in three.
Sources without weight come after the others.

Running totals within a source are taken in three steps, by ranges of runs of
doc_ids, by runs and then within a run, so a source that holds a large part of
all rows is spread over many tasks, also if its ids are far apart.  More than
``MAX_SOURCES`` sources, or a weight that asks for windows beyond ``MAX_WINDOW``
slots, raise an error.

Defined results: a null source is a source of its own; null and empty texts
have no characters and follow their predecessor; documents longer than a block
take several slots, the first of which is theirs; rows that repeat a doc_id in
a source count each, in any order; null doc_ids come first, in any order; without
any weight all sources weigh the same; an empty table gives no rows.  Columns
named like the two that are added are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arbograph.session import materialise

BLOCK_CHARS = 16_384
#: Quanta of all weights together: shares are exact to one part of these.
QUANTA = 10_000_000_000
#: Slots of a window, at least and at most; a power of two.
WINDOW, MAX_WINDOW = 1_024, 1 << 20
#: Slots that are given within one step of the outer aggregate.
STEP = 64
#: Without given weights, a source's weight is its number of characters to this power.
TEMPER = 0.5
#: Sources at most: their weights are sent to every window, which takes time in proportion to slots times sources.
MAX_SOURCES = 10_000
#: Width of a run of doc_ids.
RUN_IDS = 1_024


def _length() -> Column:
    return F.coalesce(F.length(F.col("text").cast("string")), F.lit(0)).cast("long")


def _run() -> Column:
    """Runs of doc_ids; texts without an id are dealt to runs before the others."""
    none = -1 - F.pmod(F.xxhash64(F.col("text").cast("string")), F.lit(RUN_IDS))
    return F.floor(F.coalesce(F.col("doc_id").cast("long") / RUN_IDS, none))


def _before(runs: DataFrame) -> DataFrame:
    """_source, _run and the sum of ``chars`` of the source's runs before it.

    Runs are stored in ranges of bounded size, whose sums are added up first.
    """
    n = int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialise(runs.repartitionByRange(n, "_source", "_run").withColumn("part", F.spark_partition_id()), "runs")
    earlier = lambda *keys: Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
    parts = ranged.groupBy("_source", "part").agg(F.sum("chars").alias("chars"))
    parts = parts.select(F.col("_source").alias("s"), F.col("part").alias("p"), F.coalesce(F.sum("chars").over(earlier("_source", "part")), F.lit(0)).alias("first"))
    inside = F.coalesce(F.sum("chars").over(earlier("_source", "part", "_run")), F.lit(0))
    rows = ranged.withColumn("inside", inside).join(parts, F.col("_source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p")))
    return rows.select("_source", "_run", (F.col("first") + F.col("inside")).alias("_before"))


def shares(docs: DataFrame, weights: dict[str | None, float] | None = None, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """_source, share (0 for sources that ``weights`` leaves out) and blocks, at least 1."""
    sizes = docs.groupBy(F.col("source").cast("string").alias("_source")).agg(F.sum(_length()).alias("size"))
    if weights is None:
        weight = F.pow(F.col("size").cast("double"), F.lit(TEMPER))
    else:
        weight = F.lit(0.0)
        for name, value in weights.items():
            weight = F.when(F.col("_source").eqNullSafe(F.lit(name)), float(value)).otherwise(weight)
    every = Window.partitionBy()
    share = F.when(F.sum("weight").over(every) > 0, F.col("weight") / F.sum("weight").over(every)).otherwise(1.0 / F.count("*").over(every))
    return sizes.withColumn("weight", weight).select("_source", share.alias("share"), (F.floor(F.col("size") / block_chars) + 1).alias("blocks"))


@dataclass(frozen=True)
class Source:
    name: str | None
    quanta: int
    blocks: int


def quanta(shares: list[float], total: int = QUANTA) -> list[int]:
    """Whole parts of ``total`` by largest remainders, the first among equals."""
    parts = [min(int(x * total), total) for x in shares]
    order = sorted(range(len(shares)), key=lambda k: (parts[k] - shares[k] * total, k))
    left = total - sum(parts)
    for k in order[:max(left, 0)]:
        parts[k] += 1
    return parts


def window_slots(sources: list[Source]) -> int:
    least = min(x.quanta for x in sources)
    window = WINDOW
    while window * least < 2 * QUANTA:
        window *= 2
    if window > MAX_WINDOW:
        raise ValueError(f"a weight is below {2 / MAX_WINDOW:.0e} of all; raise it, set it to 0 or give small sources one name")
    return window


def _longs(values: list[int]) -> Column:
    return F.lit(values).cast("array<long>")


def _edf(window: int, start: str, end: str | None) -> Column:
    """``aggregate`` over the slots of a window, of arrays a and f; ``next`` has the blocks run so far, counted from the window's first.

    With ``end`` it stops each source there, by the end of the window, and gives the sources' numbers and blocks by slot.
    """
    limit = f"and next[i] < {end}[i]" if end else ""
    deadline = f"((next[i] + 1) * {QUANTA}L - f[i] + x - 1) div x"
    deadline = f"least({deadline}, {window}L)" if end else deadline
    best = f"""array_min(transform(a, (x, i) -> case when next[i] * {QUANTA}L - f[i] < (t + 1) * x {limit}
      then named_struct('deadline', {deadline}, 'i', i) end))"""
    moved = "transform(next, (n, i) -> case when i = best.i then n + 1 else n end)"
    steps, slots = f"sequence(0L, {window // STEP - 1}L)", f"sequence(w * {STEP}L, (w + 1) * {STEP}L - 1)"
    if end is None:
        inner = f"aggregate({slots}, before, (next, t) -> transform(array({best}), best -> {moved})[0])"
        return F.expr(f"aggregate({steps}, {start}, (before, w) -> {inner})")
    # steps are arrays of their own, so that none copies all slots before it
    step = f"""aggregate({slots}, named_struct('next', before.next, 'out', cast(array() as array<struct<i:int,n:bigint>>)),
      (s, t) -> transform(array(s.next), next -> transform(array({best}), best -> named_struct(
        'next', {moved}, 'out', concat(s.out, array(named_struct('i', best.i, 'n', next[best.i])))))[0])[0])"""
    return F.expr(f"""aggregate({steps}, named_struct('next', {start}, 'out', cast(array() as array<array<struct<i:int,n:bigint>>>)),
      (before, w) -> transform(array({step}), d -> named_struct('next', d.next, 'out', concat(before.out, array(d.out))))[0],
      done -> flatten(done.out))""")


def _tasks(spark: SparkSession, windows: int) -> int:
    return max(1, min(windows, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def boundaries(spark: SparkSession, sources: list[Source], windows: int, window: int) -> DataFrame:
    """k, the arrays f and q, and n: how far each source is at the window's start, in quanta of a block and in whole blocks, and what it has run at the end, counted from q."""
    a = [x.quanta for x in sources]
    whole, part = _longs([x * window // QUANTA for x in a]), _longs([x * window % QUANTA for x in a])
    k = spark.range(0, windows, 1, _tasks(spark, windows)).select(F.col("id").alias("k"), _longs(a).alias("a"), whole.alias("whole"), part.alias("part"))
    k = k.withColumn("f", F.expr(f"transform(part, x -> (x * k) % {QUANTA}L)"))
    k = k.withColumn("q", F.expr(f"transform(whole, (x, i) -> x * k + (part[i] * k) div {QUANTA}L)"))
    due = F.expr(f"array_sort(filter(transform(a, (x, i) -> case when f[i] > 0 then named_struct('deadline', ({QUANTA}L - f[i] + x - 1) div x, 'i', i) end), x -> x is not null))")
    run = f"transform(slice(due, 1, cast(aggregate(f, 0L, (y, z) -> y + z) div {QUANTA}L as int)), x -> x.i)"
    k = k.withColumn("due", due).withColumn("run", F.expr(run))
    k = k.withColumn("start", F.expr("transform(a, (x, i) -> if(array_contains(run, i), 1L, 0L))"))
    return k.withColumn("n", _edf(window, "start", None)).select("k", "a", "f", "q", "n")


def slots(spark: SparkSession, sources: list[Source]) -> DataFrame:
    """_source, block and slot, from which each block of the sources runs.

    Slots are given up to the last block; those of sources that have run out are left out.
    """
    weighed = [x for x in sources if x.quanta]
    window = window_slots(weighed)
    windows = max(-(-(-(-x.blocks * QUANTA // x.quanta)) // window) for x in weighed)
    ends = materialise(boundaries(spark, weighed, windows, window), "boundaries")
    before = ends.select((F.col("k") + 1).alias("k"), F.transform("q", lambda x, i: x + F.get(F.col("n"), i)).alias("run"))
    both = ends.join(before, "k", "left").withColumn("start", F.expr("transform(q, (x, i) -> coalesce(run[i] - x, 0L))"))
    # few bytes, but much work: by their size all windows would be one task
    given = both.repartition(_tasks(spark, windows)).select("k", "q", F.posexplode(_edf(window, "start", "n")).alias("t", "x"))
    names = F.array(*(F.lit(x.name).cast("string") for x in weighed))
    of = lambda values: F.get(values, F.col("x.i"))
    given = given.select(of(names).alias("_source"), (of(F.col("q")) + F.col("x.n")).alias("block"), (F.col("k") * window + F.col("t")).alias("slot"), of(_longs([x.blocks for x in weighed])).alias("blocks"))
    given = given.filter("block < blocks").drop("blocks")
    rest = [(x.name, x.blocks) for x in sources if not x.quanta]
    if rest:
        more = spark.createDataFrame(rest, "_source string, blocks long")
        more = more.select("_source", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
        given = given.unionByName(more.withColumn("slot", F.lit(windows * window) + F.col("block")))
    return given


def schedule(docs: DataFrame, weights: dict[str | None, float] | None = None, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``docs`` with ``block`` and ``slot``: reading by slot gives the mixture."""
    own = {c: f"_c{k}" for k, c in enumerate(docs.columns) if c not in ("block", "slot")}
    source = F.col("source").cast("string").alias("_source")
    rows = docs.select(*(F.col(f"`{c}`").alias(k) for c, k in own.items()), F.col("doc_id").alias("_id"), source, _run().alias("_run"), _length().alias("_chars"))
    runs = _before(docs.groupBy(source, _run().alias("_run")).agg(F.sum(_length()).alias("chars")))
    runs = runs.select(F.col("_source").alias("s"), F.col("_run").alias("r"), "_before")
    rows = rows.join(runs, F.col("_source").eqNullSafe(F.col("s")) & (F.col("_run") == F.col("r")))
    inside = Window.partitionBy("_source", "_run").orderBy("_id", "_chars").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_block", F.floor((F.col("_before") + F.coalesce(F.sum("_chars").over(inside), F.lit(0))) / block_chars))
    found = shares(docs, weights, block_chars).limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources; give the small ones one name")
    found.sort(key=lambda r: (r["_source"] or "", r["_source"] is None))
    sources = [Source(r["_source"], a, r["blocks"]) for r, a in zip(found, quanta([r["share"] for r in found]))]
    chosen = [*(F.col(k).alias(c) for c, k in own.items()), F.col("_block").cast("long").alias("block")]
    if not sources:
        return rows.select(*chosen, F.lit(None).cast("long").alias("slot"))
    given = slots(docs.sparkSession, sources).select(F.col("_source").alias("s2"), F.col("block").alias("b2"), "slot")
    return rows.join(given, F.col("_source").eqNullSafe(F.col("s2")) & (F.col("_block") == F.col("b2"))).select(*chosen, F.col("slot").cast("long").alias("slot"))


def in_order(docs: DataFrame, partitions: int | None = None, **how) -> DataFrame:
    """``docs`` in the order of the mixture: files, and rows within them, go by slot.

    Rows that repeat a doc_id in a source go to the first of their slots.
    """
    slots = materialise(schedule(docs.select("doc_id", "source", "text"), **how).select("doc_id", "source", "slot"), "slots")
    slots = slots.groupBy(F.col("doc_id").alias("_id"), F.col("source").alias("_source")).agg(F.min("slot").alias("_slot"))
    own = {c: f"_c{k}" for k, c in enumerate(docs.columns)}
    rows = docs.select(*(F.col(f"`{c}`").alias(k) for c, k in own.items()))
    placed = rows.join(slots, F.col(own["doc_id"]).eqNullSafe(F.col("_id")) & F.col(own["source"]).eqNullSafe(F.col("_source")))
    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parted = placed.repartitionByRange(n, "_slot").sortWithinPartitions("_slot", "_id")
    return parted.select(*(F.col(k).alias(c) for c, k in own.items()))


ORACLE_SQL = f"""
with recursive sized as (
  select doc_id, source, coalesce(length(text), 0) as chars from documents
), weighed as (
  select source, pow(sum(chars), {TEMPER}) as w, cast(floor(sum(chars) / {BLOCK_CHARS}) as bigint) + 1 as blocks from sized group by source
), named as materialized (
  select row_number() over (order by coalesce(source, ''), source is null) as i, source, blocks,
    case when sum(w) over () > 0 then w / sum(w) over () else 1.0 / count(*) over () end * {QUANTA} as x
  from weighed
), sources as materialized (
  select i, source, blocks,
    cast(floor(x) as bigint) + case when row_number() over (order by floor(x) - x, i) <= {QUANTA} - sum(cast(floor(x) as bigint)) over () then 1 else 0 end as a
  from named
), weights as materialized (
  select list(a order by i) as a, list(i order by i) as own, min(a) as least,
    max(cast(blocks as hugeint) * {QUANTA} // a + case when cast(blocks as hugeint) * {QUANTA} % a > 0 then 1 else 0 end) as needed
  from sources where a > 0
), sizes as materialized (
  select *, (select min(x) from (select cast({WINDOW} as bigint) << unnest(range(0, 11)) as x) where cast(x as hugeint) * least >= 2 * {QUANTA}) as size from weights
), windows as materialized (
  select k, size, a, own, len(a) as m,
    [cast(cast(x as hugeint) * k * size % {QUANTA} as bigint) for x in a] as f, [cast(cast(x as hugeint) * k * size // {QUANTA} as bigint) for x in a] as q
  from (select *, unnest(range(0, cast((needed + size - 1) // size as bigint))) as k from sizes)
), due as (
  select *, list_slice(list_sort([(({QUANTA} - f[j] + a[j] - 1) // a[j]) * 1000000 + j for j in range(1, m + 1) if f[j] > 0]), 1, cast(list_sum(f) // {QUANTA} as bigint)) as early from windows
), free(k, t, nexts) as (
  select k, cast(0 as bigint), [case when list_contains([e % 1000000 for e in early], j) then cast(1 as bigint) else 0 end for j in range(1, m + 1)] from due
  union all
  select k, t + 1, [case when j = best then nexts[j] + 1 else nexts[j] end for j in range(1, m + 1)]
  from (
    select k, t, nexts, m, list_min([case when nexts[j] * {QUANTA} - f[j] < (t + 1) * a[j]
      then (((nexts[j] + 1) * {QUANTA} - f[j] + a[j] - 1) // a[j]) * 1000000 + j end for j in range(1, m + 1)]) % 1000000 as best
    from free join windows using (k) where t < size
  )
), ends as materialized (
  select k, nexts as n from free join windows using (k) where t = size
), starts as materialized (
  select w.*, e.n, [case when w.k = 0 then 0 else p.q[j] + b.n[j] - w.q[j] end for j in range(1, w.m + 1)] as first
  from windows w join ends e using (k) left join windows p on p.k = w.k - 1 left join ends b on b.k = w.k - 1
), bound(k, t, nexts, best) as (
  select k, cast(0 as bigint), first, cast(null as bigint) from starts
  union all
  select k, t + 1, [case when j = best then nexts[j] + 1 else nexts[j] end for j in range(1, m + 1)], best
  from (
    select b.k, t, nexts, m, list_min([case when nexts[j] < n[j] and nexts[j] * {QUANTA} - f[j] < (t + 1) * a[j]
      then least((((nexts[j] + 1) * {QUANTA} - f[j] + a[j] - 1) // a[j]), size) * 1000000 + j end for j in range(1, m + 1)]) % 1000000 as best
    from bound b join starts s on b.k = s.k where t < size
  )
), slots as (
  select own[best] as i, q[best] + nexts[best] - 1 as block, b.k * size + t - 1 as slot from bound b join windows w on b.k = w.k where t > 0
  union all
  select i, unnest(range(0, blocks)) as block, (select max(k + 1) * max(size) from windows) + unnest(range(0, blocks)) as slot from sources where a = 0
), placed as (
  select doc_id, source,
    cast(floor(coalesce(sum(chars) over (partition by source order by doc_id, chars rows between unbounded preceding and 1 preceding), 0)
      / {BLOCK_CHARS}) as bigint) as block
  from sized
)
select p.doc_id, p.source, p.block, cast(slots.slot as bigint) as slot
from placed p join sources s on p.source is not distinct from s.source join slots on slots.i = s.i and slots.block = p.block
"""
