"""Similar vectors, aliases of entities, and scores of documents.  Distances here are exact."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arbograph.session import materialise

#: Rows and probes of a block, and probes whose products a task holds at once.
ROWS, PROBES, AT_ONCE = 16_384, 8_192, 256


BLOCKS = ("key", "size", "row_block", "probe_block")


def _hashed(rows: DataFrame, probes: DataFrame) -> tuple[DataFrame | None, DataFrame | None]:
    """Rows and probes by pairs of blocks: every block of the one with every block of the other; None if there are no pairs."""
    count = lambda x, n, name: x.groupBy("key", "size").agg(F.ceil(F.count("*") / n).cast("int").alias(name))
    cut = materialise(count(rows, ROWS, "row_blocks").join(count(probes, PROBES, "probe_blocks"), ["key", "size"]), "blocks")
    part = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    held = rows.join(cut, ["key", "size"]).select("key", "size", part("row_blocks").alias("row_block"), every("probe_blocks").alias("probe_block"), "id", "vector")
    sent = probes.join(cut, ["key", "size"]).select("key", "size", every("row_blocks").alias("row_block"), part("probe_blocks").alias("probe_block"), "id", "vector")
    return (None, None) if cut.isEmpty() else (held, sent)


def _ranges(rows: DataFrame, probes: DataFrame) -> tuple[DataFrame | None, DataFrame | None]:
    """As ``_hashed`` with ranges of ids as blocks, without pairs all of whose rows have larger ids than all probes; null ids are in none.

    Ids are counted in steps of half a block, and a block is a run of steps: it
    ends with the step that fills its half.
    """

    def cut(x: DataFrame, n: int, name: str) -> tuple[DataFrame, DataFrame]:
        step = max(n // 2, 1)
        stepped = x.filter("id is not null").withColumn("step", F.floor(F.col("id") / step))
        before = F.sum("n").over(Window.partitionBy("key", "size").orderBy("step").rowsBetween(Window.unboundedPreceding, -1))
        counts = stepped.groupBy("key", "size", "step").agg(F.count("*").alias("n"), F.min("id").alias("low"), F.max("id").alias("high"))
        return stepped, materialise(counts.select("key", "size", "step", "low", "high", F.floor(F.coalesce(before, F.lit(0)) / step).alias(name)), "blocks")

    (rows, row_cut), (probes, probe_cut) = cut(rows, ROWS, "row_block"), cut(probes, PROBES, "probe_block")
    lows = row_cut.groupBy("key", "size", "row_block").agg(F.min("low").alias("low"))
    highs = probe_cut.groupBy("key", "size", "probe_block").agg(F.max("high").alias("high"))
    pairs = materialise(lows.join(highs, ["key", "size"]).filter("low < high").select(*BLOCKS), "pairs")  # a row a task
    place = lambda x, steps, name: x.join(steps.select("key", "size", "step", name), ["key", "size", "step"]).join(pairs, ["key", "size", name]).select(*BLOCKS, "id", "vector")
    return (None, None) if pairs.isEmpty() else (place(rows, row_cut, "row_block"), place(probes, probe_cut, "probe_block"))


def _nearest(rows: DataFrame, probes: DataFrame, k: int, below: float, earlier: bool) -> DataFrame:
    """(probe_id, id, score) of the k rows most similar to each probe; both are (id, key, vector).

    Rows and probes of a key, with vectors of equal length, are cut into blocks
    of bounded size by their counts, and every block of probes meets every
    block of rows, so a key that most rows share is spread over tasks.  Of a
    pair of blocks only each probe's k best are kept.  With ``earlier``, for rows with
    smaller ids than the probe's only, blocks are ranges of ids, and those that lie
    behind a block of probes aren't sent there: about half of all pairs.
    """
    spark = rows.sparkSession
    rows, probes = (x.select(F.col("id").alias("id"), F.col("key").alias("key"), F.size("vector").alias("size"), F.col("vector").cast("array<double>").alias("vector")).filter("vector is not null and key is not null") for x in (rows, probes))
    held, sent = (_ranges if earlier else _hashed)(rows, probes)

    def unit(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        vectors = table.column("vector").combine_chunks()
        x = vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1)
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        return table.column("id").to_numpy(), np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if left.num_rows and right.num_rows:
            ids, x = unit(left.sort_by("id"))
            names, p = unit(right)
            for low in range(0, len(names), AT_ONCE):
                own = names[low : low + AT_ONCE]
                score = (p[low : low + AT_ONCE] @ x.T).round(6)
                out = np.isnan(score) | (np.round(1 - score, 6) >= below)
                if earlier:
                    out |= ids[None, :] >= own[:, None]
                score[out] = -np.inf
                best = np.argsort(-score, axis=1, kind="stable")[:, :k]  # of equal scores the smaller id
                value = np.take_along_axis(score, best, axis=1)
                kept = np.isfinite(value)
                found.append((np.repeat(own, kept.sum(axis=1)), ids[best][kept], value[kept]))
        columns = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
        return pa.table(dict(zip(("probe_id", "id", "score"), columns, strict=True)))

    if held is None:
        return spark.createDataFrame([], "probe_id long, id long, score double")
    return held.groupBy(*BLOCKS).cogroup(sent.groupBy(*BLOCKS)).applyInArrow(meet, "probe_id long, id long, score double")


def _first(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("probe_id").orderBy(F.desc("score"), "id")
    return found.withColumn("ord", F.row_number().over(order)).filter(F.col("ord") <= k)


def similar_entities(entities: DataFrame, probes: DataFrame, threshold: float, k: int = 5, earlier: bool = False) -> DataFrame:
    """For each probe the k nearest other entities of its type below a cosine distance, with ``earlier`` those with smaller ids.

    Both have entity_id, entity_type and name_embedding; null types and vectors
    match nothing, nor do vectors of different lengths.
    """
    of = lambda x: x.select(F.col("entity_id").alias("id"), F.col("entity_type").alias("key"), F.col("name_embedding").alias("vector"))
    found = _nearest(of(entities), of(probes), k + 1, threshold, earlier).filter("id <> probe_id")
    kinds = probes.select(F.col("entity_id").alias("probe_id"), "entity_type").distinct()
    return _first(found, k).join(kinds, "probe_id").select("probe_id", F.col("id").alias("entity_id"), "entity_type", F.round(1 - F.col("score"), 6).alias("distance"), "ord")


def cosine_topk(rows: DataFrame, probes: DataFrame, k: int = 5) -> DataFrame:
    """The k rows of (id, vector) most similar to each probe (id, vector), over all rows; zero vectors score 0."""
    of = lambda x: x.select("id", F.lit("").alias("key"), "vector")
    return _first(_nearest(of(rows), of(probes), k, np.inf, False), k)


def resolution_action(distance: Column, auto: float = 0.15, ask: float = 0.3) -> Column:
    """auto below the first bound, llm below the second, else reject."""
    return F.when(distance < auto, "auto").when(distance < ask, "llm").otherwise("reject")


def entity_aliases(candidates: DataFrame, confirmed: DataFrame | None = None, auto: float = 0.15, ask: float = 0.3) -> DataFrame:
    """canonical_id, alias_id, similarity and confirmed of each probe's first accepted candidate.

    Candidates are (probe_id, entity_id, distance) with smaller ids than the
    probe, so every entity is resolved towards earlier ones.  ``confirmed``
    (probe_id, entity_id) answers for those that must be asked about; they are
    marked 1, accepted ones below the first bound 0.
    """
    c = candidates.filter("entity_id < probe_id").withColumn("action", resolution_action(F.col("distance"), auto, ask)).filter("action <> 'reject'")
    if confirmed is not None:
        yes = confirmed.select("probe_id", "entity_id", F.lit(True).alias("yes"))
        c = c.join(yes, ["probe_id", "entity_id"], "left").filter("action = 'auto' or yes")
    else:
        c = c.filter("action = 'auto'")
    first = c.withColumn("k", F.row_number().over(Window.partitionBy("probe_id").orderBy("distance", "entity_id"))).filter("k = 1")
    return first.select(F.col("entity_id").alias("canonical_id"), F.col("probe_id").alias("alias_id"), F.round(1 - F.col("distance"), 4).alias("similarity"), (F.col("action") == "llm").cast("int").alias("confirmed"))


def resolution_stats(candidates: DataFrame, auto: float = 0.15, ask: float = 0.3) -> DataFrame:
    return candidates.groupBy(resolution_action(F.col("distance"), auto, ask).alias("action")).agg(F.count("*").alias("n"))


def doc_score(chunks: DataFrame) -> DataFrame:
    """Sum of chunk scores over the root of their number plus one, by document."""
    return chunks.groupBy("doc_id").agg((F.sum("score") / F.sqrt(F.count("*") + 1)).alias("doc_score"))
