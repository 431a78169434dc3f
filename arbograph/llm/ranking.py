"""The best documents of each item by their shared terms, with MaxScore in each shard.

A first pass over the texts counts terms; of each document it keeps the number
of its terms and how often it holds those that some item asks for, and nothing
else.  Corpus counts follow from these rows.  In the second pass every Arrow
batch of them is a shard: its postings are laid out by term, with what each adds
to a score, and the largest of these bounds the term in this shard.

For each item, terms are ordered by bound.  Those whose bounds together stay
below the score that the item's tenth document has so far are non-essential: no
document that holds only these can come in.  Postings of the essential terms are
added up, and the others are probed, the one with the largest bound first, for
those documents only that can still reach the limit with all that is left.  The
limit goes on from shard to shard of a task.  Each task sends on its best
documents of each item, and the best of these are the result; postings are
never shuffled.

Terms of all items go to the tasks in blocks of at most ``BLOCK_TERMS``; more
items than fit one block take a pass over the texts for each block, and an item
is never split.

Defined results: null and empty texts, and items without terms, have no rows; an
item's repeated terms count once; rows that repeat an item_id are items of
their own, told apart by ``copy`` within; documents that repeat a doc_id are ranked each;
equal scores go by doc_id, null last; terms that all documents hold may weigh 0
and then add nothing; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arbograph.session import materialise

#: Documents that an item gets.
TOP = 10
#: Distinct terms, and terms of items, that are sent to the tasks at a time.
BLOCK_TERMS = 200_000
#: Rows of whole texts in an Arrow batch.
TEXT_ROWS = 1_024

# Letters of terms, and how frequencies and lengths count.
SEPARATORS = bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
UPPER, LOWER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
BASE_LENGTH, SLOPE, SCALE, TF_SCALE, LENGTH_SCALE = 100 - 90, 90, 1_000_000_000, 1_000, 8

_TABLE = bytes.maketrans(SEPARATORS + UPPER, b" " * len(SEPARATORS) + LOWER)


def terms_of(text: bytes | None) -> list[bytes]:
    """The terms of a text in UTF-8, whose bytes beyond ASCII are all part of terms."""
    return (text or b"").translate(_TABLE).split()


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def item_terms(items: DataFrame) -> DataFrame:
    """item_id, copy and the sorted distinct terms of each item that has some."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(set(terms_of(t))) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(found, pa.list_(pa.binary()))], ["item_id", "copy", "terms"])

    # rows that repeat an item_id, however many, are told apart by where they are read
    own = items.select(F.col("item_id").cast("long").alias("item_id"), F.monotonically_increasing_id().alias("copy"), F.col("text").cast("string").cast("binary").alias("text"))
    return own.mapInArrow(run, "item_id long, copy long, terms array<binary>").filter(F.size("terms") > 0)


def blocks(items: DataFrame, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """``items`` with ``block``: all are one block if ``block_terms`` suffice, else none holds more besides one item's own.

    Items are dealt so that blocks get half of the limit on average, and one that is fuller is cut by running totals.
    """
    total = items.agg(F.sum(F.size("terms"))).first()[0] or 0
    n = 1 if total <= block_terms else -(-2 * total // block_terms)
    dealt = F.pmod(F.xxhash64("item_id", "copy"), F.lit(n))
    size = F.sum(F.size("terms")).over(Window.partitionBy("dealt").orderBy("item_id", "copy").rowsBetween(Window.unboundedPreceding, 0))
    cut = items.withColumn("dealt", dealt).withColumn("cut", F.floor((size - 1) / block_terms) if n > 1 else F.lit(0))
    return cut.withColumn("block", F.concat_ws(".", "dealt", "cut")).drop("dealt", "cut")


def holdings(docs: DataFrame, terms: list[bytes]) -> DataFrame:
    """doc_id, n (terms of the text, 1 at least), and for those of ``terms`` that it holds their number and how often it holds them."""
    sent = docs.sparkSession.sparkContext.broadcast(b" ".join(terms))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {t: k for k, t in enumerate(sent.value.split(b" "))}.get
        for batch in batches:
            at, sizes, which, counts, ends = [], [], [], [], [0]
            for row, text in enumerate(batch.column(1)):
                words = terms_of(text.as_py())
                if words:
                    found = Counter(map(number, words))
                    found.pop(None, None)
                    at.append(row)
                    sizes.append(len(words))
                    which.extend(found)
                    counts.extend(found.values())
                    ends.append(len(which))
            offsets = pa.array(ends, pa.int32())
            lists = (pa.ListArray.from_arrays(offsets, pa.array(v, t)) for v, t in ((which, pa.int32()), (counts, pa.int64())))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(sizes, pa.int64()), *lists], ["doc_id", "n", "terms", "counts"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return own.mapInArrow(run, "doc_id long, n long, terms array<int>, counts array<long>")


class Shard:
    """Postings of some documents by term, with what each adds to a score."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray, ends: np.ndarray, terms: np.ndarray, counts: np.ndarray, weights: np.ndarray, documents: int, total: int) -> None:
        """``ends``: where each document's entries end, from 0 on; ids rise, so that equal scores go to the first."""
        m = BASE_LENGTH + SLOPE * lengths * documents // total
        doc = np.repeat(np.arange(len(ids)), np.diff(ends))
        order = np.argsort(terms, kind="stable")
        self.ids, self.doc, self.term = ids, doc[order], terms[order]
        counts = counts[order]
        self.gain = weights[self.term] * (SCALE * counts // (TF_SCALE * counts + LENGTH_SCALE * m[self.doc]))
        self.first = np.searchsorted(self.term, np.arange(len(weights) + 1))
        self.bound = np.zeros(len(weights), np.int64)
        held = np.flatnonzero(np.diff(self.first))
        if held.size:
            self.bound[held] = np.maximum.reduceat(self.gain, self.first[held])
        self.probed = 0

    def postings(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        low, high = self.first[term], self.first[term + 1]
        return self.doc[low:high], self.gain[low:high]

    def best(self, terms: np.ndarray, limit: int, top: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the documents that reach ``limit``, all that can be among the shard's ``top`` at least."""
        bounds = self.bound[terms]
        order = np.argsort(bounds, kind="stable")
        terms, below = terms[order], np.cumsum(bounds[order])
        # documents that hold only these stay below the limit; one that meets it may win by its id
        split = int(np.searchsorted(below, max(limit, 1), "left"))
        if split == len(terms):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        found = [self.postings(t) for t in terms[split:]]
        docs = np.concatenate([d for d, _ in found])
        docs, inverse = np.unique(docs, return_inverse=True)
        scores = np.zeros(len(docs), np.int64)
        np.add.at(scores, inverse, np.concatenate([g for _, g in found]))
        for k in range(split - 1, -1, -1):
            if len(docs) > top:
                # what they have already is a limit, too
                limit = max(limit, int(np.partition(scores, len(scores) - top)[len(scores) - top]))
            able = scores + below[k] >= max(limit, 1)
            docs, scores = docs[able], scores[able]
            if not docs.size:
                break
            held, gain = self.postings(terms[k])
            at = np.minimum(np.searchsorted(held, docs), max(len(held) - 1, 0))
            if held.size:
                hit = held[at] == docs
                scores[hit] += gain[at[hit]]
                self.probed += len(docs)
        able = scores >= max(limit, 1)
        return docs[able], scores[able]


def best_of(held: DataFrame, items: list[tuple[int | None, int, np.ndarray]], weights: np.ndarray, documents: int, total: int, top: int = TOP) -> DataFrame:
    """item_id, copy, doc_id and score of each task's best documents; ``items`` have the numbers of their terms."""
    sent = held.sparkSession.sparkContext.broadcast((items, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weights = sent.value
        kept = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in items]
        for batch in batches:
            if not batch.num_rows:
                continue
            # null ids are held as the largest number, with which equal scores go last
            ids = batch.column(0).fill_null(np.iinfo(np.int64).max).to_numpy()
            by_id = np.argsort(ids, kind="stable")
            batch = batch.take(pa.array(by_id))
            lists, counts = batch.column(2), batch.column(3)
            ends = lists.offsets.to_numpy().astype(np.int64)
            shard = Shard(ids[by_id], batch.column(1).to_numpy(), ends - ends[0], lists.flatten().to_numpy(), counts.flatten().to_numpy(), weights, documents, total)
            for k, (_, _, terms) in enumerate(items):
                had, scores = kept[k]
                docs, more = shard.best(terms, int(scores[-1]) if len(scores) == top else 0, top)
                if docs.size:
                    had, scores = np.concatenate([had, shard.ids[docs]]), np.concatenate([scores, more])
                    order = np.lexsort((had, -scores))[:top]
                    kept[k] = had[order], scores[order]
        rows = [(item, copy, int(d), int(s)) for (item, copy, _), (ds, ss) in zip(items, kept) for d, s in zip(ds, ss)]
        columns = list(zip(*rows)) or [()] * 4
        ids = pa.array([None if d == np.iinfo(np.int64).max else d for d in columns[2]], pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), ids, pa.array(columns[3], pa.int64())], ["item_id", "copy", "doc_id", "score"])

    return held.select("doc_id", "n", "terms", "counts").mapInArrow(run, "item_id long, copy long, doc_id long, score long")


def rank(docs: DataFrame, items: DataFrame, top: int = TOP, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """item_id, rank, doc_id, score and ``copy`` of the ``top`` documents of every row of ``items`` with a score above 0."""
    items = materialise(blocks(item_terms(items), block_terms), "items")
    found = None
    for block in sorted(r[0] for r in items.select("block").distinct().collect()):  # so many as the items' terms ask for
        rows = items.filter(F.col("block") == block).drop("block").orderBy("item_id", "copy").collect()  # bounded by block_terms
        names = sorted({bytes(t) for r in rows for t in r["terms"]})
        number = {t: k for k, t in enumerate(names)}
        held = materialise(holdings(docs, names), "holdings", TEXT_ROWS)
        documents, total = held.agg(F.count("*"), F.sum("n")).first()
        if not documents:
            continue
        holding = dict(held.select(F.explode("terms").alias("t")).groupBy("t").count().collect())
        weights = np.array([weight(documents, holding.get(k, 0)) for k in range(len(names))], np.int64)
        asked = [(r["item_id"], r["copy"], np.array([number[bytes(t)] for t in r["terms"]], np.int64)) for r in rows]
        best = best_of(held, asked, weights, documents, total, top)
        found = best if found is None else found.unionByName(best)
    if found is None:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long, copy long")
    first = Window.partitionBy("item_id", "copy").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score", "copy")


ORACLE_SQL = r"""
with terms as materialized (
  select id, t, count(*) as tf from (
    select row_number() over () as id, unnest([translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
      for x in regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')]) as t
    from documents) group by id, t
), ids as (select row_number() over () as id, doc_id from documents),
lengths as materialized (select id, cast(sum(tf) as bigint) as n from terms group by id),
corpus as materialized (select cast(count(*) as bigint) as nn, cast(sum(n) as bigint) as ll from lengths),
weights as (select t, cast(floor(1000 * ln((2 * nn + 2) / cast(2 * count(*) + 1 as double))) as bigint) as w from terms, corpus group by t, nn),
asked as (
  select distinct item_id, unnest([translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
    for x in regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')]) as t
  from benchmark
), scored as (
  select a.item_id, d.id, cast(sum(w.w * ((1000000000 * d.tf) // (1000 * d.tf + 8 * (100 - 90 + (90 * l.n * c.nn) // c.ll)))) as bigint) as score
  from asked a join weights w using (t) join terms d using (t) join lengths l using (id) cross join corpus c group by a.item_id, d.id
), ranked as (
  select item_id, doc_id, score, row_number() over (partition by item_id order by score desc, doc_id) as rank
  from scored join ids using (id) where score > 0
)
select item_id, cast(rank as integer) as rank, doc_id, score from ranked where rank <= 10
"""
