"""Near-duplicate classes by BagMinHash signatures, banding and exact checks.

A text is the multiset of its five-word shingles; two texts are near
duplicates if the weighted Jaccard similarity of the multisets, with the
number of occurrences as weight, is at least 0.8.

*Signatures.*  Weights are discretised at the integers.  The weight axis is
cut into the dyadic ranges [0, 1), [1, 2), [2, 4), [4, 8), ...; every shingle
owns one seeded Poisson process of points (time, component, weight) over each
range, at a rate in proportion to the range's width, and a point counts for a
text if it lies below the shingle's weight there.  A component of the
signature is its earliest point.  Two texts share it with a probability equal
to their weighted Jaccard similarity, without bias, and points later than a
text's horizon are never generated, which makes one point per shingle the rule.

*Candidates.*  Signatures are cut into bands; texts that agree in a band share
a bucket.  Exact copies are first reduced to one representative, so that
buckets hold different texts.

*Checks.*  In each bucket the exact overlap of all members is computed in
blocks of a bounded number of texts and words.  If a bucket needs several blocks, its most linked
member is compared with all of them, then every member that this leaves
outside the main component is, in chunks: no link that matters to the classes
is lost, no bucket must fit in one task, and no pairs are emitted.

*Classes.*  Links are contracted by alternating large-star and small-star
steps until nothing changes; a class is named by its smallest doc_id.

Defined results: words are runs of letters, digits and underscores of the
lower-cased text; a text of one to four words is one shingle; texts without a
word, null texts and null doc_ids have no links.  Rows that repeat a doc_id
count as one document: with other texts, the one with the smallest hash is
compared, and equal texts link any of them.  Tables may be empty; other columns
are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arbograph.session import materialise

SHINGLE_WORDS = 5
THRESHOLD = 0.8
#: At a similarity of 0.8 all bands miss with a probability of 6e-5.
BANDS, BAND_ROWS = 32, 6
#: Members of a bucket that are compared at once within one task, and their words together.
BLOCK, BLOCK_WORDS = 1024, 262_144
#: Shingles whose overlaps are added up at a time, and rows of a table of overlaps that are judged at a time.
COLUMNS, STRIP = 1_024, 128
#: Candidates' ids are broadcast up to this number (16 bytes each), else joined by a shuffle.
BROADCAST_IDS = 1_000_000
CACHE_WORDS = 250_000
#: Points that are generated in one step.
AT_ONCE = 16_384
#: Documents of an Arrow batch.
BATCH_ROWS = 1_000
#: Bytes of text that are sketched at a time.
CHUNK_BYTES = 1_000_000

WORD = re.compile(r"\w+")
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits (splitmix64's finaliser)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _nth(k: int, step: int = 0x9E3779B97F4A7C15) -> np.uint64:
    return _U(k * step & 0xFFFFFFFFFFFFFFFF)


def _unit(x: np.ndarray) -> np.ndarray:
    """Uniform numbers in (0, 1]."""
    return ((x >> _U(11)).astype(np.float64) + 1.0) * 2.0**-53


class Shingler:
    """Hashes of words, kept in a table of bounded size, and of shingles."""

    def __init__(self, words: int = SHINGLE_WORDS) -> None:
        self.words = words
        self.cache: dict[str, int] = {}

    def word_hashes(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words in order, and the number of words of each text."""
        found = [WORD.findall(t.lower()) if t else [] for t in texts]
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        cache = self.cache
        for word in set().union(*found) - cache.keys():
            cache[word] = xxhash.xxh3_64_intdigest(word)
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter(map(cache.__getitem__, chain.from_iterable(found)), np.uint64, int(sizes.sum()))
        return flat, sizes

    def bags(self, flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text numbers, distinct shingle hashes and their counts, in no order, from ``word_hashes``."""
        text = np.repeat(np.arange(len(sizes)), sizes)
        width = np.minimum(sizes, self.words)
        at = np.flatnonzero(np.arange(len(flat)) + width[text] <= np.cumsum(sizes)[text])
        text = text[at]
        width = width[text]
        padded = np.concatenate([flat, np.zeros(self.words, np.uint64)])
        short = bool(len(width)) and int(width.min()) < self.words
        shingle = width.astype(np.uint64)
        for k in range(self.words):
            part = padded[at + k] * _nth(2 * k + 1)
            shingle += np.where(k < width, part, _U(0)) if short else part
        shingle = _mix(shingle)
        key = _mix(shingle + text.astype(np.uint64) * _nth(11))
        order = np.argsort(key)
        key = key[order]
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.empty(0, np.int64)
        kept = order[first]
        return text[kept], shingle[kept], np.diff(np.append(first, len(key)))


def signatures(text: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n_texts: int, size: int) -> np.ndarray:
    """BagMinHash signatures, one row a text; components are times, so equal times mean the same point."""
    out = np.full((n_texts, size), np.inf)
    total = np.bincount(text, weights=weight, minlength=n_texts)
    todo = np.flatnonzero(total > 0)
    horizon = np.zeros(n_texts)
    horizon[todo] = (np.log(size) + 4.0) / total[todo]
    while len(todo):
        open_ = np.zeros(n_texts, bool)
        open_[todo] = True
        of, key, below = (x[open_[text]] for x in (text, shingle, weight))
        low, level = 0, 0
        while len(of):
            high = 1 if level == 0 else 2 * low
            reach = below > low
            if not reach.any():
                break
            of, key, below = of[reach], key[reach], below[reach]
            _points(out, of, _mix(key + _nth(level, 0xD1B54A32D192ED03)), below, low, high, horizon, size)
            low, level = high, level + 1
        todo = todo[np.isinf(out[todo]).any(axis=1)]
        horizon[todo] *= 2.0
        out[todo] = np.inf
    return out


def _points(out, text, seed, weight, low, high, horizon, size) -> None:
    """Enter the points of one range of weights, shingle by shingle in order of time, up to each text's horizon.

    Few shingles that have many points each are carried on by several points
    at once; times are running sums either way, so they don't depend on it.
    """
    time, step = np.zeros(len(text)), 0
    while len(text):
        width = 1 if step == 0 else max(1, min(256, AT_ONCE // len(text)))
        draws = [_mix(seed[:, None] + np.array([_nth(3 * k + j) for k in range(step, step + width)])[None, :]) for j in (1, 2, 3)]
        gaps = -np.log(_unit(draws[0])) / (size * (high - low))
        times = np.cumsum(np.concatenate([time[:, None], gaps], axis=1), axis=1)[:, 1:]
        level = low + (high - low) * _unit(draws[2])
        counts = (times <= horizon[text][:, None]) & (level <= weight[:, None])
        row, column = np.nonzero(counts)
        component = (draws[1][row, column] % _U(size)).astype(np.int64)
        np.minimum.at(out, (text[row], component), times[row, column])
        go_on = times[:, -1] <= horizon[text]
        text, seed, weight, time = text[go_on], seed[go_on], weight[go_on], times[go_on, -1]
        step += width


def band_keys(times: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit bucket for each text and band."""
    parts = times.view(np.uint64).reshape(len(times), bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), parts.shape[:2])
    for k in range(rows):
        key = _mix(key * _U(0x9E3779B97F4A7C15) + parts[:, :, k])
    return key.view(np.int64)


def _runs(texts: pa.Array, size: int) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts of about ``size`` bytes."""
    start = total = 0
    for k, n in enumerate(pc.binary_length(texts).to_pylist()):
        total += n or 0
        if total >= size:
            yield start, k + 1
            start, total = k + 1, 0
    if start < len(texts):
        yield start, len(texts)


def fingerprints(docs: DataFrame, bands: int = BANDS, rows: int = BAND_ROWS) -> DataFrame:
    """doc_id, digest of the words, buckets, a hash (pick) and the number of words of every text with a word."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in batches:
            ids = batch.column(0)
            for low, high in _runs(batch.column(1), CHUNK_BYTES):
                part = batch.column(1).slice(low, high - low).to_pylist()
                flat, sizes = shingler.word_hashes(part)
                text, shingle, weight = shingler.bags(flat, sizes)
                keys = band_keys(signatures(text, shingle, weight, len(part), bands * rows), bands, rows)
                ends = np.cumsum(sizes)
                digests = [xxhash.xxh3_128_digest(flat[e - n : e].tobytes()) if n else None for e, n in zip(ends, sizes, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(low, high - low),
                        batch.column(2).slice(low, high - low),
                        pa.array(digests, pa.binary()),
                        pa.ListArray.from_arrays(np.arange(0, keys.size + 1, bands, dtype=np.int32), pa.array(keys.reshape(-1))),
                        pa.array(sizes),
                    ],
                    ["doc_id", "pick", "digest", "buckets", "words"],
                )

    return (
        docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
        .filter("doc_id is not null and text is not null")
        .select("doc_id", "text", F.xxhash64("text").alias("pick"))
        .mapInArrow(sketch, "doc_id long, pick long, digest binary, buckets array<long>, words long")
        .filter("digest is not null")
    )


def overlaps(text, shingle, weight, n: int, left: int) -> np.ndarray:
    """Multiset overlaps of the first ``left`` texts with all ``n``, by blocked products of 0/1 columns."""
    nth = np.zeros(len(text), np.int64)
    if len(weight) and weight.max() > 1:  # the k-th occurrence of a shingle is a column of its own
        nth = np.arange(int(weight.sum())) - np.repeat(np.cumsum(weight) - weight, weight)
        text, shingle = np.repeat(text, weight), np.repeat(shingle, weight)
    _, column, count = np.unique(_mix(shingle + nth.astype(np.uint64)), return_inverse=True, return_counts=True)
    shared = count[column] > 1
    text, column = text[shared], column[shared]
    rank = np.cumsum(count > 1) - 1
    column = rank[column]
    order = np.argsort(column, kind="stable")
    text, column = text[order], column[order]
    out = np.zeros((left, n), np.float32)
    width = COLUMNS
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        low, high = np.searchsorted(column, (start, start + width))
        table = np.zeros((n, width), np.float32)
        table[text[low:high], column[low:high] - start] = 1
        out += table[:left] @ table.T
    return out


def _linked(texts: pa.Array, left: int, threshold: float) -> np.ndarray:
    """Which of the first ``left`` texts are near duplicates of which of all; words are strings for a run of texts at a time only."""
    shingler = Shingler()
    runs = [shingler.word_hashes(texts.slice(low, high - low).to_pylist()) for low, high in _runs(texts, CHUNK_BYTES)]
    shingler.cache.clear()
    text, shingle, weight = shingler.bags(np.concatenate([flat for flat, _ in runs]), np.concatenate([sizes for _, sizes in runs]))
    del runs
    total = np.bincount(text, weights=weight, minlength=len(texts))
    both = overlaps(text, shingle, weight, len(texts), left)
    out = np.empty(both.shape, bool)
    for low in range(0, left, STRIP):
        part = both[low : low + STRIP].astype(np.float64)
        out[low : low + STRIP] = (part >= threshold * (total[low : min(low + STRIP, left), None] + total[None, :] - part) - 1e-9) & (part > 0)
    return out


def _components(links: np.ndarray) -> np.ndarray:
    """The smallest member that each row of a symmetric table of links is connected with."""
    n = len(links)
    label = np.full(n, -1)
    for k in range(n):
        if label[k] < 0:
            front = np.array([k])
            label[k] = k
            while len(front):
                front = np.flatnonzero(links[front].any(axis=0) & (label < 0))
                label[front] = k
    return label


def _within_block(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("doc_id")
        ids = table.column("doc_id").to_numpy()
        links = _linked(table.column("text").combine_chunks(), len(ids), threshold)
        label = _components(links)
        return pa.table(
            {
                "bucket": table.column("bucket"),
                "block": table.column("block"),
                "doc_id": ids,
                "root": ids[label],
                "links": links.sum(axis=1).astype(np.int64),
            }
        )

    return run, "bucket long, block int, doc_id long, root long, links long"


def _across_blocks(threshold: float):
    """Links of travelling texts with a block's members: one for each of the block's components."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("traveller", "descending"), ("doc_id", "ascending")])
        n = int(table.column("traveller").to_numpy(zero_copy_only=False).sum())
        ids, root = table.column("doc_id").to_numpy(), table.column("root").to_numpy()
        links = _linked(table.column("text").combine_chunks(), n, threshold)[:, n:]
        roots, at = np.unique(root[n:], return_inverse=True)
        a, b = np.nonzero(links)
        found = np.unique(a * len(roots) + at[b])
        out = np.stack([ids[found // max(1, len(roots))], roots[found % max(1, len(roots))]], axis=1)
        key = {k: table.column(k)[0].as_py() for k in ("bucket", "block")}
        return pa.table(
            {
                "bucket": pa.array([key["bucket"]] * len(out), pa.int64()),
                "block": pa.array([key["block"]] * len(out), pa.int32()),
                "doc_id": out[:, 0],
                "root": out[:, 1],
            }
        )

    return run, "bucket long, block int, doc_id long, root long"


def links(docs: DataFrame, prints: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """Links (doc_id, other) between different texts, enough to connect every class.

    ``prints`` must be stored rows of ``fingerprints``, one for each text.
    """
    members = prints.select("doc_id", "words", F.explode("buckets").alias("bucket"))
    hashed = F.xxhash64("doc_id")
    shared = materialise(
        members.groupBy("bucket")
        .agg(F.count("*").alias("n"), F.sum(F.shiftright(hashed, 20)).alias("s"), F.bit_xor(hashed).alias("x"), F.sum("words").alias("words"))
        .filter("n > 1")
        .groupBy("n", "s", "x")  # buckets of the same members
        .agg(F.min("bucket").alias("bucket"), F.max("words").alias("words"))
        .select("bucket", F.ceil(F.greatest(F.col("n") / block, F.least(F.col("n"), F.col("words") / BLOCK_WORDS))).cast("int").alias("blocks")),
        "shared",
    )
    members = materialise(
        members.drop("words").join(shared, "bucket").withColumn("block", F.pmod(F.xxhash64("doc_id", "bucket"), F.col("blocks")).cast("int")),
        "members",
    )
    wanted = members.select("doc_id").distinct().join(prints.select("doc_id", "pick"), "doc_id")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    few = wanted.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    picked = texts.withColumn("pick", F.xxhash64("text")).join(F.broadcast(wanted) if few else wanted, ["doc_id", "pick"], "left_semi")
    texts = picked.dropDuplicates(["doc_id"]).select("doc_id", "text")  # equal texts by now
    members = members.join(texts, "doc_id")

    run, schema = _within_block(threshold)
    inside = materialise(members.groupBy("bucket", "block").applyInArrow(run, schema), "inside")
    found = inside.filter("doc_id <> root").select("doc_id", F.col("root").alias("other"))
    blocks = shared.filter("blocks > 1").select("bucket", "blocks")
    if blocks.isEmpty():
        return found

    inside = inside.select("bucket", "block", "doc_id", "root", "links")
    large = members.join(inside.select("bucket", "doc_id", "root"), ["bucket", "doc_id"]).filter("blocks > 1")
    run, schema = _across_blocks(threshold)

    def meet(travellers: DataFrame) -> DataFrame:
        """Travellers (bucket, doc_id, chunk) against every block of their buckets."""
        chunks = travellers.groupBy("bucket").agg(F.max("chunk").alias("chunks"))
        sides = large.join(chunks, "bucket").select(
            "bucket", "block", F.explode(F.sequence(F.lit(0), "chunks")).alias("chunk"), "doc_id", "root", "text", F.lit(False).alias("traveller")
        )
        sent = (
            travellers.join(blocks, "bucket")
            .join(texts, "doc_id")
            .select("bucket", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "chunk", "doc_id", F.col("doc_id").alias("root"), "text", F.lit(True).alias("traveller"))
        )
        return sides.unionByName(sent).groupBy("bucket", "block", "chunk").applyInArrow(run, schema)

    first = (
        inside.join(blocks, "bucket")
        .groupBy("bucket")
        .agg(F.max_by("doc_id", F.struct("links", -F.col("doc_id"))).alias("doc_id"))
        .withColumn("chunk", F.lit(0))
    )
    hits = materialise(meet(first), "hits")
    rest = inside.join(blocks, "bucket").join(hits.select("bucket", "block", "root"), ["bucket", "block", "root"], "left_anti")
    size = Window.partitionBy("bucket", "block").orderBy("doc_id")
    chunk = F.row_number().over(size)
    rest = rest.select("bucket", "doc_id", "block", "blocks", chunk.alias("k"))
    rest = rest.select("bucket", "doc_id", (F.col("block") + F.col("blocks") * F.floor((F.col("k") - 1) / block)).cast("int").alias("chunk"))
    more = materialise(meet(materialise(rest, "rest")), "more")
    return found.unionByName(
        hits.unionByName(more).filter("doc_id <> root").select("doc_id", F.col("root").alias("other"))
    )


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node connected with each node of ``edges`` (doc_id, other)."""
    a, b = F.col("doc_id"), F.col("other")
    edges = materialise(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter("a <> b").distinct(), "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # stored, so that the join below has exchanges of its own, whose skewed partitions can be split
        least = materialise(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = materialise(large.filter("a <> b").distinct(), "large")
        least = materialise(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(least, "a")
        small = small.select("a", F.col("m").alias("b")).unionByName(
            small.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        )
        edges = materialise(small.distinct(), "edges")
        pair = F.xxhash64("a", "b")
        now = edges.agg(F.count("*"), F.bit_xor(pair), F.sum(F.shiftright(pair, 20))).first()
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now


def near_duplicate_classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id and class_id of every row of ``docs``; a class is named by its smallest doc_id."""
    prints = materialise(fingerprints(docs), "fingerprints", BATCH_ROWS)
    copies = materialise(prints.groupBy("digest").agg(F.min("doc_id").alias("first")), "copies")
    firsts = prints.join(copies.select(F.col("first").alias("doc_id")).distinct(), "doc_id", "left_semi")
    one = firsts.groupBy("doc_id").agg(F.min(F.struct("pick", "digest", "buckets", "words")).alias("p")).select("doc_id", "p.*")
    found = links(docs, one, threshold)
    same = prints.select("digest", "doc_id").join(copies, "digest").filter("doc_id <> first")
    found = found.unionByName(same.select("doc_id", F.col("first").alias("other")))
    roots = components(found).select(F.col("node").alias("doc_id"), F.col("root").alias("class_id"))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    return ids.join(roots, "doc_id", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One document of each class, with all its columns; rows without a doc_id stay, as do all texts of a repeated one."""
    kept = near_duplicate_classes(docs, threshold).filter("doc_id = class_id").select("doc_id").distinct()
    chosen = docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return chosen.select(docs.columns).unionByName(docs.filter("doc_id is null"))
