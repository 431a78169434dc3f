"""Nearest neighbours by inner product: inverted lists, product-quantised residuals, exact reranking.

A bounded sample trains coarse centroids and, for the residuals, one small
codebook for each group of components.  Every row is then indexed: its nearest
centroid's list, its residual's length and the codes of its direction, its vector.  A query visits the lists
whose centroids promise most and ranks their rows by sums from a table of its own
products with the codebooks (asymmetric distances).  Lists send codes only and
get back each query's best rows by these sums; the best of a query over all its
lists, four for each that is wanted or more, meet their vectors and are ranked by the exact product of the original
vectors in double precision.

What a query visits and reranks is fitted to some probes, drawn from the queries
themselves, whose nearest among all rows are found by brute force in one pass:
the fewest lists that hold the wanted share of these, then the fewest rows by
the codes' sums among which they are.  Where vectors have no clusters, as random directions have
none, that may be half of the lists; the more clustered, the fewer.  Within tight
clusters the codes' error exceeds the differences of the products; where too many rows would be
reranked, what a level of codes leaves over is coded again, with its own length and
codebooks, up to eight levels.  Components are multiplied by one power of two for all rows (and by one
for each query), so no size of them leaves the range of single precision.  Lists are
cut into blocks and the queries of a list into groups, both of bounded size, so
neither a crowded list nor many queries must fit in one task, and a list's rows
are copied only as often as its own queries need.

Defined results: vectors that are null, zero, or hold null or non-finite
components take no part, nor do those whose length is not the commonest one, or
rows without an id; of rows that repeat an id the one with the smallest vector, by
its first components, counts, as a query and as a row; a row is never its own
neighbour; equal scores go by the smaller id; empty tables give no rows; columns
other than the id and the vector are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arbograph.session import materialise

#: Bounds of what is trained on: rows, and components in all.
SAMPLE_ROWS, SAMPLE_VALUES = 16_384, 8_000_000
#: Components that share a codebook, and its entries.
GROUP, CODES = 2, 256
#: Lists for the root of the number of rows, and at most; rows of the sample for each of them.
LISTS, MAX_LISTS, ROWS_A_LIST = 1 / 3, 4_096, 4
#: The shares of the nearest rows that the visited lists and the reranked rows are to hold, and the sampled queries that show it.
COVERAGE, FOUND, PROBES = 0.97, 0.96, 256
#: Rows of a list's block, and queries of a group.
BLOCK, QUERIES = 8_192, 4_096
#: Rows that the queries of a group get back from a block, all together; fewer queries make a group where each gets more.
PAIRS = 1_000_000
#: Rows that a query reranks, of all its lists together: so many for each that it wants, and at least.
RERANK, LEAST_RERANK = 4, 64
#: Levels of codes that are tried one after another while more than so many rows for each that is wanted would be reranked.
LEVELS, MOST_RERANK = (1, 2, 4, 8), 16
#: Queries whose tables a task holds at once.
TABLES = 128


@dataclass(frozen=True)
class Index:
    """What training yields; its size depends on the number of lists and components, not on that of rows.

    Rows are indexed times 2 ** -exponent.  ``books``: by group of components, code and level.
    """

    centroids: np.ndarray
    books: np.ndarray
    visits: int
    exponent: int = 0
    rerank: int = 0

    @property
    def padded(self) -> int:
        return self.books.shape[0] * self.books.shape[3]

    @property
    def levels(self) -> int:
        return self.books.shape[2]

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return np.ldexp(x, -self.exponent)

    def assign(self, x: np.ndarray) -> np.ndarray:
        return np.argmax(x @ self.centroids.T - 0.5 * (self.centroids**2).sum(axis=1), axis=1)

    def groups(self, x: np.ndarray) -> np.ndarray:
        wide = np.zeros((len(x), self.padded), x.dtype)
        wide[:, : x.shape[1]] = x
        return wide.reshape(len(x), len(self.books), -1)

    def encode(self, x: np.ndarray, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each row's code, a row of bytes: codes by level and group, then the levels' lengths; and what they leave over."""
        rest = x.astype(np.float64) - self.centroids[lists]
        codes = np.empty((len(x), self.levels, len(self.books)), np.uint8)
        lengths = np.empty((len(x), self.levels), np.float32)
        for level in range(self.levels):
            lengths[:, level], direction = _direction(rest)
            parts = self.groups(direction)
            near = np.empty_like(parts)
            for j, book in enumerate(self.books[:, :, level]):
                codes[:, level, j] = np.argmax(parts[:, j] @ book.T - 0.5 * (book**2).sum(axis=1), axis=1)
                near[:, j] = book[codes[:, level, j]]
            rest = rest - lengths[:, level, None].astype(np.float64) * near.reshape(len(x), self.padded)[:, : x.shape[1]]
        return np.concatenate([codes.reshape(len(x), -1), lengths.view(np.uint8).reshape(len(x), -1)], axis=1), rest

    def rough(self, queries: np.ndarray, lists: np.ndarray, coded: np.ndarray) -> np.ndarray:
        """Products of scaled queries with rows as their lists and codes give them, the same for the same row in any company."""
        queries = queries.astype(np.float32 if self.levels == 1 else np.float64)
        n = self.levels * len(self.books)
        codes, lengths = coded[:, :n], np.ascontiguousarray(coded[:, n:]).view(np.float32)
        used, at = np.unique(lists, return_inverse=True)
        out = np.einsum("qd,ld->ql", queries, self.centroids[used])[:, at]
        parts = self.groups(queries)
        for level in range(self.levels):
            tables = np.einsum("qjd,jcd->qjc", parts, self.books[:, :, level])
            total = np.zeros_like(out)
            for j in range(len(self.books)):
                total += tables[:, j][:, codes[:, level * len(self.books) + j]]
            out += total * lengths[None, :, level]
        return out


def _direction(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and directions of rows; zero rows have no direction."""
    length = np.sqrt((x**2).sum(axis=1)).astype(np.float32)
    return length, (x / np.where(length > 0, length, 1)[:, None]).astype(np.float32)


def _evened(x: np.ndarray) -> np.ndarray:
    """Queries times a power of two each, such that the largest component is near 1: their rows keep their order."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=0))[1][:, None])


def _means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        label = np.argmax(x @ centres.T - 0.5 * (centres**2).sum(axis=1), axis=1)
        count = np.bincount(label, minlength=k)
        order = np.argsort(label, kind="stable")
        filled = np.flatnonzero(count)
        starts = (np.cumsum(count) - count)[filled]
        centres[filled] = np.add.reduceat(x[order], starts, dtype=np.float64) / count[filled, None]
    return centres


def train(sample: np.ndarray, rows: int, seed: int = 7, exponent: int = 0) -> Index:
    """``rows``: the number of rows that will be indexed.  All lists are visited until ``fit_visits`` has seen the rows."""
    rng = np.random.default_rng(seed)
    x = np.ldexp(sample, -exponent).astype(np.float32)
    lists = int(np.clip(round(LISTS * rows**0.5), 1, min(MAX_LISTS, max(1, len(x) // ROWS_A_LIST))))
    centroids = np.unique(_means(x, lists, rng, 10), axis=0)  # equal rows, whose centre is the row itself, share a list
    bare = Index(centroids, np.zeros((-(-x.shape[1] // GROUP), CODES, 0, GROUP), np.float32), len(centroids), exponent)
    return deepened(bare, sample, 1, rng)


def deepened(index: Index, sample: np.ndarray, levels: int, rng: np.random.Generator) -> Index:
    """The index with further levels of codebooks, for what its own leave over."""
    x = index.scaled(sample)
    lists = index.assign(x.astype(np.float32))
    while index.levels < levels:
        parts = index.groups(_direction(index.encode(x, lists)[1])[1])
        books = np.stack([_means(parts[:, j], CODES, rng, 6) for j in range(len(index.books))])
        index = replace(index, books=np.concatenate([index.books, books[:, :, None]], axis=2))
    return index


def _usable(vector: Column) -> Column:
    v = vector.cast("array<double>")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return v.isNotNull() & F.forall(v, finite) & F.exists(v, lambda x: x != 0)


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def usable_vectors(rows: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """id and vector of the rows that take part."""
    found = rows.select(F.col(f"`{id_column}`").cast("long").alias("id"), F.col(f"`{vector_column}`").cast("array<double>").alias("vector"))
    found = found.filter(F.col("id").isNotNull() & _usable(F.col("vector"))).groupBy("id").agg(F.min("vector").alias("vector"))
    common = found.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return found.filter(F.size("vector") == (common["n"] if common else 0))


def build(vectors: DataFrame, k: int, queries: DataFrame | None = None) -> tuple[Index | None, DataFrame]:
    """A trained index, and list, id, codes and vector of every row.

    ``queries`` (id, vector): what will be asked, from which the probes are drawn; else they are rows.
    """
    size = F.greatest(F.abs(F.array_max("vector")), F.abs(F.array_min("vector")))
    shape = vectors.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("d"), F.max(size).alias("most")).first()
    schema = "list int, id long, codes binary, vector array<double>"
    if not shape["n"]:
        return None, vectors.sparkSession.createDataFrame([], schema)
    sample = _drawn(vectors, shape["n"], min(SAMPLE_ROWS, max(1, SAMPLE_VALUES // shape["d"])))
    x = _matrix(sample.column("vector"))
    index = train(x, shape["n"], exponent=int(np.frexp(shape["most"])[1]))

    def indexed(index: Index) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    x = index.scaled(_matrix(batch.column(1)))
                    lists = index.assign(x.astype(np.float32))
                    codes = [row.tobytes() for row in index.encode(x, lists)[0]]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(lists, pa.int32()), batch.column(0), pa.array(codes, pa.binary()), batch.column(1)],
                        ["list", "id", "codes", "vector"],
                    )

        return materialise(vectors.select("id", "vector").mapInArrow(run, schema), "index")

    rows = indexed(index)
    asked = queries.count() if queries is not None else 0
    if asked:
        drawn = _drawn(queries, asked, PROBES)
    else:
        drawn = sample.take(np.random.default_rng(1).choice(len(x), min(PROBES, len(x)), replace=False))
    ids, probes = drawn.column("id").to_numpy(), _evened(_matrix(drawn.column("vector")))
    near = nearest_of_probes(index, rows, ids, probes, k)
    if not near.num_rows:
        return index, rows
    index = fit_visits(index, probes, near)
    tried = []
    for levels in LEVELS:
        if levels > index.levels:
            index = deepened(index, x, levels, np.random.default_rng(levels))
            rows = indexed(index)
        tried.append((replace(index, rerank=fit_rerank(index, rows, ids, probes, near)), rows))
        if tried[-1][0].rerank <= max(MOST_RERANK * k, LEAST_RERANK):
            return tried[-1]
    least = min(index.rerank for index, _ in tried)
    return next(t for t in tried if t[0].rerank <= 1.5 * least)  # fewer levels, if more of them don't tell rows apart


def _drawn(rows: DataFrame, n: int, wanted: int) -> pa.Table:
    """About ``wanted`` of the ``n`` rows by a hash of their ids, the same ones in any layout."""
    found = rows.filter(F.pmod(F.xxhash64("id"), F.lit(n)) < wanted).select("id", "vector").toArrow()
    if not found.num_rows:
        found = rows.select("id", "vector").limit(wanted).toArrow()
    return found.sort_by("id")


def nearest_of_probes(index: Index, rows: DataFrame, ids: np.ndarray, probes: np.ndarray, k: int) -> pa.Table:
    """probe, id and vector of the k rows nearest to each probe (scaled queries and their ids), by brute force; at most probes times k."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = np.full((len(ids), 0), -np.inf)
        names = np.zeros((len(ids), 0), np.int64)
        for batch in batches:
            if batch.num_rows:
                # products of equal rows must be equal, so no product of matrices
                found = np.einsum("qd,nd->qn", probes, index.scaled(_matrix(batch.column(1))))
                own = batch.column(0).to_numpy()
                found[ids[:, None] == own[None, :]] = -np.inf
                score = np.concatenate([score, found], axis=1)
                names = np.concatenate([names, np.broadcast_to(own, found.shape)], axis=1)
                best = np.lexsort((names, -score), axis=1)[:, :k]
                score, names = np.take_along_axis(score, best, axis=1), np.take_along_axis(names, best, axis=1)
        kept = np.isfinite(score)
        yield pa.RecordBatch.from_arrays([pa.array(np.nonzero(kept)[0].astype(np.int32)), pa.array(score[kept]), pa.array(names[kept])], ["probe", "score", "id"])

    order = Window.partitionBy("probe").orderBy(F.desc("score"), "id")
    near = rows.select("id", "vector").mapInArrow(run, "probe int, score double, id long")
    near = near.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k).select("probe", "id")
    return near.join(rows.select("id", "vector"), "id").select("probe", "id", "vector").toArrow().sort_by([("probe", "ascending"), ("id", "ascending")])


def _order(index: Index, queries: np.ndarray) -> np.ndarray:
    """All lists of each scaled query, the most promising first."""
    return np.argsort(-(queries.astype(np.float32) @ index.centroids.T), axis=1, kind="stable")


def fit_visits(index: Index, probes: np.ndarray, near: pa.Table) -> Index:
    """The index with the fewest visits that reach the wanted share of the rows nearest to each of the probes."""
    rank = np.argsort(_order(index, probes), axis=1)
    lists = index.assign(index.scaled(_matrix(near.column("vector"))).astype(np.float32))
    at = np.sort(rank[near.column("probe").to_numpy(), lists])
    return replace(index, visits=int(at[int(np.ceil(COVERAGE * len(at))) - 1]) + 1)


def fit_rerank(index: Index, rows: DataFrame, ids: np.ndarray, probes: np.ndarray, near: pa.Table) -> int:
    """How many rows of a probe, by the codes, hold the wanted share of the rows nearest to it."""
    visited = np.argsort(_order(index, probes), axis=1) < index.visits
    x = index.scaled(_matrix(near.column("vector")))
    lists = index.assign(x.astype(np.float32))
    coded = index.encode(x, lists)[0]
    probe, names = near.column("probe").to_numpy(), near.column("id").to_numpy()
    level = np.array([index.rough(probes[p][None], lists[i : i + 1], coded[i : i + 1])[0, 0] for i, p in enumerate(probe)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ahead = np.zeros(len(probe), np.int64)
        for batch in batches:
            if batch.num_rows:
                own, held, codes = batch.column(0).to_numpy(), batch.column(1).to_numpy(), _bytes(batch.column(2))
                for low in range(0, len(ids), TABLES):
                    rough = index.rough(probes[low : low + TABLES], held, codes)
                    rough[~visited[low : low + TABLES][:, held] | (own[None, :] == ids[low : low + TABLES, None])] = -np.inf
                    for i in np.flatnonzero((probe >= low) & (probe < low + TABLES)):
                        scores = rough[probe[i] - low]
                        ahead[i] += np.count_nonzero(scores > level[i]) + np.count_nonzero(own[scores == level[i]] < names[i])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(ahead))), pa.array(ahead)], ["i", "ahead"])

    counted = rows.select("id", "list", "codes").mapInArrow(run, "i long, ahead long").groupBy("i").agg(F.sum("ahead").alias("ahead")).toArrow()
    ahead = np.full(len(probe), np.iinfo(np.int64).max)
    ahead[counted.column("i").to_numpy()] = counted.column("ahead").to_numpy()
    ahead[~visited[probe, lists]] = np.iinfo(np.int64).max
    return int(np.sort(ahead)[int(np.ceil(FOUND * len(ahead))) - 1]) + 1


def _bytes(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Codes of equal length as a row of bytes each."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def _best(scores: np.ndarray, n: int) -> np.ndarray:
    """Positions of the n largest scores, of equal ones the first, in ascending order of position."""
    if len(scores) <= n:
        return np.arange(len(scores))
    limit = np.partition(scores, len(scores) - n)[len(scores) - n]
    above, equal = np.flatnonzero(scores > limit), np.flatnonzero(scores == limit)
    return np.sort(np.concatenate([above, equal[: n - len(above)]]))


def search(queries: DataFrame, index: Index | None, rows: DataFrame, k: int, rerank: int | None = None) -> DataFrame:
    """query_id, rank from 1, id and score of the k nearest rows found for each query (id, vector), of which ``rerank`` are ranked exactly."""
    if index is None:
        return queries.sparkSession.createDataFrame([], "query_id long, rank int, id long, score double")
    routed = materialise(_routed(queries, index), "routed")
    order = Window.partitionBy("query_id").orderBy(F.desc("rough"), "id")
    wanted = max(RERANK * k, LEAST_RERANK, index.rerank) if rerank is None else max(rerank, k)
    near = _rough(routed, index, rows, wanted).withColumn("n", F.row_number().over(order)).filter(F.col("n") <= wanted).select("query_id", "id")
    pairs = near.join(rows.select("id", "vector"), "id").join(routed.select(F.col("id").alias("query_id"), F.col("vector").alias("query")), "query_id")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                products = (_matrix(batch.column(2)) * _matrix(batch.column(3))).sum(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(products)], ["query_id", "id", "score"])

    exact = pairs.select("query_id", "id", "vector", "query").mapInArrow(score, "query_id long, id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return exact.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def _routed(queries: DataFrame, index: Index) -> DataFrame:
    """Queries with the lists that they visit."""

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = _order(index, _evened(_matrix(batch.column(1))))[:, : index.visits]
                at = np.arange(0, near.size + 1, near.shape[1], dtype=np.int32)
                lists = pa.ListArray.from_arrays(at, pa.array(near.ravel().astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*batch.columns, lists], ["id", "vector", "lists"])

    return queries.mapInArrow(route, "id long, vector array<double>, lists array<int>")


def _rough(routed: DataFrame, index: Index, rows: DataFrame, wanted: int) -> DataFrame:
    """query_id, id and rough product of the best ``wanted`` rows of each block of the lists that a query visits."""
    together = max(1, min(QUERIES, PAIRS // min(wanted, BLOCK)))
    asked = routed.select(F.explode("lists").alias("list")).groupBy("list").agg(F.ceil(F.count("*") / together).cast("int").alias("parts"))
    held = rows.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    cut = F.broadcast(materialise(held.join(asked, "list"), "lists"))  # a row a list, whose number is bounded
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    sent = (
        routed.select(F.col("id").alias("query_id"), F.col("vector").alias("query"), F.explode("lists").alias("list"))
        .join(cut, "list")
        .select("list", upto("blocks").alias("block"), F.pmod(F.xxhash64("query_id"), F.col("parts")).cast("int").alias("part"), "query_id", "query")
    )
    held = rows.join(cut, "list").select("list", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"), upto("parts").alias("part"), "id", "codes")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        if left.num_rows and right.num_rows:
            right = right.sort_by("id")
            ids = right.column("id").to_numpy()
            codes, lists = _bytes(right.column("codes")), right.column("list").to_numpy()
            names, queries = left.column("query_id").to_numpy(), _evened(_matrix(left.column("query")))
            for low in range(0, len(names), TABLES):
                rough = index.rough(queries[low : low + TABLES], lists, codes)
                for name, scores in zip(names[low : low + TABLES], rough, strict=True):
                    at = _best(np.where(ids == name, -np.inf, scores), wanted)
                    at = at[ids[at] != name]
                    out.append((np.full(len(at), name), ids[at], scores[at]))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
        return pa.table({"query_id": columns[0], "id": columns[1], "rough": columns[2].astype(np.float64)})

    keys = ("list", "block", "part")
    return sent.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInArrow(meet, "query_id long, id long, rough double")


def nearest(rows: DataFrame, queries: DataFrame, k: int, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """The k nearest of ``rows`` for each of ``queries``, both with an id and a vector column."""
    vectors = usable_vectors(rows, id_column, vector_column)
    asked = queries.select(F.col(f"`{id_column}`").cast("long").alias("id"), F.col(f"`{vector_column}`").cast("array<double>").alias("vector"))
    asked = asked.filter(F.col("id").isNotNull() & _usable(F.col("vector"))).groupBy("id").agg(F.min("vector").alias("vector"))
    shape = vectors.select(F.size("vector").alias("d")).first()
    asked = asked.filter(F.size("vector") == (shape["d"] if shape else 0))
    index, indexed = build(vectors, k, asked)
    return search(asked, index, indexed, k).withColumnRenamed("id", id_column)
