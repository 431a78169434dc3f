"""Operators against plain computations, and the queries with SQL against DuckDB."""

import itertools
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict
from dataclasses import replace

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from arbograph.llm import ann, bagminhash, mixing, packing, registry, token_counts
from tests.test_queries import SF, compare, duck  # noqa: F401


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, duck, name):  # noqa: F811
    compare(spark, duck, registry.QUERIES[name], registry.ORACLES[name])


# packing

TOKENS = public_tokenizers.path("word_bpe_49k.json")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=5))
def test_ids_are_the_library_s(texts):
    own, library = packing.loaded(open(TOKENS).read()), Tokenizer.from_file(TOKENS)
    ids, counts = own.encode(pa.array(texts, pa.string()))
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts))[:-1]] == [library.encode(t, add_special_tokens=False).ids for t in texts]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=60))
def test_bins_hold_every_piece_once_and_fit(lengths):
    bins = packing.best_two_fit(lengths, 50)
    assert sorted(itertools.chain(*bins)) == list(range(len(lengths)))
    assert all(sum(lengths[k] for k in b) <= 50 for b in bins)
    half = sum(1 for b in bins if 2 * sum(lengths[k] for k in b) < 50)
    assert half <= 1


def test_two_smaller_pieces_replace_one():
    # greedy takes 6 and 3 and leaves a gap of 1; 2 and 2 fill it
    assert sorted(sorted((6, 3, 2, 2)[k] for k in b) for b in packing.best_two_fit([6, 3, 2, 2], 10)) == [[2, 2, 6], [3]]


def test_pieces_give_back_the_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = packing.pack_documents(docs, TOKENS, shard_rows=64).collect()
    library = Tokenizer.from_file(TOKENS)
    ids = {r.doc_id: [*library.encode(r.text, add_special_tokens=False).ids, 0] for r in docs.collect()}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert by_doc.keys() == ids.keys()
    for doc, parts in by_doc.items():
        parts.sort(key=lambda r: r.piece)
        assert [(r.piece, r.start) for r in parts] == [(k, 2048 * k) for k in range(len(parts))]
        assert sum(r.length for r in parts) == len(ids[doc]) and all(r.length == 2048 for r in parts[:-1])
        for r in parts:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[doc][r.start : r.start + r.length], "<u4").tobytes())
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    total = sum(map(len, ids.values()))
    assert len(by_sequence) <= 1.02 * total / 2048 + 2 * (len(rows) / 64 + 1)


def test_sequences_follow_the_order_of_the_files(spark, tmp_path):
    # long rows in later files, which scans read first
    rows = [(k, "ab " * (20 + 3 * k), "s") for k in range(400)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1).sortWithinPartitions("doc_id").write.option("maxRecordsPerFile", 37).parquet(f"{tmp_path}/a")
    stored = spark.read.parquet(f"{tmp_path}/a")
    for docs in (stored, stored.filter("doc_id >= 0").orderBy("doc_id")):
        assert [r._place for r in packing.placed(docs).orderBy("doc_id").collect()] == list(range(400))
    few = packing.placed(stored.filter("doc_id % 3 = 0")).collect()
    assert sorted(r._place for r in few) == list(range(134))
    found = packing.pack_documents(stored, TOKENS, shard_rows=50).orderBy("sequence_id").collect()
    assert [r.doc_id // 50 for r in found] == sorted(r.doc_id // 50 for r in found)
    own = packing.pack_documents(stored, TOKENS, capacity=64, shard_rows=50).collect()
    whole = {r.sequence_id for r in own if r.length == 64}
    assert len(whole) == sum(r.length == 64 for r in own) and not whole & {r.sequence_id for r in own if r.length < 64}


def test_sequences_keep_the_mixture(spark, tmp_path):
    """Shares among the first sequences are those of the mixture, up to one shard, with a hot source."""
    rows = [(k, "some words of one length here " * 40, "hot" if k < 3000 else "abc"[k % 3]) for k in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    how = {"weights": {"hot": 0.4, "a": 0.3, "b": 0.2, "c": 0.1}, "block_chars": 1200, "partitions": 7}
    mixing.in_order(docs, **how).write.parquet(f"{tmp_path}/mixed")
    found = packing.pack_documents(spark.read.parquet(f"{tmp_path}/mixed"), TOKENS, shard_rows=50).orderBy("sequence_id", "offset").collect()
    source = {k: s for k, _, s in rows}
    for shards in (2, 6, 12):
        first = [source[r.doc_id] for r in found[: 50 * shards]]
        for name, weight in how["weights"].items():
            assert abs(first.count(name) - weight * len(first)) <= 1, (shards, name)


# token counts

def count_alone(scores, word):
    node = token_counts.MARK + word
    best, count = [0.0], [0]
    for end in range(1, len(node) + 1):
        size = len(node[end - 1].encode())
        options = [(-(best[end - 1] + token_counts.BYTE_SCORE * size), count[end - 1] + size)]
        options += [(-(best[s] + scores[node[s:end]]), count[s] + 1) for s in range(end) if node[s:end] in scores]
        top = min(options)
        best.append(-top[0])
        count.append(top[1])
    return count[-1]


def test_shared_prefixes_give_the_counts_of_single_words(spark):
    trie = token_counts.UnigramTrie(token_counts.vocabulary(public_tokenizers.path("piece_bpe_32k.model")))
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(40).collect()] + ["漢字 é\U0001f600 " + "x" * 500]
    words = sorted({w for t in texts for w in t.split()})
    assert dict(trie.walk(words)) == {w: count_alone(trie.scores, w) for w in words}
    assert trie.count(["a b a", ""]) == [(3, 2 * dict(trie.walk(["a"]))["a"] + dict(trie.walk(["b"]))["b"]), (0, 0)]


# near duplicates

def bags(texts):
    out = {}
    for k, t in texts.items():
        w = re.findall(r"\w+", (t or "").lower())
        out[k] = Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()
    return out


def classes(texts, threshold=0.8):
    b, parent = bags(texts), {k: k for k in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(sorted(texts), 2):
        both = sum((b[i] & b[j]).values())
        if both and both >= threshold * (sum(b[i].values()) + sum(b[j].values()) - both):
            low, high = sorted((find(i), find(j)))
            parent[high] = low
    return {k: find(k) for k in texts}


def copies(seed=5):
    """Groups of near copies in chains, texts with repeated parts, short ones and strangers."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    texts = []
    for _ in range(12):
        base = [word() for _ in range(rng.choice((8, 60, 150)))] * rng.choice((1, 1, 3))
        for _ in range(rng.choice((1, 2, 30))):
            own = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 25))):
                own[rng.randrange(len(own))] = word()
            texts.append(" ".join(own))
            if rng.random() < 0.3:
                base = own
    texts += ["one two", "one two", "One, two!", "", None, " ", "three"]
    return dict(enumerate(rng.sample(texts, len(texts))))


@pytest.mark.parametrize("block", [1024, 7])
def test_classes_equal_all_pairs(spark, block, monkeypatch):
    texts = copies()
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    monkeypatch.setattr(bagminhash.links, "__defaults__", (0.8, block))
    found = {r.doc_id: r.class_id for r in bagminhash.near_duplicate_classes(docs).collect()}
    assert found == classes(texts)


def test_blocks_are_bounded_by_words(spark, monkeypatch):
    texts = copies(6)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    monkeypatch.setattr(bagminhash, "BLOCK_WORDS", 500)
    assert {r.doc_id: r.class_id for r in bagminhash.near_duplicate_classes(docs).collect()} == classes(texts)


def test_memory_of_a_block():
    rng = np.random.default_rng(4)
    words = np.array([f"w{k}" for k in range(5_000)])
    own = lambda: np.where(np.arange(200) == rng.integers(200), rng.choice(words, 200), base)
    base = rng.choice(words, 200)
    texts = [" ".join(own()) for _ in range(1024)]
    table = pa.table({"bucket": [1] * 1024, "block": pa.array([0] * 1024, pa.int32()), "doc_id": range(1024), "text": texts})
    run, _ = bagminhash._within_block(0.8)
    tracemalloc.start()
    found = run(table)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found.column("root").to_pylist() == [0] * 1024
    assert peak < 32e6, peak


def test_signatures_are_unbiased():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 2**63, 300, dtype=np.int64).astype(np.uint64)
    a, b = rng.integers(0, 9, 300), rng.integers(0, 9, 300)
    text = np.concatenate([np.zeros((a > 0).sum(), np.int64), np.ones((b > 0).sum(), np.int64)])
    s = bagminhash.signatures(text, np.concatenate([keys[a > 0], keys[b > 0]]), np.concatenate([a[a > 0], b[b > 0]]), 2, 20_000)
    assert abs((s[0] == s[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.015


def test_components_of_chains(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 99), (99, 100), (5, 5)], "doc_id long, other long")
    found = {r.node: r.root for r in bagminhash.components(edges).collect()}
    assert found == {**{k: 0 for k in range(1, 41)}, 100: 99}


# mixing

def given_slots(spark, weights, blocks):
    parts = mixing.quanta([w / sum(weights) for w in weights])
    assert sum(parts) == mixing.QUANTA and all(abs(p - mixing.QUANTA * w / sum(weights)) <= 1 for p, w in zip(parts, weights))
    sources = [mixing.Source(f"s{k}" if k else None, a, n) for k, (a, n) in enumerate(zip(parts, blocks))]
    return sources, mixing.slots(spark, sources).collect()


@pytest.mark.parametrize("weights, window", [([1, 7, 3, 90, 2], 64), ([1 / 3, 1 / 3, 1 / 3], 8), ([0.7, 0.29, 0.01], 256), ([1], 2), ([0.61, 0.17, 0.13, 0.05, 0.04], 64), ([5, 5, 5, 5, 1, 1, 1, 1, 1], 8)])
def test_every_source_stays_within_a_block_of_its_share(spark, weights, window, monkeypatch):
    """At every slot of many windows, with no slot empty and every block at its turn."""
    monkeypatch.setattr(mixing, "WINDOW", window)
    monkeypatch.setattr(mixing, "STEP", min(window, 16))
    total = sum(weights)
    blocks = [max(1, round(2_000 * w / total)) for w in weights]
    sources, rows = given_slots(spark, weights, blocks)
    slot = {(r._source, r.block): r.slot for r in rows}
    assert len(slot) == len(rows) == sum(blocks) and len(set(slot.values())) == len(rows)
    for source, n in zip(sources, blocks):
        own = [slot[source.name, k] for k in range(n)]
        assert own == sorted(own)
        for k, t in enumerate(own):
            # block k may not run before its time and must have run by its deadline
            assert k * mixing.QUANTA // source.quanta <= t < -(-(k + 1) * mixing.QUANTA // source.quanta), (source, k, t)
    first = min(n * total / w for n, w in zip(blocks, weights))
    assert set(range(int(first) - 2)) <= set(slot.values())


def edf_in_one_run(parts, slots):
    """Earliest deadline first over all slots, one by one."""
    done, out = [0] * len(parts), []
    for t in range(slots):
        ready = [(-(-(n + 1) * mixing.QUANTA // a), i) for i, (n, a) in enumerate(zip(done, parts)) if n * mixing.QUANTA // a <= t]
        deadline, i = min(ready)
        assert deadline > t
        out.append(i)
        done[i] += 1
    return out


def test_the_first_window_is_that_of_one_run_but_for_its_end(spark):
    weights = [0.41, 0.3, 0.17, 0.1, 0.02]
    sources, rows = given_slots(spark, weights, [420, 310, 180, 110, 25])
    got = [r._source for r in sorted(rows, key=lambda r: r.slot)][:900]
    assert got == [sources[i].name for i in edf_in_one_run([x.quanta for x in sources], 900)]


@pytest.mark.parametrize("weights", [{"a": 0.70049, "b": 0.29851, "c": 0.001}, {"a": 0.5004, "b": 0.4996, "d": 0.0}])
def test_sources_stay_within_a_block_of_given_weights_over_many_periods(spark, weights):
    docs = spark.range(12_000).selectExpr("id as doc_id", "repeat('x', 10) as text", "case when id % 1200 = 0 then 'c' when id % 1200 = 1 then 'd' when id % 10 < 7 then 'a' else 'b' end as source")
    rows = mixing.schedule(docs, weights=weights, block_chars=10).collect()
    assert len(rows) == 12_000
    total, last = sum(weights.values()), max(r.slot for r in rows if weights.get(r.source))
    own = defaultdict(list)
    for r in rows:
        own[r.source].append(r.slot)
    assert len({r.slot for r in rows if weights.get(r.source)}) == sum(len(own[s]) for s in own if weights.get(s))
    for name, slots in own.items():
        w = weights.get(name, 0) / total
        for k, slot in enumerate(sorted(slots)):
            if w:
                assert abs(k - w * slot) < 1 + 1e-5 and abs(k + 1 - w * (slot + 1)) < 1 + 1e-5, (name, k, slot)
            else:
                assert slot > last


def test_hundreds_of_small_sources_leave_a_hot_one_its_weight(spark):
    weights = [0.75, *[0.001] * 250]
    _, rows = given_slots(spark, weights, [1_500, *[2] * 250])
    assert len(rows) == 2_000 and {r.slot for r in rows} == set(range(2_000))
    assert sum(r._source is None for r in rows if r.slot < 40) == 30


def test_weights_too_small_and_sources_too_many_are_refused(spark, monkeypatch):
    docs = spark.createDataFrame([(k, "x" * 9, "ab"[k % 2]) for k in range(10)], "doc_id long, text string, source string")
    with pytest.raises(ValueError):
        mixing.schedule(docs, weights={"a": 1.0, "b": 1e-9})
    monkeypatch.setattr(mixing, "MAX_SOURCES", 1)
    with pytest.raises(ValueError):
        mixing.schedule(docs)


def test_sources_without_any_text_and_without_weight(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, None, None)], "doc_id long, text string, source string")
    assert sorted(r.slot for r in mixing.schedule(docs).collect()) == [0, 1, 2]
    assert sorted(r.slot for r in mixing.schedule(docs, weights={"c": 1.0}).collect()) == [0, 1, 2]
    found = {r.source: r.slot for r in mixing.schedule(docs, weights={"a": 1.0}).collect()}
    assert found["a"] == 0 and found["b"] == found[None] == mixing.WINDOW


def test_order_of_the_mixture_keeps_all_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    mixed = mixing.in_order(docs, 4)
    assert sorted(mixed.collect()) == sorted(docs.collect())
    slot = {r.doc_id: r.slot for r in mixing.schedule(docs).collect()}
    order = [slot[r.doc_id] for r in mixed.withColumn("p", F.spark_partition_id()).collect()]
    assert order == sorted(order)


def test_given_weights_rule(spark):
    docs = spark.createDataFrame([(k, "x" * 100, "ab"[k % 2]) for k in range(400)], "doc_id long, text string, source string")
    rows = mixing.schedule(docs, weights={"a": 3.0, "b": 1.0}, block_chars=100).collect()
    first = sorted(rows, key=lambda r: r.slot)[:100]
    assert sum(r.source == "a" for r in first) == 75


# neighbours

@pytest.mark.parametrize("n, hot", [(300, 0), (6000, 0), (6000, 2000)])
def test_recall(spark, n, hot):
    rng = np.random.default_rng(n + hot)
    x = rng.normal(size=(n, 32)).astype(np.float32)
    x[:hot] = x[0]
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>")
    found = defaultdict(list)
    for r in ann.nearest(df, df.filter("vec_id % 50 = 0"), 20).orderBy("query_id", "rank").collect():
        found[r.query_id].append((r.vec_id, r.score))
    hits = wanted = 0
    exact = x.astype(float)
    for q in range(0, n, 50):
        s = (exact * exact[q]).sum(axis=1)
        s[q] = -np.inf
        best = np.lexsort((np.arange(n), -s))[:20]
        hits += len({k for k, _ in found[q]} & set(best.tolist()))
        wanted += 20
        assert found[q] == sorted(found[q], key=lambda r: (-r[1], r[0])) and all(abs(s[k] - v) < 1e-9 for k, v in found[q])
    assert hits >= 0.95 * wanted


@pytest.mark.parametrize("kind", ["tight", "large", "small", "elsewhere"])
def test_recall_on_other_rows(spark, kind):
    rng = np.random.default_rng(8)
    n, d = (6000, 64) if kind == "tight" else (3000, 32)
    x = rng.normal(size=(n, d))
    asked = np.arange(0, n, 20)
    if kind == "tight":  # a cluster's rows differ by less than what one level of codes leaves over
        x = rng.normal(size=(10, d))[rng.integers(0, 10, n)] + 1e-4 * x
        x /= np.linalg.norm(x, axis=1, keepdims=True)
    elif kind == "large":  # squares beyond single precision
        x = 1e25 * x
    elif kind == "small":
        x = 1e-30 * x
    else:  # queries that aren't like the rows
        x = rng.normal(size=(8, d))[rng.integers(0, 8, n)] + 0.3 * x
        x[asked] = rng.normal(size=(len(asked), d))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = defaultdict(set)
    for r in ann.nearest(df, df.filter("vec_id % 20 = 0"), 20).collect():
        found[r.query_id].add(r.vec_id)
    hits = 0
    for q in asked:
        s = (x * x[q]).sum(axis=1)
        s[q] = -np.inf
        hits += len(found[int(q)] & set(np.lexsort((np.arange(n), -s))[:20].tolist()))
    assert hits >= 0.9 * 20 * len(asked), hits / (20 * len(asked))


def test_clustered_vectors_need_few_visits(spark):
    rng = np.random.default_rng(5)
    n = 50_000
    x = rng.normal(size=(300, 32))[rng.integers(0, 300, n)] + 0.35 * rng.normal(size=(n, 32))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    table = pa.table({"vec_id": np.arange(n), "embedding": pa.ListArray.from_arrays(np.arange(0, 32 * n + 1, 32, dtype=np.int32), pa.array(x.ravel()))})
    df = spark.createDataFrame(table)
    index, rows = ann.build(ann.usable_vectors(df, "vec_id", "embedding"), 20)
    sizes = {r["list"]: r["count"] for r in rows.groupBy("list").count().collect()}
    asked = np.arange(0, n, 500)
    order = np.argsort(-(x[asked] @ index.centroids.T), axis=1)[:, : index.visits]
    visited = sum(sizes.get(int(v), 0) for v in order.ravel()) / (len(asked) * n)
    best = {}
    for q in asked:
        s = x.astype(float) @ x[q].astype(float)
        s[q] = -np.inf
        best[int(q)] = set(np.lexsort((np.arange(n), -s))[:20].tolist())

    def recall(with_index, rerank=None):
        found = defaultdict(set)
        for r in ann.search(df.filter("vec_id % 500 = 0").selectExpr("vec_id as id", "cast(embedding as array<double>) as vector"), with_index, rows, 20, rerank).collect():
            found[r.query_id].add(r.id)
        return sum(len(found[q] & b) for q, b in best.items()) / (20 * len(best))

    assert recall(index) >= 0.9  # 80 of 50,000 rows are reranked for each query
    assert visited <= 0.25, visited
    # what is reranked is chosen by the codes: without residuals, or with those of other codes, near rows are lost
    assert recall(replace(index, books=np.zeros_like(index.books))) < 0.7
    assert recall(replace(index, books=index.books[:, ::-1])) < 0.7
    # and so they are if nothing but the codes ranks them
    assert recall(index, 20) < recall(index)


def test_repeated_ids_give_one_result_in_any_layout(spark):
    rng = np.random.default_rng(3)
    rows = [(k, v.tolist()) for k, v in enumerate(rng.normal(size=(200, 8)))]
    rows += [(k, rng.normal(size=8).tolist()) for k in (0, 0, 20, 21, 22)] + [rows[40], rows[41]]
    run = lambda r, n: sorted(map(tuple, ann.nearest(spark.createDataFrame(r, "vec_id long, embedding array<double>").repartition(n), spark.createDataFrame(r, "vec_id long, embedding array<double>").filter("vec_id % 20 = 0").repartition(n), 5).collect()))
    first = run(rows, 1)
    assert run(rows[::-1], 3) == first and run(rows[100:] + rows[:100], 2) == first
    kept = {}
    for k, v in rows:
        kept[k] = min(v, kept.get(k, v))
    for q in (0, 20, 40):
        scores = sorted((-float(np.dot(kept[q], v)), k) for k, v in kept.items() if k != q)[:5]
        assert [r[2] for r in first if r[0] == q] == [k for _, k in scores]


def test_groups_of_queries_and_blocks_change_nothing(spark, monkeypatch):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(900, 8))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    run = lambda: sorted(map(tuple, ann.nearest(df, df, 5).collect()))
    whole = run()
    monkeypatch.setattr(ann, "BLOCK", 37)
    monkeypatch.setattr(ann, "QUERIES", 23)
    assert run() == whole


# the pipeline

def test_pipeline_on_the_smallest_tables(spark):
    kept = corpus_pipeline.run(spark, SF)
    docs = {r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    found = kept.collect()
    assert found and {r.doc_id for r in found} < docs
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    bad = {r.doc_id for r in labels if r.quality == 0}
    assert not bad & {r.doc_id for r in found}
