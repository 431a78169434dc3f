"""Ranks against scores of all documents, one by one."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from arbograph.llm import ranking

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]


def expected(docs, items, top=10):
    held = [(d, Counter(terms(t))) for d, t in docs]
    held = [(d, c) for d, c in held if c]
    n, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scored = []
        for d, c in held:
            m = 100 - 90 + (90 * sum(c.values()) * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if c[t])
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        out += [(item, k, x[3], -x[0]) for k, x in enumerate(sorted(scored)[:top], 1)]
    return sorted(out, key=repr)


def found(spark, docs, items, **how):
    docs = spark.createDataFrame([(*d, "clash", 7) for d in docs], "doc_id long, text string, score string, n int")
    items = spark.createDataFrame([(*i, "clash") for i in items], "item_id long, text string, terms string")
    partitions = how.pop("partitions", 3)
    return sorted((tuple(r)[:4] for r in ranking.rank(docs.repartition(partitions), items, **how).collect()), key=repr)


def corpus(seed, n=400):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(300)] + ["Straße", "ÉTÉ", "été", "漢字", "can't", "a_b", "K", "ſ"]
    odds = [1 / (k + 1) for k in range(len(words))]
    docs = [(k, " ".join(rng.choices(words, odds, k=rng.choice((0, 3, 30, 60, 400))))) for k in range(n)]
    docs += [(7, docs[7][1]), (n, docs[3][1].upper()), (None, docs[5][1]), (n + 1, None), (n + 2, "?! \x7f"), (n + 3, "w1 " * 30_000)]
    items = [(k, " ".join(rng.choices(words, k=12))) for k in range(20)] + [(30, None), (31, ""), (32, "nowhere"), (33, "w0"), (34, "w0 W0 w0"), (35, " ".join(words))]
    return rng.sample(docs, len(docs)), items


@pytest.mark.parametrize("seed", range(2))
def test_ranks_equal_those_of_all_scores(spark, seed):
    docs, items = corpus(seed)
    assert found(spark, docs, items) == expected(docs, items)


def test_small_shards_and_blocks_change_nothing(spark):
    docs, items = corpus(5)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
        assert found(spark, docs, items, block_terms=60, partitions=1) == expected(docs, items)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_blocks_hold_every_item_once_and_stay_small(spark):
    _, items = corpus(1)
    rows = ranking.item_terms(spark.createDataFrame(items, "item_id long, text string"))
    found = ranking.blocks(rows, 40).collect()
    assert sorted(r.item_id for r in found) == sorted(r.item_id for r in rows.collect())
    sizes = Counter()
    for r in found:
        sizes[r.block] += len(r.terms)
    assert len(sizes) > 4 and max(sizes.values()) <= 40 + max(len(r.terms) for r in found)


def test_ties_go_by_id_and_null_last(spark):
    docs = [(k, "same words") for k in range(30, 0, -1)] + [(None, "same words"), (-5, "same words"), (50, "others here")]
    assert found(spark, docs, [(1, "same")]) == expected(docs, [(1, "same")])
    few = [(None, "same"), (3, "same"), (9, "x")]
    assert [r[2] for r in sorted(found(spark, few, [(1, "same")]), key=lambda r: r[1])] == [3, None]


def test_empty_tables(spark):
    assert found(spark, [], [(1, "a")]) == [] and found(spark, [(1, "a")], []) == [] and found(spark, [(1, ""), (2, None)], [(1, "a")]) == []


@settings(max_examples=200, deadline=None)
@given(st.text(st.characters(codec="utf-8"), max_size=30))
def test_terms_are_the_pattern_s(text):
    assert [t.decode() for t in ranking.terms_of(text.encode())] == terms(text)


def test_limits_spare_postings():
    """With a limit, frequent terms are probed for few documents, and the result is that without one."""
    rng = np.random.default_rng(1)
    n, counts = 5_000, []
    for k in range(40):
        counts.append(np.flatnonzero(rng.random(n) < (0.9 if k < 20 else 0.01)))
    entries = sorted((d, k) for k, docs in enumerate(counts) for d in docs)
    ends = np.concatenate([[0], np.cumsum(np.bincount([d for d, _ in entries], minlength=n))])
    weights = np.array([ranking.weight(n, len(c)) for c in counts])
    shard = ranking.Shard(np.arange(n), rng.integers(50, 500, n), ends, np.array([k for _, k in entries]), rng.integers(1, 5, len(entries)), weights, n, n * 270)
    whole, scores = shard.best(np.arange(40), 0, n)
    order = np.lexsort((whole, -scores))[:10]
    all_probed, shard.probed = len(entries), 0
    some, least = shard.best(np.arange(40), int(scores[order[-1]]), 10)
    again = np.lexsort((some, -least))[:10]
    assert whole[order].tolist() == some[again].tolist() and scores[order].tolist() == least[again].tolist()
    assert shard.probed < all_probed / 20
