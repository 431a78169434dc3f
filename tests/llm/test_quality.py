"""Weak supervision: what expectation-maximisation finds, and what it does with single votes."""

import numpy as np
from pyspark.sql import functions as F

from arbograph.llm import quality


def drawn(spark, n, shares, rates, abstain=0.1, seed=3):
    """Vote vectors, with counts, of n texts of classes with known shares and rates."""
    rng = np.random.default_rng(seed)
    of = rng.choice(len(shares), n, p=shares)
    found = np.where(rng.random((n, len(rates))) < np.array(rates)[:, of].T, -1, 1)
    found = np.where(rng.random(found.shape) < abstain, 0, found)
    vectors, count = np.unique(found, axis=0, return_counts=True)
    rows = [(*map(int, v), int(k)) for v, k in zip(vectors, count, strict=True)]
    return spark.createDataFrame(rows, ", ".join(f"_r{k} int" for k in range(len(rates))) + ", count long")


def test_known_accuracies_are_recovered(spark):
    shares = [0.7, 0.2, 0.1]
    rates = [(0.04, 0.85, 0.10), (0.10, 0.90, 0.20), (0.02, 0.05, 0.75), (0.15, 0.30, 0.95), (0.05, 0.40, 0.06), (0.03, 0.02, 0.8)]
    kinds = ["a", "a", "b", "b", None, "b"]
    model = quality.fit_votes(drawn(spark, 60_000, shares, rates), [f"r{k}" for k in range(6)], kinds)
    assert model.good == 0
    assert np.allclose(model.shares, shares, atol=0.03)
    assert np.allclose(model.rates, rates, atol=0.06)


def test_the_good_class_is_the_one_condemned_least(spark):
    # four fifths of the corpus are bad in one way, against the start
    rates = [(0.03, 0.9), (0.05, 0.8), (0.02, 0.85)]
    model = quality.fit_votes(drawn(spark, 20_000, [0.2, 0.8], rates), ["r0", "r1", "r2"], ["a", "a", "a"])
    assert np.isclose(model.shares[model.good], 0.2, atol=0.03)
    assert quality.Model((0.2, 0.8), ((0.9, 0.1), (0.8, 0.1))).good == 1


def test_no_estimate_is_held_at_a_bound(spark):
    rates = [(0.0, 1.0), (0.0, 1.0), (0.3, 0.6)]
    model = quality.fit_votes(drawn(spark, 20_000, [0.5, 0.5], rates, abstain=0), ["r0", "r1", "r2"], ["a", "a", None])
    assert max(model.rates[0][0], 1 - model.rates[0][1]) < 1e-3
    assert np.allclose(model.rates[2], rates[2], atol=0.02)


def test_one_bad_vote_is_outvoted_and_two_of_a_kind_are_not(spark):
    rates = [(0.02, 0.9), (0.02, 0.9), (0.02, 0.3), (0.02, 0.3)]
    model = quality.fit_votes(drawn(spark, 40_000, [0.9, 0.1], rates, abstain=0), [f"r{k}" for k in range(4)], ["a", "a", None, None])
    cases = spark.createDataFrame([(-1, 1, 1, 1), (1, 1, -1, 1), (-1, -1, 1, 1), (0, 0, 0, 0)], "a int, b int, c int, d int")
    found = [r[0] for r in cases.select(quality.posterior(model, [F.col(x) for x in "abcd"])).collect()]
    assert found[0] > 0.5 and found[1] > 0.9 and found[2] < 0.1
    assert np.isclose(found[3], model.shares[0])


def test_a_text_with_a_bad_vote_stays(spark):
    prose = [" ".join(f"word{(i * 7 + k) % 997}{'.' if k % 12 == 11 else ''}" for k in range(150)) for i in range(200)]
    junk = [" ".join(f"#{i}{k} $%&" for k in range(120)) for i in range(20)]
    late = " ".join(f"other{k}" for k in range(140))  # no sentence ends, all else well
    docs = spark.createDataFrame([(t,) for t in [*prose, *junk, late]], "text string")
    kept = {r[0] for r in quality.keep_good(docs).collect()}
    assert late in kept and not kept & set(junk) and kept >= set(prose)


def test_no_texts(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, kept string, n_words string")
    assert quality.fit(quality.counts(docs)) == quality.start()
    assert quality.keep_good(docs).columns == docs.columns and quality.keep_good(docs).count() == 0
