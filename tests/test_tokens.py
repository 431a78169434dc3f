"""Counts and cuts by a tokenizer's file against the library, one text at a time."""

import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from arbograph.functions import tokens
from arbograph.operators import structure, summaries

FILES = ["byte_bpe_50k.json", "word_bpe_49k.json"]
TEXTS = ["", None, "one", "Straße  漢字 \U0001f600 naïve\n\nabc", "word " * 3000, "x" * 5000, "<|endoftext|> a", "  ", "e\u0301" * 40]


def texts():
    rng = random.Random(2)
    return TEXTS + ["".join(rng.choices(["the ", "cat", "ing ", "é", "漢", " ", "\n", "zzz", "1234"], k=rng.randint(1, 300))) for _ in range(40)]


@pytest.mark.parametrize("file", FILES)
def test_counts_and_cuts(spark, file):
    path = public_tokenizers.path(file)
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    size = lambda t: len(library.encode(t or "", add_special_tokens=False).ids)
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts())], "k int, t string")
    cut = tokens.token_cutter(spark, path, "|cut")
    for limit in (0, 1, 7, 60):
        for r in rows.select("t", tokens.token_counter(spark, path)(F.col("t")).alias("n"), cut(F.col("t"), limit).alias("c")).collect():
            assert r.n == size(r.t)
            if r.t is None or r.n <= limit:
                assert r.c == r.t
            else:
                assert r.c.endswith("|cut") and r.t.startswith(r.c[:-4]) and size(r.c[:-4]) <= limit


def test_operators_take_a_counter(spark):
    count = tokens.token_counter(spark, public_tokenizers.path(FILES[0]))
    library = Tokenizer.from_file(public_tokenizers.path(FILES[0]))
    docs = spark.createDataFrame([(1, "one two three\nfour\n")], "doc_id long, text string")
    assert [r.tokens for r in structure.page_list(docs, count).orderBy("page_no").collect()] == [len(library.encode(t).ids) for t in ("one two three", "four", "")]
    nodes = spark.createDataFrame([(1, 1, None, 0, "a", "w " * 30), (1, 2, None, 0, "b", "w " * 300)], "doc_id long, ord int, parent_ord int, depth int, title string, text string")

    class Says:
        def chat(self, prompt):
            return "said"

    assert {r.ord: r.how for r in summaries.summarised(nodes, Says(), 100, count=count).collect()} == {1: "own", 2: "alone"}
