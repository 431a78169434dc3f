"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator and stage."""

import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from arbograph.llm import ann, bagminhash, chat, filter_audit, licenses, mixing, packing, quality, ranking, secrets, token_counts, toxicity, url_filter
from arbograph.llm.registry import URL_RULES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("aeiounrstl", k=rng.randint(2, 9)))
    return " ".join(f"{' '.join(word() for _ in range(8)).capitalize()}." for _ in range(30))


PROSE = prose(0)
ROWS = [
    (1, PROSE, "en", "a", 1), (2, None, None, None, None), (None, "some text without an id " * 20, "en", "a", 1), (3, "", "en", "b", 0),
    (4, PROSE, "en", None, 1), (5, "word " * 30_000, "en", "a", 1), (1, PROSE, "en", "a", 1), (6, " \n\t ", "en", "b", 3), (7, "é ß 漢字 \U0001f600 " * 40, "de", "b", 1),
    (8, PROSE + " idiot moron scum.", "en", "a", 1),
]
#: Names that operators use within.
CLASHING = ("length", "block", "slot", "_n", "_row", "list", "root", "class_id", "kept", "posterior", "n_words", "score", "strength", "sequence_id", "_slot", "_run", "key", "bucket")
TOKENS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(1, 1, 0), (8, 1, 1), (2, None, None), (None, 1, 1), (4, 0, 0), (8, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def operators(docs, labels):
    return {
        "toxicity": toxicity.score_documents(docs, labels),
        "quality": quality.judge(quality.counts(docs), quality.fit(quality.counts(docs))),
        "licenses": licenses.scan(docs),
        "packing": packing.pack_documents(docs, TOKENS),
        "token_counts": token_counts.count_tokens(docs, PIECES),
        "mixing": mixing.schedule(docs),
        "near_duplicates": bagminhash.near_duplicate_classes(docs),
        "secrets": secrets.report(secrets.find(docs)),
        "ranking": ranking.rank(docs, docs.select(F.col("doc_id").alias("item_id"), "text", *docs.columns[5:])),
        "filter_audit": filter_audit.audit(docs, labels),
    }


#: Operators with other rows than one a document.
OTHER_ROWS = ("packing", "ranking", "filter_audit")


def of_other_tables(spark, more=()):
    """Urls, chats and vectors, whose tables have further columns."""
    extra = lambda df: df.withColumns({c: F.lit("x") for c in more if c not in df.columns})
    pages = spark.createDataFrame([(1, "http://A.example.com/en/71"), (2, "x://b.net/de/8"), (2, "x://b.net/de/8"), (3, None), (None, "http://a.org/es/"), (4, ""), (5, "x://h/" + "p/" * 20_000)], "page_id long, url string")
    chats = spark.createDataFrame([(1, 0, "user", "hi"), (2, 0, "user", "hi"), (2, 1, "assistant", "yes"), (3, 0, None, None), (None, 0, "user", "x " * 50_000), (2, 1, "assistant", "yes")], "conv_id long, turn long, role string, text string")
    vectors = spark.createDataFrame([(0, [1.0, 0.0]), (20, [2.0, 1.0]), (3, [0.0, 1.0]), (4, None), (None, [1.0, 1.0]), (5, [0.0, 0.0])], "vec_id long, embedding array<double>")
    tables = {k: extra(v) for k, v in {"urls": pages, "chats": chats, "vectors": vectors}.items()}
    return tables, {
        "urls": lambda t: url_filter.judge(t, URL_RULES),
        "chats": chat.format_conversations,
        "vectors": lambda t: ann.nearest(t, t.filter("vec_id % 20 = 0"), 3),
    }


def stages(docs, labels, monkeypatch):
    monkeypatch.setattr(corpus_pipeline, "read_table", lambda *a: labels)
    return {name: f(docs.sparkSession, docs, "") for name, f in corpus_pipeline.STAGES}


def test_all_rows_are_judged(docs, labels):
    for name, df in operators(docs, labels).items():
        rows = df.collect()
        assert len({tuple(r) for r in rows}) > 1, name
        if name not in OTHER_ROWS:
            assert len(rows) == len(ROWS), name


def test_clashing_columns_change_nothing(spark, docs, labels):
    rows = lambda df, columns: sorted(map(repr, df.select(*columns).collect()))
    more = docs.withColumns({c: F.lit("x") for c in CLASHING})
    clashing = operators(more, labels.withColumns({c: F.lit("x") for c in CLASHING}))
    for name, df in operators(docs, labels).items():
        assert rows(df, df.columns) == rows(clashing[name], df.columns), name
    plain, calls = of_other_tables(spark)
    for name, table in of_other_tables(spark, (*CLASHING, "host", "path", "rule", "verdict", "rank", "id", "vector", "role_", "n_turns"))[0].items():
        df = calls[name](plain[name])
        assert rows(df, df.columns) == rows(calls[name](table), df.columns) != [], name


def test_stages_keep_the_columns(docs, labels, monkeypatch):
    more = docs.withColumns({c: F.lit("x") for c in CLASHING})
    for name, df in stages(more, labels, monkeypatch).items():
        if name != "best_fit_packing":
            assert df.columns == more.columns, name
        assert df.collect() is not None


def test_empty_tables(docs, labels, monkeypatch):
    none = docs.filter("false")
    for name, df in operators(none, labels.filter("false")).items():
        assert df.count() == 0, name
    for name, df in stages(none, labels.filter("false"), monkeypatch).items():
        assert df.count() == 0, name
    tables, calls = of_other_tables(docs.sparkSession)
    for name, table in tables.items():
        assert calls[name](table.filter("false")).count() == 0, name


def test_quality_counts(spark):
    rows = [("a b c a b c a b c",), ("x y\nx y\n\n  \nx y",), (None,), ("",), ("a b c d",), ("#a $b\u00a0c",)]
    found = quality.counts(spark.createDataFrame(rows, "text string")).collect()
    assert [tuple(r[c] for c in quality.COUNTS) for r in found] == [
        (9, 9, 0, 0, 9), (6, 6, 0, 2, 6), (0, 0, 0, 0, 0), (0, 0, 0, 0, 0), (4, 4, 0, 0, 0), (2, 6, 2, 0, 0)]


def test_quality_keeps_prose_and_drops_junk(spark):
    junk = [("A$$$ b### " * 60,), ("STOP!! NOW!! " * 60,), ("again " * 200,), ("one | two | " * 60,), ("short",)]
    good = [(prose(k),) for k in range(60)]
    kept = {r[0] for r in quality.keep_good(spark.createDataFrame(junk * 4 + good, "text string")).collect()}
    assert kept == {t for t, in good}


def test_toxicity_learns_words_and_stems(spark):
    rows, labels = [], []
    for k in range(400):
        bad = k % 4 == 0
        rows.append((k, prose(k) + (f" grobzu{'abcdefghij'[k // 4 % 10]} zorkface" if bad else "")))
        labels.append((k, 1, int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = toxicity.score_documents(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert all(r.predicted == int(r.doc_id % 4 == 0) for r in found)
    assert any(r.held_out for r in found) and all(0 <= r.score <= 1 for r in found)


def test_toxicity_learns_from_texts_that_share_a_passage(spark):
    rows, labels, passage = [], [], " ".join(prose(1000 + k) for k in range(4))
    for k in range(120):
        bad = k % 4 == 0
        rows.append((k, f"{passage} {prose(k)}" + (" you zorkface" if bad else "")))
        labels.append((k, 1, int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = toxicity.score_documents(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert all(r.predicted == int(r.doc_id % 4 == 0) for r in found)


def test_near_copies_are_one_text_when_words_are_learned(spark):
    rows = [(k, prose(k) + " plainword", 0) for k in range(60)] + [(100 + k, f"{PROSE} {prose(99)} copiedword number{k}", 1) for k in range(30)]
    words, _ = toxicity.learn_words(spark.createDataFrame(rows, "doc_id long, text string, toxic int"))
    assert "copiedword" not in words and "plainword" not in words


def test_url_parts_and_rules(spark):
    urls = {
        "http://A.Example.COM/en/7x?q": ("a.example.com", "/en/7x", "example.com/en/7", "allow"),
        "https://example.com/en/8": ("example.com", "/en/8", "com/en/", "block"),
        "x://notexample.net/de/8": ("notexample.net", "/de/8", "net/de/", "allow"),
        "x://b.example.net/de/81": ("b.example.net", "/de/81", "example.net/de/8", "block"),
        "x://a.org/es/#f": ("a.org", "/es/", "org/es/", "block"), "x://com": ("com", "", None, "allow"), "no scheme/en/": ("", "", None, "allow"),
        "x://?a": ("", "", None, "allow"), "": ("", "", None, "allow"), None: ("", "", None, "allow"), "x://a.com/e n/\n": ("a.com", "/e n/\n", None, "allow"),
    }
    pages = spark.createDataFrame([(k, u, "h") for k, u in enumerate(urls)] * 2, "page_id long, url string, host string")
    found = url_filter.judge(pages, URL_RULES).collect()
    assert len(found) == 2 * len(urls)
    for r in found:
        assert (r.host, r.path, r.rule, r.verdict) == list(urls.values())[r.page_id], r
    assert url_filter.judge(pages.filter("false"), URL_RULES).count() == 0
    assert url_filter.judge(pages, []).filter("verdict = 'allow'").count() == 2 * len(urls)
    with pytest.raises(ValueError):
        url_filter.judge(pages, [*URL_RULES, URL_RULES[0]])


def test_cascade_is_exact_over_the_universe(spark):
    universe = spark.range(20_000).select(F.xxhash64("id").alias("x"), F.xxhash64(F.lit("s"), "id").alias("y"))
    rows = universe.toArrow()
    pairs = url_filter._pairs(rows.column("x").combine_chunks(), rows.column("y").combine_chunks())
    for n in (0, 1, 7, 300, 15_000):
        cascade = url_filter.build_cascade(pairs[:n], universe)
        assert cascade.contains(pairs).tolist() == [k < n for k in range(len(pairs))]
    assert len(cascade.levels) > 3


def test_licenses(spark):
    rows = [(1, "Copyright (c) 2020 Somebody\n\n" + licenses._MIT.upper()), (2, "text\nReleased under the MIT Licence!\nmore\n licensed under CC BY-NC 4.0."), (3, "Copyright 2020"), (4, None), (2, "x"), (5, "spdx-license-identifier: ISC")]
    found = {(r.doc_id, r.license, r.notices) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {(1, "MIT", ""), (2, None, "CC-BY-NC-4.0, MIT"), (2, None, ""), (3, None, ""), (4, None, ""), (5, "ISC", "ISC")}


def test_chats(spark):
    rows = [(1, 0, "user", "hi"), (2, 0, "user", "hi"), (2, 1, "assistant", "yes"), (3, 5, "user", "hi"), (3, 6, "assistant", "yes"), (4, 0, None, None), (4, None, "user", "last"), (5, 0, "user", "other"), (None, 0, "user", "hi"), (6, 0, "user", "hi"), (6, 0, "user", "hi"), (7, 0, "", "")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, k string")
    found = {r.conv_id: (r.n_turns, r.copies) for r in chat.format_conversations(df).collect()}
    assert found == {2: (2, 2), 4: (2, 1), 5: (1, 1), 6: (2, 1)}
    assert chat.format_conversations(df.filter("false")).count() == 0
    long = spark.range(1000).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.lit("u").alias("role"), F.col("id").cast("string").alias("text"))
    both = long.unionByName(long.filter("turn < 700").withColumn("conv_id", F.lit(2).cast("long")))
    assert [(r.conv_id, r.n_turns) for r in chat.format_conversations(both).select("conv_id", "n_turns").collect()] == [(1, 1000)]


def test_neighbours_of_odd_vectors(spark):
    v = lambda *x: list(map(float, x))
    rows = [(0, v(1, 0)), (1, v(1, 0)), (2, v(1, 0)), (3, v(0, 1)), (4, v(0, 0)), (5, None), (6, [1.0, None]), (7, v("nan", 1)), (8, v("inf", 1)), (9, v(1, 2, 3)), (None, v(1, 1)), (20, v(2, 1)), (40, v(-1, 0))]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, list string")
    found = ann.nearest(df, df.filter("vec_id % 20 = 0"), 3).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.vec_id, r.score) for r in found] == [(0, 20, 2.0), (0, 1, 1.0), (0, 2, 1.0), (20, 0, 2.0), (20, 1, 2.0), (20, 2, 2.0), (40, 3, 0.0), (40, 0, -1.0), (40, 1, -1.0)]
    assert ann.nearest(df.filter("false"), df, 3).count() == 0


def test_repeated_ids_with_other_texts_give_one_result(spark):
    base = [(k, prose(k)) for k in range(12)]
    rows = [*base, (3, prose(40) + " tail"), (3, prose(41)), (50, prose(41)), (51, prose(40)), (52, prose(3)), (3, None), (None, prose(3))]
    run = lambda rs, n: sorted((r.doc_id if r.doc_id is not None else -1, r.class_id) for r in bagminhash.near_duplicate_classes(spark.createDataFrame(rs, "doc_id long, text string").repartition(n)).collect())
    first = run(rows, 1)
    assert all(run(r, n) == first for r, n in ((rows[::-1], 3), (rows[5:] + rows[:5], 2)))
    classes = dict(first)
    assert classes[52] == 3 and classes[50] == 3 and classes[0] == 0  # equal texts link any of an id's texts
