"""The audit of filters against a walk through every order, and its table against the definition."""

import random
import re
from collections import Counter
from itertools import permutations

import pytest

from arbograph.llm import filter_audit


def failing(text, smaller):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {
        "A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text),
        "D": any(c in "#$%&*|" for c in text), "E": smaller,
    }


def expected(rows, labels):
    good, toxic = {d for d, q, _ in labels if q == 1 and d is not None}, {d for d, _, t in labels if t == 1 and d is not None}
    texts = [(d, t or "", p or "") for d, t, p in rows]
    least = {}
    for d, t, _ in texts:
        if d is not None:
            least[t] = min(d, least.get(t, d))
    judged = [(d, p, failing(t, d is not None and d > least[t])) for d, t, p in texts]
    out = {}
    for part in {p for _, _, p in texts}:
        own = [(d, f) for d, p, f in judged if p == part]
        total = Counter()
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, name in enumerate(order, 1):
                gone = [(d, f) for d, f in left if f[name]]
                left = [x for x in left if not x[1][name]]
                total[name] += len(gone)
                out[part, order, step] = [
                    len(left), len(gone), sum(f[name] for _, f in own) - len(gone), sum(f[name] and sum(f.values()) == 1 for _, f in own),
                    sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone),
                ]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(total[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def found(spark, rows, labels, partitions=3):
    docs = spark.createDataFrame([(*r, "clash", "x") for r in rows], "doc_id long, text string, lang string, mask string, label string").repartition(partitions)
    known = spark.createDataFrame([(*r, "clash") for r in labels], "doc_id long, quality int, toxic int, part string")
    return {tuple(r)[:3]: tuple(r)[3:] for r in filter_audit.audit(docs, known).collect()}


def texts(seed, n):
    rng = random.Random(seed)
    pool = [" ".join(rng.choices(["ab", "cd", "ÉÉ", "XY", "漢字", "e#", *map(str, range(size))], k=rng.choice((0, 1, 99, 100, 101, 140)))) for size in (1, 40, 400, 4000) for _ in range(6)]
    pool += ["", " \t\n\x0b\f\r", "   \x1c \x85", None, "A" * 10 + "b" * 90, "A" * 11 + "b" * 89, "a\x0bb\x0cc " * 40]
    return [(k, rng.choice(pool), rng.choice(("en", "de", None, ""))) for k in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_counts_are_those_of_a_walk_through_every_order(spark, seed):
    rows = texts(seed, 160)
    rows += [rows[0], rows[0], (rows[3][0], "another text", "en"), (None, rows[5][1], "en"), (None, rows[5][1], "en"), (None, None, None)]
    rng = random.Random(seed)
    labels = [(k, rng.choice((0, 1, None)), rng.choice((0, 1, None))) for k in range(0, 160, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1), (9999, 1, 1)]
    assert found(spark, rows, labels) == expected(rows, labels)


def test_many_copies_and_many_parts(spark, monkeypatch):
    monkeypatch.setattr(filter_audit, "HELD_PARTS", 2)
    monkeypatch.setattr(filter_audit, "SLICE_ROWS", 5)
    rows = [(k, "one text " * 60, f"p{k % 40}") for k in range(300, 0, -1)]
    assert found(spark, rows, []) == expected(rows, [])


def test_the_table_has_the_first_failure():
    table = filter_audit.first_failures()
    assert table.shape == (32, 120)
    for mask in range(32):
        for o, order in enumerate(filter_audit.ORDERS):
            falls = [s for s, name in enumerate(order) if mask >> "ABCDE".index(name) & 1]
            assert table[mask, o] == (falls[0] if falls else 5)


def test_empty_tables(spark):
    assert found(spark, [], []) == {}
    assert found(spark, [(1, "a", "en")], []) == expected([(1, "a", "en")], [])
