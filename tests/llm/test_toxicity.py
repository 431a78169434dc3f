"""The pattern grammar: against positions counted by hand, and what it calls toxic."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from arbograph.llm import toxicity

SEEDS = toxicity.seed_model()


def scorer(words=None, stems=None):
    return toxicity.Scorer(words or SEEDS.words, stems or {}, SEEDS.threats)


def score(text, model=SEEDS):
    found, _ = toxicity.Scorer(model.words, model.stems, model.threats).text(text)
    return float(model.score(model.strength(np.array([found])))[0])


def by_hand(tokens, kinds, weights):
    """Kind, aim, weight and factor of each match, from the distances of the openers."""
    out = []
    for k, kind in enumerate(kinds):
        if kind in toxicity.MATCHES:
            aimed, factor = False, 1.0
            for step, scopes in ((-1, toxicity.SCOPES_BEFORE), (1, toxicity.SCOPES_AFTER)):
                for opener, width, by in scopes:
                    if any(kinds[k + step * d] == opener for d in range(1, width + 1) if 0 <= k + step * d < len(kinds)):
                        aimed, factor = aimed or opener == "target", factor * by
            out.append((kind, aimed, weights[k], factor))
    return out


SYMBOL = {"idiot": "insult", "loser": "insult", "kill": "threat", "you": "target", "not": "negation", "said": "report", "tree": "other", "walks": "other"}


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(sorted(SYMBOL)), max_size=30))
def test_machines_find_what_distances_say(tokens):
    own = scorer()
    expected = by_hand(tokens, [SYMBOL[t] for t in tokens], [own.symbol(t)[1] for t in tokens])
    found = own.clause(tokens)
    assert [x[:3] for x in found] == [x[:3] for x in expected]
    assert np.allclose([x[3] for x in found], [x[3] for x in expected])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from(sorted(SYMBOL)), max_size=8), max_size=5))
def test_texts_add_up_their_clauses(clauses):
    own, expected, before, matched = scorer(), dict.fromkeys(toxicity.PATTERNS, 0.0), False, 0
    for tokens in clauses:
        found = by_hand(tokens, [SYMBOL[t] for t in tokens], [own.symbol(t)[1] for t in tokens])
        hit = False
        for kind, aimed, weight, factor in found:
            if aimed:
                expected[f"{kind}_aimed"] += weight * factor
            elif kind == "insult" and before:
                expected["insult_again"] += weight * factor
            elif kind == "insult":
                expected["alone"] = factor
            hit = hit or aimed or (kind == "insult" and before)
            before = before or kind == "insult"
        matched += hit
    found, n = own.text(". ".join(" ".join(c) for c in clauses))
    assert np.allclose(found, list(expected.values())) and n == matched


@pytest.mark.parametrize("text", ["i will kill you", "You are an idiot.", "idiot, you there", "I'll strangle them", "a moron here. there a loser.", "stupid worthless scum"])
def test_toxic(text):
    assert score(text) > 0.5


@pytest.mark.parametrize(
    "text",
    ["", None, "A fine day.", "there was an idiot", "clown", "kill", "we kill time", "you are not an idiot", 'he said "you idiot"', "you tree", "idiot tree. you walk far and wide"],
)
def test_not_toxic(text):
    assert score(text) < 0.5


def test_order_of_strengths():
    assert score("you are an idiot") > score("there was an idiot") > score("that was not an idiot") > score("a fine day") == score(None)
    assert score("you idiot") > score("they wrote you idiot") and score("you idiot") > score("you idiot, he said")
    assert score("you idiot. you idiot.") > score("you idiot.")
    assert scorer(stems={"scumm": 3.0}).text("you scummish")[0][1] == 3.0


def drawn(threat_labels, n=400):
    """What texts match, and labels by which insults are toxic where they recur."""
    found, toxic = np.zeros((2 * n, 4)), np.zeros(2 * n)
    found[:n, 0], found[:n, 2], toxic[:n] = 1, np.linspace(2, 9, n), 1
    found[n : n + n // 20, 0] = 1
    if threat_labels is not None:
        found[-n // 4 :, 3] = 1
        toxic[-n // 4 :] = threat_labels
    return found, toxic


def test_weights_of_patterns_are_learned():
    model = toxicity.Model({}, {}, {}, *toxicity.curve(*drawn(None)))
    one = lambda *x: float(model.strength(np.array([x]))[0])
    assert one(1, 0, 2, 0) > 1 > one(1, 0, 0, 0)
    # labels say nothing of threats: their weight stays
    assert np.isclose(model.weights[3], toxicity.START["threat_aimed"], rtol=0.02)
    assert toxicity.curve(*drawn(0))[0][3] < 0.8 * toxicity.START["threat_aimed"]
    assert toxicity.curve(*drawn(1))[0][3] > toxicity.START["threat_aimed"]


def test_an_insult_alone_never_reaches_the_limit():
    found = np.zeros((200, 4))
    found[:100, 0] = 1
    weights, steepness = toxicity.curve(found, found[:, 0])
    assert weights[0] < 1 and steepness > 0


def test_null_ids_are_scored(spark):
    docs = spark.createDataFrame([(None, "you idiot"), (5, None), (5, "you idiot"), (6, "")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    found = toxicity.score_documents(docs, labels).collect()
    assert [r.predicted for r in found] == [1, 0, 1, 0] and found[0].held_out is False and found[0].score == found[2].score
