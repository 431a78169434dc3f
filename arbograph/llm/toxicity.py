"""Toxicity by a weighted finite-state pattern grammar over clauses.

Words become symbols: insult, threat, target, negation, report or other.  Small
transducers each follow one opener for a few words and mark the insults and
threats they meet there: *target* marks them as aimed at somebody, *negation*
("not" and the like) and *reported speech* ("said", quotation marks) make them
weigh less.  They are composed into one machine, which reads a clause forwards,
and into one for what follows a word, which reads it backwards.  A clause
matches by its patterns: insult and target, in either order, threat and target,
in either order, or an insult where the text had one before.  An insult alone,
the first of its text, leaves a small residue that can't make a text toxic; a
threat at nobody leaves nothing.

Weights of patterns, learned from labelled rows, and of the words in them, say
how much of a limit each match makes up, and a logistic curve maps the sum to a
score from 0 to 1, one half at the limit.  Where the labels say nothing of a pattern, its
weight stays what it was, in proportion to the limit.

Seed words are fixed below.  Further insults, words or stems with many forms,
and the weights of all words, threats included, are learned from labelled
training rows.  All learn from a bounded sample of at most about
``SAMPLE_ROWS`` labelled rows, spread evenly by a hash of doc_id; scoring covers
every text as a whole.

Defined results: null and empty texts have strength 0 and still get a score, the lowest;
labels that are null are ignored, and of several labels of a document the
largest counts; without labels of both kinds the seed words and a default curve
are used; a null doc_id is never held out or learned from and is scored like
any other; repeated rows are scored alike; empty tables give no rows; columns
other than doc_id and text never influence a score.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbograph.llm import bagminhash
from arbograph.session import materialise

#: Labelled rows to learn from, at most about so many.
SAMPLE_ROWS = 12_000
#: A learned word is found in so many families of toxic texts at least, in so large a share of toxic ones among all, and more often
#: than chance allows by so many nats: one in 10^7, as about a million words are tried.
MIN_TEXTS, MIN_PURITY, MIN_EVIDENCE = 5, 0.6, 16.0
#: Stems have so many letters, and so many forms at least.
STEM_LETTERS, STEM_FORMS = (4, 5, 6, 7, 8), 4

# Seed words of the grammar.
INSULTS = "idiot idiots moron morons imbecile loser losers scum scumbag stupid dumbass worthless pathetic disgusting".split()
THREATS = "kill murder strangle stab shoot hurt destroy punch".split()
TARGETS = "you your yours yourself he she they him her them his their u du dich dein ihr euch tu toi ton vous votre vosotros usted tú te eres".split()
NEGATIONS = "not no never none nobody neither nor cannot isn aren wasn don doesn didn nicht kein keine nie ne pas jamais aucun nunca ningún jamás".split()
REPORTS = "said says say wrote writes called calls claimed quoted reported according dit écrit sagte schrieb laut dijo escribió \" “ ” « » „".split()

CLAUSE = re.compile(r"[.!?;:\n]+")
TOKEN = re.compile(r"\w+|[\"“”«»„]")


SYMBOLS = ("insult", "threat", "target", "negation", "report", "other")
MATCHES = ("insult", "threat")
#: What a text's matches add up to: the residue of an insult alone, and the patterns.
PATTERNS = ("alone", "insult_aimed", "insult_again", "threat_aimed")
#: How many words before and after a match each opener reaches, and the factor that it puts on the match.
SCOPES_BEFORE = (("target", 5, 1.0), ("negation", 3, 0.25), ("report", 12, 0.4))
SCOPES_AFTER = (("target", 3, 1.0), ("report", 4, 0.4))


@dataclass(frozen=True)
class Transducer:
    """Arcs (state, symbol) -> (state, whether a match is aimed, log weight)."""

    start: object
    arcs: dict = field(hash=False)

    def read(self, symbols: Iterable[str]) -> Iterator[tuple[bool, float]]:
        """Of every symbol in turn."""
        state = self.start
        for symbol in symbols:
            state, aimed, weight = self.arcs[state, symbol]
            yield aimed, weight


def scope(opener: str, width: int, factor: float) -> Transducer:
    """Marks the matches among the ``width`` words that follow ``opener``: as aimed if that is a target, else with a weight."""
    arcs = {}
    for left in range(width + 1):
        for symbol in SYMBOLS:
            marked = left > 0 and symbol in MATCHES
            after = width if symbol == opener else max(left - 1, 0)
            arcs[left, symbol] = (after, marked and opener == "target", float(np.log(factor)) if marked else 0.0)
    return Transducer(0, arcs)


def compose(first: Transducer, second: Transducer) -> Transducer:
    """Both at once: pairs of states, matches aimed by either, and weights added."""
    start = (first.start, second.start)
    arcs, todo, seen = {}, [start], {start}
    while todo:
        state = todo.pop()
        for symbol in SYMBOLS:
            (a, aim_a, x), (b, aim_b, y) = first.arcs[state[0], symbol], second.arcs[state[1], symbol]
            arcs[state, symbol] = ((a, b), aim_a or aim_b, x + y)
            if (a, b) not in seen:
                seen.add((a, b))
                todo.append((a, b))
    return Transducer(start, arcs)


def grammar() -> tuple[Transducer, Transducer]:
    """The machine that reads a clause forwards, and the one that reads it backwards."""
    return tuple(reduce(compose, (scope(*x) for x in scopes)) for scopes in (SCOPES_BEFORE, SCOPES_AFTER))


class Scorer:
    """What texts match under the grammar; ``words``, ``stems`` and ``threats`` hold weights."""

    def __init__(self, words: dict[str, float], stems: dict[str, float], threats: dict[str, float]) -> None:
        import ahocorasick

        self.words, self.stems, self.threats = words, stems, threats
        self.lengths = sorted({len(s) for s in stems})
        self.kind = {w: k for k, ws in zip(SYMBOLS[2:5], (TARGETS, NEGATIONS, REPORTS), strict=True) for w in ws}
        self.forwards, self.backwards = grammar()
        self.index = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        for w in {*words, *stems, *threats}:
            self.index.add_word(w)
        self.index.make_automaton()

    def insult(self, word: str) -> float:
        found = self.words.get(word, 0.0)
        for n in self.lengths:
            if len(word) >= n and (weight := self.stems.get(word[:n], 0.0)) > found:
                found = weight
        return found

    def symbol(self, token: str) -> tuple[str, float]:
        if token in self.threats:
            return "threat", self.threats[token]
        if token in self.kind:
            return self.kind[token], 0.0
        weight = self.insult(token)
        return ("insult", weight) if weight else ("other", 0.0)

    def clause(self, tokens: list[str]) -> list[tuple[str, bool, float, float]]:
        """Kind, aim, the word's weight and the factor on it of every match."""
        read = [self.symbol(t) for t in tokens]
        symbols = [s for s, _ in read]
        if not ("insult" in symbols or "threat" in symbols):
            return []
        before = list(self.forwards.read(symbols))
        after = list(self.backwards.read(symbols[::-1]))[::-1]
        return [
            (s, a or b, weight, float(np.exp(x + y)))
            for (s, weight), (a, x), (b, y) in zip(read, before, after, strict=True)
            if s in MATCHES
        ]

    def text(self, text: str | None) -> tuple[list[float], int]:
        """What is found of each of ``PATTERNS``, and the number of clauses with a pattern."""
        found, clauses = dict.fromkeys(PATTERNS, 0.0), 0
        if not text:
            return list(found.values()), clauses
        text = text.lower()
        starts = set()
        for end, length in self.index.iter(text):
            at = end - length + 1
            if at == 0 or not (text[at - 1].isalnum() or text[at - 1] == "_"):
                starts.add(at)
        if not starts:
            return list(found.values()), clauses
        low, before = 0, False
        hits = iter(sorted(starts))
        hit = next(hits)
        for high in (*(m.end() for m in CLAUSE.finditer(text)), len(text)):
            if hit is not None and hit < high:
                matched = False
                for kind, aimed, weight, factor in self.clause(TOKEN.findall(text[low:high])):
                    if aimed or (kind == "insult" and before):
                        found[f"{kind}_{'aimed' if aimed else 'again'}"] += weight * factor
                        matched = True
                    elif kind == "insult":
                        found["alone"] = factor
                    before = before or kind == "insult"
                clauses += matched
                while hit is not None and hit < high:
                    hit = next(hits, None)
            low = high
        return list(found.values()), clauses


#: How much of the limit an insult alone makes up, and where the patterns' weights start; the steepness of the curve.
ALONE = 0.4
START = {"insult_aimed": 0.6, "insult_again": 0.35, "threat_aimed": 1.5}
STEEPNESS = 4.0


@dataclass(frozen=True)
class Model:
    words: dict
    stems: dict
    threats: dict
    weights: tuple[float, ...] = (ALONE, *START.values())
    steepness: float = STEEPNESS

    def strength(self, found: np.ndarray) -> np.ndarray:
        """In parts of the limit, of rows of what texts match."""
        return found @ np.array(self.weights)

    def score(self, strength: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.steepness * (strength - 1), -500, 500)))


def seed_model() -> Model:
    return Model(dict.fromkeys(INSULTS, 2.0), {}, dict.fromkeys(THREATS, 1.0))


def curve(found: np.ndarray, toxic: np.ndarray, ridge: float = 0.1) -> tuple[tuple[float, ...], float]:
    """Weights and steepness from what labelled texts match.

    Logistic regression whose limit is one strength: the odds are linear in
    steepness and in steepness times weight, which are pulled towards each
    other in the proportion of the start.  An insult that is aimed weighs at
    least in that proportion to one that recurs.
    """
    x = np.column_stack([ALONE * found[:, 0] - 1, found[:, 1:]])
    start = np.array(list(START.values()))
    tie = np.column_stack([-start, np.eye(len(start))])  # zero where weights are those of the start
    prior = ridge * tie.T @ tie
    prior[0, 0] += ridge
    pull = np.zeros(len(start) + 1)
    pull[0] = ridge * STEEPNESS
    beta = STEEPNESS * np.array([1.0, *start])

    def loss(b: np.ndarray) -> float:
        odds = x @ b
        return float(np.logaddexp(0, odds).sum() - toxic @ odds + b @ prior @ b / 2 - pull @ b)

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -500, 500)))
        slope = x.T @ (toxic - p) - prior @ beta + pull
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + prior, slope)
        size = 1.0
        while size > 1e-6 and loss(beta + size * step) > loss(beta):
            size /= 2
        beta = beta + size * step
        if np.abs(size * step).max() < 1e-8:
            break
    steepness = max(float(beta[0]), 0.5)
    aimed, again, threat = (max(float(v), 0.0) / steepness for v in beta[1:])
    return (ALONE, max(aimed, again * START["insult_aimed"] / START["insult_again"]), again, threat), steepness


def held_out() -> F.Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0


def training_rows(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, text and toxic of a bounded sample of the labelled rows that aren't held out."""
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .filter("doc_id is not null and toxic is not null")
        .filter(~held_out())
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    total = known.count()
    if total > sample_rows:
        known = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(total)) < sample_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.join(F.broadcast(known), "doc_id").filter("text is not null")


def learn_words(rows: DataFrame) -> tuple[dict[str, float], dict[str, float]]:
    """Words by the texts that hold them, and stems of which many forms are found.

    Near copies, by the classes of ``bagminhash`` among the rows, count as one
    text of either kind; what other texts have in common changes nothing.  Only
    what passes the limits is collected.
    """
    texts = rows.groupBy("text").agg(F.max((F.col("toxic") > 0).cast("int")).alias("bad"), F.max((F.col("toxic") <= 0).cast("int")).alias("good"))
    # a key of each text, as rows may repeat a doc_id with other texts
    texts = materialise(texts.withColumn("doc_id", F.xxhash64("text")), "families")
    classes = bagminhash.near_duplicate_classes(texts).select("doc_id", F.col("class_id").alias("family"))
    words = F.filter(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))), lambda w: F.length(w) >= 2)
    per_word = (
        texts.join(F.broadcast(classes), "doc_id")  # two numbers for each of the sampled texts
        .select("family", "bad", "good", F.explode(words).alias("word"))
        .groupBy("word", "family")
        .agg(F.max("bad").alias("bad"), F.max("good").alias("good"))
        .groupBy("word")
        .agg(F.sum(F.col("bad") + F.col("good")).alias("n"), F.sum("bad").alias("bad"))
    )
    kinds = [F.struct(F.lit(0).alias("size"), F.col("word").alias("form"))]
    kinds += [F.when(F.length("word") >= n, F.struct(F.lit(n).alias("size"), F.substring("word", 1, n).alias("form"))) for n in STEM_LETTERS]
    found = (
        per_word.select("n", "bad", F.explode(F.array_compact(F.array(*kinds))).alias("k"))
        .groupBy(F.col("k.form").alias("word"), F.col("k.size").alias("size"))
        .agg(*(F.sum(c).alias(c) for c in ("n", "bad")), F.sum((F.col("bad") > 0).cast("int")).alias("forms"), F.max(F.struct("bad", "n")).alias("top"))
        .filter((F.col("size") == 0) | (F.col("forms") >= STEM_FORMS))
        # a stem stands without its commonest form, which may be a word of its own
        .withColumns({c: F.col(c) - F.when(F.col("size") > 0, F.col(f"top.{c}")).otherwise(0) for c in ("n", "bad")})
        .withColumn("forms", F.when(F.col("size") == 0, 0).otherwise(F.col("forms")))
    )
    base = rows.agg(F.avg((F.col("toxic") > 0).cast("double"))).first()[0] or 0.5
    share, rate = F.col("bad") / F.col("n"), F.lit(min(max(base, 1e-6), 0.5))
    nats = F.col("bad") * F.log(share / rate) + F.when(share < 1, (F.col("n") - F.col("bad")) * F.log((1 - share) / (1 - rate))).otherwise(0.0)
    found = found.filter((F.col("bad") >= MIN_TEXTS) & (share >= MIN_PURITY) & (nats >= MIN_EVIDENCE))
    found = found.collect()  # few: each has its texts in the bounded sample
    prior = float(np.log((1 - base + 0.01) / (base + 0.01)))
    weigh = lambda r: max(float(np.log((r["bad"] + 0.5) / (r["n"] - r["bad"] + 0.5))) + prior, 0.0)
    stem_weights: dict[str, float] = {}
    for r in sorted((r for r in found if r["forms"]), key=lambda r: (-r["bad"] * weigh(r), r["word"])):
        if not any(r["word"].startswith(s) or s.startswith(r["word"]) for s in stem_weights):
            stem_weights[r["word"]] = weigh(r)
    return {r["word"]: weigh(r) for r in found if not r["forms"]}, stem_weights


def matches(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns of ``keep``, without the text, what each text matches by pattern, its strength, its score and its matched clauses."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model.words, model.stems, model.threats)
        for batch in batches:
            if batch.num_rows:
                read = [scorer.text(t.as_py()) for t in batch.column(batch.num_columns - 1)]
                found = np.array([x for x, _ in read])
                strength = model.strength(found)
                added = [*found.T, strength, model.score(strength)]
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:-1], *(pa.array(x, pa.float64()) for x in added), pa.array([n for _, n in read], pa.int64())],
                    [*batch.schema.names[:-1], *PATTERNS, "strength", "score", "clauses"],
                )

    chosen = docs.select(*keep, F.col("text").cast("string").alias("text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema[:-1])
    return chosen.mapInArrow(run, f"{schema}, {', '.join(f'{x} double' for x in (*PATTERNS, 'strength', 'score'))}, clauses long")


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Words, weights and curve from labelled rows that aren't held out."""
    rows = materialise(training_rows(docs, labels, sample_rows), "training")  # read several times
    words, stems = learn_words(rows)
    seeds = seed_model()
    openers = {*TARGETS, *NEGATIONS, *REPORTS}
    threats = seeds.threats | {w: max(x, 1.0) for w, x in words.items() if w in seeds.threats}
    words = seeds.words | {w: x for w, x in words.items() if w not in threats and w not in openers}
    model = Model(words, stems, threats)
    found = matches(rows, model, ["toxic"]).select("toxic", *PATTERNS).toPandas()
    y = (found["toxic"].to_numpy() > 0).astype(float)
    if y.size == 0 or y.min() == y.max():
        return model
    return Model(words, stems, threats, *curve(found[list(PATTERNS)].to_numpy(float), y))


def score_documents(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted, strength and clauses of every row of ``docs``."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = matches(own, fit(docs, labels, sample_rows), ["doc_id"])
    held = F.coalesce(held_out(), F.lit(False)).alias("held_out")
    return found.select("doc_id", held, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "strength", "clauses")


def keep_clean(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``docs`` whose texts score below one half, with their columns."""
    model = fit(docs, labels, sample_rows)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model.words, model.stems, model.threats)
        for batch in batches:
            if batch.num_rows:
                found = np.array([scorer.text(t.as_py())[0] for t in batch.column(at)])
                yield batch.filter(pa.array(model.strength(found) < 1))

    return docs.mapInArrow(run, docs.schema)
