"""Quality rules as weak supervision, in DataFrame functions only.

Rules look at counts of a text and vote good, bad or not at all.  Texts are
good, or bad in one of several ways, each of which is seen by two rules at
least, as one rule alone can't be told from its own mistakes.  The share of
every such class, and how often each rule condemns its texts when it votes, are
estimated by expectation-maximisation over the distinct vote vectors, of which
there are at most 3 to the number of rules whatever the size of the corpus, so
an iteration reads a bounded table.  No estimate is bounded; a prior of the
strength of one text keeps them off 0 and 1.  Iterations end when the likelihood
stands still.  The class that rules condemn least is the good one.  A text is
kept if its posterior probability of being good is at least one half, rather
than if it passes every rule: one bad vote that its likes don't back is
outvoted.

Defined results: a null text counts as empty; a text without words has no
votes but the length rule's and fails the base rule; an empty table gives no
rows; repeated rows are judged alike; other columns are kept by ``judge``
under their names, and the columns it adds replace columns of the same names.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbograph.session import materialise

SPACE = "\\x20\\x09-\\x0D"
#: Iterations end when a text's mean log likelihood gains less than this, or after so many.
TOLERANCE, ITERATIONS = 1e-7, 200
#: Where the estimates start: the share of good texts, how often a rule condemns good texts, those bad in the way it looks for, others.
PRIOR_GOOD, FALSE_ALARMS, ALARMS, BY_CHANCE = 0.9, 0.02, 0.7, 0.05
#: Texts, or votes, that the start counts as.
SMOOTH = 1.0

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
EXTRA = ("n_lines", "n_capitals", "n_shouts", "n_stops", "n_twice")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it is used."""
    return F.transform(F.array(value), body)[0]


def _repeats(words: Column) -> Column:
    """Words in three-word windows that occur twice or more in the text, and
    how many windows equal an earlier one.

    Windows are compared by 64-bit hashes.  Texts whose windows are all
    distinct end there; the others sort their windows once, so the cost is
    n log n for texts of any length.
    """

    def covered(hashes: Column) -> Column:
        ordered = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return _let(
            ordered,
            lambda pairs: _let(
                F.array_sort(
                    F.transform(
                        F.filter(
                            pairs,
                            lambda p, j: F.coalesce(F.get(pairs, j - 1)["h"] == p["h"], F.lit(False))
                            | F.coalesce(F.get(pairs, j + 1)["h"] == p["h"], F.lit(False)),
                        ),
                        lambda p: p["i"],
                    )
                ),
                lambda at: F.aggregate(
                    F.transform(at, lambda p, j: F.least(F.lit(3), F.coalesce(F.get(at, j + 1) - p, F.lit(3)))),
                    F.lit(0).cast("long"),
                    lambda total, x: total + x,
                ),
            ),
        )

    def of(ws: Column) -> Column:
        windows = F.transform(
            F.sequence(F.lit(0), F.size(ws) - 3), lambda i: F.xxhash64(F.get(ws, i), F.get(ws, i + 1), F.get(ws, i + 2))
        )
        none = F.struct(F.lit(0).cast("long").alias("words"), F.lit(0).cast("long").alias("twice"))
        return F.when(F.size(ws) < 4, none).otherwise(
            _let(
                windows,
                lambda hs: _let(
                    (F.size(hs) - F.size(F.array_distinct(hs))).cast("long"),
                    lambda twice: F.when(twice == 0, none).otherwise(F.struct(covered(hs).alias("words"), twice.alias("twice"))),
                ),
            )
        )

    return _let(words, of)


def counts(docs: DataFrame) -> DataFrame:
    """``docs`` with the counts of each text; a generator keeps the optimiser from computing them twice."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = F.regexp_extract_all(text, F.lit(f"([^{SPACE}]+)"), F.lit(1))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    zero = F.lit(0).cast("long")
    row = _let(
        words,
        lambda ws: _let(
            lines,
            lambda ls: _let(_repeats(ws), lambda rs: F.struct(
                F.size(ws).cast("long").alias("n_words"),
                F.aggregate(ws, zero, lambda total, w: total + F.length(w)).alias("word_chars"),
                F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
                (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
                rs["words"].alias("n_repeat_words"),
                F.size(ls).cast("long").alias("n_lines"),
                F.regexp_count(text, F.lit("[A-Z]")).cast("long").alias("n_capitals"),
                F.regexp_count(text, F.lit("!!")).cast("long").alias("n_shouts"),
                F.regexp_count(text, F.lit(f"[.!?][{SPACE}]")).cast("long").alias("n_stops"),
                rs["twice"].alias("n_twice"),
            )),
        ),
    )
    return docs.drop(*COUNTS, *EXTRA).select("*", F.inline(F.array(row)))


#: Name, the way of being bad that a rule looks for (if another does too), when it votes bad, when good; both over the counts, in SQL.
RULES = (
    ("length", None, "n_words < 50", "n_words >= 100"),
    ("symbols", "junk", "100 * n_symbols > 10 * n_words", "n_symbols = 0 and n_words > 0"),
    ("marks", "junk", "100 * n_symbols > 2 * word_chars", "100 * n_symbols <= word_chars and n_words > 0"),
    ("lines", "repetition", "100 * n_dup_lines > 40 * n_lines", "100 * n_dup_lines <= 30 * n_lines and n_lines > 0"),
    ("repeats", "repetition", "100 * n_repeat_words > 30 * n_words", "100 * n_repeat_words <= 20 * n_words and n_words > 0"),
    ("windows", "repetition", "100 * n_twice > 20 * n_words", "100 * n_twice <= 12 * n_words and n_words > 0"),
    ("capitals", "shouting", "100 * n_capitals > 40 * word_chars", "100 * n_capitals <= 10 * word_chars and n_words > 0"),
    ("shouts", "shouting", "100 * n_shouts > 10 * n_words", "n_shouts = 0 and n_words > 0"),
    ("stops", None, "n_words >= 60 * (1 + n_stops)", "n_words > 0 and n_words <= 40 * (1 + n_stops)"),
)
NAMES = tuple(name for name, _, _, _ in RULES)
KINDS = tuple(kind for _, kind, _, _ in RULES)
BASE_FAILED = "n_words < 50 or 100 * n_repeat_words > 50 * n_words"


@dataclass(frozen=True)
class Model:
    """Shares of the classes, and ``rates[k][c]``: how often rule k, if it votes, condemns a text of class c."""

    shares: tuple[float, ...]
    rates: tuple[tuple[float, ...], ...]

    @property
    def good(self) -> int:
        """The class that is condemned least."""
        return min(range(len(self.shares)), key=lambda c: sum(rate[c] for rate in self.rates))


def start(kinds: Sequence[str | None] = KINDS) -> Model:
    """Good texts, and one class for each way of being bad."""
    ways = sorted({x for x in kinds if x is not None})
    return Model(
        (PRIOR_GOOD, *((1 - PRIOR_GOOD) / len(ways) for _ in ways)),
        tuple((FALSE_ALARMS, *(ALARMS if way == kind else BY_CHANCE for way in ways)) for kind in kinds),
    )


def votes() -> list[Column]:
    """1 for good, -1 for bad, 0 for none, by rule."""
    return [F.expr(f"case when {bad} then -1 when {good} then 1 else 0 end").alias(f"_{name}") for name, _, bad, good in RULES]


def _joint(model: Model, votes: Column) -> Column:
    """The probabilities of each class and an array of votes; a rule that abstains says nothing.

    The model is one literal, whose values aren't compiled into the plan, so
    that all iterations share their code.
    """
    rules = range(len(model.rates))
    logs = [[math.log(share), *(math.log1p(-r[c]) for r in model.rates), *(math.log(r[c]) for r in model.rates)] for c, share in enumerate(model.shares)]

    def of(log: Column) -> Column:
        return F.exp(
            F.aggregate(
                F.lit(list(rules)),
                F.get(log, F.lit(0)),
                lambda total, k: total + F.when(F.get(votes, k) == 1, F.get(log, k + 1)).when(F.get(votes, k) == -1, F.get(log, k + 1 + len(rules))).otherwise(0.0),
            )
        )

    return F.transform(F.lit(logs), of)


def fit_votes(vectors: DataFrame, names: Sequence[str], kinds: Sequence[str | None]) -> Model:
    """The model of distinct vote vectors: a column _name for each rule, and ``count``."""
    first = model = start(kinds)
    classes = range(len(first.shares))
    before = -math.inf
    share = {c: F.col("count") * F.get("_joint", F.lit(c)) / F.col("_all") for c in classes}
    sums = [F.sum("count").alias("n"), F.sum(F.col("count") * F.log("_all")).alias("fit"), *(F.sum(share[c]).alias(f"s{c}") for c in classes)]
    sums += [F.sum(F.when(F.col(f"_{x}") == v, share[c]).otherwise(0.0)).alias(f"{x}{v}{c}") for x in names for v in (1, -1) for c in classes]
    for _ in range(ITERATIONS):
        weighed = vectors.select("*", _joint(model, F.array(*(f"_{x}" for x in names))).alias("_joint"))
        weighed = weighed.withColumn("_all", F.aggregate("_joint", F.lit(0.0), lambda total, x: total + x))
        found = weighed.agg(*sums).first()
        if not found["n"]:
            break
        model = Model(
            tuple((found[f"s{c}"] + SMOOTH * first.shares[c]) / (found["n"] + SMOOTH) for c in classes),
            tuple(
                tuple((found[f"{x}-1{c}"] + SMOOTH * rate[c]) / (found[f"{x}-1{c}"] + found[f"{x}1{c}"] + SMOOTH) for c in classes)
                for x, rate in zip(names, first.rates, strict=True)
            ),
        )
        if found["fit"] - before < TOLERANCE * found["n"]:
            break
        before = found["fit"]
    return model


def fit(counted: DataFrame) -> Model:
    """The model of counted texts."""
    vectors = materialise(counted.select(*votes()).groupBy(*(f"_{x}" for x in NAMES)).count(), "votes")
    return fit_votes(vectors, NAMES, KINDS)


def posterior(model: Model, votes: Sequence[Column]) -> Column:
    return _let(
        _joint(model, F.array(*votes)),
        lambda joint: F.get(joint, F.lit(model.good)) / F.aggregate(joint, F.lit(0.0), lambda total, x: total + x),
    )


def judge(counted: DataFrame, model: Model) -> DataFrame:
    """Adds ``base_failed``, ``posterior`` and ``kept`` to counted texts."""
    return (
        counted.drop("base_failed", "posterior", "kept")
        .withColumn("base_failed", F.expr(BASE_FAILED))
        .withColumn("posterior", posterior(model, votes()))
        .withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= 0.5))
    )


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that are kept, with the columns of ``docs``; each text is counted once and stored with its counts."""
    own = {c: f"_c{k}" for k, c in enumerate(docs.columns) if c != "text"}
    counted = materialise(counts(docs.select("text", *(F.col(f"`{c}`").alias(k) for c, k in own.items()))), "counted")
    kept = judge(counted, fit(counted)).filter("kept")
    return kept.select(*(F.col(own.get(c, c)).alias(c) for c in docs.columns))


def oracle_sql() -> str:
    """The same judgement in SQL: counts by joins, estimates by a recursive query over the vote vectors."""
    case = {name: f"case when {bad} then -1 when {good} then 1 else 0 end" for name, _, bad, good in RULES}
    first = start()
    classes = range(len(first.shares))

    def joint(c: int) -> str:
        return f"exp(ln(p_{c})" + "".join(f" + case v_{x} when 1 then ln(1 - r_{x}_{c}) when -1 then ln(r_{x}_{c}) else 0 end" for x in NAMES) + ")"

    of = lambda x, vote, c: f"sum(case when v_{x} = {vote} then n * j_{c} / total else 0 end)"
    steps = [f"(sum(n * j_{c} / total) + {SMOOTH * first.shares[c]}) / (sum(n) + {SMOOTH})" for c in classes]
    for x, rate in zip(NAMES, first.rates, strict=True):
        steps += [f"({of(x, -1, c)} + {SMOOTH * rate[c]}) / ({of(x, -1, c)} + {of(x, 1, c)} + {SMOOTH})" for c in classes]
    params = [*(f"p_{c}" for c in classes), *(f"r_{x}_{c}" for x in NAMES for c in classes)]
    values = [*first.shares, *(v for rate in first.rates for v in rate)]
    joints = ", ".join(f"{joint(c)} as j_{c}" for c in classes)
    condemned = [" + ".join(f"r_{x}_{c}" for x in NAMES) for c in classes]
    good = "case " + " ".join(f"when {condemned[c]} <= least({', '.join(condemned)}) then j_{c}" for c in classes) + " end"
    total = " + ".join(f"j_{c}" for c in classes)
    return f"""
with recursive texts as materialized (
  select row_number() over () as r, doc_id, coalesce(text, '') as t from documents
), split as materialized (
  select r, doc_id, t,
    [x for x in string_split_regex(t, '[\\x20\\x09-\\x0D]+') if x <> ''] as ws,
    [x for x in string_split(t, chr(10)) if regexp_matches(x, '[^\\x20\\x09-\\x0D]')] as ls
  from texts
), starts as (
  select r, ws, unnest(range(1, len(ws) - 1)) as i from split
), windows as (
  select r, i, count(*) over (partition by r, ws[i], ws[i + 1], ws[i + 2]) as n,
    row_number() over (partition by r, ws[i], ws[i + 1], ws[i + 2] order by i) as nth
  from starts
), repeated as (
  select r, count(distinct p) as n_repeat_words
  from (select r, unnest([i, i + 1, i + 2]) as p from windows where n > 1) group by r
), twice as (
  select r, count(*) as n_twice from windows where nth > 1 group by r
), counted as materialized (
  select doc_id, cast(len(ws) as bigint) as n_words,
    cast(coalesce(list_sum([length(x) for x in ws]), 0) as bigint) as word_chars,
    cast(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
    cast(len(ls) - len(list_distinct(ls)) as bigint) as n_dup_lines,
    coalesce(n_repeat_words, 0) as n_repeat_words,
    len(ls) as n_lines,
    length(regexp_replace(t, '[^A-Z]', '', 'g')) as n_capitals,
    len(regexp_extract_all(t, '!!')) as n_shouts,
    len(regexp_extract_all(t, '[.!?][\\x20\\x09-\\x0D]')) as n_stops,
    coalesce(n_twice, 0) as n_twice
  from split left join repeated using (r) left join twice using (r)
), voted as materialized (
  select *, {', '.join(f'{case[x]} as v_{x}' for x in NAMES)} from counted
), vectors as materialized (
  select {', '.join(f'v_{x}' for x in NAMES)}, count(*) as n from voted group by all
), em(step, fit, done, {', '.join(params)}) as (
  select 0, cast(-1e300 as double), false, {', '.join(f'cast({v} as double)' for v in values)}
  union all
  select step + 1, sum(n * ln(total)), sum(n * ln(total)) - fit < {TOLERANCE} * sum(n) or step + 1 >= {ITERATIONS}, {', '.join(steps)}
  from (select *, {total} as total from (select *, {joints} from em cross join vectors where not done))
  group by step, fit
), judged as (
  select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed, {good} / ({total}) as posterior
  from (select v.*, e.*, {joints} from voted v cross join (select * from em order by step desc limit 1) e)
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and posterior >= 0.5 as kept
from judged
"""
