"""URL rules by a cascade of Bloom filters.

A rule is a host and a path prefix; it fits its host and all subdomains, and
paths that start with its own.  A url therefore has a bounded number of keys
that a rule could have: its host's suffixes of as many labels, and its path's
prefixes of as many characters, as some rule has.

Level one of a cascade encodes the listed keys.  Level two encodes the keys of
the corpus that pass level one though they aren't listed, level three the
listed keys that pass level two, and so on until no key is left.  As the
corpus's complete set of keys goes through, each of its keys is told exactly:
it is listed if the first level that it fails is an even one.  The first
level's rate of false positives is set by the number of keys in the corpus, so
that the second encodes about as many keys as the first; the cascade's size
follows that of the list, and it is sent to the tasks instead of a join.

Defined results: the host is what follows the first ``://`` up to ``/``, ``?``,
``#`` or the end, with A-Z lower-cased, the path what follows up to ``?``,
``#`` or the end; null urls and urls without ``://`` have neither.  The longest
rule wins, of equally long ones that with the longer host.  Without a rule a
url isn't listed and is allowed.  Empty tables give no rows; other columns than
page_id and url are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Listed keys at most: about 4 MB of filters.
MAX_LISTED = 1_000_000
#: Rates of false positives: the first level's at least and at most, and that of all others.
FIRST_RATE, LATER_RATE = (2.0**-30, 0.25), 0.25
MAX_LEVELS = 64

_U = np.uint64


@dataclass(frozen=True)
class Rule:
    action: str
    host: str
    path: str

    @property
    def key(self) -> str:
        return self.host + self.path


def _spread(x: np.ndarray, salt: int) -> np.ndarray:
    x = x ^ _U((salt * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@dataclass(frozen=True)
class Bloom:
    """A filter over pairs of 64-bit hashes."""

    bits: np.ndarray
    probes: int
    salt: int

    @staticmethod
    def of(keys: np.ndarray, rate: float, salt: int) -> Bloom:
        size = max(64, math.ceil(len(keys) * -math.log(rate) / math.log(2) ** 2))
        filter_ = Bloom(np.zeros(-(-size // 8), np.uint8), max(1, round(-math.log2(rate))), salt)
        for at in filter_.places(keys):
            np.bitwise_or.at(filter_.bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
        return filter_

    def places(self, keys: np.ndarray) -> Iterator[np.ndarray]:
        size = _U(8 * len(self.bits))
        first, step = _spread(keys[:, 0], self.salt), _spread(keys[:, 1], self.salt) | _U(1)
        for k in range(self.probes):
            yield ((first + _U(k) * step) % size).astype(np.int64)

    def test(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), bool)
        for at in self.places(keys):
            out &= (self.bits[at >> 3] >> (at & 7)) & 1 == 1
        return out


@dataclass(frozen=True)
class Cascade:
    levels: tuple[Bloom, ...]

    def contains(self, keys: np.ndarray) -> np.ndarray:
        """Whether each key is listed; exact for the keys of the list and of the corpus it was built over."""
        out, open_ = np.zeros(len(keys), bool), np.arange(len(keys))
        for k, level in enumerate(self.levels):
            passed = level.test(keys[open_])
            if k % 2:
                out[open_[~passed]] = True
            open_ = open_[passed]
        out[open_] = len(self.levels) % 2 == 1
        return out


def _pairs(first: pa.Array, second: pa.Array) -> np.ndarray:
    return np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for c in (first, second)])


def hashes(key: Column) -> tuple[Column, Column]:
    return F.xxhash64(key), F.xxhash64(F.lit("second"), key)


def _rows(keys: np.ndarray) -> set[bytes]:
    return {row.tobytes() for row in keys}


def build_cascade(listed: np.ndarray, universe: DataFrame, n: int | None = None) -> Cascade:
    """``listed``: pairs of hashes; ``universe``: the corpus's hashes (x, y), repeats allowed; ``n``: about how many."""
    if len(listed) > MAX_LISTED:
        raise ValueError(f"{len(listed)} listed keys; at most {MAX_LISTED} fit in a cascade: split the list by host or use a semi-join")
    if not len(listed):
        return Cascade(())
    listed = np.unique(listed, axis=0)
    n = universe.agg(F.approx_count_distinct("x")).first()[0] if n is None else n
    rate = min(max(0.5 * len(listed) / max(n, 1), FIRST_RATE[0]), FIRST_RATE[1])
    first = Bloom.of(listed, rate, 1)

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(first.test(_pairs(*batch.columns))))

    # about 1.5 times as many keys as are listed
    passed = universe.select("x", "y").mapInArrow(passing, "x long, y long").distinct().toArrow()
    keys, own = _pairs(passed.column("x").combine_chunks(), passed.column("y").combine_chunks()), _rows(listed)
    wrong = keys[[row.tobytes() not in own for row in keys]] if len(keys) else keys
    levels, inside, outside = [first], listed, wrong
    while len(outside):
        if len(levels) > MAX_LEVELS:
            raise RuntimeError("the cascade does not end")
        level = Bloom.of(outside, LATER_RATE, len(levels) + 1)
        levels.append(level)
        # the keys of the other kind that this level passes by mistake are what the next one encodes
        inside, outside = outside, inside[level.test(inside)]
    return Cascade(tuple(levels))


def host_and_path(url: Column) -> tuple[Column, Column]:
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    text = F.coalesce(url.cast("string"), F.lit(""))
    return F.translate(F.regexp_extract(text, pattern, 1), upper, lower), F.regexp_extract(text, pattern, 2)


def candidate_keys(host: Column, path: Column, rules: Iterable[Rule]) -> Column:
    """Keys that a fitting rule would have, longest first."""
    labels, sizes = sorted({r.host.count(".") + 1 for r in rules}), sorted({len(r.path) for r in rules})
    suffixes = [F.when((host != "") & (F.size(F.split(host, r"\.")) >= n), F.substring_index(host, ".", -n)) for n in labels]
    starts = [F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in sizes]
    keys = F.array(*(F.struct(F.length(F.concat(s, p)).alias("n"), F.length(s).alias("h"), F.concat(s, p).alias("key")) for s in suffixes for p in starts))
    keys = F.sort_array(F.filter(keys, lambda x: x["key"].isNotNull()), asc=False)
    return F.transform(keys, lambda x: x["key"])


def judge(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """page_id, host, path, rule (its key, or null) and verdict of every row."""
    if len({r.key for r in rules}) < len(rules):
        raise ValueError("two rules have the same host and path")
    host, path = host_and_path(F.col("url"))
    keyed = pages.select("page_id", host.alias("host"), path.alias("path"))
    keyed = keyed.withColumn("keys", candidate_keys(F.col("host"), F.col("path"), rules) if rules else F.array().cast("array<string>"))
    spark = pages.sparkSession
    universe = keyed.select(F.explode("keys").alias("key"))
    universe = universe.select(*(h.alias(c) for h, c in zip(hashes(F.col("key")), "xy", strict=True)))
    cascades, n = {}, universe.agg(F.approx_count_distinct("x")).first()[0]
    for action in ("allow", "block"):
        own = [(r.key,) for r in rules if r.action == action]
        found = spark.createDataFrame(own, "key string").select(*(h.alias(c) for h, c in zip(hashes(F.col("key")), "xy", strict=True))).toArrow()
        cascades[action] = build_cascade(_pairs(found.column("x").combine_chunks(), found.column("y").combine_chunks()), universe, n)

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, x, y = batch.columns[-3:]
            pairs = _pairs(x.flatten(), y.flatten())
            allow, block = (cascades[a].contains(pairs) for a in ("allow", "block"))
            ends = np.cumsum(np.diff(keys.offsets.to_numpy()))
            names = keys.flatten()
            hits = np.flatnonzero(allow | block)
            at = np.searchsorted(hits, np.concatenate(([0], ends[:-1])))
            rules_, verdicts = [], []
            for k, end in zip(at.tolist(), ends.tolist(), strict=True):
                hit = int(hits[k]) if k < len(hits) and hits[k] < end else None
                rules_.append(None if hit is None else names[hit].as_py())
                verdicts.append("allow" if hit is None or allow[hit] else "block")
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(rules_, pa.string()), pa.array(verdicts, pa.string())], ["page_id", "host", "path", "rule", "verdict"])

    x, y = F.transform("keys", lambda k: hashes(k)[0]), F.transform("keys", lambda k: hashes(k)[1])
    kind = dict(keyed.dtypes)["page_id"]
    return keyed.select("page_id", "host", "path", "keys", x.alias("x"), y.alias("y")).mapInArrow(
        look_up, f"page_id {kind}, host string, path string, rule string, verdict string"
    )


def oracle_sql(rules: list[Rule]) -> str:
    values = ", ".join(f"('{r.action}', '{r.host}', '{r.path}')" for r in rules)
    pattern = "(?s)^.*?://([^/?#]*)([^?#]*)"
    return f"""
with parsed as (
  select page_id,
    translate(regexp_extract(coalesce(url, ''), '{pattern}', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(coalesce(url, ''), '{pattern}', 2) as path
  from pages
), fitting as (
  select page_id, arg_max(rule, n) as rule, arg_max(action, n) as verdict
  from (
    select p.page_id, r.action, r.h || r.p as rule, length(r.h || r.p) * 1000 + length(r.h) as n
    from (select distinct page_id, host, path from parsed) p
    join (values {values}) r(action, h, p) on (p.host = r.h or ends_with(p.host, '.' || r.h)) and starts_with(p.path, r.p)
  ) group by page_id
)
select p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') as verdict
from parsed p left join fitting f using (page_id)
"""
