"""A log of what each step of a run took in, gave out and left out: one row of JSON a step.

Rows are counted by Spark while a step writes them, so a count costs no further
scan.  Within ``RunLog.step`` the frames that go through ``counted`` are counted;
outside of a step ``counted`` gives its frame back as it is, so operators may
call it whether or not a run is logged.

Defined results: a count is null where the step counts no such rows, and 0 where
Spark has left a counted frame out as it has none; a frame that is written
several times within a step has the count of the last; a step that raises has the
error in its row, null counts, and raises on.
"""

from __future__ import annotations

import datetime
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

SCHEMA = "run string, place int, step string, started timestamp, seconds double, rows_in long, rows_out long, rejected long, error string"
_STEP: ContextVar[Step | None] = ContextVar("step", default=None)


class Step:
    """Counts of one step, some of which are known when it begins."""

    def __init__(self, **known: int | None) -> None:
        self.known = known
        self.seen: dict[str, tuple[Observation, str]] = {}
        self.counts: dict[str, int | None] = {}

    def close(self) -> None:
        self.counts = dict.fromkeys(("rows_in", "rows_out", "rejected")) | self.known
        for label, (observation, name) in self.seen.items():
            self.counts[label] = _value(observation, name)
        if self.counts["rejected"] is None and None not in (self.counts["rows_in"], self.counts["rows_out"]):
            self.counts["rejected"] = max(self.counts["rows_in"] - self.counts["rows_out"], 0)

    def __getitem__(self, label: str) -> int | None:
        return self.counts[label]


def _value(observation: Observation, name: str) -> int:
    from py4j.protocol import Py4JJavaError

    try:
        return observation.get[name]
    except Py4JJavaError as e:  # no row was observed: the plan had no rows there and the frame was left out
        if "AssertionError" not in str(e.java_exception):
            raise
        return 0


def counted(df: DataFrame, label: str, rejected: Column | None = None) -> DataFrame:
    """``df``, counted as ``label`` by the step in progress when it is written, and those of its rows that are ``rejected``.

    Call it on what is about to be written or appended: rows that a join drops
    later on are counted, and a frame that joins nothing may count as empty.
    """
    step = _STEP.get()
    if step is None:
        return df
    observation = Observation()
    metrics = [F.count(F.lit(1)).alias(label)]
    step.seen[label] = (observation, label)
    if rejected is not None:
        metrics.append(F.count_if(rejected).alias("rejected"))
        step.seen["rejected"] = (observation, "rejected")
    return df.observe(observation, *metrics)


class RunLog:
    """``path``: a folder of JSON rows that any number of runs share, or None for a log that is kept nowhere."""

    def __init__(self, spark: SparkSession, path: str | None) -> None:
        self.spark, self.path, self.run, self.steps = spark, path, uuid.uuid4().hex, 0

    @contextmanager
    def step(self, name: str, **known: int | None) -> Iterator[Step]:
        step = Step(**known)
        if self.path is None:
            step.counts = dict.fromkeys(("rows_in", "rows_out", "rejected")) | known
            yield step
            return
        self.steps += 1
        started, clock = datetime.datetime.now(datetime.timezone.utc), time.monotonic()
        held = _STEP.set(step)
        try:
            yield step
        except Exception as e:
            self._write(name, started, clock, dict.fromkeys(("rows_in", "rows_out", "rejected")), f"{type(e).__name__}: {e}")
            raise
        finally:
            _STEP.reset(held)
        step.close()
        self._write(name, started, clock, step.counts, None)

    def _write(self, name: str, started: datetime.datetime, clock: float, counts: dict, error: str | None) -> None:
        row = (self.run, self.steps, name, started, time.monotonic() - clock, counts["rows_in"], counts["rows_out"], counts["rejected"], error)
        self.spark.createDataFrame([row], SCHEMA).coalesce(1).write.mode("append").json(self.path)

    @staticmethod
    def read(spark: SparkSession, path: str) -> DataFrame:
        return spark.read.schema(SCHEMA).json(path)
