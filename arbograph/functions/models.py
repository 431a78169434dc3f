"""Language models and embedders behind small interfaces, with deterministic stand-ins.

A client is any object with ``chat(prompt)``, which gives a text or a ``Reply``;
an embedder has ``embed(texts) -> list of vectors``.  They are sent to the tasks and
called in batches.  Only errors of the client's side become failed answers, with
their reason; any other error of a client's code fails the job.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from arbograph.session import materialise


@dataclass(frozen=True)
class Reply:
    """``finished`` is false if the text ended at the longest that a model gives."""

    text: str
    finished: bool = True


class Client(Protocol):
    def chat(self, prompt: str) -> str | Reply: ...


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> list[list[float]]: ...


class ModelError(RuntimeError):
    pass


#: What a client may raise when its service doesn't answer.
CLIENT_ERRORS = (ModelError, OSError)
FINISHED, LENGTH, FAILED = "finished", "length", "failed"
GO_ON = "Go on with this answer, without repeating any of it."


class Retrying:
    """Calls a client again after failures, waiting 2, 4, 8, ... seconds, a minute at most."""

    def __init__(self, client: Client, tries: int = 15, sleep: Callable[[float], None] = time.sleep) -> None:
        self.client, self.tries, self.sleep = client, tries, sleep

    def chat(self, prompt: str) -> str | Reply:
        for k in range(self.tries):
            try:
                return self.client.chat(prompt)
            except Exception as e:
                if k + 1 == self.tries:
                    raise ModelError(f"no answer after {self.tries} tries") from e
                self.sleep(min(2.0 ** (k + 1), 60.0))
        raise ModelError("no tries")


class FirstSentence:
    """Answers with the first sentence of the prompt's last part, but for a list of concepts at its end."""

    def chat(self, prompt: str) -> str:
        text = prompt.split("\n## Related Concepts\n")[0].strip()
        return text.rsplit("\n\n", 1)[-1].split(". ")[0][:200]


class HashEmbedder:
    """Unit vectors from hashes of a text's words."""

    def __init__(self, size: int = 64) -> None:
        self.size = size

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            vector = [0.0] * self.size
            for word in text.lower().split():
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                vector[h % self.size] += 1.0 if h >> 63 else -1.0
            norm = sum(x * x for x in vector) ** 0.5
            out.append([x / norm for x in vector] if norm else vector)
        return out


def replies(rows: DataFrame, prompt: Column, client: Client) -> DataFrame:
    """``rows`` with ``answer``, ``status`` (finished, length or failed) and ``reason``.

    A failed answer is null and has a reason; a null prompt isn't sent.
    """
    schema = StructType([f for f in rows.schema if f.name not in ("answer", "status", "reason")])
    asked = rows.select(*(F.col(f"`{f.name}`") for f in schema), prompt.alias("_prompt"))

    def ask(text: str | None) -> tuple[str | None, str, str | None]:
        if text is None:
            return None, FAILED, "no prompt"
        try:
            found = client.chat(text)
        except CLIENT_ERRORS as e:
            return None, FAILED, f"{type(e).__name__}: {e}"
        if isinstance(found, Reply):
            return found.text, FINISHED if found.finished else LENGTH, None
        return found, FINISHED, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [ask(text.as_py()) for text in batch.columns[-1]]
            told = [pa.array([r[k] for r in found], pa.string()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *told], [*batch.schema.names[:-1], "answer", "status", "reason"])

    out = StructType(schema.fields[:])
    for name in ("answer", "status", "reason"):
        out = out.add(name, StringType())
    return asked.mapInArrow(run, out)


def long_replies(rows: DataFrame, prompt: Column, client: Client, rounds: int = 5) -> DataFrame:
    """As ``replies``, where answers that ended by length go on, at most ``rounds`` times, and ``calls`` counts the calls.

    Each round asks only for what is still open and is stored.  What is open
    after the last has the status length; one that fails on the way keeps what
    it had.
    """
    asked = rows.withColumn("_first", prompt)
    state = materialise(replies(asked, F.col("_first"), client).withColumn("calls", F.lit(1)), "replies")
    done = state.filter(F.col("status") != LENGTH)
    for _ in range(rounds):
        state = state.filter(F.col("status") == LENGTH)
        if state.isEmpty():
            return done.drop("_first")
        more = replies(state.withColumnRenamed("answer", "_before"), F.concat_ws("\n\n", "_first", F.lit(GO_ON), "_before"), client)
        more = more.withColumns({"answer": F.concat("_before", F.coalesce("answer", F.lit(""))), "calls": F.col("calls") + 1})
        state = materialise(more.select(*done.columns), "replies")
        done = done.unionByName(state.filter(F.col("status") != LENGTH))
    return done.unionByName(state.filter(F.col("status") == LENGTH)).drop("_first")


def answers(rows: DataFrame, prompt: Column, client: Client, column: str = "answer", default: str = "") -> DataFrame:
    """``rows`` with the client's answer to each prompt, or ``default`` where it fails."""
    found = replies(rows, prompt, client)
    kept = [c for c in rows.columns if c not in (column, "answer", "status", "reason")]
    return found.select(*(F.col(f"`{c}`") for c in kept), F.coalesce("answer", F.lit(default)).alias(column))


def embeddings(rows: DataFrame, text: str, embedder: Embedder, column: str = "embedding") -> DataFrame:
    """``rows`` with the vector of each text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(**{column: embedder.embed([t or "" for t in batch[text]])})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInPandas(run, f"{schema}, {column} array<float>")


# Words that tell a question's intent, in the order in which they are tried.
INTENT_WORDS = (
    ("COMPARISON", ("compare", "versus", " vs ", "difference between", "differ")),
    ("TEMPORAL", ("changed", "previous version", "over time", "since", "history")),
    ("RELATIONSHIP", ("related", "relationship", "connect", "between", "linked")),
    ("HIERARCHICAL", ("subsection", "section", "chapter", "under ", "structure")),
    ("LOOKUP", ("what is", "who is", "define", "where is", "when was")),
)


def intent(question: Column) -> Column:
    """The first intent one of whose words a question contains, else EXPLORATION."""
    text = F.concat(F.lit(" "), F.lower(F.coalesce(question, F.lit(""))), F.lit(" "))
    out = None
    for name, words in INTENT_WORDS:
        hit = F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(text, w))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("EXPLORATION")
