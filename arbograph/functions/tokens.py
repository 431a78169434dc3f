"""Tokens by a tokenizer's file: counts and cuts as column functions, for operators that take ``count``.

The file, one of the ``tokenizers`` library, is read by the driver and sent to the
tasks; workers load it once.  Equal texts of a batch are counted once.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

Counter = Callable[[Column], Column]
_LOADED: dict = {}


def _loaded(data: str):
    from tokenizers import Tokenizer

    key = zlib.crc32(data.encode())
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Tokenizer.from_str(data)
        _LOADED[key].encode_special_tokens = True
    return _LOADED[key]


def _ids(tokenizer, text: str) -> list[int]:
    return tokenizer.encode(text, add_special_tokens=False).ids


def token_counter(spark: SparkSession, path: str) -> Counter:
    """A function from a column of texts to their numbers of tokens, 0 for null."""
    with open(path, encoding="utf-8") as f:
        sent = spark.sparkContext.broadcast(f.read())

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        tokenizer, known = _loaded(sent.value), texts.fillna("")
        distinct = known.unique().tolist()
        found = {t: len(e.ids) for t, e in zip(distinct, tokenizer.encode_batch(distinct, add_special_tokens=False), strict=True)}
        return known.map(found).astype("int64")

    return count


def token_cutter(spark: SparkSession, path: str, marker: str = "\n[...truncated...]") -> Callable[[Column, int], Column]:
    """A function that cuts texts to the longest beginning of at most so many tokens, by bisection, and marks what it cut."""
    with open(path, encoding="utf-8") as f:
        sent = spark.sparkContext.broadcast(f.read())

    def cutter(text: Column, limit: int) -> Column:
        @F.pandas_udf("string")
        def cut(texts: pd.Series) -> pd.Series:
            tokenizer = _loaded(sent.value)

            def one(t: str | None) -> str | None:
                if t is None:
                    return None
                found = tokenizer.encode(t, add_special_tokens=False)
                if len(found.ids) <= limit:
                    return t
                size = lru_cache(None)(lambda n: len(_ids(tokenizer, t[:n])))
                # near the end of the last token that fits; a cut may join or part tokens around it
                near = found.offsets[limit - 1][1] if limit else 0
                low, high = max(near - 64, 0), min(near + 64, len(t))
                at = bisect.bisect_right(range(low, high + 1), limit, key=size) - 1 if size(low) <= limit else -1
                return t[: low + at if at >= 0 else bisect.bisect_right(range(low + 1), limit, key=size) - 1] + marker

            return texts.map(one)

        return cut(text)

    return cutter
