"""Token counts of a unigram model by dynamic programming shared along a trie.

Texts are split at white space; each run, with a mark before it, is a
pre-token.  The pre-tokens that a batch adds are walked in the order of their
trie, depth first: the best score and its number of tokens are computed once
for each prefix and shared by all pre-tokens that begin with it, and the count
at the end of a pre-token is stored.  A text's count is the sum over its
pre-tokens.  Workers keep the stored counts of bounded tables between batches.

The pieces are those of a vocabulary file, which is not trained here; a piece's
log-probability follows from its rank by Zipf's rule.  A character that is no
piece costs one token for each of its UTF-8 bytes.

Defined results: null and empty texts have no tokens; a tie between
segmentations goes to fewer tokens; repeated rows are counted alike; an empty
table gives no rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: Added to a rank before its logarithm is taken.
ZIPF_SHIFT = 2.7
#: Log-probability of one byte of an unknown character.
BYTE_SCORE = -25.0
#: Stored counts before a new table is begun; the last full one is kept beside it.
CACHE_WORDS = 400_000
#: Bytes of text that are counted at a time.
CHUNK_BYTES = 2_000_000


def vocabulary(path: str) -> list[str]:
    """The pieces of a SentencePiece file in order of rank, without control and byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_proto=Path(path).read_bytes())
    return [model.id_to_piece(k) for k in range(model.vocab_size()) if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k) or model.is_unused(k))]


class UnigramTrie:
    """Token counts of pre-tokens."""

    def __init__(self, pieces: Iterable[str]) -> None:
        self.scores = {p: -math.log(rank + ZIPF_SHIFT) for rank, p in enumerate(pieces)}
        self.longest = max(map(len, self.scores), default=1)
        self.counts: dict[str, int] = {}
        self.older: dict[str, int] = {}

    def walk(self, words: Iterable[str]) -> Iterator[tuple[str, int]]:
        """Each word with its count; words in sorted order share the work on common prefixes."""
        scores, longest = self.scores, self.longest
        best, count, last = [0.0], [0], ""
        for word in sorted(words):
            node = MARK + word
            shared, limit = 0, min(len(node), len(last))
            while shared < limit and node[shared] == last[shared]:
                shared += 1
            del best[shared + 1 :], count[shared + 1 :]
            for end in range(shared + 1, len(node) + 1):
                size = len(node[end - 1].encode("utf-8", "surrogatepass"))
                top, n = best[end - 1] + BYTE_SCORE * size, count[end - 1] + size
                for start in range(max(0, end - longest), end):
                    score = scores.get(node[start:end])
                    if score is not None:
                        score += best[start]
                        if score > top or (score == top and count[start] + 1 < n):
                            top, n = score, count[start] + 1
                best.append(top)
                count.append(n)
            last = node
            yield word, count[-1]

    def count(self, texts: list[str]) -> list[tuple[int, int]]:
        """Pre-tokens and tokens of each text."""
        found = [t.split() for t in texts]
        if len(self.counts) > CACHE_WORDS:
            self.older, self.counts = self.counts, {}
        counts, older = self.counts, self.older
        missing = set().union(*found) - counts.keys()
        for word in missing & older.keys():
            counts[word] = older[word]
        counts.update(self.walk(missing - older.keys()))
        get = counts.__getitem__
        return [(len(words), sum(map(get, words))) for words in found]


_LOADED: dict[int, UnigramTrie] = {}


def _loaded(pieces: str) -> UnigramTrie:
    key = zlib.crc32(pieces.encode())
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = UnigramTrie(pieces.split("\n"))
    return _LOADED[key]


def count_tokens(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """doc_id, n_pretokens and n_tokens of every row of ``docs``."""
    pieces = docs.sparkSession.sparkContext.broadcast("\n".join(vocabulary(vocabulary_path)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = _loaded(pieces.value)
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()
            low = total = 0
            for k, size in enumerate(sizes):
                total += size
                if total >= CHUNK_BYTES or k + 1 == len(sizes):
                    part = batch.slice(low, k + 1 - low)
                    found = trie.count([t or "" for t in part.column(1).to_pylist()])
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0), pa.array([n for n, _ in found], pa.int64()), pa.array([n for _, n in found], pa.int64())],
                        ["doc_id", "n_pretokens", "n_tokens"],
                    )
                    low, total = k + 1, 0

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_pretokens long, n_tokens long")
