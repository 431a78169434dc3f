"""Best-two-fit packing of tokenised documents into fixed-length sequences.

Documents are tokenised once, in Arrow batches, into pieces of at most
``capacity`` tokens; only documents longer than that are cut.  Full pieces are
sequences of their own.  A shard is a run of a bounded number of consecutive
documents, in the order of the files and of the rows within them, and the other
pieces of each shard are packed by best-two-fit: a bin is
filled greedily with the longest piece that fits, then its smallest piece is
replaced by the two unpacked pieces that fill the expanded gap most tightly.
A shard leaves at most a few bins part-filled, so the loss against packing all
pieces together is a few bins in some thousands.

Sequence ids rise with the place of a sequence's earliest document, so the order
of a mixture holds among the sequences but for stretches of one shard.

Defined results: a null text counts as empty and still holds the end id; rows
that repeat are packed as often as they occur; an empty table gives no rows;
columns other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from collections.abc import Iterator, Sequence
from itertools import accumulate
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbograph.session import materialise

CAPACITY = 2048
END_ID = 0
#: Consecutive documents of a shard, each of which has one part-filled piece at most: what one task holds while it packs.
SHARD_ROWS = 8192
#: Lower bits of a sequence id: 0 for a bin, else one more than the piece.  The upper ones are the earliest document's place.
PIECE_BITS = 26
#: Runs and words whose ids a worker keeps before it starts a new table; what the last full one holds moves over as it is met.
CACHE_RUNS = 300_000
#: What is set apart by spaces before a text is split at them: marks and the short forms after an apostrophe.
MARKS = r"('s|'t|'re|'ve|'m|'ll|'d|[^\x09-\x0d\x20\x{85}\x{a0}\pL\pN]+)"
#: Texts that go to the library as a whole: characters from U+0300 on, those whose lower case is two, separators that only Python splits at, special tokens.
OTHER = r"[^\x00-\x1b\x20-\x{012f}\x{0131}-\x{02ff}]|<\|"
#: Words that are encoded as one text.
RUN_WORDS = 200
#: Documents of an Arrow batch.
BATCH_ROWS = 1_000
#: Bytes of text that are encoded at a time.
CHUNK_BYTES = 2_000_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, _place long"


class WordTokenizer:
    """Ids of whole texts by a word-level BPE file of ``tokenizers``.

    The file's rules split a text at white space and each run between into
    words that are encoded independently, so the ids of a run are looked up
    once, and those of words when a new run is met.  That holds for characters
    below U+0300, where normal form C changes nothing; other texts, and texts
    that may hold a special token, go to the library as a whole.
    """

    def __init__(self, spec: str) -> None:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_str(spec)
        vocabulary = self.library.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[k for token, k in vocabulary.items() if token.endswith("</w>")]] = True
        of = lambda kind: "".join(f"\\u{c:04x}" for c in range(0x300) if unicodedata.category(chr(c))[0] == kind)
        letters, digits = of("L"), of("N")
        spaces = "\\x09-\\x0d\\x20\\x85\\xa0"
        self.words = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{digits}]|[^{spaces}{letters}{digits}]+")
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4")

    def learn(self, missing: list[str]) -> dict[str, bytes]:
        """Ids of words not seen yet: many are encoded as one text, and its ids cut after those that end a word."""
        learned: dict[str, bytes] = {}
        runs = [missing[k : k + RUN_WORDS] for k in range(0, len(missing), RUN_WORDS)]
        for words, found in zip(runs, self.library.encode_batch_fast([" ".join(x) for x in runs], add_special_tokens=False), strict=True):
            ids = np.array(found.ids, "<u4")
            cuts = [0, *(np.flatnonzero(self.ends[ids]) + 1).tolist()]
            data = ids.tobytes()
            if len(cuts) == len(words) + 1 and cuts[-1] == len(ids):
                for word, start, end in zip(words, cuts, cuts[1:], strict=False):
                    learned[word] = data[4 * start : 4 * end]
            else:
                for word in words:
                    learned[word] = self.whole(word).tobytes()
        return learned

    def look_up(self, wanted: list[str]) -> list[bytes | None]:
        """The tables' ids of each; what only the older one holds is entered in the new one."""
        found = list(map(self.cache.get, wanted))
        for k in [k for k, x in enumerate(found) if x is None]:
            if (data := self.older.get(wanted[k])) is not None:
                found[k] = self.cache[wanted[k]] = data
        return found

    def runs(self, wanted: list[str]) -> list[bytes]:
        """The ids of runs without white space: words as a rule, else split into words."""
        if len(self.cache) > CACHE_RUNS:
            self.older, self.cache = self.cache, {}
        found = self.look_up(wanted)
        new = [x for x, data in zip(wanted, found, strict=True) if data is None]
        split = {x: self.words.findall(x) for x in new if not x.isalpha()}
        words = list({x for x in new if x not in split}.union(*split.values()))
        known = self.look_up(words)
        ids = {w: x for w, x in zip(words, known, strict=True) if x is not None}
        learned = self.learn([w for w, x in zip(words, known, strict=True) if x is None])
        ids |= learned
        ids |= {x: b"".join([ids[w] for w in parts]) for x, parts in split.items()}
        self.cache |= ids
        return [ids[x] if data is None else data for x, data in zip(wanted, found, strict=True)]

    def encode(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in order, as little-endian unsigned 32-bit numbers, and the number of each text's.

        Equal runs are found by Arrow, so each is looked up once, and ids are
        gathered for all at once.
        """
        texts = pc.fill_null(pa.array(texts).cast(pa.large_string()), "")
        odd = pc.match_substring_regex(texts, pattern=OTHER)
        spaced = pc.replace_substring_regex(pc.utf8_lower(pc.if_else(odd, "", texts)), pattern=MARKS, replacement=r" \1 ")
        parts = pc.utf8_split_whitespace(spaced)
        coded = parts.flatten().dictionary_encode()
        known = self.runs(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        size = np.fromiter(map(len, known), np.int64, len(known)) // 4
        flat = np.frombuffer(b"".join(known), "<u4")
        code = coded.indices.to_numpy(zero_copy_only=False)
        length = size[code]
        end = np.cumsum(length)
        shift = (np.cumsum(size) - size)[code] - (end - length)
        ids = flat[np.repeat(shift, length) + np.arange(len(shift) and end[-1])]
        bounds = np.concatenate(([0], end))[parts.offsets.to_numpy()]
        counts = np.diff(bounds)
        strange = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        if len(strange):  # their ids go where the others leave nothing
            own = [self.whole(texts[int(k)].as_py()) for k in strange]
            counts[strange] = [len(x) for x in own]
            ids = np.insert(ids, np.repeat(bounds[strange], counts[strange]), np.concatenate(own))
        return ids, counts


_LOADED: dict[int, WordTokenizer] = {}


def loaded(spec: str) -> WordTokenizer:
    """The tokenizer that this worker keeps, with what it has looked up."""
    key = zlib.crc32(spec.encode())
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = WordTokenizer(spec)
    return _LOADED[key]


def chunks(texts: pa.Array, size: int) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts of about ``size`` bytes."""
    start = total = 0
    for k, n in enumerate(pc.binary_length(texts).to_pylist()):
        total += n or 0
        if total >= size:
            yield start, k + 1
            start, total = k + 1, 0
    if start < len(texts):
        yield start, len(texts)


def placed(docs: DataFrame) -> DataFrame:
    """doc_id, text and _place: a row's number from 0, by the names of the files and the rows within them.

    Scans deal files to tasks by size, so the order is taken from the files
    themselves.  Rows that aren't those of whole files are stored first.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    where = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_index")]

    def counted(rows: DataFrame) -> list:
        files = rows.select(*where).groupBy("_file").agg(F.count("*").alias("n"), F.min("_index").alias("low"), F.max("_index").alias("high"), F.sum("_index").alias("total"))
        return sorted(files.collect(), key=lambda r: (len(r["_file"]), r["_file"]))

    try:
        files = counted(own)
    except AnalysisException:  # not read from files
        files = None
    if files is None or any(r["low"] or r["high"] != r["n"] - 1 or 2 * r["total"] != r["n"] * r["high"] for r in files):
        own = materialise(own, "documents")
        files = counted(own)
    starts = accumulate((r["n"] for r in files), initial=0)
    before = docs.sparkSession.createDataFrame([(r["_file"], start) for r, start in zip(files, starts, strict=False)], "_name string, _before long")
    rows = own.select("doc_id", "text", *where)
    return rows.join(F.broadcast(before), F.col("_file") == F.col("_name")).select("doc_id", "text", (F.col("_before") + F.col("_index")).alias("_place"))  # a row a file


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of at most ``capacity`` ids of every document, its end id included, with the document's place.

    The tokenizer file is read on the driver and sent along; its size is that
    of a vocabulary.
    """
    spec = docs.sparkSession.sparkContext.broadcast(Path(tokenizer_path).read_text())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = loaded(spec.value)
        for batch in batches:
            for low, high in chunks(batch.column(1), CHUNK_BYTES):
                ids, texts, places = (c.slice(low, high - low) for c in batch.columns)
                flat, counts = tokenizer.encode(texts)
                ends = np.cumsum(counts)
                flat = np.insert(flat, ends, END_ID).astype("<u4")
                counts += 1
                pieces = -(-counts // capacity)
                row = np.repeat(np.arange(len(counts)), pieces)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = piece * capacity
                length = np.minimum(capacity, counts[row] - start)
                data, at = memoryview(flat.tobytes()), 4 * ((np.cumsum(counts) - counts)[row] + start)
                sums = [zlib.crc32(data[a : a + n]) for a, n in zip(at.tolist(), (4 * length).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(sums, pa.int64()), places.take(pa.array(row))],
                    ["doc_id", "piece", "start", "length", "ids_crc32", "_place"],
                )

    return placed(docs).mapInArrow(cut, PIECES)


def best_two_fit(lengths: Sequence[int], capacity: int) -> list[list[int]]:
    """Bins of positions in ``lengths``; each length is from 1 to capacity.

    ``below[x]`` is the longest unpacked length of at most x, so both the
    greedy step and the partner of each half of a pair are one look-up.
    """
    sizes = np.asarray(lengths, np.int64)
    order = np.argsort(-sizes, kind="stable")
    stacks: dict[int, list[int]] = {}
    for k in order[::-1].tolist():
        stacks.setdefault(int(sizes[k]), []).append(k)
    counts = np.bincount(sizes, minlength=capacity + 1)
    below = np.maximum.accumulate(np.where(counts > 0, np.arange(capacity + 1), 0))

    def take(x: int) -> int:
        counts[x] -= 1
        if counts[x] == 0:
            below[x : x + np.searchsorted(below[x:], x, side="right")] = below[x - 1]
        return stacks[x].pop()

    def put_back(x: int, k: int) -> None:
        counts[x] += 1
        if counts[x] == 1:
            below[x : x + np.searchsorted(below[x:], x, side="left")] = x
        stacks[x].append(k)

    bins: list[list[int]] = []
    left = len(sizes)
    while left:
        gap, own = capacity, []
        while gap and (x := int(below[gap])):
            own.append((x, take(x)))
            gap -= x
        if gap and len(own) > 1:
            smallest, k = own[-1]
            room = gap + smallest
            first = np.flatnonzero(counts[:room])
            second = below[room - first]
            second = np.where((second == first) & (counts[first] < 2), below[first - 1], second)
            both = np.where(second > 0, first + second, 0)
            if both.size and int(both.max()) > smallest:
                best = int(both.argmax())
                put_back(smallest, k)
                own[-1:] = [(int(x), take(int(x))) for x in (first[best], second[best])]
        bins.append([k for _, k in own])
        left -= len(own)
    return bins


def pack(pieces: DataFrame, capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``sequence_id`` and ``offset`` instead of ``_place`` for pieces with a ``length`` from 1 to capacity.

    A document's pieces share its place and have numbers in ``piece``; no two
    documents share one.  At most one of them is shorter than the capacity.
    """
    own = [c for c in pieces.columns if c != "_place"]
    full = pieces.filter(F.col("length") >= capacity).select(
        *own, (F.shiftleft("_place", PIECE_BITS) + F.col("piece") + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    partial = pieces.filter(F.col("length") < capacity)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.select(*own).schema)

    def pack_shard(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("_place", "ascending")])
        sizes, places = table.column("length").to_numpy(), table.column("_place").to_numpy()
        bins = best_two_fit(sizes, capacity)
        sequence, offset = np.empty(table.num_rows, np.int64), np.empty(table.num_rows, np.int64)
        for members in bins:
            at, first = 0, int(places[members].min()) << PIECE_BITS
            for k in members:
                sequence[k], offset[k] = first, at
                at += int(sizes[k])
        return table.select(own).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    packed = (
        partial.withColumn("_shard", F.floor(F.col("_place") / shard_rows))
        .groupBy("_shard")
        .applyInArrow(pack_shard, f"{schema}, sequence_id long, offset long")
    )
    return full.unionByName(packed)


def pack_documents(
    docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of ``docs``."""
    return pack(materialise(token_pieces(docs, tokenizer_path, capacity), "pieces", BATCH_ROWS), capacity, shard_rows)
