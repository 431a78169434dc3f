"""Tables of contents, section trees and pages, as flat rows with an explicit order.

A table of contents is (doc_id, ord, structure, title, physical_index[,
appear_start]); pages are (doc_id, page_no, text).
"""

from __future__ import annotations

import bisect
import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arbograph.session import materialise

from arbograph.functions.text import estimated_tokens, page_tag, parent_code, zero_padded
from arbograph.operators.hierarchy import walks


def _in_order():
    return Window.partitionBy("doc_id").orderBy("ord")


def page_list(docs: DataFrame, count: Callable[[Column], Column] = estimated_tokens) -> DataFrame:
    """Pages of documents (doc_id, text): their lines, with their tokens."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("k", "text"))
    return lines.select("doc_id", (F.col("k") + 1).alias("page_no"), "text", count(F.col("text")).alias("tokens"))


def document_totals(pages: DataFrame) -> DataFrame:
    return pages.groupBy("doc_id").agg(F.count("*").alias("total_pages"), F.sum("tokens").alias("total_tokens"))


def toc_preface(toc: DataFrame) -> DataFrame:
    """A first entry "Preface" on page 1 for documents whose contents begin later."""
    first = toc.groupBy("doc_id").agg(F.min_by("physical_index", "ord").alias("first"), F.min("ord").alias("ord"))
    added = first.filter("first > 1").select("doc_id", (F.col("ord") - 1).alias("ord"), F.lit("0").alias("structure"), F.lit("Preface").alias("title"), F.lit(1).alias("physical_index"))
    return toc.select("doc_id", "ord", "structure", "title", "physical_index").unionByName(added)


def toc_validate(toc: DataFrame, totals: DataFrame, start: int = 1) -> DataFrame:
    """physical_index is null where it lies behind the last page."""
    joined = toc.join(totals.select("doc_id", "total_pages"), "doc_id", "left")
    valid = F.when(F.col("physical_index") <= F.col("total_pages") + start - 1, F.col("physical_index"))
    return joined.withColumn("physical_index", valid).drop("total_pages")


def section_spans(toc: DataFrame, totals: DataFrame) -> DataFrame:
    """start_index and end_index of the entries with a page of the document.

    An entry ends where the next begins, or a page before if that one starts
    its page; the last ends with the document.
    """
    joined = toc.join(totals.select("doc_id", "total_pages"), "doc_id").filter("physical_index between 1 and total_pages")
    appears = F.col("appear_start") if "appear_start" in toc.columns else F.lit(None).cast("string")
    marked = joined.withColumn("_a", appears)
    following = F.lead("physical_index").over(_in_order())
    end = F.when(F.lead("_a").over(_in_order()) == "yes", following - 1).otherwise(following)
    spans = marked.withColumn("end_index", F.coalesce(end, F.col("total_pages")).cast("int"))
    return spans.select("doc_id", "ord", "structure", "title", F.col("physical_index").alias("start_index"), "end_index")


def toc_parents(toc: DataFrame) -> DataFrame:
    """parent_ord: the last earlier entry whose code is the entry's own without its last part; null for roots."""
    c = toc.select("doc_id", "ord", "structure", "title", parent_code(F.col("structure")).alias("parent_code"))
    p = toc.select("doc_id", F.col("structure").alias("parent_code"), F.col("ord").alias("p"))
    found = c.join(p, ["doc_id", "parent_code"]).filter("p < ord").groupBy("doc_id", "ord").agg(F.max("p").alias("parent_ord"))
    return c.drop("parent_code").join(found, ["doc_id", "ord"], "left")


def section_depth(tree: DataFrame) -> DataFrame:
    """Depth of every entry of ``tree`` (doc_id, ord, parent_ord); roots have 0."""
    key = lambda c: F.concat_ws("/", "doc_id", c)
    up = tree.filter("parent_ord is not null").select(key("ord").alias("parent"), key("parent_ord").alias("child"))
    depth = walks(up).groupBy("start").agg(F.max("level").alias("depth"))
    return tree.withColumn("start", key("ord")).join(depth, "start", "left").drop("start").withColumn("depth", F.coalesce("depth", F.lit(0)))


def leaf_nodes(tree: DataFrame) -> DataFrame:
    parents = tree.filter("parent_ord is not null").select("doc_id", F.col("parent_ord").alias("ord")).distinct()
    return tree.join(parents, ["doc_id", "ord"], "left_anti")


def node_ids(toc: DataFrame, start: int = 0) -> DataFrame:
    """Numbers entries in their order, with four digits or more."""
    return toc.withColumn("node_id", zero_padded(F.row_number().over(_in_order()) - 1 + start))


def toc_gap_bounds(toc: DataFrame) -> DataFrame:
    """For entries without a page the nearest pages before (else 0) and after (else -1)."""
    before = F.last("physical_index", True).over(_in_order().rowsBetween(Window.unboundedPreceding, -1))
    after = F.first("physical_index", True).over(_in_order().rowsBetween(1, Window.unboundedFollowing))
    out = toc.withColumn("before", F.coalesce(before, F.lit(0))).withColumn("after", F.coalesce(after, F.lit(-1)))
    return out.filter("physical_index is null").select("doc_id", "ord", "title", "before", "after")


def toc_matching_pairs(printed: DataFrame, found: DataFrame, start: int = 1) -> DataFrame:
    """Entries of both lists (doc_id, ord, title, page / physical_index) with equal titles, from page ``start`` on."""
    right = found.select("doc_id", "title", "physical_index").filter(F.col("physical_index") >= start)
    return printed.select("doc_id", "ord", "title", "page").join(right, ["doc_id", "title"])


def page_offset(pairs: DataFrame) -> DataFrame:
    """The commonest difference of physical and printed page; of equally common ones the first met."""
    diffs = pairs.withColumn("page_offset", F.col("physical_index") - F.col("page")).groupBy("doc_id", "page_offset").agg(F.count("*").alias("n"), F.min("ord").alias("first"))
    return diffs.groupBy("doc_id").agg(F.min_by("page_offset", F.struct(-F.col("n"), "first", "page_offset")).alias("page_offset"))


def with_offset(printed: DataFrame, offsets: DataFrame) -> DataFrame:
    return printed.join(offsets, "doc_id").withColumn("physical_index", F.col("page") + F.col("page_offset"))


def toc_accuracy(checked: DataFrame) -> DataFrame:
    """Share of right entries of (doc_id, correct); 0 if none was checked."""
    return checked.groupBy("doc_id").agg(F.coalesce(F.avg(F.when(F.col("correct").isNotNull(), F.col("correct").cast("double"))), F.lit(0.0)).alias("accuracy"))


#: Ways of finding a document's contents, each of which follows the one before where that fails.
WAYS = ("toc_with_page_numbers", "toc_without_page_numbers", "no_toc")
#: Above this share of right entries the others are fixed one by one.
FIXABLE = 0.6


def toc_decision(accuracy: Column, way: Column) -> Column:
    """What follows a check: accept, fix, the next way of finding contents, or failed if none is left."""
    following = F.when(way == WAYS[0], WAYS[1]).when(way == WAYS[1], WAYS[2]).otherwise("failed")
    return F.when(accuracy == 1.0, "accept").when(accuracy > FIXABLE, "fix").otherwise(following)


def clamped(spans: DataFrame, totals: DataFrame) -> DataFrame:
    """Spans within the document, with ends not before starts."""
    out = spans.join(totals.select("doc_id", "total_pages"), "doc_id")
    start = F.least(F.greatest("start_index", F.lit(1)), "total_pages")
    out = out.withColumn("start_index", start.cast("int"))
    return out.withColumn("end_index", F.greatest("start_index", F.least("end_index", "total_pages")).cast("int")).drop("total_pages")


def _span_pages(spans: DataFrame, pages: DataFrame) -> DataFrame:
    """One row a page of each span: an equi-join on page numbers instead of a range join."""
    listed = spans.filter("start_index <= end_index").withColumn("page_no", F.explode(F.sequence("start_index", "end_index")))
    return listed.join(pages, ["doc_id", "page_no"])


def section_text(spans: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, ord and the pages' texts of each span, in order."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_no", "text"))), lambda x: x["text"]), "")
    return _span_pages(spans.select("doc_id", "ord", "start_index", "end_index"), pages.select("doc_id", "page_no", "text")).groupBy("doc_id", "ord").agg(text.alias("text"))


def labelled_text(spans: DataFrame, pages: DataFrame) -> DataFrame:
    """As ``section_text``, each page between its tags."""
    tagged = pages.select("doc_id", "page_no", page_tag(F.col("page_no"), F.col("text")).alias("text"))
    return section_text(spans, tagged)


def sampled(entries: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n random entries, the same for the same seed and rows."""
    return entries.orderBy(F.xxhash64(F.lit(seed), "doc_id", "ord"), "doc_id", "ord").limit(n)


def split_large(spans: DataFrame, parts: DataFrame) -> DataFrame:
    """Spans with parts (doc_id, ord of the parent, part, title, start_index, end_index) below them: a parent ends where its first part begins."""
    first = parts.groupBy("doc_id", "ord").agg(F.min("start_index").alias("first"))
    trimmed = spans.join(first, ["doc_id", "ord"], "left").withColumn("end_index", F.coalesce(F.greatest("start_index", F.least("end_index", "first")), "end_index"))
    own = trimmed.select("doc_id", "ord", F.lit(0).alias("part"), "title", "start_index", "end_index")
    return own.unionByName(parts.select("doc_id", "ord", "part", "title", "start_index", "end_index"))


def section_tokens(spans: DataFrame, pages: DataFrame) -> DataFrame:
    """Tokens and pages of each span, without its text."""
    rows = _span_pages(spans.select("doc_id", "ord", "title", "start_index", "end_index"), pages.select("doc_id", "page_no", "tokens"))
    return rows.groupBy("doc_id", "ord", "title", "start_index", "end_index").agg(F.sum("tokens").alias("tokens"))


def large_nodes(spans: DataFrame, pages: DataFrame, max_pages: int = 10, max_tokens: int = 20_000) -> DataFrame:
    return section_tokens(spans, pages).filter((F.col("end_index") - F.col("start_index") > max_pages) & (F.col("tokens") >= max_tokens))


def token_limit_report(spans: DataFrame, pages: DataFrame, limit: int = 110_000) -> DataFrame:
    return section_tokens(spans, pages).filter(F.col("tokens") > limit)


def toc_listing(tree: DataFrame) -> DataFrame:
    """Titles indented by depth."""
    return tree.select("doc_id", "ord", F.concat(F.expr("repeat('  ', depth)"), "title").alias("line"))


def fallback_structure(pages: DataFrame) -> DataFrame:
    return pages.select("doc_id", F.col("page_no").alias("ord"), F.concat(F.lit("Page "), "page_no").alias("title"), F.col("page_no").alias("start_index"), F.col("page_no").alias("end_index"))


def node_pages(spans: DataFrame) -> DataFrame:
    """Distinct pages of all spans of a document."""
    return spans.filter("start_index <= end_index").select("doc_id", F.explode(F.sequence("start_index", "end_index")).alias("page_no")).distinct()


def node_context(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """Texts of the wanted nodes (doc_id, node_id) of each document in their order, with blank lines between."""
    found = nodes.join(wanted.select("doc_id", "node_id").distinct(), ["doc_id", "node_id"], "left_semi")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node_id", "text"))), lambda x: x["text"]), "\n\n")
    return found.groupBy("doc_id").agg(text.alias("context"))


def chunk_words(pages: DataFrame, size: int = 500, overlap: int = 50) -> DataFrame:
    """Chunks of words of each document; pages with text are marked, the last chunk may be overlap only."""
    stride = size - overlap
    marked = pages.filter(F.trim(F.regexp_replace("text", r"\s+", " ")) != "").select("doc_id", "page_no", F.concat(F.lit("[Page "), "page_no", F.lit("] "), "text").alias("text"))
    whole = marked.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_no", "text"))), lambda x: x["text"]), "\n").alias("text"))
    words = whole.select("doc_id", F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " ").alias("w"))
    starts = F.sequence(F.lit(0), F.size("w") - 1, F.lit(stride))
    chunks = words.select("doc_id", "w", F.posexplode(starts).alias("chunk", "at"))
    part = F.slice("w", F.col("at") + 1, F.lit(size))
    return chunks.select("doc_id", "chunk", F.array_join(part, " ").alias("text"), F.size(part).alias("word_count"))


def group_pages(tokens: list[int], max_tokens: int, overlap: int = 1) -> list[tuple[int, int]]:
    """(first, last) page positions of groups that hold about equally many tokens.

    A group ends before the first page, its own first ``overlap`` and one aside,
    with which the running total passes the aim; that page is found by bisection.
    """
    ends = [0, *itertools.accumulate(tokens)]
    if not tokens:
        return []
    parts = -(-ends[-1] // max_tokens) if ends[-1] > max_tokens else 1
    if parts == 1:
        return [(0, len(tokens) - 1)]
    aim = math.ceil((ends[-1] / parts + max_tokens) / 2)
    starts, cuts = [0], []
    while True:
        cut = max(bisect.bisect_right(ends, ends[starts[-1]] + aim) - 1, cuts[-1] + 1 if cuts else 1)
        if cut >= len(tokens):
            return list(zip(starts, [c - 1 for c in [*cuts, len(tokens)]]))
        cuts.append(cut)
        starts.append(max(cut - overlap, 0))


def _groups_of(docs: pa.Array, numbers: pa.Array, tokens: np.ndarray, starts: np.ndarray, max_tokens: int, overlap: int) -> pa.RecordBatch:
    """Groups of the documents that begin at ``starts``; those that fit one group go without a loop."""
    ends = np.append(starts[1:], len(tokens))
    own, group, first, last = starts, np.zeros(len(starts), np.int64), starts, ends - 1
    large = np.add.reduceat(tokens, starts) > max_tokens
    if large.any():
        cut = [(s, k, s + a, s + b) for s, e in zip(starts[large].tolist(), ends[large].tolist()) for k, (a, b) in enumerate(group_pages(tokens[s:e].tolist(), max_tokens, overlap))]
        own, group, first, last = (np.concatenate([x[~large], y]) for x, y in zip((own, group, first, last), np.array(cut, np.int64).T))
    sums = np.concatenate([[0], np.cumsum(tokens)])
    columns = [docs.take(pa.array(own)).cast("int64"), pa.array(group, "int32"), *(numbers.take(pa.array(x)).cast("int32") for x in (first, last)), pa.array(sums[last + 1] - sums[first], "int64")]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "group_no", "first_page", "last_page", "tokens"])


def page_groups(pages: DataFrame, max_tokens: int = 20_000, overlap: int = 1) -> DataFrame:
    """doc_id, group_no, first_page, last_page and tokens.

    Sequential within a document only: tasks have whole documents in order, and
    a batch's documents go through one call; the last one waits for the next batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                if not batch.num_rows:
                    continue
                if held and held[-1].column(0)[-1] == batch.column(0)[0] and batch.column(0)[0] == batch.column(0)[-1]:
                    held.append(batch)  # the same document goes on
                    continue
                held.append(batch)
            if not held:
                return
            docs, numbers, tokens = (pa.concat_arrays([b.column(k) for b in held]) for k in range(3))
            known, keys, sizes = docs.is_valid().to_numpy(False), docs.fill_null(0).to_numpy(False), tokens.to_numpy(False).astype(np.int64)
            starts = np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]) | (known[1:] != known[:-1])) + 1])
            done = len(keys) if batch is None else starts[-1]
            held = [pa.RecordBatch.from_arrays([docs[done:], numbers[done:], tokens[done:]], ["doc_id", "page_no", "tokens"])] if done < len(keys) else []
            if done:
                yield _groups_of(docs[:done], numbers[:done], sizes[:done], starts[starts < done], max_tokens, overlap)

    whole = pages.select("doc_id", "page_no", "tokens").repartition("doc_id").sortWithinPartitions("doc_id", F.asc_nulls_last("page_no"))
    return whole.mapInArrow(run, "doc_id long, group_no int, first_page int, last_page int, tokens long")


NODE = "title string, node_id string, start_index int, end_index int, summary string, nodes string"


def flatten_tree(trees: DataFrame) -> DataFrame:
    """Nodes of nested JSON structures (doc_id, json), with their path and depth; levels are stored one after the other until one is empty."""
    level = trees.select("doc_id", F.lit("").alias("path"), F.from_json(F.get_json_object("json", "$.structure"), "array<string>").alias("nodes"))
    out, depth = None, 0
    while True:
        parsed = level.select("doc_id", "path", F.posexplode("nodes").alias("k", "json"))
        parsed = parsed.select("doc_id", F.concat("path", F.lpad(F.col("k").cast("string"), 6, "0"), F.lit(".")).alias("path"), F.from_json("json", NODE).alias("n"))
        parsed = materialise(parsed.select("doc_id", "path", "n.*"), "level")
        rows = parsed.select("doc_id", F.lit(depth).alias("depth"), "path", "title", "node_id", "start_index", "end_index", "summary")
        out = rows if out is None else out.unionByName(rows)
        level = parsed.select("doc_id", "path", F.from_json("nodes", "array<string>").alias("nodes")).filter("size(nodes) > 0")
        depth += 1
        if level.isEmpty():
            return out.withColumn("ord", F.row_number().over(Window.partitionBy("doc_id").orderBy("path")))


#: Keys of a node in a nested structure, in their order.
KEYS = ("title", "node_id", "start_index", "end_index", "summary", "prefix_summary", "text", "line_num")


def nested_json(tree: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """One JSON structure a document from (doc_id, ord, parent_ord and some of ``keys``): a sink's last step.

    Put together from the leaves up, a level of all documents at a time: a node's
    object has its own keys in the given order, those that are null left out, and
    then, unless it has no children, ``nodes`` with theirs, which the level below has
    stored.  A node whose parent is missing is a root; trees may have any depth.
    """
    if not set(keys) <= set(KEYS):
        raise ValueError(f"keys are some of {', '.join(KEYS)}")
    own = F.to_json(F.struct(*(c for c in keys if c in tree.columns)))
    known = tree.select("doc_id", F.col("ord").alias("parent_ord"), F.lit(True).alias("_known"))
    rooted = tree.join(known, ["doc_id", "parent_ord"], "left").withColumn("parent_ord", F.when(F.col("_known"), F.col("parent_ord")))
    nodes = materialise(section_depth(rooted.select("doc_id", "ord", "parent_ord", own.alias("own"))), "nodes")
    level = None
    for depth in range(nodes.agg(F.max("depth")).first()[0] or 0, -1, -1):
        mine = nodes.filter(F.col("depth") == depth)
        inside = F.lit(None).cast("string")
        if level is not None:
            mine = mine.join(_arrays(level, "parent_ord").withColumnRenamed("parent_ord", "ord"), ["doc_id", "ord"], "left")
            inside = F.col("array")
        bare = F.substring("own", F.lit(1), F.length("own") - 1)
        with_nodes = F.concat(bare, F.when(F.col("own") == "{}", "").otherwise(","), F.lit('"nodes":'), inside, F.lit("}"))
        level = materialise(mine.select("doc_id", "ord", "parent_ord", F.coalesce(with_nodes, "own").alias("json")), "level")
    return _arrays(level).select("doc_id", F.concat(F.lit('{"structure":'), "array", F.lit("}")).alias("json"))


def _arrays(nodes: DataFrame, *keys: str) -> DataFrame:
    """The JSON objects of each document, or of each of its parents, as one array in order."""
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "json"))), lambda x: x["json"]), ",")
    return nodes.groupBy("doc_id", *keys).agg(F.concat(F.lit("["), listed, F.lit("]")).alias("array"))
