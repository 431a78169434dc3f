"""Markdown documents (doc_id, text) as headings, sections and trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arbograph.functions.text import estimated_tokens

LEVELS = range(1, 7)


def _by_line():
    return Window.partitionBy("doc_id").orderBy("line_num")


def _lines(docs: DataFrame) -> DataFrame:
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("k", "line"))
    return lines.select("doc_id", (F.col("k") + 1).alias("line_num"), "line", F.trim(F.regexp_replace("line", r"^\s+|\s+$", "")).alias("bare"))


def _marked(docs: DataFrame) -> DataFrame:
    """Lines with whether they are headings: outside fences, which the number of fence lines so far tells."""
    lines = _lines(docs)
    fence = F.col("bare").startswith("```")
    inside = F.sum(fence.cast("int")).over(_by_line().rowsBetween(Window.unboundedPreceding, 0)) % 2 == 1
    heading = ~fence & ~inside & F.col("bare").rlike(r"^#{1,6}\s+\S")
    return lines.withColumn("heading", heading)


def md_headings(docs: DataFrame) -> DataFrame:
    """doc_id, line_num and title of headings, also of indented ones."""
    found = _marked(docs).filter("heading")
    return found.select("doc_id", "line_num", F.regexp_extract("bare", r"^#{1,6}\s+(.+)$", 1).alias("title"))


def md_sections(docs: DataFrame) -> DataFrame:
    """doc_id, ord, line_num, level, title and text up to the next heading; indented headings are none here."""
    marked = _marked(docs).withColumn("own", F.col("heading") & F.col("line").startswith("#"))
    section = F.sum(F.col("own").cast("int")).over(_by_line().rowsBetween(Window.unboundedPreceding, 0))
    rows = marked.withColumn("ord", section).filter("ord > 0")
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_num", "line"))), lambda x: x["line"]), "\n")
    head = F.min_by(F.struct("line_num", "line", "bare"), "line_num")
    out = rows.groupBy("doc_id", "ord").agg(head.alias("h"), lines.alias("text"))
    return out.select(
        "doc_id", F.col("ord").cast("int").alias("ord"), "h.line_num", F.length(F.regexp_extract("h.line", r"^(#{1,6})", 1)).alias("level"),
        F.regexp_extract("h.bare", r"^#{1,6}\s+(.+)$", 1).alias("title"), F.regexp_replace("text", r"^\s+|\s+$", "").alias("text"),
    )


def md_tree(sections: DataFrame) -> DataFrame:
    """parent_ord: the nearest section before with a smaller level.

    Levels are six at most, so the last section of each level so far is a
    window column, and the parent the latest of those below the own level.
    """
    before = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    last = [F.last(F.when(F.col("level") == n, F.col("ord")), True).over(before) for n in LEVELS]
    out = sections.select("*", *(c.alias(f"_l{n}") for n, c in zip(LEVELS, last, strict=True)))
    parent = F.array_max(F.array(*(F.when(F.col("level") > n, F.col(f"_l{n}")) for n in LEVELS)))
    return out.withColumn("parent_ord", parent).drop(*(f"_l{n}" for n in LEVELS))


def md_subtree_tokens(sections: DataFrame) -> DataFrame:
    """Estimated tokens of each section with all below it, from running totals of lengths."""
    after = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(1, Window.unboundedFollowing)
    upto = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    s = sections.select("doc_id", "ord", "level", "title", F.length("text").cast("long").alias("n"))
    s = s.withColumn("c", F.sum(F.when(F.col("n") > 0, F.col("n") + 1).otherwise(0)).over(upto))
    nexts = [F.first(F.when(F.col("level") == n, F.col("ord")), True).over(after) for n in LEVELS]
    s = s.select("*", F.max("ord").over(Window.partitionBy("doc_id")).alias("last"), *(c.alias(f"_n{n}") for n, c in zip(LEVELS, nexts, strict=True)))
    end = F.array_min(F.array(*(F.when(F.col("level") >= n, F.col(f"_n{n}")) for n in LEVELS)))
    s = s.withColumn("end", F.coalesce(end - 1, F.col("last")))
    ends = s.select("doc_id", F.col("ord").alias("end"), F.col("c").alias("c_end"))
    own = F.when(F.col("n") > 0, F.col("n") + 1).otherwise(0)
    out = s.join(ends, ["doc_id", "end"]).withColumn("chars", F.greatest(F.col("c_end") - F.col("c") + own - 1, F.lit(0)))
    return out.select("doc_id", "ord", "level", "title", F.ceil(F.col("chars") / 4).cast("long").alias("tokens"))


def md_thinning(sections: DataFrame, least: int = 100) -> DataFrame:
    """Sections that stay, with their texts, once those with fewer than ``least`` tokens have taken over all below them.

    What is below a section has no more tokens than it, so a section stays if it
    has no parent or one that isn't small, and what goes belongs to the last
    section before it that stays; a section that takes over has few tokens, so no
    group is large.  Texts of nothing but blanks are left out of merged ones.
    """
    counted = md_tree(sections).join(md_subtree_tokens(sections).select("doc_id", "ord", "tokens"), ["doc_id", "ord"])
    parents = counted.select("doc_id", F.col("ord").alias("parent_ord"), F.col("tokens").alias("_above"))
    marked = counted.join(parents, ["doc_id", "parent_ord"], "left").withColumn("_stays", F.col("_above").isNull() | (F.col("_above") >= least))
    upto = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    marked = marked.withColumn("_into", F.last(F.when(F.col("_stays"), F.col("ord")), True).over(upto))
    held = F.col("_stays") | (F.trim(F.regexp_replace("text", r"\s+", " ")) != "")
    texts = F.transform(F.array_sort(F.collect_list(F.when(held, F.struct("ord", "text")))), lambda x: x["text"])
    joined = F.aggregate(F.slice(texts, 2, F.size(texts)), F.get(texts, F.lit(0)), lambda a, t: F.concat(a, F.when((a == "") | a.endswith("\n"), "").otherwise("\n\n"), t))
    first = lambda c: F.max(F.when(F.col("_stays"), F.col(c))).alias(c)
    out = marked.groupBy("doc_id", F.col("_into").alias("ord")).agg(first("level"), first("title"), joined.alias("text"), first("tokens"), F.size(texts).alias("_n"))
    tokens = F.when(F.col("_n") > 1, estimated_tokens(F.col("text"))).otherwise(F.col("tokens"))
    return out.select("doc_id", "ord", "level", "title", "text", tokens.alias("tokens"))
