"""Pages, tables of contents and Markdown out of a table of documents; readers and sinks of document files."""

from __future__ import annotations

import fnmatch
import json
import os
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbograph.operators.structure import page_list

SQL = {
    "t_pages": """
SELECT doc_id, CAST(k AS INT) AS page_no, text, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS k FROM documents) x""",
    "t_totals": "SELECT doc_id, count(*) AS total_pages, CAST(sum(tokens) AS BIGINT) AS total_tokens FROM t_pages GROUP BY doc_id",
    "t_toc": """
SELECT doc_id, i + 1 AS ord, CASE WHEN i % 3 = 0 THEN CAST(i // 3 + 1 AS VARCHAR) ELSE concat(CAST(i // 3 + 1 AS VARCHAR), '.', CAST(i % 3 AS VARCHAR)) END AS structure,
  concat('Part ', substring(text, 1, 12)) AS title, CASE WHEN page_no % 7 <> 0 THEN CAST(page_no + doc_id % 2 AS INT) END AS physical_index,
  page_no - 2 AS page, CASE WHEN i % 2 = 0 THEN 'yes' ELSE 'no' END AS appear_start
FROM (SELECT *, (page_no - 1) // 3 AS i FROM t_pages WHERE page_no % 3 = 1) x""",
    "t_spans": """
SELECT doc_id, ord, structure, title, physical_index AS start_index, CAST(coalesce(CASE WHEN lead(appear_start) OVER w = 'yes'
  THEN lead(physical_index) OVER w - 1 ELSE lead(physical_index) OVER w END, total_pages) AS INT) AS end_index
FROM t_toc JOIN t_totals USING (doc_id) WHERE physical_index BETWEEN 1 AND total_pages WINDOW w AS (PARTITION BY doc_id ORDER BY ord)""",
    "t_tree": """
SELECT c.doc_id, c.ord, c.structure, c.title, (SELECT max(p.ord) FROM t_toc p WHERE p.doc_id = c.doc_id AND p.ord < c.ord
  AND p.structure = CASE WHEN contains(c.structure, '.') THEN regexp_replace(c.structure, '[.][^.]*$', '') END) AS parent_ord FROM t_toc c""",
    "t_markdown": """
SELECT doc_id, string_agg(concat(CASE WHEN page_no % 11 = 5 THEN '```' || chr(10) ELSE '' END, CASE (page_no - 1) % 6 WHEN 0 THEN '# ' WHEN 2 THEN '## ' WHEN 3 THEN ' ## '
  WHEN 4 THEN '### ' ELSE '' END, text), chr(10) ORDER BY page_no) AS text FROM t_pages GROUP BY doc_id""",
}


def toc(docs: DataFrame) -> DataFrame:
    """A table of contents with an entry for every third page, some of them without a page."""
    i = F.floor((F.col("page_no") - 1) / 3).cast("int")
    rows = page_list(docs).filter("page_no % 3 = 1").withColumn("i", i)
    chapter = F.floor(F.col("i") / 3) + 1
    return rows.select(
        "doc_id", (F.col("i") + 1).alias("ord"),
        F.when(F.col("i") % 3 == 0, chapter.cast("string")).otherwise(F.concat(chapter.cast("string"), F.lit("."), (F.col("i") % 3).cast("string"))).alias("structure"),
        F.concat(F.lit("Part "), F.substring("text", 1, 12)).alias("title"),
        F.when(F.col("page_no") % 7 != 0, (F.col("page_no") + F.col("doc_id") % 2).cast("int")).alias("physical_index"),
        (F.col("page_no") - 2).alias("page"),
        F.when(F.col("i") % 2 == 0, "yes").otherwise("no").alias("appear_start"),
    )


def markdown(docs: DataFrame) -> DataFrame:
    """Documents whose lines are marked as headings of three levels, with fences between."""
    k = F.col("page_no")
    mark = F.when((k - 1) % 6 == 0, "# ").when((k - 1) % 6 == 2, "## ").when((k - 1) % 6 == 3, " ## ").when((k - 1) % 6 == 4, "### ").otherwise("")
    line = F.concat(F.when(k % 11 == 5, "```\n").otherwise(""), mark, "text")
    rows = page_list(docs).select("doc_id", "page_no", line.alias("line"))
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_no", "line"))), lambda x: x["line"]), "\n").alias("text"))


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """Whole files (doc_id, doc_name, text); ids are hashes of paths."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return rows.select(F.xxhash64("path").alias("doc_id"), document_name(F.col("path")).alias("doc_name"), "text")


def document_name(path: F.Column) -> F.Column:
    """The last part of a path; an empty one is "Untitled", slashes elsewhere become dashes."""
    return F.coalesce(F.nullif(F.element_at(F.split(path, "/"), -1), F.lit("")), F.lit("Untitled"))


def read_pages(spark: SparkSession, path: str, extract: Callable[[bytes], list[str]], glob: str = "*.pdf") -> DataFrame:
    """Pages (doc_id, doc_name, page_no, text) of binary files by a pluggable extractor, one file at a time.

    A folder's files of other kinds are left out; a path to one such file is refused.
    """
    if "://" not in path and not os.path.exists(path):
        raise FileNotFoundError(path)
    if os.path.isfile(path) and not fnmatch.fnmatch(os.path.basename(path).lower(), glob.lower()):
        raise ValueError(f"{path} is no {glob} file")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*" if os.path.isfile(path) else glob).load(path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                texts = extract(bytes(row.content))
                yield pd.DataFrame({"doc_id": row.doc_id, "doc_name": row.doc_name, "page_no": range(1, len(texts) + 1), "text": texts})

    named = files.select(F.xxhash64("path").alias("doc_id"), document_name(F.col("path")).alias("doc_name"), "content")
    return named.mapInPandas(run, "doc_id long, doc_name string, page_no int, text string")


def read_structures(spark: SparkSession, path: str) -> DataFrame:
    """Nested structures (doc_id, json) of JSON files, for ``flatten_tree``."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("json"))
    return rows.select(F.xxhash64("path").alias("doc_id"), "json")


def write_structures(structures: DataFrame, path: str) -> None:
    """One line of JSON text for each row of (doc_id, json)."""
    structures.select("json").write.text(path)


DEFAULTS = {"model": {"name": "stand-in", "tries": 15}, "index": {"max_pages": 10, "max_tokens": 20_000, "node_ids": True, "summaries": True}, "query": {"budget": 12_000, "hops": 2}}


def load_config(overrides: dict | str | None = None, environment: dict[str, str] | None = None) -> dict:
    """Defaults, merged deeply with overrides (a dict or a JSON file) and ``ARBOGRAPH_SECTION_KEY`` variables; unknown keys are errors."""
    config = json.loads(json.dumps(DEFAULTS))
    if isinstance(overrides, str):
        with open(overrides) as f:
            overrides = json.load(f)

    def merge(into: dict, more: dict, where: str) -> None:
        for key, value in more.items():
            if key not in into:
                raise ValueError(f"unknown setting {where}{key}")
            if isinstance(into[key], dict):
                merge(into[key], value, f"{where}{key}.")
            else:
                into[key] = value

    merge(config, overrides or {}, "")
    for section, values in config.items():
        for key, value in values.items():
            text = (os.environ if environment is None else environment).get(f"ARBOGRAPH_{section}_{key}".upper())
            if text is not None:
                values[key] = text.lower() in ("1", "true") if isinstance(value, bool) else type(value)(text)
    return config
