"""A document graph out of order tables: customers' yearly reports, with orders as their leaf sections.

``SQL`` has the same tables as text that other engines run too.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arbograph.graph import DocumentGraph
from arbograph.session import read_table, sent_by_rows

_DOC = "(o_custkey * 10) + (CAST(year(o_orderdate) AS BIGINT) - 1995) + 1"
_PRIORITY = "CAST(substring(o_orderpriority, 1, 1) AS BIGINT)"

SQL: dict[str, str] = {
    "g_documents": """
SELECT (o_custkey * 10) + (y - 1995) + 1 AS doc_id,
       concat('report-', CAST(o_custkey AS VARCHAR), '-', CAST(y AS VARCHAR)) AS doc_name,
       concat('group-', CAST(o_custkey AS VARCHAR)) AS doc_group,
       CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY y) AS INT) AS doc_version
FROM (SELECT DISTINCT o_custkey, CAST(year(o_orderdate) AS BIGINT) AS y FROM orders) t""",
    "g_sections": f"""
SELECT section_id, doc_id, title, start_index, depth_level,
       concat(title, ' in short') AS summary,
       CASE WHEN depth_level = 2 THEN concat(title, ' is described on page ', CAST(start_index AS VARCHAR), '.') END AS text_content
FROM (
  SELECT CAST(1000000000 + d AS BIGINT) AS section_id, d AS doc_id, 'Overview' AS title, 1 AS start_index, 0 AS depth_level
  FROM (SELECT DISTINCT {_DOC} AS d FROM orders) r
  UNION ALL
  SELECT CAST(2000000000 + d * 10 + pr AS BIGINT), d, title, CAST(pr AS INT), 1
  FROM (SELECT DISTINCT {_DOC} AS d, {_PRIORITY} AS pr, o_orderpriority AS title FROM orders) m
  UNION ALL
  SELECT o_orderkey + 1, {_DOC}, concat('Order ', CAST(o_orderkey AS VARCHAR)), CAST(month(o_orderdate) AS INT), 2 FROM orders
) u""",
    "g_hierarchy": f"""
SELECT DISTINCT CAST(1000000000 + d AS BIGINT) AS parent_id, CAST(2000000000 + d * 10 + pr AS BIGINT) AS child_id
FROM (SELECT {_DOC} AS d, {_PRIORITY} AS pr FROM orders) m
UNION ALL
SELECT CAST(2000000000 + ({_DOC}) * 10 + {_PRIORITY} AS BIGINT), o_orderkey + 1 FROM orders""",
    "g_entities": """
SELECT p_partkey + 1 AS entity_id, concat(p_name, ' ', CAST(p_partkey AS VARCHAR)) AS name, p_type AS entity_type FROM part
UNION ALL
SELECT s_suppkey + 1000001, s_name, 'SUPPLIER' FROM supplier""",
    "g_mentions": """
SELECT (l_orderkey + 1) * 1000000 + l_partkey + 1 AS edge_id, l_orderkey + 1 AS section_id, l_partkey + 1 AS entity_id,
       CASE min(l_returnflag) WHEN 'A' THEN 'DEFINES' WHEN 'N' THEN 'DISCUSSES' ELSE 'MENTIONS' END AS relevance
FROM lineitem GROUP BY l_orderkey, l_partkey""",
    "g_relationships": """
SELECT DISTINCT l_suppkey + 1000001 AS source_entity, l_partkey + 1 AS target_entity, 'SUPPLIES' AS relationship
FROM lineitem WHERE l_quantity >= 50
UNION ALL
SELECT p_partkey + 1, ((p_partkey * 7 + 3) % n) + 1, CASE WHEN p_size % 2 = 0 THEN 'PART_OF' ELSE 'RELATED_TO' END
FROM part CROSS JOIN (SELECT count(*) AS n FROM part) c WHERE p_partkey % 3 = 0""",
    "g_sessions": """
SELECT conv_id + 1 AS session_id, concat('Session ', CAST(conv_id AS VARCHAR)) AS title, count(*) AS n_rows
FROM conversations GROUP BY conv_id""",
    "g_turns": """
SELECT conv_id * 1000 + turn + 1 AS turn_id, conv_id + 1 AS session_id,
       CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INT) AS turn_number, text AS question, answer
FROM (SELECT conv_id, turn, role, text,
             CASE WHEN lead(role) OVER (PARTITION BY conv_id ORDER BY turn) = 'assistant'
                  THEN lead(text) OVER (PARTITION BY conv_id ORDER BY turn) END AS answer FROM conversations) c
WHERE role = 'user'""",
    "g_turn_entities": """
SELECT conv_id * 1000 + turn + 1 AS turn_id, ((conv_id * 1000 + turn + 1) * 31) % n + 1 AS entity_id, 'PRIMARY' AS role
FROM conversations CROSS JOIN (SELECT count(*) AS n FROM part) c WHERE conversations.role = 'user'
UNION ALL
SELECT conv_id * 1000 + turn + 1, ((conv_id * 1000 + turn + 1) * 17) % n + 1, 'REFERENCED'
FROM conversations CROSS JOIN (SELECT count(*) AS n FROM part) c WHERE conversations.role = 'user'""",
    "g_turn_sections": """
SELECT conv_id * 1000 + turn + 1 AS turn_id, ((conv_id * 1000 + turn + 1) * 13 + i * 7) % n + 1 AS section_id,
       CAST(round(1.0 - 0.1 * i, 1) AS DOUBLE) AS rank_score
FROM conversations CROSS JOIN (SELECT count(*) AS n FROM orders) c
CROSS JOIN (SELECT 0 AS i UNION ALL SELECT 1 UNION ALL SELECT 2) k WHERE role = 'user'""",
}


def with_views(query: str) -> str:
    """``query`` with the graph's tables that it names as common table expressions before its own."""
    used = [f"{name} AS ({SQL[name]})" for name in SQL if re.search(rf"\b{name}\b", query)]
    if not used:
        return query
    own = query.removeprefix("WITH ")
    return "WITH " + ",\n".join(used) + (",\n" if own != query else "\n") + own


def _doc_id() -> F.Column:
    return F.col("o_custkey") * 10 + F.year("o_orderdate").cast("long") - 1995 + 1


def documents(orders: DataFrame) -> DataFrame:
    years = orders.select("o_custkey", F.year("o_orderdate").cast("long").alias("y")).distinct()
    version = F.row_number().over(Window.partitionBy("o_custkey").orderBy("y"))
    return years.select(
        (F.col("o_custkey") * 10 + F.col("y") - 1995 + 1).alias("doc_id"),
        F.concat(F.lit("report-"), "o_custkey", F.lit("-"), "y").alias("doc_name"),
        version.alias("doc_version"),
        F.concat(F.lit("group-"), "o_custkey").alias("doc_group"),
    )


def _middle() -> F.Column:
    return (F.lit(2_000_000_000) + _doc_id() * 10 + F.substring("o_orderpriority", 1, 1).cast("long")).cast("long")


def sections(orders: DataFrame) -> DataFrame:
    roots = orders.select(_doc_id().alias("doc_id")).distinct()
    roots = roots.select((F.lit(1_000_000_000) + F.col("doc_id")).cast("long").alias("section_id"), "doc_id", F.lit("Overview").alias("title"), F.lit(1).alias("start_index"), F.lit(0).alias("depth_level"))
    middle = orders.select(_middle().alias("section_id"), _doc_id().alias("doc_id"), F.col("o_orderpriority").alias("title"), F.substring("o_orderpriority", 1, 1).cast("int").alias("start_index"), F.lit(1).alias("depth_level")).distinct()
    leaves = orders.select((F.col("o_orderkey") + 1).alias("section_id"), _doc_id().alias("doc_id"), F.concat(F.lit("Order "), "o_orderkey").alias("title"), F.month("o_orderdate").alias("start_index"), F.lit(2).alias("depth_level"))
    text = F.when(F.col("depth_level") == 2, F.concat("title", F.lit(" is described on page "), "start_index", F.lit(".")))
    return roots.unionByName(middle).unionByName(leaves).withColumns({"summary": F.concat("title", F.lit(" in short")), "text_content": text})


def hierarchy(orders: DataFrame) -> DataFrame:
    upper = orders.select((F.lit(1_000_000_000) + _doc_id()).cast("long").alias("parent_id"), _middle().alias("child_id")).distinct()
    return upper.unionByName(orders.select(_middle().alias("parent_id"), (F.col("o_orderkey") + 1).alias("child_id")))


def entities(part: DataFrame, supplier: DataFrame) -> DataFrame:
    parts = part.select((F.col("p_partkey") + 1).alias("entity_id"), F.concat("p_name", F.lit(" "), "p_partkey").alias("name"), F.col("p_type").alias("entity_type"))
    return parts.unionByName(supplier.select((F.col("s_suppkey") + 1_000_001).alias("entity_id"), F.col("s_name").alias("name"), F.lit("SUPPLIER").alias("entity_type")))


def mentions(lineitem: DataFrame) -> DataFrame:
    flag = F.min("l_returnflag")
    relevance = F.when(flag == "A", "DEFINES").when(flag == "N", "DISCUSSES").otherwise("MENTIONS")
    return lineitem.groupBy("l_orderkey", "l_partkey").agg(relevance.alias("relevance")).select(
        ((F.col("l_orderkey") + 1) * 1_000_000 + F.col("l_partkey") + 1).alias("edge_id"),
        (F.col("l_orderkey") + 1).alias("section_id"),
        (F.col("l_partkey") + 1).alias("entity_id"),
        "relevance",
    )


def relationships(lineitem: DataFrame, part: DataFrame) -> DataFrame:
    supplies = lineitem.filter("l_quantity >= 50").select((F.col("l_suppkey") + 1_000_001).alias("source_entity"), (F.col("l_partkey") + 1).alias("target_entity"), F.lit("SUPPLIES").alias("relationship")).distinct()
    kind = F.when(F.col("p_size") % 2 == 0, "PART_OF").otherwise("RELATED_TO")
    others = part.filter("p_partkey % 3 = 0").join(F.broadcast(part.agg(F.count("*").alias("n"))))  # one row
    return supplies.unionByName(others.select((F.col("p_partkey") + 1).alias("source_entity"), ((F.col("p_partkey") * 7 + 3) % F.col("n") + 1).alias("target_entity"), kind.alias("relationship")))


def turns(conversations: DataFrame) -> DataFrame:
    order = Window.partitionBy("conv_id").orderBy("turn")
    answered = conversations.withColumn("answer", F.when(F.lead("role").over(order) == "assistant", F.lead("text").over(order)))
    return answered.filter("role = 'user'").select(
        (F.col("conv_id") * 1000 + F.col("turn") + 1).alias("turn_id"),
        (F.col("conv_id") + 1).alias("session_id"),
        F.row_number().over(order).alias("turn_number"),
        F.col("text").alias("question"),
        "answer",
    )


def _turn_ids(conversations: DataFrame, counted: DataFrame) -> DataFrame:
    ids = conversations.filter("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn") + 1).alias("turn_id"))
    return ids.join(F.broadcast(counted.agg(F.count("*").alias("n"))))  # one row


def turn_entities(conversations: DataFrame, part: DataFrame) -> DataFrame:
    ids = _turn_ids(conversations, part)
    link = lambda k, role: ids.select("turn_id", (F.col("turn_id") * k % F.col("n") + 1).alias("entity_id"), F.lit(role).alias("role"))
    return link(31, "PRIMARY").unionByName(link(17, "REFERENCED"))


def turn_sections(conversations: DataFrame, orders: DataFrame) -> DataFrame:
    ids = _turn_ids(conversations, orders).withColumn("i", F.explode(F.array(*map(F.lit, range(3)))))
    return ids.select("turn_id", ((F.col("turn_id") * 13 + F.col("i") * 7) % F.col("n") + 1).alias("section_id"), F.round(1.0 - 0.1 * F.col("i"), 1).alias("rank_score"))


def load_graph(spark: SparkSession, sf_dir: str) -> DocumentGraph:
    read = lambda name: read_table(spark, sf_dir, name)
    orders, part, lineitem, talks = read("orders"), read("part"), read("lineitem"), read("conversations")
    sessions = talks.groupBy("conv_id").agg(F.count("*").alias("n_rows")).select((F.col("conv_id") + 1).alias("session_id"), F.concat(F.lit("Session "), "conv_id").alias("title"))
    return DocumentGraph.from_tables(
        spark,
        {
            "documents": documents(orders),
            "sections": sections(orders),
            "section_hierarchy": hierarchy(orders),
            "entities": sent_by_rows(entities(part, read("supplier"))),
            "section_entities": mentions(lineitem),
            "entity_relationships": relationships(lineitem, part),
            "sessions": sessions,
            "turns": turns(talks),
            "turn_entities": turn_entities(talks, part),
            "turn_sections": turn_sections(talks, orders),
        },
    )
