"""Queries from questions to contexts, with their SQL: every user turn is a question, its entities' names are its words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbograph.functions import models
from arbograph.functions.text import repaired_json
from arbograph.operators import answers, enrichment, extraction, patterns, prompts, retrieval
from arbograph.plans.graph_queries import PATHS
from arbograph.plans.stand_ins import ForgetfulTitles
from arbograph.sources.tables import load_graph, with_views

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

SQL = {
    "q_names": """SELECT x.turn_id AS question_id, CASE x.role WHEN 'PRIMARY' THEN 1 ELSE 2 END AS ord, upper(e.name) AS name
FROM g_turn_entities x JOIN g_entities e ON e.entity_id = x.entity_id""",
    "q_resolved": """SELECT n.question_id, n.ord, n.name, e.entity_id, e.name AS entity_name, e.entity_type FROM q_names n
JOIN (SELECT k.key, min(e.entity_id) AS entity_id FROM (SELECT DISTINCT lower(name) AS key FROM q_names) k JOIN g_entities e ON contains(lower(e.name), k.key) GROUP BY k.key) f ON f.key = lower(n.name)
JOIN g_entities e ON e.entity_id = f.entity_id""",
    "q_shared": """SELECT m.entity_id, m.section_id, s.title FROM g_mentions m JOIN g_sections s ON s.section_id = m.section_id
WHERE EXISTS (SELECT 1 FROM g_mentions o WHERE o.section_id = m.section_id AND o.entity_id <> m.entity_id)""",
    "q_near": """SELECT r.question_id, r.ord AS entity_ord, m.section_id AS row_ord, 'section' AS node_type, m.section_id AS node_id, m.title AS node_label,
  'mentions' AS edge_label, 'inbound' AS edge_direction, r.entity_name FROM q_resolved r JOIN q_shared m ON m.entity_id = r.entity_id
QUALIFY row_number() OVER (PARTITION BY r.question_id, m.section_id ORDER BY r.ord, m.section_id, r.entity_name) = 1""",
    "q_hops": """SELECT DISTINCT source_entity AS entity_id, target_entity AS node_id, relationship, 1 AS hops FROM g_relationships
UNION SELECT a.source_entity, b.target_entity, b.relationship, 2 FROM g_relationships a JOIN g_relationships b ON b.source_entity = a.target_entity WHERE b.target_entity <> a.source_entity""",
    "q_far": """SELECT r.question_id, r.ord AS entity_ord, h.node_id + h.hops * CAST(1000000000000 AS BIGINT) AS row_ord, 'entity' AS node_type, h.node_id, e.name AS node_label,
  h.relationship AS edge_label, 'outbound' AS edge_direction, r.entity_name FROM q_resolved r JOIN q_hops h ON h.entity_id = r.entity_id JOIN g_entities e ON e.entity_id = h.node_id""",
    "q_used": """SELECT turn_id AS question_id, section_id, CAST(row_number() OVER (PARTITION BY turn_id ORDER BY rank_score DESC, section_id) AS INT) AS ord FROM g_turn_sections""",
    "q_full": """SELECT u.question_id, u.ord, u.section_id, s.title, 'MENTIONS' AS relevance, s.summary, s.text_content, s.depth_level, s.start_index, d.doc_name
FROM q_used u LEFT JOIN (g_sections s JOIN g_documents d ON d.doc_id = s.doc_id) ON s.section_id = u.section_id""",
    "q_asked": """SELECT turn_id AS question_id, question, ['LOOKUP', 'RELATIONSHIP', 'EXPLORATION', 'COMPARISON', 'HIERARCHICAL', 'TEMPORAL'][(turn_id // 2) % 6 + 1] AS intent FROM g_turns""",
    "q_words": """SELECT question_id, ord, CASE WHEN (question_id // 2) % 11 = 0 THEN concat('ORDER ', CAST(question_id AS VARCHAR)) ELSE name END AS name FROM q_names WHERE (question_id // 2) % 7 <> 0""",
    "q_known": """SELECT n.question_id, n.ord, e.entity_id, e.name AS entity_name, a.intent FROM q_words n JOIN q_asked a ON a.question_id = n.question_id
JOIN (SELECT k.key, min(e.entity_id) AS entity_id FROM (SELECT DISTINCT lower(name) AS key FROM q_words) k JOIN g_entities e ON contains(lower(e.name), k.key) GROUP BY k.key) f ON f.key = lower(n.name)
JOIN g_entities e ON e.entity_id = f.entity_id""",
    "q_below": """SELECT parent_id AS top, child_id AS node, 1 AS level FROM g_hierarchy UNION ALL SELECT a.parent_id, b.child_id, 2 FROM g_hierarchy a JOIN g_hierarchy b ON b.parent_id = a.child_id""",
    "q_hits1": """SELECT r.question_id, 1 AS step, r.ord AS entity_ord, m.section_id AS top, 0 AS level, m.section_id, m.relevance FROM q_known r JOIN g_mentions m ON m.entity_id = r.entity_id
WHERE r.intent = 'HIERARCHICAL' OR EXISTS (SELECT 1 FROM g_mentions o WHERE o.section_id = m.section_id AND o.entity_id <> m.entity_id)
UNION ALL SELECT r.question_id, 1, r.ord, m.section_id, b.level, b.node, NULL FROM q_known r JOIN g_mentions m ON m.entity_id = r.entity_id JOIN q_below b ON b.top = m.section_id WHERE r.intent = 'HIERARCHICAL'""",
    "q_hits2": """SELECT r.question_id, 2 AS step, r.ord AS entity_ord, x.k AS top, 0 AS level, x.section_id, x.relevance FROM q_known r JOIN (
  SELECT k.key, m.section_id, m.relevance, row_number() OVER (PARTITION BY k.key ORDER BY s.start_index NULLS LAST, m.section_id, m.entity_id) AS k
  FROM (SELECT DISTINCT lower(entity_name) AS key FROM q_known WHERE question_id NOT IN (SELECT question_id FROM q_hits1)) k
  JOIN g_entities e ON contains(lower(e.name), k.key) JOIN g_mentions m ON m.entity_id = e.entity_id JOIN g_sections s ON s.section_id = m.section_id) x
ON x.key = lower(r.entity_name) AND x.k <= 10 WHERE r.question_id NOT IN (SELECT question_id FROM q_hits1)""",
    "q_hits3": """SELECT question_id, 3 AS step, 0 AS entity_ord, row_number() OVER (PARTITION BY question_id ORDER BY doc_id, start_index NULLS LAST, section_id) AS top, 0 AS level, section_id, NULL AS relevance
FROM (SELECT DISTINCT w.question_id, s.section_id, s.doc_id, s.start_index FROM q_words w JOIN g_sections s ON contains(lower(s.title), lower(w.name))
  WHERE w.question_id NOT IN (SELECT question_id FROM q_hits1 UNION ALL SELECT question_id FROM q_hits2)) t""",
    "q_hits": """SELECT question_id, CAST(row_number() OVER (PARTITION BY question_id ORDER BY entity_ord, top, level, coalesce(relevance, ''), section_id) AS INT) AS ord, section_id, relevance, step
FROM (SELECT * FROM (SELECT * FROM q_hits1 UNION ALL SELECT * FROM q_hits2 UNION ALL SELECT * FROM q_hits3) u
QUALIFY row_number() OVER (PARTITION BY question_id, section_id ORDER BY entity_ord, top, level, coalesce(relevance, '')) = 1) f""",
    "q_near2": """SELECT DISTINCT r.question_id, r.ord AS entity_ord, 0 AS hops, o.entity_id, 'RELATED_TO' AS relationship, '' AS rel FROM q_known r JOIN g_mentions m ON m.entity_id = r.entity_id
JOIN g_mentions o ON o.section_id = m.section_id AND o.entity_id <> r.entity_id WHERE r.intent <> 'HIERARCHICAL'
UNION ALL SELECT r.question_id, r.ord, h.hops, h.node_id, h.relationship, h.relationship FROM q_known r JOIN q_hops h ON h.entity_id = r.entity_id WHERE r.intent IN ('EXPLORATION', 'TEMPORAL')""",
    "q_found": """SELECT question_id, CAST(row_number() OVER (PARTITION BY question_id ORDER BY entity_ord, hops, entity_id, rel) AS INT) AS ord, entity_id, relationship
FROM (SELECT * FROM q_near2 QUALIFY row_number() OVER (PARTITION BY question_id, entity_id ORDER BY entity_ord, hops, entity_id, rel) = 1) u""",
}


def with_tables(query: str) -> str:
    import re

    needed, text = [], query
    while more := [n for n in SQL if n not in needed and re.search(rf"\b{n}\b", text)]:
        needed += more
        text += "".join(SQL[n] for n in more)
    parts = ", ".join(f"{n} AS ({SQL[n]})" for n in SQL if n in needed)
    return with_views("WITH " + parts + "\n" + query if parts else query)


class Questions:
    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.g = spark, load_graph(spark, sf_dir)

    @property
    def names(self) -> DataFrame:
        return patterns.session_entities(self.g).select(F.col("turn_id").alias("question_id"), F.when(F.col("role") == "PRIMARY", 1).otherwise(2).alias("ord"), F.upper("name").alias("name"))

    @property
    def resolved(self) -> DataFrame:
        return retrieval.resolve_entity_names(self.g, self.names)

    @property
    def hits(self) -> DataFrame:
        from pyspark.sql import Window

        order = Window.partitionBy("turn_id").orderBy(F.desc("rank_score"), "section_id")
        return self.g["turn_sections"].select(F.col("turn_id").alias("question_id"), "section_id", F.row_number().over(order).alias("ord"), F.lit("").alias("title"), F.lit("MENTIONS").alias("relevance"))

    @property
    def hydrated(self) -> DataFrame:
        return retrieval.hydrate_sections(self.g, self.hits)

    @property
    def related(self) -> DataFrame:
        r = patterns.multi_hop_entities(self.g, 1, self.resolved.select("entity_id"))
        r = r.withColumnRenamed("entity_id", "rid").withColumnRenamed("start_id", "entity_id").withColumnRenamed("name", "rname").withColumnRenamed("entity_type", "rtype")
        return self.resolved.select("question_id", "ord", "entity_id").join(r, "entity_id").select(
            "question_id", (F.col("ord") * 10**12 + F.col("rid") * 100 + F.length("relationship")).alias("ord"), F.col("rid").alias("entity_id"), F.col("rname").alias("name"), F.col("rtype").alias("entity_type"), "relationship")


    @property
    def asked(self) -> DataFrame:
        """The questions, with the six intents in turn."""
        intents = F.array(*map(F.lit, ("LOOKUP", "RELATIONSHIP", "EXPLORATION", "COMPARISON", "HIERARCHICAL", "TEMPORAL")))
        half = F.floor(F.col("turn_id") / 2)
        return self.g["turns"].select(F.col("turn_id").alias("question_id"), "question", F.get(intents, (half % 6).cast("int")).alias("intent"))

    @property
    def words(self) -> DataFrame:
        """Names of the questions: none for every seventh, a title instead for every eleventh."""
        half = F.floor(F.col("question_id") / 2)
        name = F.when(half % 11 == 0, F.concat(F.lit("ORDER "), F.col("question_id").cast("string"))).otherwise(F.col("name"))
        return self.names.filter(half % 7 != 0).withColumn("name", name)

    @property
    def known(self) -> DataFrame:
        return retrieval.resolve_entity_names(self.g, self.words).join(self.asked.select("question_id", "intent"), "question_id")


def query(sql: str | None = None):
    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(Questions(spark, sf_dir))

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        if sql is not None:
            ORACLES[f.__name__] = with_tables(sql)
        return f

    return register


_INTENT = "CASE " + " ".join(
    "WHEN " + " OR ".join(f"contains(concat(' ', lower(coalesce(question, '')), ' '), '{w}')" for w in words) + f" THEN '{name}'" for name, words in models.INTENT_WORDS
) + " ELSE 'EXPLORATION' END"


@query(f"SELECT turn_id, {_INTENT} AS intent FROM g_turns")
def intent_rules(q):
    return q.g["turns"].select("turn_id", models.intent(F.col("question")).alias("intent"))


@query("SELECT question_id, ord, name, entity_id, entity_name, entity_type FROM q_resolved")
def resolve_entity_names(q):
    return q.resolved


@query("""SELECT r.source_entity * 10000000 + r.target_entity AS ord, s.entity_id AS source_id, t.entity_id AS target_id, r.relationship
FROM (SELECT DISTINCT source_entity, target_entity, relationship FROM g_relationships) r JOIN (SELECT name, min(entity_id) AS entity_id FROM g_entities GROUP BY name) s
  ON s.name = (SELECT name FROM g_entities e WHERE e.entity_id = r.source_entity)
JOIN (SELECT name, min(entity_id) AS entity_id FROM g_entities GROUP BY name) t ON t.name = (SELECT name FROM g_entities e WHERE e.entity_id = r.target_entity)""")
def resolve_relationship_endpoints(q):
    """Relations given by names, the sources with their types in brackets."""
    e = q.g["entities"].select("entity_id", "name", F.col("entity_id").alias("ord"))
    rows = patterns.related_entities(q.g).join(q.g["entities"].select(F.col("entity_id").alias("source_id"), "entity_type"), "source_id").select(
        (F.col("source_id") * 10_000_000 + F.col("related_id")).alias("ord"), F.concat("source_name", F.lit(" ("), "entity_type", F.lit(")")).alias("source"), F.col("related_name").alias("target"), "relationship").distinct()
    return retrieval.resolve_relationship_endpoints(e, rows)


@query("SELECT question_id, entity_ord, node_id, node_label, edge_label, concat('Section mentions entity ''', entity_name, '''') AS reason FROM q_near")
def intent_lookup(q):
    return retrieval.intent_lookup(q.g, q.resolved).select("question_id", "entity_ord", "node_id", "node_label", "edge_label", "reason")


@query("SELECT question_id, entity_ord, node_id, node_label, edge_label, concat('Comparison context for ''', entity_name, '''') AS reason FROM q_near")
def intent_comparison(q):
    return retrieval.intent_comparison(q.g, q.resolved).select("question_id", "entity_ord", "node_id", "node_label", "edge_label", "reason")


@query(f"""SELECT p.source_id AS question_id, 1 AS entity_ord, p.mid_id AS node_id, p.mid_name AS node_label, p.r1_type AS edge_label,
  concat('Path from ''', p.source_name, ''' to ''', p.target_name, '''') AS reason
FROM ({PATHS}) p JOIN (SELECT source_id, min(target_id) AS t FROM ({PATHS}) x GROUP BY source_id) m ON m.source_id = p.source_id AND m.t = p.target_id""")
def intent_relationship(q):
    """For every entity with paths, how it is connected with the first that they lead to."""
    paths = patterns.entity_paths(q.g)
    ends = paths.groupBy("source_id", "source_name").agg(F.min_by("target_name", "target_id").alias("target_name"))
    names = ends.select(F.col("source_id").alias("question_id"), F.posexplode(F.array("source_name", "target_name")).alias("k", "name"))
    resolved = retrieval.resolve_entity_names(q.g, names.select("question_id", (F.col("k") + 1).alias("ord"), "name"))
    return retrieval.intent_relationship(q.g, resolved).select("question_id", "entity_ord", "node_id", "node_label", "edge_label", "reason")


@query("""SELECT question_id, entity_ord, node_type, node_id, node_label, edge_label, concat('Section mentions entity ''', entity_name, '''') AS reason FROM q_near
UNION ALL SELECT question_id, entity_ord, node_type, node_id, node_label, edge_label, concat('Multi-hop entity from ''', entity_name, '''') FROM q_far""")
def intent_exploration(q):
    return retrieval.intent_exploration(q.g, q.resolved).select("question_id", "entity_ord", "node_type", "node_id", "node_label", "edge_label", "reason")


@query("""SELECT x.question_id, x.entity_ord, x.node_id, s.title AS node_label FROM (
  SELECT r.question_id, min(r.ord) AS entity_ord, d.node AS node_id FROM q_resolved r JOIN (
    SELECT e.entity_id, w.node FROM (SELECT p_partkey + 1 AS entity_id, 1000000000 + k AS top FROM part, (SELECT DISTINCT l_partkey, doc_id AS k FROM lineitem JOIN g_sections ON section_id = l_orderkey + 1) x WHERE x.l_partkey = p_partkey) e
    JOIN (SELECT parent_id AS top, child_id AS node FROM g_hierarchy UNION ALL SELECT a.parent_id, b.child_id FROM g_hierarchy a JOIN g_hierarchy b ON b.parent_id = a.child_id) w ON w.top = e.top) d
  ON d.entity_id = r.entity_id GROUP BY r.question_id, d.node) x JOIN g_sections s ON s.section_id = x.node_id""")
def intent_hierarchical(q):
    """Mentions lifted to the reports' first sections, so that there is something below them."""
    lifted = q.g["section_entities"].join(q.g["sections"].select("section_id", "doc_id"), "section_id").select(F.lit(None).cast("long").alias("edge_id"), (F.col("doc_id") + 1_000_000_000).alias("section_id"), "entity_id", "relevance")
    g = q.g.with_table("section_entities", lifted)
    return retrieval.intent_hierarchical(g, q.resolved).select("question_id", "entity_ord", "node_id", "node_label")


@query("""SELECT question_id, CAST(row_number() OVER (PARTITION BY question_id ORDER BY entity_ord, row_ord, edge_label, entity_name) AS INT) AS step_number, node_type, node_id, node_label, edge_label, edge_direction
FROM (SELECT * FROM q_near UNION ALL SELECT * FROM q_far) u""")
def traversal_path(q):
    steps = retrieval.intent_exploration(q.g, q.resolved)
    return retrieval.traversal_path(steps).select("question_id", "step_number", "node_type", "node_id", "node_label", "edge_label", "edge_direction")


@query("SELECT * FROM q_full")
def hydrate_sections(q):
    return q.hydrated


_RELATED = """SELECT r.question_id, r.ord * CAST(1000000000000 AS BIGINT) + h.node_id * 100 + length(h.relationship) AS ord, h.node_id AS entity_id, e.name, e.entity_type, h.relationship
FROM q_resolved r JOIN q_hops h ON h.entity_id = r.entity_id AND h.hops = 1 JOIN g_entities e ON e.entity_id = h.node_id"""


@query(f"""SELECT question_id, ord, entity_id, name, entity_type, relationship FROM (SELECT *, row_number() OVER (PARTITION BY question_id, entity_id ORDER BY ord) AS k FROM ({_RELATED}) x) y WHERE k = 1""")
def dedupe_related(q):
    return retrieval.dedupe_related(q.related)


_CONTEXT = """SELECT question_id, ord, section_id, text, tokens, used <= 60 AS fits FROM (
  SELECT *, 8 + sum(tokens) OVER (PARTITION BY question_id ORDER BY ord) AS used FROM (
    SELECT question_id, ord, section_id, text, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens FROM (
      SELECT *, concat('### ', title, chr(10), '**Document:** ', doc_name, ' | **Depth:** ', CAST(depth_level AS VARCHAR), chr(10), '**Relevance:** ', relevance, chr(10), chr(10), coalesce(text_content, summary), chr(10)) AS text FROM q_full) a) b) c"""


@query(f"SELECT question_id, ord, section_id, text, tokens, false AS truncated FROM ({_CONTEXT}) x WHERE fits")
def context_budget(q):
    return retrieval.context_budget(q.hydrated, 60)


@query("SELECT question_id, title, doc_name, min(ord) AS ord FROM q_full GROUP BY question_id, title, doc_name")
def answer_sources(q):
    return retrieval.answer_sources(q.hydrated)


@query("""SELECT section_id, name, type, relevance FROM (
  SELECT m.section_id, trim(e.name) AS name, upper(e.entity_type) AS type, m.relevance FROM g_mentions m JOIN g_entities e ON e.entity_id = m.entity_id) x""")
def validate_entities(q):
    """Mentions as a model would give them, with blanks and two faulty entries each."""
    e = patterns.entity_sections(q.g)
    found = F.struct(F.concat(F.lit(" "), "entity_name", F.lit(" ")).alias("name"), F.lower("entity_type").alias("type"), F.lower("relevance").alias("relevance"))
    bad = [F.struct(F.lit(n).alias("name"), F.lit(t).alias("type"), F.lit(None).cast("string").alias("relevance")) for n, t in ((" ", "x"), ("x", ""))]
    return retrieval.validate_entities(e.select("section_id", F.array(found, *bad).alias("entities")))


@query("SELECT source_entity AS source, target_entity AS target, relationship FROM g_relationships WHERE relationship <> 'PART_OF'")
def validate_relationships(q):
    rows = q.g["entity_relationships"].select(F.col("source_entity").cast("string").alias("source"), F.col("target_entity").cast("string").alias("target"), F.nullif("relationship", F.lit("PART_OF")).alias("relationship"))
    kept = retrieval.validate_relationships(rows)
    return kept.select(F.col("source").cast("long").alias("source"), F.col("target").cast("long").alias("target"), "relationship")


@query("""SELECT s.section_id, t.name, t.type, 'MENTIONS' AS relevance FROM g_sections s JOIN (VALUES ('Urgent', 'CONCEPT'), ('Overview', 'CONCEPT'), ('short', 'METRIC')) t(name, type)
ON list_contains(regexp_extract_all(lower(coalesce(s.summary, s.text_content)), '\\w+'), lower(t.name))""")
def extract_entities(q):
    terms = q.spark.createDataFrame([("Urgent", "CONCEPT"), ("Overview", "CONCEPT"), ("short", "METRIC")], "name string, type string")
    return retrieval.extract_entities(q.g["sections"], terms)


@query(f"""SELECT section_id, CASE WHEN k % 5 = 3 THEN summary ELSE title END AS name, CASE WHEN k % 5 = 3 THEN 'METRIC' ELSE 'CONCEPT' END AS type,
  CASE WHEN k % 5 = 3 THEN 'MENTIONS' ELSE 'DISCUSSES' END AS relevance
FROM (SELECT section_id, title, summary, row_number() OVER (PARTITION BY doc_id, section_id // {prompts.RUN} ORDER BY section_id) - 1 AS k FROM g_sections) s""")
def batched_entities(q):
    """Five sections to a prompt, by a model that loses, repeats and invents some: none is lost."""
    return extraction.extract_entities(q.g["sections"], ForgetfulTitles(), size=5)


@query("""SELECT source_entity, target_entity, CASE WHEN relationship = 'SUPPLIES' THEN NULL WHEN relationship = 'RELATED_TO' THEN 'RELATED_TO' ELSE 'PART_OF' END AS parsed FROM g_relationships""")
def parse_relationship(q):
    """Answers that wrap a type in words, or say none of the known ones."""
    answer = F.concat(F.lit("I think: "), F.lower("relationship"), F.lit("."))
    return q.g["entity_relationships"].select("source_entity", "target_entity", enrichment.parse_relationship(answer).alias("parsed"))


@query("""SELECT session_id, true AS valid FROM g_sessions""")
def repaired_answers(q):
    """Fenced answers with None and trailing commas, read as JSON."""
    answer = F.concat(F.lit("Sure:\n```json\n{\"id\": "), F.col("session_id").cast("string"), F.lit(", \"x\": None, \"y\": [1, 2,],}\n```\n"))
    read = F.from_json(repaired_json(answer), "id long, x string, y array<int>")
    return q.g["sessions"].select("session_id", ((read["id"] == F.col("session_id")) & read["x"].isNull() & (F.size(read["y"]) == 2)).alias("valid"))


@query(f"""SELECT s.question_id, CAST(to_json({{'sections': s.l, 'related': coalesce(r.l, [])}}) AS VARCHAR) AS result FROM (
  SELECT question_id, list({{'title': title, 'doc_name': doc_name, 'summary': substring(summary, 1, 200)}} ORDER BY ord) AS l FROM q_full GROUP BY question_id) s
LEFT JOIN (SELECT question_id, list({{'name': name, 'entity_type': entity_type, 'relationship': relationship}} ORDER BY name, entity_type, relationship) AS l FROM (
  SELECT *, row_number() OVER (PARTITION BY question_id, entity_id ORDER BY ord) AS k FROM ({_RELATED}) x) y WHERE k = 1 GROUP BY question_id) r ON r.question_id = s.question_id""")
def structured_retrieve(q):
    return retrieval.structured_retrieve(q.hydrated, retrieval.dedupe_related(q.related))


_REASON = "CASE intent WHEN 'COMPARISON' THEN 'Comparison context for ''' ELSE 'Section mentions entity ''' END || entity_name || ''''"


@query(f"""SELECT question_id, CAST(row_number() OVER (PARTITION BY question_id ORDER BY entity_ord, row_ord, edge_label, reason) AS INT) AS step_number, node_type, node_id, node_label, edge_label, edge_direction, reason FROM (
  SELECT * FROM (SELECT r.question_id, r.ord AS entity_ord, m.section_id AS row_ord, 'section' AS node_type, m.section_id AS node_id, m.title AS node_label, 'mentions' AS edge_label, 'inbound' AS edge_direction, {_REASON} AS reason
    FROM q_known r JOIN q_shared m ON m.entity_id = r.entity_id WHERE r.intent NOT IN ('RELATIONSHIP', 'HIERARCHICAL')) n
    QUALIFY row_number() OVER (PARTITION BY question_id, node_id ORDER BY entity_ord, row_ord, reason) = 1
  UNION ALL SELECT r.question_id, r.ord, h.node_id + h.hops * CAST(1000000000000 AS BIGINT), 'entity', h.node_id, e.name, h.relationship, 'outbound', 'Multi-hop entity from ''' || r.entity_name || ''''
    FROM q_known r JOIN q_hops h ON h.entity_id = r.entity_id JOIN g_entities e ON e.entity_id = h.node_id WHERE r.intent IN ('EXPLORATION', 'TEMPORAL')
  UNION ALL SELECT r.question_id, r.ord, p.mid_id, 'entity', p.mid_id, p.mid_name, p.r1_type, 'outbound', 'Path from ''' || r.entity_name || ''' to ''' || t.entity_name || ''''
    FROM q_known r JOIN q_known t ON t.question_id = r.question_id AND t.ord = r.ord + 1 JOIN ({PATHS}) p ON p.source_id = r.entity_id AND p.target_id = t.entity_id WHERE r.intent = 'RELATIONSHIP'
  UNION ALL SELECT * FROM (SELECT r.question_id, r.ord AS entity_ord, b.node AS row_ord, 'section', b.node AS node_id, c.title, 'parent_of', 'outbound', 'Descendant of section ''' || s.title || '''' AS reason
    FROM q_known r JOIN g_mentions m ON m.entity_id = r.entity_id JOIN q_below b ON b.top = m.section_id JOIN g_sections s ON s.section_id = b.top JOIN g_sections c ON c.section_id = b.node WHERE r.intent = 'HIERARCHICAL') h
    QUALIFY row_number() OVER (PARTITION BY question_id, node_id ORDER BY entity_ord, row_ord, reason) = 1) u""")
def question_dispatch(q):
    """Traversals for questions of all intents, in one plan."""
    return retrieval.dispatch(q.g, q.known)


@query("SELECT question_id, ord, section_id, relevance, step FROM q_hits")
def question_sections(q):
    """The sections that every question's context is made of, and what found them."""
    return answers.section_hits(q.g, q.asked, q.words, q.known).select("question_id", "ord", "section_id", "relevance", "step")


@query("SELECT question_id, ord, entity_id, relationship FROM q_found")
def question_related(q):
    return answers.related_entities(q.g, q.known).select("question_id", "ord", "entity_id", "relationship")


@query("""SELECT a.question_id, a.intent, CASE WHEN w.question_id IS NULL THEN 'no names' WHEN s.n IS NULL THEN 'no sections' ELSE 'answered' END AS outcome,
  coalesce(s.n, 0) AS n_sections, coalesce(r.n, 0) AS n_related FROM q_asked a LEFT JOIN (SELECT DISTINCT question_id FROM q_words) w ON w.question_id = a.question_id
LEFT JOIN (SELECT question_id, count(*) AS n FROM q_hits GROUP BY question_id) s ON s.question_id = a.question_id
LEFT JOIN (SELECT question_id, count(*) AS n FROM q_found GROUP BY question_id) r ON r.question_id = a.question_id""")
def question_answers(q):
    """All questions answered by the stand-in client: what became of them, and over how much."""
    found = answers.answer(q.g, q.asked, q.words)
    counted = lambda rows, name: rows.groupBy("question_id").agg(F.count("*").alias(name))
    out = found.answers.join(counted(found.sections, "n_sections"), "question_id", "left").join(counted(found.related, "n_related"), "question_id", "left")
    return out.select("question_id", "intent", "outcome", F.coalesce("n_sections", F.lit(0)).alias("n_sections"), F.coalesce("n_related", F.lit(0)).alias("n_related"))
