"""Queries over the whole graph, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbograph.operators import enrichment, hierarchy, patterns, reads, sessions, temporal, views
from arbograph.sources.tables import load_graph, with_views

#: Texts that the searches by name look for.
NAMES = ["red widget", "supplier#00000001", "a_t 7"]
CONCEPTS = ["urgent", "order 11"]

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of a graph under its name; ``sql`` may name the graph's tables."""

    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(load_graph(spark, sf_dir))

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        if sql is not None:
            ORACLES[f.__name__] = with_views(sql)
        return f

    return register


def _names(g, names=tuple(NAMES)) -> DataFrame:
    return g.spark.createDataFrame([(n,) for n in names], "query string")


_NAME_VALUES = ", ".join(f"('{n}')" for n in NAMES)


@query("SELECT doc_id, doc_name, doc_version, doc_group FROM g_documents")
def all_documents(g):
    return reads.all_documents(g).select("doc_id", "doc_name", "doc_version", "doc_group")


@query("""SELECT doc_id, section_id, title, start_index, depth_level,
  CAST(row_number() OVER (PARTITION BY doc_id ORDER BY start_index, section_id) AS INT) AS ord FROM g_sections""")
def document_sections(g):
    return reads.document_sections(g).select("doc_id", "section_id", "title", "start_index", "depth_level", "ord")


@query("SELECT entity_id, name, entity_type FROM g_entities")
def all_entities(g):
    return reads.all_entities(g).select("entity_id", "name", "entity_type")


@query("""SELECT s.section_id, s.title, s.summary, s.text_content, s.depth_level, s.start_index, d.doc_id, d.doc_name
FROM g_sections s JOIN g_documents d ON d.doc_id = s.doc_id WHERE s.section_id IN (SELECT section_id FROM g_turn_sections)""")
def sections_by_ids(g):
    return reads.sections_by_ids(g, g["turn_sections"]).drop("end_index")


@query("""SELECT h.parent_id, s.section_id, s.title, s.start_index,
  CAST(row_number() OVER (PARTITION BY h.parent_id ORDER BY s.start_index, s.section_id) AS INT) AS ord
FROM g_sections s JOIN g_hierarchy h ON h.child_id = s.section_id""")
def section_children(g):
    return reads.section_children(g).select("parent_id", "section_id", "title", "start_index", "ord")


@query("""SELECT m.section_id, e.entity_id, e.name, e.entity_type, m.relevance
FROM g_entities e JOIN g_mentions m ON m.entity_id = e.entity_id""")
def section_entities(g):
    return reads.section_entities(g).drop("description")


@query(f"""SELECT query, ord, section_id, entity_id, title, depth_level, relevance, start_index, doc_id, doc_name FROM (
  SELECT q.query, CAST(row_number() OVER (PARTITION BY q.query ORDER BY s.start_index, s.section_id, e.entity_id) AS INT) AS ord,
    s.section_id, e.entity_id, s.title, s.depth_level, m.relevance, s.start_index, d.doc_id, d.doc_name
  FROM (VALUES {_NAME_VALUES}) q(query) JOIN g_entities e ON lower(e.name) LIKE '%' || lower(q.query) || '%'
  JOIN g_mentions m ON m.entity_id = e.entity_id JOIN g_sections s ON s.section_id = m.section_id
  JOIN g_documents d ON d.doc_id = s.doc_id) t WHERE ord <= 10""")
def entity_sections(g):
    return reads.entity_sections(g, _names(g))


@query(f"""SELECT query, ord, entity_id, name, entity_type, relationship FROM (
  SELECT q.query, CAST(row_number() OVER (PARTITION BY q.query ORDER BY e2.name, e2.entity_id, r.source_entity, r.relationship) AS INT) AS ord,
    e2.entity_id, e2.name, e2.entity_type, r.relationship
  FROM (VALUES {_NAME_VALUES}) q(query) JOIN g_entities e1 ON lower(e1.name) LIKE '%' || lower(q.query) || '%'
  JOIN g_relationships r ON r.source_entity = e1.entity_id JOIN g_entities e2 ON e2.entity_id = r.target_entity) t WHERE ord <= 20""")
def related_entities(g):
    return reads.related_entities(g, _names(g)).drop("description")


@query("""SELECT DISTINCT s.doc_id, e.entity_id, e.name, e.entity_type FROM g_entities e
JOIN g_mentions m ON m.entity_id = e.entity_id JOIN g_sections s ON s.section_id = m.section_id""")
def doc_entities(g):
    return reads.doc_entities(g)


@query("""SELECT entity1_id, entity2_id, string_agg(text_content, chr(10) || chr(10) ORDER BY ord) AS text FROM (
  SELECT p.source_entity AS entity1_id, p.target_entity AS entity2_id, s.text_content,
    row_number() OVER (PARTITION BY p.source_entity, p.target_entity ORDER BY s.section_id) AS ord
  FROM (SELECT DISTINCT source_entity, target_entity FROM g_relationships) p
  JOIN g_mentions m1 ON m1.entity_id = p.source_entity
  JOIN g_mentions m2 ON m2.entity_id = p.target_entity AND m2.section_id = m1.section_id
  JOIN g_sections s ON s.section_id = m1.section_id) t WHERE ord <= 3 GROUP BY entity1_id, entity2_id""")
def shared_section_text(g):
    pairs = g["entity_relationships"].select(F.col("source_entity").alias("entity1_id"), F.col("target_entity").alias("entity2_id"))
    return reads.shared_section_text(g, pairs)


@query(f"""SELECT s.section_id, s.doc_id, d.doc_name, s.title, s.start_index, s.depth_level
FROM g_sections s JOIN g_documents d ON d.doc_id = s.doc_id
WHERE {' OR '.join(f"contains(lower(s.title), '{c}')" for c in CONCEPTS)}""")
def title_search(g):
    return reads.title_search(g, CONCEPTS)


@query(" UNION ALL ".join(
    f"SELECT '{label}' AS label, '{kind}' AS kind, count(*) AS n FROM {view}"
    for label, kind, view in (
        ("documents", "vertex", "g_documents"), ("sections", "vertex", "g_sections"), ("entities", "vertex", "g_entities"),
        ("sessions", "vertex", "g_sessions"), ("turns", "vertex", "g_turns"), ("section_hierarchy", "edge", "g_hierarchy"),
        ("section_entities", "edge", "g_mentions"), ("entity_relationships", "edge", "g_relationships"),
        ("turn_entities", "edge", "g_turn_entities"), ("turn_sections", "edge", "g_turn_sections"),
    )
))
def graph_stats(g):
    return reads.graph_stats(g)


@query("SELECT section_id, doc_id, title FROM g_sections WHERE depth_level = 0 AND title IS NOT NULL")
def top_level_sections(g):
    return reads.top_level_sections(g)


@query("""SELECT s.section_id, s.title AS section_title, s.depth_level, m.relevance, e.entity_id, e.name AS entity_name, e.entity_type
FROM g_sections s JOIN g_mentions m ON m.section_id = s.section_id JOIN g_entities e ON e.entity_id = m.entity_id""")
def pgq_entity_sections(g):
    return patterns.entity_sections(g)


@query("""SELECT d.doc_name, s.section_id, s.title AS section_title, e.name AS entity_name, m.relevance
FROM g_documents d JOIN g_sections s ON s.doc_id = d.doc_id JOIN g_mentions m ON m.section_id = s.section_id
JOIN g_entities e ON e.entity_id = m.entity_id WHERE e.entity_type <> 'SUPPLIER'""")
def pgq_entity_sections_docs(g):
    return patterns.entity_sections_with_documents(g, F.col("entity_type") != "SUPPLIER")


@query("""SELECT a.entity_id AS source_id, a.name AS source_name, r.relationship, b.entity_id AS related_id, b.name AS related_name, b.entity_type AS related_type
FROM g_entities a JOIN g_relationships r ON r.source_entity = a.entity_id JOIN g_entities b ON b.entity_id = r.target_entity""")
def pgq_related_entities(g):
    return patterns.related_entities(g)


@query("""SELECT p.section_id AS parent_id, p.title AS parent_title, c.section_id AS child_id, c.title AS child_title
FROM g_hierarchy h JOIN g_sections p ON p.section_id = h.parent_id JOIN g_sections c ON c.section_id = h.child_id""")
def hierarchy_pairs(g):
    return patterns.hierarchy_pairs(g)


_NEIGHBOURS = """SELECT m.entity_id, s.section_id, s.title, s.depth_level, m.relevance,
  e2.entity_id AS co_entity_id, e2.name AS co_entity_name, e2.entity_type AS co_entity_type
FROM g_mentions m JOIN g_mentions m2 ON m2.section_id = m.section_id AND m2.entity_id <> m.entity_id
JOIN g_sections s ON s.section_id = m.section_id JOIN g_entities e2 ON e2.entity_id = m2.entity_id"""


@query(_NEIGHBOURS)
def entity_neighborhood(g):
    return patterns.entity_neighborhood(g)


@query(f"SELECT DISTINCT entity_id, section_id, title, depth_level, relevance FROM ({_NEIGHBOURS}) t")
def neighborhood_sections(g):
    return patterns.neighborhood_sections(g)


@query(f"SELECT DISTINCT entity_id, co_entity_id, co_entity_name AS name, co_entity_type AS entity_type FROM ({_NEIGHBOURS}) t")
def neighborhood_entities(g):
    return patterns.neighborhood_entities(g)


PATHS = """SELECT a.entity_id AS source_id, a.name AS source_name, m.entity_id AS mid_id, m.name AS mid_name, m.entity_type AS mid_type,
  r1.relationship AS r1_type, b.entity_id AS target_id, b.name AS target_name, r2.relationship AS r2_type
FROM g_relationships r1 JOIN g_relationships r2 ON r2.source_entity = r1.target_entity
JOIN g_entities a ON a.entity_id = r1.source_entity JOIN g_entities m ON m.entity_id = r1.target_entity
JOIN g_entities b ON b.entity_id = r2.target_entity"""


@query(PATHS)
def entity_paths(g):
    return patterns.entity_paths(g)


@query(f"""SELECT source_query, target_query, ord, source_id, source_name, mid_id, mid_name, mid_type, r1_type, target_id, target_name, r2_type FROM (
  SELECT q.s AS source_query, q.t AS target_query, p.*,
    CAST(row_number() OVER (PARTITION BY q.s, q.t ORDER BY source_id, mid_id, target_id, r1_type, r2_type) AS INT) AS ord
  FROM (VALUES ('supplier', '1'), ('widget', 'red')) q(s, t) JOIN ({PATHS}) p
  ON lower(p.source_name) LIKE '%' || q.s || '%' AND lower(p.target_name) LIKE '%' || q.t || '%') x WHERE ord <= 10""")
def entity_paths_by_name(g):
    pairs = g.spark.createDataFrame([("supplier", "1"), ("widget", "red")], "source_query string, target_query string")
    return patterns.entity_paths_by_name(g, pairs)


@query("""SELECT t.start_id, t.entity_id, e.name, e.entity_type, t.relationship, t.hops FROM (
  SELECT source_entity AS start_id, target_entity AS entity_id, relationship, 1 AS hops FROM g_relationships
  UNION
  SELECT r1.source_entity, r2.target_entity, r2.relationship, 2 FROM g_relationships r1
  JOIN g_relationships r2 ON r2.source_entity = r1.target_entity WHERE r2.target_entity <> r1.source_entity) t
JOIN g_entities e ON e.entity_id = t.entity_id""")
def multi_hop_entities(g):
    return patterns.multi_hop_entities(g)


@query("""SELECT a.name AS source_name, r.relationship, b.name AS target_name, b.entity_type AS target_type
FROM g_entities a JOIN g_relationships r ON r.source_entity = a.entity_id JOIN g_entities b ON b.entity_id = r.target_entity
WHERE a.entity_type = 'SUPPLIER'""")
def org_relationships(g):
    return patterns.typed_relationships(g, "SUPPLIER")


@query("""SELECT e.entity_id, e.name, e.entity_type, count(*) AS mention_count FROM g_entities e
JOIN g_mentions m ON m.entity_id = e.entity_id GROUP BY ALL ORDER BY mention_count DESC, e.entity_id LIMIT 15""")
def most_mentioned(g):
    return patterns.most_mentioned(g)


@query("""SELECT t.session_id, t.turn_id, t.turn_number, x.role, e.entity_id, e.name, e.entity_type
FROM g_turns t JOIN g_turn_entities x ON x.turn_id = t.turn_id JOIN g_entities e ON e.entity_id = x.entity_id""")
def session_entities(g):
    return patterns.session_entities(g)


_DOWN = """FROM (SELECT parent_id AS start, child_id AS node, 1 AS tree_level FROM g_hierarchy
  UNION ALL SELECT h1.parent_id, h2.child_id, 2 FROM g_hierarchy h1 JOIN g_hierarchy h2 ON h2.parent_id = h1.child_id
  UNION ALL SELECT h1.parent_id, h3.child_id, 3 FROM g_hierarchy h1 JOIN g_hierarchy h2 ON h2.parent_id = h1.child_id
    JOIN g_hierarchy h3 ON h3.parent_id = h2.child_id) w"""


@query(f"SELECT w.start, s.section_id, s.title, s.depth_level, w.tree_level {_DOWN} JOIN g_sections s ON s.section_id = w.node")
def section_descendants(g):
    return hierarchy.section_descendants(g)


@query(f"SELECT w.node AS start, s.section_id, s.title, s.depth_level, w.tree_level {_DOWN} JOIN g_sections s ON s.section_id = w.start")
def section_ancestors(g):
    return hierarchy.section_ancestors(g)


@query(f"""SELECT f.title AS root_title, s.section_id AS child_section_id, s.title AS child_title, s.depth_level AS child_depth, w.tree_level
{_DOWN} JOIN (SELECT title, min(section_id) AS start FROM g_sections WHERE depth_level < 2 GROUP BY title) f ON f.start = w.start
JOIN g_sections s ON s.section_id = w.node""")
def section_subtree_by_title(g):
    return hierarchy.section_subtree_by_title(g, g["sections"].filter("depth_level < 2"))


@query("""SELECT e.entity_id, e.name, e.entity_type, c.mention_count FROM g_entities e
JOIN (SELECT entity_id, count(*) AS mention_count FROM g_mentions GROUP BY entity_id HAVING count(*) >= 2) c ON c.entity_id = e.entity_id
WHERE e.entity_id NOT IN (SELECT source_entity FROM g_relationships) AND e.entity_id NOT IN (SELECT target_entity FROM g_relationships)""")
def isolated_entities(g):
    return enrichment.isolated_entities(g)


@query("""SELECT p.a AS entity1_id, e1.name AS entity1_name, e1.entity_type AS entity1_type, p.b AS entity2_id, e2.name AS entity2_name,
  e2.entity_type AS entity2_type, p.n AS shared_sections
FROM (SELECT m1.entity_id AS a, m2.entity_id AS b, count(DISTINCT m1.section_id) AS n FROM g_mentions m1
  JOIN g_mentions m2 ON m2.section_id = m1.section_id AND m1.entity_id < m2.entity_id GROUP BY 1, 2 HAVING count(DISTINCT m1.section_id) >= 2) p
JOIN g_entities e1 ON e1.entity_id = p.a JOIN g_entities e2 ON e2.entity_id = p.b
WHERE NOT EXISTS (SELECT 1 FROM g_relationships r WHERE r.source_entity = p.a AND r.target_entity = p.b)
  AND NOT EXISTS (SELECT 1 FROM g_relationships r WHERE r.source_entity = p.b AND r.target_entity = p.a)""")
def cooccurring_pairs(g):
    return enrichment.cooccurring_pairs(g)


@query("SELECT relationship, 'EXTRACTION' AS edge_source, count(*) AS n FROM g_relationships GROUP BY relationship")
def enrichment_stats(g):
    return enrichment.enrichment_stats(g)


@query("SELECT entity_type, count(*) AS n FROM g_entities GROUP BY entity_type")
def entity_type_distribution(g):
    return enrichment.entity_type_distribution(g)


@query("""SELECT entity_type, string_agg(name, ', ' ORDER BY k) FILTER (WHERE k <= 5) AS names, greatest(count(*) - 5, 0) AS more
FROM (SELECT *, row_number() OVER (PARTITION BY entity_type ORDER BY name, entity_id) AS k FROM g_entities) t GROUP BY entity_type""")
def entities_by_type_sample(g):
    return enrichment.entities_by_type_sample(g)


@query("""SELECT doc_group, string_agg(CAST(doc_version AS VARCHAR), ',' ORDER BY doc_version) AS versions
FROM (SELECT DISTINCT doc_group, doc_version FROM g_documents) t GROUP BY doc_group""")
def doc_group_versions(g):
    return enrichment.doc_group_versions(g)


@query("""SELECT d.doc_id, d.doc_group, d.doc_version, p.doc_id AS previous_id, p.doc_name AS previous_name
FROM g_documents d JOIN g_documents p ON p.doc_group = d.doc_group AND p.doc_version = d.doc_version - 1""")
def previous_version(g):
    return temporal.previous_version(g)


_DIFF = """WITH held AS (
  SELECT s.doc_id, e.name, e.entity_type, min(e.entity_id) AS entity_id FROM g_entities e
  JOIN g_mentions m ON m.entity_id = e.entity_id JOIN g_sections s ON s.section_id = m.section_id GROUP BY 1, 2, 3
), pairs AS (
  SELECT p.doc_id AS old_doc, d.doc_id AS new_doc FROM g_documents d
  JOIN g_documents p ON p.doc_group = d.doc_group AND p.doc_version = d.doc_version - 1
)
SELECT old_doc AS source_doc_id, new_doc AS target_doc_id, coalesce(n.entity_id, o.entity_id) AS entity_id,
  coalesce(n.name, o.name) AS name, coalesce(n.entity_type, o.entity_type) AS entity_type,
  CASE WHEN o.entity_id IS NULL THEN 'APPEARED' WHEN n.entity_id IS NULL THEN 'DISAPPEARED' ELSE 'STABLE' END AS change_type,
  o.name AS old_value, n.name AS new_value
FROM (SELECT DISTINCT old_doc, new_doc, name, entity_type FROM pairs JOIN held ON held.doc_id IN (old_doc, new_doc)) k
LEFT JOIN held o ON o.doc_id = old_doc AND o.name = k.name AND o.entity_type = k.entity_type
LEFT JOIN held n ON n.doc_id = new_doc AND n.name = k.name AND n.entity_type = k.entity_type"""


@query(_DIFF)
def temporal_diff(g):
    return temporal.temporal_diff(g)


def _changed(g):
    """The graph with its differences stored as edges."""
    found = temporal.temporal_diff(g)
    return g.with_table("temporal_edges", found.select(
        (F.col("target_doc_id") * 10_000_000 + F.col("entity_id")).alias("edge_id"), "source_doc_id", "target_doc_id", "entity_id", "change_type", "old_value", "new_value", F.lit(1.0).cast("decimal(3,2)").alias("confidence")))


@query(f"""SELECT d1.doc_group, d1.doc_version AS version_from, d2.doc_version AS version_to, x.entity_id, x.name, x.entity_type,
  x.change_type, x.old_value, x.new_value
FROM ({_DIFF}) x JOIN g_documents d1 ON d1.doc_id = x.source_doc_id JOIN g_documents d2 ON d2.doc_id = x.target_doc_id""")
def temporal_changes(g):
    return temporal.temporal_changes(_changed(g)).drop("edge_id", "confidence")


@query(f"""SELECT d2.doc_group, d2.doc_version, concat('ent_', CAST(e.entity_id AS VARCHAR)) AS id, e.name AS label, max(x.change_type) AS temporal_status
FROM ({_DIFF}) x JOIN g_documents d2 ON d2.doc_id = x.target_doc_id JOIN g_entities e ON e.name = x.name GROUP BY ALL""")
def versioned_graph(g):
    return temporal.versioned_entity_nodes(_changed(g))


@query("SELECT session_id, title FROM g_sessions")
def list_sessions(g):
    return sessions.list_sessions(g).select("session_id", "title")


@query("SELECT session_id, turn_id, turn_number, question, answer, turn_number AS ord FROM g_turns")
def session_turns(g):
    return sessions.session_turns(g).select("session_id", "turn_id", "turn_number", "question", "answer", "ord")


@query("SELECT session_id, turn_id, CAST(row_number() OVER (PARTITION BY session_id ORDER BY turn_id) AS INT) AS turn_number FROM g_turns")
def turn_numbers(g):
    return sessions.turn_numbers(g["turns"].select("session_id", "turn_id"))


_LAST = "(SELECT session_id, arg_max(turn_id, turn_number) AS turn_id FROM g_turns GROUP BY session_id)"


@query(f"""SELECT l.session_id, l.turn_id,
  coalesce((SELECT string_agg(e.name, ',' ORDER BY e.name, e.entity_id) FROM g_turn_entities x JOIN g_entities e ON e.entity_id = x.entity_id
    WHERE x.turn_id = l.turn_id AND x.role = 'PRIMARY'), '') AS primary_entities,
  coalesce((SELECT string_agg(CAST(s.section_id AS VARCHAR), ',' ORDER BY s.rank_score DESC, s.section_id) FROM g_turn_sections s
    WHERE s.turn_id = l.turn_id), '') AS previous_sections
FROM {_LAST} l""")
def session_context(g):
    return sessions.session_context(g)


@query(f"""SELECT l.session_id, e.entity_id, e.name FROM {_LAST} l
JOIN g_turn_entities x ON x.turn_id = l.turn_id AND x.role = 'PRIMARY' JOIN g_entities e ON e.entity_id = x.entity_id
WHERE NOT EXISTS (SELECT 1 FROM g_turns t JOIN g_turn_entities y ON y.turn_id = t.turn_id AND y.role = 'REFERENCED'
  JOIN g_entities k ON k.entity_id = y.entity_id WHERE t.session_id = l.session_id AND lower(k.name) = lower(e.name))""")
def session_supplement(g):
    known = patterns.session_entities(g).filter("role = 'REFERENCED'").select("session_id", "name")
    return sessions.session_supplement(g, known)


@query("""SELECT turn_id, entity_id, min(role) AS role FROM g_turn_entities WHERE entity_id <> 0 GROUP BY turn_id, entity_id""")
def turn_entity_roles(g):
    return sessions.turn_entity_roles(g["turn_entities"].withColumn("ord", F.col("entity_id")))


@query("""SELECT turn_id, section_id, round(1.0 - 0.1 * (row_number() OVER (PARTITION BY turn_id ORDER BY section_id) - 1), 6) AS rank_score
FROM g_turn_sections""")
def turn_section_rank(g):
    ranked = sessions.turn_section_rank(g["turn_sections"].select("turn_id", "section_id", F.col("section_id").alias("ord")))
    return ranked


_NODES = """SELECT concat('doc_', CAST(doc_id AS VARCHAR)) AS id, 'document' AS type, doc_name AS label, doc_group, doc_version FROM g_documents
UNION ALL SELECT concat('sec_', CAST(section_id AS VARCHAR)), 'section', title, NULL, NULL FROM g_sections
UNION ALL SELECT concat('ent_', CAST(entity_id AS VARCHAR)), 'entity', name, NULL, NULL FROM g_entities"""
_EDGES = """SELECT concat('doc_', CAST(doc_id AS VARCHAR)) AS source, concat('sec_', CAST(section_id AS VARCHAR)) AS target, 'contains' AS type FROM g_sections
UNION ALL SELECT concat('sec_', CAST(parent_id AS VARCHAR)), concat('sec_', CAST(child_id AS VARCHAR)), 'parent_of' FROM g_hierarchy
UNION ALL SELECT concat('sec_', CAST(section_id AS VARCHAR)), concat('ent_', CAST(entity_id AS VARCHAR)), lower(relevance) FROM g_mentions
UNION ALL SELECT concat('ent_', CAST(source_entity AS VARCHAR)), concat('ent_', CAST(target_entity AS VARCHAR)), lower(relationship) FROM g_relationships"""


@query(_NODES)
def graph_nodes(g):
    return views.graph_nodes(g)


@query(_EDGES)
def graph_edges(g):
    return views.graph_edges(g)


@query(f"SELECT type, count(*) AS n FROM ({_NODES}) t GROUP BY type")
def node_type_counts(g):
    return views.node_type_counts(g)


@query(f"SELECT source AS id, target AS neighbor, type, 'out' AS direction FROM ({_EDGES}) a UNION ALL SELECT target, source, type, 'in' FROM ({_EDGES}) b")
def node_connections(g):
    return views.node_connections(g)


@query(f"""WITH hits AS (SELECT id FROM ({_NODES}) t WHERE lower(label) LIKE '%or%')
SELECT source, target, type FROM ({_EDGES}) e WHERE source IN (SELECT id FROM hits) AND target IN (SELECT id FROM hits)""")
def search_subgraph(g):
    return views.search_subgraph(g, "OR")


@query(f"""WITH ids AS (SELECT concat('sec_', CAST(section_id AS VARCHAR)) AS id FROM g_turn_sections
  UNION SELECT concat('ent_', CAST(entity_id AS VARCHAR)) FROM g_turn_entities)
SELECT source, target, type FROM ({_EDGES}) e WHERE source IN (SELECT id FROM ids) AND target IN (SELECT id FROM ids)""")
def path_subgraph(g):
    steps = g["turn_sections"].select(F.lit("section").alias("node_type"), F.col("section_id").alias("node_id")).unionByName(g["turn_entities"].select(F.lit("entity").alias("node_type"), F.col("entity_id").alias("node_id")))
    return views.path_subgraph(g, steps)
