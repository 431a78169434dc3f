"""Queries over pages, contents, trees, Markdown and vectors, with their SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbograph.operators import markdown as md
from arbograph.operators import contents, search, structure, vectors
from arbograph.plans.stand_ins import PageReader
from arbograph.session import materialise, read_table
from arbograph.sources import documents as source

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def with_tables(query: str) -> str:
    """``query`` with the tables of ``source.SQL`` that it needs, directly or not, before its own expressions."""
    needed, text = [], query
    while more := [n for n in source.SQL if n not in needed and re.search(rf"\b{n}\b", text)]:
        needed += more
        text += "".join(source.SQL[n] for n in more)
    parts = [f"{n} AS ({source.SQL[n]})" for n in source.SQL if n in needed]
    own = query.removeprefix("WITH ")
    return "WITH " + ",\n".join(parts) + (",\n" if own != query else "\n") + own if parts else query


class Documents:
    """The table and what is derived from it, when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.docs = spark, read_table(spark, sf_dir, "documents")
        self.embeddings = lambda: read_table(spark, sf_dir, "embeddings")

    @property
    def pages(self) -> DataFrame:
        return structure.page_list(self.docs)

    @property
    def totals(self) -> DataFrame:
        return structure.document_totals(self.pages)

    @property
    def toc(self) -> DataFrame:
        return source.toc(self.docs)

    @property
    def spans(self) -> DataFrame:
        return structure.section_spans(self.toc, self.totals)

    @property
    def tree(self) -> DataFrame:
        return structure.toc_parents(self.toc)

    @property
    def sections(self) -> DataFrame:
        return md.md_sections(source.markdown(self.docs))


def query(sql: str | None = None):
    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(Documents(spark, sf_dir))

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        if sql is not None:
            ORACLES[f.__name__] = with_tables(sql)
        return f

    return register


@query("SELECT doc_id, page_no, text, tokens FROM t_pages")
def page_list(d):
    return d.pages


@query("SELECT doc_id, ord, structure, title, start_index, end_index FROM t_spans")
def section_spans(d):
    return d.spans


@query("""SELECT doc_id, ord, structure, title, physical_index FROM t_toc
UNION ALL SELECT doc_id, 0, '0', 'Preface', 1 FROM (SELECT doc_id, arg_min(physical_index, ord) AS first FROM t_toc GROUP BY doc_id) f WHERE first > 1""")
def toc_preface(d):
    return structure.toc_preface(d.toc)


@query("""SELECT doc_id, ord, title, CASE WHEN physical_index <= total_pages THEN physical_index END AS physical_index
FROM t_toc LEFT JOIN t_totals USING (doc_id)""")
def toc_validate(d):
    return structure.toc_validate(d.toc, d.totals).select("doc_id", "ord", "title", "physical_index")


@query("SELECT doc_id, ord, structure, title, parent_ord FROM t_tree")
def toc_parents(d):
    return d.tree


@query("""SELECT a.doc_id, a.ord, a.title, a.parent_ord,
  CASE WHEN a.parent_ord IS NULL THEN 0 WHEN b.parent_ord IS NULL THEN 1 ELSE 2 END AS depth
FROM t_tree a LEFT JOIN t_tree b ON b.doc_id = a.doc_id AND b.ord = a.parent_ord""")
def section_depth(d):
    return structure.section_depth(d.tree).select("doc_id", "ord", "title", "parent_ord", "depth")


@query("SELECT doc_id, ord, title FROM t_tree a WHERE NOT EXISTS (SELECT 1 FROM t_tree b WHERE b.doc_id = a.doc_id AND b.parent_ord = a.ord)")
def leaf_nodes(d):
    return structure.leaf_nodes(d.tree).select("doc_id", "ord", "title")


@query("""SELECT doc_id, ord, title, CASE WHEN ord > 10000 THEN CAST(ord - 1 AS VARCHAR) ELSE lpad(CAST(ord - 1 AS VARCHAR), 4, '0') END AS node_id FROM t_toc""")
def node_ids(d):
    return structure.node_ids(d.toc).select("doc_id", "ord", "title", "node_id")


@query("""SELECT doc_id, ord, title, coalesce((SELECT arg_max(b.physical_index, b.ord) FROM t_toc b WHERE b.doc_id = a.doc_id AND b.ord < a.ord AND b.physical_index IS NOT NULL), 0) AS before,
  coalesce((SELECT arg_min(b.physical_index, b.ord) FROM t_toc b WHERE b.doc_id = a.doc_id AND b.ord > a.ord AND b.physical_index IS NOT NULL), -1) AS after
FROM t_toc a WHERE physical_index IS NULL""")
def toc_gap_bounds(d):
    return structure.toc_gap_bounds(d.toc)


_PAIRS = "SELECT a.doc_id, a.ord, a.title, a.page, b.physical_index FROM t_toc a JOIN t_toc b ON b.doc_id = a.doc_id AND b.title = a.title AND b.physical_index >= 1"


@query(_PAIRS)
def toc_matching_pairs(d):
    return structure.toc_matching_pairs(d.toc, d.toc).select("doc_id", "ord", "title", "page", "physical_index")


@query(f"""SELECT doc_id, page_offset FROM (SELECT doc_id, page_offset, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, f, page_offset) AS k
FROM (SELECT doc_id, physical_index - page AS page_offset, count(*) AS n, min(ord) AS f FROM ({_PAIRS}) p GROUP BY 1, 2) x) y WHERE k = 1""")
def page_offset(d):
    return structure.page_offset(structure.toc_matching_pairs(d.toc, d.toc))


@query("""SELECT doc_id, coalesce(avg(CASE WHEN physical_index IS NOT NULL THEN CAST(physical_index = page + 2 AS INT) END), 0) AS accuracy FROM t_toc GROUP BY doc_id""")
def toc_accuracy(d):
    checked = d.toc.select("doc_id", (F.col("physical_index") == F.col("page") + 2).cast("int").alias("correct"))
    return structure.toc_accuracy(checked)


@query("""SELECT s.doc_id, s.ord, string_agg(p.text, '' ORDER BY p.page_no) AS text FROM t_spans s
JOIN t_pages p ON p.doc_id = s.doc_id AND p.page_no BETWEEN s.start_index AND s.end_index GROUP BY s.doc_id, s.ord""")
def section_text(d):
    return structure.section_text(d.spans, d.pages)


_TOKENS = """SELECT s.doc_id, s.ord, s.title, s.start_index, s.end_index, CAST(sum(p.tokens) AS BIGINT) AS tokens FROM t_spans s
JOIN t_pages p ON p.doc_id = s.doc_id AND p.page_no BETWEEN s.start_index AND s.end_index GROUP BY ALL"""


@query(f"SELECT * FROM ({_TOKENS}) x WHERE end_index - start_index > 1 AND tokens >= 300")
def large_nodes(d):
    return structure.large_nodes(d.spans, d.pages, 1, 300)


@query(f"SELECT * FROM ({_TOKENS}) x WHERE tokens > 1000")
def token_limit_report(d):
    return structure.token_limit_report(d.spans, d.pages, 1000)


@query("""SELECT a.doc_id, a.ord, concat(repeat('  ', CASE WHEN a.parent_ord IS NULL THEN 0 WHEN b.parent_ord IS NULL THEN 1 ELSE 2 END), a.title) AS line
FROM t_tree a LEFT JOIN t_tree b ON b.doc_id = a.doc_id AND b.ord = a.parent_ord""")
def toc_listing(d):
    return structure.toc_listing(structure.section_depth(d.tree))


@query("SELECT doc_id, page_no AS ord, concat('Page ', CAST(page_no AS VARCHAR)) AS title, page_no AS start_index, page_no AS end_index FROM t_pages")
def fallback_structure(d):
    return structure.fallback_structure(d.pages)


@query("SELECT DISTINCT p.doc_id, p.page_no FROM t_spans s JOIN t_pages p ON p.doc_id = s.doc_id AND p.page_no BETWEEN s.start_index AND s.end_index")
def node_pages(d):
    return structure.node_pages(d.spans)


@query("""SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY page_no) AS context FROM t_pages WHERE page_no % 2 = 1 GROUP BY doc_id""")
def node_context(d):
    nodes = d.pages.select("doc_id", F.lpad(F.col("page_no").cast("string"), 9, "0").alias("node_id"), "text", "page_no")
    return structure.node_context(nodes.drop("page_no"), nodes.filter("page_no % 2 = 1"))


_CHUNKS = """WITH whole AS (
  SELECT doc_id, string_split(trim(regexp_replace(string_agg(concat('[Page ', CAST(page_no AS VARCHAR), '] ', text), chr(10) ORDER BY page_no), '\\s+', ' ', 'g')), ' ') AS w
  FROM t_pages WHERE trim(regexp_replace(text, '\\s+', ' ', 'g')) <> '' GROUP BY doc_id
), starts AS (SELECT doc_id, w, unnest(range(0, len(w), 450)) AS s FROM whole)
SELECT doc_id, CAST(s // 450 AS INT) AS chunk, array_to_string(w[s + 1 : s + 500], ' ') AS text, CAST(len(w[s + 1 : s + 500]) AS INT) AS word_count FROM starts"""


@query(_CHUNKS)
def chunk_words(d):
    return structure.chunk_words(d.pages)


#: Token limits of the groups: the usual one, and one that small documents reach.
_LIMITS = (20_000, 400)


def _groups(*limits: int) -> str:
    return f"""SELECT max_tokens, doc_id, g AS group_no, first_page, last_page, tokens FROM (
  WITH RECURSIVE p AS (
    SELECT l.max_tokens, doc_id, page_no, tokens, row_number() OVER w AS k, sum(tokens) OVER d AS total,
      ceil((sum(tokens) OVER d / ceil(sum(tokens) OVER d / l.max_tokens) + l.max_tokens) / 2) AS target
    FROM t_pages CROSS JOIN (VALUES {", ".join(f"({n})" for n in limits)}) l(max_tokens)
    WINDOW w AS (PARTITION BY l.max_tokens, doc_id ORDER BY page_no), d AS (PARTITION BY l.max_tokens, doc_id)
  ), walk AS (
    SELECT max_tokens, doc_id, k, k AS first, CAST(tokens AS BIGINT) AS held, tokens AS last, 0 AS g FROM p WHERE k = 1
    UNION ALL
    SELECT max_tokens, doc_id, k, CASE WHEN cut THEN k - 1 ELSE first END, CASE WHEN cut THEN last ELSE held END + n, n, g + CAST(cut AS INT)
    FROM (SELECT w.max_tokens, w.doc_id, p.k, w.first, w.held, w.last, w.g, p.tokens AS n, p.total > w.max_tokens AND w.held + p.tokens > p.target AS cut
      FROM walk w JOIN p ON p.max_tokens = w.max_tokens AND p.doc_id = w.doc_id AND p.k = w.k + 1) x
  ), ends AS (SELECT max_tokens, doc_id, g, max(k) AS last, min(first) AS first FROM walk GROUP BY max_tokens, doc_id, g)
  SELECT e.max_tokens, e.doc_id, e.g, CAST(min(p.page_no) AS INT) AS first_page, CAST(max(p.page_no) AS INT) AS last_page, CAST(sum(p.tokens) AS BIGINT) AS tokens
  FROM ends e JOIN p ON p.max_tokens = e.max_tokens AND p.doc_id = e.doc_id AND p.k BETWEEN e.first AND e.last GROUP BY e.max_tokens, e.doc_id, e.g) t"""


@query(_groups(*_LIMITS))
def page_groups(d):
    out = None
    for limit in _LIMITS:
        found = structure.page_groups(d.pages, limit).select(F.lit(limit).alias("max_tokens"), "*")
        out = found if out is None else out.unionByName(found)
    return out


@query(f"""WITH said AS (SELECT doc_id, page_no, length(text) % 3 AS said FROM t_pages),
begun AS (SELECT doc_id, min(page_no) AS first FROM said WHERE said = 0 AND page_no <= {contents.CHECK_PAGES} GROUP BY doc_id),
ended AS (SELECT b.doc_id, b.first, min(s.page_no) AS stop FROM begun b LEFT JOIN said s ON s.doc_id = b.doc_id AND s.said = 1 AND s.page_no > b.first GROUP BY b.doc_id, b.first)
SELECT s.doc_id, s.page_no FROM said s JOIN ended e ON e.doc_id = s.doc_id WHERE s.said = 0 AND s.page_no >= e.first AND (e.stop IS NULL OR s.page_no < e.stop)""")
def contents_pages(d):
    """The run of pages that a model takes for contents, asked for in waves."""
    pages = materialise(d.pages, "pages")
    return contents.contents_pages(pages, pages.select("doc_id").distinct().withColumn("start", F.lit(1)), PageReader())


_SHIFTED = """shifted AS (SELECT c.doc_id, c.ord, c.title, CAST(c.page + 2 + CASE WHEN (c.ord + c.doc_id) % 4 = 0 THEN 1 ELSE 0 END AS INT) AS physical_index, t.total_pages
  FROM t_toc c JOIN t_totals t USING (doc_id) WHERE c.page + 2 + CASE WHEN (c.ord + c.doc_id) % 4 = 0 THEN 1 ELSE 0 END <= t.total_pages),
far AS (SELECT doc_id, arg_max(physical_index, ord) >= any_value(total_pages) / 2 AS is_far FROM shifted GROUP BY doc_id),
checks AS (SELECT s.*, contains(p.text, substring(s.title, 6)) AS correct FROM shifted s JOIN far USING (doc_id) JOIN t_pages p ON p.doc_id = s.doc_id AND p.page_no = s.physical_index WHERE is_far),
accuracies AS (SELECT f.doc_id, coalesce(avg(CAST(c.correct AS DOUBLE)), 0) AS accuracy FROM far f LEFT JOIN checks c USING (doc_id) GROUP BY f.doc_id)"""


def _shifted(d, pages: DataFrame) -> DataFrame:
    """Contents of which every fourth entry is a page late."""
    late = F.when((F.col("ord") + F.col("doc_id")) % 4 == 0, 1).otherwise(0)
    rows = d.toc.withColumn("physical_index", (F.col("page") + 2 + late).cast("int"))
    valid = structure.toc_validate(rows, structure.document_totals(pages)).filter("physical_index is not null")
    return materialise(valid.select("doc_id", "ord", "structure", "title", "physical_index"), "entries")


@query(f"""WITH {_SHIFTED}
SELECT doc_id, accuracy, CASE WHEN accuracy = 1 THEN 'accept' WHEN accuracy > 0.6 THEN 'fix' ELSE 'toc_without_page_numbers' END AS decision FROM accuracies""")
def contents_decisions(d):
    """What follows the check of every document's contents."""
    pages = materialise(d.pages, "pages")
    accuracy = contents.verified(_shifted(d, pages), pages, PageReader())[1]
    return accuracy.withColumn("decision", structure.toc_decision(F.col("accuracy"), F.lit(structure.WAYS[0])))


@query(f"""WITH {_SHIFTED}, bounds AS (SELECT c.*, coalesce(last_value(CASE WHEN correct THEN physical_index END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
  coalesce(first_value(CASE WHEN correct THEN physical_index END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), total_pages) AS after
  FROM checks c JOIN accuracies a USING (doc_id) WHERE a.accuracy > 0.6),
found AS (SELECT b.doc_id, b.ord, min(p.page_no) AS page_no FROM bounds b JOIN t_pages p ON p.doc_id = b.doc_id AND p.page_no BETWEEN b.before AND b.after AND contains(p.text, substring(b.title, 6)) WHERE NOT b.correct GROUP BY 1, 2)
SELECT b.doc_id, b.ord, b.title, CAST(coalesce(f.page_no, b.physical_index) AS INT) AS physical_index, b.correct OR f.page_no IS NOT NULL AS correct FROM bounds b LEFT JOIN found f ON f.doc_id = b.doc_id AND f.ord = b.ord""")
def contents_fixed(d):
    """Entries of contents that are right or can be fixed, after the rounds of fixing."""
    pages = materialise(d.pages, "pages")
    looked, accuracy = contents.verified(_shifted(d, pages), pages, PageReader())
    rows = looked.join(accuracy.filter(F.col("accuracy") > structure.FIXABLE).select("doc_id"), "doc_id", "left_semi")
    return contents.fixed(rows, pages, PageReader()).select("doc_id", "ord", "title", "physical_index", "correct")


#: Tokens of a group whose entries are carried on.
_CARRIED = 2_000


@query(f"""SELECT doc_id, CAST(k - 1 AS INT) AS ord, CAST(k AS VARCHAR) AS structure, substring(text, 1, 12) AS title, page_no AS physical_index FROM (
  SELECT g.doc_id, p.page_no, p.text, row_number() OVER (PARTITION BY g.doc_id ORDER BY g.group_no, p.page_no) AS k
  FROM ({_groups(_CARRIED)}) g JOIN t_pages p ON p.doc_id = g.doc_id AND p.page_no BETWEEN g.first_page AND g.last_page) x""")
def carried_contents(d):
    """Sections listed group by group, each numbered on from the last that its prompt shows."""
    return contents.carried_contents(materialise(d.pages, "pages"), PageReader(), _CARRIED)


@query("""SELECT doc_id, depth, title, node_id, ord FROM (SELECT a.doc_id, a.title, lpad(CAST(a.ord - 1 AS VARCHAR), 4, '0') AS node_id, a.ord,
  CASE WHEN a.parent_ord IS NULL THEN 0 WHEN b.parent_ord IS NULL THEN 1 ELSE 2 END AS depth
  FROM t_tree a LEFT JOIN t_tree b ON b.doc_id = a.doc_id AND b.ord = a.parent_ord) x""")
def flatten_tree(d):
    """Trees written as nested JSON and read back."""
    nodes = structure.node_ids(d.tree).withColumns({"start_index": F.col("ord"), "end_index": F.col("ord")})
    return structure.flatten_tree(materialise(structure.nested_json(nodes), "trees")).select("doc_id", "depth", "title", "node_id", "ord")


#: Columns that documents are searched by, and what a model answers to some questions.
_SEARCHED = {"lang": "string", "source": "string", "n_chars": "long"}
_CONDITIONS = {
    1: '[{"column": "lang", "comparison": "=", "value": "en"}, {"column": "n_chars", "comparison": ">", "value": 5000}]',
    2: '```json\n[{"column": "source", "comparison": "in", "value": ["src1", "src2"]}, {"column": "lang", "comparison": "!=", "value": "en"}]\n```',
    3: '[{"column": "source", "comparison": "contains", "value": "7"}, {"column": "n_chars", "comparison": "<=", "value": 900}]',
}


@query("""SELECT CAST(1 AS BIGINT) AS question_id, doc_id FROM documents WHERE lang = 'en' AND n_chars > 5000
UNION ALL SELECT 2, doc_id FROM documents WHERE source IN ('src1', 'src2') AND lang <> 'en' UNION ALL SELECT 3, doc_id FROM documents WHERE contains(source, '7') AND n_chars <= 900""")
def metadata_search(d):
    """Documents by conditions that a model gave as JSON."""
    return search.by_metadata(d.docs, {k: search.predicate(a, _SEARCHED) for k, a in _CONDITIONS.items()})


@query("""WITH scored AS (SELECT doc_id, ord, parent_ord, CAST((ord * 37 + doc_id * 11) % 101 AS DOUBLE) AS score FROM t_tree),
first AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, ord) AS k FROM scored WHERE parent_ord IS NULL),
second AS (SELECT s.*, row_number() OVER (PARTITION BY s.doc_id ORDER BY s.score DESC, s.ord) AS k FROM scored s JOIN first f ON f.doc_id = s.doc_id AND f.ord = s.parent_ord AND f.k <= 2),
third AS (SELECT s.*, 0 AS k FROM scored s JOIN second f ON f.doc_id = s.doc_id AND f.ord = s.parent_ord AND f.k <= 2)
SELECT doc_id AS question_id, doc_id, CAST(rank AS INT) AS rank, ord, depth, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, ord) AS rank FROM (
  SELECT doc_id, ord, score, 0 AS depth FROM first UNION ALL SELECT doc_id, ord, score, 1 FROM second UNION ALL SELECT doc_id, ord, score, 2 FROM third) u) r WHERE rank <= 3""")
def tree_search(d):
    """A walk down every document's tree below the best two nodes of each level."""
    tree = materialise(d.tree.withColumn("summary", F.lit(None).cast("string")), "tree")
    asked = tree.select(F.col("doc_id").alias("question_id"), "doc_id").distinct().withColumn("question", F.lit("which?"))
    score = lambda rows: rows.withColumn("score", ((F.col("ord") * 37 + F.col("doc_id") * 11) % 101).cast("double"))
    return search.tree_search(tree, asked, score, 2, 3)[0]


_LINES = """lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_num FROM t_markdown
), bared AS (SELECT *, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS bare FROM lines
), fenced AS (SELECT *, starts_with(bare, '```') AS fence, sum(CAST(starts_with(bare, '```') AS INT)) OVER (PARTITION BY doc_id ORDER BY line_num) % 2 = 1 AS inside FROM bared
), marked AS (SELECT *, NOT fence AND NOT inside AND regexp_matches(bare, '^#{1,6}\\s+\\S') AS heading FROM fenced)"""


@query(f"WITH {_LINES} SELECT doc_id, CAST(line_num AS INT) AS line_num, regexp_extract(bare, '^#{{1,6}}\\s+(.+)$', 1) AS title FROM marked WHERE heading")
def md_headings(d):
    return md.md_headings(source.markdown(d.docs))


_SECTIONS = f"""{_LINES}, numbered AS (
  SELECT *, sum(CAST(heading AND starts_with(line, '#') AS INT)) OVER (PARTITION BY doc_id ORDER BY line_num) AS ord FROM marked
), secs AS (
  SELECT doc_id, CAST(ord AS INT) AS ord, CAST(min(line_num) AS INT) AS line_num, CAST(length(regexp_extract(arg_min(line, line_num), '^(#{{1,6}})', 1)) AS INT) AS level,
    regexp_extract(arg_min(bare, line_num), '^#{{1,6}}\\s+(.+)$', 1) AS title, regexp_replace(string_agg(line, chr(10) ORDER BY line_num), '^\\s+|\\s+$', '', 'g') AS text
  FROM numbered WHERE ord > 0 GROUP BY doc_id, ord)"""


@query(f"WITH {_SECTIONS} SELECT * FROM secs")
def md_sections(d):
    return d.sections


@query(f"""WITH {_SECTIONS} SELECT a.doc_id, a.ord, a.level, a.title,
  (SELECT max(b.ord) FROM secs b WHERE b.doc_id = a.doc_id AND b.ord < a.ord AND b.level < a.level) AS parent_ord FROM secs a""")
def md_tree(d):
    return md.md_tree(d.sections).select("doc_id", "ord", "level", "title", "parent_ord")


_TOKENS = """ends AS (
  SELECT a.doc_id, a.ord, a.level, a.title, coalesce((SELECT min(b.ord) FROM secs b WHERE b.doc_id = a.doc_id AND b.ord > a.ord AND b.level <= a.level), 1000000000) AS e FROM secs a
), sized AS (
  SELECT x.doc_id, x.ord, x.level, x.title, CAST(ceil(length(string_agg(s.text, chr(10) ORDER BY s.ord)) / 4.0) AS BIGINT) AS tokens
  FROM ends x JOIN secs s ON s.doc_id = x.doc_id AND s.ord >= x.ord AND s.ord < x.e AND s.text <> '' GROUP BY x.doc_id, x.ord, x.level, x.title)"""


@query(f"WITH {_SECTIONS}, {_TOKENS} SELECT * FROM sized")
def md_subtree_tokens(d):
    return md.md_subtree_tokens(d.sections)


@query(f"""WITH {_SECTIONS}, {_TOKENS}, small AS (SELECT z.doc_id, z.ord, e.e FROM sized z JOIN ends e USING (doc_id, ord) WHERE z.tokens < 100
), tops AS (SELECT * FROM small s WHERE NOT EXISTS (SELECT 1 FROM small o WHERE o.doc_id = s.doc_id AND o.ord < s.ord AND o.e > s.ord)
), merged AS (
  SELECT t.doc_id, t.ord, count(*) AS n, string_agg(CASE WHEN s.ord = t.ord THEN '' WHEN ends_with(before, chr(10)) THEN '' ELSE chr(10) || chr(10) END || s.text, '' ORDER BY s.ord) AS text
  FROM tops t JOIN (SELECT *, lag(text) OVER (PARTITION BY doc_id ORDER BY ord) AS before FROM secs) s ON s.doc_id = t.doc_id AND s.ord >= t.ord AND s.ord < t.e GROUP BY t.doc_id, t.ord)
SELECT z.doc_id, z.ord, z.level, z.title, coalesce(m.text, s.text) AS text, CASE WHEN m.n > 1 THEN CAST(ceil(length(m.text) / 4.0) AS BIGINT) ELSE z.tokens END AS tokens
FROM sized z JOIN secs s USING (doc_id, ord) LEFT JOIN merged m USING (doc_id, ord)
WHERE NOT EXISTS (SELECT 1 FROM tops t JOIN ends e ON e.doc_id = t.doc_id AND e.ord = t.ord WHERE t.doc_id = z.doc_id AND t.ord < z.ord AND e.e > z.ord)""")
def md_thinning(d):
    return md.md_thinning(d.sections)


_VECTORS = "(SELECT vec_id + 1 AS entity_id, CAST(label AS VARCHAR) AS entity_type, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"
_SIMILAR = f"""SELECT * FROM (
  SELECT p.entity_id AS probe_id, e.entity_id, e.entity_type, round(1 - list_cosine_similarity(e.v, p.v), 6) AS distance,
    CAST(row_number() OVER (PARTITION BY p.entity_id ORDER BY round(1 - list_cosine_similarity(e.v, p.v), 6), e.entity_id) AS INT) AS ord
  FROM {_VECTORS} e JOIN {_VECTORS} p ON p.entity_type = e.entity_type AND p.entity_id <> e.entity_id
  WHERE p.entity_id % 100 = 0 AND round(1 - list_cosine_similarity(e.v, p.v), 6) < 0.9) x WHERE ord <= 5"""


def _entities(d):
    return d.embeddings().select((F.col("vec_id") + 1).alias("entity_id"), F.col("label").cast("string").alias("entity_type"), F.col("embedding").alias("name_embedding"))


def _similar(d):
    e = _entities(d)
    return vectors.similar_entities(e, e.filter("entity_id % 100 = 0"), 0.9)


@query(_SIMILAR)
def similar_entities(d):
    return _similar(d)


#: Every entity against the earlier ones of its type.
_RESOLVED = _SIMILAR.replace("p.entity_id <> e.entity_id", "p.entity_id > e.entity_id").replace("p.entity_id % 100 = 0 AND ", "")


def _resolved(d):
    return vectors.similar_entities(_entities(d), _entities(d), 0.9, earlier=True)


_TOPK = f"""SELECT probe_id, id, score, ord FROM (
  SELECT p.entity_id AS probe_id, e.entity_id AS id, round(list_cosine_similarity(e.v, p.v), 6) AS score,
    CAST(row_number() OVER (PARTITION BY p.entity_id ORDER BY round(list_cosine_similarity(e.v, p.v), 6) DESC, e.entity_id) AS INT) AS ord
  FROM {_VECTORS} e CROSS JOIN {_VECTORS} p WHERE p.entity_id % 100 = 0) x WHERE ord <= 5"""


def _topk(d):
    e = d.embeddings().select((F.col("vec_id") + 1).alias("id"), F.col("embedding").alias("vector"))
    return vectors.cosine_topk(e, e.filter("id % 100 = 0"))


@query(_TOPK)
def cosine_topk(d):
    return _topk(d)


@query(f"SELECT probe_id, entity_id, distance, CASE WHEN distance < 0.6 THEN 'auto' WHEN distance < 0.75 THEN 'llm' ELSE 'reject' END AS action FROM ({_RESOLVED}) s")
def resolution_action(d):
    return _resolved(d).select("probe_id", "entity_id", "distance", vectors.resolution_action(F.col("distance"), 0.6, 0.75).alias("action"))


@query(f"""SELECT entity_id AS canonical_id, probe_id AS alias_id, round(1 - distance, 4) AS similarity, 0 AS confirmed FROM (
  SELECT *, row_number() OVER (PARTITION BY probe_id ORDER BY distance, entity_id) AS k FROM ({_RESOLVED}) s WHERE distance < 0.85) x WHERE k = 1""")
def entity_aliases(d):
    return vectors.entity_aliases(_resolved(d), None, 0.85, 0.9)


@query(f"""SELECT action, count(*) AS n FROM (SELECT CASE WHEN distance < 0.6 THEN 'auto' WHEN distance < 0.75 THEN 'llm' ELSE 'reject' END AS action FROM ({_RESOLVED}) s) x GROUP BY action""")
def resolution_stats(d):
    return vectors.resolution_stats(_resolved(d), 0.6, 0.75)


@query("SELECT doc_id, sum(tokens / 1000.0) / sqrt(count(*) + 1) AS doc_score FROM t_pages GROUP BY doc_id")
def doc_score(d):
    return vectors.doc_score(d.pages.select("doc_id", (F.col("tokens") / 1000.0).alias("score")))
