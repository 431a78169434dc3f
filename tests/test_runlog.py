"""The log of a run: what is counted, without a further job, and what becomes of errors."""

import pytest
from pyspark.sql import functions as F

from arbograph.graph import DocumentGraph
from arbograph.plans import indexing
from arbograph.runlog import RunLog, counted
from arbograph.session import materialise
from tests.test_indexing import V1, V2, dictionary, scripted


def rows(spark, path):
    return {r.step: r for r in RunLog.read(spark, str(path)).collect()}


def test_steps_of_indexing(spark, tmp_path):
    docs = spark.createDataFrame([("a.md", "g", 1, V1), ("b.md", "g", 2, V2)], "doc_name string, doc_group string, doc_version int, text string")
    log = RunLog(spark, str(tmp_path / "log"))
    g = indexing.index_markdown(DocumentGraph(spark), docs, dictionary(spark), scripted(), log=log)
    found = rows(spark, tmp_path / "log")
    assert {r.run for r in found.values()} == {log.run} and sorted(r.place for r in found.values()) == list(range(1, len(found) + 1))
    for table in ("documents", "sections", "section_hierarchy", "entities", "section_entities", "entity_relationships", "temporal_edges"):
        assert found[table].rows_out == g[table].count() and found[table].error is None and found[table].seconds > 0
    assert found["sections"].rows_in == found["sections"].rows_out == 6 and found["sections"].rejected == 0
    assert found["entities"].rows_in == found["section_entities"].rows_in == found["section_entities"].rows_out
    assert found["entities"].rejected == found["entities"].rows_in - 3
    # the relationship to somebody whom no entity is called by goes
    assert found["entity_relationships"].rejected == found["relationships_found"].rows_out - found["entity_relationships"].rows_out > 0
    # a second run adds its rows, and only what it adds is counted
    indexing.index_markdown(g, docs.filter("doc_version = 1").withColumn("doc_version", F.lit(3)), dictionary(spark), log=RunLog(spark, str(tmp_path / "log")))
    later = RunLog.read(spark, str(tmp_path / "log")).filter(F.col("run") != log.run)
    assert {r.step: r.rows_out for r in later.collect()}.items() >= {"documents": 1, "sections": 2, "entities": 0}.items()


def test_entries_without_a_page_are_rejected(spark, tmp_path):
    docs = spark.createDataFrame([("p.pdf", "g", 1)], "doc_name string, doc_group string, doc_version int")
    pages = spark.createDataFrame([("p.pdf", k, f"page {k}", 10) for k in range(1, 6)], "doc_name string, page_no int, text string, tokens long")
    indexing.index_pages(DocumentGraph(spark), docs, pages, dictionary(spark), scripted(), log=RunLog(spark, str(tmp_path / "log")))
    found = rows(spark, tmp_path / "log")
    assert (found["contents"].rows_in, found["contents"].rejected, found["pages"].rows_out) == (3, 1, 5)


def test_counts_need_no_job_of_their_own(spark, tmp_path):
    df = spark.range(100)

    def jobs(group, log):
        spark.sparkContext.setJobGroup(group, group)
        try:
            with log.step("s") as step:
                materialise(counted(df, "rows_in", F.col("id") < 10), "rows")
                inside = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return inside, step

    plain, silent = jobs("without", RunLog(spark, None))
    logged, step = jobs("with", RunLog(spark, str(tmp_path / "log")))
    assert plain == logged
    assert (step["rows_in"], step["rejected"], step["rows_out"]) == (100, 10, None)
    assert silent["rows_in"] is None
    assert counted(df, "rows_in") is df


def test_frames_that_are_left_out_count_as_empty(spark, tmp_path):
    with RunLog(spark, str(tmp_path / "log")).step("s", rows_in=4) as step:
        materialise(counted(spark.range(5), "rows_out").filter("false"), "rows")
    assert (step["rows_out"], step["rejected"]) == (0, 4)


def test_errors_are_logged_and_raised(spark, tmp_path):
    with pytest.raises(KeyError):
        with RunLog(spark, str(tmp_path / "log")).step("s"):
            raise KeyError("gone")
    row = rows(spark, tmp_path / "log")["s"]
    assert row.error == "KeyError: 'gone'" and row.rows_in is None
    df = spark.range(3)
    assert counted(df, "rows_in") is df
